import hashlib
import random
import re
import time

from lantern.llm import pii

SCHEMA = "doc_id long, text string, spans string, kind int"


def plain_regex(text):
    """The patterns as written, with nothing made faster."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        n = re.sub("[^0-9]", "", m.group())
        total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(n)))
        if 13 <= len(n) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def some_texts():
    r = random.Random(8)
    bits = ["a@b.c", "x.y@z-1.co.uk", "@", ".", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+", "٣٤", "0", "5", " ", "-", "é", "word", "%", "1" * 14, "(555) 123-4567", "\n", "password=ab12cd34ef56", "0000255.1.1.01"]
    return ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(3000)]


def test_base_spans_equal_the_plain_patterns():
    for text in some_texts():
        assert pii.base_spans(text) == plain_regex(text), text


def test_added_spans_touch_no_base_span_and_lie_in_order():
    weights = pii.trained()
    for text in some_texts():
        base, whole = pii.all_spans(text, weights)
        assert set(base) <= set(whole)
        added = sorted((a, b) for k, a, b in whole if (k, a, b) not in base)
        assert all(b <= c for (_, b), (c, _) in zip(added, added[1:]))
        assert not any(x < b and a < y for a, b in added for _, x, y in base)


def test_dynamic_program_is_the_best_labelling():
    r = random.Random(3)
    for _ in range(200):
        n = r.randint(1, 7)
        found = [(i, j, "card") for i in range(n) for j in range(i + 1, n + 1) if r.random() < 0.6]
        scores = [r.gauss(0, 1) for _ in found]
        top = 0.0
        for mask in range(1 << min(len(found), 14)):
            chosen = sorted(found[k][:2] for k in range(min(len(found), 14)) if mask >> k & 1)
            if all(a[1] <= b[0] for a, b in zip(chosen, chosen[1:])):
                top = max(top, sum(scores[k] for k in range(min(len(found), 14)) if mask >> k & 1))
        got = pii.best(n, found[:14], scores[:14])
        assert abs(sum(scores[found.index(x)] for x in got) - top) < 1e-9


def test_held_out_sentences():
    weights, hit, said, true_n = pii.trained(), 0, 0, 0
    for text, true in pii.sentences(seed=99, n=200):
        _, whole = pii.all_spans(text, weights)
        got = {(a, b, k) for k, a, b in whole}
        hit, said, true_n = hit + len(got & true), said + len(got), true_n + len(true)
    assert hit / true_n > 0.85 and hit / said > 0.85, (hit, said, true_n)


def test_finds_what_patterns_miss():
    weights = pii.trained()
    for text, span in [("call (464) 555-9887 now", "(464) 555-9887"), ("token = \"0641917ea4e9feb9cda83477b57ac2654884f485\" end", "0641917ea4e9feb9cda83477b57ac2654884f485"), ("mail jane [at] place [dot] org please", "jane [at] place [dot] org"), ("+1 (578) 555-6437 4918187128635271 x", "4918187128635271")]:
        assert span in [text[a:b] for _, a, b in pii.all_spans(text, weights)[1]], text
    clean = "In 2024 the 12 teams met on 2024-05-06 at 10:30 with 1,234.50 and version 3.12.1 of it."
    assert pii.all_spans(clean, weights)[1] == []


def test_long_runs_take_linear_time():
    start = time.time()
    for run in ("1" * 200_000, "a" * 200_000, "1." * 100_000, "1 " * 20_000, "+1 " * 20_000, "a@" * 50_000, "(" * 100_000):
        pii.all_spans(run, pii.trained())
    assert time.time() - start < 30


def test_table(spark):
    rows = [(1, "a@b.co and 1.2.3.4", "s", 1), (1, "a@b.co and 1.2.3.4", "s", 1), (2, None, "s", 1), (3, "", "s", 1), (None, "é +1 (555) 123-4567", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    base = "email:0:6,ip:11:18"
    assert (got[1].n_email, got[1].n_ip, got[1].spans, got[1].base_sha256) == (1, 1, base, hashlib.sha256(base.encode()).hexdigest())
    assert got[2].base_sha256 == got[3].base_sha256 == hashlib.sha256(b"").hexdigest() and got[None].spans == "phone:2:19"
    clean = pii.redacted(df)
    assert clean.columns == df.columns
    assert sorted(r.text or "" for r in clean.collect()) == ["", "", "[EMAIL] and [IP]", "[EMAIL] and [IP]", "é [PHONE]"]
    assert pii.personal_data(df.limit(0)).count() == 0 and pii.redacted(df.limit(0)).count() == 0
