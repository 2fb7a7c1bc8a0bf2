import random
import time

from lantern.llm import pii


def _kept(text, found):
    """All but addresses with both ``@`` and blanks, which are left out on purpose."""
    return sorted((a, b, kind) for a, b, kind in found if not ("@" in text[a:b] and " " in text[a:b]))


def whole(text):
    edges, found = pii.candidates(text, 0, len(text))
    return _kept(text, [(edges[i], edges[j], kind) for i, j, kind in found])


def by_parts(text):
    out = []
    for low, high in pii.neighbourhoods(text):
        edges, found = pii.candidates(text, low, high)
        out += [(edges[i], edges[j], kind) for i, j, kind in found]
    return _kept(text, out)


def test_neighbourhoods_hold_every_segment_of_the_whole_text():
    r = random.Random(12)
    bits = ["john", "j.d", "[at]", "(at)", "[dot]", "(dot)", "@", "j@a.org", ".", "-", "internationalorganization", "org", "co", "x9", "555", "1234", "(", ")", "+", "?", "é", "\n", "\t", "          "]
    for _ in range(6000):
        text = "".join(r.choice(bits) + r.choice(["", " ", " ", "  "]) for _ in range(r.randint(1, 22)))
        assert by_parts(text) == whole(text), text
        ranges = list(pii.neighbourhoods(text))
        assert all(a < b for a, b in ranges) and all(b < c for (_, b), (c, _) in zip(ranges, ranges[1:])), text


def test_long_written_out_domains_are_found_whole():
    weights = pii.trained()
    for address in ("john [at] mail [dot] internationalorganization [dot] org", "mary.jones (at) administration (dot) internationalorganization (dot) example"):
        text = f"write to {address} soon"
        assert address in [text[a:b] for _, a, b in pii.all_spans(text, weights)[1]], text


def test_blanks_around_an_at_sign_make_no_address():
    assert pii.all_spans("We meet @ home. Then we go.", pii.trained())[1] == []


def test_written_out_separators_take_linear_time():
    start = time.time()
    for run in ("[at]" * 50_000, "a[at]b." * 30_000, "[at] a [dot] " * 15_000, "a@b . " * 15_000):
        list(pii.neighbourhoods(run))
    assert time.time() - start < 10
