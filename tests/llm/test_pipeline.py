import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lantern.llm import common, langid, neardup, pii, registry, repeats
from tests.llm import test_neardup
from tests.llm.test_langid import WORDS
from tests.llm.test_repeats import brute as removed

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(21)
    passage = " ".join(r.choice(WORDS["en"]) + str(k) for k in range(60))
    rows = []
    for i in range(60):
        lang = r.choice(list(WORDS))
        text = " ".join(r.choice(WORDS[lang]) + r.choice(["", "", f"x{i}"]) for _ in range(r.choice([30, 80, 200])))
        if i % 7 == 0:
            text += " " + passage + f" end{i}"
        if i % 5 == 0:
            text += f" call +1 (555) 01{i:02d}-4567 or me{i}@mail.org"
        rows.append((i, text, lang))
    rows += [(100 + k, rows[k][1], rows[k][2]) for k in range(5)]
    rows += [(200 + k, rows[8][1] + f" tail{k}", "en") for k in range(4)]
    rows += [(300, None, "en"), (301, "", "fr"), (302, "zzkq " * 200, None), (303, "12345 !!", "de")]
    return [(d, t, lang, "src0", len(t or "")) for d, t, lang in rows]


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_equals_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = langid.fit(langid.learnable(docs))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    rows = [x for x, (_, _, no) in zip(rows, langid.predict([t for _, t in rows], model)) if not no]
    assert {d for d, _ in rows} >= set(range(60)) and not {300, 301, 302, 303} & {d for d, _ in rows}
    groups = test_neardup.brute(rows)
    rows = [(d, t) for d, t in rows if groups[d][1] == d]
    assert not {100, 101, 200} & {d for d, _ in rows}
    lost = {d: n for d, _, n, _, _ in removed(rows, repeats.LENGTH)}
    assert sum(n > 0 for n in lost.values()) >= 5
    seen, cut = {}, []
    for d, t in rows:
        raw = t.encode()
        for i in range(len(raw) - repeats.LENGTH + 1):
            seen[raw[i : i + repeats.LENGTH]] = seen.get(raw[i : i + repeats.LENGTH], 0) + 1
    for d, t in rows:
        raw, gone = t.encode(), set()
        for i in range(len(raw) - repeats.LENGTH + 1):
            if seen[raw[i : i + repeats.LENGTH]] > 1:
                gone.update(range(i, i + repeats.LENGTH))
        cut.append((d, bytes(b for i, b in enumerate(raw) if i not in gone).decode("utf-8", "ignore")))
    weights, clean = pii.trained(), []
    for d, t in cut:
        for kind, a, b in sorted(pii.all_spans(t, weights)[1], key=lambda s: -s[1]):
            t = t[:a] + f"[{kind.upper()}]" + t[b:]
        clean.append((d, t))
    assert any("[EMAIL]" in t for _, t in clean)
    tokenizer = Tokenizer.from_file(common.tokenizer_path("byte_bpe_50k.json"))
    want = []
    for d, t in clean:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        assert len(ids) <= 2048
        want.append((d, 0, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= sum(r.length for r in got) // 2048 + 2


def test_stages_keep_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, folder), "t")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert docs.where("n_chars <> length(text)").count() == 0


def test_stages_take_empty_tables_nulls_and_clashing_columns(spark):
    odd = "doc_id long, text string, lang string, source string, n_chars long, sum long, found string, kept boolean, score double, row string, rejected boolean"
    rows = [(1, "the of and to", "en", None, None, 1, "f", True, 0.5, "r", False), (1, "the of and to", "en", None, None, 1, "f", True, 0.5, "r", False), (None, "the of and to in", None, "s", 3, None, None, None, None, None, None)]
    for data in ([], rows):
        for name, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame(data, odd)
            out = stage(spark, docs, "")
            n = out.count()
            assert n == len(data) or name == "near_duplicates" and n == 2, (name, n)
            assert name == "packing" or out.columns == docs.columns


def test_registry_names_each_operator_once():
    assert sorted(int(n.split("_")[0][2:]) for n in registry.QUERIES) == list(range(1, 11))
    assert set(registry.ORACLES) <= set(registry.QUERIES) and neardup.BANDS * neardup.ROWS == 220
