import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lantern.llm import bpe, common, packing

SCHEMA = "doc_id long, text string, id string, task int"
WORDS = ["the", " it's", "we're", "  ", "\n\n", "größe", "don't", "123", " 4567", "!!!", "\t", "日本語", "🙂", "<|endoftext|>", "x" * 40, " " * 30, "'", "'r", "'re"]


def some_texts(seed, n, most):
    r = random.Random(seed)
    return ["".join(r.choice(WORDS) + r.choice(["", " "]) for _ in range(r.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    texts = some_texts(3, 60, 60) + ["", None, "a" * 3000, " " * 2500 + "b", "same", "same"]
    rows = [(i, t, "extra", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [rows[0], (rows[1][0], "another " * 90, "x", 1)], SCHEMA)


def expected(text):
    codec = bpe.Codec.at(common.tokenizer_path("byte_bpe_50k.tiktoken"))
    ids = np.array(codec.engine.encode_ordinary(text or ""), "<u4")
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("size,overlap", [(1 << 16, 1 << 12), (40, 16), (17, 6), (100, 50)])
def test_chunked_encoding_equals_whole_encoding(docs, size, overlap):
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(docs, chunk_chars=size, overlap=overlap).collect())
    assert got == sorted((r.doc_id, *expected(r.text)) for r in docs.collect())


@pytest.mark.parametrize("seed", range(4))
def test_chunks_of_blanks_runs_and_contractions(spark, seed):
    r = random.Random(seed)
    bits = [" \n", "\n\n", "  ", " ", "\t", "x", "word", "it's", "'re", "'", "12", "!?", "é", "z" * 50, " " * 40, "7" * 45, "\u00a0", "\x1d"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 150))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size, overlap in ((32, 8), (64, 20)):
        got = {x.doc_id: x.ids_sha256 for x in bpe.encode(rows, chunk_chars=size, overlap=overlap).collect()}
        assert got == {d: expected(t)[1] for d, t in enumerate(texts)}


def test_a_run_over_an_overlap_leaves_the_other_pieces(spark):
    words = "some words of a text, " * 400
    rows = spark.createDataFrame([(1, words + "z" * 900 + " " + words), (2, words * 2)], "id long, text string").withColumnRenamed("id", "key")
    cut = bpe._pieces(common.written(bpe._chunks(rows.withColumnRenamed("key", "id"), common.tokenizer_path("byte_bpe_50k.tiktoken"), 1000, 100), "t"), 1000)
    sizes = [r.of for r in cut.where("id = 1").orderBy("chunk").collect()]
    assert len(sizes) == 19 and max(sizes) <= 3 and sizes.count(1) >= 16
    assert {r.of for r in cut.where("id = 2").collect()} == {1}
    got = bpe.encode(rows, id_col="key", chunk_chars=1000, overlap=100)
    assert {r.key: r.ids_sha256 for r in got.collect()} == {r.key: expected(r.text)[1] for r in rows.collect()}


def test_round_trip(docs):
    encoded = bpe.encode(docs, keep_ids=True)
    back = sorted((r.doc_id, bytes(r.raw)) for r in bpe.decode(encoded).collect())
    assert back == sorted((r.doc_id, (r.text or "").encode()) for r in docs.collect())


def test_both_vocabulary_files_give_the_same_ranks():
    a = bpe.read_ranks(common.tokenizer_path("byte_bpe_50k.tiktoken"))
    assert a == bpe.read_ranks(common.tokenizer_path("byte_bpe_50k.json"))


def test_pieces_match_the_tokenizers_library(docs):
    reference = Tokenizer.from_file(common.tokenizer_path("byte_bpe_50k.json"))
    want = []
    for r in docs.collect():
        ids, start, k = [*reference.encode(r.text or "", add_special_tokens=False).ids, 0], 0, 0
        while start < len(ids):
            stop = start + ((len(ids) - start) % 50 or 50)
            want.append((r.doc_id, k, start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes())))
            start, k = stop, k + 1
    got = [tuple(r) for r in packing.pieces(docs, max_tokens=50).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("per_task,open_bins", [(1 << 20, 1024), (40, 1024), (40, 3), (7, 1)])
def test_packing_is_gapless_and_tight(docs, per_task, open_bins):
    parts = common.written(packing.pieces(docs, max_tokens=64), "t")
    rows = packing.pack(parts, max_tokens=64, open_bins=open_bins, pieces_per_task=per_task).collect()
    assert len(rows) == parts.count()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    if per_task > 1000 and open_bins > 100:
        assert len(bins) <= 1.02 * sum(r.length for r in rows) / 64 + 1


def test_packer_closes_the_fullest_first():
    p = packing.Packer(10, 2)
    assert [p.place(n) for n in (6, 7, 8)] == [(0, 0), (1, 0), (2, 0)]  # opening bin 2 closes bin 1
    assert p.place(2) == (2, 8)
    assert p.place(3) == (0, 6)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert bpe.encode(none).count() == 0
    assert packing.pack(common.written(packing.pieces(none), "t")).count() == 0
