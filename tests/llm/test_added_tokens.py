import random
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from lantern.llm import bpe, common, packing

END = "<|endoftext|>"


def some_texts():
    r = random.Random(11)
    bits = [END, END[:-1], "|>", "<", " ", "  ", "\n", "word", " it's", "12", "é", "🙂"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 12))) for _ in range(200)]
    return [*texts, f"hello {END} world", END, END * 3, f"x{END} ", "a" * 3000 + END, "", None]


def expected(texts):
    tokenizer = Tokenizer.from_file(common.tokenizer_path("byte_bpe_50k.json"))
    out = []
    for d, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert len(ids) <= packing.MAX_TOKENS
        out.append((d, 0, 0, len(ids), zlib.crc32(ids.tobytes())))
    return out


def test_query_gives_the_ids_of_the_library_with_its_defaults(spark, tmp_path):
    texts = some_texts()
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = packing.op7_packing(spark, str(tmp_path)).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == expected(texts)


def test_pipeline_stage_gives_them_too(spark):
    texts = some_texts()
    got = corpus_pipeline.packed(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "").collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected(texts)


def test_codec_knows_the_added_id():
    codec = bpe.Codec.at(common.tokenizer_path("byte_bpe_50k.json"))
    ids = codec.ids_with_added(f"hello {END} world")
    assert ids.tolist() == [31373, 220, 50256, 995] and codec.decode(ids) == f"hello {END} world".encode()
    assert 50256 not in codec.ids(f"hello {END} world")
