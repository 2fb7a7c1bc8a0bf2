import zlib

import numpy as np

import corpus_pipeline
from lantern.llm import bpe, common, packing


def test_sequences_can_be_read_from_the_result(spark):
    texts = ["Some words here. " * k for k in range(40)] + ["a <|endoftext|> b", "x y " * 3000, "", None]
    rows = list(enumerate(texts)) + [(3, texts[3]), (3, "another")]
    got = corpus_pipeline.packed(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    codec, bins, docs = bpe.Codec.at(common.tokenizer_path("byte_bpe_50k.json")), {}, {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append((r.piece, r.start, ids))
    for held in bins.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(held), sorted(held)[1:])) and sum(n for _, n in held) <= packing.MAX_TOKENS
    assert len(docs[3]) == 3 and {k: len(v) for k, v in docs.items() if k not in (3, 41)} == {k: 1 for k in range(44) if k not in (3, 41)}
    for d, text in enumerate(texts):
        if d != 3:
            ids = np.concatenate([x for *_, x in sorted(docs[d], key=lambda p: p[:2])])
            assert ids[-1] == packing.END_ID and codec.decode(ids[:-1]) == (text or "").encode()
