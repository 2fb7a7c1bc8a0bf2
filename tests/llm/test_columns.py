"""Stages and queries on tables whose other columns have awkward names."""

import pytest

import corpus_pipeline
from lantern.llm import bpe, common, langid, media, neardup, packing, pii, quality, registry, repeats, topk, toxicity

NAMES = [
    "gone", "node", "sum", "key", "rep", "row", "found", "id_b", "sum_b", "task", "piece", "length", "kept", "component", "c0", "c1", "dotted.name", "a b", "qu`ote",
    "score", "rejected", "lang_pred", "label", "host", "path", "slot", "bits", "media", "ids", "id", "query_id", "dim", "vec", "a", "b", "n", "m", "of", "wanted", "repeats found", "high", "low",
]


def rows():
    long = "words of a passage that comes again and again in other texts too, " * 5
    texts = [long + "one", long + "two", long + "one", "write to me@mail.org", "", None, "short words", "short words"]
    return [(k if k != 5 else None, t, "en" if k % 2 else None, "src", len(t or "")) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def wide(spark):
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows(), shape)
    return docs.select("*", *(docs["n_chars"].cast("string").alias(n) for n in NAMES))


def test_stages_keep_every_column(spark, wide):
    docs = wide
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, ""), "t")
        if name == "packing":
            assert docs.count() == 3
        else:
            assert docs.columns == wide.columns and [t for _, t in docs.dtypes] == [t for _, t in wide.dtypes], name
            assert docs.where("gone <> `dotted.name` or `a b` <> kept").count() == 0
            kept = {r.doc_id for r in docs.collect()}
            assert name == "near_duplicates" or not kept or kept <= {r[0] for r in rows()}


OPERATORS = {
    "pii": pii.personal_data, "near duplicates": neardup.near_duplicates, "bpe": bpe.encode, "media": lambda d: media.digests(media.pcm(media.stored(d))), "pieces": packing.pieces, "repeats": repeats.remove_repeats,
    "language": lambda d: langid.identified(d, langid.fit(langid.learnable(d))).select("doc_id", "lang_pred"),
    "toxicity": lambda d: toxicity.scored(d, toxicity.fit(d, d.select("doc_id", (d.n_chars > 20).cast("int").alias("toxic")))),
    "quality": lambda d: quality.scored(quality.evidence(d, quality.fit(d, d.select("doc_id", (d.n_chars > 20).cast("int").alias("quality"))), d.source, d.lang)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_ignore_other_columns(wide, name):
    plain = wide.select("doc_id", "text", "lang", "source", "n_chars")
    a, b = (sorted(map(repr, OPERATORS[name](d).collect())) for d in (wide, plain))
    assert a == b and len(a) == 8


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_take_empty_tables(wide, name):
    assert OPERATORS[name](wide.limit(0)).count() == 0


def test_search_ignores_other_columns(spark):
    vectors = spark.createDataFrame([(k, [float(k), 1.0], "x") for k in range(60)], "vec_id long, embedding array<float>, other string")
    odd = vectors.select("*", *(vectors["other"].alias(n) for n in NAMES))
    found = [sorted(map(tuple, topk.top_k(topk.quantised(v.where("vec_id < 3")), topk.quantised(v)).collect())) for v in (vectors, odd)]
    assert found[0] == found[1] and len(found[0]) == 15


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n != "op1_topk"])
def test_queries_on_a_small_folder(spark, tmp_path, name):
    docs = spark.createDataFrame([(k, t, lang, s, n) for k, (_, t, lang, s, n) in enumerate(rows())], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, k % 2, k % 2) for k in range(8)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = registry.QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted({r.doc_id for r in got}) == list(range(8)) and len(got) == 8
