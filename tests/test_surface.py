"""The public names, and what the engine does at its edges."""

import json

import pytest
from pyspark.sql import functions as F

import lantern
from lantern import Document, KeywordField, NumericField, Schema, SearchEngine, TextField
from lantern.functions.analysis import Analyzer
from lantern.functions.scoring import BM25Scorer
from lantern.functions.stems import PorterStemmer
from lantern.operators import facets, postings
from lantern.plans import compile as compiling
from lantern.plans.engine import MOST_SEGMENTS
from lantern.sources.store import SegmentStore
from lantern.streaming.ingest import index_stream
from tests.brute import Brute


def ids(engine, q, **more):
    return sorted(r.doc_id for r in engine.matches(q, **more).collect())


def test_names():
    wanted = "SearchEngine Schema TextField KeywordField NumericField Document TermQuery BoolQuery PhraseQuery WildcardQuery MatchAllQuery Analyzer AnalyzerPipeline WhitespaceTokenizer RegexTokenizer NgramTokenizer LowercaseNormalizer UnicodeNormalizer AccentStripper PorterStemmer StopWordFilter ENGLISH_STOP_WORDS BM25Scorer TFIDFScorer"
    assert set(wanted.split()) <= set(lantern.__all__) and all(hasattr(lantern, n) for n in lantern.__all__)


def test_documents():
    d = Document(3, {"title": "x" * 60, "n": 1})
    assert d["n"] == 1 and d["none"] is None and d.get("none", 7) == 7 and "title" in d and "none" not in d
    assert d.to_dict() == {"doc_id": 3, "fields": {"title": "x" * 60, "n": 1}} and Document.from_dict(d.to_dict()) == d
    assert repr(d) == "Document(id=3, {'title': '" + "x" * 50 + "...', 'n': 1})"


def test_schema_views():
    s = Schema(a=TextField(), b=KeywordField(faceted=True), c=NumericField(), d=KeywordField(indexed=False))
    assert s.field_names() == ["a", "b", "c", "d"] and s.get_faceted_fields() == ["b"] and s.get_field("c") is s.get("c") and s.get_field("z") is None
    assert (s.get_text_fields(), s.get_keyword_fields(), s.get_numeric_fields(), s.get_searchable_fields()) == (["a"], ["b", "d"], ["c"], ["a", "b"])


def test_facet_collector(spark):
    c = facets.FacetCollector()
    for tags in (["a", "b"], ["a"], "a", ["c"], 5):
        c.add("tags", tags)
    c.add("year", 2020)
    assert c.get_facets("tags", 1) == [("a", 3)] and c.get_facets("none") == [] and c.to_dict() == {"tags": {"a": 3, "b": 1, "c": 1, "5": 1}, "year": {"2020": 1}}
    assert c.get_all_facets(2)["tags"][0] == ("a", 3) and len(c.get_all_facets(2)["tags"]) == 2
    df = spark.createDataFrame([(i, [f"v{j}" for j in range(i % 3)]) for i in range(9)], "doc_id long, tags array<string>")
    assert facets.FacetCollector.counted(facets.facet_counts(df, ["tags"]), 1).to_dict() == {"tags": {"v0": 6}}


def test_multi_field_scores(spark):
    pairs = [(1.5, 2.0), (0.25, 4.0)]
    got = spark.range(1).select(BM25Scorer.multi_field_column([*((F.lit(s), b) for s, b in pairs), (F.lit(None).cast("double"), 9.0)]).alias("s")).first().s
    assert got == BM25Scorer.score_multi_field(pairs) == 4.0


def test_columns_named_like_the_engines_own(spark):
    e = SearchEngine(schema=Schema(text=TextField(), score=NumericField()), spark=spark)
    rows = [("alpha beta", 7.0, "x", 1, 2), ("alpha", 8.0, "y", 3, 4)]
    e.index_documents(spark.createDataFrame(rows, "text string, score double, at string, part int, base int"))
    assert ids(e, "alpha") == [0, 1]
    page = e.page("alpha")
    assert {r.document_score for r in page.collect()} == {7.0, 8.0} and all(r.score < 5 for r in page.collect())
    hit = e.search("beta").hits[0]
    assert hit.doc == {"text": "alpha beta", "score": 7.0, "at": "x", "part": 1, "base": 2} and hit.score < 5


def test_analysis_runs_once_and_shuffles_nothing(spark):
    docs = spark.createDataFrame([(1, "running runs ran the run"), (2, ""), (3, None), (4, "plain")], "doc_id long, body string")
    rows = postings.analysed(docs, Schema(body=TextField()))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    got = {(r.doc_id, r.term): (r.tf, r.positions, r.dl) for r in postings.postings_of(rows).collect()}
    assert got == {(1, "run"): (3, [0, 1, 4], 4), (1, "ran"): (1, [2], 4), (4, "plain"): (1, [0], 1)}
    assert sorted((r.doc_id, r.dl) for r in postings.lengths_of(rows).collect()) == [(1, 4), (2, 0), (4, 1)]


def test_few_parts_are_spread_and_many_are_not(spark):
    few, many = spark.range(100).coalesce(1), spark.range(100).repartition(9)
    assert postings.spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert postings.spread(many) is many and postings.spread(spark.range(100)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


class CountingStemmer(PorterStemmer):
    def stem_all(self, words):
        if len(words) != len(set(words)):
            raise AssertionError("a word is stemmed twice in a batch")
        return super().stem_all(words)


def test_a_batch_stems_each_word_once(spark):
    docs = spark.createDataFrame([(k, "words wording words " * 20) for k in range(40)], "doc_id long, body string").coalesce(1)
    schema = Schema(body=TextField(analyzer=Analyzer(stemmer=CountingStemmer())))
    assert postings.build_postings(docs, schema).where("tf = 60 and size(positions) = 60").count() == 40


def test_wildcards_push_what_they_look_up(spark, tmp_path, monkeypatch):
    schema = Schema(body=TextField(), tag=KeywordField())
    with SearchEngine(str(tmp_path / "i"), schema, spark=spark) as e:
        e.add_many([{"body": "python pythons java", "tag": "Pyx"}, {"body": "pytest", "tag": "other"}, {"body": "nothing"}])
    again = SearchEngine(str(tmp_path / "i"), schema, spark=spark)
    plan = again.matches("py*")._jdf.queryExecution().toString()
    assert "StringStartsWith(term,py)" in plan and "In(term, [pytest,python])" in plan
    assert ids(again, "py*") == [0, 1] and ids(again, "tag:py*") == [0] and ids(again, "zz*") == [] and ids(again, "zz* OR nothing") == [2]
    monkeypatch.setattr(compiling, "WILDCARD_TERMS", 1)
    assert ids(again, "py*") == [0, 1]


def test_commits_append_segments(spark, tmp_path):
    schema, path, docs = Schema(body=TextField(), tag=KeywordField(), n=NumericField()), str(tmp_path / "i"), {}
    for k in range(4):
        with SearchEngine(path, schema, spark=spark) as e:
            new = {"body": f"alpha beta{k} " * (k + 1), "tag": ["t", str(k)]} if k != 2 else {"body": "alpha", "n": 5, "more": "text"}
            docs[e.add(new)] = new
            e.add({})
            docs[len(docs)] = {}
    store = SegmentStore(spark, path)
    assert len(store.list_segments()) == 4 and len(store._numbers()) == 2
    again, brute = SearchEngine(path, schema, spark=spark), Brute(schema, docs)
    for q in ("alpha", "beta1 OR beta3", "tag:t", "b*"):
        assert {r.doc_id: r.score for r in again.matches(q).collect()} == pytest.approx(brute.run(again.parse(q)))
    assert again.stats()["documents"] == 8 and again.get(4) == docs[4] and not again.stats()["dirty"]
    again.remove(0)
    again.commit()
    assert len(store.list_segments()) == 1 and ids(SearchEngine(path, schema, spark=spark), "alpha") == [2, 4, 6]


def test_many_segments_become_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("lantern.plans.engine.MOST_SEGMENTS", 2)
    assert MOST_SEGMENTS == 16
    for k in range(4):
        with SearchEngine(str(tmp_path / "i"), spark=spark) as e:
            e.add({"content": f"word w{k}"})
    assert len(SegmentStore(spark, str(tmp_path / "i")).list_segments()) == 2
    assert ids(SearchEngine(str(tmp_path / "i"), spark=spark), "word") == [0, 1, 2, 3]


def test_published_state_survives_what_fails(spark, tmp_path):
    s = SegmentStore(spark, str(tmp_path / "s"))
    s.save_segment({"t": spark.range(3)}, "a")
    with pytest.raises(ValueError):
        s.save_segment({"t": spark.range(9)}, "a")
    assert s.load_latest()[0]["t"].count() == 3
    # A writer that ended before its rename leaves a file that no reader takes for a manifest.
    (tmp_path / "s" / ".leftover").write_text("{")
    assert [x["id"] for x in s.list_segments()] == ["a"]
    # Two writers at once: the second one's number is taken.
    before = s._numbers
    s._numbers = lambda: before()[:-1] if before()[-1] > 1 else before()
    s.save_segment({"t": spark.range(1)}, "b")
    with pytest.raises(OSError):
        s.save_segment({"t": spark.range(1)}, "c")
    s._numbers = before
    assert [x["id"] for x in s.list_segments()] == ["a", "b"]
    assert json.loads((tmp_path / "s" / f"manifest-{s._numbers()[-1]}.json").read_text())["segments"][1]["id"] == "b"


def test_replayed_batches_are_known(spark, tmp_path):
    source, path, checkpoint = tmp_path / "in", str(tmp_path / "i"), str(tmp_path / "c")
    spark.createDataFrame([(1, "streamed words")], "doc_id long, content string").write.parquet(str(source))
    stream = spark.readStream.schema("doc_id long, content string").parquet(str(source))
    index_stream(stream, SearchEngine(path, spark=spark), checkpoint, "doc_id").awaitTermination()
    # The commit log of the batch is lost with the driver: it runs again.
    for f in (tmp_path / "c" / "commits").iterdir():
        f.unlink()
    index_stream(stream, SearchEngine(path, spark=spark), checkpoint, "doc_id").awaitTermination()
    e = SearchEngine(path, spark=spark)
    assert e.stats()["documents"] == 1 and ids(e, "words") == [1] and e.streams == {checkpoint: 0}
    spark.createDataFrame([(2, "more words")], "doc_id long, content string").write.mode("append").parquet(str(source))
    index_stream(stream, SearchEngine(path, spark=spark), checkpoint, "doc_id").awaitTermination()
    assert ids(SearchEngine(path, spark=spark), "words") == [1, 2]


def test_facets_of_a_search_are_bounded(spark):
    e = SearchEngine(schema=Schema(content=TextField(), tag=KeywordField(faceted=True)), spark=spark)
    e.add_many([{"content": "word", "tag": [f"t{j}" for j in range(k + 1)]} for k in range(5)])
    assert e.search("word", facets=["tag"], facet_limit=2).facets == {"tag": {"t0": 5, "t1": 4}}
    assert len(e.search("word", facets=["tag"]).facets["tag"]) == 5


def test_blocks_end_at_their_size_and_keep_all_postings(spark, monkeypatch):
    rows = [(k, " ".join(["same", f"w{k % 3}", "Same"] * (k % 4)) if k % 5 else None, f"K{k % 2}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, body string, tag string").coalesce(1)
    schema = Schema(body=TextField(analyzer=Analyzer()), tag=KeywordField())
    whole = {(r.field, r.term, r.doc_id): (r.tf, r.positions, r.dl) for r in postings.build_postings(docs, schema).collect()}
    for name, size in (("BLOCK_TOKENS", 10), ("BLOCK_DOCS", 3), ("SENT_ROWS", 2)):
        monkeypatch.setattr(postings, name, size)
    blocks = postings.analysed(docs, schema)
    got = {(r.field, r.term, r.doc_id): (r.tf, r.positions, r.dl) for r in postings.postings_of(blocks).collect()}
    wanted = {("tag", f"k{k % 2}", k): (1, [0], 1) for k in range(40)}
    for k, body, _ in rows:
        words = (body or "").lower().split()
        wanted |= {("body", w, k): (words.count(w), [i for i, x in enumerate(words) if x == w], len(words)) for w in words}
    assert got == whole == wanted and blocks.where("term = 'same'").count() > 5
    assert {tuple(r) for r in postings.dictionary_of(blocks).collect()} == {tuple(r) for r in postings.dictionary(postings.postings_of(blocks)).collect()}
    assert postings.totals_of(blocks) == {"tag": 40, "body": sum(3 * (k % 4) for k in range(40) if k % 5)}


def test_a_terms_df_comes_from_its_blocks(spark):
    e = SearchEngine(schema=Schema(body=TextField()), spark=spark)
    e.add_many([{"body": "alpha beta"}, {"body": "alpha"}])
    assert ids(e, "alpha") == [0, 1]
    plan = e.index.terms.where("term = 'alpha'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Filter") < plan.index("InMemoryRelation") and "doc_ids" not in plan[: plan.index("InMemoryRelation")]
    spark.catalog.clearCache()
    assert ids(e, "beta") == [0] and e._pending[0][1].storageLevel.useMemory
