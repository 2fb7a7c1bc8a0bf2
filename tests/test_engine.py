import json
import random

import pytest
from pyspark.sql import functions as F

from lantern.functions.analysis import Analyzer
from lantern.functions.scoring import PythonScorer
from lantern.operators import facets, postings
from lantern.plans.ast import BoolQuery, MatchAllQuery, PhraseQuery, Query, RangeQuery, TermQuery, WildcardQuery
from lantern.plans.compile import Compiler
from lantern.plans.engine import SearchEngine
from lantern.sources.readers import read_documents
from lantern.sources.schema import FieldType, KeywordField, NumericField, Schema, TextField
from lantern.sources.store import SegmentStore
from lantern.streaming.ingest import index_stream
from tests.brute import Brute

DOCS = [
    {"title": "Python Basics", "body": "Python is a language. Learning python is running fast", "tags": ["python", " Beginner "], "author": "Ada Stone", "year": 2020},
    {"title": "Java Guide", "body": "Java is verbose; the agreed state of art", "tags": ["java", "java"], "author": "bob", "year": 2024.5},
    {"title": "Machine learning", "body": "machine learning with python and big data. data machine", "tags": "ml", "author": None, "year": "2022"},
    {"title": "", "body": "working works work", "extra": True, "year": "nan"},
    {"body": "café résumé machine-learning don't", "tags": [], "author": "ada", "year": "x"},
]


def schema():
    return Schema(title=TextField(boost=2.0), body=TextField(), tags=KeywordField(faceted=True), author=KeywordField(), year=NumericField())


@pytest.fixture(scope="module")
def engine(spark):
    e = SearchEngine(schema=schema(), spark=spark)
    assert e.add_many(DOCS) == [0, 1, 2, 3, 4]
    return e


def ids(engine, q, **more):
    return sorted(r.doc_id for r in engine.matches(q, **more).collect())


WANTED = {
    "python": [0, 2], "python AND machine": [2], "python machine": [2], "java OR machine": [1, 2], "NOT python": [], "python AND NOT machine": [], "python OR NOT java": [0, 2], "the python": [], "title:python": [0], "nofield:python": [],
    '"machine learning"': [2], '"state of art"': [], '"the state"': [1], "work": [3], "machine": [2], "machine-learning": [4], "run*": [0], "running*": [], "pyth*": [0, 2], "agre*": [], "title:*": [0, 1, 2], "author:ada": [4], "author:ad*": [0, 4],
    "tags:beginner": [0], "tags:java": [1], "*": [0, 1, 2, 3, 4], "café": [4], "cafe": [], "a:b:c": [], 'tags:"ml"': [2], 'title:""': [], "foo.bar": [], "python.x": [0, 2],
}


@pytest.mark.parametrize("query", WANTED)
def test_which_documents_match(engine, query):
    assert ids(engine, query) == WANTED[query]


def random_tree(r: random.Random, depth: int) -> Query:
    word = lambda: r.choice("alpha beta gamma delta running work the zz a1 ml java Ada".split())
    field = lambda: r.choice([None, None, "title", "body", "tags", "author", "nope"])
    kind = r.random()
    if depth and kind < 0.5:
        some = lambda low: [random_tree(r, depth - 1) for _ in range(r.randint(low, 2))]
        return BoolQuery(some(0), some(0), some(0) if r.random() < 0.4 else [], boost=r.choice([1.0, 1.0, 2.5]))
    if kind < 0.7:
        return TermQuery(word(), field(), r.choice([1.0, 3.0]))
    if kind < 0.82:
        return PhraseQuery([word() for _ in range(r.randint(0, 3))], field(), slop=r.randint(0, 3))
    if kind < 0.9:
        return WildcardQuery(word()[: r.randint(0, 2)] + "*", field())
    if kind < 0.96:
        return RangeQuery("year", gte=r.choice([None, 3]), lt=r.choice([None, 8]), boost=2.0)
    return MatchAllQuery(0.5)


def test_random_trees_equal_brute_force(spark):
    r = random.Random(31)
    words = "alpha beta gamma delta running works the zz a1 agreed".split()
    docs = {}
    for i in range(25):
        d = {"title": " ".join(r.choice(words) for _ in range(r.randint(0, 3))), "body": " ".join(r.choice(words) for _ in range(r.randint(0, 9))), "tags": [r.choice(["ml", "java", "Ada", " ", "alpha"]) for _ in range(r.randint(0, 3))], "author": r.choice([None, "java", "beta"]), "year": r.choice([None, 1, 5, 9.5])}
        docs[i] = {k: v for k, v in d.items() if v is not None and r.random() < 0.9}
    e = SearchEngine(schema=schema(), spark=spark)
    e.add_many(list(docs.values()))
    brute = Brute(schema(), docs)
    for k in range(25):
        q = random_tree(r, 2)
        got, want = {x.doc_id: x.score for x in e.matches(q).collect()}, brute.run(q)
        assert got.keys() == want.keys(), q
        assert all(got[i] == pytest.approx(want[i]) for i in got), q


def test_pages_totals_facets_and_snippets(engine):
    r = engine.search("python OR machine OR java", limit=2, facets=["tags", "year", "nope", "extra"])
    assert r.total == 3 and len(r) == 2 and [h.score for h in r] == sorted((h.score for h in r), reverse=True)
    assert r.facets["tags"] == {"java": 2, " Beginner ": 1, "ml": 1, "python": 1} and "nope" not in r.facets
    second = engine.search("python OR machine OR java", limit=2, offset=2)
    assert len({h.doc_id for h in [*r, *second]}) == 3
    assert engine.search("*", limit=0, facets=["tags"]).total == 5 and len(engine.search("*", limit=0)) == 0
    assert engine.search("python", filters={"tags": ["ml"]}).total == 1 and engine.search("*", filters={"tags": []}).total == 0 and engine.search("*", filters={"nope": ["x"]}).total == 0
    hit = engine.search("title:python").hits[0]
    assert hit.highlight("title") == "<b>Python</b> Basics" and hit.highlight("missing") == "" and hit.doc["year"] == 2020
    page = engine.with_highlight(engine.page("python"), "python", "body").select("snippet").collect()
    assert len(page) == 2 and all("<b>" in x.snippet for x in page)
    with pytest.raises(TypeError):
        engine.search("*", filters={"tags": "ml"})
    with pytest.raises(ValueError):
        engine.search("*", limit=-1)


def test_ranges_read_numbers_as_python_does(spark):
    texts = ["1_000", "1d", " 7 ", "1e3", "inf", "-Infinity", "nan", "0x1", "", ".5", "5.", "1__0", "+3", None, "٣"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, v string")
    from lantern.plans.compile import number_of

    for r in df.select("v", number_of(F.col("v"), df.schema["v"].dataType).alias("n")).collect():
        try:
            want = float(r.v)
        except (TypeError, ValueError):
            want = None
        if r.v != "٣":
            assert r.n == want or want != want and r.n != r.n, r.v


def test_ranges_and_negation(engine, spark):
    assert ids(engine, RangeQuery("year", gte=2021)) == [1, 2, 3] and ids(engine, RangeQuery("year", gt=2020, lte=2022)) == [2, 3] and ids(engine, RangeQuery("nope", gte=1)) == []
    with pytest.raises(ValueError):
        engine.matches(RangeQuery("year", gte="abc"))
    run = lambda q: sorted(r.doc_id for r in Compiler(engine.index, engine.scorer, "exclude").matched(engine.parse(q)).collect())
    assert run("python NOT machine") == [0] and run("NOT python") == [1, 3, 4]
    assert ids(engine, BoolQuery(must=[TermQuery("python")], must_not=[TermQuery("machine")])) == [0]


def test_ties_are_broken_by_id_and_custom_scorers_work(spark):
    e = SearchEngine(schema=Schema(content=TextField()), scorer=PythonScorer(lambda tf, df, dl, a, n: 7.0), spark=spark)
    e.add_many([{"content": "equal words"}] * 3)
    assert [(h.doc_id, h.score) for h in e.search("equal", limit=2)] == [(0, 7.0), (1, 7.0)]
    assert SearchEngine(spark=spark, scorer="BM25").scorer.__class__.__name__ == "TFIDFScorer"


def test_removal_and_stats(spark):
    e = SearchEngine(schema=schema(), spark=spark)
    e.add_many(DOCS)
    before = e.stats()
    assert before["documents"] == 5 and before["dirty"] and before["avg_field_lengths"]["title"] == 1.2
    assert e.remove(0) and not e.remove(0) and not e.remove(99)
    assert e.get(0) is None and e.get(1) == DOCS[1] and ids(e, "python") == [2] and e.stats()["documents"] == 4
    assert e.add({"title": "new"}) == 5
    assert postings.by_doc(e.index.postings, 5).count() == 1


def test_persistence(spark, tmp_path):
    path = str(tmp_path / "index")
    with SearchEngine(path, schema(), spark=spark) as e:
        e.add_many(DOCS)
        want = e.search("python OR machine").hits
    again = SearchEngine(path, schema(), spark=spark)
    got = again.search("python OR machine").hits
    assert [(h.doc_id, round(h.score, 9), h.doc) for h in got] == [(h.doc_id, round(h.score, 9), h.doc) for h in want]
    stats = again.stats()
    assert not stats["dirty"] and stats["path"] == path and stats["index_size"].split()[1] in ("KB", "B", "MB")
    assert again.add({"title": "sixth"}) == 5
    again.remove(0)
    again.commit()
    third = SearchEngine(path, schema(), spark=spark)
    assert ids(third, "sixth") == [5] and ids(third, "python") == [2] and third.add({}) == 6
    assert len(SegmentStore(spark, path).list_segments()) == 1
    with pytest.raises(ValueError):
        SearchEngine(path, Schema(content=TextField()), spark=spark)


def test_appends_and_removals_equal_a_fresh_build(spark, tmp_path):
    e = SearchEngine(str(tmp_path / "i"), schema(), spark=spark)
    e.add_many(DOCS[:2])
    assert ids(e, "python") == [0]
    e.add_many(DOCS[2:])
    assert ids(e, "python") == [0, 2]
    e.commit()
    e.add_many(DOCS[:3])
    e.remove(1)
    e.add({"body": "python again", "tags": ["late"]})
    e.remove(6)
    fresh = Brute(schema(), {i: d for i, d in enumerate([*DOCS, *DOCS[:3], {"body": "python again", "tags": ["late"]}]) if i not in (1, 6)})
    for again in (e, None):
        if again is None:
            e.commit()
            again = SearchEngine(str(tmp_path / "i"), schema(), spark=spark)
        for q in ("python OR java", "machine learning", "tags:late", "p*"):
            want = fresh.run(again.parse(q))
            assert {r.doc_id: r.score for r in again.matches(q).collect()} == pytest.approx(want)


def test_json_export(spark, tmp_path):
    e = SearchEngine(schema=schema(), spark=spark)
    e.add_many(DOCS)
    e.export_json(str(tmp_path / "j"))
    again = SearchEngine(schema=schema(), spark=spark)
    again.import_json(str(tmp_path / "j"))
    assert ids(again, "python") == [0, 2] and again.get(1) == DOCS[1] and again.add({"title": "sixth"}) == 5 and ids(again, "sixth") == [5]
    with pytest.raises(ValueError):
        SearchEngine(spark=spark).import_json(str(tmp_path / "j"))


def test_segments(spark, tmp_path):
    s = SegmentStore(spark, str(tmp_path / "s"))
    assert not s.exists() and s.list_segments() == [] and s.load_latest() is None and s.load_segment("x") is None and s.index_size_bytes() == 0
    df = spark.range(3)
    s.save_segment({"t": df}, "a", {"k": 1})
    s.save_segment({"t": spark.range(5)}, "b")
    assert [x["id"] for x in s.list_segments()] == ["a", "b"] and s.load_latest()[0]["t"].count() == 5 and s.load_segment("a")["t"].count() == 3
    assert s.delete_segment("a") and not s.delete_segment("a") and s.exists() and s.index_size_bytes() > 0
    s.compact({"t": df})
    assert len(s.list_segments()) == 1 and s.load_latest()[0]["t"].count() == 3 and "created" in s.manifest()


def test_stored_lookups_are_pruned(spark, tmp_path):
    with SearchEngine(str(tmp_path / "i"), schema(), spark=spark) as e:
        e.add_many(DOCS)
    again = SearchEngine(str(tmp_path / "i"), schema(), spark=spark)
    plan = again.matches("title:python")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(field" in plan and "EqualTo(term,python)" in plan.replace("In(term, [python])", "EqualTo(term,python)")


def test_dataframes_get_dense_ids(spark):
    e = SearchEngine(schema=Schema(text=TextField(analyzer=Analyzer())), spark=spark)
    e.index_documents(spark.range(10).select(F.concat(F.lit("w"), "id").alias("text")).repartition(3))
    e.index_documents(spark.createDataFrame([("w3 more",)], "text string"))
    assert sorted(r.doc_id for r in e.documents.collect()) == list(range(11)) and len(ids(e, "w3")) == 2 and e.get(10) == {"text": "w3 more"}


def test_streams_are_appended(spark, tmp_path):
    spark.createDataFrame([(1, "streamed words"), (2, "more words")], "doc_id long, content string").write.parquet(str(tmp_path / "in"))
    e = SearchEngine(str(tmp_path / "i"), spark=spark)
    stream = spark.readStream.schema("doc_id long, content string").parquet(str(tmp_path / "in"))
    index_stream(stream, e, str(tmp_path / "c"), "doc_id").awaitTermination()
    assert ids(SearchEngine(str(tmp_path / "i"), spark=spark), "words") == [1, 2]


def test_facet_values_read_as_python_prints_them(spark):
    values = [1.0, 2.5, 1e7, 12345678.25, 1e16, 1e-5, 1e22, 0.00025, -0.5, float("nan"), float("inf")]
    df = spark.createDataFrame([(v, True, 3) for v in values], "x double, b boolean, n int")
    got = {r.value for r in facets.facet_counts(df, ["x"]).collect()}
    assert got == {str(v) for v in values}
    assert [(r.value, r["count"]) for r in facets.facet_counts(df, ["b"]).collect()] == [("True", len(values))]
    f = facets.FacetFilter().add_filter("b", ["True"]).add_filter("n", [3])
    assert df.where(f.column(df)).count() == len(values) and f.matches({"b": True, "n": 3}) and not f.matches({"b": None})
    assert facets.FacetFilter().matches({}) and not facets.FacetFilter().active


def test_top_facets_and_posting_sets(spark):
    df = spark.createDataFrame([(i, [f"v{j}" for j in range(i % 5 + 1)]) for i in range(20)], "doc_id long, tags array<string>")
    assert [r.value for r in facets.top_facets(facets.facet_counts(df, ["tags"]), 2).orderBy("value").collect()] == ["v0", "v1"]
    rows = postings.build_postings(df, Schema(tags=KeywordField()))
    a, b = postings.lookup(rows, "tags", "v1"), postings.lookup(rows, "tags", "v3")
    assert (postings.intersect(a, b).count(), postings.union(a, b).count(), postings.difference(a, b).count()) == (8, 16, 8)
    assert postings.merged(a, a).where("tf = 2 and size(positions) = 2").count() == 16


def test_schema_and_readers(spark, tmp_path):
    with pytest.raises(TypeError):
        Schema(x="text")
    s = Schema(a=TextField(), b=KeywordField(indexed=False), c=NumericField(), d=FieldType())
    assert s.get_searchable_fields() == ["a"] and s.validate_document({"a": 1, "z": 2}) == ["unknown field: z"] and s.get("c").get_analyzer() is None
    assert json.loads(json.dumps(s.to_json()))["a"]["kind"] == "text"
    df = spark.createDataFrame([(1, "x")], "i int, t string")
    for kind in ("parquet", "json", "csv"):
        df.write.format(kind).option("header", True).save(str(tmp_path / kind))
        assert read_documents(spark, str(tmp_path / kind), kind).count() == 1
    with pytest.raises(ValueError):
        read_documents(spark, "x", "xml")


def test_empty_engine(spark):
    e = SearchEngine(spark=spark)
    assert e.search("x").total == 0 and e.search("*").total == 0 and e.stats()["documents"] == 0 and e.get(0) is None and not e.remove(0)
