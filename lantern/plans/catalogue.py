"""Registered search-engine queries and their SQL counterparts.

Scores are rounded to six digits on both sides, since engines add up in other
orders.  Queries with SQL use analysis without stemming, which SQL lacks;
stemmed ones are tested against goldens and a brute-force evaluator.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.functions.analysis import Analyzer, AnalyzerPipeline, exact_analyzer, keyword_analyzer, simple_analyzer, standard_analyzer
from lantern.functions.scoring import BM25Scorer, PythonScorer, TFIDFScorer
from lantern.functions.snippets import Highlighter
from lantern.functions.stems import stem_arrays
from lantern.functions.text import ENGLISH_STOP_WORDS, AccentStripper, LowercaseNormalizer, NgramTokenizer, PunctuationStripper, RegexTokenizer, SentenceTokenizer, StopWordFilter, UnicodeNormalizer, WhitespaceTokenizer
from lantern.operators import facets, postings
from lantern.plans.ast import BoolQuery, MatchAllQuery, PhraseQuery, RangeQuery, TermQuery, WildcardQuery
from lantern.plans.compile import Compiler
from lantern.plans.engine import SearchEngine
from lantern.plans.stem_sql import stemmed
from lantern.sources.schema import KeywordField, NumericField, Schema, TextField
from lantern.sources.store import SegmentStore
from lantern.util import format_size_column, truncate_column

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------- indexes

_engines: dict[tuple[str, str, str], SearchEngine] = {}


def _engine(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], tuple[Schema, DataFrame, str]]) -> SearchEngine:
    """One index for each corpus in a session, as a user would keep it."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _engines:
        schema, df, id_col = make()
        engine = SearchEngine(schema=schema, spark=spark)
        engine.index_documents(df, id_col)
        _engines[key] = engine
    return _engines[key]


def documents_engine(spark: SparkSession, sf_dir: str) -> SearchEngine:
    """text without stemming, lang and source as keywords, n_chars as a number."""
    schema = Schema(text=TextField(analyzer=Analyzer()), lang=KeywordField(indexed=False), source=KeywordField(indexed=False, faceted=True), n_chars=NumericField())
    return _engine(spark, sf_dir, "documents", lambda: (schema, table(spark, sf_dir, "documents"), "doc_id"))


def stemmed_engine(spark: SparkSession, sf_dir: str) -> SearchEngine:
    schema = Schema(text=TextField(), source=KeywordField(indexed=False))
    return _engine(spark, sf_dir, "stemmed", lambda: (schema, table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id"))


def parts_engine(spark: SparkSession, sf_dir: str) -> SearchEngine:
    """p_name (boost 2) and p_type as text, p_brand as a keyword."""
    schema = Schema(p_name=TextField(analyzer=simple_analyzer(), boost=2.0), p_type=TextField(analyzer=simple_analyzer()), p_brand=KeywordField(faceted=True), p_retailprice=NumericField())
    return _engine(spark, sf_dir, "part", lambda: (schema, table(spark, sf_dir, "part"), "p_partkey"))


def _out(matched: DataFrame) -> DataFrame:
    return matched.select("doc_id", F.round("score", 6).alias("score"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_engine(spark, sf_dir).page("the AND and OR of", limit=10).select("doc_id", "score", "lang", "source")


# ---------------------------------------------------- SQL building blocks

W = r"[\p{L}\p{N}_]+(?:[-''][\p{L}\p{N}_]+)*"
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
DOCS = f"""with tl as (select doc_id, list_transform(regexp_extract_all(text, '{W}'), lambda x: lower(x)) l from documents where text is not null),
tk as (select doc_id, unnest(l) term, generate_subscripts(l, 1) - 1 pos from tl),
dl as (select doc_id, len(l) dl from tl),
st as (select sum(dl)::double / (select count(*) from documents) avgdl, (select count(*) from documents) n from dl),
po as (select term, doc_id, count(*) tf from tk group by all)
"""


def bm25(term: str, boost: float = 1.0, k1: float = 1.2, b: float = 0.75) -> str:
    return f"""(select doc_id, {boost} * ln((n - df + 0.5) / (df + 0.5) + 1.0) * (tf * ({k1} + 1.0)) / (tf + {k1} * (1.0 - {b} + {b} * dl / greatest(avgdl, 1.0))) s
from po join dl using (doc_id), st, (select count(*) df from po where term = '{term}') where term = '{term}')"""


def _tokens(column: str, name: str, key: str, of: str) -> str:
    return f"with l as (select {key}, {of} l from {name} where {column} is not null) select {key}, (generate_subscripts(l, 1) - 1)::int as position, unnest(l) as term from l"


# ------------------------------------------------------------ tokenizers


def _exploded(df: DataFrame, key: str, tokens) -> DataFrame:
    return df.select(key, F.explode(tokens).alias("t")).select(key, F.col("t.position").alias("position"), F.col("t.text").alias("term"))


@registered(_tokens("text", "documents", "doc_id", f"regexp_extract_all(text, '{W}')"))
def tokenize_regex(spark, sf_dir):
    return _exploded(table(spark, sf_dir, "documents"), "doc_id", RegexTokenizer().column(F.col("text")))


@registered(_tokens("text", "documents", "doc_id", r"regexp_extract_all(text, '[^\s\x0b\x1c-\x1f\x{85}\p{Z}]+')"))
def tokenize_whitespace(spark, sf_dir):
    return _exploded(table(spark, sf_dir, "documents"), "doc_id", WhitespaceTokenizer().column(F.col("text")))


@registered(_tokens("p_name", "part", "p_partkey", r"""list_filter(flatten(list_transform([2, 3], lambda n: list_transform(range(1, greatest(len(trim(p_name)) - n + 2, 1)::bigint), lambda a: substr(trim(p_name), a::int, n)))), lambda g: trim(g) <> '')"""))
def tokenize_ngram(spark, sf_dir):
    return _exploded(table(spark, sf_dir, "part"), "p_partkey", NgramTokenizer(2, 3).column(F.col("p_name")))


@registered(r"""with s as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)),
lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') l from documents where text is not null)
select doc_id, (generate_subscripts(l, 1) - 1)::int as place, unnest(l) as sentence from s""")
def tokenize_sentence(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(SentenceTokenizer().column(F.col("text"))).alias("place", "sentence"))
    return found.select("doc_id", "place", "sentence")


@registered(rf"""with t as (select doc_id, regexp_extract_all(text, '{W}') l, string_split_regex(text, '{W}') g from documents where text is not null),
u as (select doc_id, unnest(l) tok, unnest(g[1:len(l)]) gap, generate_subscripts(l, 1) k from t),
s as (select doc_id, tok, k, sum(length(gap)) over w + coalesce(sum(length(tok)) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0) a from u window w as (partition by doc_id order by k))
select doc_id, tok as text, (k - 1)::int as position, a::int as start_char, (a + length(tok))::int as end_char from s""")
def token_offsets(spark, sf_dir):
    return RegexTokenizer().offsets_table(table(spark, sf_dir, "documents"), "doc_id", "text")


@registered(DOCS + "select doc_id, pos::int as position, term from tk where term not in ('the', 'and', 'of', 'der', 'la')")
def stop_filter_positions(spark, sf_dir):
    analyzer = Analyzer(RegexTokenizer(), [LowercaseNormalizer()], StopWordFilter({"the", "and", "of", "der", "la"}))
    return _exploded(table(spark, sf_dir, "documents"), "doc_id", analyzer.column(F.col("text")))


@registered(r"""with l as (select doc_id, list_transform(regexp_extract_all(text, '[^\s\x0b\x1c-\x1f\x{85}\p{Z}]+'), lambda x: lower(x)) l from documents),
t as (select doc_id, (generate_subscripts(l, 1) - 1)::int as position, trim(unnest(l), '.,;:!?"''()[]{}…—–-') as term from l) select * from t where term <> ''""")
def punctuation_strip(spark, sf_dir):
    analyzer = Analyzer(WhitespaceTokenizer(), [LowercaseNormalizer(), PunctuationStripper()])
    return _exploded(table(spark, sf_dir, "documents"), "doc_id", analyzer.column(F.col("text")))


@registered(DOCS + "select term, strip_accents(term) as folded, count(*) as n from tk group by all")
def accent_fold(spark, sf_dir):
    tokens = _exploded(table(spark, sf_dir, "documents"), "doc_id", Analyzer().column(F.col("text")))
    words = tokens.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    fold = AccentStripper().column(F.array(F.struct(F.col("term").alias("text"), F.lit(0).alias("position"))))
    return words.select("term", F.get(fold, F.lit(0))["text"].alias("folded"), "n")


@registered(DOCS + "select doc_id, pos::int as position, nfc_normalize(term) as term from tk")
def unicode_normalize(spark, sf_dir):
    analyzer = Analyzer(RegexTokenizer(), [LowercaseNormalizer(), UnicodeNormalizer("NFC")])
    return _exploded(table(spark, sf_dir, "documents"), "doc_id", analyzer.column(F.col("text")))


@registered(DOCS + f"select term, stem from ({stemmed('select distinct term from tk')})")
def porter_stem_vocab(spark, sf_dir):
    words = documents_engine(spark, sf_dir).index.terms.where("field = 'text'").select("term")
    return words.select("term", F.get(stem_arrays(F.array("term")), F.lit(0)).alias("stem"))


# ----------------------------------------------------------------- index


@registered(DOCS + "select 'text' as field, term, doc_id, count(*) as tf, string_agg(pos::varchar, ',' order by pos) as positions, any_value(len(l))::int as dl from tk join tl using (doc_id) group by term, doc_id")
def postings_build(spark, sf_dir):
    rows = documents_engine(spark, sf_dir).index.postings.where("field = 'text'")
    return rows.select("field", "term", "doc_id", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"), "dl")


@registered("""select field, term, doc_id, 1::bigint as tf, 1 as dl from (
select 'lang' as field, lower(trim(lang)) as term, doc_id from documents union all select 'source', lower(trim(source)), doc_id from documents) where term <> ''""")
def keyword_postings(spark, sf_dir):
    return documents_engine(spark, sf_dir).index.postings.where("field in ('lang', 'source')").select("field", "term", "doc_id", "tf", "dl")


@registered("""with v as (select event_id as doc_id, string_split(event_type || '|' || upper(event_type) || '| ', '|') l from events)
select lower(trim(w)) as term, doc_id, count(*) as tf, any_value(n)::int as dl from (select doc_id, unnest(l) w, len(l) n from v) where trim(w) <> '' group by 1, 2""")
def keyword_lists(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.array("event_type", F.upper("event_type"), F.lit(" ")).alias("tags"))
    return postings.build_postings(events, Schema(tags=KeywordField())).select("term", "doc_id", "tf", "dl")


@registered(DOCS + "select 'text' as field, term, count(distinct doc_id) as df, count(*) as cf from tk group by term")
def term_dictionary(spark, sf_dir):
    return documents_engine(spark, sf_dir).index.terms.where("field = 'text'").select("field", "term", "df", "cf")


@registered(DOCS + "select 'text' as field, doc_id, dl::int as dl from dl union all select 'lang', doc_id, 1 from documents where lang is not null union all select 'source', doc_id, 1 from documents where source is not null")
def field_lengths(spark, sf_dir):
    engine = documents_engine(spark, sf_dir)
    return postings.field_lengths(engine.documents, engine.schema)


@registered(DOCS + """select n as documents, (select count(*) from (select distinct term from tk)) + (select count(distinct lang) + count(distinct source) from documents) + 1 as unique_terms, round(avgdl, 1) as avg_text_length from st""")
def index_stats(spark, sf_dir):
    s = documents_engine(spark, sf_dir).stats()
    return spark.createDataFrame([(s["documents"], s["unique_terms"], s["avg_field_lengths"]["text"])], "documents long, unique_terms long, avg_text_length double")


@registered(DOCS + "select * from po where term = 'that' order by doc_id")
def posting_lookup(spark, sf_dir):
    return postings.lookup(documents_engine(spark, sf_dir).index.postings, "text", "that").select("term", "doc_id", "tf")


def _lists(spark, sf_dir, a, b):
    rows = documents_engine(spark, sf_dir).index.postings
    return postings.lookup(rows, "text", a), postings.lookup(rows, "text", b)


@registered(DOCS + "select doc_id from po where term = 'with' intersect select doc_id from po where term = 'that'")
def posting_intersect(spark, sf_dir):
    return postings.intersect(*_lists(spark, sf_dir, "with", "that"))


@registered(DOCS + "select doc_id from po where term = 'with' union select doc_id from po where term = 'der'")
def posting_union(spark, sf_dir):
    return postings.union(*_lists(spark, sf_dir, "with", "der"))


@registered(DOCS + "select doc_id from po where term = 'with' except select doc_id from po where term = 'that'")
def posting_difference(spark, sf_dir):
    return postings.difference(*_lists(spark, sf_dir, "with", "that"))


# --------------------------------------------------------------- scoring


@registered(DOCS + f"select doc_id, round(s, 6) as score from {bm25('the')}")
def term_bm25(spark, sf_dir):
    return _out(documents_engine(spark, sf_dir).matches("the"))


@registered(DOCS + f"select doc_id, round(s, 6) as score from {bm25('the', k1=2.0, b=0.3)}")
def bm25_custom_k1_b(spark, sf_dir):
    return _out(Compiler(documents_engine(spark, sf_dir).index, BM25Scorer(2.0, 0.3)).matched(TermQuery("the")))


@registered(DOCS + "select doc_id, round((1 + ln(tf)) * ln(n::double / df), 6) as score from po, st, (select count(*) df from po where term = 'that') where term = 'that'")
def term_tfidf(spark, sf_dir):
    return _out(Compiler(documents_engine(spark, sf_dir).index, TFIDFScorer()).matched(TermQuery("that")))


PARTS = r"""with f as (select p_partkey doc_id, 'p_name' field, 2.0 boost, list_transform(regexp_extract_all(p_name, '\S+'), lambda x: lower(x)) l from part
union all select p_partkey, 'p_type', 1.0, list_transform(regexp_extract_all(p_type, '\S+'), lambda x: lower(x)) from part
union all select p_partkey, 'p_brand', 1.0, [lower(trim(p_brand))] from part),
tk as (select doc_id, field, boost, len(l) dl, unnest(l) term from f),
av as (select field, sum(len(l))::double / (select count(*) from part) avgdl from f group by field),
po as (select field, term, doc_id, boost, dl, count(*) tf from tk group by all),
df as (select field, term, count(*) df from po group by all),
sc as (select doc_id, field, term, boost * ln((n - df + 0.5) / (df + 0.5) + 1.0) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / greatest(avgdl, 1.0))) s
from po join df using (field, term) join av using (field), (select count(*) n from part))
"""


@registered(PARTS + "select doc_id, round(sum(s), 6) as score from sc where term in ('widget') group by doc_id")
def term_multi_field_boost(spark, sf_dir):
    return _out(parts_engine(spark, sf_dir).matches(TermQuery("widget")))


@registered(PARTS + "select doc_id, round(3.0 * sum(s), 6) as score from sc where field = 'p_brand' and term = 'brand#12' group by doc_id")
def keyword_term_boost(spark, sf_dir):
    return _out(parts_engine(spark, sf_dir).matches("p_brand:Brand#12^3"))


@registered(PARTS + "select doc_id, round(max(s), 6) as score from sc where starts_with(term, 's') group by doc_id")
def wildcard_prefix(spark, sf_dir):
    return _out(parts_engine(spark, sf_dir).matches("s*"))


@registered(PARTS + "select doc_id, round(max(s), 6) as score from sc where field = 'p_type' group by doc_id")
def field_exists(spark, sf_dir):
    return _out(parts_engine(spark, sf_dir).matches("p_type:*"))


# --------------------------------------------------------------- boolean


def _join(kind: str, a: str, b: str, score: str) -> str:
    return DOCS + f"select doc_id, round({score}, 6) as score from {bm25(a)} a {kind} join {bm25(b)} b using (doc_id)"


@registered(_join("inner", "the", "that", "a.s + b.s"))
def bool_must(spark, sf_dir):
    return _out(documents_engine(spark, sf_dir).matches("the AND that"))


@registered(_join("full", "that", "der", "greatest(a.s, b.s)"))
def bool_should_dismax(spark, sf_dir):
    return _out(documents_engine(spark, sf_dir).matches("that OR der"))


@registered(DOCS + f"select doc_id, round(s, 6) as score from {bm25('the')} where doc_id not in (select doc_id from po where term = 'that')")
def bool_must_not(spark, sf_dir):
    return _out(documents_engine(spark, sf_dir).matches(BoolQuery(must=[TermQuery("the")], must_not=[TermQuery("that")])))


@registered(_join("left", "the", "that", "a.s + coalesce(b.s, 0)"))
def bool_must_should(spark, sf_dir):
    return _out(documents_engine(spark, sf_dir).matches(BoolQuery(must=[TermQuery("the")], should=[TermQuery("that")])))


@registered(DOCS + f"select doc_id, round(1.5 * (x.s + c.s), 6) as score from (select doc_id, greatest(a.s, b.s) s from {bm25('that', 2.0)} a full join {bm25('with')} b using (doc_id)) x join {bm25('the')} c using (doc_id)")
def bool_nested_boost(spark, sf_dir):
    inner = BoolQuery(should=[TermQuery("that", boost=2.0), TermQuery("with")])
    return _out(documents_engine(spark, sf_dir).matches(BoolQuery(must=[inner, TermQuery("the")], boost=1.5)))


@registered("select doc_id, 0.0::double as score from documents where false")
def parsed_not_is_empty(spark, sf_dir):
    return _out(documents_engine(spark, sf_dir).matches("the AND NOT that"))


@registered(DOCS + f"select doc_id, round(s, 6) as score from {bm25('the')} where doc_id not in (select doc_id from po where term = 'that')")
def parsed_not_excludes_on_request(spark, sf_dir):
    engine = documents_engine(spark, sf_dir)
    return _out(Compiler(engine.index, engine.scorer, "exclude").matched(engine.parse("the AND NOT that")))


# --------------------------------------------------------------- phrases

PHRASE = """, hit as (select distinct a.doc_id from tk a join tk b on a.doc_id = b.doc_id and a.term = 'of' and b.term = 'the' and abs(b.pos - (a.pos + 1)) <= {slop})
select doc_id, round(2.0 * ln((n - df + 0.5) / (df + 0.5) + 1.0) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / greatest(avgdl, 1.0))), 6) as score
from hit join dl using (doc_id), st, (select count(*) df from po where term = 'of')"""


@registered(DOCS + PHRASE.format(slop=0))
def phrase_exact(spark, sf_dir):
    return _out(documents_engine(spark, sf_dir).matches('"of the"'))


@registered(DOCS + PHRASE.format(slop=3))
def phrase_slop(spark, sf_dir):
    return _out(documents_engine(spark, sf_dir).matches(PhraseQuery(["of", "the"], slop=3)))


@registered(DOCS + """, x as (select a.doc_id, a.pos p0, min(b.pos) p1 from tk a join tk b on a.doc_id = b.doc_id and a.term = 'of' and b.term = 'the' and abs(b.pos - (a.pos + 1)) <= 2 group by all),
y as (select x.doc_id, p0, min(c.pos) p2 from x join tk c on x.doc_id = c.doc_id and c.term = 'and' and abs(c.pos - (p1 + 1)) <= 2 group by all),
hit as (select distinct doc_id from y)
select doc_id, round(2.0 * ln((n - df + 0.5) / (df + 0.5) + 1.0) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / greatest(avgdl, 1.0))), 6) as score
from hit join dl using (doc_id), st, (select count(*) df from po where term = 'of')""")
def phrase_three_slop(spark, sf_dir):
    return _out(documents_engine(spark, sf_dir).matches(PhraseQuery(["of", "the", "and"], slop=2)))


# ---------------------------------------------------- ranges, all, pages


@registered("select doc_id, 2.0::double as score from documents where n_chars >= 1000 and n_chars < 5000")
def range_numeric(spark, sf_dir):
    return _out(documents_engine(spark, sf_dir).matches(RangeQuery("n_chars", gte=1000, lt=5000, boost=2.0)))


@registered("select event_id as doc_id, 1.0::double as score from events where value > 10 and value <= 50")
def range_events(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumnRenamed("event_id", "doc_id")
    from lantern.plans.compile import in_range

    return events.where(in_range(events, RangeQuery("value", gt=10, lte=50))).select("doc_id", F.lit(1.0).alias("score"))


@registered(DOCS + f"select doc_id, round(s + 1.0, 6) as score from {bm25('the')} join documents using (doc_id) where n_chars >= 2000")
def range_and_term(spark, sf_dir):
    return _out(documents_engine(spark, sf_dir).matches(BoolQuery(must=[TermQuery("the"), RangeQuery("n_chars", gte=2000)])))


@registered("select doc_id, 1.0::double as score, lang from documents order by doc_id limit 10 offset 20")
def match_all_page(spark, sf_dir):
    return documents_engine(spark, sf_dir).page(MatchAllQuery(), limit=10, offset=20).select("doc_id", "score", "lang")


@registered(DOCS + f"select doc_id, round(a.s + b.s, 6) as score, source from {bm25('the')} a join {bm25('that')} b using (doc_id) join documents using (doc_id) order by a.s + b.s desc, doc_id limit 10 offset 5")
def ranked_page(spark, sf_dir):
    page = documents_engine(spark, sf_dir).page("the AND that", limit=10, offset=5)
    return page.select("doc_id", F.round("score", 6).alias("score"), "source")


# ---------------------------------------------------------------- facets


@registered(DOCS + """, m as (select doc_id, lang, source from documents where doc_id in (select doc_id from po where term = 'that'))
select 'lang' as field, lang as value, count(*) as count from m where lang is not null group by lang union all select 'source', source, count(*) from m where source is not null group by source""")
def facet_counts(spark, sf_dir):
    engine = documents_engine(spark, sf_dir)
    return facets.facet_counts(engine.index.docs.join(engine.matches("that"), "doc_id", "left_semi"), ["lang", "source"])


@registered("""select field, value, count from (select 'source' as field, source as value, count(*) as count, row_number() over (order by count(*) desc, source) r from documents where source is not null group by source) where r <= 5""")
def facet_top_n(spark, sf_dir):
    return facets.top_facets(facets.facet_counts(table(spark, sf_dir, "documents"), ["source"]), 5)


@registered(DOCS + f"select doc_id, round(s, 6) as score from {bm25('the')} join documents using (doc_id) where lang in ('en', 'fr') and source = 'src0'")
def facet_filtered_search(spark, sf_dir):
    return _out(documents_engine(spark, sf_dir).matches("the", filters={"lang": ["en", "fr"], "source": ["src0"]}))


# -------------------------------------------------- removal, many, snippets


@registered(DOCS.replace("from documents where text is not null", "from documents where text is not null and lang <> 'de'").replace("(select count(*) from documents)", "(select count(*) from documents where lang <> 'de')") + f"select doc_id, round(s, 6) as score from {bm25('the')}")
def remove_docs_rescore(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    engine = SearchEngine(schema=Schema(text=TextField(analyzer=Analyzer())), spark=spark)
    engine.index_documents(docs, "doc_id")
    engine.remove_where(docs.where("lang = 'de'"))
    return _out(engine.matches("the"))


@registered(DOCS + f"select 'one' as query, doc_id, round(s, 6) as score from {bm25('that')} union all select 'two', doc_id, round(s, 6) from {bm25('der')}")
def search_many(spark, sf_dir):
    found = documents_engine(spark, sf_dir).search_many({"one": "that", "two": "der"}, limit=1 << 30)
    return found.select("query", "doc_id", F.round("score", 6).alias("score"))


STEMMED = DOCS + f""", ss as ({stemmed('select distinct term from tk')}),
ks as (select doc_id, stem from tk join ss using (term) where term not in ({", ".join(f"'{w}'" for w in sorted(ENGLISH_STOP_WORDS))})),
ls as (select doc_id, count(ks.stem) dl from dl left join ks using (doc_id) group by doc_id),
sa as (select sum(dl)::double / (select count(*) from documents) avgdl, (select count(*) from documents) n from ls),
sp as (select stem, doc_id, count(*) tf from ks group by all),
sd as (select stem, count(*) df from sp group by all),
sc as (select stem, doc_id, ln((n - df + 0.5) / (df + 0.5) + 1.0) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / greatest(avgdl, 1.0))) s from sp join sd using (stem) join ls using (doc_id), sa)
"""


@registered(STEMMED + f""", again as ({stemmed("select distinct stem as term from sd where starts_with(stem, 'moron')")})
select doc_id, round(max(s), 6) as score from sc where stem in ('read', 'licens') or stem in (select stem from again) group by doc_id""")
def stemmed_search(spark, sf_dir):
    return _out(stemmed_engine(spark, sf_dir).matches("reading OR moron* OR license"))


def highlighted(rows: str, terms: list[str], size: int) -> str:
    """CTEs up to ``snip(doc_id, snippet)`` of a query that gives doc_id and t; no term may overlap itself or another."""
    listed, marks = ", ".join(f"'{t}'" for t in terms), "|".join(terms)
    blank = r"[^ \n\t]*"
    return f"""rw as (select doc_id, t, lower(t) low, length(t) n from ({rows})),
pc as (select doc_id, term, unnest(string_split(low, term)) piece, generate_subscripts(string_split(low, term), 1) k, len(string_split(low, term)) m from rw, (select unnest([{listed}]) term) where n > 0),
ht as (select * from (select doc_id, term, (sum(length(piece)) over (partition by doc_id, term order by k) + (k - 1) * length(term))::bigint p, k, m from pc) where k < m),
w0 as (select doc_id, t, n, greatest(0, p - {size // 2}) a0, least(n, greatest(0, p - {size // 2}) + {size}) b0, row_number() over (partition by doc_id order by p) k from ht join rw using (doc_id)),
wd as (select doc_id, t, n, k, length(regexp_replace(left(t, a0), '{blank}$', '')) a, case when b0 < n then least(n, b0 + length(regexp_extract(substr(t, b0), '^{blank}'))) else n end b from w0),
gr as (select doc_id, k, b as last, true as taken from wd where k = 1
  union all select wd.doc_id, wd.k, case when wd.a >= gr.last then wd.b else gr.last end, wd.a >= gr.last from gr join wd on wd.doc_id = gr.doc_id and wd.k = gr.k + 1),
sc as (select wd.doc_id, wd.k, t, n, a, b, count(*) + 2 * count(distinct term) v from wd join gr on gr.doc_id = wd.doc_id and gr.k = wd.k and taken join ht on ht.doc_id = wd.doc_id and a <= p and p + length(term) <= b group by all),
bs as (select *, row_number() over (partition by doc_id order by v desc, k) place from sc),
sn as (select doc_id, string_agg(case when a > 0 then '...' else '' end || regexp_replace(regexp_replace(substr(t, a + 1, b - a), '({marks})', '<b>\\1</b>', 'gi'), '^\\s+|\\s+$', '', 'g') || case when b < n then '...' else '' end, ' ... ' order by a) x from bs where place <= 3 group by doc_id),
snip as (select doc_id, coalesce(x, case when n > {size} then left(t, {size}) || '...' else coalesce(t, '') end) as snippet from rw left join sn using (doc_id))
"""


FOUND = DOCS + f""", pg as (select doc_id, text as t from {bm25('that')} a join {bm25('with')} b using (doc_id) join documents using (doc_id) order by a.s + b.s desc, doc_id limit 20)
"""


@registered(FOUND.replace("with tl", "with recursive tl", 1) + ", " + highlighted("select doc_id, t from pg", ["that", "with"], 150) + "select * from snip")
def highlight_snippets(spark, sf_dir):
    engine = documents_engine(spark, sf_dir)
    page = engine.page("that AND with", limit=20)
    return engine.with_highlight(page, "that AND with", "text", highlighter=Highlighter(overlapping=False)).select("doc_id", "snippet")


@registered("with recursive " + highlighted("select doc_id, text as t from documents", ["license", "that"], 80) + "select * from snip")
def highlight_all(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", Highlighter(overlapping=False).column(F.col("text"), ["license", "that"], 80).alias("snippet"))


@registered("select turn as n, count(*) as count from conversations group by turn")
def conversation_turns(spark, sf_dir):
    found = facets.facet_counts(table(spark, sf_dir, "conversations"), ["turn"])
    return found.select(F.col("value").cast("bigint").alias("n"), "count")


@registered("select doc_id, 1.0::double as score from (select l_orderkey * 10 + l_linenumber as doc_id, l_quantity from lineitem) where l_quantity >= 10 and l_quantity < 20")
def range_lineitem(spark, sf_dir):
    from lantern.plans.compile import in_range

    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc_id"), "l_quantity")
    return rows.where(in_range(rows, RangeQuery("l_quantity", gte=10, lt=20))).select("doc_id", F.lit(1.0).alias("score"))


@registered("select 'o_orderpriority' as field, o_orderpriority as value, count(*) as count from orders group by 2 union all select 'o_orderstatus', o_orderstatus, count(*) from orders group by 2")
def facet_orders(spark, sf_dir):
    return facets.facet_counts(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"])


@registered(PARTS + "select doc_id, round(sum(s), 6) as score from sc where term = 'widget' and doc_id in (select p_partkey from part where p_retailprice >= 950) group by doc_id")
def term_with_price_filter(spark, sf_dir):
    engine = parts_engine(spark, sf_dir)
    return _out(Compiler(engine.index, engine.scorer).matched(TermQuery("widget"), F.col("p_retailprice") >= 950))


@registered(PARTS + "select doc_id, round(max(s) * 2.0, 6) as score from sc where field = 'p_type' and starts_with(term, 'eco') group by doc_id")
def wildcard_field_boost(spark, sf_dir):
    return _out(parts_engine(spark, sf_dir).matches(WildcardQuery("eco*", "p_type", 2.0)))


# ------------------------------------------------- the language, whole pages


@registered(DOCS + f"select doc_id, round(x.s + c.s, 6) as score from (select doc_id, greatest(a.s, b.s) s from {bm25('that')} a full join {bm25('der')} b using (doc_id)) x join {bm25('with')} c using (doc_id)")
def parsed_grouping(spark, sf_dir):
    return _out(documents_engine(spark, sf_dir).matches("(that OR der) AND with"))


@registered("select doc_id, 1.0::double as score from documents")
def parsed_star(spark, sf_dir):
    return _out(documents_engine(spark, sf_dir).matches("*"))


@registered(DOCS + "select doc_id, round(2.5 * (tf + df::double / n) / dl, 6) as score from po join dl using (doc_id), st, (select count(*) df from po where term = 'with') where term = 'with'")
def custom_scorer(spark, sf_dir):
    engine = documents_engine(spark, sf_dir)
    return _out(Compiler(engine.index, PythonScorer(lambda tf, df, dl, avgdl, n: 2.5 * (tf + df / n) / dl)).matched(TermQuery("with")))


@registered(PARTS + """, f2 as (select doc_id, sum(s) filter (where field = 'p_name') / 2.0 a, sum(s) filter (where field = 'p_type') b from sc where term in ('widget', 'steel') group by doc_id)
select doc_id, round(coalesce(a, 0) * 3.0 + coalesce(b, 0) * 0.5, 6) as score from f2 where a is not null or b is not null""")
def multi_field_scores(spark, sf_dir):
    """Scores of two fields, combined by boosts."""
    engine = parts_engine(spark, sf_dir)
    scores = [engine.index.postings.where(F.col("field") == f).join(engine.index.terms, ["field", "term"]).where(F.col("term").isin("widget", "steel")) for f in ("p_name", "p_type")]
    sums = [d.groupBy("doc_id").agg(F.sum(BM25Scorer().column(F.col("tf"), F.col("df"), F.col("dl"), F.lit(engine.index.average_length(f)), F.lit(engine.index.doc_count))).alias(f)) for d, f in zip(scores, ("p_name", "p_type"))]
    return sums[0].join(sums[1], "doc_id", "full").select("doc_id", F.round(BM25Scorer.multi_field_column([(F.col("p_name"), 3.0), (F.col("p_type"), 0.5)]), 6).alias("score"))


@registered(r"""with v as (select p_partkey, lower(unnest(regexp_extract_all(p_type, '\S+'))) term from part),
w as (select p_partkey, lower(unnest(regexp_extract_all(p_brand, '[\p{L}\p{N}_]+'))) term from part)
select p_partkey, preset, term from v, (select unnest(['exact', 'keyword', 'simple']) as preset) union all select p_partkey, 'built', term from w where term <> 'brand'""")
def analyzer_presets(spark, sf_dir):
    """Terms of each preset, and of an analyzer built step by step."""
    parts = table(spark, sf_dir, "part")
    built = AnalyzerPipeline().tokenizer(RegexTokenizer(r"\w+", r"[\p{L}\p{N}_]+")).add_normalizer(LowercaseNormalizer()).stop_words({"brand"}).build()
    of = {"exact": (exact_analyzer(), "p_type"), "keyword": (keyword_analyzer(), "p_type"), "simple": (simple_analyzer(), "p_type"), "built": (built, "p_brand")}
    every = F.array(*(F.struct(F.lit(n).alias("preset"), a.terms_column(F.col(c)).alias("terms")) for n, (a, c) in of.items()))
    each = parts.select("p_partkey", F.explode(every).alias("x"))
    return each.select("p_partkey", "x.preset", F.explode("x.terms").alias("term"))


@registered(STEMMED + "select doc_id, stem as term from ks")
def standard_terms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(standard_analyzer().terms_column(F.col("text"))).alias("term"))


@registered(DOCS + "select 'text' as field, term, tf from po where doc_id = 7 union all select 'lang', lower(trim(lang)), 1 from documents where doc_id = 7 and lang is not null union all select 'source', lower(trim(source)), 1 from documents where doc_id = 7 and source is not null")
def postings_of_document(spark, sf_dir):
    return postings.by_doc(documents_engine(spark, sf_dir).index.postings, 7).select("field", "term", "tf")


@registered(DOCS + f""", h as (select doc_id, s, lang, row_number() over (order by s desc, doc_id) r from {bm25('with')} join documents using (doc_id)),
t as (select count(*) total from h), l as (select lang, count(*) c from h where lang is not null group by lang)
select 'hit' as kind, r::int as place, doc_id, round(s, 6) as score, lang as value from h where r <= 10 union all select 'total', 0, total, 0.0, null from t union all select 'facet', 0, c, 0.0, lang from l""")
def search_results(spark, sf_dir):
    """A page of hits with its total and facet counts, as the facade returns them."""
    found = documents_engine(spark, sf_dir).search("with", limit=10, facets=["lang"])
    rows = [("hit", k + 1, h.doc_id, round(h.score, 6), h.doc["lang"]) for k, h in enumerate(found)]
    rows += [("total", 0, found.total, 0.0, None)] + [("facet", 0, n, 0.0, value) for value, n in found.facets["lang"].items()]
    return spark.createDataFrame(rows, "kind string, place int, doc_id long, score double, value string")


@registered("""select p_partkey, regexp_replace(p_name, '(widget|red)', '<b>\\1</b>', 'gi') as marked from part""")
def highlight_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", Highlighter().column(F.col("p_name"), ["widget", "red"]).alias("marked"))


@registered("select doc_id, case when coalesce(text, '') = '' then '' when length(text) > 100 then substr(text, 1, 100) || '...' else text end as none_found, case when coalesce(text, '') = '' then '' else substr(text, 1, 150) end as none_asked from documents")
def highlight_guards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", Highlighter().column(F.col("text"), ["q\u0000q"], 100).alias("none_found"), Highlighter().column(F.col("text"), [], 100).alias("none_asked"))


# ------------------------------------------------------------ stored indexes


def _folder(spark: SparkSession) -> str:
    """A place for an index in the folder that the cluster shares; a local session without one uses its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{shared or 'file://' + tempfile.mkdtemp(prefix='lantern-index-')}/index-{uuid.uuid4().hex}"


def _part_schema() -> Schema:
    return Schema(p_name=TextField(analyzer="simple", boost=2.0), p_type=TextField(analyzer="simple"), p_brand=KeywordField(faceted=True), p_retailprice=NumericField())


@registered(PARTS + "select doc_id, round(sum(s), 6) as score from sc where term = 'widget' group by doc_id")
def stored_search(spark, sf_dir):
    """Committed, opened again, searched."""
    path, parts = _folder(spark), table(spark, sf_dir, "part")
    with SearchEngine(path, _part_schema(), spark=spark) as engine:
        engine.index_documents(parts, "p_partkey")
    return _out(SearchEngine(path, _part_schema(), spark=spark).matches("widget"))


@registered(PARTS + "select doc_id, round(max(s), 6) as score from sc where starts_with(term, 'st') group by doc_id")
def appended_segments_search(spark, sf_dir):
    """Three commits, each a segment of its own, searched as one."""
    path, parts = _folder(spark), table(spark, sf_dir, "part")
    for k in range(3):
        with SearchEngine(path, _part_schema(), spark=spark) as engine:
            engine.index_documents(parts.where(F.col("p_partkey") % 3 == k), "p_partkey")
    return _out(SearchEngine(path, _part_schema(), spark=spark).matches("st*"))


@registered(PARTS.replace("from part", "from part where p_size <= 25") + "select doc_id, round(sum(s), 6) as score from sc where term = 'widget' group by doc_id")
def compacted_after_removal_search(spark, sf_dir):
    """A removal makes the next commit write the index anew."""
    path, parts = _folder(spark), table(spark, sf_dir, "part")
    with SearchEngine(path, _part_schema(), spark=spark) as engine:
        engine.index_documents(parts, "p_partkey")
    with SearchEngine(path, _part_schema(), spark=spark) as engine:
        engine.remove_where(parts.where("p_size > 25").select(F.col("p_partkey").alias("doc_id")))
    return _out(SearchEngine(path, _part_schema(), spark=spark).matches("widget"))


@registered(PARTS + "select doc_id, round(sum(s), 6) as score from sc where term = 'widget' group by doc_id")
def exported_and_imported_search(spark, sf_dir):
    path, engine = _folder(spark), SearchEngine(schema=_part_schema(), spark=spark)
    engine.index_documents(table(spark, sf_dir, "part"), "p_partkey")
    engine.export_json(path)
    again = SearchEngine(schema=_part_schema(), spark=spark)
    again.import_json(path)
    return _out(again.matches("widget"))


@registered("select p_partkey as doc_id, p_name, p_brand from part")
def stored_documents(spark, sf_dir):
    path, parts = _folder(spark), table(spark, sf_dir, "part")
    with SearchEngine(path, _part_schema(), spark=spark) as engine:
        engine.index_documents(parts, "p_partkey")
    return SearchEngine(path, _part_schema(), spark=spark).documents.select("doc_id", "p_name", "p_brand")


@registered("select field, value, count, row_number() over (partition by field order by count desc, value)::int as place from (select 'p_brand' as field, p_brand as value, count(*) as count from part group by all union all select 'p_size', p_size::varchar, count(*) from part group by all) qualify row_number() over (partition by field order by count desc, value) <= 7")
def facet_collector(spark, sf_dir):
    """The most frequent values on the driver, as its views give them."""
    found = facets.FacetCollector.counted(facets.facet_counts(table(spark, sf_dir, "part"), ["p_brand", "p_size"]), 50)
    rows = [(field, value, n, k + 1) for field, pairs in found.get_all_facets(7).items() for k, (value, n) in enumerate(pairs)]
    return spark.createDataFrame(rows, "field string, value string, count long, place int")


@registered("select 'a' as id, 0 as place, count(*) as n from nation union all select 'c', 1, count(*) from region union all select 'latest', 2, count(*) from region union all select 'dropped', 3, 0")
def segments_listed(spark, sf_dir):
    """Saved, deleted, listed and loaded segments of a store."""
    store = SegmentStore(spark, _folder(spark))
    for name, of in (("a", "nation"), ("b", "supplier"), ("c", "region")):
        store.save_segment({"rows": table(spark, sf_dir, of)}, name)
    store.delete_segment("b")
    rows = [(x["id"], k, store.load_segment(x["id"])["rows"].count()) for k, x in enumerate(store.list_segments())]
    rows += [("latest", len(rows), store.load_latest()[0]["rows"].count()), ("dropped", len(rows) + 1, int(store.load_segment("b") is not None))]
    return spark.createDataFrame(rows, "id string, place int, n long")


@registered("""select doc_id, case when b < 1024 then printf('%.1f B', b::double) when b < 1048576 then printf('%.1f KB', b / 1024.0::double) else printf('%.1f MB', b / 1048576.0::double) end as size,
case when length(text) > 40 then left(text, 37) || '...' else text end as short from (select doc_id, text, 300 * strlen(text) as b from documents)""")
def sizes_and_truncation(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", format_size_column(F.octet_length("text") * 300).alias("size"), truncate_column(F.col("text"), 40).alias("short"))
