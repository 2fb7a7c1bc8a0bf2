import unicodedata

import pytest
from pyspark.sql import functions as F

from lantern import util
from lantern.functions import analysis, text
from lantern.functions.scoring import BM25Scorer, TFIDFScorer
from lantern.functions.snippets import Highlighter
from lantern.functions.stems import stem

STEMS = "caresses caress|ponies poni|cats cat|ties ti|caress caress|feed feed|agreed agre|plastered plaster|bled bled|motoring motor|sing sing|conflated conflat|sized size|hopping hop|falling fall|hissing hiss|fizzed fizz|failing fail|filing file|happy happi|sky sky|relational relat|conditional condit|rational ration|digitizer digit|triplicate triplic|hopeful hope|goodness good|revival reviv|adoption adopt|rate rate|controlled control|roll roll|running run|connected connect|generalization gener|an an|AB AB|y y"
STRINGS = ["", "well-known machine-learning", "don't can't won't", "...!!!", "Python 3.12 is great!", "hello, world!", "  café  résumé naïve x ", "日本語 text_1", "Hello world. How are you? Fine thanks.", "a\x1cb\x85c", "İstanbul ΑΣ", "¿Qué? Sí. Ño.  Fin!", "ab", "(x)… “q” —dash—", "x²½ ٣"]


@pytest.mark.parametrize("pair", STEMS.split("|"))
def test_stems(pair):
    word, want = pair.split()
    assert stem(word) == want


def test_long_runs_of_y_do_not_recurse():
    assert len(stem("y" * 5000)) == 5000 and stem("") == ""


@pytest.mark.parametrize("make", [text.RegexTokenizer, text.WhitespaceTokenizer, text.NgramTokenizer, lambda: text.NgramTokenizer(3, 3)])
def test_columns_equal_python(spark, make):
    tokenizer = make()
    df = spark.createDataFrame([(i, s) for i, s in enumerate(STRINGS)], "i int, s string")
    for r in df.select("s", tokenizer.column(F.col("s")).alias("t"), tokenizer.with_offsets(F.col("s")).alias("o")).collect():
        want = tokenizer.tokenize(r.s)
        assert [(t.text, t.position) for t in r.t] == [(t.text, t.position) for t in want], r.s
        assert [(t.text, t.start_char, t.end_char) for t in r.o] == [(t.text, t.start_char, t.end_char) for t in want]


def test_token_goldens():
    assert [t.text for t in text.RegexTokenizer().tokenize("well-known machine-learning")] == ["well-known", "machine-learning"]
    assert [(t.text, t.start_char, t.end_char) for t in text.WhitespaceTokenizer().tokenize("hello, world!")] == [("hello,", 0, 6), ("world!", 7, 13)]
    assert [t.text for t in text.NgramTokenizer().tokenize("abc")] == ["ab", "bc", "abc"] and text.NgramTokenizer(3, 3).tokenize("ab") == []
    assert text.SentenceTokenizer().tokenize("Hello world. How are you? Fine thanks.") == ["Hello world.", "How are you?", "Fine thanks."]
    assert len(text.ENGLISH_STOP_WORDS) == 127


ANALYZERS = [
    analysis.standard_analyzer(), analysis.simple_analyzer(), analysis.keyword_analyzer(), analysis.exact_analyzer(), analysis.Analyzer(),
    analysis.AnalyzerPipeline().tokenizer(text.WhitespaceTokenizer()).add_normalizer(text.LowercaseNormalizer()).add_normalizer(text.PunctuationStripper()).add_normalizer(text.AccentStripper()).stop_words({"is"}).stemmer().build(),
    analysis.AnalyzerPipeline().add_normalizer(text.UnicodeNormalizer("NFKC")).stop_words(set()).build(),
]


@pytest.mark.parametrize("k", range(len(ANALYZERS)))
def test_analyzers_agree_on_both_sides(spark, k):
    a = ANALYZERS[k]
    df = spark.createDataFrame([(s,) for s in [*STRINGS, "the running state of Art works", "Ⅷ ﬁne é", None]], "s string")
    for r in df.select("s", a.column(F.col("s")).alias("t")).collect():
        assert [(t.text, t.position) for t in r.t] == [(t.text, t.position) for t in a.analyze(r.s)], r.s


def test_analyzer_goldens():
    assert analysis.standard_analyzer().analyze_to_terms("works working work state of the art") == ["work", "work", "state", "art"]
    assert [t.position for t in analysis.standard_analyzer().analyze("state of art")] == [0, 2]
    assert analysis.exact_analyzer().analyze_to_terms("Hello World") == ["hello", "world"]
    assert text.AccentStripper().text("café résumé naïve") == "cafe resume naive" and unicodedata.normalize("NFC", "é") == text.UnicodeNormalizer().text("é")


def test_scorers(spark):
    assert TFIDFScorer().score(1, 10, n=1000) == pytest.approx(4.605170186)
    b = BM25Scorer()
    assert [b.score(t, 5, 100, 100, 1000) for t in (1, 10, 100)] == sorted(b.score(t, 5, 100, 100, 1000) for t in (1, 10, 100))
    assert b.score(1, 5, 50, 100, 1000) > b.score(1, 5, 200, 100, 1000) and BM25Scorer(b=0).score(1, 5, 50, 100, 1000) == BM25Scorer(b=0).score(1, 5, 200, 100, 1000)
    assert b.score(0, 5, 1, 1, 10) == b.score(1, 0, 1, 1, 10) == 0.0 and b.score_multi_field([(1.0, 2.0), (0.5, 1.0)]) == 2.5
    rows = [(1, 3, 10, 8.5, 40), (4, 40, 3, 0.2, 40), (0, 3, 1, 1.0, 40), (2, 1, 7, 3.0, 1)]
    df = spark.createDataFrame(rows, "tf int, df int, dl int, a double, n int")
    for s in (b, TFIDFScorer(), BM25Scorer(2.0, 0.1)):
        got = [r[0] for r in df.select(s.column(*(F.col(c) for c in ("tf", "df", "dl", "a", "n")))).collect()]
        assert got == pytest.approx([s.score(*x) for x in rows])


def test_highlighter_goldens():
    h = Highlighter()
    assert h.highlight("Python is a great language", ["python"]) == "<b>Python</b> is a great language"
    assert h.highlight("", ["x"]) == "" and h.highlight(None, ["x"]) == "" and h.highlight("abc" * 100, []) == ("abc" * 100)[:150]
    assert h.highlight("nothing here", ["zzz"], 7) == "nothing..." and h.highlight("prune the run", ["run"]) == "p<b>run</b>e the <b>run</b>"
    long = "start " + "filler " * 60 + "needle " + "filler " * 60 + "needle thread end"
    marked = h.highlight(long, ["needle", "thread"], 40)
    assert marked.count("<b>needle</b>") == 2 and marked.startswith("...") and " ... " in marked and not marked.endswith("...")
    assert Highlighter("[", "]", max_fragments=1).highlight(long, ["needle", "thread"], 40).count("[") == 2


def test_highlight_column(spark):
    df = spark.createDataFrame([("Python here",), (None,)], "s string")
    assert [r[0] for r in df.select(Highlighter().column(F.col("s"), ["python"])).collect()] == ["<b>Python</b> here", ""]


def test_helpers(spark, capsys):
    assert [util.format_size(n) for n in (0, 1023, 1024, 1536 * 1024)] == ["0.0 B", "1023.0 B", "1.0 KB", "1.5 MB"]
    sizes = [0, 1, 1023, 1024, 1280, 1792, 1536 * 1024, 5 << 30, 7 << 41, 3 << 52]
    assert [r[0] for r in spark.createDataFrame([(n,) for n in sizes], "n long").select(util.format_size_column(F.col("n"))).collect()] == [util.format_size(n) for n in sizes]
    assert util.truncate("a" * 10, 8) == "aaaaa..." and util.truncate("abc", 8) == "abc"
    df = spark.createDataFrame([("a" * 10,), ("abc",)], "s string")
    assert [r[0] for r in df.select(util.truncate_column(F.col("s"), 8)).collect()] == ["aaaaa...", "abc"]
    shared = ["x" * 1000]
    assert 1000 < util.deep_size({"a": shared, "b": shared}) < 2000
    with util.Timer() as t:
        pass
    assert t.elapsed_ms >= 0 and util.timed(lambda: 3)() == 3 and "ms" in capsys.readouterr().out


def test_offsets_of_long_texts_come_in_parts(spark, monkeypatch):
    texts = [(1, "ab cd-e " * 50), (2, None), (3, ""), (4, "é x")]
    df = spark.createDataFrame(texts, "id long, s string").coalesce(1)
    monkeypatch.setattr("lantern.functions.text.SENT_TOKENS", 7)
    tokenizer = text.RegexTokenizer()
    got = {tuple(r) for r in tokenizer.offsets_table(df, "id", "s").collect()}
    assert got == {(k, x.text, x.position, x.start_char, x.end_char) for k, t in texts for x in tokenizer.tokenize(t or "")}
    assert len(got) == 102 and not isinstance(tokenizer.each("a b"), list)


def test_overlapping_occurrences_count_only_if_asked(spark):
    # "thathat" holds "that" at 0 and at 3; counted twice, its fragment beats the first one.
    told = "that " + "x " * 60 + "thathat"
    assert Highlighter(max_fragments=1, fragment_size=20).highlight(told, ["that"]).endswith("<b>that</b>hat")
    once = Highlighter(max_fragments=1, fragment_size=20, overlapping=False)
    assert once.highlight(told, ["that"]).startswith("<b>that</b> x")
    assert spark.createDataFrame([(told,)], "s string").select(once.column(F.col("s"), ["that"])).first()[0] == once.highlight(told, ["that"])


def test_highlighting_takes_small_batches(spark):
    key, df = util.BATCH_ROWS, spark.range(2500).select(F.lit("some text").alias("s")).coalesce(1)
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        assert df.select(Highlighter().column(F.col("s"), ["text"])).distinct().count() == 1
        assert spark.conf.get(key) == "1000"
        spark.conf.set(key, "77")
        util.small_batches(spark)
        assert spark.conf.get(key) == "77"
    finally:
        spark.conf.set(key, before)
