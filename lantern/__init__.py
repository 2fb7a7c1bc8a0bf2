"""Full-text search as Spark plans; the README has the module map."""

from lantern.functions.analysis import Analyzer, AnalyzerPipeline
from lantern.functions.scoring import BM25Scorer, TFIDFScorer
from lantern.functions.stems import PorterStemmer
from lantern.functions.text import ENGLISH_STOP_WORDS, AccentStripper, LowercaseNormalizer, NgramTokenizer, RegexTokenizer, StopWordFilter, UnicodeNormalizer, WhitespaceTokenizer
from lantern.plans.ast import BoolQuery, MatchAllQuery, PhraseQuery, RangeQuery, TermQuery, WildcardQuery
from lantern.plans.engine import SearchEngine
from lantern.sources.document import Document
from lantern.sources.schema import KeywordField, NumericField, Schema, TextField

__version__ = "1.0.0"
__all__ = [name for name in dir() if name[0].isupper()] + ["__version__"]
