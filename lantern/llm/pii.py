"""Personal data by patterns and a semi-Markov conditional random field.

Base spans are those of four patterns with checks.  A semi-Markov CRF scores
whole candidate segments (features see the entire span and what adjoins it) and
a bounded-entity dynamic program picks boundaries and types of all segments of a
neighbourhood jointly.  It adds what the patterns miss: phones without a
country code, written-out separators, and secrets such as keys and passwords.
Base spans always stay; an added span never touches one.

A text is cut into neighbourhoods around digits, ``@`` and a written-out ``at``,
as far as an address may go on from there: outside these no segment can be a
candidate, so the dynamic program over the whole text falls apart into theirs
and its result is that of the whole text.  One shape is left out on purpose: an
address with a blank beside its ``@``, or a dot after it, which "meet @ home.
Then" has too.  Patterns are matched in linear time, however long a run of
digits or letters is.

The CRF is trained here, by maximum likelihood with forward-backward on
sentences from seeded templates (:func:`trained`), within a second or two.

Defined results: a null or empty text has no spans; rows that repeat give equal
rows; offsets are code points; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from heapq import merge
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.llm import common

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: The longest segment, in units (runs of letters or digits, or one other sign).
MOST_UNITS = 24

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The look-behind and possessive counts change no match and keep runs of digits linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, end = [], 0
    for m in _DOMAIN.finditer(text):
        at = start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            out.append((start, m.end()))
            end = m.end()
    return out


def _ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]


def _counted(pattern: re.Pattern, text: str, low: int, high: int, check) -> list[tuple[int, int]]:
    out = []
    for m in pattern.finditer(text):
        digits = _DIGITS.sub("", m.group())
        if low <= len(digits) <= high and (check is None or check(digits)):
            out.append(m.span())
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The patterns' spans, by kind and start."""
    found = {
        "email": _emails(text) if "@" in text else [],
        "ip": _ips(text),
        "card": _counted(_CARD, text, 13, 19, luhn),
        "phone": _counted(_PHONE, text, 9, 15, None) if "+" in text else [],
    }
    return [(kind, a, b) for kind in BASE_KINDS for a, b in found[kind]]


# ---------------------------------------------------------------- the CRF

_UNIT = re.compile(r"[^\W_]+|\s+|.", re.S)
_HOT = re.compile(r"[0-9@]")
_REST = re.compile(r"\S*")
_WORD = re.compile(r"\S+")
_AT = re.compile(r"\[at\]|\(at\)")
#: What the pattern of an address takes in after a written-out ``at``.
_DOMAIN_ON = re.compile(r"(?: ?[\w-]++(?: ?(?:\.|\[dot\]|\(dot\)) ?[\w-]++)*+)?")
_BETWEEN = re.compile(r"[ ().\-]*")
_CUE = re.compile(r"(?:password|passwd|pwd|token|secret|api[_-]?key|key|auth)\W{0,4}$", re.I)
_CALL = re.compile(r"(?:tel|phone|call|fax|mobile|cell)\W{0,3}$", re.I)
_TAIL = 32
#: Characters after a segment that features see: as many as ' [dot] x' has.
_AFTER = 8
_ON = re.compile(r"[.\-/@_]\w")
_DOT_ON = re.compile(r" ?(?:\[dot\]|\(dot\)) ?\w")
_SECRET = re.compile(r"[A-Za-z0-9_\-]{12,}\Z")
_PHONE_LIKE = re.compile(r"\+?\(?[0-9][0-9 ().\-]*[0-9]\Z")
_MAIL_LIKE = re.compile(r"[\w.%+-]+ ?(?:@|\[at\]|\(at\)) ?[\w-]+(?: ?(?:\.|\[dot\]|\(dot\)) ?[\w-]+)+\Z")
_IP_LIKE = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}\Z")
_CARD_LIKE = re.compile(r"[0-9](?:[ .-]?[0-9]){12,18}\Z")


def possible(span: str) -> list[str]:
    """Kinds whose rough shape a segment has; others score nothing."""
    out, first = [], span[0]
    if "a" <= first.lower() <= "z" or first.isdigit():
        if _MAIL_LIKE.match(span):
            out.append("email")
        if any(c.isdigit() for c in span) and any(c.isalpha() for c in span) and _SECRET.match(span):
            out.append("secret")
    if _IP_LIKE.match(span):
        out.append("ip")
    if _PHONE_LIKE.match(span):
        n = sum(c.isdigit() for c in span)
        if 7 <= n <= 15:
            out.append("phone")
        if 13 <= n <= 19 and _CARD_LIKE.match(span):
            out.append("card")
    return out


def features(kind: str, span: str, before: str, after: str) -> list[str]:
    """Names of the features of a whole span and of what adjoins it."""
    digits = _DIGITS.sub("", span)
    out = [kind, f"{kind} digits {len(digits)}" if kind in ("card", "phone") else f"{kind} size {min(len(span) // 8, 6)}"]
    if before and before[-1].isalnum() or after and after[0].isalnum():
        out.append(f"{kind} inside a word")
    if before and before[-1] in "+.-@_/" or _ON.match(after) or kind == "email" and _DOT_ON.match(after):
        out.append(f"{kind} goes on")
    if kind == "card":
        out.append(f"card luhn {luhn(digits)}")
    if kind == "phone":
        groups = [len(g) for g in re.split(r"\D+", span) if g]
        out.append(f"phone groups {'-'.join(map(str, groups)) if len(groups) <= 4 else 'many'}")
        out.append(f"phone bracket {'(' in span and ')' in span} plus {span[0] == '+'}")
        if _CALL.search(before):
            out.append("phone cue")
    if kind == "ip":
        out.append(f"ip octets {all(int(p) <= 255 for p in span.split('.'))}")
    if kind == "email":
        out.append(f"email domain {bool(re.search(r'[A-Za-z]{2,}$', span))}")
    if kind == "secret":
        letters = [c for c in span if c.isalpha()]
        turns = sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:]))
        out.append(f"secret cue {bool(_CUE.search(before))}")
        out.append(f"secret turns {min(turns // 2, 4)}")
        out.append(f"secret hex {all(c in '0123456789abcdef' for c in span)}")
        out.append(f"secret one case {len({c.isupper() for c in letters}) == 1}")
    return out


def _words(text: str) -> Iterator[tuple[int, int]]:
    """Words with a digit or ``@``."""
    m, end = _HOT.search(text), 0
    while m:
        a, b = m.start(), _REST.match(text, m.end()).end()
        while a > end and not text[a - 1].isspace():
            a -= 1
        yield a, b
        end = b
        m = _HOT.search(text, b)


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Whole words around a written-out ``at``: the one before, and all that its domain may take in."""
    m = _AT.search(text)
    words = [w.span() for w in _WORD.finditer(text)] if m else []
    starts = [a for a, _ in words]
    while m:
        first = m.start() - (m.start() > 0 and text[m.start() - 1] == " ")
        last = _DOMAIN_ON.match(text, m.end()).end() - 1
        # A place in blanks belongs to the word before them.
        a, b = words[max(bisect_right(starts, max(first - 1, 0)) - 1, 0)], words[bisect_right(starts, last) - 1]
        yield min(a[0], m.start()), b[1]
        m = _AT.search(text, m.end())


def neighbourhoods(text: str) -> Iterator[tuple[int, int]]:
    """Ranges that hold every possible segment, in order, not touching.

    Words with a digit or ``@`` and the words around a written-out ``at``, where they stand close or only signs of a phone number lie between.
    """
    start = end = -1
    for a, b in merge(_words(text), _addresses(text)):
        if start >= 0 and (a <= end + 8 or _BETWEEN.fullmatch(text, end, a)):
            start, end = min(start, a), max(end, b)
        else:
            if start >= 0:
                yield start, end
            start, end = a, b
    if start >= 0:
        yield start, end


def candidates(text: str, low: int, high: int) -> tuple[list[int], list[tuple[int, int, str]]]:
    """Unit boundaries of text[low:high] and segments (first, past, kind)."""
    units = [m.start() for m in _UNIT.finditer(text, low, high)]
    edges = [*units, high]
    out = []
    for i, a in enumerate(units):
        c = text[a]
        if not (c.isalnum() or c in "+("):
            continue
        digits, spaced = 0, False
        for j in range(i + 1, min(i + MOST_UNITS, len(units)) + 1):
            last = text[edges[j] - 1]
            if last.isspace():
                if "\n" in text[edges[j - 1] : edges[j]]:
                    break
                spaced = True
                continue
            digits += sum(map(str.isdigit, text[edges[j - 1] : edges[j]]))
            if spaced and digits > 19:  # no kind has as many in several words
                break
            if not last.isalnum() or edges[j] - a < 7:
                continue
            out.extend((i, j, kind) for kind in possible(text[a : edges[j]]))
    return edges, out


def _named(text: str, edges: list[int], found: list[tuple[int, int, str]]) -> list[list[str]]:
    return [features(kind, text[edges[i] : edges[j]], text[max(0, edges[i] - _TAIL) : edges[i]], text[edges[j] : edges[j] + _AFTER]) for i, j, kind in found]


def best(n: int, found: list[tuple[int, int, str]], scores: list[float]) -> list[tuple[int, int, str]]:
    """The best set of segments of ``n`` units that don't overlap."""
    ending: dict[int, list[int]] = {}
    for k, (_, j, _) in enumerate(found):
        ending.setdefault(j, []).append(k)
    value, back = [0.0] * (n + 1), [-1] * (n + 1)
    for j in range(1, n + 1):
        value[j] = value[j - 1]
        for k in ending.get(j, ()):
            if (v := value[found[k][0]] + scores[k]) > value[j]:
                value[j], back[j] = v, k
    out, j = [], n
    while j:
        if back[j] < 0:
            j -= 1
        else:
            out.append(found[back[j]])
            j = found[back[j]][0]
    return out[::-1]


def _gradient(n: int, found: list[tuple[int, int, str]], scores: np.ndarray) -> np.ndarray:
    """Posterior probabilities of the segments, by forward and backward sums."""
    ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    ahead[0] = behind[n] = 0.0
    ending: dict[int, list[int]] = {}
    starting: dict[int, list[int]] = {}
    for k, (i, j, _) in enumerate(found):
        ending.setdefault(j, []).append(k)
        starting.setdefault(i, []).append(k)
    for j in range(1, n + 1):
        ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(ahead[found[k][0]] + scores[k] for k in ending.get(j, ()))])
    for i in range(n - 1, -1, -1):
        behind[i] = np.logaddexp.reduce([behind[i + 1], *(behind[found[k][1]] + scores[k] for k in starting.get(i, ()))])
    return np.array([math.exp(ahead[i] + scores[k] + behind[j] - ahead[n]) for k, (i, j, _) in enumerate(found)])


def sentences(seed: int = 13, n: int = 160) -> list[tuple[str, set[tuple[int, int, str]]]]:
    """Made-up sentences and their true segments."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(2, 9)))

    def card() -> str:
        body = d(r.choice([14, 15, 15, 15]))
        full = next(body + c for c in "0123456789" if luhn(body + c))
        sep = r.choice(["", "", " ", "-", "."])
        return sep.join(full[k : k + 4] for k in range(0, len(full), 4))

    def phone() -> str:
        a, b, c = d(3), d(3), d(4)
        return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+1 ({a}) {b}-{c}", f"+{d(2)} {a} {b} {c}", f"{a}.{b}.{c}", f"+1-{a}-{b}-{c}"])

    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    some = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    makers = {
        "phone": phone,
        "card": card,
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "email": lambda: r.choice([f"{word()}.{word()}@{word()}.com", f"{word()}@{word()}.co.uk", f"{word()} [at] {word()} [dot] org", f"{word()}{d(2)} (at) {word()}.net"]),
        "secret": lambda: r.choice([hexes(18), hexes(40), hexes(32), some(24), "AKIA" + some(16).upper()]),
    }
    other = [
        lambda: d(4), lambda: f"{d(2)}/{d(2)}/{d(4)}", lambda: f"{d(4)}-{d(2)}-{d(2)}", lambda: f"{d(1)}.{d(2)}.{d(1)}", lambda: f"{d(2)},{d(3)}.{d(2)}",
        lambda: d(r.randint(5, 12)), lambda: d(r.randint(20, 24)), lambda: "-".join(d(r.randint(1, 3)) for _ in range(5)), lambda: " ".join(d(r.randint(1, 4)) for _ in range(r.randint(3, 6))),
        lambda: f"{word()}{d(r.randint(1, 3))}{word()}", lambda: f"{word()}-{word()}-{d(2)}", lambda: f"300.{d(3)}.{d(2)}.999", lambda: f"{word()}_{word()}_{d(1)}", lambda: f"{d(3)}-{d(3)}", lambda: f"({d(4)})", lambda: f"{d(3)}.{d(3)}",
    ]
    cues = {"secret": ["token = \"", "password=", "api_key: ", "secret ", ""], "phone": ["call ", "tel: ", "", "", ""]}
    out = []
    for _ in range(n):
        text, true = "", set()
        for _ in range(r.randint(1, 5)):
            text += " ".join(word() for _ in range(r.randint(1, 4))) + " "
            if r.random() < 0.55:
                kind = r.choice(list(makers))
                text += r.choice(cues.get(kind, [""]))
                made = makers[kind]()
                if kind == "secret" and not (any(c.isdigit() for c in made) and any(c.isalpha() for c in made)):
                    continue
                true.add((len(text), len(text) + len(made), kind))
                text += made
            else:
                text += r.choice(other)()
            text += r.choice(["", ".", ",", "\"", ";"]) + " "
        out.append((text, true))
    return out


@lru_cache(maxsize=1)
def trained(rounds: int = 40, rate: float = 0.6, decay: float = 0.002) -> dict[str, float]:
    """Feature weights by maximum likelihood with a squared penalty."""
    index: dict[str, int] = {}
    cases = []
    for text, true in sentences():
        for low, high in neighbourhoods(text):
            edges, found = candidates(text, low, high)
            if found:
                rows = [[index.setdefault(x, len(index)) for x in names] for names in _named(text, edges, found)]
                cases.append((len(edges) - 1, found, rows, np.array([(edges[i], edges[j], kind) in true for i, j, kind in found], float)))
    weights, moment = np.zeros(len(index)), np.full(len(index), 1e-8)
    for _ in range(rounds):
        slope = -decay * weights * len(cases)
        for n, found, rows, true in cases:
            off = true - _gradient(n, found, np.array([weights[r].sum() for r in rows]))
            for r, v in zip(rows, off):
                slope[r] += v
        moment += slope * slope
        weights += rate * slope / np.sqrt(moment)
    return {name: float(weights[k]) for name, k in index.items()}


def added_spans(text: str, base: list[tuple[str, int, int]], weights: dict[str, float]) -> list[tuple[str, int, int]]:
    """Segments of the best labelling that touch no base span."""
    taken = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    out = []
    for low, high in neighbourhoods(text):
        edges, found = candidates(text, low, high)
        if not found:
            continue
        # A feature never met in training speaks against a segment.
        scores = [sum(weights.get(x, -0.5) for x in names) for names in _named(text, edges, found)]
        for i, j, kind in best(len(edges) - 1, found, scores):
            a, b = edges[i], edges[j]
            before = bisect_left(starts, b)
            if not before or reach[before - 1] <= a:
                out.append((kind, a, b))
    return out


def all_spans(text: str, weights: dict[str, float]) -> tuple[list, list]:
    base = base_spans(text)
    whole = base + added_spans(text, base, weights)
    return base, sorted(whole, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of base spans, and all spans."""
    weights = trained()
    names = ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_added"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names[1:]]
            for at in range(0, batch.num_rows, 256):
                for text in batch["text"].slice(at, 256).to_pylist():
                    base, whole = all_spans(text, weights) if text else ([], [])
                    counts = [sum(s[0] == k for s in base) for k in BASE_KINDS]
                    for column, value in zip(out, (*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(whole), len(whole) - len(base))):
                        column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, t) for c, t in zip(out, kinds))], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.transform(common.in_arrow, find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def runs(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Maximal runs of overlapping spans, in order; a run's kind is that of its first span (of the longest of those)."""
    out: list[tuple[str, int, int]] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if out and a < out[-1][2]:
            out[-1] = (*out[-1][:2], max(out[-1][2], b))
        else:
            out.append((kind, a, b))
    return out


def marked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each run of spans replaced by a mark: no character that any span covers is left."""
    parts, at = [], 0
    for kind, a, b in runs(spans):
        parts += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*parts, text[at:]])


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every run of spans in ``text_col`` replaced by its kind in brackets.

    Null and empty texts stay as they are, and so do all other columns, whatever their names.
    """
    weights = trained()
    place = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[place] = pa.array([marked(t, all_spans(t, weights)[1]) if t else t for t in batch.column(place).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return common.kept_columns(docs, clean)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(common.table(spark, sf_dir, "documents"))
