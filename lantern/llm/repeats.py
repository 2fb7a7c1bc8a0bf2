"""Removal of byte strings that occur more than once, by suffix order.

A window of ``length`` bytes is removed where an equal one starts anywhere else.

1. Every window has an anchor: its ``gram``-byte string of least hash (the
   left-most of equals), which depends on the window alone, so equal windows
   have equal anchors at equal places.  Consecutive windows of one anchor
   occurrence form a context, of about ``length`` + 80 bytes.
2. Anchor strings that occur once anywhere can't lie in a repeated window; a
   count of hashes, combined before the shuffle, leaves the others.  A fixed-size
   Bloom filter of these thins the second scan; where it is too small for the
   corpus it only lets more through, and the exact join that follows decides.
3. A context found several times is wholly repeated, and one copy goes on.
   Anchors with one distinct context are done.
4. The distinct contexts of the other anchors are brought together by anchor
   and ordered by external induced suffix sorting (``induction``); suffixes
   with a common prefix of ``length`` give the repeated windows.
   Shards are as many as the contexts' bytes ask for, ``SHARD_BYTES`` each.
5. An anchor with more than ``hot_contexts`` distinct contexts (a short line in
   a third of all documents) isn't given to one task: its windows are counted by
   128-bit hashes in a grouped aggregation, which gives the same result.

Texts move twice at most, to be cut into contexts and to lose their spans; those
that a bitmap of fixed size tells to be in neither stay where they lie.

Defined results: a null text counts as empty; rows that repeat an id and text
are documents of their own and get equal results; null ids are kept; texts
shorter than ``length`` lose nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.llm import common, induction, shingles

LENGTH = 200
GRAM = 48
HOT_CONTEXTS = 1 << 17
BLOOM_BITS = 1 << 25
#: A byte that UTF-8 never holds parts the contexts.
BREAK = b"\xff"
#: Bytes of contexts that a suffix sort is given, about; and those that wait for it in memory before a file takes them.
SHARD_BYTES, WAITING_BYTES = 1 << 25, 1 << 24

#: Windows of a very long text are taken in runs of so many.
SEGMENT = 1 << 20

_M = np.uint64
_BITS = _M(21)


def _prefix_sums(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    up, down = shingles._powers(len(raw) + 1)
    b = np.frombuffer(raw, np.uint8)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(shingles._letters[b] * up[: len(raw)], out=sums[1:])
    return sums, down


def anchors(raw: bytes, length: int, gram: int) -> tuple[np.ndarray, ...] | None:
    """Gram hashes, context hashes, starts and byte lengths of all contexts."""
    parts = []
    for at in range(0, len(raw) - length + 1, SEGMENT):
        g, c, low, size = _segment_anchors(raw[at : at + SEGMENT + length - 1], length, gram)
        parts.append((g, c, low + at, size))
    return tuple(map(np.concatenate, zip(*parts))) if parts else None


def _segment_anchors(raw: bytes, length: int, gram: int) -> tuple[np.ndarray, ...]:
    sums, down = _prefix_sums(raw)
    width, grams = length - gram + 1, len(raw) - gram + 1
    h = shingles.mix((sums[gram:] - sums[:-gram]) * down[:grams])
    # The place in the low bits makes the left-most of equal hashes the least. As many bits in every
    # segment: which gram a window takes must not depend on the text around it.
    m, span = (h >> _BITS << _BITS) | np.arange(grams, dtype=np.uint64), 1
    while span * 2 <= width:
        m, span = np.minimum(m[:-span], m[span:]), span * 2
    if width > span:
        m = np.minimum(m[: len(m) - (width - span)], m[width - span :])
    place = (m & ((_M(1) << _BITS) - _M(1))).astype(np.int64)
    low = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    high = np.append(low[1:], len(place)) - 1 + length
    context = shingles.mix((sums[high] - sums[low]) * down[low] + (high - low).astype(np.uint64))
    return h[place[low]].view(np.int64), context.view(np.int64), low, high - low


class Bloom:
    """A bounded filter over 64-bit hashes; three probes."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, _M(len(words) * 64 - 1)

    def probes(self, keys: np.ndarray) -> list[np.ndarray]:
        k = keys.view(np.uint64)
        step = shingles.mix(k) | _M(1)
        return [(k + step * _M(i)) & self.mask for i in range(3)]

    def holds(self, keys: np.ndarray) -> np.ndarray:
        ok = np.ones(len(keys), np.bool_)
        for p in self.probes(keys):
            ok &= (self.words[(p >> _M(6)).astype(np.int64)] >> (p & _M(63)) & _M(1)).astype(np.bool_)
        return ok

    @classmethod
    def of(cls, keys: DataFrame, count: int, most_bits: int) -> Bloom:
        bits = min(most_bits, max(1 << 10, 1 << (16 * count).bit_length()))
        empty = cls(np.zeros(bits // 64, np.uint64))

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = np.zeros(bits // 64, np.uint64)
            for batch in batches:
                for p in empty.probes(batch["gram"].to_numpy(zero_copy_only=False)):
                    np.bitwise_or.at(mine, (p >> _M(6)).astype(np.int64), _M(1) << (p & _M(63)))
            used = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(mine[used].view(np.int64), pa.int64())], ["at", "bits"])

        # At most bits / 64 rows, whatever the input.
        rows = keys.transform(common.in_arrow, spread, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
        empty.words[rows["at"].to_numpy()] = rows["bits"].to_numpy(np.int64).view(np.uint64)
        return empty


def _slices(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)


def _gram_counts(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 1024):
            found = [a[0] for t in batch["text"].to_pylist() if (a := anchors(t.encode(), length, gram)) is not None]
            if found:
                each, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(each), pa.array(counts, pa.int64())], ["gram", "n"])

    return docs.select("text").transform(common.in_arrow, grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram")


def _contexts(docs: DataFrame, bloom: Bloom, length: int, gram: int) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(bloom.words)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = Bloom(held.value)
        for batch in _slices(batches, 1024):
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for k, text in enumerate(batch["text"].to_pylist()):
                a = anchors(text.encode(), length, gram)
                if a is None:
                    continue
                ok = filter_.holds(a[0])
                if ok.any():
                    for column, values in zip(out, (*a, np.full(len(ok), k))):
                        column.append(values[ok])
            if out[0]:
                grams, contexts, low, size, row = map(np.concatenate, out)
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams), pa.array(contexts), batch["doc_id"].take(row), batch["sum"].take(row), pa.array(low, pa.int64()), pa.array(size, pa.int32())],
                    ["gram", "context", "doc_id", "sum", "low", "size"],
                )

    return docs.transform(common.in_arrow, found, "gram long, context long, doc_id long, sum long, low long, size int")


def _spools(batches: Iterator[pa.RecordBatch], budget: induction.Budget):
    """Columns of all rows and their bytes as one string with breaks."""
    import tempfile

    columns: list[list] = [[], [], [], []]
    with tempfile.SpooledTemporaryFile(WAITING_BYTES, dir=budget.folder()) as spool:
        starts, at = array("q"), 0
        for batch in _slices(batches, 4096):
            for column, name in zip(columns, ("doc_id", "sum", "low", "size")):
                column.append(batch[name])
            for raw in batch["raw"].to_pylist():
                starts.append(at)
                spool.write(raw + BREAK)
                at += len(raw) + 1
        text = budget.array(at, np.uint8)
        spool.seek(0)
        for k in range(0, at, 1 << 20):
            piece = spool.read(1 << 20)
            text[k : k + len(piece)] = np.frombuffer(piece, np.uint8)
    return columns, np.array(starts, np.int64), text


def _runs(mask: np.ndarray, starts: np.ndarray, n: int, length: int, budget: induction.Budget) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, first, past) of runs of marked windows; a match across a break isn't one of windows."""
    last = np.append(starts[1:], n) - 1 - length  # of each row's windows
    for part in budget.parts(n):
        at = np.flatnonzero(mask[part]) + part.start
        row = np.searchsorted(starts, at, side="right") - 1
        at, row = at[ok := at <= last[row]], row[ok]
        if len(at):
            # Runs that a block cuts give two spans that touch.
            new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1]))))
            yield row[new], at[new], at[np.append(new[1:], len(at)) - 1] + 1


def _sorted_out(rows: DataFrame, length: int, budget_args: tuple) -> DataFrame:
    """Spans (doc_id, sum, start, stop) of repeated windows among contexts."""

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        budget = induction.Budget(*budget_args)
        try:
            columns, starts, text = _spools(batches, budget)
            if not len(starts):
                return
            mask = induction.repeated(text, length, budget)
            ids, sums, low = (pa.chunked_array(c).combine_chunks() for c in columns[:3])
            low = low.to_numpy()
            for row, first, past in _runs(mask, starts, len(text), length, budget):
                pick, base = pa.array(row), low[row] - starts[row]
                yield pa.RecordBatch.from_arrays([ids.take(pick), sums.take(pick), pa.array(base + first), pa.array(base + past - 1 + length)], ["doc_id", "sum", "start", "stop"])
        finally:
            budget.close()

    return rows.transform(common.in_arrow, order, "doc_id long, sum long, start long, stop long")


def _counted(rows: DataFrame, length: int) -> DataFrame:
    """The same spans by counting window hashes; for anchors beyond a shard."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 64):
            for k, raw in enumerate(batch["raw"].to_pylist()):
                sums, down = _prefix_sums(raw)
                n = len(raw) - length + 1
                a = shingles.mix((sums[length:] - sums[:-length]) * down[:n])
                back, _ = _prefix_sums(raw[::-1])
                b = shingles.mix(((back[length:] - back[:-length]) * down[:n])[::-1])
                pick = pa.array(np.full(n, k))
                start = batch["low"][k].as_py() + np.arange(n)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), batch["doc_id"].take(pick), batch["sum"].take(pick), pa.array(start)], ["h1", "h2", "doc_id", "sum", "start"])

    each = common.written(rows.transform(common.in_arrow, windows, "h1 long, h2 long, doc_id long, sum long, start long"), "windows")
    twice = each.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
    return each.join(twice, ["h1", "h2"]).select("doc_id", "sum", "start", (F.col("start") + length).alias("stop"))


def _same(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Join on (sum, doc_id), null ids being equal to each other."""
    b = b.withColumnRenamed("doc_id", "id_b").withColumnRenamed("sum", "sum_b")
    joined = a.join(b, (F.col("sum") == F.col("sum_b")) & F.col("doc_id").eqNullSafe(F.col("id_b")), how)
    return joined if how in ("left_semi", "left_anti") else joined.drop("id_b", "sum_b")


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_contexts: int = HOT_CONTEXTS, bloom_bits: int = BLOOM_BITS, shard_bytes: int = SHARD_BYTES, budget: tuple = ()) -> DataFrame:
    """(doc_id, sum, found): byte ranges to remove, of the documents that have any.

    ``docs`` has doc_id, text (no nulls) and sum, a hash of the text.
    """
    grams = common.written(_gram_counts(docs, length, gram), "grams")
    bloom = Bloom.of(grams, grams.count(), bloom_bits)
    context = common.written(_contexts(docs, bloom, length, gram).join(grams, "gram", "left_semi"), "contexts")
    common.dropped(grams)
    each = context.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("doc_id", "sum", "low", "size"), "low").alias("one"))
    each = common.written(each, "each")
    copied = context.join(each.where("n > 1").select("gram", "context"), ["gram", "context"]).select("doc_id", "sum", F.col("low").alias("start"), (F.col("low") + F.col("size")).alias("stop"))
    several = each.groupBy("gram").agg(F.count(F.lit(1)).alias("distinct")).where("distinct > 1")
    need = each.join(several, "gram").select("gram", "distinct", "one.*")
    # One document's contexts: as many as its own length allows.
    wanted = common.written(need.groupBy("doc_id", "sum").agg(F.collect_list(F.struct("gram", "distinct", "low", "size")).alias("wanted")), "wanted")
    asked, _ = common.sifted(docs.select("doc_id", "text", "sum"), F.struct("doc_id", "sum"), wanted, F.struct("doc_id", "sum"))
    held = _same(asked, wanted, "inner").select("doc_id", "sum", "text", "wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None
        for batch in _slices(batches, 64):
            for k in range(batch.num_rows):
                key = (batch["doc_id"][k].as_py(), batch["sum"][k].as_py())
                if key == seen:  # a row that repeats id and text
                    continue
                seen, raw, items = key, batch["text"][k].as_py().encode(), batch["wanted"][k].as_py()
                pick = pa.array([k] * len(items))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(pick), batch["sum"].take(pick), *(pa.array([x[c] for x in items], t) for c, t in (("gram", pa.int64()), ("distinct", pa.int64()), ("low", pa.int64()), ("size", pa.int32()))), pa.array([raw[x["low"] : x["low"] + x["size"]] for x in items], pa.binary())],
                    ["doc_id", "sum", "gram", "distinct", "low", "size", "raw"],
                )

    cuts = common.written(held.transform(common.in_arrow, cut, "doc_id long, sum long, gram long, distinct long, low long, size int, raw binary"), "cuts")
    hot = cuts.where(F.col("distinct") > hot_contexts)
    usual = cuts.where(F.col("distinct") <= hot_contexts)
    asked_bytes = usual.agg(F.sum("size")).first()[0] or 0
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-asked_bytes // shard_bytes))
    found = copied.unionByName(_sorted_out(usual.repartition(shards, "gram"), length, budget))
    if common.has_rows(hot):
        found = found.unionByName(_counted(hot, length))
    out = common.written(found.groupBy("doc_id", "sum").agg(F.collect_set(F.struct("start", "stop")).alias("found")), "spans")
    common.dropped(context, each, wanted, cuts)
    return out


def _with_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` (with doc_id and sum) and ``found``, null where a document has none."""
    touched, rest = common.sifted(docs, F.struct("doc_id", "sum"), found, F.struct("doc_id", "sum"))
    return _same(touched, found, "left").unionByName(rest, allowMissingColumns=True)


def _merged(found: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((x["start"], x["stop"]) for x in found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _prepared(docs: DataFrame) -> DataFrame:
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return plain.withColumn("sum", F.xxhash64("text"))


def remove_repeats(docs: DataFrame, keep_text: bool = False, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, on request, kept.

    ``kept`` is the remaining text.  A run may begin or end inside a
    multi-byte character; bytes left of such a character are dropped from
    ``kept`` (not from the digest, which is of all remaining bytes).
    """
    plain = _prepared(docs)
    found = spans(plain, **options)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 256):
            out: list[list] = [[] for _ in names[1:]]
            for text, ranges in zip(batch["text"].to_pylist(), batch["found"].to_pylist()):
                raw, runs = text.encode(), _merged(ranges or [])
                left, at = [], 0
                for a, b in runs:
                    left.append(raw[at:a])
                    at = b
                left.append(raw[at:])
                rest = b"".join(left)
                values = (len(raw), len(raw) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore"))
                for column, value in zip(out, values):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, t) for c, t in zip(out, kinds))], names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * keep_text
    return _with_spans(plain, found).select("doc_id", "text", "found").transform(common.in_arrow, remove, schema)


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with repeated bytes cut out of ``text``, all columns and rows kept.

    A row that loses all its text stays, with an empty one; a null text stays null.
    """
    found = spans(_prepared(docs), **options)
    names, plain = docs.columns, common.numbered(docs)
    doc_id, text = (F.col(f"c{names.index(c)}") for c in ("doc_id", "text"))
    keyed = plain.select("*", doc_id.cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))).alias("sum"))
    held = _with_spans(keyed, found).select(*plain.columns, "found").toDF(*names, "found")
    place = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for k, ranges in enumerate(batch.column(len(names)).to_pylist()):
                if ranges:
                    raw, left, at = texts[k].encode(), [], 0
                    for a, b in _merged(ranges):
                        left.append(raw[at:a])
                        at = b
                    left.append(raw[at:])
                    texts[k] = b"".join(left).decode("utf-8", "ignore")
            columns = list(batch.columns)
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return common.without_last(common.kept_columns(held, cut))


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents"))


#: For small tables with unique ids: all windows of 200 bytes, as hexadecimal digits, cut from segments of 512.
ORACLE = r"""
with x as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents
), g as (select doc_id, s, substring(h, s * 1024 + 1, 1422) as p from (select doc_id, h, unnest(range(0, length(h) // 1024 + 1)) as s from x)
), w as (select doc_id, s * 512 + k as i, substring(p, 2 * k + 1, 400) as v from (select doc_id, s, p, unnest(range(0, greatest(least(512, length(p) // 2 - 199), 0))) as k from g)
), r as (select v from w group by v having count(*) > 1
), m as (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 200 then 0 else 1 end as fresh from w where v in (select v from r)
), o as (select doc_id, run, min(i) as a, max(i) + 200 as b from (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as run from m) group by all
), k as (select doc_id, a, lag(b, 1, 0) over (partition by doc_id order by a) as z from o
), t as (select doc_id, sum(b - a)::bigint as n_removed, count(*) as n_spans, max(b) as last from o group by doc_id
), q as (select doc_id, string_agg(substring(h, 2 * z + 1, 2 * (a - z)), '' order by a) as q from k join x using (doc_id) group by doc_id)
select doc_id, length(h) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(q, '') || substring(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
from x left join t using (doc_id) left join q using (doc_id)
"""
