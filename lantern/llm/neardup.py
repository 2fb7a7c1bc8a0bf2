"""MinHash near-duplicate groups: minima, bands, verification, components.

1. Each text gives its shingle count, a 128-bit hash of its word sequence and
   the keys of its bands (``bands`` bands of ``rows`` universal hash minima).
   With 44 x 5, a pair at the threshold of 0.8 shares no band with a
   probability of 2.5e-8, and less above it.
2. Rows of one word sequence form a class; only its representative goes on, so
   a text repeated in a third of all rows is one row from here.
3. A bucket's members are compared with its least member only.  Candidates are
   verified by signatures (one bit of each minimum; pairs that differ in more bits
   than a linked pair can but with a probability below 1e-9 go), the rest
   confirmed on the full shingle sets, and confirmed links joined to components.
4. Buckets whose members all lie in one component are done.  Of the rest, those
   of up to ``crowd`` members have their pairs from different components
   confirmed too, so work stays in proportion to the members.  The members of
   larger ones (pages of one template, alike but not near duplicates) meet in an
   exact join by rare shingles instead (:func:`by_rare_shingles`), which finds
   every link among them without enumerating a bucket's pairs.  Connectivity is
   thus that of all candidate pairs.

Only texts of candidate pairs are shuffled, sifted by a bitmap of fixed size.

Defined results: a null, empty or blank text has no shingles and links with
nothing; a doc_id that repeats with several texts has the links of all of them,
and each of its rows keeps a row, with its own count; null doc_ids get their row
and no link; other columns are ignored.  Nodes are doc_ids, or where one repeats
with several texts, (doc_id, hash of the text), joined among one doc_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.llm import common, shingles
from lantern.llm.components import connected

BANDS, ROWS = 44, 5
THRESHOLD_PERCENT = 80
#: Buckets of more members go the way of rare shingles.
CROWD = 64
#: Counters of shingle frequencies; these only order shingles, so sharing one costs work, never a link.
COUNTERS = 1 << 20


def most_bits(minima: int, percent: int) -> int:
    """Bits in which a linked pair's signatures differ at most, but for less than 1e-9.

    A bit differs with half the probability that a minimum does: the binomial's
    upper tail beyond the result is below 1e-9 at the threshold.
    """
    p, tail, k = (100 - percent) / 200, 0.0, minima
    while k > 0:
        log_term = math.lgamma(minima + 1) - math.lgamma(k + 1) - math.lgamma(minima - k + 1) + (k * math.log(p) if p else -math.inf) + (minima - k) * math.log1p(-p)
        tail += math.exp(log_term)
        if tail >= 1e-9:
            return k
        k -= 1
    return 0


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    import xxhash

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = shingles.MinHash(bands, rows)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts, high, low, keys, bits = [], [], [], [], []
                for text in part["text"].to_pylist():
                    words = shingles.word_hashes((text or "").encode())
                    found = shingles.shingle_set(words)
                    counts.append(len(found))
                    whole = xxhash.xxh3_128_intdigest(words.tobytes()) if len(found) else None
                    high.append(None if whole is None else (whole >> 64) - (1 << 63))
                    low.append(None if whole is None else (whole & (1 << 64) - 1) - (1 << 63))
                    key, bit = hasher.keys(found) if len(found) else (None, None)
                    keys.append(key)
                    bits.append(bit)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["sum"], pa.array(counts, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                    ["doc_id", "sum", "n_shingles", "high", "low", "keys", "bits"],
                )

    return docs.transform(common.in_arrow, sign, "doc_id long, sum long, n_shingles long, high long, low long, keys array<long>, bits array<long>")


def _asked(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of ``nodes``; of all other rows, the texts stay where they lie."""
    maybe, _ = common.sifted(rows, F.col("node"), nodes, F.col("node"))
    return maybe.join(nodes, "node", "left_semi").groupBy("node").agg(F.min_by("text", "sum").alias("text"))


def confirmed(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of a written table whose full shingle sets reach the threshold; ``rows`` has node, text and sum."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = _asked(rows, common.written(nodes, "nodes"))
    # Each b is in few pairs, so the first join is even. In the second, a pivot of very many pairs makes a
    # partition of many texts, whose size Spark sees and splits.
    right = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, tuple[str, np.ndarray]] = {}

        def of(side: int, text: str) -> np.ndarray:
            if side not in last or last[side][0] != text:
                last[side] = text, shingles.shingle_set(shingles.word_hashes(text.encode()))
            return last[side][1]

        for batch in batches:
            a, b = [], []
            for at in range(0, batch.num_rows, 512):
                for r in batch.slice(at, 512).to_pylist():
                    x, y = of(0, r["text_a"]), of(1, r["text_b"])
                    small, large = sorted((len(x), len(y)))
                    if 100 * small < percent * large:
                        continue
                    both_ways = np.concatenate((x, y))
                    both_ways.sort(kind="stable")
                    shared = int((both_ways[1:] == both_ways[:-1]).sum())
                    if 100 * shared >= percent * (len(x) + len(y) - shared):
                        a.append(r["a"])
                        b.append(r["b"])
            kind = batch.schema.field("a").type
            yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], ["a", "b"])

    return both.select("a", "b", "text_a", "text_b").transform(common.in_arrow, compare, pairs.select("a", "b").schema)


def _frequencies(texts: DataFrame) -> np.ndarray:
    """How often the shingles of each of ``COUNTERS`` hash slots occur."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for text in batch["text"].to_pylist():
                found = shingles.shingle_set(shingles.word_hashes(text.encode()))
                np.add.at(mine, (found & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
        used = np.flatnonzero(mine)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(mine[used])], ["slot", "n"])

    # At most COUNTERS rows, whatever the input.
    got = texts.transform(common.in_arrow, count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(COUNTERS, np.int64)
    out[got["slot"].to_numpy()] = got["n"].to_numpy()
    return out


def by_rare_shingles(crowd: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components of ``crowd`` (rep, component) that may reach the threshold; none that does is missing.

    All shingles stand in one order, rarest first.  Of a linked pair of sets of
    n <= m shingles, the larger one's first m - ceil(t m) + 1 hold one of the
    smaller one's first n - ceil(2 t n / (1 + t)) + 1, so only sets that meet in
    such a shingle are paired, and of these only pairs whose sizes and places
    leave room for enough common ones.  Texts of one template differ in their
    rarest shingles and hardly ever meet.  A shingle of one component is done;
    one component's sets with a shingle, where they are its most, are never
    paired with each other, so the pairs looked at are at most about twice those
    from different components.
    """
    texts = common.written(_asked(rows, crowd.select(F.col("rep").alias("node"))), "crowd")
    often = crowd.sparkSession.sparkContext.broadcast(_frequencies(texts))
    kind = crowd.schema["rep"].dataType.simpleString()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found: list[list[np.ndarray]] = [[], [], [], [], []]
                for k, text in enumerate(part["text"].to_pylist()):
                    own = shingles.shingle_set(shingles.word_hashes(text.encode()))
                    n = len(own)
                    own = own[np.lexsort((own, often.value[(own & np.uint64(COUNTERS - 1)).astype(np.int64)]))]
                    seen = n - -(-percent * n // 100) + 1
                    kept = n - -(-2 * percent * n // (100 + percent)) + 1
                    for column, values in zip(found, (np.full(seen, k), own[:seen].view(np.int64), np.full(seen, n), np.arange(seen), np.arange(seen) < kept)):
                        column.append(values)
                row, shingle, n, place, kept = map(np.concatenate, found)
                yield pa.RecordBatch.from_arrays([part["node"].take(pa.array(row)), pa.array(shingle), pa.array(n, pa.int32()), pa.array(place, pa.int32()), pa.array(kept)], ["rep", "shingle", "n", "place", "kept"])

    entries = texts.select("node", "text").transform(common.in_arrow, mark, f"rep {kind}, shingle long, n int, place int, kept boolean").join(crowd, "rep")
    entries = common.written(entries, "entries")
    by = entries.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("size"), F.max("kept").alias("kept"))
    met = by.groupBy("shingle").agg(F.max_by("component", F.struct("size", "component")).alias("most"), F.count(F.lit(1)).alias("components"), F.max("kept").alias("some")).where("components > 1 and some").select("shingle", "most")
    live = common.written(entries.join(met, "shingle").withColumn("of_most", F.col("component") == F.col("most")).drop("most"), "live")
    common.dropped(entries, texts)
    side = F.explode(F.when(F.col("of_most"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True))))
    x = live.where("kept").select("shingle", side.alias("of_most"), F.col("rep").alias("a"), F.col("component").alias("c"), F.col("n").alias("n"), F.col("place").alias("i"))
    y = live.select("shingle", "of_most", F.col("rep").alias("b"), F.col("component").alias("d"), F.col("n").alias("m"), F.col("place").alias("j"))
    room = f"(100 + {percent}) * (1 + least(n - i, m - j) - 1) >= {percent} * (n + m)"
    pairs = x.join(y, ["shingle", "of_most"]).where(f"c <> d and (n < m or n = m and a < b) and 100 * n >= {percent} * m and {room}")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, percent: int = THRESHOLD_PERCENT, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    plain = plain.withColumn("sum", F.xxhash64("text"))
    signed = common.written(signatures(plain, bands, rows), "signed")
    own = signed.where("n_shingles > 0 and doc_id is not null")
    several = own.groupBy("doc_id").agg(F.min("sum").alias("least"), F.max("sum").alias("most")).where("least < most").select("doc_id")
    repeating = common.has_rows(several)
    node = F.struct("doc_id", "sum") if repeating else F.col("doc_id")
    own = own.withColumn("node", node)
    # A class's representative; equal word sequences have equal sets, so any row's keys do.
    classes = common.written(
        own.groupBy("high", "low").agg(F.min("node").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("bits").alias("bits")),
        "classes",
    )
    # From here to the pairs, rows are two numbers: there is one for each band of each class.
    banded = classes.select("rep", F.explode("keys").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = common.written(banded.join(buckets, "key"), "members")
    facts = classes.select("rep", "n", "bits")
    words = -(-bands * rows // 64)
    apart_bits = " + ".join(f"bit_count(bits[{k}] ^ others[{k}])" for k in range(words))
    near = f"100 * least(n, m) >= {percent} * greatest(n, m) and {apart_bits} <= {most_bits(bands * rows, percent)}"

    def alike(pairs: DataFrame) -> DataFrame:
        """The pairs whose sizes and signatures don't rule a link out."""
        with_a = pairs.join(facts.withColumnRenamed("rep", "a"), "a")
        with_b = with_a.join(facts.select(F.col("rep").alias("b"), F.col("n").alias("m"), F.col("bits").alias("others")), "b")
        return with_b.where(near).select("a", "b")

    tried = common.written(alike(members.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()), "tried")
    filled = plain.where(F.col("text").rlike(r"[^ \t\n\x0B\f\r]")).withColumn("node", node)
    nodes = own.select("doc_id", "high", "low").distinct().join(classes.select("high", "low", "rep"), ["high", "low"])
    links = confirmed(tried, filled, percent)
    if repeating:
        of_several = nodes.join(several, "doc_id", "left_semi")
        least = of_several.groupBy("doc_id").agg(F.min("rep").alias("b"))
        links = links.unionByName(of_several.select("doc_id", F.col("rep").alias("a")).join(least, "doc_id").where("a <> b").select("a", "b"))
    links = common.written(links, "links")
    first = connected(links)

    placed = members.drop("pivot").join(first.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    placed = common.written(placed, "placed")
    common.dropped(members)
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    apart = common.written(placed.join(mixed, "key", "left_semi"), "apart")
    common.dropped(placed)
    few = apart.where(F.col("size") <= crowd)
    other = few.select("key", F.col("rep").alias("b"), F.col("component").alias("other"))
    across = few.select("key", F.col("rep").alias("a"), "component").join(other, "key").where("component <> other and a < b").select("a", "b").distinct()
    many = common.written(apart.where(F.col("size") > crowd).select("rep", "component").distinct(), "many")
    if common.has_rows(many):
        across = across.unionByName(by_rare_shingles(many, filled, percent)).distinct()
    left = common.written(alike(across.join(tried, ["a", "b"], "left_anti")), "across")
    if common.has_rows(left):
        more = common.written(confirmed(left, filled, percent), "links")
        if common.has_rows(more):
            first = connected(links.unionByName(more))

    found = nodes.join(first.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("c"))
    if repeating:
        found = found.select("doc_id", F.col("c.doc_id").alias("c")).distinct()
    return (
        signed.join(found, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that near_duplicates doesn't keep; the others with all their columns.

    Rows that repeat both id and text count as one document: one of them stays.
    Rows without an id stay.  Other columns may have any names.
    """
    found = common.written(near_duplicates(docs, **options), "groups")
    ids = found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    names, plain = docs.columns, common.numbered(docs)
    doc_id, text = (plain[names.index(c)] for c in ("doc_id", "text"))
    if common.has_rows(ids.where("n > 1")):
        # Rows without an id are no repeats of each other.
        known = plain.where(doc_id.isNotNull()).dropDuplicates([f"c{names.index(c)}" for c in ("doc_id", "text")])
        plain = known.unionByName(plain.where(doc_id.isNull()))
    gone = common.written(found.where("not kept").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    return common.without(plain, doc_id.cast("long"), gone, "gone").toDF(*names)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


#: For small tables: all pairs that share a shingle.
ORACLE = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as l from documents
), s as (
  select distinct doc_id, unnest(case when len(l) > 1 then list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1]) else l end) as shingle from w
), n as (
  select doc_id, count(*) as n from s group by doc_id
), p as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all
), e as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)
), both_ways as (
  select a, b from e union select b, a from e
), r as (
  select doc_id, doc_id as c from documents union select r.doc_id, g.b from r join both_ways g on g.a = r.c
)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept
from (select doc_id, min(c) as component_id from r group by doc_id) left join n using (doc_id)
"""
