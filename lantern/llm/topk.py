"""Exact top-k inner-product search by distributed histogram selection.

Vectors become integer vectors.  Queries and candidates travel in blocks; each
pass scores every candidate for every query and adds up, per query, a histogram
of scores over the range that still holds the k-th best.  The bin with the k-th
becomes the next range, until it is one score wide: that score is exact.  A last
pass keeps scores at or above it, and ties go to smaller ids.

A task sends of a histogram only the bins from the top that hold as many scores
as are still looked for: the k-th best overall is never below the k-th best of
a part.  Blocks have a fixed size and meet on a grid of (query group, candidate
group), so no task or broadcast grows with the tables.

Scores are exact: in doubles where all products of a block allow it, otherwise
modulo 2^64 with a check by bounds, or by whole numbers where these leave it
open, that the true score is a long.

Defined results: vectors that are null or empty, or hold a null, a NaN or an
infinity, and rows without an id, take no part; nor does a pair whose score
isn't a long, which the result can't hold.  A query is scored
against candidates of its own length only.  A vec_id that repeats is one query
(with the least of its vectors); none of its rows are candidates for it, and
each row is a candidate for the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lantern.llm import common

K = 5
QUERY_STEP = 50
BINS = 2048
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 4096
GROUP_BLOCKS = 16
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, dim, vec): floor(256 * x) / 256, a double for any finite x, of the vectors that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(F.coalesce(v, F.lit(0.0))) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & fine)
    # From 2^45 on, a double is a multiple of 1/256 anyway.
    return rows.select("vec_id", F.size("x").alias("dim"), F.transform("x", lambda v: F.when(F.abs(v) < 2.0**45, F.floor(v * 256).cast("double") / 256).otherwise(v)).alias("vec"))


def _blocks(rows: DataFrame, groups: int) -> DataFrame:
    """Candidates in blocks, each dealt to one group; as 32-bit integers (times 256) or, where these don't hold them, doubles."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def out(dim: int) -> pa.RecordBatch:
            ids, values = map(np.concatenate, held.pop(dim))
            if np.abs(values).max() < 1 << 23:
                values = (values * 256).astype("<i4")
            names = ["dim", "cgroup", "ids", "vals"]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([int(ids[0]) % groups], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], names)

        for batch in batches:
            dims, ids = batch["dim"].to_numpy(), batch["vec_id"].to_numpy()
            flat, ends = batch["vec"].flatten().to_numpy(), np.cumsum(dims)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                values = flat[(ends[at] - dim)[:, None] + np.arange(dim)].astype("<f8")
                for k in range(0, len(at), CANDIDATE_BLOCK):
                    kept = held.setdefault(dim, ([], []))
                    kept[0].append(ids[at[k : k + CANDIDATE_BLOCK]].astype("<i8"))
                    kept[1].append(values[k : k + CANDIDATE_BLOCK])
                    if sum(map(len, kept[0])) >= CANDIDATE_BLOCK:
                        yield out(dim)
        for dim in list(held):
            yield out(dim)

    return rows.transform(common.in_arrow, pack, "dim int, cgroup int, ids binary, vals binary")


def _whole(x: float) -> int:
    return int(x * 256) if abs(x) < 2.0**45 else int(x) << 8


def _residues(x: np.ndarray) -> np.ndarray:
    """256 * x modulo 2^64."""
    near = np.abs(x) < 2.0**54
    out = (np.where(near, x, 0.0) * 256).astype(np.int64).view(np.uint64)
    out[~near] = np.array([_whole(v) & (1 << 64) - 1 for v in x[~near].tolist()], np.uint64)
    return out


def _wide_scores(q: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of integers / 256 of any size, and where they are a long."""
    scores = (_residues(q) @ _residues(values).T).view(np.int64)  # right wherever the true score is a long
    with np.errstate(all="ignore"):
        rough = np.abs(q @ values.T) * 65536
        error = (np.abs(q) @ np.abs(values).T) * 65536 * (q.shape[1] + 4) * 2.0**-52
        fits, unsure = rough + error < 2.0**63, ~(rough - error > 2.0**63)
    for i, j in np.argwhere(~fits & unsure).tolist():
        fits[i, j] = LEAST <= sum(_whole(a) * _whole(b) for a, b in zip(q[i].tolist(), values[j].tolist())) <= MOST
    return scores, fits


def _scores(row: dict) -> tuple[np.ndarray, list[dict], np.ndarray, np.ndarray]:
    """Ids of candidates, queries, their scores, and which of these count."""
    queries, dim = row["queries"], row["dim"]
    ids = np.frombuffer(row["ids"], "<i8")
    narrow = len(row["vals"]) == 4 * len(ids) * dim
    values = np.frombuffer(row["vals"], "<i4").reshape(-1, dim) / 256 if narrow else np.frombuffer(row["vals"], "<f8").reshape(-1, dim)
    q = np.array([x["vec"] for x in queries], np.float64).reshape(-1, dim)
    fits = np.array([x["query_id"] for x in queries], np.int64)[:, None] != ids[None, :]
    if float(np.abs(q).max(initial=0)) * float(np.abs(values).max(initial=0)) * dim < 2**37:
        scores = (q @ values.T * 65536).astype(np.int64)  # exact in doubles
    else:
        scores, longs = _wide_scores(q, values)
        fits &= longs
    return ids, queries, scores, fits


def _histogram(bins: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ids, queries, scores, fits = _scores(batch.slice(at, 1).to_pylist()[0])
                out: list[np.ndarray] = []
                for x, mine, live in zip(queries, scores, fits):
                    low, width = x["low"], x["width"]
                    mine = mine[live & (mine >= low) & (mine <= x["high"])]
                    # The distance of two longs needs all 64 bits.
                    above = mine.view(np.uint64) - np.array([low], np.int64).view(np.uint64)
                    counts = np.bincount((above // np.uint64(width)).astype(np.int64), minlength=1)
                    top = np.flatnonzero(counts)[::-1]
                    # Bins below the one that completes the count can't hold the k-th best.
                    top = top[: int(np.searchsorted(np.cumsum(counts[top]), x["need"])) + 1]
                    out.append(np.column_stack((np.full(len(top), x["query_id"]), top, counts[top])))
                rows = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, c]), pa.int64()) for c in range(3)], ["query_id", "bin", "n"])

    return count


def _keepers(k: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ids, queries, scores, fits = _scores(batch.slice(at, 1).to_pylist()[0])
                out: list[list[np.ndarray]] = [[], [], []]
                for x, mine, live in zip(queries, scores, fits):
                    hit = np.flatnonzero(live & (mine >= x["low"]))
                    hit = hit[np.lexsort((ids[hit], ~mine[hit]))[:k]]
                    for column, values in zip(out, (np.full(len(hit), x["query_id"]), ids[hit], mine[hit])):
                        column.append(values)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in out], ["query_id", "vec_id", "score"])

    return keep


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score of each query's ``k`` best candidates.

    Both sides as :func:`quantised` gives them.
    """
    rows = common.written(candidates, "vectors")
    asked = queries.groupBy(F.col("vec_id").alias("query_id"), "dim").agg(F.min("vec").alias("vec"))
    # One vector length for a query, too, where its id repeats with several.
    asked = common.written(asked.groupBy("query_id").agg(F.min(F.struct("dim", "vec")).alias("v")).select("query_id", "v.*"), "queries")
    norms = F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v)
    count, longest = rows.agg(F.count(F.lit(1)), F.max(norms)).first()
    asking, most = asked.agg(F.count(F.lit(1)), F.max(norms)).first()
    reach = (longest or 0.0) ** 0.5 * (most or 0.0) ** 0.5 * 65536 * (1 + 1e-9)
    bound = int(reach) + 2 if reach < 2.0**62 else MOST
    least = -bound if bound < MOST else LEAST
    cgroups = max(1, -(-count // CANDIDATE_BLOCK) // GROUP_BLOCKS, min(12, -(-count // CANDIDATE_BLOCK)))
    blocks = max(1, -(-asking // QUERY_BLOCK))
    qgroups = -(-blocks // GROUP_BLOCKS)
    packed = common.written(_blocks(rows, cgroups), "blocks")
    spread = packed.withColumn("qgroup", F.explode(F.sequence(F.lit(0), F.lit(qgroups - 1))))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    width = widest = max(1, -(-(bound - least + 1) // BINS))
    state = asked.select("query_id", F.lit(least).cast("long").alias("low"), F.lit(bound).cast("long").alias("high"), F.lit(widest).cast("long").alias("width"), F.lit(k).alias("need"))

    def meet(now: DataFrame) -> DataFrame:
        held = asked.join(now, "query_id").groupBy("dim", "block").agg(F.collect_list(F.struct("query_id", "vec", "low", "high", "width", "need")).alias("queries"))
        held = held.withColumn("qgroup", F.col("block") % qgroups).withColumn("cgroup", F.explode(F.sequence(F.lit(0), F.lit(cgroups - 1))))
        return spread.join(held, ["dim", "qgroup", "cgroup"]).select("dim", "ids", "vals", "queries")

    by_query = Window.partitionBy("query_id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    while True:
        counts = meet(state).transform(common.in_arrow, _histogram(BINS), "query_id long, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        reached = counts.withColumn("sum", F.sum("n").over(by_query)).join(state, "query_id").where("sum >= need and sum - n < need")
        step = max(1, -(-width // BINS))
        found = reached.select("query_id", F.expr("cast(low + cast(bin as decimal(20, 0)) * cast(width as decimal(18, 0)) as long)").alias("at"), F.expr("int(need - (sum - n))").alias("left"))
        # A query with fewer candidates than k takes them all; its range stays whole, in bins as wide as at first.
        last = F.expr(f"cast(least(cast(at as decimal(20, 0)) + {width - 1}, cast({bound} as decimal(20, 0))) as long)")
        state = common.written(
            state.join(found, "query_id", "left").select(
                "query_id", F.coalesce("at", F.lit(least)).cast("long").alias("low"), F.coalesce(last, F.lit(bound)).cast("long").alias("high"), F.when(F.col("at").isNull(), F.lit(widest)).otherwise(F.lit(step)).cast("long").alias("width"), F.coalesce("left", F.lit(k)).alias("need")
            ),
            "state",
        )
        if width == 1:
            break
        width = step
    kept = meet(state).transform(common.in_arrow, _keepers(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(common.table(spark, sf_dir, "embeddings"))
    return top_k(rows.where(F.col("vec_id") % QUERY_STEP == 0), rows)


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as query_id, b.vec_id, list_dot_product(a.q, b.q)::bigint as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q)
), r as (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s
)
select * from r where rank <= 5
"""
