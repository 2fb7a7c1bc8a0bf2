"""Language identification by nearest centroid.

A text becomes a vector of hashed byte n-grams (one, two and three bytes of
lower-cased letters, blanks between words), weighted by 1 + log tf and idf
and normalised.  Each language has several centroids, found by spherical
k-means; the prediction is the language of the nearest one by cosine.  A text
farther from every centroid than its language's calibrated distance is marked
as rejected.

The model is fitted on at most ``sample`` labelled rows of a language (those of
least hash of the id, so the same ones at any size and in any order); texts are
predicted whole.

Defined results: a null text, or one without a letter, is ``und`` with score 0
and rejected; rows that repeat get equal rows; with no labelled row at all,
every text is ``und``; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lantern.llm import common

UNKNOWN = "und"
DIMENSIONS = 1 << 12
CENTROIDS = 4
SAMPLE = 600
#: A text is rejected below this part of the least usual cosine of its language.
REJECT = 0.55
FULL_LETTERS = 400

_M = np.uint32


def held_out(doc_id: str = "doc_id") -> F.Column:
    """The fourth of ids that no model here learns from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows for each value of ``key``, by least hash of doc_id."""
    order = Window.partitionBy(key).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")


def counts(texts: list[str], dimensions: int) -> np.ndarray:
    """Term frequencies of hashed byte n-grams, a row for each text; dimensions: a power of two."""
    out, bits = np.zeros((len(texts), dimensions), np.float32), dimensions.bit_length() - 1
    for k, text in enumerate(texts):
        raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), np.uint8)
        # Digits and signs say little of a language; they count as blanks.
        raw = _LETTER[raw].astype(np.uint32)
        two = raw[:-1] * _M(0x01000193) ^ raw[1:]
        three = two[:-1] * _M(0x01000193) ^ raw[2:]
        h = np.concatenate((raw, two, three))
        h *= _M(0x9E3779B1)
        h >>= _M(32 - bits)
        out[k] = np.bincount(h, minlength=dimensions)
    return out


_LETTER = np.arange(256, dtype=np.uint8)
_LETTER[:128] = [b if chr(b).isalpha() else 32 for b in range(128)]


def weighted(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(tf) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.maximum(norm, 1e-12)


def _spherical(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means by cosine; starts from spread-out rows, no chance involved."""
    centres = [x.mean(axis=0)]
    while len(centres) < min(k, len(x)):
        near = np.max(x @ np.array(centres).T, axis=1)
        centres.append(x[int(np.argmin(near))])
    c = np.array(centres)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = np.argmax(x @ c.T, axis=1)
        c = np.array([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def fit(labelled: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS, dimensions: int = DIMENSIONS) -> dict:
    """A model from (doc_id, text, lang) rows; a bounded number reaches the driver."""
    usable = labelled.where("lang is not null and text is not null")
    # Ids first: the texts of the sample alone are read in the second scan.
    chosen = common.written(bounded_sample(usable.select("doc_id", "lang"), "lang", sample).select("doc_id").distinct(), "sample")
    rows = bounded_sample(usable.join(chosen, "doc_id", "left_semi"), "lang", sample).select("doc_id", "lang", "text")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                text = batch["text"][at].as_py()
                if not any(map(str.isalpha, text)):
                    continue
                tf = counts([text], dimensions)[0]
                place = np.flatnonzero(tf)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(at, 1), batch["lang"].slice(at, 1), pa.array([place.astype("<i4").tobytes()]), pa.array([tf[place].astype("<f4").tobytes()])],
                    ["doc_id", "lang", "place", "tf"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    held = common.written(rows.transform(common.in_arrow, sparse, f"doc_id {kind}, lang string, place binary, tf binary"), "sparse")

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, own = 0, np.zeros(dimensions, np.int64)
        for batch in batches:
            n += batch.num_rows
            for raw in batch["place"].to_pylist():
                own[np.frombuffer(raw, "<i4")] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dimensions)), pa.array(np.append(n, own))], ["slot", "n"])

    # As many rows as there are dimensions; slot -1 counts texts.
    counted = held.transform(common.in_arrow, present, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(dimensions + 1, np.int64)
    for r in counted:
        seen[r.slot] = r.n
    idf = (np.log((1 + seen[-1]) / (1 + seen[:-1])) + 0.05).astype(np.float32)

    def cluster(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        # At most ``sample`` rows.
        got = sorted(table.to_pylist(), key=lambda r: (str(r["doc_id"]), r["place"], r["tf"]))
        tf = np.zeros((len(got), dimensions), np.float32)
        for k, r in enumerate(got):
            tf[k, np.frombuffer(r["place"], "<i4")] = np.frombuffer(r["tf"], "<f4")
        x = weighted(tf, idf)
        centres = _spherical(x, centroids).astype(np.float32)
        near = float(np.quantile((x @ centres.T).max(axis=1), 0.02))
        return pa.table({"lang": [key[0].as_py()] * len(centres), "k": pa.array(range(len(centres)), pa.int32()), "centre": [c.tobytes() for c in centres], "near": [near] * len(centres)})

    # A language is a few centroids of fixed size; its texts stay with the executors.
    got = sorted(held.groupBy("lang").applyInArrow(cluster, "lang string, k int, centre binary, near double").collect(), key=lambda r: (r.lang, r.k))
    langs = sorted({r.lang for r in got})
    centres = np.array([np.frombuffer(r.centre, "<f4") for r in got], np.float32).reshape(-1, dimensions)
    nearest = {r.lang: r.near for r in got}
    return {"langs": langs, "idf": idf, "centres": centres, "of": np.array([langs.index(r.lang) for r in got], int), "least": np.array([nearest[n] for n in langs]) * REJECT}


def predict(texts: list[str | None], model: dict) -> list[tuple[str, float, bool]]:
    out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, True)] * len(texts)
    live = [k for k, t in enumerate(texts) if t and model["langs"] and any(map(str.isalpha, t))]
    if live:
        cosine = weighted(counts([texts[k] for k in live], len(model["idf"])), model["idf"]) @ model["centres"].T
        best = np.argmax(cosine, axis=1)
        for k, b, c in zip(live, best, cosine[np.arange(len(best)), best]):
            own = int(model["of"][b])
            out[k] = model["langs"][own], float(min(max(c, 0.0), 1.0)), bool(c < model["least"][own] * min(1.0, (len(texts[k]) / FULL_LETTERS) ** 0.5))
    return out


def identified(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with lang_pred, score and rejected added (replacing such names)."""
    kept = docs.drop("lang_pred", "score", "rejected")
    held = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by the parameters
    place, names = kept.columns.index("text"), ["lang_pred", "score", "rejected"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            got = predict(part.column(place).to_pylist(), held.value)
            more = [pa.array([g[c] for g in got], t) for c, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, *names])

    return common.kept_columns(kept, run, tuple(T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()))))


def accepted(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with all their columns and no more."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            yield part.filter(pa.array([not rejected for _, _, rejected in predict(part.column(place).to_pylist(), held.value)], pa.bool_()))

    return common.kept_columns(docs, run)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield batch.slice(at, 256)


def learnable(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out()).select("doc_id", "text", "lang")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = identified(docs.select("doc_id", "text"), fit(learnable(docs)))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
