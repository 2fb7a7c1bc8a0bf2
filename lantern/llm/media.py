"""Media columns: texts stored as FLAC, read back as seekable PCM blocks.

A text's UTF-8 bytes, padded with 255 to a positive multiple of 576, are 8-bit
samples; ``flac`` encodes and decodes them.  Streams are columns of bytes, PCM
comes back in blocks that carry their sample offset, and any block can be read
alone through the seek table.  The query writes the PCM blocks as a table and
takes its digests from what it reads back.

Defined results: a null text counts as empty (one block of padding); equal
texts give equal streams; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.llm import common, flac

#: Payload bytes that are encoded at once; one larger text is a group of its own.
GROUP_BYTES = 1 << 22


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % flac.BLOCK if raw else flac.BLOCK)


class Feature:
    """Level, peak and zero crossings of the samples around their middle, block by block."""

    def __init__(self):
        self.n = self.energy = self.peak = self.crossings = 0
        self.last: bool | None = None

    def update(self, samples: np.ndarray) -> None:
        x = samples.astype(np.int64) - 128
        below = x < 0
        self.n += len(x)
        self.energy += int((x * x).sum())
        self.peak = max(self.peak, int(np.abs(x).max(initial=0)))
        self.crossings += int((below[1:] != below[:-1]).sum()) + (self.last is not None and bool(below[0]) != self.last)
        self.last = bool(below[-1])

    def __str__(self) -> str:
        return f"n={self.n};energy={self.energy};peak={self.peak};crossings={self.crossings}"


def feature(samples: np.ndarray) -> str:
    out = Feature()
    if len(samples):
        out.update(samples)
    return str(out)


def _groups(items: list[bytes]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for k, p in enumerate(items):
        if k > start and size + len(p) > GROUP_BYTES:
            yield start, k
            start, size = k, 0
        size += len(p)
    if start < len(items):
        yield start, len(items)


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the stream (binary) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part["text"].to_pylist()
                whole = [payload(t) for t in texts]
                for a, b in _groups(whole):
                    sizes = [len((t or "").encode()) for t in texts[a:b]]
                    yield pa.RecordBatch.from_arrays([part["doc_id"].slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(flac.encode(whole[a:b]), pa.binary())], ["doc_id", "n_bytes", "media"])

    return _plain(docs).transform(common.in_arrow, run, "doc_id long, n_bytes long, media binary")


PCM = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, blocks array<struct<sample_offset: long, pcm: binary>>"


def pcm(media: DataFrame) -> DataFrame:
    """Each stream read back as an array of PCM blocks (unsigned bytes) with their sample offsets, and facts of the stream.

    Streams are decoded in bounded parts, however long; a row is about as large
    as its text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                streams, blocks, offsets, ends = part["media"].to_pylist(), [], [], [0]
                for k, sample, samples, done in flac.decoded(streams):
                    raw = samples.tobytes()
                    blocks += [raw[j : j + flac.BLOCK] for j in range(0, len(raw), flac.BLOCK)]
                    offsets.append(np.arange(sample, sample + len(raw), flac.BLOCK))
                    if done:
                        ends.append(len(blocks))
                pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(offsets)), pa.array(blocks, pa.binary())], ["sample_offset", "pcm"])
                columns = [part["doc_id"], part["n_bytes"], pa.array([len(s) for s in streams], pa.int64()), pa.array([hashlib.sha256(s).hexdigest() for s in streams]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "media_bytes", "media_sha256", "blocks"])

    return media.select("doc_id", "n_bytes", "media").transform(common.in_arrow, run, PCM)


def pcm_blocks(media: DataFrame) -> DataFrame:
    """doc_id, block, sample_offset and pcm of all streams, a row for each block."""
    return pcm(media).select("doc_id", F.explode("blocks").alias("b")).select("doc_id", F.expr(f"b.sample_offset div {flac.BLOCK}").alias("block"), "b.sample_offset", "b.pcm")


def digests(rows: DataFrame) -> DataFrame:
    """Digests of the stored bytes and of the payload in rows of :func:`pcm`."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                flat, sizes = part["blocks"].flatten(), pc.list_value_length(part["blocks"]).to_pylist()
                blocks, offsets, low, out = flat.field("pcm").to_pylist(), flat.field("sample_offset").to_numpy(), 0, []
                for n in sizes:
                    own, low = slice(low, low + n), low + n
                    if not np.array_equal(offsets[own], np.arange(n) * flac.BLOCK):
                        raise flac.FlacError("a block out of its place")
                    raw, told = b"".join(blocks[own]), Feature()
                    for k in range(0, len(raw), 1 << 20):
                        told.update(np.frombuffer(raw[k : k + (1 << 20)], np.uint8))
                    out.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), str(told)))
                size, sums, tails, features = (pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int64(), pa.string())))
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["n_bytes"], size, sums, tails, part["media_bytes"], part["media_sha256"], features], names)

    return rows.transform(common.in_arrow, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op6_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.written(pcm(stored(common.table(spark, sf_dir, "documents"))), "pcm"))
