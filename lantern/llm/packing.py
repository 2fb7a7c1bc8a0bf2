"""Bounded-space online best-fit packing of token sequences.

Documents are tokenised where they are read and cut into pieces only where they
exceed a sequence.  Pieces then arrive, in an order that their hashes mix, at
an online best-fit packer with a fixed number of open bins: a bitset keyed by
free space finds the fullest bin that still fits in one machine operation, and
when a new bin would exceed the bound, the fullest open one is closed.  Arrivals
wait in a window of as many pieces as bins may be open and go in longest first:
a window can't open more bins than that, so its long pieces' bins are still open
when its short ones come.  (Longest first over a whole task would open and close
bins long before anything fits what they have left.)  Only piece lengths move
between tasks, never texts; each packing task takes at most about
``pieces_per_task`` pieces, so its memory and time don't grow with the corpus.

Defined results: a null text counts as empty and, as every document, still has
its end token; documents that repeat a doc_id are packed each on their own, in
an order fixed by their contents; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.llm import common
from lantern.llm.bpe import Codec

MAX_TOKENS = 2048
OPEN_BINS = 1024
PIECES_PER_TASK = 1 << 20
END_ID = 0
SLICE_TEXTS = 256

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str | None = None, max_tokens: int = MAX_TOKENS, keep_ids: bool = False, encode_special_tokens: bool = False) -> DataFrame:
    """Token pieces of every document; only longer documents are cut.

    The first piece of a cut document takes the remainder, the others are full.
    ``encode_special_tokens`` is the tokenizers library's property of that name:
    where it is false (the library's default), the literal of an added token of
    the JSON file becomes that token's id, otherwise it is text like any other.
    """
    path = path or common.tokenizer_path("byte_bpe_50k.json")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        codec, end = Codec.at(path), np.array([END_ID], "<u4")
        encoded = codec.ids if encode_special_tokens else codec.ids_with_added
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_TEXTS):
                part = batch.slice(at, SLICE_TEXTS)
                out: list[list] = [[] for _ in names]
                for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
                    ids = np.concatenate((encoded(text), end))
                    start, k = 0, 0
                    while start < len(ids):
                        stop = min(start + ((len(ids) - start) % max_tokens or max_tokens), len(ids))
                        raw = ids[start:stop].tobytes()
                        for column, value in zip(out, (doc_id, k, start, stop - start, zlib.crc32(raw), raw)):
                            column.append(value)
                        start, k = stop, k + 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.transform(common.in_arrow, cut, PIECES + ", ids binary" * keep_ids)


class Packer:
    """Online best-fit over ``open_bins`` bins of ``capacity``."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit = capacity, open_bins
        self.free = 0  # bit f is set if an open bin has f free
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.next = 0

    def place(self, length: int) -> tuple[int, int]:
        """The bin's number and the offset in it."""
        fits = self.free >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            number = self._take(room)
        else:
            room, number = self.capacity, self.next
            self.next += 1
            if length < room and self.open == self.limit:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
        left = room - length
        if left:
            if not self.bins[left]:
                self.free |= 1 << left
            self.bins[left].append(number)
            self.open += 1
        return number, self.capacity - room

    def place_all(self, lengths: list[int]) -> list[tuple[int, int]]:
        """Places of a window's pieces, which go in longest first."""
        out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
        for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
            out[k] = self.place(lengths[k])
        return out

    def _take(self, room: int) -> int:
        held = self.bins[room]
        number = held.pop()
        if not held:
            self.free &= ~(1 << room)
        self.open -= 1
        return number


def _windows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows in windows of ``size``, however they are batched."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        while rows >= size:
            table = pa.Table.from_batches(held)
            yield table.slice(0, size).combine_chunks().to_batches()[0]
            held, rows = table.slice(size).to_batches(), rows - size
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def pack(parts: DataFrame, max_tokens: int = MAX_TOKENS, open_bins: int = OPEN_BINS, pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Adds sequence_id and offset to a stored table of pieces."""
    tasks = max(1, -(-parts.count() // pieces_per_task))
    fields = parts.columns

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, task = Packer(max_tokens, open_bins), None
        for window in _windows(batches, open_bins):
            task = window["task"][0].as_py() if task is None else task
            placed = packer.place_all(window["length"].to_pylist())
            columns = [window[c] for c in fields]
            columns += [pa.array([(task << 40) + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*fields, "sequence_id", "offset"])

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema.fields)
    # Dealt and ordered by two hashes: every task, and every window of one, sees the same mix.
    dealt = parts.withColumn("task", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(tasks)).cast("long"))
    # A range by the task's number keeps each number in one partition of its own.
    ordered = dealt.repartitionByRange(tasks, "task") if tasks > 1 else dealt.repartition(1)
    ordered = ordered.sortWithinPartitions("task", F.xxhash64("ids_crc32", "doc_id", "piece"), "doc_id", "piece", "start", "ids_crc32")
    return ordered.transform(common.in_arrow, fill, f"{shape}, sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.written(pieces(common.table(spark, sf_dir, "documents")), "pieces"))
