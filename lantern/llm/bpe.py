"""Byte-level BPE encoding and decoding with overlapping chunks.

A text is cut into chunks of ``chunk_chars`` characters that overlap by
``overlap``; one of a single chunk is encoded in the task that reads it.  Longer
texts' chunks are spread over tasks:

1. Every chunk is pre-tokenised on its own, from a start that need not be a true
   boundary.  The pre-tokeniser has no memory besides its position, so the first
   place in an overlap where the boundaries of both chunks agree is one where
   they have resynchronised, and all later boundaries agree too.  (Places after
   blanks are passed over: how blanks are split depends on what follows them.)
2. Texts are cut at these places.  Each piece is a row of its own and pieces are
   encoded in parallel, wherever their chunk lies; only ids come back together,
   in order, for the digests.
3. An overlap without such a place (one endless word or run of blanks) joins its
   two chunks in one piece, and chunking resumes at the next overlap.  There the
   chunks may agree with each other though neither has met the true boundaries,
   so a joined piece's end is verified by pre-tokenising it from its true start;
   should that fail, the text is encoded as one.  The result never depends on
   the chunking.

Defined results: a null text counts as empty; an empty text has no ids; equal
rows give equal results, and repeated doc_id rows each give a row of their own;
columns other than the two that are named are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lantern.llm import common

CHUNK_CHARS = 1 << 14
OVERLAP = 1 << 10
SLICE_TEXTS = 256
#: Characters at a chunk's end whose boundaries may change with the text after them.
_EDGE = 2


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token bytes, of a rank file or of a tokenizer's JSON file."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        back = {c: b for b, c in _byte_alphabet().items()}
        return {bytes(back[c] for c in token): i for token, i in vocab.items() if all(c in back for c in token) and token != "<|endoftext|>"}
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def read_added(path: str) -> list[dict]:
    """The added tokens of a tokenizer's JSON file; a rank file has none."""
    if not path.endswith(".json"):
        return []
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens", [])
    if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that match other than literally are not read")
    return added


def _byte_alphabet() -> dict[int, str]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(spare)
            spare += 1
    return table


class Codec:
    """Encodes and decodes with one vocabulary; built once in each worker."""

    _kept: dict[str, Codec] = {}

    def __init__(self, path: str):
        import regex
        import tiktoken

        self.ranks = read_ranks(path)
        self.added = {t["content"]: t["id"] for t in read_added(path)}
        self.engine = tiktoken.Encoding("lantern", pat_str=pattern(), mergeable_ranks=self.ranks, special_tokens=self.added)
        # The longest of those that begin at one place, as in the tokenizers library.
        self.literals = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.splitter = regex.compile(pattern())

    @classmethod
    def at(cls, path: str) -> Codec:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def ids(self, text: str):
        """Token ids as little-endian unsigned 32-bit integers."""
        if not text:
            return np.zeros(0, "<u4")
        try:
            return self.engine.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        except ValueError:  # the native splitter's limit on one endless run
            found: list[int] = []
            for m in self.splitter.finditer(text):
                found.extend(self.engine._encode_single_piece(m.group(0).encode()))
            return np.array(found, "<u4")

    def ids_with_added(self, text: str):
        """As :meth:`ids`, but an added token's literal is its id, and the texts between are encoded each on its own."""
        found = list(self.literals.finditer(text)) if self.literals and text else []
        if not found:
            return self.ids(text)
        parts, at = [], 0
        for m in found:
            parts += [self.ids(text[at : m.start()]), np.array([self.added[m.group()]], "<u4")]
            at = m.end()
        return np.concatenate([*parts, self.ids(text[at:])])

    def decode(self, ids) -> bytes:
        return self.engine.decode_bytes(ids.tolist())

    def starts(self, text: str, base: int) -> list[int]:
        return [base + m.start() for m in self.splitter.finditer(text)]


def _digest(codec: Codec, ids) -> tuple[int, str, str]:
    raw = codec.decode(ids)
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest()


DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Ids of every text and digests of ids and of the decoded bytes.

    Returns id_col, n_tokens, ids_sha256, decoded_sha256 and, with
    ``keep_ids``, ids (binary, little-endian unsigned 32-bit).
    """
    path = path or common.tokenizer_path("byte_bpe_50k.tiktoken")
    rows = docs.select(F.col(common.quoted(id_col)).alias("id"), F.coalesce(F.col(common.quoted(text_col)).cast("string"), F.lit("")).alias("text"))
    more = ", ids binary" if keep_ids else ""
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, {DIGEST}{more}"

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.at(path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_TEXTS):
                part = batch.slice(at, SLICE_TEXTS)
                out: list[list] = [[], [], [], []]
                for text in part["text"].to_pylist():
                    ids = codec.ids(text)
                    for column, value in zip(out, (*_digest(codec, ids), ids.tobytes() if keep_ids else b"")):
                        column.append(value)
                yield _batch(part["id"], out, keep_ids)

    long_rows = rows.where(F.length("text") > chunk_chars)
    done = rows.where(F.length("text") <= chunk_chars).transform(common.in_arrow, short, schema)
    return done.unionByName(_encode_long(long_rows, path, schema, keep_ids, chunk_chars, overlap)).withColumnRenamed("id", id_col)


def _batch(ids: pa.Array, out: list[list], keep_ids: bool) -> pa.RecordBatch:
    columns = [ids, pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
    if keep_ids:
        columns.append(pa.array(out[3], pa.binary()))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names)


def _chunks(rows: DataFrame, path: str, size: int, overlap: int) -> DataFrame:
    """(row, id, chunk, text, head, tail): chunks and the boundaries in their overlaps."""
    kind = rows.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch["text"].to_pylist()):
                n = -(-len(text) // size)
                for low in range(0, n, 64):
                    chunk = range(low, min(n, low + 64))
                    pick = pa.array([k] * len(chunk))
                    yield pa.RecordBatch.from_arrays([batch["row"].take(pick), batch["id"].take(pick), pa.array(chunk, pa.int32()), pa.array([text[c * size : c * size + size + overlap] for c in chunk])], ["row", "id", "chunk", "text"])

    def boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.at(path)
        for batch in batches:
            heads, tails = [], []
            for k, text in zip(batch["chunk"].to_pylist(), batch["text"].to_pylist()):
                base = k * size
                inner = [x for x in codec.starts(text, base) if x <= base + len(text) - _EDGE]
                # A piece must be split alike without what follows it, and blanks at its end would not be.
                tail = [x for x in inner if x >= base + size and not text[x - 1 - base].isspace()]
                heads.append([x for x in inner if x < base + overlap])
                # A boundary is settled only where the token before it can't grow: the last one of a cut text isn't.
                tails.append([x for x in tail if x < inner[-1]] if len(text) == size + overlap else tail)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], [*batch.schema.names, "head", "tail"])

    plain = f"row long, id {kind}, chunk int, text string"
    spread = rows.withColumn("row", F.monotonically_increasing_id()).transform(common.in_arrow, cut, plain).repartition("row", "chunk")
    return spread.transform(common.in_arrow, boundaries, plain + ", head array<long>, tail array<long>")


def _pieces(chunks: DataFrame, size: int) -> DataFrame:
    """Adds to each chunk its piece, how many chunks that has, and which characters of the chunk are the piece's."""
    by_row = Window.partitionBy("row").orderBy("chunk")
    # Boundaries alone are brought together by text; the chunks' texts stay.
    met = chunks.select("row", "chunk", "head", "tail").withColumn("next", F.lead("head").over(by_row))
    stops = met.select("row", "chunk", F.col("next").isNull().alias("last"), F.array_min(F.array_intersect("tail", "next")).alias("stop"))
    before = by_row.rowsBetween(Window.unboundedPreceding, -1)
    placed = stops.select("row", "chunk", "last", "stop", F.coalesce(F.count("stop").over(before), F.lit(0)).alias("piece"), F.coalesce(F.max("stop").over(before), F.lit(0)).alias("start"))
    placed = placed.withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("row", "piece")))
    base = F.col("chunk") * F.lit(size).cast("long")
    low = F.greatest("start", base) - base
    high = F.when(F.col("last"), F.lit(None)).otherwise(F.coalesce("stop", base + size) - base)
    return chunks.drop("head", "tail").join(placed.select("row", "chunk", "piece", "of", low.cast("int").alias("low"), high.cast("int").alias("high")), ["row", "chunk"])


def _encode_long(rows: DataFrame, path: str, schema: str, keep_ids: bool, size: int, overlap: int) -> DataFrame:
    """The chunked way: pre-tokenise, stitch, encode the pieces, concatenate."""
    kind = rows.schema["id"].dataType.simpleString()
    pieces = common.written(_pieces(common.written(_chunks(rows, path, size, overlap), "chunks"), size), "text-pieces")
    shape = f"row long, id {kind}, piece long, good boolean, ids binary"

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.at(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids = [codec.ids(t[a:b]).tobytes() for t, a, b in zip(*(part[c].to_pylist() for c in ("text", "low", "high")))]
                yield pa.RecordBatch.from_arrays([part["row"], part["id"], part["piece"], pa.array([True] * len(ids)), pa.array(ids, pa.binary())], ["row", "id", "piece", "good", "ids"])

    def united(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        # As many chunks as one run without a common boundary covers.
        codec, got = Codec.at(path), table.sort_by("chunk").to_pylist()
        text, ahead, end = "".join(x["text"][x["low"] : x["high"]] for x in got), "", got[-1]["high"]
        if end is not None:
            ahead = got[-1]["text"][end:]
        good = not ahead or any(m.start() == len(text) for m in codec.splitter.finditer(text + ahead))
        return pa.table([pa.array([x], t) for x, t in ((got[0]["row"], pa.int64()), (got[0]["id"], table.schema.field("id").type), (got[0]["piece"], pa.int64()), (good, pa.bool_()), (codec.ids(text).tobytes(), pa.binary()))], ["row", "id", "piece", "good", "ids"])

    single = pieces.where("of = 1").transform(common.in_arrow, alone, shape)
    several = common.written(pieces.where("of > 1").groupBy("row", "piece").applyInArrow(united, shape), "joined-pieces")
    encoded = single.unionByName(several)
    bad = several.where("not good").select("row").distinct()
    if common.has_rows(bad):
        whole = pieces.join(bad, "row").withColumn("high", F.when(F.col("chunk") == F.max("chunk").over(Window.partitionBy("row")), F.lit(None)).otherwise(F.lit(size)).cast("int"))
        whole = whole.withColumn("low", F.lit(0)).withColumn("piece", F.lit(0).cast("long"))
        encoded = encoded.join(bad, "row", "left_anti").unionByName(whole.groupBy("row", "piece").applyInArrow(united, shape))

    def gathered(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        # One text's ids: about as large as the text, which one row holds anyway.
        codec, n, ids_sum, raw_sum, kept = Codec.at(path), 0, hashlib.sha256(), hashlib.sha256(), []
        got = table.sort_by("piece")
        for raw in got["ids"].to_pylist():
            ids = np.frombuffer(raw, "<u4")
            n += len(ids)
            ids_sum.update(raw)
            raw_sum.update(codec.decode(ids))
            if keep_ids:
                kept.append(raw)
        return pa.Table.from_batches([_batch(got["id"].combine_chunks().slice(0, 1), [[n], [ids_sum.hexdigest()], [raw_sum.hexdigest()], [b"".join(kept)]], keep_ids)])

    return encoded.drop("good").groupBy("row").applyInArrow(gathered, schema)


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """id_col and the bytes that ``ids`` stand for; a null ids counts as empty."""
    path = path or common.tokenizer_path("byte_bpe_50k.tiktoken")

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.at(path)
        for batch in batches:
            raw = [codec.decode(np.frombuffer(x or b"", "<u4")) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(raw, pa.binary())], ["id", "raw"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), "ids").transform(common.in_arrow, back, f"id {kind}, raw binary").withColumnRenamed("id", id_col)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(common.table(spark, sf_dir, "documents"))
