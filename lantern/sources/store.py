"""Stored segments: Parquet tables in a folder each, named by one manifest.

Manifests are numbered; each is written under another name and renamed to its
number, which no manifest had before, and the highest number counts.  A reader
thus sees the old state or the new one, and a crash at any point leaves one of
them, also on file systems where a rename doesn't replace.  Two writers that
take the same number don't overwrite each other: the second one fails.  Paths
are Hadoop paths: local, HDFS or an object store.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lantern.util import format_size

MANIFEST = re.compile(r"manifest-(\d+)\.json")


class SegmentStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, str(path).rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def initialize(self) -> None:
        self._fs.mkdirs(self._path(f"{self.path}/segments"))

    def _numbers(self) -> list[int]:
        here = self._path(self.path)
        names = [f.getPath().getName() for f in self._fs.listStatus(here)] if self._fs.exists(here) else []
        return sorted(int(m.group(1)) for m in map(MANIFEST.fullmatch, names) if m)

    def _place(self, number: int):
        return self._path(f"{self.path}/manifest-{number}.json")

    def exists(self) -> bool:
        return bool(self._numbers())

    def manifest(self) -> dict:
        numbers = self._numbers()
        if not numbers:
            return {"segments": []}
        stream = self._fs.open(self._place(numbers[-1]))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        manifest = {"created": time.time(), **manifest, "updated": time.time()}
        fresh = self._path(f"{self.path}/.{uuid.uuid4().hex}")
        stream = self._fs.create(fresh, True)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        numbers = self._numbers()
        number = numbers[-1] + 1 if numbers else 1
        if self._fs.exists(self._place(number)) or not self._fs.rename(fresh, self._place(number)):
            self._fs.delete(fresh, False)
            raise OSError(f"manifest {number} was written by another")
        for old in numbers[:-1]:  # the one before stays for readers that are about to open it
            self._fs.delete(self._place(old), False)

    def save_segment(self, tables: dict[str, DataFrame], segment_id: str | None = None, facts: dict | None = None, layout: dict[str, Callable] | None = None, replace: bool = False) -> str:
        """Write tables as one segment and publish it; ``replace`` drops all others after."""
        self.initialize()
        if segment_id and any(x["id"] == segment_id for x in self.list_segments()):
            raise ValueError(f"segment {segment_id} is published; segments don't change")
        segment_id = segment_id or f"seg_{int(time.time() * 1000)}_{uuid.uuid4().hex[:6]}"
        for name, df in tables.items():
            writer = (layout or {}).get(name, lambda d: d.write)(df)
            writer.mode("overwrite").parquet(f"{self.path}/segments/{segment_id}/{name}")
        before = self.manifest()
        entry = {"id": segment_id, "timestamp": time.time(), "tables": sorted(tables), "facts": facts or {}}
        self._publish(before | {"segments": [*([] if replace else before["segments"]), entry]})
        if replace:
            for s in before["segments"]:
                self._fs.delete(self._path(f"{self.path}/segments/{s['id']}"), True)
        return segment_id

    def compact(self, tables: dict[str, DataFrame], **options) -> str:
        return self.save_segment(tables, f"compact_{int(time.time() * 1000)}_{uuid.uuid4().hex[:6]}", replace=True, **options)

    def list_segments(self) -> list[dict]:
        return self.manifest()["segments"]

    def load_segment(self, segment_id: str, shapes: dict[str, str] | None = None) -> dict[str, DataFrame] | None:
        """The tables of a segment; of those in ``shapes``, with that schema, which an empty table's folder doesn't tell."""
        entry = next((s for s in self.list_segments() if s["id"] == segment_id), None)
        if entry is None:
            return None
        reader = lambda t: self.spark.read.schema(shapes[t]) if shapes and t in shapes else self.spark.read
        return {t: reader(t).parquet(f"{self.path}/segments/{segment_id}/{t}") for t in entry["tables"]}

    def load_latest(self) -> tuple[dict[str, DataFrame], dict] | None:
        segments = self.list_segments()
        return (self.load_segment(segments[-1]["id"]), segments[-1]["facts"]) if segments else None

    def delete_segment(self, segment_id: str) -> bool:
        manifest = self.manifest()
        kept = [s for s in manifest["segments"] if s["id"] != segment_id]
        if len(kept) == len(manifest["segments"]):
            return False
        self._publish(manifest | {"segments": kept})
        self._fs.delete(self._path(f"{self.path}/segments/{segment_id}"), True)
        return True

    def index_size_bytes(self) -> int:
        here = self._path(self.path)
        return int(self._fs.getContentSummary(here).getLength()) if self._fs.exists(here) else 0

    def index_size_human(self) -> str:
        return format_size(self.index_size_bytes())
