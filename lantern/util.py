"""Small driver-side helpers."""

from __future__ import annotations

import functools
import sys
import time

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession | None) -> None:
    """Sends rows that may hold long texts to Python by 1,000, where the session has Spark's default of 10,000."""
    if spark is not None and spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "1000")


def format_size(n: float) -> str:
    """Bytes with one decimal in B, KB, MB, GB or TB (base 1024)."""
    units = ("B", "KB", "MB", "GB", "TB")
    power = 0
    while n >= 1024 and power < len(units) - 1:
        n, power = n / 1024, power + 1
    return f"{n:.1f} {units[power]}"


def format_size_column(c: Column) -> Column:
    """The same of a column of whole bytes."""
    units, out = ("B", "KB", "MB", "GB", "TB"), None
    for power in reversed(range(len(units))):
        # Ties go to the even digit, as in Python; quotients by powers of two are exact.
        text = F.concat(F.format_string("%.1f", F.bround(c / float(1 << 10 * power), 1)), F.lit(f" {units[power]}"))
        out = F.when(c >= (1 << 10 * power if power else -1), text) if out is None else out.when(c >= (1 << 10 * power if power else -1), text)
    return out


def deep_size(value, seen: set[int] | None = None) -> int:
    """Bytes of a Python object and all it holds, each counted once."""
    seen = set() if seen is None else seen
    if id(value) in seen:
        return 0
    seen.add(id(value))
    inner = [*value.keys(), *value.values()] if isinstance(value, dict) else value if isinstance(value, (list, tuple, set, frozenset)) else []
    more = [value.__dict__] if hasattr(value, "__dict__") else []
    return sys.getsizeof(value) + sum(deep_size(v, seen) for v in (*inner, *more))


class Timer:
    """``with Timer() as t: ...`` leaves seconds and milliseconds in ``t``."""

    def __enter__(self) -> Timer:
        self.began = time.perf_counter()
        self.seconds = 0.0
        return self

    def __exit__(self, *_) -> None:
        self.seconds = time.perf_counter() - self.began

    @property
    def elapsed_ms(self) -> float:
        return self.seconds * 1000


def timed(f):
    """A decorator that prints how long each call took."""

    @functools.wraps(f)
    def wrapped(*args, **kwargs):
        with Timer() as t:
            result = f(*args, **kwargs)
        print(f"{f.__name__}: {t.elapsed_ms:.2f} ms")
        return result

    return wrapped


def truncate(text: str, n: int = 100) -> str:
    return text if len(text) <= n else text[: n - 3] + "..."


def truncate_column(c: Column, n: int = 100) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)
