"""Stage outputs written once as Parquet tables and read back.

The reference writes each stage (star schema, clean tables, features) to a
file that later stages and the served queries read.  Here a stage output is
written under the shared folder named by ``spark.checkpoint.dir`` (set by the
cluster; tests fall back to a temp folder), which

* cuts the lineage: later plans start from a Parquet scan, so a lost
  executor recomputes from that table, not from the raw join;
* gives later stages column pruning, filter pushdown and real size
  statistics (which AQE uses to choose broadcast vs. shuffle joins);
* is done once per session and input, then shared by every query.

Set ``LEDGERLIGHT_MATERIALIZE=0`` to keep everything as one lazy plan.
"""

from __future__ import annotations

import hashlib
import os
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerlight.session import ensure_checkpoint_dir
from ledgerlight.sources.io import COMPRESSION, MONTH, by_month, write_months

_TABLES: dict[tuple, tuple] = {}
_FRAMES: dict[tuple, DataFrame] = {}
_LOCKS: dict[tuple, threading.Lock] = {}
_GUARD = threading.Lock()

#: While stages are written: the shuffle files of a written stage go, as nothing
#: reads them again, and rows that come a few months a task are not sorted by month first.
_WRITE_CONF = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
               "spark.sql.maxConcurrentOutputFileWriters": "8"}
#: Of the session, while stages are written: how many are, and what was set before.
_WRITING: dict[int, tuple[int, dict]] = {}


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """``_WRITE_CONF`` holds while any thread is inside."""
    with _GUARD:
        n, before = _WRITING.get(id(spark), (0, {}))
        if not n:
            before = {k: spark.conf.get(k, None) for k in _WRITE_CONF}
            for k, v in _WRITE_CONF.items():
                spark.conf.set(k, v)
        _WRITING[id(spark)] = n + 1, before
    try:
        yield
    finally:
        with _GUARD:
            n, before = _WRITING.pop(id(spark))
            if n > 1:
                _WRITING[id(spark)] = n - 1, before
            else:
                for k, v in before.items():
                    spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def enabled() -> bool:
    return os.environ.get("LEDGERLIGHT_MATERIALIZE", "1") != "0"


def stage(spark: SparkSession, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """Return the table for ``key``; build and write it on first use.

    The schema is kept with the path, so that reading a stage runs no job.
    Tables are not bucketed: a join on a hot key is left to AQE, which can
    split a skewed shuffle partition but not a skewed bucket.
    """
    if not enabled():
        return build()
    path, schema, _ = _written(spark, key, build)
    return _read(spark, path, schema)


def observed_stage(spark: SparkSession, key: tuple, build: Callable[[], Observed]) -> tuple[DataFrame, dict]:
    """The table for ``key`` and what was counted while it was written.

    The counts come with the write itself and cost no other pass.  They sit
    in its last stage, whose tasks report once each, even if executors are
    lost and earlier stages run again.
    """
    if not enabled():
        made = build()
        return made.keep(made.rows), made.rows.agg(*made.aggregates).first().asDict()
    path, schema, counts = _written(spark, key, build)
    return _read(spark, path, schema), counts


@dataclass
class Observed:
    """Rows, what is counted of them (names and SQL aggregates), what of them
    is written (``keep``), and whether in a folder for each month."""
    rows: DataFrame
    counts: dict[str, str]
    keep: Callable[[DataFrame], DataFrame] = lambda df: df
    monthly: bool = False

    @property
    def aggregates(self) -> list[Column]:
        return [F.expr(sql).alias(name) for name, sql in self.counts.items()]


def folder(spark: SparkSession, key: tuple, write: Callable[[str], None]) -> str:
    """A folder that ``write`` has filled, once per session and key."""
    k = (spark.sparkContext.applicationId,) + tuple(key)
    with _GUARD:
        lock = _LOCKS.setdefault(k, threading.Lock())
    with lock:
        if k not in _TABLES:
            path = _new_path(spark, key, k)
            with writing(spark):
                write(path)
            _TABLES[k] = (path, None, {})
    return _TABLES[k][0]


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at ``path``; its files are listed once in a session."""
    key = id(spark), path
    if key not in _FRAMES:
        _FRAMES[key] = spark.read.schema(schema).parquet(path)
    return _FRAMES[key]


def _new_path(spark: SparkSession, key: tuple, k: tuple) -> str:
    root = ensure_checkpoint_dir(spark).rstrip("/")
    digest = hashlib.sha1(repr(k).encode()).hexdigest()[:12]
    return f"{root}/ledgerlight-stages/{key[0]}-{digest}-{uuid.uuid4().hex[:8]}"


def _written(spark: SparkSession, key: tuple, build: Callable) -> tuple:
    """Path, schema and counts of the table for ``key``."""
    k = (spark.sparkContext.applicationId,) + tuple(key)
    with _GUARD:
        lock = _LOCKS.setdefault(k, threading.Lock())
    with lock:  # one builder per table; other tables build concurrently
        entry = _TABLES.get(k)
        if entry is None:
            path = _new_path(spark, key, k)
            made, seen = build(), None
            if isinstance(made, Observed):
                seen = Observation(path.rsplit("/", 1)[-1])
                # counted behind that shuffle; rows with a month are dealt by it already
                rows = by_month(made.rows) if made.monthly and MONTH not in made.rows.columns else made.rows
                df = made.keep(rows.observe(seen, *made.aggregates))
            else:
                df = made
            with writing(spark):
                if MONTH in df.columns:
                    write_months(df, path)
                else:
                    df.write.mode("overwrite").option("compression", COMPRESSION).parquet(path)
            entry = _TABLES[k] = (path, df.schema, seen.get if seen else {})
    return entry


def clear() -> None:
    _TABLES.clear()
    _FRAMES.clear()
