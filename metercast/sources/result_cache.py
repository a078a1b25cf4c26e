"""Results kept in the shared folder for a limited time.

A result is stored as Parquet under a key: the hash of the query's analysed
plan and of a snapshot of what it reads (every input file with its size and
time; the rows of local relations). A result younger than the time to live is
read back; a plan or an input that changed has another key and is computed
anew. A result becomes visible by one empty file created after its data were
committed, so two writers of one key do each other no harm, and a writer that
dies leaves nothing visible.
"""

from __future__ import annotations

import hashlib
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_base

_FILE = re.compile(r"path=([^;]*);.*?length=(\d+);.*?modification_time=(\d+)")
_PYTHON = re.compile(r"EvalPython|In(Pandas|Arrow)\b|PythonUDTF")
_POSITION = "_cache_position"


class NotCacheable(ValueError):
    """The plan reads something that has no snapshot, or runs Python code without a version."""


def _leaves(plan) -> list:
    def as_list(seq) -> list:
        it = seq.iterator()
        out = []
        while it.hasNext():
            out.append(it.next())
        return out
    return [leaf for p in [plan, *as_list(plan.subqueriesAll())] for leaf in as_list(p.collectLeaves())]


def snapshot(df: DataFrame) -> str:
    """A hash of everything the frame reads: the files its plan lists, with sizes and times, and local rows."""
    nil = getattr(getattr(df.sparkSession._jvm.scala.collection.immutable, "Nil$"), "MODULE$")
    seen = set()
    for leaf in _leaves(df._jdf.queryExecution().analyzed()):
        kind = leaf.getClass().getSimpleName()
        if kind == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            listed = leaf.relation().location().listFiles(nil, nil).mkString("\n")
            seen.update(" ".join(f) for f in _FILE.findall(listed))
        elif kind == "LocalRelation":
            seen.add(f"{leaf.schema().simpleString()} {leaf.data().mkString(chr(10))}")
        elif kind not in ("OneRowRelation", "Range"):
            raise NotCacheable(f"no snapshot of a {kind}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()


def plan_text(df: DataFrame) -> str:
    """The analysed plan with its expression ids numbered in order of appearance (they differ between sessions)."""
    conf = df.sparkSession.conf
    names = {"spark.sql.debug.maxToStringFields": "1000000", "spark.sql.maxPlanStringLength": str((1 << 31) - 32),
             "spark.sql.maxMetadataStringLength": "1000000"}
    before = {k: conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            conf.set(k, v)
        execution = df._jdf.queryExecution()
        text, optimized = execution.analyzed().toString(), execution.optimizedPlan().toString()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    ids: dict[str, str] = {}
    text = re.sub(r"#(\d+)", lambda m: ids.setdefault(m[1], f"#{len(ids)}"), text)
    return ("python " if _PYTHON.search(optimized) else "") + text


class ResultCache:
    """Stored results under one folder; ``ttl`` in seconds, ``clock`` gives the time (tests)."""

    def __init__(self, spark: SparkSession, folder: str | None = None, ttl: float = 600.0, clock: Callable[[], float] = time.time):
        self.spark, self.ttl, self.clock = spark, ttl, clock
        self.folder = (folder or f"{checkpoint_base(spark)}/result-cache").rstrip("/")
        self.hits = self.misses = 0

    # -- files ------------------------------------------------------------------
    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        path = self._path(*parts)
        return sorted(s.getPath().getName() for s in self._fs().listStatus(path)) if self._fs().exists(path) else []

    # -- keys -------------------------------------------------------------------
    def key(self, df: DataFrame, version: str = "") -> str:
        """Hash of plan, schema, inputs and ``version``.

        The plan doesn't show the code of Python functions: a frame with some
        needs a ``version`` that the caller changes with the code.
        """
        text = plan_text(df)
        if text.startswith("python ") and not version:
            raise NotCacheable("a plan with Python functions needs a version")
        return hashlib.sha256("\0".join([version, df.schema.json(), text, snapshot(df)]).encode()).hexdigest()[:40]

    # -- results ----------------------------------------------------------------
    def get(self, df: DataFrame, version: str = "") -> DataFrame:
        """The stored result if one is young enough; else the result, computed and stored now.

        What can't have a key (``NotCacheable``: an RDD, a stream, a table of
        another system) is returned as it is, uncached. A global sort order is
        kept.
        """
        try:
            key = self.key(df, version)
        except NotCacheable:
            return df
        entry = self._newest(key)
        if entry:
            self.hits += 1
        else:
            self.misses += 1
            entry = self._store(df, key)
        ordered = self._ordered(df)
        schema = T.StructType([*df.schema.fields, T.StructField(_POSITION, T.LongType())]) if ordered else df.schema
        out = self.spark.read.schema(schema).parquet(f"{self.folder}/{key}/{entry}")
        return out.orderBy(_POSITION).drop(_POSITION) if ordered else out

    @staticmethod
    def _ordered(df: DataFrame) -> bool:
        return bool(df._jdf.queryExecution().optimizedPlan().outputOrdering().nonEmpty())

    def _newest(self, key: str) -> str | None:
        names = self._names(key)
        ready = [n[:-3] for n in names if n.endswith(".ok") and n[:-3] in names]
        young = [n for n in ready if 0 <= self.clock() - int(n.split("-")[0]) / 1000 < self.ttl]
        return max(young, default=None)

    def _store(self, df: DataFrame, key: str) -> str:
        entry = f"{int(self.clock() * 1000):015d}-{uuid.uuid4().hex}"
        # ids of a sorted frame ascend with its order; readers sort by them
        out = df.withColumn(_POSITION, F.monotonically_increasing_id()) if self._ordered(df) else df
        out.write.parquet(f"{self.folder}/{key}/{entry}")
        self._fs().create(self._path(key, f"{entry}.ok"), False).close()
        return entry

    # -- removal ----------------------------------------------------------------
    def invalidate(self, df: DataFrame | None = None, version: str = "") -> int:
        """Make a frame's stored results (or all) invisible; readers that have begun go on. Returns how many."""
        keys = [self.key(df, version)] if df is not None else self._names()
        gone = [(k, n) for k in keys for n in self._names(k) if n.endswith(".ok")]
        for k, n in gone:
            self._fs().delete(self._path(k, n), False)
        return len(gone)

    def sweep(self, grace: float = 86_400.0) -> int:
        """Delete the files of results that are past the time to live by ``grace`` seconds (what still reads them has ended).
        Returns how many entries went."""
        count = 0
        for key in self._names():
            names = {n.removesuffix(".ok") for n in self._names(key)}
            old = {n for n in names if self.clock() - int(n.split("-")[0]) / 1000 >= self.ttl + grace}
            for n in sorted(old):
                self._fs().delete(self._path(key, f"{n}.ok"), False)
                self._fs().delete(self._path(key, n), True)
            if old == names:
                self._fs().delete(self._path(key), True)
            count += len(old)
        return count
