"""A table whose rows belong to days and are replaced by whole days.

Every replacement writes the new rows of its days, sorted, to a folder of its
own and then publishes a manifest (one line for each day: the folder that holds it).
Manifests are numbered and created, never overwritten: readers see the state
before or after a replacement, a writer that dies changes nothing, and of two
writers of one number the second fails and starts again from the new state.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY = "day"
#: Live folders before all days are written to one.
MAX_FOLDERS = 24


class DailyTable:
    """Rows of ``schema`` (without the day) by ``day`` under ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _manifest(self) -> tuple[int, dict[str, str]]:
        fs, folder = self._file("manifests")
        numbers = [int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()] if fs.exists(folder) else []
        if not numbers:
            return 0, {}
        n = max(numbers)
        stream = fs.open(self._file(f"manifests/{n:012d}")[1])
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return n, json.loads(text)

    def _publish(self, number: int, days: dict[str, str]) -> bool:
        """Whether this writer made manifest ``number``: written aside, then renamed to a name that must be free."""
        fs, aside = self._file(f"manifests/_{uuid.uuid4().hex}")
        stream = fs.create(aside, False)
        stream.write(json.dumps(days, sort_keys=True).encode())
        stream.close()
        target = self._file(f"manifests/{number:012d}")[1]
        # a rename onto an existing file is refused (or throws) on HDFS; a local file system needs the claim first
        claim = self._file(f"manifests/_claim-{number:012d}")[1]
        try:
            fs.create(claim, False).close()
        except Exception as e:
            if "AlreadyExists" not in str(e):
                raise
            fs.delete(aside, False)
            return False
        return bool(fs.rename(aside, target))

    def days(self) -> list[date]:
        return [date.fromisoformat(d) for d in sorted(self._manifest()[1])]

    def _write(self, rows: DataFrame) -> str:
        """Rows in a folder of their own, sorted by day: footers tell which row groups hold a day."""
        version = f"v={uuid.uuid4().hex}"
        (rows.select(DAY, *self.schema.fieldNames()).hint("rebalance", DAY).sortWithinPartitions(DAY)
         .write.parquet(f"{self.path}/{version}"))
        return version

    def replace(self, days: Iterable[date], rows: DataFrame, retries: int = 5) -> None:
        """Make ``rows`` (with their ``day``) the content of ``days``; the other days stay. Days without rows become empty.

        Running a replacement again gives the same state.
        """
        days = {d.isoformat() for d in days}
        if not days:
            return
        version = self._write(rows.where(F.col(DAY).isin([date.fromisoformat(d) for d in days])))
        for _ in range(retries):
            number, now = self._manifest()
            if self._publish(number + 1, now | dict.fromkeys(days, version)):
                break
        else:
            raise RuntimeError(f"{self.path}: {retries} other writers came first")
        if len({*now.values(), version}) > MAX_FOLDERS:
            self.compact()

    def compact(self) -> bool:
        """Write all days to one folder; False if another writer came in between (nothing has changed then)."""
        number, now = self._manifest()
        return self._publish(number + 1, dict.fromkeys(now, self._write(self._read(now))))

    def read(self, first: date | None = None, last: date | None = None) -> DataFrame:
        """Rows of the days from ``first`` to ``last``."""
        return self._read({d: v for d, v in self._manifest()[1].items()
                           if (first is None or d >= first.isoformat()) and (last is None or d <= last.isoformat())})

    def _read(self, own: dict[str, str]) -> DataFrame:
        schema = T.StructType([T.StructField(DAY, T.DateType()), *self.schema.fields])
        out = None
        for version in sorted(set(own.values())):
            days = sorted(d for d, v in own.items() if v == version)
            others = [date.fromisoformat(d) for d, v in own.items() if v != version and days[0] < d < days[-1]]
            part = self.spark.read.schema(schema).parquet(f"{self.path}/{version}").where(
                F.col(DAY).between(date.fromisoformat(days[0]), date.fromisoformat(days[-1])))
            part = part.where(~F.col(DAY).isin(others)) if others else part
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], schema)

    def vacuum(self, keep: int = 2) -> int:
        """Delete folders that none of the newest ``keep`` manifests names (older readers have ended). Returns how many."""
        fs, folder = self._file("manifests")
        numbers = sorted((s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().isdigit()), reverse=True)
        used = set()
        for n in numbers[:keep]:
            stream = fs.open(self._file(f"manifests/{n}")[1])
            used |= set(json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")).values())
            stream.close()
        old = [s.getPath() for s in fs.listStatus(self._file("")[1]) if s.getPath().getName().startswith("v=") and s.getPath().getName() not in used]
        for path in old:
            fs.delete(path, True)
        return len(old)
