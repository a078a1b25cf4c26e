"""Alerts that fire once (C14 over the budget monitor's output).

The monitor (:mod:`budget_monitor`) emits a window's state in every
micro-batch that changes it, so an exceeded limit is an alert row again and
again. Here a second stream reads that output and remembers, for each (limit,
window), that its alert has fired: the first row over the limit goes out, later
ones and replayed ones do not. The state is one small row for each alert
that has fired. It is dropped once the feed is ``keep`` past the window's end;
rows of a window that old are late and dropped too, so nothing fires again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .budget_monitor import _checkpoint_root

_VALUES = ["batch_id", "used", "used_usd", "pct", "light"]


def _fire_once(columns: list[str]):
    """One group is a limit in a window; its rows are the monitor's states of it, its state says that the alert has fired."""
    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first = None
        for pdf in frames:
            if len(pdf):
                row = pdf.loc[[pdf["batch_id"].idxmin()]]
                first = row if first is None or row["batch_id"].iloc[0] < first["batch_id"].iloc[0] else first
        if first is not None and not state.exists:
            state.update((int(first["batch_id"].iloc[0]),))
            state.setTimeoutTimestamp(int(first["_until"].iloc[0]))
            yield first[columns]
    return run


def _keys(columns: list[str]) -> list[str]:
    return [c for c in columns if c not in (*_VALUES, "alert")]


def first_alerts(states: DataFrame, keep: str = "60 days") -> DataFrame:
    """The first alert of every (limit, window) in the monitor's output: its keys, batch_id, used, cost, percent, light.

    On a stream an alert goes out in the micro-batch that first shows it, and
    never again. States of windows that ended more than ``keep`` before the
    latest window end seen are late and ignored: choose it longer than the
    longest window and the feed's lag. On a batch frame it is one aggregate
    over all rows, by the smallest batch_id. Rows without an alert, or with a
    null one, fire nothing.
    """
    keys = _keys(states.columns)
    if not states.isStreaming:
        first = states.where("alert").groupBy(*keys).agg(F.min(F.struct(*_VALUES)).alias("_first"))
        return first.select(*keys, "_first.*")
    columns = [*keys, *_VALUES]
    end = F.col("window_end").cast("timestamp")
    # every state moves the watermark; only alerts cross to Python
    alerts = (states.withColumn("_end", end).withWatermark("_end", keep).where("alert")
              .select(*columns, "_end", F.unix_millis("_end").alias("_until")))
    schema = T.StructType([states.schema[c] for c in columns])
    return alerts.groupBy(*keys).applyInPandasWithState(_fire_once(columns), schema, "batch_id long", "append",
                                                        GroupStateTimeout.EventTimeTimeout)


def start_first_alerts(states_path: str, spark, out_path: str, checkpoint_location: str | None = None,
                       keep: str = "60 days", trigger: dict | None = None, query_name: str | None = None) -> StreamingQuery:
    """Follow the monitor's output folder and append each alert to ``out_path`` once.

    The file sink's log makes a repeated micro-batch replace its own files, so
    a restarted query (same ``checkpoint_location``, by default under
    ``spark.checkpoint.dir``) neither loses nor repeats an alert.
    """
    schema = spark.read.parquet(states_path).schema
    states = spark.readStream.schema(schema).parquet(states_path)
    w = (first_alerts(states, keep).writeStream.outputMode("append").format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint_location or f"{_checkpoint_root(spark)}/first-alerts"))
    if query_name:
        w = w.queryName(query_name)
    return w.trigger(**(trigger or {"processingTime": "1 minute"})).start()
