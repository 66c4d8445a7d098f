"""Streaming forms of the grouped and ordered detectors, and a sink of findings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_threshold(events: DataFrame, ts: str, keys: list[str], least: int, window: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Keys with at least `least` events in a window, emitted when the watermark has passed its end."""
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, window), *keys).agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= least).select(*keys, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n")


def failure_streaks(events: DataFrame, account: str, ts: str, tie: str, failed: Column, least: int = 5) -> DataFrame:
    """(account, ts, tie, failures): successes after failures in a row. Events of an account are taken in order of ts
    within a micro-batch; the state is the length of the open row of failures."""
    kind = {f.name: f.dataType.simpleString() for f in events.schema}
    out = f"account {kind[account]}, ts {kind[ts]}, tie {kind[tie]}, failures long"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "tie"], kind="stable")
        open_, found = state.get[0] if state.exists else 0, []
        for t, i, bad in zip(rows["ts"], rows["tie"], rows["failed"]):
            if bad:
                open_ += 1
                continue
            if open_ >= least:
                found.append((key[0], t, i, open_))
            open_ = 0
        state.update((int(open_),))
        yield pd.DataFrame(found, columns=["account", "ts", "tie", "failures"])

    own = events.select(F.col(account).alias("account"), F.col(ts).alias("ts"), F.col(tie).alias("tie"), failed.alias("failed"))
    return own.groupBy("account").applyInPandasWithState(step, out, "open long", "append", GroupStateTimeout.NoTimeout)


def write_findings(findings: DataFrame, path: str, checkpoint: str):
    """Appends finished findings to Parquet; a restart goes on from the checkpoint."""
    return findings.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
