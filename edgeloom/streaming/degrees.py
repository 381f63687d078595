"""Streams of edges: degrees by window, and running degrees kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_degrees(edges: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, id, degree) of out-arcs by tumbling window; rows later than the watermark are dropped by the engine."""
    counts = edges.withWatermark(time, late).groupBy(F.window(time, window), F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return counts.select(F.col("window.start").alias("start"), "id", "degree")


def running_degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): after each batch the new degree of every source in it."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def add(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = (state.get[0] if state.exists else 0) + sum(len(r) for r in rows)
        state.update((total,))
        yield pd.DataFrame({"id": [key[0]], "degree": [total]})

    return edges.groupBy("src").applyInPandasWithState(add, "id long, degree long", "degree long", "update", GroupStateTimeout.NoTimeout)
