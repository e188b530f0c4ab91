"""Selection events as a stream: the same state as the batch fold, kept per case and term."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTPUT = "case_id string, term string, status string, sources bigint, duplicates bigint, conflicts bigint"
STATE = "status string, sources bigint, duplicates bigint, conflicts bigint"


def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """The first status of a key stays; equal ones later are duplicates, others conflicts."""
    status, sources, duplicates, conflicts = state.get if state.exists else (None, 0, 0, 0)
    rows = sorted((r for pdf in batches for r in zip(pdf["at"], pdf["seq"], pdf["status"], strict=True)), key=lambda r: (r[0], r[1]))
    for _, _, new in rows:
        sources += 1
        if status is None:
            status = new
        elif new == status:
            duplicates += 1
        else:
            conflicts += 1
    state.update((status, sources, duplicates, conflicts))
    yield pd.DataFrame([(*key, status, sources, duplicates, conflicts)], columns=[c.split(" ")[0] for c in OUTPUT.split(", ")])


def selection_stream(events: DataFrame) -> DataFrame:
    """A stream of ``events(case_id, term, status, at, seq)`` to the changed states; write it in update mode."""
    good = events.where("case_id is not null and term is not null and status is not null and at is not null and seq is not null")
    return good.groupBy("case_id", "term").applyInPandasWithState(fold, OUTPUT, STATE, "update", "NoTimeout")


def activity(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """``(start, event_type, n, total)`` per window of ``events(ts, event_type, value)``, late rows up to ``late``; append mode."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
