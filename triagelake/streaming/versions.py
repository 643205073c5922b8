"""The last version of every id in a stream, by order of arrival."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# How long an id is remembered after its last change.
REMEMBER = "400 days"

NEW, CHANGED, UNCHANGED, OVERTAKEN = "new", "changed", "unchanged", "overtaken"
# Changes that say what an incident is from now on.
TOLD = (NEW, CHANGED)

# Versions known to be overtaken before they reach their id's state are spread over so many groups.
LANES = 64

_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800}


def milliseconds(span: str) -> int:
    """``30 days`` and the like."""
    said = re.fullmatch(r"\s*(\d+)\s*([a-z]+?)s?\s*", span)
    if not said or said[2] not in _UNITS:
        raise ValueError(f"not a span of time: {span}")
    return 1000 * int(said[1]) * _UNITS[said[2]]


def arrivals(valid: DataFrame, remember: str = REMEMBER) -> DataFrame:
    """Rows with ``change``, ``version`` and ``arrived_at``; see `ingest_stream`.

    ``valid`` has ``id``, ``_digest`` of the content and ``_place``: modification time, path and
    offset of the part of the file that the row was read from.
    """
    columns = [f for f in valid.schema.fields if f.name not in ("_digest", "_place")]
    placed = T.StructType([*columns, T.StructField("_digest", T.StringType()), T.StructField("_order", T.StringType()), T.StructField("_lane", T.IntegerType())])
    out = T.StructType([*columns, T.StructField("change", T.StringType()), T.StructField("version", T.LongType())])
    told = (
        valid.mapInArrow(in_order, placed)
        .groupBy("id", "_lane")
        .transformWithState(LastVersion([f.name for f in columns], milliseconds(remember)), out, "Append", "ProcessingTime")
    )
    return told.withColumn("arrived_at", F.current_timestamp())


def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a text that sorts by arrival, and a lane: 0 for the last row of an id in its part of the input.

    An id that fills much of a batch so brings few rows to its state: the others are known to
    be overtaken, and pass it by in lanes of their own.
    """
    here, lines = None, 0
    for batch in batches:
        orders = []
        for place in batch.column("_place").to_pylist():
            lines = lines + 1 if place == here else 0
            here = place
            orders.append(f"{place['at']:020d} {place['file_path']} {place['file_block_start']:020d} {lines:012d}")
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        lanes = 1 + np.arange(len(ids)) % LANES
        _, from_end = np.unique(ids[::-1], return_index=True)
        lanes[len(ids) - 1 - from_end] = 0
        kept = [c for c in batch.schema.names if c not in ("_place",)]
        made = {c: batch.column(c) for c in kept}
        made |= {"_order": pa.array(orders, pa.string()), "_lane": pa.array(lanes, pa.int32())}
        yield pa.RecordBatch.from_pydict(made)


class LastVersion(StatefulProcessor):
    """Compares the last row of an id in a batch with what is held, and holds it from then on."""

    def __init__(self, columns: list[str], remember_ms: int) -> None:
        self.columns = columns
        self.remember_ms = remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "digest string, version long", self.remember_ms)

    def told(self, row: Row, change: str, version: int | None) -> Row:
        return Row(*self.columns, "change", "version")(*(row[c] for c in self.columns), change, version)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        last = None
        for row in rows:
            if key[1] == 0:
                if last is None or row["_order"] > last["_order"]:
                    row, last = last, row
                if row is None:
                    continue
            yield self.told(row, OVERTAKEN, None)
        if last is None:
            return
        before = self.held.get() if self.held.exists() else None
        if before is not None and before[0] == last["_digest"]:
            yield self.told(last, UNCHANGED, before[1])
            return
        version = 1 if before is None else before[1] + 1
        self.held.update((last["_digest"], version))
        yield self.told(last, NEW if before is None else CHANGED, version)

    def close(self) -> None:
        pass
