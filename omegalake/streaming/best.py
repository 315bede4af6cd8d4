"""The best entry of each key as a stream, in state that spans batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql import types as T

#: State provider that keeps state on disk, in the checkpoint's folder.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_L, _S, _B = T.LongType(), T.StringType(), T.BooleanType()
#: What is kept of an entry.
KEPT = T.StructType([T.StructField("equivalent", _B), T.StructField("status", _S), T.StructField("pos", _L)])


def merit(equivalent: bool | None, status: str | None, pos: int) -> tuple[bool, bool, int]:
    """Equivalent before ok before later entries."""
    return bool(equivalent), status == "ok", pos


class _Best(StatefulProcessor):
    """One kept entry for each key; a better one takes its place and is passed on. Which entry comes first makes no difference."""

    def __init__(self, keys: list[str], ttl_ms: int | None):
        self._names, self._ttl = [*keys, *KEPT.names], ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._best = handle.getValueState("best", KEPT, self._ttl) if self._ttl else handle.getValueState("best", KEPT)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = self._best.get()
        best = tuple(kept) if kept else None
        for r in rows:
            if best is None or merit(r["equivalent"], r["status"], r["pos"]) > merit(*best):
                best = (r["equivalent"], r["status"], r["pos"])
        if best is not None and (kept is None or best != tuple(kept)):
            self._best.update(best)
            yield Row(**dict(zip(self._names, (*key, *best))))

    def close(self) -> None:
        pass


def best_entries(entries: DataFrame, keys: list[str], ttl_ms: int | None = None, time: str | None = None, watermark: str | None = None) -> DataFrame:
    """A stream of (keys, equivalent, status, pos): each key's best entry so far, again whenever it is beaten, if not oftener.

    The last row of a key by batch is its best entry. It is kept by a running aggregate, without Python, unless entries are
    dropped or forgotten: then by transformWithState, which asks its state a few times for each key of a batch. time and watermark: entries later than that are dropped, and counted by Spark
    as such; without, every entry counts, however late. ttl_ms: a key's state goes so long after its last change, and an entry
    that comes then starts anew. The session must use STATE_STORE.
    """
    if not watermark and not ttl_ms:
        merit_first = F.struct(F.coalesce("equivalent", F.lit(False)).alias("_equivalent"), F.coalesce(F.col("status") == "ok", F.lit(False)).alias("_ok"), F.col("pos").cast("long").alias("pos"), "equivalent", "status")
        return entries.groupBy(*keys).agg(F.max(merit_first).alias("_best")).select(*keys, *(F.col(f"_best.{c}").alias(c) for c in KEPT.names))
    if watermark:
        entries = entries.withWatermark(time, watermark)
    schema = T.StructType([*(entries.schema[k] for k in keys), *KEPT.fields])
    grouped = entries.groupBy(*keys)
    return grouped.transformWithState(_Best(keys, ttl_ms), schema, "Update", "ProcessingTime" if ttl_ms else "None")
