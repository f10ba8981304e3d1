"""Request limits per client: fixed minutes and a sliding window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gazetteer import vocab
from gazetteer.operators.order import top_per
from gazetteer.session import cut_lineage


def rate_fixed(
    events: DataFrame, client: str = "client", at: str = "at_s", order: str = "event_id",
    limit: int = vocab.RATE_MAX, window_s: int = vocab.RATE_WINDOW_S,
) -> DataFrame:
    """Whether each request fits its client's minute; rejected ones count too.

    Requests are placed by time, then ``order``.  Only the first ``limit`` of a
    minute pass, so the limit's place per minute decides for all others and no
    minute is ever ranked in full.
    """
    bucket = F.floor(F.col(at) / window_s)
    placed = events.withColumn("bucket", bucket).withColumn("_place", F.struct(at, order))
    w = Window.partitionBy(client, "bucket").orderBy("_place")
    last_ok = (
        placed.select(client, "bucket", "_place")
        .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit)
        .groupBy(client, "bucket").agg(F.max("_place").alias("_last"))
    )
    allowed = F.col("_place") <= F.col("_last")
    left = F.greatest(F.lit(1), F.ceil((F.col("bucket") + 1) * window_s - F.col(at)))
    return placed.join(last_ok, [client, "bucket"]).withColumn("allowed", allowed).withColumn(
        "retry_after_s", F.when(~F.col("allowed"), left)).drop("_place", "_last")


def over_limit(
    stream: DataFrame, client: str = "client", at: str = "ts", limit: int = vocab.RATE_MAX,
    late: str = "1 minute",
) -> DataFrame:
    """Streaming alert: client minutes with more requests than allowed so far.

    In update mode a minute is told again whenever its count has grown.
    """
    return (
        stream.withWatermark(at, late)
        .groupBy(F.window(at, f"{vocab.RATE_WINDOW_S} seconds"), client)
        .agg(F.count(F.lit(1)).alias("requests"))
        .where(F.col("requests") > limit)
        .select(client, F.col("window.start").alias("minute"), "requests")
    )


def store_alerts(alerts: DataFrame, batch: int, out: str) -> None:
    """Store what one micro-batch told; a repeated batch replaces itself."""
    alerts.write.mode("overwrite").parquet(f"{out}/alerts/batch={batch}")


def write_alerts(alerts: DataFrame, out: str) -> StreamingQuery:
    """Run the alert over everything available; only minutes that changed are written."""
    return (
        alerts.writeStream.outputMode("update").option("checkpointLocation", f"{out}/progress")
        .foreachBatch(lambda df, batch: store_alerts(df, batch, out)).trigger(availableNow=True).start())


def current_alerts(spark: SparkSession, out: str, client: str = "client") -> DataFrame:
    """The latest count of each client minute; counts only grow, so it is the greatest told."""
    return spark.read.parquet(f"{out}/alerts").groupBy(client, "minute").agg(F.max("requests").alias("requests"))


# --- sliding window -----------------------------------------------------------

def admit(recent: list[float], now: float, limit: int, window_s: float) -> tuple[list[float], int | None]:
    """One request against the admitted times of the last window.

    Returns the times to remember and, when rejected, the seconds to wait.
    """
    recent = [t for t in recent if now - t < window_s]
    if len(recent) >= limit:
        return recent, max(1, int(-(-(window_s - (now - recent[0])) // 1)))
    return [*recent, now], None


def idle_segments(
    events: DataFrame, client: str, at: str, window_s: int = vocab.RATE_WINDOW_S
) -> DataFrame:
    """Number the stretches of each client that a pause of a whole window parts.

    After such a pause no admitted request is in the window, so stretches do not
    depend on each other.  Pauses show in the first and last time of each window
    slot, one small row per client and slot.
    """
    slots = events.withColumn("_slot", F.floor(F.col(at) / window_s))
    edges = slots.groupBy(client, "_slot").agg(F.min(at).alias("_from"), F.max(at).alias("_to"))
    w = Window.partitionBy(client).orderBy("_slot")
    starts = F.coalesce(F.col("_from") - F.lag("_to").over(w) >= window_s, F.lit(True))
    numbered = edges.withColumn("_new", starts.cast("int")).withColumn(
        "segment", F.sum("_new").over(w)).select(client, "_slot", "segment")
    return slots.join(numbered, [client, "_slot"]).drop("_slot")


WINDOWS_A_CHUNK = 240


def rate_sliding(
    events: DataFrame, client: str = "client", at: str = "at_s", order: str = "event_id",
    limit: int = vocab.RATE_MAX, window_s: int = vocab.RATE_WINDOW_S, windows_a_chunk: int = WINDOWS_A_CHUNK,
) -> DataFrame:
    """Whether each request is admitted: fewer than ``limit`` admitted in the last window.

    Of requests at one instant only the first ``limit`` can pass, so only those
    are walked; a flood shrinks to its distinct instants before any shuffle.
    Stretches between pauses do not depend on each other, and long ones are cut
    into chunks of time.  All chunks are walked at once from an empty window;
    then those whose predecessor ended with other admitted times are walked
    again from these, until none differs.  No client has to fit a task; one that
    is over its limit without a pause may need a round for each of its chunks.
    """
    first = top_per(events.select(client, at, order), [client, at], [F.col(order)], limit).drop("_rn")
    chunk = ["_client", "_segment", "_chunk"]
    rows = cut_lineage(idle_segments(first, client, at, window_s).select(
        F.col(client).alias("_client"), F.col("segment").alias("_segment"),
        F.floor(F.col(at) / (window_s * windows_a_chunk)).cast("bigint").alias("_chunk"),
        F.col(at).alias("_at"), F.col(order).alias("_order")))
    schema = T.StructType([*rows.schema.fields, T.StructField("_wait", T.LongType()),
                           T.StructField("_left", T.ArrayType(T.DoubleType()))])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Verdicts in order, and after each chunk a row with the times it leaves behind."""
        key, recent = None, []

        def leave() -> pd.DataFrame:
            return pd.DataFrame({**{c: [k] for c, k in zip(chunk, key, strict=True)}, "_at": [None], "_order": [None],
                                 "_wait": pd.array([None], "Int64"), "_left": [recent]})

        for batch in batches:
            verdicts, from_row = [], 0
            for i, (c, s, k, t) in enumerate(zip(*[batch[x] for x in (*chunk, "_at")], strict=True)):
                if (c, s, k) != key:
                    if key is not None:
                        yield batch[from_row:i][[*chunk, "_at", "_order"]].assign(_wait=pd.array(verdicts, "Int64"), _left=None)
                        yield leave()
                        verdicts, from_row = [], i
                    key, recent = (c, s, k), list(batch["_entry"].iloc[i])
                recent, wait = admit(recent, float(t), limit, window_s)
                verdicts.append(wait)
            yield batch[from_row:][[*chunk, "_at", "_order"]].assign(_wait=pd.array(verdicts, "Int64"), _left=None)
        if key is not None:
            yield leave()

    def walked(entered: DataFrame) -> DataFrame:
        placed = entered.repartition(*chunk).sortWithinPartitions(*chunk, "_at", "_order")
        return cut_lineage(placed.mapInPandas(walk, schema))

    # A chunk's window can only hold admitted times that reach its first request.
    chunks = rows.groupBy(*chunk).agg(F.min("_at").cast("double").alias("_from"))
    nothing = F.array().cast("array<double>")
    states = cut_lineage(chunks.withColumn("_entry", nothing))
    judged = walked(rows.withColumn("_entry", nothing))
    before = Window.partitionBy("_client", "_segment").orderBy("_chunk")
    while True:
        left = judged.where("_left IS NOT NULL").select(*chunk, "_left")
        due = states.join(left, chunk).withColumn("_due", F.filter(
            F.coalesce(F.lag("_left").over(before), nothing), lambda t: F.col("_from") - t < window_s))
        states = cut_lineage(due.select(*chunk, "_from", F.col("_due").alias("_entry"), (F.col("_due") != F.col("_entry")).alias("_new")))
        changed = states.where("_new")
        if changed.isEmpty():
            break
        states = states.drop("_new")
        again = walked(rows.join(changed.select(*chunk, "_entry"), chunk))
        judged = judged.join(changed.select(*chunk), chunk, "left_anti").unionByName(again)

    seen = judged.where("_left IS NULL").select(
        F.col("_client").alias(client), F.col("_at").alias(at), F.col("_order").alias(order), "_wait", F.lit(True).alias("_seen"))
    # Whoever comes later in the same instant finds the window full: it waits
    # like the last one walked, or a whole window if that one still passed.
    last = seen.groupBy(client, at).agg(
        F.max_by(F.coalesce("_wait", F.lit(window_s).cast("bigint")), order).alias("_full"))
    out = events.join(seen, [client, at, order], "left").join(last, [client, at], "left")
    wait = F.when(F.col("_seen"), F.col("_wait")).otherwise(F.col("_full"))
    return out.withColumn("retry_after_s", wait).withColumn(
        "allowed", F.col("retry_after_s").isNull()).drop("_wait", "_seen", "_full")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SlidingLimit(StatefulProcessor):
    """Admitted times of one client's last window, kept until the window is over in event time."""

    def __init__(self, limit: int, window_s: int, key: str, at: str, order: str):
        self.limit, self.window_s, self.key, self.at, self.order = limit, window_s, key, at, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "at double")
        self.newest = handle.getValueState("newest", "at double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        recent = [t for (t,) in self.times.get()] if self.times.exists() else []
        newest = self.newest.get()[0] if self.newest.exists() else float("-inf")
        arrived = pd.concat([r[[self.order, self.at]] for r in rows]).sort_values([self.at, self.order])
        verdicts = []
        for t in arrived[self.at].astype("int64") / 1e9 if arrived[self.at].dtype.kind == "M" else arrived[self.at]:
            newest = max(newest, float(t))  # who comes late comes now
            recent, wait = admit(recent, newest, self.limit, self.window_s)
            verdicts.append(wait)
        self.times.put([(t,) for t in recent])
        self.newest.update((newest,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int((newest + self.window_s) * 1000))
        yield arrived.assign(**{
            self.key: key[0], "allowed": [v is None for v in verdicts], "retry_after_s": pd.array(verdicts, dtype="Int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        self.newest.clear()
        yield from ()

    def close(self) -> None:
        pass


def rate_sliding_stream(
    stream: DataFrame, client: str = "client", at: str = "at", order: str = "event_id", late: str = "1 minute",
    limit: int = vocab.RATE_MAX, window_s: int = vocab.RATE_WINDOW_S,
) -> DataFrame:
    """Streaming admission: the columns ``client``, ``at`` (a timestamp) and ``order`` with the verdict.

    Within a micro-batch requests are taken in time order.  A request older than
    one judged before it is judged as if it came at that one's time; one behind
    the watermark (``late``) is dropped by Spark and gets no verdict.  A client
    whose last window is over in event time is forgotten.  The session must keep
    state in RocksDB (``ROCKS``).
    """
    rows = stream.select(client, at, order).withWatermark(at, late)
    schema = T.StructType([rows.schema[order], rows.schema[at], rows.schema[client], T.StructField("allowed", T.BooleanType()),
                           T.StructField("retry_after_s", T.LongType())])
    return rows.groupBy(client).transformWithStateInPandas(
        SlidingLimit(limit, window_s, client, at, order), schema, "Append", "EventTime")
