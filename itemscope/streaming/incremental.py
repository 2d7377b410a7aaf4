"""Structured Streaming operators (extensions X1, X2).

X1  Incremental PDS over arriving responses.  ``max`` is associative and
    idempotent, so one streaming aggregation keeps, per item, the max over
    models of each answer's probability (one column per answer - a single
    stateful aggregation, no chained aggregations); the PDS is the sum of
    those columns, a projection after it.  Duplicate and late rows cannot
    change a max, so no watermark is needed for correctness.
X2  Running accuracy per (model, event-time window) with a watermark: rows
    later than the watermark are dropped, state for closed windows is freed.

Both sinks are ``foreachBatch`` changelogs: every micro-batch appends the
groups it updated, tagged with the batch id, to a Parquet folder; the
current result is the latest row per key.  Restarting from the checkpoint
location replays nothing twice (batch ids are idempotent keys).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def pds_stream(responses: DataFrame, n_classes: int, col: str = "probs") -> DataFrame:
    """X1 on a streaming DataFrame (model_id, item_id, probs ARRAY<DOUBLE>); answer
    vectors shorter than ``n_classes`` have no probability for the other answers."""
    aggs = [F.max(F.get(col, F.lit(c))).alias(f"pmax_{c}") for c in range(n_classes)]
    return responses.groupBy("item_id").agg(*aggs, F.count(F.lit(1)).alias("n_rows"))


def pds_from_state(state: DataFrame, n_classes: int) -> DataFrame:
    """The PDS projection over the per-answer maxima."""
    total = F.lit(0.0)
    for c in range(n_classes):
        total = total + F.coalesce(F.col(f"pmax_{c}"), F.lit(0.0))
    return state.select("item_id", total.alias("pds"), "n_rows")


def accuracy_stream(events: DataFrame, window: str = "1 day", watermark: str = "2 days",
                    ts: str = "ts") -> DataFrame:
    """X2 on a streaming DataFrame (ts, model_id, score [, weight])."""
    w = F.col("weight") if "weight" in events.columns else F.lit(1.0)
    return (events.withWatermark(ts, watermark)
                  .groupBy("model_id", F.window(ts, window).alias("win"))
                  .agg(F.sum(w * F.col("score")).alias("wsum"), F.sum(w).alias("w"),
                       F.count(F.lit(1)).alias("n")))


def changelog_sink(agg: DataFrame, out_path: str, checkpoint: str,
                   trigger_once: bool = True, state_partitions: int | None = None) -> StreamingQuery:
    """Start ``agg`` in update mode writing a batch-tagged changelog to Parquet.

    ``state_partitions`` fixes the number of state-store partitions of a new
    query (it is recorded in the checkpoint and cannot change afterwards);
    size it to the key cardinality of the stream.  The session setting is only
    changed while the query starts."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out_path)

    writer = agg.writeStream.outputMode("update").foreachBatch(write) \
                .option("checkpointLocation", checkpoint)
    if trigger_once:
        writer = writer.trigger(availableNow=True)
    if state_partitions is None:
        return writer.start()
    conf = agg.sparkSession.conf
    before = conf.get("spark.sql.shuffle.partitions")
    conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    try:
        return writer.start()
    finally:
        conf.set("spark.sql.shuffle.partitions", before)


def latest(changelog: DataFrame, keys: list) -> DataFrame:
    """Current state of a changelog: the row of the highest batch per key."""
    w = Window.partitionBy(*keys).orderBy(F.col("batch_id").desc())
    return changelog.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1) \
                    .drop("_rn", "batch_id")


def run_to_end(spark: SparkSession, query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
