"""Incremental feeds: rows above a run's high-water mark, run states, and progress, as streams and in batch form."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.ledger import TRANSITIONS
from ..sources.scratch import shared_folder

if TYPE_CHECKING:
    import pandas as pd


def append_only(spark: SparkSession, folder: str, schema: str, form: str = "json", files: int = 64) -> DataFrame:
    """A folder that only grows, as a stream of at most `files` files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(form).load(folder)


def fresh_steps(steps: DataFrame) -> DataFrame:
    """Stream (run_id, step_index, payload): each step once, those above the run's mark; a step 1 after higher ones means a restart and resets the mark."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import pandas as pd

        mark = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("step_index")
        reset = bool(len(rows)) and rows["step_index"].min() == 1 and mark > 0
        if reset:
            mark = 0
        new = rows[rows["step_index"] > mark].drop_duplicates("step_index")
        if len(new):
            mark = int(new["step_index"].max())
        state.update((mark,))
        yield pd.DataFrame({"run_id": new["run_id"], "step_index": new["step_index"], "payload": new["payload"], "reset": reset})

    kind = steps.schema["run_id"].dataType.simpleString()
    return steps.groupBy("run_id").applyInPandasWithState(run, f"run_id {kind}, step_index bigint, payload string, reset boolean", "mark bigint", "append", GroupStateTimeout.NoTimeout)


def run_states(events: DataFrame) -> DataFrame:
    """Stream (run_id, seq, event) of run events: the status of each run after every batch, by the transition table."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import pandas as pd

        status = state.get[0] if state.exists else None
        refused = 0
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            sources, to = TRANSITIONS.get(r.event, ((), None))
            if to is not None and status in sources:
                status = to
            else:
                refused += 1
        state.update((status,))
        yield pd.DataFrame({"run_id": [key[0]], "status": [status], "refused": [refused]})

    kind = events.schema["run_id"].dataType.simpleString()
    return events.groupBy("run_id").applyInPandasWithState(run, f"run_id {kind}, status string, refused bigint", "status string", "update", GroupStateTimeout.NoTimeout)


def poll_increments(steps: DataFrame, by: list[str], poll: str, index: str) -> DataFrame:
    """Batch form: per poll (in order) the highest index seen, the mark before, whether it was reset, and how many rows are new.

    A poll whose highest index is below the one before it restarts the feed: its mark is 0.
    """
    seen = steps.groupBy(*by, poll).agg(F.max(index).alias("top"), F.count("*").alias("n"))
    before = F.lag("top").over(W.partitionBy(*by).orderBy(poll))
    out = seen.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("reset", F.col("top") < F.col("before"))
    return out.withColumn("mark", F.when(F.col("reset"), 0).otherwise(F.col("before"))).withColumn("fresh", F.greatest(F.col("top") - F.col("mark"), F.lit(0)))


def newest_only(responses: DataFrame, by: list[str], token: str) -> DataFrame:
    """Responses of the newest request of each key; late ones of older requests are stale."""
    newest = responses.groupBy(*by).agg(F.max(token).alias(token))
    return responses.join(newest, [*by, token], "left_semi")


def progress(chunks: DataFrame, by: list[str], order: str, size: str, total: str) -> DataFrame:
    """Running bytes and percent (0 to 100) of uploads."""
    run = F.sum(size).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    pct = F.when(F.col(total) > 0, F.greatest(F.least(100.0 * run / F.col(total), F.lit(100.0)), F.lit(0.0))).otherwise(0.0)
    return chunks.withColumns({"sent": run, "percent": pct})


def windowed(events: DataFrame, at: str, by: str, value: str, width: str = "1 hour", late: str = "400 days") -> DataFrame:
    """Counts and sums per window and key; rows later than `late` behind the newest are dropped."""
    stamped = events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    out = stamped.groupBy(F.window("__at", width).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), by, "n", "total")


def drained(stream: DataFrame, what: str, by: list[str] | None = None) -> DataFrame:
    """Run a stream over all there is, into files of the shared folder with their own checkpoint, and read these. Of an aggregate, whose rows come out anew with each
    batch that changes them, `by` names the keys: each key's row of its newest batch is the result."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    stream.writeStream.outputMode("update" if by else "append").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    names = stream.columns
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).option("basePath", f"{base}/out").parquet(f"{base}/out/*")
    if not by:
        return rows.select(*names)
    return rows.groupBy(*by).agg(F.max_by(F.struct(*[c for c in names if c not in by]), "batch").alias("r")).select(*by, "r.*").select(*names)


def batch_progress(done: DataFrame, by: list[str], order: str, batch: int = 32) -> DataFrame:
    """Rows done in order, with how many rows and how many batches (the last may be short) are done so far, and in all."""
    run = W.partitionBy(*by).orderBy(order)
    number = F.row_number().over(run)
    every = F.count("*").over(W.partitionBy(*by))
    return done.withColumns({"done": number.cast("bigint"), "batches": F.ceil(number / F.lit(batch)), "all": every, "all_batches": F.ceil(every / F.lit(batch))})


def phase_events(done: DataFrame, by: list[str], order: str, phase: str, batch: int = 32) -> DataFrame:
    """(by, phase, status, processed, processed_batches) as a progress callback reports them: running at nothing and after each batch, and done at the end."""
    rows = batch_progress(done, by, order, batch)
    ends = rows.where((F.col("done") % batch == 0) | (F.col("done") == F.col("all")))
    total = done.groupBy(*by).agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("bigint")
    event = lambda status, n, b: [*by, F.lit(phase).alias("phase"), F.lit(status).alias("status"), n.alias("processed"), b.alias("processed_batches")]
    return total.select(*event("running", zero, zero)).union(ends.select(*event("running", F.col("done"), F.col("batches")))).union(total.select(*event("done", F.col("n"), F.ceil(F.col("n") / F.lit(batch)))))


def rebuild_needed(shown: DataFrame, incoming: DataFrame, by: str, pos: str, key: str) -> DataFrame:
    """(by, rebuild): whether what is shown is no longer a prefix of what comes in: some shown position holds another key, or none."""
    a = shown.select(by, pos, F.col(key).alias("__shown"))
    b = incoming.select(by, pos, F.col(key).alias("__new"))
    met = a.join(b, [by, pos], "full_outer")
    return met.groupBy(by).agg(F.bool_or(F.col("__shown").isNotNull() & ~F.col("__shown").eqNullSafe(F.col("__new"))).alias("rebuild"))
