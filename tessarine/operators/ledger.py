"""Ledgers of an exploration: views, steps, marks, saved tiles and run states, every one keyed by run and ordered by seq."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.strings import public_url

#: Caps of the ledgers.
VIEWS_KEPT, VIEWS_SHOWN, CANDIDATES_SHOWN = 8, 4, 8
GOOD_CAP, BAD_CAP = 200, 50
FINAL = ("done", "terminated", "error")
CLOSED_TO_UPLOADS = ("pending", "running", *FINAL)

#: Allowed changes of a run's status: event -> (from, to).
TRANSITIONS = {
    "create": ((None,), "created"),
    "upload": (("created", "uploading"), "uploading"),
    "finalize": (("created", "uploading"), "pending"),
    "start": (("pending",), "running"),
    "finish": (("running",), "done"),
    "fail": (("created", "uploading", "pending", "running"), "error"),
    "terminate": (("created", "uploading", "pending", "running"), "terminated"),
}


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """rows with a 1-based number in order within their run (and other keys)."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("bigint"))


def last_rows(rows: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each group."""
    newest = W.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= n).drop("__n")


def current_view(views: DataFrame, run: str = "run_id", seq: str = "view_seq") -> DataFrame:
    """The last view of each run: an aggregate, no window, so it combines before the shuffle."""
    return views.groupBy(run).agg(F.max_by(F.struct(*[c for c in views.columns if c != run]), seq).alias("v")).select(run, "v.*")


def save_tiles(requests: DataFrame, by: list[str], order: list[str], quality: str = "quality") -> DataFrame:
    """Requests to save a tile, with tile_idx where the cap of their quality allows it and a reason where it doesn't."""
    n = F.row_number().over(W.partitionBy(*by, quality).orderBy(*order))
    cap = F.when(F.col(quality) == "good", GOOD_CAP).otherwise(BAD_CAP)
    ok = F.col("__n") <= cap
    return requests.withColumn("__n", n).select(*requests.columns, ok.alias("ok"), F.when(ok, F.col("__n")).cast("bigint").alias("tile_idx"), F.when(~ok, F.concat(F.lit("max_"), F.col(quality), F.lit("_tiles_reached"))).alias("reason"))


def live_marks(log: DataFrame, by: list[str], order: list[str], kind: str = "kind") -> DataFrame:
    """Marks that no later discard has popped: a log of `mark` and `discard` rows as a stack. Adds roi_id, which counts the live stack, so ids are used again after a discard.

    A mark is popped by the first later point where the stack falls below its own height: two windows and one aggregate,
    no Python fold. Discards of an empty stack do nothing.
    """
    run = W.partitionBy(*by).orderBy(*order)
    step = F.when(F.col(kind) == "mark", 1).when(F.col(kind) == "discard", -1).otherwise(0)
    walk = log.withColumn("__step", step).withColumn("__sum", F.sum("__step").over(run.rowsBetween(W.unboundedPreceding, 0)))
    # the floor rises with each discard that finds nothing
    walk = walk.withColumn("__floor", F.least(F.min("__sum").over(run.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)))
    walk = walk.withColumn("__height", F.col("__sum") - F.col("__floor"))
    low = F.min("__height").over(run.rowsBetween(1, W.unboundedFollowing))
    walk = walk.withColumn("__after", low)
    live = (F.col(kind) == "mark") & (F.col("__after").isNull() | (F.col("__after") >= F.col("__height")))
    return walk.where(live).select(*log.columns, F.col("__height").cast("bigint").alias("roi_id"))


def run_state(events: DataFrame, by: list[str], order: list[str], kind: str = "kind") -> DataFrame:
    """Status after each event by the transition table; an event that its status doesn't allow leaves it and is refused.

    The table only ever moves on: but for uploads, each status is entered once, by the first fitting event after its predecessor was entered. So the
    moves are a handful of running minima over the run's ordered events, windows of one layout, and no array of the run's events is ever built.
    """
    run = W.partitionBy(*by)
    rows = events.select(*by, *order, F.col(kind).alias("event")).withColumn("__at", F.row_number().over(run.orderBy(*order)))

    def first(event: str, after: str) -> Column:
        names = (event,) if isinstance(event, str) else event
        hit = F.col("event").isin(*names)
        return F.min(F.when(hit if after is None else hit & (F.col("__at") > F.col(after)), F.col("__at"))).over(run)

    rows = rows.withColumn("__created", first("create", None))
    for name, event, after in (("__closed", "finalize", "__created"), ("__ended", ("fail", "terminate"), "__created"), ("__loaded", "upload", "__created")):
        rows = rows.withColumn(name, first(event, after))
    for name, event, after in (("__started", "start", "__closed"), ("__finished", "finish", "__started")):
        rows = rows.withColumn(name, first(event, after))
    never = F.lit(1 << 31).cast("bigint")
    at = lambda c: F.coalesce(F.col(c), never)
    # a run ends by failing or by finishing, whichever comes first, and nothing moves behind its end
    rows = rows.withColumn("__ended", F.when(at("__ended") < at("__finished"), F.col("__ended")))
    for name in ("__closed", "__started", "__finished"):
        rows = rows.withColumn(name, F.when(at(name) < at("__ended"), F.col(name)))
    rows = rows.withColumn("__loaded", F.when(at("__loaded") < F.least(at("__closed"), at("__ended")), F.col("__loaded")))
    end = F.max(F.when(F.col("__at") == F.col("__ended"), F.when(F.col("event") == "fail", "error").otherwise("terminated"))).over(run)
    here = F.col("__at")
    status = (
        F.when(here >= at("__ended"), end).when(here >= at("__finished"), "done").when(here >= at("__started"), "running").when(here >= at("__closed"), "pending")
        .when(here >= at("__loaded"), "uploading").when(here >= at("__created"), "created")
    )
    entered = F.lit(False)
    for name in ("__created", "__closed", "__started", "__finished", "__ended"):
        entered = entered | (here == at(name))
    loads = (F.col("event") == "upload") & (here > at("__created")) & (here < F.least(at("__closed"), at("__ended")))
    return rows.select(*by, *order, "event", status.alias("status"), (entered | F.coalesce(loads, F.lit(False))).alias("ok"))


#: What may be asked of a run, whatever its ledger, by status.
CLEARED_FROM = "done"


def guarded(requests: DataFrame, runs: DataFrame, by: str = "run_id", action: str = "action") -> DataFrame:
    """requests with ok, the status after them, and a reason: runs (run_id, status) that aren't known give unknown_run; uploads and finalising need an open run;
    terminating a run that has ended changes nothing and is fine; outputs are cleared of runs that are done, and of no others."""
    met = requests.join(runs.select(by, F.col("status").alias("__status"), F.lit(True).alias("__known")), by, "left")
    status, asked = F.col("__status"), F.col(action)
    ended = F.coalesce(status.isin(*FINAL), F.lit(False))
    why = (
        F.when(F.col("__known").isNull(), "unknown_run").when(asked.isin("upload", "finalize") & F.coalesce(status.isin(*CLOSED_TO_UPLOADS), F.lit(False)), F.concat(F.lit("closed_"), status))
        .when((asked == "clear") & ~status.eqNullSafe(F.lit(CLEARED_FROM)), "not_done").when(~asked.isin("upload", "finalize", "terminate", "clear", "get"), "unknown_action")
    )
    after = F.when(asked == "upload", "uploading").when(asked == "finalize", "pending").when((asked == "terminate") & ~ended, "terminated").otherwise(status)
    return met.select(*requests.columns, why.isNull().alias("ok"), F.when(why.isNull(), after).otherwise(status).alias("status"), why.alias("reason"))


def upload_totals(files: DataFrame, by: list[str], size: str, name: str) -> DataFrame:
    return files.groupBy(*by).agg(F.sum(size).alias("total_bytes"), F.count("*").alias("n_files"), F.sort_array(F.collect_list(name)).alias("names"))


def carried_start(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """started_at of each status row: its own time where a phase is `starting`, else the last such."""
    seen = F.last(F.when(F.col("status") == "starting", F.col("at")), ignorenulls=True).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("started_at", F.coalesce(seen, F.col("at")))


def report_order(marks: DataFrame, by: list[str]) -> DataFrame:
    """Marks with their place in a report: most important first, then by id."""
    return marks.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("importance"), "roi_id")))


def summary(runs: DataFrame, last: str, **ledgers: DataFrame) -> DataFrame:
    """Each run with n_<name> and last_<name> (the largest `last`) of its ledgers: partial aggregates, no ledger is gathered."""
    out = runs
    for name, rows in ledgers.items():
        out = out.join(rows.groupBy("run_id").agg(F.count("*").alias(f"n_{name}"), F.max(last).alias(f"last_{name}")), "run_id", "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)).cast("bigint"))
    return out


def snapshot(runs: DataFrame, **ledgers: DataFrame) -> DataFrame:
    """Each run with its ledgers as arrays of structs, sorted by their first column after run_id; null where a run has none. For ledgers that are shown whole: one run's rows are one value."""
    out = runs
    for name, rows in ledgers.items():
        cols = [c for c in rows.columns if c != "run_id"]
        out = out.join(rows.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name)), "run_id", "left")
    return out


def public_snapshot(runs: DataFrame, views: DataFrame, marks: DataFrame, root: str) -> DataFrame:
    """What a client sees of each run: its current view and its marks with the addresses of their images, and the addresses of its overview and overlay; null where there is none.

    runs (run_id, overview_path, overlay_path), views (run_id, view_seq, ..., debug_path), marks (run_id, roi_id, ..., debug_path). Maps without entries are null.
    """
    shown = views.withColumn("image_url", public_url(F.col("debug_path"), root))
    now = current_view(shown)
    now = now.select("run_id", F.struct(*[c for c in now.columns if c != "run_id"]).alias("current_view"))
    lists = snapshot(runs.select("run_id"), roi_marks=marks.withColumn("image_url", public_url(F.col("debug_path"), root)))
    tidy = [F.when(F.size(f.name) > 0, F.col(f.name)).alias(f.name) if f.dataType.typeName() == "map" else F.col(f.name) for f in runs.schema.fields]
    out = runs.select(*tidy, public_url(F.col("overview_path"), root).alias("overview_image_url"), public_url(F.col("overlay_path"), root).alias("roi_candidates_image_url"))
    return out.join(now, "run_id", "left").join(lists, "run_id", "left")
