"""A run's report as text: sections from the ledgers, written by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ledger import report_order

#: The lines of a report that are always the same, and the labels of its facts.
PROMPT, FINAL, REASONING, MARKS, STEPS = "## Prompt", "## Final Report", "## Model Reasoning", "## Regions of Interest (ROIs)", "## Navigation Steps"
NO_MARKS, NO_STEPS, NO_REASON = "_No ROIs were kept in this run._", "_No navigation steps recorded._", "(no reason provided)"
FENCE, END = "```text", "```"

_MARK = (
    "roi_id int, label string, note string, importance int, view_level int, bbox array<bigint>, field_width_um double, field_height_um double, tissue_fraction double, effective_magnification double, image string"
)
_STEP = (
    "step_index int, tool string, nav_reason string, view_level int, bbox array<bigint>, field_width_um double, field_height_um double, tissue_fraction double, candidate_stage string, candidate_pipeline string, "
    "candidate_count int, candidate_source string, candidate_warning string, index_extractor string, index_tiles int, index_dim int, shown_w int, shown_h int, image string"
)


def _with(rows: DataFrame, schema: str, by: str) -> DataFrame:
    """rows with all columns of a ledger, null where they have none."""
    fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
    return rows.select(by, *[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])


def _fact(label: str, value: Column) -> Column:
    """A line, null for a null or empty value."""
    return F.concat(F.lit(f"- **{label}**: "), F.nullif(value.cast("string"), F.lit("")))


def _view_facts() -> dict[str, Column]:
    box = F.col("bbox")
    return {
        "level": _fact("View level", F.col("view_level")),
        "box": F.when(box.isNotNull(), _fact("BBox (level 0)", F.format_string("x=%d, y=%d, w=%d, h=%d", *[F.get(box, F.lit(i)) for i in range(4)]))),
        "field": F.when(F.col("field_width_um").isNotNull() & F.col("field_height_um").isNotNull(), _fact("Approx field size", F.format_string("~%.0f × %.0f µm", "field_width_um", "field_height_um"))),
        "tissue": F.when(F.col("tissue_fraction").isNotNull(), _fact("Tissue fraction", F.format_string("%.2f", "tissue_fraction"))),
    }


def _picture(label: str, ident: str) -> Column:
    return F.when(F.nullif(F.col("image"), F.lit("")).isNotNull(), F.concat(F.lit(f"\n![{label} "), F.col(ident).cast("string"), F.lit("]("), F.col("image"), F.lit(")")))


def _joined(rows: DataFrame, by: str, place: str, lines: list[Column], name: str) -> DataFrame:
    """(by, name): each row's lines that are there, an empty line behind each row, rows by place."""
    text = F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n")
    placed = rows.select(by, F.struct(F.col(place).alias("place"), F.concat(text, F.lit("\n")).alias("text")).alias("r"))
    return placed.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["text"]), "\n").alias(name))


def mark_section(marks: DataFrame, by: str = "run_id") -> DataFrame:
    """(run_id, section): the marked regions, most important first."""
    facts, rows = _view_facts(), _with(marks, _MARK, by).withColumn("importance", F.coalesce("importance", F.lit(1)))
    lines = [
        F.concat(F.lit("### ROI "), F.col("roi_id").cast("string"), F.lit(": "), F.coalesce("label", F.lit("")), F.lit("\n")), _fact("Importance", F.col("importance")), _fact("Note", F.col("note")),
        facts["level"], facts["box"], facts["field"], facts["tissue"], F.when(F.col("effective_magnification").isNotNull(), _fact("Effective magnification (approx)", F.format_string("~%.1fx", "effective_magnification"))), _picture("ROI", "roi_id"),
    ]
    return _joined(report_order(rows, [by]), by, "place", lines, "section")


def step_section(steps: DataFrame, by: str = "run_id") -> DataFrame:
    """(run_id, walk): the steps in order, each with its reason and what is known of its view and its candidates."""
    facts, rows = _view_facts(), _with(steps, _STEP, by)
    some = F.col("index_extractor").isNotNull() | F.col("index_tiles").isNotNull() | F.col("index_dim").isNotNull()
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    meta = F.concat(F.lit("extractor="), word("index_extractor"), F.lit(", tiles="), word("index_tiles"), F.lit(", feature_dim="), word("index_dim"))
    lines = [
        F.concat(F.lit("### Step "), F.col("step_index").cast("string"), F.lit(": `"), F.coalesce("tool", F.lit("")), F.lit("`\n")), _fact("Reason", F.coalesce(F.nullif(F.col("nav_reason"), F.lit("")), F.lit(NO_REASON))),
        facts["level"], facts["box"], facts["field"], facts["tissue"], _fact("ROI candidate stage", F.col("candidate_stage")), _fact("ROI candidate pipeline", F.col("candidate_pipeline")),
        _fact("Top-K candidates in this view", F.col("candidate_count")), _fact("Candidate source", F.col("candidate_source")), _fact("Candidate warning", F.col("candidate_warning")), F.when(some, _fact("Candidate index meta", meta)),
        F.when(F.col("shown_w").isNotNull() & F.col("shown_h").isNotNull(), _fact("View image size", F.format_string("%d×%d px", "shown_w", "shown_h"))), _picture("Step", "step_index"),
    ]
    return _joined(rows, by, "step_index", lines, "walk")


def markdown_report(runs: DataFrame, marks: DataFrame, steps: DataFrame) -> DataFrame:
    """(run_id, report, summary) of runs (run_id, prompt, final_text[, reasoning]), their marks and their steps; facts that a ledger has no column for are left out. summary is the plain text of prompt and final report."""
    out = runs.join(mark_section(marks), "run_id", "left").join(step_section(steps), "run_id", "left")
    reasoning = F.nullif(F.col("reasoning"), F.lit("")) if "reasoning" in runs.columns else F.lit(None).cast("string")
    text = F.coalesce("final_text", F.lit(""))
    fenced = lambda head, body: F.concat(F.lit(f"{head}\n\n{FENCE}\n"), body, F.lit(f"\n{END}\n"))
    report = F.concat_ws(
        "\n", F.concat(F.lit("# Report ("), F.col("run_id").cast("string"), F.lit(")\n")), fenced(PROMPT, F.coalesce("prompt", F.lit(""))), F.concat(F.lit(f"{FINAL}\n\n"), text, F.lit("\n")), fenced(REASONING, reasoning),
        F.lit(f"{MARKS}\n"), F.coalesce("section", F.lit(f"{NO_MARKS}\n")), F.lit(f"{STEPS}\n"), F.coalesce("walk", F.lit(f"{NO_STEPS}\n")),
    )
    summary = F.concat(F.lit("Prompt\n"), F.trim(F.coalesce("prompt", F.lit(""))), F.lit("\n\nFinal Report\n"), F.trim(text), F.lit("\n"))
    return out.select("run_id", report.alias("report"), summary.alias("summary"))


def write_reports(reports: DataFrame, folder: str) -> None:
    """One folder per run with the report's text."""
    reports.select("run_id", F.col("report").alias("value")).write.mode("overwrite").partitionBy("run_id").text(folder)
