"""Roll-ups of the metrics: one row for each runner, each pair of runners; the report. Metrics stay apart, none is merged
with another, and there is no composite score."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, Window, functions as F

from leafmill.operators import metrics as M
from leafmill.operators.records import KEY
from leafmill.schema import FLOOR_RUNNER


def score(records: DataFrame, floor: str = FLOOR_RUNNER) -> DataFrame:
    """Per runner: papers, means of per-paper medians, sums and pooled ratios. All-zero timings are no timing. The records
    are read once; every metric takes what was written of them."""
    records = M.facts(records)
    r = records.select(*KEY)
    cov = M.coverage(records, floor).groupBy("runner").agg(F.count("*").alias("covered_papers"), F.avg("median_ratio").alias("coverage"), F.sum("dropped_count").alias("dropped_pages"), F.sum("chars_total").alias("chars"))
    order = M.reading_order(records).groupBy("runner").agg(F.avg("monotonic_fraction").alias("order_monotonic"), F.sum("blocks_ending_midword").alias("midword"))
    structure = M.structure_proxy(records).groupBy("runner").agg(F.avg("found_exactly_once").alias("sections_found"))
    tables = M.table_structure(records).groupBy("runner").agg(F.sum("tables").alias("tables"), F.try_divide(F.sum(F.col("empty_cell_ratio") * F.col("cells")), F.sum(F.when(F.col("empty_cell_ratio").isNotNull(), F.col("cells")))).alias("empty_cells"))
    gutter = M.column_interleaving(records).groupBy("runner").agg(F.try_divide(F.sum("spanning"), F.sum("paragraphs")).alias("gutter"), F.try_divide(F.sum("spanning_large"), F.sum("paragraphs_large")).alias("gutter_large"))
    arithmetic = M.table_arithmetic(records).groupBy("runner").agg(F.sum("checked").alias("checked"), F.sum("passed").alias("passed")).withColumn("pass_rate", F.try_divide("passed", "checked"))
    chunks = M.chunk_health(records).groupBy("runner").agg(F.sum("chunks").alias("chunks"), F.avg("median_chars").alias("median_chunk"), F.sum("orphan_chunks").alias("orphans"), F.sum("straddling_chunks").alias("straddling"))
    cost = M.cost(records).groupBy("runner").agg(F.when(F.bool_and(F.col("wall_seconds") == 0), F.lit(None)).otherwise(F.avg("seconds_per_page")).alias("seconds_per_page"))
    out = r.groupBy("runner").agg(F.count("*").alias("papers"))
    for part in (cov, order, structure, tables, gutter, arithmetic, chunks, cost):
        out = out.join(part, "runner", "left")
    return out.na.fill(0, ["covered_papers", "dropped_pages", "chars"])


def worst_papers(records: DataFrame, floor: str = FLOOR_RUNNER, n: int = 5) -> DataFrame:
    """The papers each runner covers worst; ties by paper."""
    c = M.coverage(records, floor).filter(F.col("median_ratio").isNotNull())
    c = c.withColumn("rank", F.row_number().over(Window.partitionBy("runner").orderBy("median_ratio", "paper_id")))
    return c.filter(F.col("rank") <= n).select("runner", "rank", "paper_id", F.bround("median_ratio", 3).alias("median_ratio"))


def pair_agreement(records: DataFrame) -> DataFrame:
    """Of each pair of runners: papers both have, mean of the papers' median agreement."""
    a, b = records.select("paper_id", F.col("runner").alias("left_runner")), records.select("paper_id", F.col("runner").alias("right_runner"))
    shared = a.join(b, "paper_id").filter("left_runner < right_runner").groupBy("left_runner", "right_runner").agg(F.count("*").alias("papers"))
    mean = M.agreement(records).groupBy("left_runner", "right_runner").agg(F.avg("median").alias("median_agreement"))
    return shared.join(mean, ["left_runner", "right_runner"], "left")


def format_cell(value, digits: int = 3) -> str:
    if value is None:
        return "—"
    return f"{value:.{digits}f}" if isinstance(value, float) else str(value)


#: The headings of the report's main table, which readers of the report rely on, with field and digits.
COLUMNS = [
    ("papers", "papers", 0), ("cov. papers", "covered_papers", 0), ("cov. mean-of-medians", "coverage", 3),
    ("dropped pages", "dropped_pages", 0), ("chars", "chars", 0), ("order monotonic", "order_monotonic", 3),
    ("midword", "midword", 0), ("sections/6", "sections_found", 2), ("tables", "tables", 0),
    ("empty cells (pooled)", "empty_cells", 3), ("gutter-span (150ch+)", "gutter_large", 3), ("arith checked", "checked", 0),
    ("arith pass", "pass_rate", 3), ("chunks", "chunks", 0), ("orphans", "orphans", 0), ("s/page", "seconds_per_page", 2),
]


def render(records: DataFrame, floor: str = FLOOR_RUNNER) -> str:
    """The report as Markdown. One row for each runner or pair comes to the driver."""
    runners = score(records, floor).orderBy("runner").collect()
    lines = [f"Coverage is measured against `{floor}`. No column is a quality score; none should be averaged with another.", ""]
    lines += ["| runner | " + " | ".join(h for h, _, _ in COLUMNS) + " |", "|---" * (len(COLUMNS) + 1) + "|"]
    lines += [f"| `{r['runner']}` | " + " | ".join(format_cell(r[f], d) for _, f, d in COLUMNS) + " |" for r in runners]
    lines += ["", "## Cross-runner agreement", "", "| pair | papers | mean of per-paper medians |", "|---|---|---|"]
    lines += [f"| {p['left_runner']} vs {p['right_runner']} | {p['papers']} | {format_cell(p['median_agreement'])} |" for p in pair_agreement(records).orderBy("left_runner", "right_runner").collect()]
    lines += ["", "## Worst papers by coverage", ""]
    worst: dict[str, list[str]] = {r["runner"]: [] for r in runners}
    for w in worst_papers(records, floor).orderBy("runner", "rank").collect():
        worst[w["runner"]].append(f"{w['paper_id']} ({w['median_ratio']})")
    lines += [f"- `{r}`: {', '.join(w) or '—'}" for r, w in worst.items()]
    lines += ["", "## Chunk straddling", ""]
    lines += [f"- `{r['runner']}`: {r['straddling']} chunks cross a section header; median chunk {format_cell(r['median_chunk'], 0)} chars" for r in runners]
    return "\n".join([*lines, ""])


def write_report(records: DataFrame, path: str, floor: str = FLOOR_RUNNER) -> str:
    """Write the report, keeping everything from a "## Findings" heading of the old file on as it is."""
    text, file = "# Extraction report\n\n" + render(records, floor), Path(path)
    old = file.read_text() if file.exists() else ""
    at = old.find("## Findings")
    if at >= 0:
        text = text.rstrip("\n") + "\n\n" + old[at:].rstrip("\n") + "\n"
    file.write_text(text)
    return text
