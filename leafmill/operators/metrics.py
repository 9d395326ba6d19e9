"""Label-free metrics of extraction records, one row for each runner and paper.

Metrics are never averaged with each other, and absent is null, never a guess. All take ``current_records``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from leafmill.functions.text import ORPHAN_CHARS, SECTION_PATTERNS, TOTAL, cell_text, level, parse_number, strip
from leafmill.operators.records import KEY, cells, chars_per_page, page_chars, tables
from leafmill.schema import FLOOR_RUNNER, TEXT_KINDS
from leafmill.session import cut

MIN_FLOOR_CHARS, DROPPED_BELOW, SLACK = 50, 0.10, 2.0
GUTTER_LEFT, GUTTER_RIGHT, LARGE = 0.35, 0.65, 150


def page_coverage(records: DataFrame, floor: str = FLOOR_RUNNER) -> DataFrame:
    """(runner, paper_id, page, ratio): a page's characters over those the floor runner found, where those are enough."""
    chars = chars_per_page(records)
    base = chars.filter((F.col("runner") == floor) & (F.col("chars") >= MIN_FLOOR_CHARS)).select("paper_id", "page", F.col("chars").alias("floor_chars"))
    papers = records.select(*KEY)
    pages = papers.join(base, "paper_id")
    both = pages.join(chars, [*KEY, "page"], "left")
    return both.select(*KEY, "page", (F.coalesce("chars", F.lit(0)) / F.col("floor_chars")).alias("ratio"))


def coverage(records: DataFrame, floor: str = FLOOR_RUNNER) -> DataFrame:
    """Coverage of each record whose paper the floor runner has, too; median and minimum are null where no page counts."""
    total = chars_per_page(records).groupBy(*KEY).agg(F.sum("chars").alias("chars_total"))
    has_floor = records.filter(F.col("runner") == floor).select("paper_id").distinct()
    r = page_coverage(records, floor).groupBy(*KEY).agg(
        F.count("*").alias("pages_compared"),
        F.percentile("ratio", 0.5).alias("median_ratio"),
        F.min("ratio").alias("min_ratio"),
        F.sort_array(F.collect_list(F.when(F.col("ratio") < DROPPED_BELOW, F.col("page")))).alias("dropped_pages"),
        F.count_if(F.col("ratio") < DROPPED_BELOW).alias("dropped_count"),
    )
    out = total.join(has_floor, "paper_id", "left_semi").join(r, KEY, "left")
    return out.withColumns({"pages_compared": F.coalesce("pages_compared", F.lit(0)), "dropped_count": F.coalesce("dropped_count", F.lit(0)), "dropped_pages": F.coalesce("dropped_pages", F.array().cast("array<int>"))})


def _codes(text: str) -> np.ndarray:
    """The distinct 3-grams of a text of a-z, 0-9 and spaces as numbers: intersecting numbers costs a fraction of strings."""
    c = _CODES[np.frombuffer(text.encode(), np.uint8)]
    return np.unique(c[:-2] * 1369 + c[1:-1] * 37 + c[2:]) if len(c) >= 3 else c[:0]


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _gram_codes(texts: pa.Array) -> pa.Array:
    return pa.array([_codes(t or "").tolist() for t in texts.to_pylist()], pa.list_(pa.int32()))


_GRAMS = T.ArrayType(T.StructType([T.StructField("page", T.IntegerType()), T.StructField("grams", T.ArrayType(T.ShortType()))]))


@F.arrow_udf(_GRAMS)
def _page_grams(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Of each page of a record, from its parts (page, text) in order, the codes of its text."""
    for pages, parts in batches:
        page, grams, ends, offsets = [], [], [0], [0]
        for n, ps in zip(pages.to_pylist(), parts.to_pylist()):
            texts: dict[int, list[str]] = {}
            for p in ps or []:
                texts.setdefault(p["page"], []).append(p["text"])
            for at in range(1, max(n or 1, 1) + 1):
                g = _codes(" ".join(texts.get(at, [])))
                page.append(at)
                grams.append(g)
                ends.append(ends[-1] + len(g))
            offsets.append(len(page))
        codes = np.concatenate(grams) if grams else np.empty(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((codes - 32768).astype(np.int16)))
        yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(page, pa.int32()), lists], ["page", "grams"]))


_CODES = np.zeros(128, np.int64)
for _n, _c in enumerate(b" abcdefghijklmnopqrstuvwxyz0123456789"):
    _CODES[_c] = _n


def page_agreement(records: DataFrame) -> DataFrame:
    """(left_runner, right_runner, paper_id, page, score): similarity of the 3-gram sets of one page of two runners, over
    the pages both have. Each page's grams are made once, inside the record, and written; the join of them is on (paper,
    page), and no text is shuffled."""
    part = lambda page, text: F.struct(page.alias("page"), level(text).alias("text"))
    text = F.transform(F.array_sort(F.filter(F.coalesce("blocks", F.expr("array()")), lambda b: b["kind"].isin(*TEXT_KINDS) & (b["text"] != "")), lambda a, b: a["order"] - b["order"]), lambda b: part(b["page"], b["text"]))
    grid = F.transform(F.coalesce("tables", F.expr("array()")), lambda t: part(t["page"], F.array_join(cell_text(t["cells"]), " ")))
    parts = F.filter(F.concat(text, grid), lambda p: p["text"] != "")
    g = cut(records.select(*KEY, F.inline(_page_grams("pages", parts))))
    a = g.select("paper_id", "page", F.col("runner").alias("left_runner"), F.col("grams").alias("left_grams"))
    b = g.select("paper_id", "page", F.col("runner").alias("right_runner"), F.col("grams").alias("right_grams"))
    both = a.join(b, ["paper_id", "page"]).filter("left_runner < right_runner")
    common = F.size(F.array_intersect("left_grams", "right_grams"))
    union = F.size("left_grams") + F.size("right_grams") - common
    return both.filter(union > 0).select("left_runner", "right_runner", "paper_id", "page", (common / union).alias("score"))


def agreement(records: DataFrame, worst: int = 5) -> DataFrame:
    """Of each pair of runners and paper: the median page score and the worst pages, ascending, ties by page."""
    order = Window.partitionBy("left_runner", "right_runner", "paper_id").orderBy("score", "page")
    p = page_agreement(records).withColumn("n", F.row_number().over(order))
    low = F.when(F.col("n") <= worst, F.struct("n", "page", F.bround("score", 3).alias("score")))
    p = p.groupBy("left_runner", "right_runner", "paper_id").agg(F.count("*").alias("pages_compared"), F.percentile("score", 0.5).alias("median"), F.sort_array(F.collect_list(low)).alias("low"))
    pick = lambda f: F.transform("low", lambda x: x[f])
    return p.select("left_runner", "right_runner", "paper_id", "pages_compared", "median", pick("page").alias("worst_pages"), pick("score").alias("worst_scores"))


def row_metrics(records: DataFrame, *keep: str) -> DataFrame:
    """(runner, paper_id, *keep, reading_order, structure, health): the metrics that a record's own row tells, each as a struct,
    from one pass over the records; what isn't asked for isn't computed. No shuffle or window is needed."""
    none = F.expr("array()")
    kind = lambda k: F.filter(F.coalesce("blocks", none), lambda b: b["kind"] == k)
    ordered = F.array_sort(F.filter("blocks", lambda b: b["bbox"].isNotNull() & (F.size(b["bbox"]) > 0)), lambda a, b: a["order"] - b["order"])
    heads = F.coalesce(F.transform(kind("section_header"), lambda b: b["order"]), F.array().cast("array<int>"))
    r = records.select(*KEY, *keep, "blocks", ordered.alias("boxed"), F.transform(kind("section_header"), lambda b: b["text"]).alias("h"), heads.alias("heads"), F.coalesce("chunks", none).alias("k"))
    return r.select(*KEY, *keep, F.struct(*_reading_order()).alias("reading_order"), F.struct(*_structure()).alias("structure"), F.struct(*_health()).alias("health"))


def _reading_order() -> list[Column]:
    at = lambda i, f: F.get(F.col("boxed"), i)[f]
    box = lambda i, k: F.get(at(i, "bbox"), F.lit(k))

    def forward(i):
        same = at(i, "page") == at(i - 1, "page")
        on = (box(i, 1) >= box(i - 1, 1) - SLACK) | (box(i, 0) > box(i - 1, 2))
        return F.coalesce(F.when(same, on).otherwise(at(i, "page") > at(i - 1, "page")), F.lit(False)).cast("int")

    n = F.greatest(F.size("boxed") - 1, F.lit(0))
    ok = F.aggregate(F.transform(F.expr("slice(boxed, 1, greatest(size(boxed) - 1, 0))"), lambda _, i: forward(i + 1)), F.lit(0), lambda s, x: s + x)
    midword = F.size(F.filter("blocks", lambda b: (b["kind"] == "paragraph") & strip(b["text"]).rlike("(-|[a-z])$")))
    return [
        F.greatest(F.size("blocks"), F.lit(0)).alias("blocks"),
        F.greatest(F.size("boxed"), F.lit(0)).alias("blocks_with_bbox"),
        F.when(n > 0, ok / n).alias("monotonic_fraction"),
        F.greatest(midword, F.lit(0)).alias("blocks_ending_midword"),
    ]


def _structure() -> list[Column]:
    def matching(p: str):
        return F.size(F.filter("h", lambda t: F.coalesce(t.rlike(rf"(?i)(?U)\b({p})\b"), F.lit(False))))

    count = {n: matching(p) for n, p in SECTION_PATTERNS.items()}
    once = sum((F.when(c == 1, 1).otherwise(0) for c in count.values()), F.lit(0))
    missing = F.filter(F.array(*[F.when(c == 0, F.lit(n)) for n, c in count.items()]), lambda x: x.isNotNull())
    return [F.size("h").alias("section_headers"), *[c.alias(f"{n}_headers") for n, c in count.items()], once.alias("found_exactly_once"), missing.alias("missing")]


def _health() -> list[Column]:
    chars = F.sort_array(F.transform("k", lambda c: c["chars"]))
    n = F.size("k")
    at = lambda f: F.get(chars, F.least(n - 1, F.floor(n * F.lit(f)).cast("int")))
    median = F.when(n > 0, (F.get(chars, F.floor((n - 1) / 2).cast("int")) + F.get(chars, F.floor(n / 2).cast("int"))) / 2)
    some = lambda test: F.size(F.filter("k", test))
    first = lambda c: F.substring(c["text"], 1, 1)
    over = lambda c: F.exists("heads", lambda h: (h > F.array_min(c["block_ids"])) & (h < F.array_max(c["block_ids"])))
    return [
        n.alias("chunks"),
        median.alias("median_chars"),
        at(0.1).alias("p10_chars"),
        at(0.9).alias("p90_chars"),
        some(lambda c: c["chars"] < ORPHAN_CHARS).alias("orphan_chunks"),
        some(lambda c: (F.lower(first(c)) == first(c)) & (F.upper(first(c)) != first(c))).alias("midsentence_starts"),
        some(lambda c: F.coalesce(over(c), F.lit(False))).alias("straddling_chunks"),
    ]


def reading_order(records: DataFrame) -> DataFrame:
    """How often a block stands after the one before it, and how many paragraphs end inside a word."""
    return (records if "reading_order" in records.columns else row_metrics(records)).select(*KEY, "reading_order.*")


def structure_proxy(records: DataFrame) -> DataFrame:
    """Which of six sections are found once, and which are missing."""
    return (records if "structure" in records.columns else row_metrics(records)).select(*KEY, "structure.*")


def chunk_health(records: DataFrame) -> DataFrame:
    """Sizes of chunks, orphans, chunks that begin inside a sentence or run over a section header."""
    return (records if "health" in records.columns else row_metrics(records)).select(*KEY, "health.*")


def paragraph_boxes() -> Column:
    """A record's paragraphs with a box as an array of (page, n, x0, x1)."""
    p = F.filter(F.coalesce("blocks", F.expr("array()")), lambda b: (b["kind"] == "paragraph") & (F.size(b["bbox"]) == 4))
    return F.transform(p, lambda b: F.struct(b["page"].alias("page"), F.length(b["text"]).alias("n"), F.get(b["bbox"], F.lit(0)).alias("x0"), F.get(b["bbox"], F.lit(2)).alias("x1")))


def facts(records: DataFrame) -> DataFrame:
    """All that the metrics need of the records, from one pass and without their texts: ``row_metrics``, characters by
    page, boxes of paragraphs, tables. Metrics take these rows as they take records."""
    keep = ["pages", "wall_seconds", "tables"]
    r = records.withColumns({"page_chars": page_chars(), "paragraph_boxes": paragraph_boxes()})
    return cut(row_metrics(r, *keep, "page_chars", "paragraph_boxes"))


def cost(records: DataFrame) -> DataFrame:
    return records.select(*KEY, "wall_seconds", F.try_divide("wall_seconds", "pages").alias("seconds_per_page"))


def total_series(records: DataFrame) -> DataFrame:
    """Every labelled total with the sum and number of the values it should add up.

    Row axis: a row below the first with a total label in its first two columns sums each column's numbers below the first
    row and above it. Column axis: a column after the first with a label in its first two rows sums each row's numbers
    after the first column and before it. Earlier totals are values, too.
    """
    c = cells(records).withColumns({"value": parse_number(F.col("text")), "label": F.coalesce(F.col("text").rlike(TOTAL), F.lit(False))})
    table = [*KEY, "table_idx"]
    row = Window.partitionBy(*table, "r")
    col = Window.partitionBy(*table, "c")
    above = col.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    before = row.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    down = F.when(F.col("r") >= 1, F.col("value"))
    across = F.when(F.col("c") >= 1, F.col("value"))
    c = c.withColumns({
        "row_total": F.max((F.col("c") < 2) & F.col("label")).over(row) & (F.col("r") >= 1),
        "col_total": F.max((F.col("r") < 2) & F.col("label")).over(col) & (F.col("c") >= 1),
        "row_sum": F.sum(down).over(above), "row_n": F.count(down).over(above),
        "col_sum": F.sum(across).over(before), "col_n": F.count(across).over(before),
    })
    keep = [*table, "page", "r", "c"]
    rows = c.filter("row_total AND value IS NOT NULL AND row_n >= 2").select(*keep, F.lit("row").alias("axis"), F.col("row_sum").alias("summed"), F.col("value").alias("printed"))
    cols = c.filter("col_total AND value IS NOT NULL AND col_n >= 2").select(*keep, F.lit("col").alias("axis"), F.col("col_sum").alias("summed"), F.col("value").alias("printed"))
    s = rows.unionByName(cols)
    limit = F.greatest(F.abs("printed") * 0.01, F.lit(0.01))
    return s.withColumn("passed", F.abs(F.col("summed") - F.col("printed")) <= limit)


def table_arithmetic(records: DataFrame, failures: int = 20) -> DataFrame:
    """How many labelled totals are right; the first failures of each record, rows before columns of each table."""
    s = total_series(records)
    place = F.struct("table_idx", F.when(F.col("axis") == "row", 0).otherwise(1).alias("a"), F.when(F.col("axis") == "row", F.col("r")).otherwise(F.col("c")).alias("x"), F.when(F.col("axis") == "row", F.col("c")).otherwise(F.col("r")).alias("y"), "page", "axis", "r", "c", F.bround("summed", 4).alias("summed"), "printed")
    g = s.groupBy(*KEY).agg(F.count("*").alias("checked"), F.count_if("passed").alias("passed"), F.slice(F.sort_array(F.collect_list(F.when(~F.col("passed"), place))), 1, failures).alias("failures"))
    out = records.select(*KEY).join(g, KEY, "left")
    return out.select(*KEY, F.coalesce("checked", F.lit(0)).alias("checked"), F.coalesce("passed", F.lit(0)).alias("passed"), F.try_divide("passed", "checked").alias("pass_rate"), F.transform("failures", lambda f: F.struct(f["table_idx"].alias("table"), f["page"].alias("page"), f["axis"].alias("axis"), f["r"].alias("row"), f["c"].alias("col"), f["summed"].alias("summed"), f["printed"].alias("printed"))).alias("failures"))


def table_structure(records: DataFrame) -> DataFrame:
    """Tables, cells, shares of empty and of numeric cells, median rows and columns; null without tables or cells."""
    t = tables(records).groupBy(*KEY).agg(F.count("*").alias("tables"), F.sum(F.col("rows") * F.col("cols")).alias("cells"), F.percentile("rows", 0.5).alias("median_rows"), F.percentile("cols", 0.5).alias("median_cols"))
    blank = F.coalesce(strip(F.col("text")), F.lit("")) == ""
    c = cells(records).groupBy(*KEY).agg(F.count("*").alias("n"), F.count_if(blank).alias("empty"), F.count_if(F.col("text").rlike(r"(?U)\d")).alias("numeric"))
    out = records.select(*KEY).join(t, KEY, "left").join(c, KEY, "left")
    return out.select(*KEY, F.coalesce("tables", F.lit(0)).alias("tables"), F.coalesce("cells", F.lit(0)).alias("cells"), F.when(F.col("cells") > 0, F.try_divide("empty", "n")).alias("empty_cell_ratio"), F.when(F.col("cells") > 0, F.try_divide("numeric", "n")).alias("numeric_cell_ratio"), *[F.when(F.col("cells") > 0, F.col(m)).alias(m) for m in ("median_rows", "median_cols")])


def column_interleaving(records: DataFrame, min_chars: int = LARGE) -> DataFrame:
    """Paragraphs that span the gutter between two columns, of all and of large ones."""
    b = records if "paragraph_boxes" in records.columns else records.select(*KEY, paragraph_boxes().alias("paragraph_boxes"))
    b = b.select(*KEY, F.inline("paragraph_boxes")).withColumn("width", F.max("x1").over(Window.partitionBy(*KEY, "page"))).filter("width > 0")
    spans = (F.col("x0") < GUTTER_LEFT * F.col("width")) & (F.col("x1") > GUTTER_RIGHT * F.col("width"))
    large = F.col("n") >= min_chars
    g = b.groupBy(*KEY).agg(F.count("*").alias("paragraphs"), F.count_if(spans).alias("spanning"), F.count_if(large).alias("paragraphs_large"), F.count_if(spans & large).alias("spanning_large"))
    out = records.select(*KEY).join(g, KEY, "left").na.fill(0, ["paragraphs", "spanning", "paragraphs_large", "spanning_large"])
    return out.withColumns({"ratio": F.try_divide("spanning", "paragraphs"), "ratio_large": F.try_divide("spanning_large", "paragraphs_large")})
