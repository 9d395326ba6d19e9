"""Views of extraction records: which of them count, their parts, their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from leafmill.functions.text import cell_text
from leafmill.schema import BLOCK_KINDS, TEXT_KINDS
from leafmill.session import drop_redelivered

KEY = ["runner", "paper_id"]


def first_deliveries(records: DataFrame) -> DataFrame:
    """Each record once: the delivery loaded first, one of those loaded at the same time; rows without an id all stay.
    Only (record_id, loaded_at) is shuffled to find out which."""
    return drop_redelivered(records, "record_id", "loaded_at")


def current_records(records: DataFrame) -> DataFrame:
    """One record of each runner and paper: the last run (of equal ones that with the largest id), first delivery. Rows
    without an id, or with a null runner or paper, are no record of one and don't count.

    The winners are found from four narrow columns; rows are then picked by a semi join.
    """
    once = first_deliveries(records.filter(F.col("record_id").isNotNull()))
    last = once.groupBy(*KEY).agg(F.max(F.struct("run_at", "record_id")).alias("w")).filter(F.col("runner").isNotNull() & F.col("paper_id").isNotNull())
    return once.join(last.select("w.record_id"), "record_id", "left_semi")


def blocks(records: DataFrame, *keep: str) -> DataFrame:
    return records.select(*KEY, *keep, F.inline("blocks"))


def tables(records: DataFrame, *keep: str) -> DataFrame:
    return records.select(*KEY, *keep, F.posexplode("tables").alias("table_idx", "t")).select(*KEY, *keep, "table_idx", "t.*")


def cells(records: DataFrame) -> DataFrame:
    """Every cell with its table, row and column; ``n_rows`` and ``n_cols`` are the table's."""
    t = tables(records).select(*KEY, "table_idx", "page", F.col("rows").alias("n_rows"), F.col("cols").alias("n_cols"), F.posexplode("cells").alias("r", "row"))
    return t.select(*KEY, "table_idx", "page", "n_rows", "n_cols", "r", F.posexplode("row").alias("c", "text"))


def chunks(records: DataFrame) -> DataFrame:
    return records.select(*KEY, F.inline("chunks"))


def page_parts(records: DataFrame) -> DataFrame:
    """(runner, paper_id, page, part, text): what stands on each page, blocks in order before tables."""
    text = blocks(records).filter(F.col("kind").isin(*TEXT_KINDS) & (F.col("text") != ""))
    text = text.select(*KEY, "page", F.col("order").cast("bigint").alias("part"), "text")
    grid = tables(records).select(*KEY, "page", (F.col("table_idx") + F.lit(1 << 40)).alias("part"), F.array_join(cell_text(F.col("cells")), " ").alias("text"))
    return text.unionByName(grid.filter("text <> ''"))


def page_texts(records: DataFrame) -> DataFrame:
    """(runner, paper_id, page, text): each page's text as one string."""
    p = page_parts(records).groupBy(*KEY, "page").agg(F.sort_array(F.collect_list(F.struct("part", "text"))).alias("p"))
    return p.select(*KEY, "page", F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("text"))


def all_pages(records: DataFrame) -> DataFrame:
    """``page_texts`` with a row for every page of a record, its text null where nothing stands on it."""
    spine = records.select(*KEY, F.explode(F.sequence(F.lit(1), F.greatest("pages", F.lit(1)))).alias("page"))
    return spine.join(page_texts(records), [*KEY, "page"], "full_outer")


def page_chars() -> Column:
    """A record's characters as an array of (page, n): every page with 0, its text blocks and filled cells."""
    text = F.transform(
        F.filter(F.coalesce("blocks", F.expr("array()")), lambda b: b["kind"].isin(*TEXT_KINDS)),
        lambda b: F.struct(b["page"].alias("page"), F.length(F.coalesce(b["text"], F.lit(""))).cast("bigint").alias("n")),
    )
    grid = F.transform(
        F.coalesce("tables", F.expr("array()")),
        lambda t: F.struct(
            t["page"].alias("page"),
            F.coalesce(F.aggregate(cell_text(t["cells"]), F.lit(0).cast("bigint"), lambda s, c: s + F.length(c)), F.lit(0).cast("bigint")).alias("n"),
        ),
    )
    spine = F.transform(F.sequence(F.lit(1), F.greatest("pages", F.lit(1))), lambda p: F.struct(p.alias("page"), F.lit(0).cast("bigint").alias("n")))
    return F.concat(spine, text, grid)


def chars_per_page(records: DataFrame) -> DataFrame:
    """(runner, paper_id, page, chars): characters of text blocks and filled cells; pages without any have 0, pages beyond
    the record's count are added. Each record's pages are summed inside the record before anything is shuffled."""
    chars = records if "page_chars" in records.columns else records.select(*KEY, page_chars().alias("page_chars"))
    return chars.select(*KEY, F.inline("page_chars")).groupBy(*KEY, "page").agg(F.sum("n").alias("chars"))


def _sorted_fields(value: Column, kind: T.DataType) -> Column:
    """``value`` with the fields of its structs in alphabetical order, at every depth."""
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _sorted_fields(x, kind.elementType))
    if isinstance(kind, T.StructType):
        fields = F.struct(*[_sorted_fields(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
        return F.when(value.isNotNull(), fields)
    return value


def content_hash(records: DataFrame) -> Column:
    """SHA-256 of a record's content: all fields but its timing as JSON, keys in alphabetical order at every depth."""
    fields = ["blocks", "chunks", "pages", "paper_id", "pdf_sha256", "runner", "runner_version", "tables"]
    ordered = [_sorted_fields(F.col(f), records.schema[f].dataType).alias(f) for f in fields]
    return F.sha2(F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"}), 256)


def violation(order_is_dense: bool = False) -> Column:
    """The first invariant a record breaks, or null: missing fields, pages, blocks (kind, text, page, order, bbox), their
    order, tables (row and column counts), chunks (text, chars, block ids)."""
    b = F.coalesce("blocks", F.expr("array()"))
    t = F.coalesce("tables", F.expr("array()"))
    c = F.coalesce("chunks", F.expr("array()"))
    orders = F.transform(b, lambda x: x["order"])
    no = lambda e: ~F.coalesce(e, F.lit(False))
    bad_box = lambda x: x["bbox"].isNotNull() & (no(F.size(x["bbox"]) == 4) | F.exists(x["bbox"], lambda v: v.isNull()))
    steps = [
        (F.col("paper_id").isNull() | F.col("runner").isNull() | F.col("runner_version").isNull() | F.col("pdf_sha256").isNull(), "field"),
        (F.col("blocks").isNull() | F.col("tables").isNull() | F.col("chunks").isNull() | F.col("wall_seconds").isNull(), "field"),
        (no(F.col("pages") >= 1), "pages"),
        (F.exists(b, lambda x: no(x["kind"].isin(*BLOCK_KINDS))), "block kind"),
        (F.exists(b, lambda x: x["text"].isNull()), "block text"),
        (F.exists(b, lambda x: no(x["page"] >= 1)), "block page"),
        (F.exists(b, lambda x: x["order"].isNull()), "block order"),
        (F.exists(b, bad_box), "block bbox"),
        (F.array_sort(orders) != orders, "blocks not sorted"),
        (F.exists(t, lambda x: x["page"].isNull() | x["rows"].isNull() | x["cols"].isNull()), "table fields"),
        (F.exists(t, lambda x: no(F.size(x["cells"]) == x["rows"])), "table rows"),
        (F.exists(t, lambda x: F.exists(x["cells"], lambda r: no(F.size(r) == x["cols"]))), "table cols"),
        (F.exists(c, lambda x: x["text"].isNull() | no(F.length(x["text"]) == x["chars"])), "chunk text"),
        (F.exists(c, lambda x: no(F.size(F.array_except(x["block_ids"], orders)) == 0)), "chunk block ids"),
    ]
    if order_is_dense:
        steps.append((no(orders == F.transform(b, lambda _, i: i)), "order not dense"))
    out = F
    for test, name in steps:
        out = out.when(test, name)
    return out.otherwise(F.lit(None).cast("string"))


def latest_lines(lines: DataFrame, key: list[str], line: str = "line_no") -> DataFrame:
    """Of several lines with one key the last; for results files, where later lines replace earlier ones."""
    w = Window.partitionBy(*key).orderBy(F.desc(line))
    return lines.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
