"""From words to lines, blocks, tables and chunks: the structuring steps shared by all extractors."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from leafmill.functions.text import classify, strip
from leafmill.schema import CHUNKABLE_KINDS

LINE_BUCKET, GAP_FACTOR, DEFAULT_GAP, BUDGET = 2.0, 1.6, 10.0, 1200
FRONT_MATTER = "(front matter)"
#: The layout model's labels and the block kinds they mean.
LABEL_KINDS = {
    "title": "section_header", "section_header": "section_header", "caption": "caption", "text": "paragraph",
    "paragraph": "paragraph", "list_item": "paragraph", "footnote": "other", "page_header": "other",
    "page_footer": "other", "formula": "other", "code": "other", "reference": "paragraph",
}


def _box(*c: Column) -> Column:
    return F.array(*[x.cast("double") for x in c])


def words_to_lines(words: DataFrame, key: list[str]) -> DataFrame:
    """Words (*key, page, seq, x0, top, x1, bottom, text) whose tops round (half to even) to one bucket, as lines left to
    right with the union of their boxes; ``line`` numbers a page's lines from the top."""
    b = words.withColumn("bucket", F.bround(F.col("top") / LINE_BUCKET))
    row = F.sort_array(F.collect_list(F.struct("x0", "seq", "text")))
    g = b.groupBy(*key, "page", "bucket").agg(row.alias("w"), F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"))
    line = F.row_number().over(Window.partitionBy(*key, "page").orderBy("bucket")) - 1
    return g.select(*key, "page", line.alias("line"), F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("text"), _box(F.col("x0"), F.col("top"), F.col("x1"), F.col("bottom")).alias("bbox"))


def items_to_lines(items: DataFrame, key: list[str]) -> DataFrame:
    """Text items in bottom-up coordinates (*key, page, seq, x, baseline, width, height, page_height, text) as lines:
    blank items drop, tops are flipped and rounded half up, runs of white space become one space, empty lines drop."""
    i = items.filter(strip(F.col("text")) != "").withColumn("top", F.col("page_height") - F.col("baseline") - F.col("height"))
    i = i.withColumn("bucket", F.floor(F.col("top") / LINE_BUCKET + 0.5))
    row = F.sort_array(F.collect_list(F.struct("x", "seq", "text")))
    g = i.groupBy(*key, "page", "bucket").agg(row.alias("w"), F.min("x").alias("x0"), F.min("top").alias("top"), F.max(F.col("x") + F.col("width")).alias("x1"), F.max(F.col("top") + F.col("height")).alias("bottom"))
    text = strip(F.regexp_replace(F.array_join(F.transform("w", lambda x: x["text"]), " "), r"(?U)\s+", " "))
    g = g.withColumn("text", text).filter("text <> ''")
    line = F.row_number().over(Window.partitionBy(*key, "page").orderBy("bucket")) - 1
    return g.select(*key, "page", line.alias("line"), "text", _box(F.col("x0"), F.col("top"), F.col("x1"), F.col("bottom")).alias("bbox"))


def join_lines(lines: Column) -> Column:
    """Lines as one text: a line's final hyphen joins it to the next, otherwise a space does."""
    add = lambda a, x: F.when(a == "", x).when(a.endswith("-"), F.concat(F.substring(a, F.lit(1), F.length(a) - 1), x)).otherwise(F.concat(a, F.lit(" "), x))
    return F.aggregate(F.transform(lines, strip), F.lit(""), add)


def union_box(boxes: Column) -> Column:
    """The smallest box around all, or null without any."""
    b = F.filter(boxes, lambda x: x.isNotNull())
    side = lambda i, f: f(F.transform(b, lambda x: F.get(x, F.lit(i))))
    return F.when(F.size(b) > 0, F.array(side(0, F.array_min), side(1, F.array_min), side(2, F.array_max), side(3, F.array_max)))


def group_lines(lines: DataFrame, key: list[str]) -> DataFrame:
    """Lines (*key, page, line, text, bbox) as blocks (*key, page, block, kind, text, bbox).

    A block begins where the gap to the line before exceeds 1.6 times the page's median line height, or where a line or
    the one before isn't a paragraph line. Gaps and islands over one window of the page's lines.
    """
    page = [*key, "page"]
    w = Window.partitionBy(*page).orderBy("line")
    ls = lines.filter(strip(F.col("text")) != "").withColumn("kind", classify(F.col("text")))
    top, bottom = F.get("bbox", F.lit(1)), F.get("bbox", F.lit(3))
    ls = ls.withColumn("limit", F.coalesce(F.percentile(bottom - top, 0.5).over(Window.partitionBy(*page)) * GAP_FACTOR, F.lit(DEFAULT_GAP)))
    gap = F.coalesce(top - F.lag(bottom).over(w), F.lit(0.0))
    begins = F.lag("line").over(w).isNull() | (gap > F.col("limit")) | (F.col("kind") != "paragraph") | (F.lag("kind").over(w) != "paragraph")
    ls = ls.withColumn("block", F.sum(begins.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    g = ls.groupBy(*page, "block").agg(F.sort_array(F.collect_list(F.struct("line", "text", "bbox"))).alias("l"))
    text = join_lines(F.transform("l", lambda x: x["text"]))
    return g.select(*page, "block", classify(text).alias("kind"), text.alias("text"), union_box(F.transform("l", lambda x: x["bbox"])).alias("bbox"))


def map_label(label: Column, text: Column) -> Column:
    """Block kind of a layout label; unknown ones are other, paragraphs are looked at again by their text."""
    kinds = F.create_map(*[F.lit(x) for pair in LABEL_KINDS.items() for x in pair])
    kind = F.coalesce(F.try_element_at(kinds, label), F.lit("other"))
    return F.when(kind == "paragraph", classify(text)).otherwise(kind)


def flip_bbox(box: Column, height: Column) -> Column:
    """A provenance box with its origin top left, or null without a box or page height; the origin is bottom left unless
    named otherwise."""
    t, b = box["t"], box["b"]
    down = F.coalesce(box["coord_origin"], F.lit("BOTTOMLEFT")) != "TOPLEFT"
    y0, y1 = F.when(down, height - t).otherwise(t), F.when(down, height - b).otherwise(b)
    known = box.isNotNull() & (~down | (F.coalesce(height, F.lit(0.0)) > 0))
    return F.when(known, F.array(box["l"], F.least(y0, y1), box["r"], F.greatest(y0, y1)))


def pad_rows(cells: Column) -> Column:
    """Rows of equal length, short ones filled with empty cells; null cells become empty."""
    wide = F.coalesce(F.array_max(F.transform(cells, F.size)), F.lit(0))
    return F.transform(cells, lambda r: F.concat(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), F.array_repeat(F.lit(""), F.greatest(wide - F.size(r), F.lit(0)))))


def build_grid(data: Column) -> Column:
    """A table's cells: its grid if it has one, else its cells put at their places; cells outside drop, later ones win."""
    placed = F.coalesce(data["table_cells"], F.expr("array()"))
    rows = F.greatest(F.coalesce(data["num_rows"], F.array_max(F.transform(placed, lambda c: c["end_row_offset_idx"])), F.lit(0)), F.lit(0))
    cols = F.greatest(F.coalesce(data["num_cols"], F.array_max(F.transform(placed, lambda c: c["end_col_offset_idx"])), F.lit(0)), F.lit(0))
    span = lambda n: F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i < n)

    def at(r: Column, c: Column) -> Column:
        here = F.filter(placed, lambda x: (x["start_row_offset_idx"] == r) & (x["start_col_offset_idx"] == c))
        return F.coalesce(F.element_at(F.when(F.size(here) > 0, here), -1)["text"], F.lit(""))

    scattered = F.transform(span(rows), lambda r: F.transform(span(cols), lambda c: at(r, c)))
    grid = F.transform(data["grid"], lambda r: F.transform(r, lambda c: F.coalesce(c["text"], F.lit(""))))
    return F.when(F.size(data["grid"]) > 0, grid).otherwise(scattered)


_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_CHUNK = T.ArrayType(T.StructType([T.StructField("id", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("block_ids", T.ArrayType(T.IntegerType())), T.StructField("section", T.StringType()), T.StructField("chars", T.IntegerType())]))


def pack(blocks: list[dict], budget: int = BUDGET) -> list[dict]:
    """One document's chunks: headers end a chunk and name the section, sentences fill chunks up to the budget."""
    out, buffer, ids, used, section = [], [], [], 0, FRONT_MATTER

    def flush() -> None:
        nonlocal buffer, ids, used
        if buffer:
            text = " ".join(buffer)
            out.append({"id": len(out), "text": text, "block_ids": list(dict.fromkeys(ids)), "section": section, "chars": len(text)})
        buffer, ids, used = [], [], 0

    for b in blocks or []:
        if b["kind"] == "section_header":
            flush()
            section = (b["text"] or "").strip() or section
        elif b["kind"] in CHUNKABLE_KINDS:
            for s in filter(None, map(str.strip, _SENTENCE.split(b["text"] or ""))):
                if buffer and used + len(s) + 1 > budget:
                    flush()
                used += len(s) + bool(buffer)
                buffer.append(s)
                ids.append(b["order"])
    flush()
    return out


def chunk_blocks(blocks: Column, budget: int = BUDGET) -> Column:
    """Chunks of an array of blocks (in reading order). Greedy packing is a sequential fold over one document: it runs row
    by row in Arrow batches, without a shuffle and in linear time, where a fold in SQL would copy its growing state."""

    @F.arrow_udf(_CHUNK)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if b is None else pack(b, budget) for b in batch.to_pylist()], pa.list_(pa.struct([("id", pa.int32()), ("text", pa.string()), ("block_ids", pa.list_(pa.int32())), ("section", pa.string()), ("chars", pa.int32())])))

    return run(blocks)


def finish(blocks: DataFrame, meta: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Blocks and meta data as records: dense orders, chunks, seconds rounded to three places. ``meta`` has the other
    fields; documents without blocks keep an empty list."""
    b = F.struct("page", "kind", "text", "bbox")
    g = blocks.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*order, b.alias("b")))).alias("s"))
    numbered = F.transform("s", lambda x, i: F.struct(x["b"]["page"].alias("page"), x["b"]["kind"].alias("kind"), x["b"]["text"].alias("text"), x["b"]["bbox"].alias("bbox"), i.alias("order")))
    out = meta.join(g.select(*key, numbered.alias("blocks")), key, "left")
    empty = F.array().cast("array<struct<page:int,kind:string,text:string,bbox:array<double>,order:int>>")
    out = out.withColumn("blocks", F.coalesce("blocks", empty)).withColumn("chunks", chunk_blocks(F.col("blocks")))
    return out.withColumn("wall_seconds", F.bround("wall_seconds", 3))
