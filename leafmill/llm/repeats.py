"""Lines repeated across the documents of one source.

Lines are compared in a normal form (digits removed, letter case and white space levelled). Each line is cut into chunks
where a rolling gear hash of its last characters says so, wherever in the line that is; a line's ends are cuts, too,
since the line is the unit that is removed. Distinct papers are counted for each (source, chunk); a line all of whose
chunks are repeated excessively is a candidate, and only candidates are counted as whole lines, exactly. Chunks and lines
travel as hashes: no text is shuffled. A line that repeats can't be lost, for equal lines have equal chunks.

Defined cases: records without a source have no site, so none of their lines counts; a null paper counts as no paper; null
and empty blocks have no lines; redelivered records change no count, as papers are counted once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from leafmill.session import cut, small_or_shuffled

#: Characters the rolling hash sees; a cut falls where its lowest CUT_BITS bits are zero.
WINDOW, CUT_BITS = 16, 6
#: A line is repeated excessively if it stands in this many papers of its source and in this share of them.
MIN_PAPERS, MIN_SHARE = 3, 5
SKIPPED_KINDS = ("section_header", "table")


def normal_line(line: Column) -> Column:
    """The form in which two lines are the same."""
    bare = F.regexp_replace(line, r"\p{Nd}+", "")
    return F.trim(F.regexp_replace(F.lower(bare), r"(?U)\s+", " "))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunk_lines(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the content-defined chunks' hashes of all lines, and where each line's begin."""
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(chars):
        return np.empty(0, np.int64), np.zeros(len(lines) + 1, np.int64)
    begins = np.cumsum(lengths) - lengths
    value = _mix(chars + np.uint64(0x9E3779B97F4A7C15))
    gear = np.zeros(len(chars), np.uint64)
    for back in range(min(WINDOW, len(chars))):
        gear[back:] += value[: len(value) - back] << np.uint64(back)
    at_cut = (_mix(gear) & np.uint64((1 << CUT_BITS) - 1)) == 0
    at_cut &= np.arange(len(chars)) - np.repeat(begins, lengths) >= WINDOW - 1  # the window lies within the line
    starts = np.zeros(len(chars), bool)
    starts[1:] = at_cut[:-1]
    starts[begins[lengths > 0]] = True
    first = np.flatnonzero(starts)
    sizes = np.diff(np.append(first, len(chars)))
    place = np.arange(len(chars)) - np.repeat(first, sizes)
    powers = np.cumprod(np.full(int(sizes.max()), 0x5851F42D4C957F2D, np.uint64))
    hashes = _mix(np.add.reduceat(value * powers[place], first) + sizes.astype(np.uint64)).view(np.int64)
    return hashes, np.append(np.searchsorted(first, begins), len(first))


@F.arrow_udf(T.ArrayType(T.LongType()))
def chunk_hashes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        hashes, offsets = chunk_lines([x or "" for x in batch.to_pylist()])
        yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes, pa.int64()))


def line_table(records: DataFrame) -> DataFrame:
    """Each line that may count: its place, the hashes of its source, paper and normal form, and its chunks."""
    blocks = records.filter(F.col("source").isNotNull()).select("record_id", "source", "paper_id", F.inline("blocks"))
    blocks = blocks.filter(F.col("text").isNotNull() & ~F.coalesce(F.col("kind").isin(*SKIPPED_KINDS), F.lit(False)))
    lines = blocks.select(
        "record_id",
        F.col("order").alias("block_order"),
        F.xxhash64("source").alias("site"),
        F.when(F.col("paper_id").isNotNull(), F.xxhash64("paper_id")).alias("paper"),
        F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"),
    )
    lines = lines.withColumn("line", normal_line(F.col("line"))).filter(F.col("line").rlike(r"\p{L}\P{L}+\p{L}+\P{L}+\p{L}"))
    return lines.select(
        "record_id",
        "block_order",
        "line_no",
        "site",
        "paper",
        F.xxhash64("line").alias("key"),
        F.xxhash64(F.lit(1), "line").alias("key2"),
        chunk_hashes("line").alias("chunks"),
    )


def _excessive(counted: DataFrame, what: list[str], papers: DataFrame) -> DataFrame:
    """The rows of (site, *what, paper) that stand in enough papers of their site. Two steps, both combined before the
    shuffle, so that a line in every paper of a hot source is no hot group."""
    distinct = counted.filter(F.col("paper").isNotNull()).distinct()
    often = distinct.groupBy("site", *what).agg(F.count("*").alias("papers")).filter(F.col("papers") >= MIN_PAPERS)
    return often.join(papers, "site").filter(F.col("papers") * MIN_SHARE >= F.col("site_papers")).drop("site_papers")


def repeated_lines(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, repeated): the cut line table, and the lines (site, key, key2, papers) repeated excessively.

    At most MIN_SHARE times the mean number of a paper's lines can be excessive in a site, whatever the data's size; the
    table is broadcast only where its counted size is small.
    """
    papers = records.filter(F.col("source").isNotNull() & F.col("paper_id").isNotNull())
    papers = papers.select(F.xxhash64("source").alias("site"), F.xxhash64("paper_id").alias("paper")).distinct()
    papers = papers.groupBy("site").agg(F.count("*").alias("site_papers"))
    lines = cut(line_table(records))
    chunks = lines.select("site", F.explode("chunks").alias("chunk"), "paper")
    often = small_or_shuffled(cut(_excessive(chunks, ["chunk"], papers).drop("papers")))
    parts = lines.select("record_id", "block_order", "line_no", "site", "paper", "key", "key2", F.explode(F.array_distinct("chunks")).alias("chunk"), F.size(F.array_distinct("chunks")).alias("d"))
    # Distinct, or the lines of a record delivered twice would seem to have twice their chunks.
    hit = parts.join(often, ["site", "chunk"]).distinct().groupBy("site", "key", "key2", "paper", "d", "record_id", "block_order", "line_no").agg(F.count("*").alias("hits"))
    whole = hit.filter("hits = d").select("site", "key", "key2", "paper")
    return lines, cut(_excessive(whole, ["key", "key2"], papers))


def repeated_places(records: DataFrame) -> DataFrame:
    """(record_id, block_order, line_no) of each line repeated excessively, once."""
    lines, repeated = repeated_lines(records)
    found = lines.join(small_or_shuffled(repeated), ["site", "key", "key2"], "left_semi")
    return found.select("record_id", "block_order", "line_no").distinct()


def without_repeated_lines(records: DataFrame) -> DataFrame:
    """(record_id, block_order, page, kind, text) of every block, without its repeated lines. A block of which nothing
    is left has an empty text; a null text stays null. Blocks aren't shuffled: each site's few keys come to them."""
    _, repeated = repeated_lines(records)
    keys = repeated.groupBy("site").agg(F.collect_list(F.struct("key", "key2")).alias("bad"))
    blocks = records.select("record_id", F.xxhash64("source").alias("site"), F.inline("blocks"))
    blocks = blocks.join(small_or_shuffled(cut(keys)), "site", "left")

    def stays(line: Column) -> Column:
        n = normal_line(line)
        return ~F.array_contains("bad", F.struct(F.xxhash64(n).alias("key"), F.xxhash64(F.lit(1), n).alias("key2")))

    kept = F.array_join(F.filter(F.split("text", "\n", -1), stays), "\n")
    counts = F.col("bad").isNotNull() & ~F.coalesce(F.col("kind").isin(*SKIPPED_KINDS), F.lit(False))
    return blocks.select("record_id", F.col("order").alias("block_order"), "page", "kind", F.when(counts, kept).otherwise(F.col("text")).alias("text"))
