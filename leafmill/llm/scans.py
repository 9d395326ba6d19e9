"""Noise in text from scanned pages: split words, misread words, running heads and page numbers; and its repair.

Three classifiers, all boosted trees, trained on this corpus without labels of its own:

* *Words.* The vocabulary of the papers that weren't scanned is the standard. Unknown words of scanned papers meet
  candidates through an inverted join on character 2-grams, whose rarest ones suffice for all words within two edits.
  Two runners that read the same scanned page err independently, so where both show the same neighbours but other words,
  the word one of them shows is a labelled replacement. A ranking model learns from a bounded sample of such pairs which
  candidate, or none, replaces a word; the statistics it sees (counts, how often a substitution recurs) cover all data.
* *Joins.* Each pair of line halves around a mark is judged from the counts of the whole, the parts and the spelling with
  the mark; the label is whether another runner shows the whole word or the same broken one.
* *Furniture.* Two classifiers of lines and their neighbours judge running heads and page numbers; what recurs on several
  pages of a paper (a head's words, a number's distance from the page's place) are their labels, and evidence of its own
  odds where it is seen.

Defined cases: a paper without a manifest row, or with a null ``scanned``, isn't scanned; null and empty texts have no
noise; redelivered records count once; every model is also taught a few seed rows, which decide where the corpus has
nothing to learn from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from leafmill.llm.boosting import Boosted
from leafmill.llm.lookalikes import one_form
from leafmill.session import cut, drop_redelivered, shuffled, small_or_shuffled

PROSE = ("paragraph", "caption")
#: A word is a standard of spelling from this count on in papers that weren't scanned.
MIN_COUNT = 5
#: Edits between a misread word and its candidates.
EDITS = 2
#: Scanned papers of which readings are compared for labels, and labelled rows of each model.
SAMPLE_PAPERS, SAMPLE_ROWS = 3000, 60_000
#: A head's or number's evidence: pages of the paper; share of the source's scanned papers beyond which a line is the site's.
MIN_PAGES, SITE_SHARE, SITE_PAPERS = 2, 0.1, 3

MARKS = "-‐¬­"
SPLIT = rf"(\S*[^\s{MARKS}])([{MARKS}])([\n ])(?=(\S+))"
#: A word with a mark before white space, and the next word; tried from the beginnings of words only.
BROKEN = rf"(?<!\S)\S*[^\s{MARKS}][{MARKS}][\n ]\S+"
EDGES = r"""^[(\[{“„"'«‘¿¡]+|[.,;:)\]}?!”“"'’»]+$"""
NUMBER = r"^(?:\p{L}{1,10}\.?\s*)?[\[(–—-]*\s*(\d{1,5})(?:\s*/\s*\d{1,5})?\s*[\])–—-]*$"


def scanned_papers(manifest: DataFrame) -> DataFrame:
    """(paper_id, scanned) of each paper the manifest says anything about; scanned wins over its contradiction."""
    m = manifest.filter(F.col("scanned").isNotNull() & F.col("filename").isNotNull())
    return m.select(F.regexp_replace("filename", r"\.[^.]*$", "").alias("paper_id"), "scanned").groupBy("paper_id").agg(F.max("scanned").alias("scanned"))


def bare(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, EDGES, ""))


def parts(word: Column) -> Column:
    """The parts of a compound that could be words: at least two characters, one of them a letter."""
    return F.filter(F.split(bare(word), "[-‐‑/]"), lambda p: p.rlike(r"\p{L}") & (F.length(p) >= 2))


def raw_words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def vocabulary(clean: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words, hanging): counts of words in prose of papers that weren't scanned; counts of words that end in a mark."""
    prose = clean.select(F.inline("blocks")).filter(F.col("kind").isin(*PROSE) & F.col("text").isNotNull())
    raw = cut(prose.select(F.explode(F.split("text", r"\s+")).alias("raw")).groupBy("raw").agg(F.count("*").alias("n")))
    raw = raw.withColumn("raw", one_form(F.col("raw")))
    whole = raw.select(bare(F.col("raw")).alias("word"), "n")
    pieces = raw.filter(F.col("raw").rlike("[-‐‑/]")).select(F.explode(parts(F.col("raw"))).alias("word"), "n")
    words = whole.unionByName(pieces).filter(F.length("word") >= 2).groupBy("word").agg(F.sum("n").alias("n"))
    hanging = raw.filter(F.col("raw").rlike(r"[-‐]$")).select(F.regexp_replace(bare(F.col("raw")), r"[-‐]+$", "").alias("word"), "n")
    return cut(words), hanging.groupBy("word").agg(F.sum("n").alias("hanging"))


def scanned_blocks(records: DataFrame, papers: DataFrame) -> DataFrame:
    """Blocks of the scanned papers' distinct records, in one form of look-alikes, with what stands beside them."""
    r = records.join(small_or_shuffled(papers.filter("scanned").select("paper_id")), "paper_id", "left_semi")
    r = r.select("record_id", "paper_id", "source", "blocks").dropDuplicates(["record_id"]).filter(F.size("blocks") > 0)
    page = lambda at: F.get(F.col("blocks"), at)["page"]
    around = F.transform(
        "blocks",
        lambda b, i: F.struct(
            b["page"].alias("page"),
            b["kind"].alias("kind"),
            b["text"].alias("text"),
            b["order"].alias("block_order"),
            (~F.coalesce(page(i - 1) == b["page"], F.lit(False))).alias("first"),
            (~F.coalesce(page(i + 1) == b["page"], F.lit(False))).alias("last"),
        ),
    )
    title = F.get(F.filter("blocks", lambda b: b["kind"] == "section_header"), F.lit(0))["text"]
    return r.select("record_id", "paper_id", F.coalesce("source", F.lit("")).alias("source"), title.alias("title"), F.inline(around)).withColumn("text", one_form(F.col("text")))


# --- furniture -------------------------------------------------------------------------------------------------------

LINE_FEATURES = ["length", "words", "other", "alone", "first", "last", "front", "ended", "upper", "digits", "site", "title", "author", "next_lower"]


def _segments(blocks: DataFrame) -> DataFrame:
    """Line segments (split at runs of spaces) at places where furniture can stand, with their features."""
    lines = blocks.filter(F.col("text").isNotNull()).withColumn("lines", F.split("text", "\n", -1))
    lines = lines.select("*", F.posexplode("lines").alias("line_no", "line"), F.size("lines").alias("n_lines"))
    lines = lines.withColumn("follow", F.get("lines", F.col("line_no") + 1)).withColumn("ahead", F.when(F.col("line_no") > 0, F.get("lines", F.col("line_no") - 1)))
    seg = lines.select("*", F.explode(F.filter(F.split(F.trim("line"), r"\s{2,}"), lambda s: s != "")).alias("segment"), F.size(F.split(F.trim("line"), r"\s{2,}")).alias("n_segments")).drop("lines", "text", "line")
    seg = seg.withColumn("norm", F.lower(F.regexp_replace("segment", r"\s+", " ")))
    number = F.regexp_extract("segment", NUMBER, 1)
    seg = seg.withColumn("number", F.when(number != "", number.cast("int")))
    edge_line = (F.col("line_no") == 0) | (F.col("line_no") == F.col("n_lines") - 1)
    return seg.withColumn("edge", edge_line & (F.col("first") | F.col("last") | (F.col("kind") == "other") | (F.col("n_lines") > 1)))


NUMBER_FEATURES = ["alone", "other", "first", "last", "first_line", "parts", "length", "worded", "header", "next_lower", "before_open"]
#: Rows that every model of page numbers, and of running heads, is taught besides the corpus's, label first.
NUMBER_SEEDS = [
    *[(1, 1, 1, a, 1 - a, 1, 1, n, w, 0, 0, 0) for a in (0, 1) for n in (1, 3, 8) for w in (0, 1)],
    *[(1, 0, o, a, 1 - a, f, 1, n, 0, 0, 0, 0) for o in (0, 1) for a in (0, 1) for f in (0, 1) for n in (1, 5)],
    *[(1, 0, o, a, 1 - a, f, 2, n, 0, h, 0, 0) for o in (0, 1) for a in (0, 1) for f in (0, 1) for n in (1, 8) for h in (0, 1)],
    *[(0, a, 0, 0, 0, f, 1, n, 0, 0, t, b) for a in (0, 1) for f in (0, 1) for n in (1, 8) for t in (0, 1) for b in (0, 1)],
]
HEAD_SEEDS = [
    *[(1, n, w, 1, 1, f, 1 - f, 0, 0, u, 0, 0, t, a, 0) for n, w in ((30, 4), (60, 7)) for f in (0, 1) for u in (0, 1) for t, a in ((0.8, 0), (0, 0.8))],
    *[(0, n, w, 0, n < 90, f, 1 - f, front, e, 0, d, 0, 0, 0, 0) for n, w in ((40, 5), (90, 14), (300, 50)) for f in (0, 1) for front in (0, 1) for e in (0, 1) for d in (0, 1)],
    *[(0, 40, 6, 1, 1, f, 1 - f, front, e, 0, 0, 0.5, 0, 0, 0) for f in (0, 1) for front in (0, 1) for e in (0, 1)],
]
#: How much likelier a line is furniture that stands on several pages where it should, and that doesn't in a paper which
#: shows other lines to do so.
PROVEN, DISPROVEN = 1000.0, 0.05


def _odds(p: Column) -> Column:
    return p / F.greatest(1 - p, F.lit(1e-6))


def page_numbers(seg: DataFrame) -> DataFrame:
    """Segments judged to be printed page numbers, by the odds of a classifier of lines and their neighbours and those of
    the number's distance from the page's place, if that is the same on several pages."""
    n = seg.filter("number IS NOT NULL AND edge").withColumn("offset", F.expr("number - page"))
    offsets = n.groupBy("paper_id", "offset").agg(F.count_distinct("page").alias("pages"))
    taught = offsets.groupBy("paper_id").agg(F.max("pages").alias("most"))
    n = n.join(shuffled(offsets), ["paper_id", "offset"]).join(shuffled(taught), "paper_id")
    features = {
        "alone": F.col("n_lines") == 1,
        "other": F.col("kind") == "other",
        "first": F.col("first"),
        "last": F.col("last"),
        "first_line": F.col("line_no") == 0,
        "parts": F.col("n_segments"),
        "length": F.length("segment"),
        "worded": F.col("segment").rlike(r"\p{L}"),
        "header": F.col("kind") == "section_header",
        "next_lower": F.coalesce(F.col("follow").rlike(r"^\p{Ll}"), F.lit(False)),
        "before_open": F.coalesce(~F.col("ahead").rlike(r"[.!?:)]\s*$"), F.lit(False)),
    }
    keep = ["record_id", "block_order", "line_no", "pages", "most"]
    n = cut(n.select(*keep, *[features[k].cast("float").alias(f"f_{k}") for k in NUMBER_FEATURES]))
    proven = F.col("pages") >= MIN_PAGES
    columns = [F.col(f"f_{k}").alias(k) for k in NUMBER_FEATURES]
    model = train(n.filter(F.col("most") >= MIN_PAGES).select(proven.cast("int").alias("label"), *columns), NUMBER_SEEDS)
    odds = _odds(scorer(model)(F.array(*columns))) * F.when(proven, PROVEN).otherwise(1.0)
    return n.withColumn("odds", odds).filter("odds >= 1").select("record_id", "block_order", "line_no")


def running_heads(seg: DataFrame, blocks: DataFrame) -> DataFrame:
    """(record_id, block_order, line_no) of the segments judged to be running heads, by the odds of a classifier of lines
    and their neighbours and those of standing at the edges of several pages; and of those that read like a head of their
    paper apart from a few misread characters."""
    text = seg.filter("number IS NULL AND edge")
    papers = blocks.select("source", "paper_id").distinct().groupBy("source").agg(F.count("*").alias("source_papers"))
    site = text.withColumn("bare", F.regexp_replace("norm", r"\d+", "")).select("source", "bare", "paper_id").distinct().groupBy("source", "bare").agg(F.count("*").alias("line_papers"))
    site = site.filter(F.col("line_papers") >= SITE_PAPERS).join(small_or_shuffled(cut(papers)), "source")
    site = small_or_shuffled(cut(site.select("source", "bare", (F.col("line_papers") / F.col("source_papers")).alias("site"))))
    pages = text.groupBy("paper_id", "norm").agg(F.count_distinct("page").alias("pages"))
    text = text.withColumn("bare", F.regexp_replace("norm", r"\d+", ""))
    text = text.join(site, ["source", "bare"], "left").join(shuffled(pages), ["paper_id", "norm"]).withColumn("site", F.coalesce("site", F.lit(0.0)))
    words = F.filter(F.split("norm", r"[^\p{L}\p{N}-]+"), lambda w: F.length(w) > 2)
    told = lambda c: F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[^\p{L}\p{N}-]+"), lambda w: F.length(w) > 2)
    share = lambda c: F.coalesce(F.try_divide(F.size(F.array_intersect(words, told(c))), F.size(F.array_distinct(words))), F.lit(0.0))
    features = {
        "length": F.length("segment"),
        "words": F.size(words),
        "other": F.col("kind") == "other",
        "alone": F.col("n_lines") == 1,
        "first": F.col("first"),
        "last": F.col("last"),
        "front": F.col("page") <= 1,
        "ended": F.col("segment").rlike(r"[.?!:;,)]$"),
        "upper": F.col("segment") == F.upper("segment"),
        "digits": F.col("segment").rlike(r"\d"),
        "site": F.col("site"),
        "title": share("title"),
        "author": share("paper_id"),
        "next_lower": F.coalesce(F.col("follow").rlike(r"^\p{Ll}"), F.lit(False)),
    }
    text = text.select("record_id", "paper_id", "block_order", "line_no", "kind", "first", "last", "site", "pages", "segment", "norm", *[features[k].cast("float").alias(f"f_{k}") for k in LINE_FEATURES])
    # A head stands at the edge of several pages of its paper and isn't a line of the whole site.
    # In capitals it may have been taken for a section header; then it must be several words at a page's edge.
    plain = (F.col("kind") != "section_header") & (F.length("segment") >= 4)
    titled = (F.col("kind") == "section_header") & (F.col("first") | F.col("last")) & (F.col("f_words") >= 3)
    recurs = (F.col("pages") >= MIN_PAGES) & (F.col("site") < SITE_SHARE) & (plain | titled) & ~((F.col("kind") == "caption") & (F.col("f_alone") == 1))
    recurs &= (F.col("kind") == "other") | (F.col("f_ended") == 0)  # the short last lines of paragraphs recur, too
    text = cut(text.filter(plain | titled).withColumn("proven", recurs).withColumn("plain", plain))
    taught = text.filter("proven").select("paper_id").distinct().withColumn("taught", F.lit(True))
    text = text.join(small_or_shuffled(cut(taught)), "paper_id", "left").withColumn("taught", F.coalesce("taught", F.lit(False)))
    columns = [F.col(f"f_{k}").alias(k) for k in LINE_FEATURES]
    model = train(text.filter("plain AND taught").select(F.col("proven").cast("int").alias("label"), *columns), HEAD_SEEDS)
    told_ = F.when(F.col("proven"), PROVEN).when(F.col("taught") | ~F.col("plain") | (F.col("site") >= SITE_SHARE) | (F.col("pages") >= MIN_PAGES), DISPROVEN).otherwise(1.0)
    scored = cut(text.withColumn("odds", _odds(scorer(model)(F.array(*columns))) * told_).select("record_id", "paper_id", "block_order", "line_no", "segment", "norm", "site", "pages", "proven", "odds"))
    head = scored.filter("odds >= 1").select("record_id", "block_order", "line_no")
    heads = scored.filter("proven AND odds >= 1").groupBy("paper_id", "norm").agg(F.max("pages").alias("_p")).select("paper_id", F.col("norm").alias("head"))
    near = scored.filter((F.length("segment") >= 4) & ~F.col("proven") & (F.col("site") < SITE_SHARE)).join(shuffled(heads), "paper_id")
    near = near.filter(F.levenshtein("norm", "head") * 5 <= F.length("head"))
    return head.unionByName(near.select("record_id", "block_order", "line_no"))


def furniture(blocks: DataFrame) -> DataFrame:
    """(record_id, block_order, line_no, noise): lines with a running head or page number."""
    seg = cut(_segments(blocks))
    numbers = page_numbers(seg).withColumn("noise", F.lit("page_no"))
    return numbers.unionByName(running_heads(seg, blocks).withColumn("noise", F.lit("header"))).distinct()


# --- models ----------------------------------------------------------------------------------------------------------


def train(sample: DataFrame, seeds: list[tuple] = ()) -> Boosted:
    """A model of the column ``label``, of ``seeds`` (label, *features), which every model is taught, and of the sample.
    Rows of equal features and label are one row that weighs as many, so that all rows are seen; where more than
    SAMPLE_ROWS are left, about so many rows are drawn, each copy of equal ones by itself."""
    names = [c for c in sample.columns if c != "label"]
    s = cut(sample.groupBy(*names, "label").agg(F.count("*").alias("_n")))
    if s.count() > SAMPLE_ROWS:
        total = s.agg(F.sum("_n")).head()[0]
        copies = s.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n")))).withColumn("_h", F.xxhash64(*names, "label", "_i"))
        drawn = copies.filter(F.col("_h") < int(-(2**63) + 2**64 * (SAMPLE_ROWS / total)))
        s = cut(drawn.groupBy(*names, "label").agg(F.count("*").alias("_n")))
    rows = s.orderBy(*names, "label").toPandas()
    first = np.array(seeds, float).reshape(len(seeds), len(names) + 1)
    x = np.concatenate([first[:, 1:], rows[names].to_numpy(float)])
    y = np.concatenate([first[:, 0], rows["label"].to_numpy(float)])
    return Boosted().fit(x, y, np.concatenate([np.ones(len(first)), rows["_n"].to_numpy(float)]))


def scorer(model: Boosted, raw: bool = False):
    """A column function: array of features -> probability, or the log-odds."""

    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x = np.array(batch.flatten().to_numpy(zero_copy_only=False), float).reshape(len(batch), -1)
            yield pa.array((model.scores(x) if raw else model.predict(x)) if len(x) else np.empty(0), pa.float64())

    return score


# --- words -----------------------------------------------------------------------------------------------------------


def _grams(word: Column) -> Column:
    padded = F.concat(F.lit("^"), word, F.lit("$"))
    chars = F.split(padded, "")
    return F.array_distinct(F.zip_with(F.slice(chars, 1, F.length(padded) - 1), F.slice(chars, 2, F.length(padded) - 1), lambda a, b: F.concat(a, b)))


def candidates(unknown: DataFrame, words: DataFrame) -> DataFrame:
    """(x, y, n_y, edits): for each unknown word all standard words within EDITS edits (one for words under four
    characters). Both sides bring only the grams that must overlap, the rarest, so that no list of a common gram is met."""
    standard = words.filter(F.col("n") >= MIN_COUNT).filter(F.col("word").rlike(r"^[\p{L}'’]+$"))
    each = standard.select("word", "n", F.explode(_grams(F.col("word"))).alias("gram"))
    rare = small_or_shuffled(cut(each.groupBy("gram").agg(F.count("*").alias("df"))))
    need = 2 * EDITS + 1

    def prefix(df: DataFrame, name: str, keep: list[str]) -> DataFrame:
        g = df.join(rare, "gram", "left").groupBy(name, *keep).agg(F.slice(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))), 1, need).alias("p"))
        return g.select(name, *keep, F.explode("p.gram").alias("gram"))

    left = prefix(unknown.select("x", F.explode(_grams(F.col("x"))).alias("gram")), "x", [])
    right = prefix(each, "word", ["n"])
    pairs = left.join(shuffled(right), "gram").filter(F.abs(F.length("x") - F.length("word")) <= EDITS).select("x", F.col("word").alias("y"), F.col("n").alias("n_y")).distinct()
    allowed = F.when(F.length("x") >= 4, F.lit(EDITS)).otherwise(F.lit(1))
    pairs = pairs.withColumn("edits", F.levenshtein("x", "y"))
    # A word without its beginning or end, or with something glued to it, isn't misread.
    x, y = F.col("x"), F.col("y")
    part = y.startswith(x) | y.endswith(x) | x.startswith(y) | x.endswith(y)
    return pairs.filter((F.col("edits") > 0) & (F.col("edits") <= allowed) & ~part)


@F.arrow_udf(T.StringType())
def _change(x: pa.Array, y: pa.Array) -> pa.Array:
    """What was read for what: the words without their common beginning and end."""
    out = []
    for a, b in zip(x.to_pylist(), y.to_pylist()):
        i = 0
        while i < min(len(a), len(b)) and a[i] == b[i]:
            i += 1
        j = 0
        while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
            j += 1
        out.append(f"{a[i : len(a) - j]}>{b[i : len(b) - j]}")
    return pa.array(out, pa.string())


WORD_FEATURES = ["edits", "longer", "length", "log_y", "log_x", "log_clean", "log_change", "rank_change", "rivals", "same_first", "odd", "change_length", "begins", "pure"]


#: Rows that every ranking is taught, each a word of its own: (label, *WORD_FEATURES).
WORD_SEEDS = [
    *[(1, 1, 0, n, 4, 1, 0, k, 1, 1, f, o, 3, 0, 0) for n in (6, 10) for k in (2, 3) for f in (0, 1) for o in (0, 1)],
    *[(1, 2, 1, n, 4, 1, 0, 3, 1, 1, f, 0, 4, 0, 0) for n in (8, 12) for f in (0, 1)],
    *[(0, 2, d, n, 4, 1, 0, 0.7, r, 6 - 5 * r, f, 0, 5, b, 0) for n in (3, 5, 8) for d in (-1, 0, 1) for r in (0.2, 1) for f in (0, 1) for b in (0, 3)],
    *[(0, 1, d, n, 4, 1, 0, 0.7, 1, 1, f, 0, 3, b, d != 0) for d in (-1, 0, 1) for n in (3, 5) for f in (0, 1) for b in (0, 3)],
    *[(0, e, 0, n, 4, 3, 1.5, 0.7, 0.3, 2, f, 0, 3, 0, 0) for e in (1, 2) for n in (4, 8) for f in (0, 1)],
]


def corrections(unknown: DataFrame, words: DataFrame, pairs: DataFrame) -> DataFrame:
    """(x, y): the unknown words that are misread, and what they should read.

    ``unknown``: (x, n_x, n_clean); ``pairs``: (x, y, other) readings at the same place in another record.
    """
    c = candidates(unknown, words).join(shuffled(unknown), "x").withColumn("change", _change(F.col("x"), F.col("y")))
    c = cut(c)
    often = cut(c.groupBy("change").agg(F.count_distinct("x").alias("n_change")))
    c = c.join(small_or_shuffled(often), "change")
    best = c.groupBy("x").agg(F.max("n_change").alias("most"), F.count("*").alias("rivals"))
    # A word that begins longer ones may be the rest of a cut text rather than misread.
    begun = words.select("n", "word", F.explode(F.sequence(F.lit(1), F.greatest(F.length("word") - 1, F.lit(1)))).alias("k")).filter("k < length(word)")
    begun = begun.groupBy(F.expr("substring(word, 1, k)").alias("x")).agg(F.max("n").alias("n_begun"))
    c = c.join(shuffled(best), "x").join(shuffled(begun), "x", "left").na.fill(0, ["n_begun"])
    log = lambda v: F.log1p(F.col(v).cast("double")).cast("float")
    features = {
        "edits": F.col("edits"),
        "longer": F.length("x") - F.length("y"),
        "length": F.length("y"),
        "log_y": log("n_y"),
        "log_x": log("n_x"),
        "log_clean": log("n_clean"),
        "log_change": log("n_change"),
        "rank_change": F.col("n_change") / F.col("most"),
        "rivals": F.col("rivals"),
        "same_first": F.substring("x", 1, 1) == F.substring("y", 1, 1),
        "odd": F.col("x").rlike(r"[^\p{L}]"),
        "change_length": F.length("change"),
        "begins": log("n_begun"),
        "pure": F.col("change").rlike("^>|>$"),
    }
    columns = [features[k].cast("float").alias(k) for k in WORD_FEATURES]
    c = cut(c.select("x", "y", "n_y", *columns))
    model = _ranking(c, pairs)
    # The chance of a candidate among all of its word and that of no replacement, whose score is 0.
    scored = c.select("x", "y", "n_y", scorer(model, raw=True)(F.array(*WORD_FEATURES)).alias("score"))
    best = F.max_by(F.struct("y", "score"), F.struct("score", "n_y", "y")).alias("b")
    chosen = scored.groupBy("x").agg(best, F.sum(F.exp("score")).alias("all"))
    return chosen.filter(2 * F.exp("b.score") >= 1 + F.col("all")).select("x", "b.y")


def _ranking(c: DataFrame, pairs: DataFrame) -> Boosted:
    """A ranking model of the candidates ``c`` (x, y, *features): boosted trees whose scores make the candidate that other
    records show likely among its word's, or none. It learns from the words that have readings; where their candidates
    are more than SAMPLE_ROWS, from about so many, whole words drawn by hash."""
    seen = cut(pairs.groupBy("x", "y").agg(F.count("*").alias("seen")))
    known = seen.groupBy("x").agg(F.sum("seen").alias("all_seen"))
    labelled = c.join(shuffled(known), "x").join(shuffled(seen), ["x", "y"], "left")
    labelled = cut(labelled.select("x", (F.coalesce("seen", F.lit(0)) * 2 > F.col("all_seen")).cast("int").alias("label"), *WORD_FEATURES))
    n = labelled.count()
    if n > SAMPLE_ROWS:
        labelled = labelled.filter(F.xxhash64("x", F.lit(3)) < int(-(2**63) + 2**64 * (SAMPLE_ROWS / n)))
    rows = labelled.orderBy("x", "label", *WORD_FEATURES).toPandas()
    first = np.array(WORD_SEEDS, float)
    x = np.concatenate([first[:, 1:], rows[WORD_FEATURES].to_numpy(float)])
    y = np.concatenate([first[:, 0], rows["label"].to_numpy(float)])
    words = np.unique(rows["x"].to_numpy(str), return_inverse=True)[1] if len(rows) else np.empty(0, int)
    return Boosted().fit(x, y, groups=np.concatenate([np.arange(len(first)), len(first) + words]))


def readings(prose: DataFrame, papers: DataFrame) -> DataFrame:
    """(x, y): words two records of a scanned paper show between the same neighbours, and words at a block's end with what
    another record shows after the same two words; of a bounded sample of papers."""
    some = papers.filter("scanned").orderBy(F.xxhash64("paper_id")).limit(SAMPLE_PAPERS).select("paper_id")
    w = prose.join(F.broadcast(some), "paper_id", "left_semi").withColumn("w", F.transform(raw_words(F.col("text")), bare))
    n = F.size("w")
    at = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.get("w", i - 2).alias("two"), F.get("w", i - 1).alias("before"), F.get("w", i).alias("x"), F.get("w", i + 1).alias("after")))
    t = cut(w.filter(n >= 2).select("paper_id", "page", "record_id", F.inline(at)).filter("length(before) > 1"))

    def told(mine: DataFrame, others: DataFrame, beside: str) -> DataFrame:
        key = ["paper_id", "page", "before", beside]
        mine, others = (d.filter(F.length(beside) > 1).groupBy(*key, "record_id", "x").agg(F.count("*").alias("n")).drop("n") for d in (mine, others))
        both = mine.join(shuffled(others.select(*key, F.col("record_id").alias("other"), F.col("x").alias("y"))), key)
        return both.filter("record_id <> other").select("x", "y")

    return told(t, t, "after").unionByName(told(t.filter("after IS NULL"), t, "two"))


# --- joins -----------------------------------------------------------------------------------------------------------

JOIN_FEATURES = ["log_whole", "log_left", "log_right", "log_compound", "log_hanging", "plain_mark", "line_end", "left_length", "right_length", "right_upper"]


#: Rows that every model of joins is taught: (label, *JOIN_FEATURES).
JOIN_SEEDS = [
    *[(1, w, l, r, 0, 0, p, e, 4, 4, 0) for w in (0.7, 4) for l, r in ((0, 0), (2, 0), (0, 2)) for p in (0, 1) for e in (0, 1)],
    *[(0, 0, 3, 3, c, 0, 1, e, 6, 6, u) for c in (0.7, 3) for e in (0, 1) for u in (0, 1)],
    *[(0, 0, 3, 4, 0, 2, 1, e, 3, 3, 0) for e in (0, 1)],
]


def splits(prose: DataFrame) -> DataFrame:
    """Every place where a mark stands between two halves: (record_id, paper_id, page, block_order, left, mark, gap, right)."""
    found = F.transform(F.regexp_extract_all("text", F.lit(BROKEN), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, SPLIT, 1).alias("left"), F.regexp_extract(m, SPLIT, 2).alias("mark"), F.regexp_extract(m, SPLIT, 3).alias("gap"), F.regexp_extract(m, SPLIT, 4).alias("right")))
    s = prose.select("record_id", "paper_id", "page", "block_order", F.inline(found))
    last = lambda a: F.coalesce(F.element_at(F.split(a, "[-‐‑/]"), -1), F.lit(""))
    return s.withColumn("l", last(bare(F.col("left")))).withColumn("r", F.coalesce(F.get(F.split(bare(F.regexp_replace("right", rf"[{MARKS}]+$", "")), "[-‐‑/]"), F.lit(0)), F.lit("")))


def _judged(kinds: DataFrame, words: DataFrame, hanging: DataFrame, fixed: DataFrame) -> DataFrame:
    """The kinds of split with the counts they are judged by."""
    look = lambda key, name: words.select(F.col("word").alias(key), F.col("n").alias(name))
    k = kinds.withColumn("whole", F.concat("l", "r")).withColumn("compound", F.concat_ws("-", "l", "r"))
    for key, name in (("whole", "n_whole"), ("l", "n_left"), ("r", "n_right"), ("compound", "n_compound")):
        k = k.join(shuffled(look(key, name)), key, "left")
    k = k.join(hanging.select(F.col("word").alias("l"), "hanging"), "l", "left")
    f = fixed.join(shuffled(words.select(F.col("word").alias("y"), "n")), "y").select(F.col("x").alias("whole"), F.col("n").alias("n_fixed"))
    return k.join(shuffled(f), "whole", "left").na.fill(0, ["n_whole", "n_left", "n_right", "n_compound", "hanging", "n_fixed"])


def split_words(s: DataFrame, prose: DataFrame, words: DataFrame, hanging: DataFrame, fixed: DataFrame, papers: DataFrame) -> DataFrame:
    """The rows of ``s`` whose halves are one word."""
    key = ["l", "r", "mark", "gap"]
    kinds = cut(_judged(s.select(*key).distinct(), words, hanging, fixed))
    log = lambda c: F.log1p(F.col(c).cast("double"))
    features = {
        "log_whole": F.log1p(F.greatest("n_whole", "n_fixed").cast("double")),
        "log_left": log("n_left"),
        "log_right": log("n_right"),
        "log_compound": log("n_compound"),
        "log_hanging": log("hanging"),
        "plain_mark": F.col("mark") == "-",
        "line_end": F.col("gap") == "\n",
        "left_length": F.length("l"),
        "right_length": F.length("r"),
        "right_upper": F.col("r") != F.lower("r"),
    }
    columns = [features[k].cast("float").alias(k) for k in JOIN_FEATURES]
    some = papers.filter("scanned").orderBy(F.xxhash64("paper_id")).limit(SAMPLE_PAPERS).select("paper_id")
    here = s.join(F.broadcast(some), "paper_id", "left_semi")
    shown = prose.join(F.broadcast(some), "paper_id", "left_semi").select("paper_id", "page", F.explode(raw_words(F.col("text"))).alias("raw"), F.col("record_id").alias("other"))
    # Another record shows the whole word, or only ever the left half with its mark, as in "pre- and".
    shown = shown.select("paper_id", "page", "other", bare(F.col("raw")).alias("shown")).distinct()
    asks = here.select("paper_id", "page", "record_id", *key, F.explode(F.array(F.struct(F.concat("l", "r").alias("shown"), F.lit(1).alias("label")), F.struct(F.concat("l", F.lit("-")).alias("shown"), F.lit(0).alias("label")))).alias("a")).select("*", "a.*").drop("a")
    told = asks.join(shuffled(shown), ["paper_id", "page", "shown"]).filter("record_id <> other").groupBy(*key).agg(F.max("label").alias("share"))
    model = train(kinds.join(shuffled(told), key).select(F.col("share").alias("label"), *columns), JOIN_SEEDS)
    kinds = kinds.withColumn("score", scorer(model)(F.array(*columns))).filter("score >= 0.5")
    return s.join(small_or_shuffled(cut(kinds.select(*key, "whole"))), key)


# --- all together ----------------------------------------------------------------------------------------------------


def analyse(records: DataFrame, manifest: DataFrame) -> dict[str, DataFrame]:
    """Everything that is known about the noise: blocks, furniture, splits and misread words with their corrections."""
    papers = cut(scanned_papers(manifest))
    records = records.select("record_id", "paper_id", "source", "blocks", "loaded_at")
    clean = drop_redelivered(records, "record_id", "loaded_at").join(small_or_shuffled(papers.filter("NOT scanned").select("paper_id")), "paper_id", "left_semi")
    words, hanging = vocabulary(clean)
    hanging = small_or_shuffled(cut(hanging))
    blocks = cut(scanned_blocks(records, papers))
    lines = cut(furniture(blocks))

    # Prose without its furniture; a line break that goes with a line leaves the others as they were.
    gone = lines.groupBy("record_id", "block_order").agg(F.collect_set("line_no").alias("gone"))
    prose = blocks.filter(F.col("kind").isin(*PROSE) & (F.col("text") != "")).join(shuffled(gone), ["record_id", "block_order"], "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("gone", i)), "\n")
    prose = cut(prose.withColumn("text", F.when(F.col("gone").isNotNull(), kept).otherwise(F.col("text"))).drop("gone", "title"))

    broken = cut(splits(prose))
    rest = prose.withColumn("text", F.regexp_replace("text", BROKEN, " "))
    tokens = cut(rest.select("record_id", "block_order", F.explode(raw_words(F.col("text"))).alias("raw")).groupBy("record_id", "block_order", "raw").agg(F.count("*").alias("n")))
    types = cut(tokens.groupBy("raw").agg(F.sum("n").alias("n")))
    said = types.select(F.explode(parts(F.col("raw"))).alias("x"), "n").unionByName(broken.select(F.concat("l", "r").alias("x"), F.lit(1).cast("bigint").alias("n")))
    said = said.filter(F.length("x") >= 2).groupBy("x").agg(F.sum("n").alias("n_x"))
    unknown = said.join(shuffled(words.select(F.col("word").alias("x"), F.col("n").alias("n_clean"))), "x", "left").na.fill(0, ["n_clean"])
    unknown = cut(unknown.filter((F.col("n_clean") < MIN_COUNT) & ~F.col("x").rlike(r"^v?[\d.,]+$")))
    fixed = cut(corrections(unknown, words, readings(prose, papers)))
    joined = split_words(broken, prose, words, hanging, fixed, papers)
    wrong = types.select("raw", F.explode(parts(F.col("raw"))).alias("x")).join(small_or_shuffled(fixed), "x")
    wrong = cut(wrong.groupBy("raw").agg(F.collect_list(F.struct("x", "y")).alias("fixes")))
    misread = tokens.join(small_or_shuffled(wrong), "raw").select("record_id", "block_order", "raw", "fixes")
    return {"blocks": blocks, "prose": prose, "furniture": lines, "splits": joined, "misread": misread, "fixed": fixed}


def noise(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """(record_id, block_order, noise): one row for each block and kind of noise."""
    a = analyse(records, manifest)
    found = a["furniture"].select("record_id", "block_order", "noise")
    found = found.unionByName(a["splits"].select("record_id", "block_order", F.lit("hyphen").alias("noise")))
    return found.unionByName(a["misread"].select("record_id", "block_order", F.lit("misread").alias("noise"))).distinct()


@F.arrow_udf(T.StringType())
def _mend(text: pa.Array, splits: pa.Array, misread: pa.Array) -> pa.Array:
    """Texts with their split words joined, misread words replaced in the letter case they stand in, lines continued."""
    import re

    out = []
    for t, broken, wrong in zip(text.to_pylist(), splits.to_pylist(), misread.to_pylist()):
        for s in broken or []:
            t = t.replace(s["left"] + s["mark"] + s["gap"] + s["right"], s["left"] + s["right"])
        for w in wrong or []:
            new = w["raw"]
            for f in w["fixes"]:

                def put(m: re.Match, y: str = f["y"]) -> str:
                    return y.upper() if len(m[0]) > 1 and m[0].isupper() else y.capitalize() if m[0][0].isupper() else y

                new = re.sub(re.escape(f["x"]), put, new, flags=re.I)
            t = re.sub(r"(?<!\S)" + re.escape(w["raw"]) + r"(?!\S)", lambda m, new=new: new, t)
        out.append(" ".join(t.split()))
    return pa.array(out, pa.string())


def paragraphs(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """(record_id, paragraph, kind, first_block, text): the prose of scanned papers as continuous, repaired paragraphs.

    Furniture is gone, split words are whole, misread words are replaced, and a paragraph that runs over a page's end is
    one with the next page's first. Blocks of which nothing is left have no row.
    """
    a = analyse(records, manifest)
    key = ["record_id", "block_order"]
    gather = lambda df, name, *c: df.groupBy(*key).agg(F.collect_set(F.struct(*c)).alias(name))
    # A misread word that was also split is replaced once it is whole.
    fixes = a["splits"].join(small_or_shuffled(a["fixed"]), F.col("whole") == F.col("x")).select(*key, F.concat("left", "right").alias("raw"), F.array(F.struct("x", "y")).alias("fixes"))
    misread = a["misread"].select(*key, "raw", "fixes").unionByName(fixes)
    p = a["prose"].join(shuffled(gather(a["splits"], "splits", "left", "mark", "gap", "right")), key, "left").join(shuffled(gather(misread, "misread", "raw", "fixes")), key, "left")
    p = p.select("record_id", "block_order", "page", "kind", _mend("text", "splits", "misread").alias("text")).filter("text <> ''")
    # Captions stand beside the text: a paragraph is continued by the next paragraph, not by what lies between.
    w = Window.partitionBy("record_id", "kind").orderBy("block_order")
    runs_on = (F.col("kind") == "paragraph") & (F.lag("page").over(w) < F.col("page")) & ~F.coalesce(F.lag("text").over(w).rlike("[.!?:)。！？][\"”»“]?$"), F.lit(True))
    p = p.withColumn("runs_on", F.coalesce(runs_on, F.lit(False))).withColumn("paragraph", F.sum(F.when(F.col("runs_on"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_order", "text"))), lambda b: b["text"]), " ")
    return p.groupBy("record_id", "kind", "paragraph").agg(F.min("block_order").alias("first_block"), joined.alias("text"))
