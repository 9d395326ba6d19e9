"""Texts cut off by field limits or in transfer.

For each source and kind of block the lengths, in bytes and in characters, are modelled as log-normal with right
censoring: values at a candidate limit are an unknown mixture of whole texts of that length and of longer ones that were
cut there. Maximum likelihood (EM) gives the distribution and, for each length at a limit, the posterior that a value of
that length is censored; candidate limits are lengths at which open-ended texts pile up beyond their neighbourhood.
Properly ended texts, open ones and those that run on in the next page's first paragraph have posteriors of their own.

The decision is a product of odds: those of the censoring posterior (away from a limit, of the class of texts), of the
ending, and of the other records. The ending's odds come from boosted trees over end marks, marks of a cut, what the next
page's first paragraph begins with, and, for captions, which may lack a full stop, how often their last words end captions
or begin longer words. Its labels are the corpus's own: away from limits, another record of the paper holds the same block
with more text, or none does. That evidence itself has odds, too: how often such a proof is found for texts whose length
says that they were cut, against PROOF_ERROR. A block with a proper end is proven only if none of its record's later
blocks begins with what follows there.

Defined cases: null and empty texts can't be cut; a null source is a source of its own; redelivered records count once;
without any labelled rows the ending model is its seed rows alone.
"""

from __future__ import annotations

from math import sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from leafmill.llm.lookalikes import CYRILLIC, CYRILLIC_AS, GREEK, GREEK_AS, one_form
from leafmill.llm.scans import NUMBER, scorer, train
from leafmill.session import cut, drop_redelivered, one_per_key, small_or_shuffled

#: A pile must exceed its neighbourhood by this many standard deviations; bytes of a character cut at a byte limit.
PILE_Z, REACH = 6.0, 3
#: Letters of the two windows at a text's beginning, one of which two versions must share (the second may be a place off).
WINDOW = 24
#: Letters in so many of which one may be misread between two versions.
MISREAD = 20
#: Letters of what follows in another record that are looked for in the record's own later blocks.
NEXT = 24
#: Last letters of a text by which its end is found in another that differs from it.
LAST = 6
#: A last line in so many papers and so large a share of its source's is the site's, not the block's.
SITE_PAPERS, SITE_SHARE = 3, 0.1
#: How often a whole block seems to go on in another record.
PROOF_ERROR = 1e-4

#: White space of any script.
SPACES = "".join(c for c in map(chr, (*range(0x3001), 0x205F)) if c.isspace())
#: End marks, what may close after them, marks of a cut in brackets.
ENDS, CLOSERS = ".!?。！？؟।:：", ")]\"”»’'』」"
MARK = r"\[(\.\.\.|…|\p{L}+)\]$"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
WIDE = "".join(chr(0xFEE0 + c) for c in range(0x21, 0x7F))
WIDE_AS = "".join(map(chr, range(0x21, 0x7F)))


def _look(text: Column) -> Column:
    """The letters and figures of a text, small, in a form that a text's beginning shares with the whole: each look-alike
    and wide form by itself."""
    letters = F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")
    plain = F.translate(letters, CYRILLIC + GREEK + WIDE, CYRILLIC_AS + GREEK_AS + WIDE_AS)
    for ligature, as_ in LIGATURES.items():
        plain = F.replace(plain, F.lit(ligature), F.lit(as_))
    return F.lower(F.when(F.octet_length(letters) == F.length(letters), letters).otherwise(plain))


def _same(*what: Column | str) -> Column:
    return F.xxhash64("paper_id", "page", "kind", *what)


def prose_blocks(records: DataFrame) -> DataFrame:
    """Paragraphs and captions with their letters, length, ending and what the next page's first paragraph begins with."""
    filled = F.filter("blocks", lambda b: (F.trim(b["text"]) != "") & b["kind"].isin("paragraph", "caption"))
    r = records.select("record_id", F.coalesce("source", F.lit("")).alias("source"), "paper_id", filled.alias("b"))
    r = r.withColumn("p", F.filter("b", lambda b: b["kind"] == "paragraph")).withColumn("c", F.filter("b", lambda b: b["kind"] == "caption"))
    nxt = lambda i: F.get(F.col("p"), i + 1)
    row = lambda b, page, start: F.struct(b["order"].alias("block_order"), b["kind"].alias("kind"), b["page"].alias("page"), b["text"].alias("text"), page.alias("next_page"), start.alias("next_start"))
    paragraphs = F.transform("p", lambda b, i: row(b, nxt(i)["page"], F.substring(F.ltrim(nxt(i)["text"]), 1, 1)))
    captions = F.transform("c", lambda b: row(b, F.lit(None).cast("int"), F.lit(None).cast("string")))
    b = r.select("record_id", "source", "paper_id", F.inline(F.concat(paragraphs, captions)))
    b = b.withColumn("t", F.rtrim("text", F.lit(SPACES))).withColumn("look", _look(F.col("text")))
    t = F.col("t")
    marked = t.endswith("…") | t.endswith("...") | t.endswith("\ufffd") | (t.endswith("]") & t.rlike(MARK))
    leaves = F.coalesce(F.col("next_page") > F.col("page"), F.lit(False))
    b = b.withColumns({"marked": marked, "ended": F.right(F.rtrim(t, F.lit(CLOSERS)), F.lit(1)).isin(*ENDS) & ~marked, "leaves": leaves, "letters": F.length("look")})
    upper = F.coalesce(F.col("next_start").rlike(r"^\p{Lu}"), F.lit(False))
    last = F.substring_index("t", "\n", -1)
    return b.select(
        "record_id", "block_order", "source", "paper_id", "kind", "page", "text", "look", "letters", "ended", "marked", "leaves",
        F.octet_length("text").alias("bytes"),
        F.length("text").alias("chars"),
        _same(F.substring("look", 1, 2 * WINDOW)).alias("same"),
        _same("text").alias("version"),
        F.when(~F.col("ended"), _line(last)).alias("line"),
        F.coalesce(F.trim(last).rlike(NUMBER), F.lit(False)).alias("numbered"),
        F.contains("t", F.lit("\n")).alias("lined"),
        F.coalesce(F.col("next_start").rlike(r"^[\p{Ll}\p{Lo}]"), F.lit(False)).alias("next_lower"),
        upper.alias("next_upper"),
        F.when(F.col("ended"), "ended").when(leaves & F.col("next_start").rlike(r"^[\p{Ll}\p{Lo}\p{N}]"), "runs on").otherwise("open").alias("ending"),
        (F.col("t") != F.col("text")).alias("space_end"),
        F.right("t", F.lit(1)).rlike(r"[\x21-\x7E]").alias("ascii_end"),
        F.right("t", F.lit(1)).rlike(r"[\p{L}\p{N}]").alias("letter_end"),
    )


def _line(line: Column) -> Column:
    """What lines of site text or running heads share: their letters."""
    return F.xxhash64(F.lower(F.regexp_replace(line, r"\P{L}+", "")))


# --- lengths ---------------------------------------------------------------------------------------------------------


def _normal_tail(a: float) -> float:
    """The hazard of the standard normal at ``a``."""
    from math import erfc, exp, pi

    tail = 0.5 * erfc(a / sqrt(2))
    return exp(-a * a / 2) / sqrt(2 * pi) / tail if tail > 1e-12 else a + 1 / max(a, 1.0)


def censoring(length: np.ndarray, ending: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """(posterior of each row, limits) for the histogram of one source's lengths; ``ending`` says which rows end properly
    ("ended", or True), are "open" (or False), or may be open because the text "runs on" elsewhere."""
    from math import erf

    ending = np.where(ending, "ended", "open") if ending.dtype == bool else ending
    posterior, limits = np.zeros(len(n)), []
    hists = {e: {int(v): float(k) for v, k, x in zip(length, n, ending) if x == e} for e in ("ended", "open", "runs on")}
    near = lambda hist, v: float(np.mean([hist.get(v + d, 0.0) for d in (*range(-20, -REACH), *range(REACH + 1, 21)) if v + d > 0]))
    for v, k in hists["open"].items():
        around = near(hists["open"], v)
        if k >= 4 and (k - around) / sqrt(around + 1) >= PILE_Z:
            limits.append(v)
    if not limits:
        return posterior, limits
    at = np.isin(length, limits)
    log, weight = np.log(np.maximum(length, 1)), n.astype(float)
    mu = float(np.average(log, weights=weight))
    sigma = max(float(np.sqrt(np.average((log - mu) ** 2, weights=weight))), 0.05)
    share = np.where(at, 0.9, 0.0)
    for _ in range(30):
        # E: the censored part of each pile has the moments of the tail; M: a weighted normal fit of the logs.
        first, second = log.copy(), log**2
        for i in np.flatnonzero(at):
            a = (log[i] - mu) / sigma
            hazard = _normal_tail(a)
            m1 = mu + sigma * hazard
            m2 = mu * mu + 2 * mu * sigma * hazard + sigma * sigma * (1 + a * hazard)
            first[i], second[i] = share[i] * m1 + (1 - share[i]) * log[i], share[i] * m2 + (1 - share[i]) * log[i] ** 2
        new = float(np.average(first, weights=weight))
        sigma = max(sqrt(max(float(np.average(second, weights=weight)) - new * new, 0.0)), 0.05)
        done, mu = abs(new - mu) < 1e-6, new
        for e, hist in hists.items():
            total = weight[ending == e].sum()
            for i in np.flatnonzero(at & (ending == e)):
                cdf = lambda x: 0.5 * (1 + erf((np.log(max(x, 0.5)) - mu) / sigma / sqrt(2)))
                whole = total * (cdf(length[i] + 0.5) - cdf(length[i] - 0.5))
                # The fit is smooth; texts of one length can be commoner than it says, as their neighbours are.
                whole = max(0.0 if e == "open" else whole, near(hist, int(length[i])))
                # A proper end, or a text that runs on, speaks for a whole one: only what exceeds chance counts against it.
                whole += 0.0 if e == "open" else 2 * sqrt(whole + 1) if e == "ended" else sqrt(whole)
                share[i] = max(0.0, 1 - whole / n[i])
        if done:
            break
    posterior[at] = share[at]
    return posterior, sorted(limits)


def posteriors(blocks: DataFrame) -> DataFrame:
    """(source, kind, unit, length, ending, posterior, n): lengths at which values of a source are censored."""
    units = F.explode(F.array(F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length")), F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")))).alias("u")
    # Versions of one block in several records are one text: together they would look like a pile.
    hist = blocks.select("source", "kind", "ending", "same", units).select("source", "kind", "u.unit", "u.length", "ending", "same").distinct()
    hist = hist.groupBy("source", "kind", "unit", "length", "ending").agg(F.count("*").alias("n"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        p, _ = censoring(pdf["length"].to_numpy(), pdf["ending"].to_numpy(), pdf["n"].to_numpy(float))
        return pdf.assign(posterior=p)[p > 0.05]

    schema = "source string, kind string, unit string, length int, ending string, n bigint, posterior double"
    return hist.groupBy("source", "kind", "unit").applyInPandas(fit, schema)


# --- endings ---------------------------------------------------------------------------------------------------------


def _caption_words(captions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, words) of captions with their words ``w``: how often two words, and a word, stand inside and at the end of
    captions; of a word also how often the most frequent longer word stands that begins with it."""
    n = F.size("w")
    each = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.get("w", i - 1).alias("before"), F.get("w", i).alias("word"), (i == n - 1).cast("int").alias("end")))
    pairs = cut(captions.filter(n >= 2).select(F.inline(each)).groupBy("before", "word").agg(F.count("*").alias("n"), F.sum("end").alias("ends")))
    words = pairs.groupBy("word").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    starts = words.select("n", "word", F.explode(F.sequence(F.lit(1), F.greatest(F.length("word") - 1, F.lit(1)))).alias("k")).filter("k < length(word)")
    longer = starts.groupBy(F.expr("substring(word, 1, k)").alias("word")).agg(F.max("n").alias("longer"))
    return pairs, words.join(longer, "word", "left").na.fill(0, ["longer"])


FEATURES = ["paragraph", "marked", "leaves", "next_lower", "next_upper", "ascii_end", "letter_end", "space_end", "log_word", "log_longer", "word_ends", "pair_ends", "log_pair", "lined"]
#: Rows every ending model is taught besides the corpus's, in the order (label, *FEATURES): what an ending says where
#: nothing is known yet.
SEEDS = [
    *[(1, 1, 0, 0, 0, 0, a, e, 0, 0, 0, 0.2, 0.2, 0, n) for a in (0, 1) for e in (0, 1) for n in (0, 1)],
    *[(1, 1, 0, 1, 0, 1, 1, e, 0, 0, 0, 0.2, 0.2, 0, n) for e in (0, 1) for n in (0, 1)],
    *[(0, 1, 0, 1, lower, 0, 1, e, 0, 0, 0, 0.2, 0.2, 0, n) for lower in (0, 1) for e in (0, 1) for n in (0, 1)],
    *[(1, p, 1, v, lower, 0, 0, 0, 0, 0, 0, 0.2, 0.2, 0, n) for p in (0, 1) for v, lower in ((0, 0), (1, 0), (1, 1)) for n in (0, 1)],
    *[(1, p, 0, v, lower, 0, 1, 1, 1, 0, 0, 0.2, 0.2, 0, n) for p in (0, 1) for v, lower in ((0, 0), (1, 0), (1, 1)) for n in (0, 1)],
    *[(0, 0, 0, 0, 0, 0, 1, 1, 0, w, 0, e, e, 0, n) for w in (0, 2) for e in (0.2, 0.7) for n in (0, 1)],
    *[(1, 0, 0, 0, 0, 0, 1, 1, 0, w, 2, 0.01, 0.01, 0, n) for w in (0, 3) for n in (0, 1)],
]


@F.arrow_udf(T.StructType([T.StructField("rest", T.StringType()), T.StructField("more", T.IntegerType())]))
def _after(mine: pa.Array, others: pa.Array, edits: pa.Array) -> pa.Array:
    """What stands in another text after the letters of this one, if it goes on there in the same line: the next letters
    and how many letters are left; null if it doesn't. Misread letters may have moved that place by as many: it is where
    the last letters are the same."""
    import re

    rest, more = [], []
    look, lig = str.maketrans(CYRILLIC + GREEK + WIDE, CYRILLIC_AS + GREEK_AS + WIDE_AS), re.compile("[" + "".join(LIGATURES) + "]").sub
    for letters, text, far in zip(mine.to_pylist(), others.to_pylist(), edits.to_pylist()):
        n, at, k = len(letters), 0, 0
        text = lig(lambda m: LIGATURES[m[0]], text.translate(look))
        if far:
            all_ = "".join(c for c in text.lower() if c.isalnum())
            ends = [d for d in sorted(range(-far, far + 1), key=abs) if all_[: n + d].endswith(letters[-LAST:])]
            n += ends[0] if ends else 0
        while k < n and at < len(text):
            k += text[at].isalnum()
            at += 1
        on = re.match(r"([-‐¬\xad]\n|[^\w\n])*\w", text[at:])
        left = "".join(c for c in text[at:] if c.isalnum()) if on else ""
        rest.append(left[: 2 * NEXT] or None)
        more.append(len(left))
    return pa.StructArray.from_arrays([pa.array(rest, pa.string()), pa.array(more, pa.int32())], ["rest", "more"])


def _windows(df: DataFrame, *keep: str, off: tuple[int, ...] = (0,)) -> DataFrame:
    """(*keep, key): the keys of a text's windows; of the second one also at places ``off`` by some letters."""
    first = F.when(F.col("letters") >= WINDOW, _same(F.lit(0), F.substring("look", 1, WINDOW)))
    second = [F.when(F.col("letters") >= 2 * WINDOW + max(off), _same(F.lit(1), F.substring("look", WINDOW + 1 + d, WINDOW))) for d in off]
    return df.select(*keep, F.explode(F.filter(F.array(first, *second), lambda k: k.isNotNull())).alias("key"))


def _beginnings(blocks: DataFrame) -> DataFrame:
    """(record_id, block_order, version): texts in the place of a block too short for a window that begin with it. The
    block's own record must not hold the longer one, nor the other record the short one."""
    place = ["paper_id", "page", "kind", F.substring("look", 1, 1).alias("first")]
    on = ["paper_id", "page", "kind", "first"]
    mine = blocks.filter((F.col("letters") < WINDOW) & (F.col("letters") > 0)).select(*place, "look").distinct()
    other = blocks.select(*place, F.substring("look", 1, 2 * WINDOW).alias("begin"), F.col("same").alias("longer")).distinct()
    # A figure that goes on in figures is another one.
    other_number = F.col("look").rlike(r"\p{N}$") & F.expr("substring(begin, length(look) + 1, 1)").rlike(r"\p{N}")
    pairs = mine.join(other, on).filter(F.col("begin").startswith(F.col("look")) & (F.length("begin") > F.length("look")) & ~other_number)
    pairs = cut(pairs.select(_same("look").alias("same"), "longer").distinct())
    held = blocks.select("record_id", F.col("same").alias("longer")).join(pairs, "longer").join(blocks.select("record_id", "same"), ["record_id", "same"], "left_anti")
    found = blocks.select("record_id", "block_order", "same").join(held.select("same", "longer").distinct(), "same")
    found = found.join(blocks.select("record_id", F.col("same").alias("longer")), ["record_id", "longer"], "left_anti")
    return found.join(blocks.select(F.col("same").alias("longer"), "version"), "longer").select("record_id", "block_order", "version")


def _nowhere_later(proofs: DataFrame, records: DataFrame) -> DataFrame:
    """Proofs (record_id, block_order, rest) whose rest, a few misread letters aside, begins no later block of the record."""
    ids = small_or_shuffled(cut(proofs.select("record_id").distinct()))
    later = records.join(ids, "record_id", "left_semi").select("record_id", F.inline("blocks"))
    first = F.regexp_extract("text", rf"^(?:[^\p{{L}}\p{{N}}]*[\p{{L}}\p{{N}}]){{1,{NEXT}}}", 0)  # so many letters, and what stands between
    later = later.select("record_id", F.col("order").alias("at"), F.substring(_look(first), 1, NEXT).alias("begin"))
    n = F.least(F.length("begin"), F.length("rest"))
    both = F.levenshtein(F.left("begin", n), F.left("rest", n)) * 8 <= n
    found = proofs.join(later, "record_id").filter((F.col("at") > F.col("block_order")) & (n >= F.least(F.lit(8), F.length("rest"))) & both)
    return proofs.join(found.select("record_id", "block_order", "rest").distinct(), ["record_id", "block_order", "rest"], "left_anti")


def longer_versions(blocks: DataFrame, records: DataFrame) -> DataFrame:
    """(record_id, block_order) of the blocks that another record of the paper holds with more text. All its versions
    there are asked; a few letters may be misread between them."""
    id_ = ["record_id", "block_order"]
    # First only lengths are compared, texts just where one is longer; equal texts of a paper count as one.
    has = cut(_windows(blocks, "record_id", "letters", "version"))
    most = has.groupBy("key").agg(F.max("letters").alias("most"), F.min("letters").alias("least"), F.count_distinct("record_id").alias("held")).filter("held > 1 AND most > least")
    asks = _windows(blocks, *id_, "letters", off=(-1, 0, 1)).join(most.drop("least", "held"), "key").filter("most > letters").select(*id_, "letters", "key")
    others = has.select("key", F.col("letters").alias("more"), "version").distinct()
    asked = asks.join(others, "key").filter("more > letters").select(*id_, "version").unionByName(_beginnings(blocks))
    asked = cut(asked.distinct())
    versions = blocks.join(small_or_shuffled(cut(asked.select("version").distinct())), "version", "left_semi")
    versions = versions.select("version", F.col("text").alias("other"), F.col("look").alias("other_look")).dropDuplicates(["version"])
    mine = blocks.join(small_or_shuffled(cut(asked.select(*id_).distinct())), id_, "left_semi").select(*id_, "look", "letters", "ended")
    pairs = mine.join(asked, id_).join(versions, "version")
    allowed = F.floor(F.col("letters") / MISREAD).cast("int")
    edits = F.when(F.col("other_look").startswith(F.col("look")), 0).otherwise(F.expr(f"levenshtein(look, left(other_look, letters), CAST(letters / {MISREAD} AS INT))"))
    pairs = cut(pairs.withColumn("edits", edits).filter((F.col("edits") >= 0) & (F.col("edits") <= allowed)))
    # In a text of one line it goes on in the line if it goes on at all.
    plain = (F.col("edits") == 0) & ~F.contains("other", F.lit("\n"))
    easy = pairs.filter(plain).select(*id_, "ended", "edits", F.expr(f"substring(other_look, letters + 1, {2 * NEXT})").alias("rest"), (F.length("other_look") - F.col("letters")).alias("more"))
    hard = pairs.filter(~plain).select(*id_, "ended", "edits", _after("look", "other", "edits").alias("a")).select(*id_, "ended", "edits", _look(F.col("a.rest")).alias("rest"), "a.more")
    after = cut(easy.unionByName(hard).filter("rest <> '' AND more > 2 * edits"))
    # What follows a proper end may stand in the record as a block of its own.
    lost = _nowhere_later(after.filter("ended").select(*id_, "rest").distinct(), records).select(*id_)
    return cut(after.filter(~F.col("ended")).select(*id_).unionByName(lost).distinct())


def foreign_endings(blocks: DataFrame, records: DataFrame) -> DataFrame:
    """(record_id, block_order) of the open blocks that end in a line of the site, a running head or a page number; that
    says nothing about the block's own end."""
    id_ = ["record_id", "block_order"]
    asked = cut(blocks.filter(~F.col("ended")).select(*id_, "source", "paper_id", "line", "lined", "numbered"))
    keys = small_or_shuffled(cut(asked.select("line").distinct()))
    site = F.coalesce("source", F.lit("")).alias("source")
    lines = records.select(site, "paper_id", F.inline("blocks")).filter("kind <> 'table'")
    lines = lines.select("source", "paper_id", "page", F.explode(F.split("text", "\n")).alias("l")).select("source", "paper_id", "page", _line(F.col("l")).alias("line"))
    seen = cut(lines.join(keys, "line", "left_semi").distinct())
    papers = records.select(site, "paper_id").distinct().groupBy("source").agg(F.count("*").alias("source_papers"))
    often = seen.select("source", "line", "paper_id").distinct().groupBy("source", "line").agg(F.count("*").alias("line_papers")).join(papers, "source")
    often = often.filter((F.col("line_papers") >= SITE_PAPERS) & (F.col("line_papers") >= SITE_SHARE * F.col("source_papers"))).select("source", "line")
    head = seen.groupBy("paper_id", "line").agg(F.count_distinct("page").alias("pages")).filter("pages >= 2").select("paper_id", "line")
    out = asked.join(often, ["source", "line"], "left_semi").select(*id_)
    out = out.unionByName(asked.filter("lined").join(head, ["paper_id", "line"], "left_semi").select(*id_))
    return cut(out.unionByName(asked.filter("lined AND numbered").select(*id_)).distinct())


def _with_endings(blocks: DataFrame, doubtful: DataFrame) -> DataFrame:
    """``doubtful`` blocks with the features of their endings; captions are judged by all whole captions' words."""
    words = F.filter(F.split(F.lower(F.col("form")), r"[^\p{L}\p{N}'’₀-₉⁰-⁹-]+"), lambda w: w != "")
    captions = blocks.filter("kind = 'caption'").withColumn("form", one_form(F.col("text"))).select("record_id", "block_order", words.alias("w"))
    captions = cut(captions)
    pairs, single = _caption_words(captions)
    ends = captions.filter(F.size("w") > 0).select("record_id", "block_order", F.element_at("w", -1).alias("word"), F.when(F.size("w") >= 2, F.get("w", F.size("w") - 2)).alias("before"))
    d = doubtful.join(ends, ["record_id", "block_order"], "left")
    d = d.join(small_or_shuffled(cut(single.select("word", F.col("n").alias("word_n"), F.col("ends").alias("word_e"), "longer"))), "word", "left")
    d = d.join(small_or_shuffled(cut(pairs.select("before", "word", F.col("n").alias("pair_n"), F.col("ends").alias("pair_e")))), ["before", "word"], "left")
    d = d.na.fill(0, ["word_n", "word_e", "longer", "pair_n", "pair_e"])
    log = lambda c: F.log1p(F.col(c).cast("double"))
    values = {
        "paragraph": F.col("kind") == "paragraph",
        "marked": F.col("marked"),
        "leaves": F.col("leaves"),
        "next_lower": F.col("next_lower") & F.col("leaves"),
        "next_upper": F.col("next_upper") & F.col("leaves"),
        "ascii_end": F.col("ascii_end"),
        "letter_end": F.col("letter_end"),
        "space_end": F.col("space_end"),
        "log_word": log("word_n"),
        "log_longer": log("longer"),
        "word_ends": (F.col("word_e") + 0.2) / (F.col("word_n") + 1),
        "pair_ends": (F.col("pair_e") + 0.2) / (F.col("pair_n") + 1),
        "log_pair": log("pair_n"),
        "lined": F.col("lined"),
    }
    return d.withColumns({f"f_{k}": values[k].cast("float") for k in FEATURES})


def _odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-3)), F.lit(1 - 1e-3))
    return p / (1 - p)


def cut_blocks(records: DataFrame) -> DataFrame:
    """(record_id, block_order, source, kind, score) of every paragraph and caption judged to be cut."""
    id_ = ["record_id", "block_order"]
    records = drop_redelivered(records.select("record_id", "paper_id", "source", "blocks", "loaded_at"), "record_id", "loaded_at")
    blocks = cut(prose_blocks(records))

    limits = cut(posteriors(blocks))
    b = blocks.drop("text", "look")
    for unit in ("bytes", "chars"):
        at = limits.filter(F.col("unit") == unit).select("source", "kind", F.col("length").alias(unit), "ending", F.col("posterior").alias(f"by_{unit}"))
        b = b.join(small_or_shuffled(cut(at)), ["source", "kind", unit, "ending"], "left")
    b = b.withColumn("posterior", F.greatest(F.coalesce("by_bytes", F.lit(0.0)), F.coalesce("by_chars", F.lit(0.0)))).drop("by_bytes", "by_chars")

    proven = longer_versions(blocks, records).withColumn("proven", F.lit(True))
    versions = blocks.groupBy("same").agg(F.max("letters").alias("most"), F.count_distinct("record_id").alias("held"))
    b = b.join(versions, "same").join(small_or_shuffled(proven), id_, "left")
    b = b.withColumn("proven", F.coalesce("proven", F.lit(False))).withColumn("shown", (F.col("held") > 1) & ((F.col("letters") == F.col("most")) | F.col("proven")))
    b = cut(b.join(small_or_shuffled(foreign_endings(blocks, records)), id_, "left_anti"))

    d = _with_endings(blocks, b.filter("NOT ended"))
    keep = [*id_, "source", "kind", "posterior", "proven", "shown"]
    d = cut(d.select(*keep, *[f"f_{k}" for k in FEATURES]))
    # A block as long as its longest version is whole, unless all versions were cut at one limit.
    labelled = d.filter((F.col("posterior") < 0.5) & (F.col("shown") | F.col("proven")))
    model = train(labelled.select(F.col("proven").cast("int").alias("label"), *[F.col(f"f_{k}").alias(k) for k in FEATURES]), SEEDS)

    # One row of rates: of labelled endings, of properly ended texts, and of proofs where the length says that a text was cut.
    rates = b.agg(
        F.count_if(F.expr("NOT ended AND posterior < 0.5 AND proven")).alias("open_cut"),
        F.count_if(F.expr("NOT ended AND posterior < 0.5 AND (shown OR proven)")).alias("open"),
        F.count_if(F.expr("ended AND posterior < 0.5 AND proven")).alias("ended_cut"),
        F.count_if(F.expr("ended AND posterior < 0.5 AND (shown OR proven)")).alias("ended"),
        F.count_if(F.expr("NOT ended AND posterior >= 0.9 AND proven")).alias("limit_proven"),
        F.count_if(F.expr("NOT ended AND posterior >= 0.9 AND (shown OR proven)")).alias("limit"),
    ).head()
    share = lambda a, n: (rates[a] + 0.5) / (rates[n] + 1)
    base, told = share("open_cut", "open"), share("limit_proven", "limit")
    others = F.when(F.col("proven"), told / PROOF_ERROR).when(F.col("shown"), 1 - told).otherwise(1.0)
    here = F.when(F.col("posterior") > 0, _odds(F.col("posterior")))
    ending = _odds(scorer(model)(F.array(*[F.col(f"f_{k}") for k in FEATURES])))
    # The model's labels are rows away from limits: there its odds are the class's times the ending's.
    d = d.withColumn("odds", F.greatest(F.coalesce(here * (1 - base) / base, F.lit(0.0)), F.lit(1.0)) * ending * others)
    e = b.filter("ended").withColumn("odds", F.greatest(F.coalesce(here, F.lit(0.0)), F.lit(share("ended_cut", "ended"))) * others)
    out = d.select(*keep, "odds").unionByName(e.select(*keep, "odds")).filter("odds >= 1")
    return out.select(*id_, "source", "kind", (F.col("odds") / (1 + F.col("odds"))).alias("score"))


def shares(records: DataFrame) -> DataFrame:
    """(source, blocks, cut_blocks, cut_share): how often each source truncates its paragraphs and captions."""
    found = cut_blocks(records).groupBy("source").agg(F.count("*").alias("cut_blocks"))
    n = F.size(F.filter("blocks", lambda b: b["kind"].isin("paragraph", "caption") & (F.trim(b["text"]) != "")))
    each = one_per_key(records.select("record_id", F.coalesce("source", F.lit("")).alias("source"), F.greatest(n, F.lit(0)).alias("n")), "record_id")
    total = each.groupBy("source").agg(F.sum("n").alias("blocks"))
    out = total.join(found, "source", "left").na.fill(0, ["cut_blocks"])
    return out.select(F.when(F.col("source") != "", F.col("source")).alias("source"), "blocks", "cut_blocks", F.try_divide(F.col("cut_blocks"), F.col("blocks")).alias("cut_share"))
