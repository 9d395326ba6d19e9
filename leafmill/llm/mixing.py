"""One mix of several sources with target shares of the tokens.

The tokens of each source's documents, in a pseudorandom order of the documents, are packed into blocks of a fixed length.
The mix is a sequence of shards of slots, one block each. How many slots a source has is fixed by its target, the mix's
size and how often its documents may be repeated; which shard they fall in is drawn: a multinomial draw for each shard,
conditioned on the sources' totals (so that the shares are met exactly, not only on average), made by halving the sequence
of shards again and again with draws seeded by the place in that tree, so that each shard finds its counts on its own.
A source's n-th slot takes the block that a keyed permutation of the source's block numbers puts there, another permutation
for each repeat, so every block occurs equally often, within one. Blocks are then joined by number.

Sizes: the mix has ``total`` tokens, by default as many as the documents of all sources with a target. A source that can't
reach its share even with all repeats is used that often; what is missing goes to the others in proportion to their shares.

Defined cases: null and empty texts have no tokens and are in no block; sources without a target stay out; a target
without documents, without a share or with a null source gets nothing; a null ``max_repeats`` is 1; of several targets for
one source the largest share counts; without any tokens the mix is empty. The last block of a source's
bucket may be shorter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from leafmill.llm.tokens import VOCABULARY, with_ids
from leafmill.session import cut, small_or_shuffled

#: Tokens of a block, slots of a shard, tokens of the documents whose places are summed up in one task.
BLOCK, SHARD, BUCKET = 512, 4096, 2_000_000
#: Totals below which the generator draws itself.
RANGE = 900_000_000
SEED = 17


def quotas(tokens: dict[str, int], targets: dict[str, tuple[float, int]], total: int) -> dict[str, float]:
    """Tokens of each source in the mix: its share of ``total``, at most its repeats, the rest shared out in proportion."""
    cap = {s: tokens.get(s, 0) * r for s, (_, r) in targets.items()}
    out = {s: 0.0 for s in targets}
    open_ = {s for s, (share, _) in targets.items() if share > 0 and cap[s] > 0}
    rest = float(min(total, sum(cap[s] for s in open_)))
    while open_:
        unit = rest / sum(targets[s][0] for s in open_)
        full = {s for s in open_ if targets[s][0] * unit >= cap[s]}
        if not full:
            out.update({s: targets[s][0] * unit for s in open_})
            break
        for s in full:
            out[s] = float(cap[s])
            rest -= cap[s]
        open_ -= full
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without replacement are good. Beyond the generator's range the same distribution is inverted
    over its whole mass: chances relative to the mode's, by their exact ratios, 12 standard deviations either way."""
    total = good + bad
    if total < RANGE:
        return int(rng.hypergeometric(good, bad, n))
    lo, hi = max(0, n - bad), min(n, good)
    mode = (n + 1) * (good + 1) // (total + 2)
    reach = int(12 * (n * (good / total) * (bad / total) * ((total - n) / (total - 1))) ** 0.5) + 12
    a, b = max(lo, mode - reach), min(hi, mode + reach)
    k = np.arange(a, b, dtype=np.float64)
    log = np.concatenate([[0.0], np.cumsum(np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1))])
    upto = np.cumsum(np.exp(log - log.max()))
    return a + int(np.searchsorted(upto, rng.random() * upto[-1], side="right"))


@lru_cache(1 << 12)
def _draw(seed: int, lo: int, hi: int, counts: tuple[int, ...], n: int) -> tuple[int, ...]:
    """How many of each source are among ``n`` slots drawn from ``counts`` without replacement, source by source; the
    draws of the upper levels are the same for all shards and kept."""
    rng, rest, out = np.random.default_rng([seed, lo, hi]), sum(counts), []
    for c in counts:
        rest -= c
        out.append(n if rest == 0 else _hypergeometric(rng, c, rest, n) if c and n else 0)
        n -= out[-1]
    return tuple(out)


def shard_counts(counts: np.ndarray, shard: int, shards: int, slots: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source in the shard, slots of each source before it)."""
    total, before = int(counts.sum()), np.zeros(len(counts), np.int64)
    here, lo, hi = counts.astype(np.int64), 0, shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        first = min(mid * slots, total) - lo * slots
        left = np.array(_draw(seed, lo, hi, tuple(here.tolist()), first), np.int64)
        if shard < mid:
            here, hi = left, mid
        else:
            before, here, lo = before + left, here - left, mid
    return here, before


def _scramble(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    x = (x ^ key) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def permute(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A keyed permutation of range(size) applied to ``index``: a Feistel network over the next even power of two, walked
    until it falls inside."""
    if size <= 1:
        return index.copy()
    half = max(1, (int(size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng([key, size]).integers(0, 1 << 63, 4).astype(np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> np.uint64(half), x & mask
        for k in keys:
            a, b = b, a ^ (_scramble(b, k) & mask)
        return a << np.uint64(half) | b

    out = once(index.astype(np.uint64))
    while (outside := out >= np.uint64(size)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def packed(documents: DataFrame, targets: DataFrame, block: int = BLOCK, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(blocks, totals): the blocks of each source (source, block, doc_ids, ids), and of each source the number of its
    documents, tokens and blocks.

    Sources are split into buckets by hash, so that no task holds more than about BUCKET tokens; in a bucket a document's
    place is the sum of the tokens before it, and blocks are numbered on from bucket to bucket. Each text is encoded once,
    and its tokens cross the network once before they are in their blocks.
    """
    docs = documents.join(small_or_shuffled(cut(targets.select("source"))), "source").filter(F.length("text") > 0)
    docs = cut(with_ids(docs.select("source", "doc_id", "text"), vocabulary=vocabulary).select("source", "doc_id", "ids", F.size("ids").cast("bigint").alias("n")))
    totals = docs.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"))
    totals = cut(totals.withColumn("buckets", F.ceil(F.col("tokens") / BUCKET)))
    sized = docs.withColumn("h", F.xxhash64("doc_id", F.lit(SEED))).join(small_or_shuffled(totals.select("source", "buckets")), "source")
    sized = sized.withColumn("bucket", F.pmod(F.shiftright("h", 8), F.col("buckets"))).drop("buckets")
    sums = sized.groupBy("source", "bucket").agg(F.ceil(F.sum("n") / block).alias("blocks"))
    ahead = F.sum("blocks").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = cut(sums.select("source", "bucket", "blocks", F.coalesce(ahead, F.lit(0)).alias("ahead")))
    totals = totals.drop("buckets").join(sums.groupBy("source").agg(F.sum("blocks").alias("blocks")), "source")
    upto = F.sum("n").over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    placed = sized.withColumn("begin", upto - F.col("n"))
    pieces = placed.withColumn("block", F.explode(F.expr(f"sequence(begin div {block}, (begin + n - 1) div {block})")))
    first = F.greatest(F.col("block") * block - F.col("begin"), F.lit(0))
    last = F.least(F.col("n"), (F.col("block") + 1) * block - F.col("begin"))
    piece = F.struct((F.col("begin") + first).alias("place"), "doc_id", F.slice("ids", (first + 1).cast("int"), (last - first).cast("int")).alias("ids"))
    # A block is at most ``block`` tokens, so its group is bounded; its pieces stand in one partition already.
    blocks = pieces.groupBy("source", "bucket", "block").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    blocks = blocks.join(small_or_shuffled(sums.drop("blocks")), ["source", "bucket"])
    return blocks.select("source", (F.col("ahead") + F.col("block")).alias("block"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"), F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids")), totals


def plan(totals: DataFrame, targets: DataFrame, total: int | None = None) -> list[dict]:
    """Of each target: available tokens and blocks, and slots in the mix. One row for each target; the table of targets is
    a setting, not data."""
    want = {r["source"]: (r["target_share"], r["max_repeats"]) for r in targets.collect()}
    have = {r["source"]: r for r in totals.collect()}
    tokens = {s: have[s]["tokens"] for s in want if s in have}
    share = quotas(tokens, want, sum(tokens.values()) if total is None else total)
    out = []
    for s in sorted(want):
        n = tokens.get(s, 0)
        blocks = have[s]["blocks"] if n else 0
        # A slot gives a block's mean size; the last block may be short.
        slots = min(round(share[s] / (n / blocks)), blocks * want[s][1]) if n else 0
        out.append({"source": s, "target_share": want[s][0], "max_repeats": want[s][1], "documents": have[s]["documents"] if s in have else 0, "tokens": n, "blocks": blocks, "slots": slots})
    return out


def slots(spark, rows: list[dict], per_shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """(shard, slot, source, block, repeat): the mix as block numbers, made shard by shard without a shuffle."""
    schema = "shard bigint, slot int, source string, block bigint, repeat int"
    counts = np.array([r["slots"] for r in rows], np.int64)
    sizes, names = [r["blocks"] for r in rows], [r["source"] for r in rows]
    shards = -(-int(counts.sum()) // per_shard)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                here, before = shard_counts(counts, shard, shards, per_shard, seed)
                which, block, repeat = np.repeat(np.arange(len(here)), here), [], []
                for s, (k, b) in enumerate(zip(here, before)):
                    nth = np.arange(b, b + k)
                    turn, at = np.divmod(nth, max(sizes[s], 1))
                    put = at.copy()
                    for t in np.unique(turn):
                        put[turn == t] = permute(at[turn == t], sizes[s], seed * 1_000_003 + s * 1009 + int(t))
                    block.append(put)
                    repeat.append(turn)
                order = np.random.default_rng([seed, 7, shard]).permutation(len(which))
                block, repeat = np.concatenate(block)[order], np.concatenate(repeat)[order]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(which), shard, np.int64)), pa.array(np.arange(len(which), dtype=np.int32)), pa.array([names[i] for i in which[order]], pa.string()), pa.array(block, pa.int64()), pa.array(repeat.astype(np.int32))], ["shard", "slot", "source", "block", "repeat"])

    return spark.range(shards).repartition(max(1, min(shards, 2 * spark.sparkContext.defaultParallelism + shards // 8))).mapInArrow(make, schema)


def clean_targets(targets: DataFrame) -> DataFrame:
    t = targets.filter(F.col("source").isNotNull() & (F.col("target_share") > 0) & ~F.isnan("target_share"))
    best = F.max_by(F.struct("target_share", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats")), F.struct("target_share", "max_repeats"))
    return cut(t.groupBy("source").agg(best.alias("b")).select("source", "b.target_share", F.greatest("b.max_repeats", F.lit(0)).alias("max_repeats")))


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, block: int = BLOCK, per_shard: int = SHARD, seed: int = SEED, vocabulary: str = VOCABULARY) -> DataFrame:
    """(shard, slot, source, block, repeat, doc_ids, ids): the mix in its order, by (shard, slot)."""
    targets = clean_targets(targets)
    blocks, totals = packed(documents, targets, block, vocabulary)
    rows = plan(totals, targets, total)
    return slots(documents.sparkSession, rows, per_shard, seed).join(blocks, ["source", "block"]).select("shard", "slot", "source", "block", "repeat", "doc_ids", "ids")


def report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, mix_tokens, actual_share, most_repeats) of a mix, one row for each target."""
    t = clean_targets(targets)
    each = cut(mixed.groupBy("source").agg(F.sum(F.size("ids")).alias("mix_tokens"), (F.max("repeat") + 1).alias("most_repeats")))
    all_ = each.agg(F.sum("mix_tokens").alias("all_tokens"))
    out = t.join(each, "source", "left").crossJoin(F.broadcast(all_))  # one row
    return out.select("source", "target_share", "max_repeats", F.coalesce("mix_tokens", F.lit(0)).alias("mix_tokens"), F.coalesce(F.try_divide("mix_tokens", "all_tokens"), F.lit(0.0)).alias("actual_share"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
