"""Mixing sources to target weights (problem 9).

Sizes are tokens of a public tokenizer. Every source's records are hashed into blocks of about equal size; the largest
total is chosen at which every source that has records reaches its target share within its repetition cap; the exact
block quotas of all sources are divided among output shards by a splitting tree, each node drawing its left half from
the multivariate hypergeometric distribution; each shard then takes disjoint blocks from each source's permuted order and
orders its records by a hash of its own.

Defined results: null and empty texts have no tokens and are left out (they add nothing to any share); a source without
a target, or null, is left out and reported with target share 0; a target source without records is reported with share 0 and the
other shares are taken relative to each other; repeated rows are records of their own; empty tables give empty outputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.tokens import TOKENIZER_DIR, VOCABULARY, count_tokens
from scriptorium.runtime import cut

#: Blocks of one source at most: bounds every window below, whatever the corpus holds.
MAX_BLOCKS = 65_536
#: A block aims at this many tokens where the source is small enough.
BLOCK_TOKENS = 2_000
#: Blocks one output shard holds on average.
SHARD_BLOCKS = 64


def draw_path(quotas: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of each source before this shard, and in it: the walk from the root of the splitting tree to its leaf.

    A node over shards lo..hi has a fixed draw (its seed is the node), so all shards see the same tree without sharing it.
    """
    lo, hi, q, before = 0, shards, quotas.astype(np.int64), np.zeros(len(quotas), np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        take = int(q.sum()) * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(q, take, method="marginals") if q.sum() else q * 0
        if shard < mid:
            hi, q = mid, left
        else:
            before, lo, q = before + left, mid, q - left
    return before, q


def plan(totals: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """(source, target_share, max_repeats, available, quota): one row per source; the number of sources is that of the targets."""
    t = targets.where("source IS NOT NULL AND target_share > 0").select("source", "target_share", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
    a = t.join(totals, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("available", F.lit(0)).alias("available"))
    have = F.when(F.col("available") > 0, F.col("target_share")).otherwise(F.lit(0.0))
    s = a.agg(F.sum(have).alias("mass"), F.min(F.when(F.col("available") > 0, F.col("max_repeats") * F.col("available") / F.col("target_share"))).alias("feasible"))
    total = F.col("feasible") * F.col("mass") if total_tokens is None else F.lit(float(total_tokens))
    return a.join(F.broadcast(s)).select(  # s is one row
        "source", "target_share", "max_repeats", "available",
        F.when(F.col("available") > 0, F.least(F.col("max_repeats") * F.col("available").cast("double"), total * F.col("target_share") / F.col("mass"))).otherwise(F.lit(0.0)).alias("quota"),
    )


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    """Blocks in their permuted order, each if it fits what is left, and at last the one that brings the sum nearest to it, if that is nearer than none."""
    pdf = pdf.sort_values(["h", "block"])
    left = float(pdf["left"].iloc[0])
    take, others = [], []
    for i, n in enumerate(pdf["tokens"].tolist()):
        if n <= left:
            take.append(i)
            left -= n
        else:
            others.append((n, i))
    if others and abs(min(others)[0] - left) < left:
        take.append(min(others)[1])
    return pdf.iloc[take][["source", "block", "tokens", "h", "copy"]]


def mix(
    documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 17,
    directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS, shard_blocks: int = SHARD_BLOCKS,
) -> tuple[DataFrame, DataFrame]:
    """The mixture (doc_id, source, copy, n_tokens, shard, position) and its report (source, target_share, available_tokens, mixed_tokens, repeats, actual_share)."""
    sized = count_tokens(documents.select("doc_id", "source", "text"), directory=directory, vocabulary=vocabulary).drop("text").where("n_tokens > 0")
    sized = cut(sized, "sized")
    totals = sized.where("source IS NOT NULL").groupBy("source").agg(F.sum("n_tokens").alias("available"))
    p = cut(plan(totals, targets, total_tokens), "plan")
    spark = documents.sparkSession
    # one block number per record, spread by hash: a source never sits in one task
    blocks = p.where("available > 0").select("source", "quota", "available", F.least(F.lit(MAX_BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("available") / block_tokens))).cast("int").alias("n_blocks"))
    rec = sized.join(F.broadcast(blocks.select("source", "n_blocks")), "source").withColumn(  # a row a target source
        "block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("n_blocks")).cast("int"))
    rec = cut(rec.drop("n_blocks"), "records")
    size = rec.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"))
    # permuted order of a source's blocks (at most MAX_BLOCKS); whole rounds of them, then as many as fit what is left of the quota
    order = size.join(F.broadcast(blocks.select("source", "quota", "available")), "source").withColumn("h", F.xxhash64("block", F.lit(seed + 1)))
    rounds = order.withColumn("rounds", F.floor(F.col("quota") / F.col("available") + 1e-9).cast("int"))
    whole_rounds = rounds.where("rounds > 0").select("source", "block", "tokens", "h", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)).alias("copy"))
    rest = rounds.select("source", "block", "tokens", "h", F.col("rounds").alias("copy"), (F.col("quota") - F.col("rounds") * F.col("available")).alias("left"))
    last = rest.groupBy("source").applyInPandas(_fill, "source string, block int, tokens bigint, h bigint, copy int")
    rank = Window.partitionBy("source").orderBy("copy", "h", "block")
    kept = whole_rounds.unionByName(last).withColumn("rank", F.row_number().over(rank) - 1)
    kept = cut(kept.select("source", "block", "copy", "tokens", "rank"), "kept")
    quotas = {r["source"]: int(r["n"]) for r in kept.groupBy("source").agg(F.count("*").alias("n")).collect()}  # a number a target source
    names = sorted(quotas)
    q = np.array([quotas[k] for k in names], np.int64)
    shards = max(1, int(-(-q.sum() // shard_blocks))) if len(q) else 1

    def walk(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for i in pdf["id"]:
                before, own = draw_path(q, shards, int(i), seed)
                # each shard draws its blocks out of the permuted order at ranks before..before + own
                yield pd.DataFrame({"source": names, "shard": int(i), "lo": before, "n": own}).query("n > 0")

    ranges = spark.range(shards).mapInPandas(walk, "source string, shard int, lo bigint, n bigint")
    at = ranges.select("source", "shard", F.explode(F.sequence(F.col("lo"), F.col("lo") + F.col("n") - 1)).alias("rank"))
    drawn = kept.join(at, ["source", "rank"]).select("source", "block", "copy", "shard")
    out = rec.join(drawn, ["source", "block"])
    # the local shuffle: a shard holds about shard_blocks blocks, so its window is bounded
    local = Window.partitionBy("shard").orderBy(F.xxhash64("doc_id", "copy", "shard", F.lit(seed)), "doc_id", "copy")
    out = out.select("doc_id", "source", "copy", "n_tokens", "shard", (F.row_number().over(local) - 1).alias("position"))
    mixed = kept.groupBy("source").agg(F.sum("tokens").alias("mixed_tokens"))
    whole = mixed.agg(F.sum("mixed_tokens").alias("whole"))
    every = p.select("source", "target_share", F.col("available").alias("available_tokens")).unionByName(
        totals.join(targets.where("target_share > 0").select("source"), "source", "left_anti").select("source", F.lit(0.0).alias("target_share"), F.col("available").alias("available_tokens")))
    rep = every.join(mixed, "source", "left").join(F.broadcast(whole)).select(  # whole is one row
        "source", "target_share", "available_tokens", F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"),
        F.round(F.when(F.col("available_tokens") > 0, F.coalesce("mixed_tokens", F.lit(0)) / F.col("available_tokens")).otherwise(F.lit(0.0)), 6).alias("repeats"),
        F.round(F.when(F.col("whole") > 0, F.coalesce("mixed_tokens", F.lit(0)) / F.col("whole")).otherwise(F.lit(0.0)), 6).alias("actual_share"),
    )
    return out, rep
