"""Splits that keep related records together (problem 1).

Ties become edges between record ids; components come from union-find forests built inside partitions and merged level
by level, every level over fewer vertices (the roots of the level before) and never in one task beyond a fixed number of
edges. Components are then handed to train, dev and test largest first, each to the split furthest below its target.

Defined results: null, blank and placeholder keys tie nothing; a metadata row whose doc_id is null is ignored; a variants
doc_id that stands for no metadata doc_id forms a group of its own; empty inputs give empty outputs; repeated rows
count as rows (they weigh in the shares) but add no ties; other columns are carried by none of the outputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.runtime import cut

#: Names that stand for no author (fixed values), and the first 16 hex digits of the hash of an empty text.
PLACEHOLDERS = ("-", "/", "--", "—", "无", "未知", "佚名", "匿名", "不详", "n/a", "none", "null", "unknown", "anonymous")
EMPTY_HASH = "e3b0c44298fc1c14"
#: Edges one union-find task takes at most; levels are added until the rest fits.
EDGES_PER_TASK = 1_000_000


def blank(c: Column) -> Column:
    return c.isNull() | (F.regexp_replace(c, r"(?U)[\s\u001c-\u001f]+", "") == "")


def names_nobody(c: Column) -> Column:
    return blank(c) | F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")).isin(*PLACEHOLDERS)


#: How an id of this corpus looks inside a longer string.
DOC_ID = r"d\d{10}"


def canonical_doc_id(c: Column, doc_id: str = DOC_ID) -> Column:
    """The metadata doc_id that a doc_id, however written, stands for: without path, year prefix, suffix, extension, case and spaces; doc_id is the pattern of ids."""
    base = F.lower(F.regexp_replace(c, r"(?U)\s+", ""))
    base = F.regexp_replace(base, r"^.*/", "")
    base = F.regexp_replace(base, r"\.[a-z]{1,4}$", "")
    return F.coalesce(F.nullif(F.regexp_extract(base, rf"(?:^|_)({doc_id})(?:_\d+)?$", 1), F.lit("")), base)


def tie_edges(metadata: DataFrame) -> DataFrame:
    """(a, b): each doc_id and the smallest doc_id that shares its paper hash, or its author and school, both exactly as written."""
    m = metadata.select("doc_id", "paper_hash", "author", "school").where(F.col("doc_id").isNotNull())
    by_hash = m.where(~blank(F.col("paper_hash")) & (F.col("paper_hash") != EMPTY_HASH)).select("doc_id", F.struct(F.lit("h").alias("t"), F.col("paper_hash").alias("x"), F.lit("").alias("y")).alias("key"))
    by_name = m.where(~names_nobody(F.col("author")) & ~blank(F.col("school"))).select("doc_id", F.struct(F.lit("n").alias("t"), F.col("author").alias("x"), F.col("school").alias("y")).alias("key"))
    keyed = by_hash.unionByName(by_name).distinct()
    # the smallest id of a key comes from a partial aggregate, so a key that holds a third of all rows stays cheap;
    # the join back is salted by AQE's skew handling since the small side has one row a key
    least = keyed.groupBy("key").agg(F.min("doc_id").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    return keyed.join(least, "key").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct()


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the partition's edges: each vertex with the smallest vertex of its local tree."""
    parent: dict = {}

    def find(x):
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for pdf in batches:
        for a, b in zip(pdf["a"], pdf["b"]):
            for x in (a, b):
                if x not in parent:
                    parent[x] = x
            ra, rb = find(a), find(b)
            if ra != rb:
                if ra < rb:
                    parent[rb] = ra
                else:
                    parent[ra] = rb
    if parent:
        vs = list(parent)
        yield pd.DataFrame({"v": vs, "r": [find(v) for v in vs]})


def components(edges: DataFrame, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """(v, root) for every vertex of edges (a, b): root is the smallest vertex of its component.

    Level by level: local forests; a vertex met in several partitions links their roots; those links are the next
    level's edges. A vertex occurs at most once per partition after the first step, so no group is unbounded.
    """
    level = cut(edges.select("a", "b").where("a <> b"), "edges")
    links: list[DataFrame] = []
    while True:
        n = level.count()
        if n == 0:
            break
        parts = max(1, -(-n // edges_per_task))
        kind = level.schema["a"].dataType.simpleString()
        local = level.repartition(parts, "a").mapInPandas(_forest, f"v {kind}, r {kind}")
        if parts == 1:
            links.append(cut(local.select("v", F.col("r").alias("m")), "forest"))
            break
        local = cut(local, "forest")
        least = local.groupBy("v").agg(F.min("r").alias("m"))
        links.append(cut(least, "links"))
        level = cut(local.join(links[-1], "v").where("r <> m").select(F.col("r").alias("a"), F.col("m").alias("b")).distinct(), "edges")
    if not links:
        kind = edges.schema["a"].dataType.simpleString()
        return edges.sparkSession.createDataFrame([], f"v {kind}, root {kind}")
    # every vertex follows its links downwards: level k's parent is looked up among the vertices of level k + 1
    out = links[-1].select("v", F.col("m").alias("root"))
    for up in reversed(links[:-1]):
        nxt = out.select(F.col("v").alias("m"), "root")
        resolved = up.join(nxt, "m", "left").select("v", F.coalesce("root", "m").alias("root"))
        out = cut(resolved.unionByName(out.join(up.select("v"), "v", "left_anti")), "labels")
    # a root of one level may still have been joined at a later one
    return out


def grouped(metadata: DataFrame, variants: DataFrame, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """(doc_id, group_doc_id, n_meta, n_var): every doc_id string as delivered, its group and how many rows carry it."""
    ids = metadata.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n_meta"))
    comp = components(tie_edges(metadata), edges_per_task)
    labelled = ids.join(comp.withColumnRenamed("v", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("group_doc_id"), "n_meta")
    labelled = cut(labelled, "labelled")
    v = variants.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n_var"))
    v = v.withColumn("c", canonical_doc_id(F.col("doc_id")))
    base = labelled.select(F.col("doc_id").alias("c"), F.col("group_doc_id").alias("g"))
    v = v.join(base, "c", "left").select("doc_id", F.coalesce("g", "c").alias("vg"), "n_var", F.col("g").isNotNull().alias("known"))
    both = labelled.join(v, "doc_id", "full").select(
        "doc_id", F.coalesce("group_doc_id", "vg").alias("group_doc_id"), F.coalesce("n_meta", F.lit(0)).alias("n_meta"),
        F.coalesce("n_var", F.lit(0)).alias("n_var"), F.coalesce(F.col("group_doc_id").isNotNull() | F.col("known"), F.lit(True)).alias("known"),
    )
    return both


def found(metadata: DataFrame, variants: DataFrame) -> DataFrame:
    g = grouped(metadata, variants)
    return g.where("known AND doc_id <> group_doc_id").select("doc_id", "group_doc_id")


def greedy_counts(sizes: list[tuple[int, int]], shares: dict[str, float]) -> dict[int, list[tuple[str, int]]]:
    """For each group size, largest first, how many groups go to which split: always the split furthest below its target.

    Groups of one size are interchangeable, so runs of them are dealt in bulk: the split furthest below gets groups until
    another one is as far below, which needs a number of steps that depends on the splits and not on the groups.
    """
    total = sum(s * c for s, c in sizes)
    names = sorted(shares, key=lambda k: (-shares[k], k))
    need = {k: shares[k] * total for k in names}
    out: dict[int, list[tuple[str, int]]] = {}
    for s, c in sorted(sizes, reverse=True):
        runs: list[tuple[str, int]] = []
        while c:
            top = max(need.values())
            # splits within one group of the furthest are level: they take turns until they meet the next one
            level = [k for k in names if need[k] > top - s]
            below = max((need[k] for k in names if k not in level), default=float("-inf"))
            rounds = min(c // len(level), int((min(need[k] for k in level) - below) // s) if below > float("-inf") else c)
            if rounds >= 1:
                dealt = [(k, rounds) for k in level]
            else:
                dealt = [(max(names, key=lambda k: need[k]), 1)]
            for k, n in dealt:
                need[k] -= n * s
                c -= n
                if runs and runs[-1][0] == k:
                    runs[-1] = (k, runs[-1][1] + n)
                else:
                    runs.append((k, n))
        out[s] = runs
    return out


def assign(metadata: DataFrame, variants: DataFrame, targets: DataFrame, per_bucket: int = 100_000) -> DataFrame:
    """(doc_id, group_doc_id, n_rows, split): each doc_id string with the split of its group.

    Only the histogram of group sizes reaches the driver: it has at most about the square root of twice the number of rows
    entries, whatever the data. The rank of a group among those of its size comes from counts per hash bucket.
    """
    g = cut(grouped(metadata, variants), "grouped")
    buckets = max(64, -(-g.count() // per_bucket))  # what one window task sorts stays about the same
    size = g.groupBy("group_doc_id").agg(F.sum(F.col("n_meta") + F.col("n_var")).alias("size"))
    size = cut(size.withColumn("bucket", F.pmod(F.xxhash64("group_doc_id"), F.lit(buckets)).cast("int")), "sizes")
    counts = size.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    hist = [(int(r["size"]), int(r["n"])) for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()]
    shares = {r["split"]: float(r["share"]) for r in targets.where("split IS NOT NULL AND share > 0").select("split", "share").collect()}
    spark = g.sparkSession
    if not hist or not shares:
        return spark.createDataFrame([], "doc_id string, group_doc_id string, n_rows bigint, split string")
    ranges = []
    for s, runs in greedy_counts(hist, shares).items():
        at = 0
        for name, n in runs:
            ranges.append((s, at, at + n, name))
            at += n
    from pyspark.sql import Window

    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    w = Window.partitionBy("size", "bucket").orderBy(F.xxhash64("group_doc_id", F.lit(7)), "group_doc_id")
    ranked = size.withColumn("rn", F.row_number().over(w) - 1).join(before.select("size", "bucket", F.coalesce("before", F.lit(0)).alias("before")), ["size", "bucket"])
    ranked = ranked.select("group_doc_id", "size", (F.col("rn") + F.col("before")).alias("rank"))
    dealt = spark.createDataFrame(ranges, "size bigint, lo bigint, hi bigint, split string")
    split = ranked.join(dealt, (ranked["size"] == dealt["size"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select("group_doc_id", "split")
    return g.join(split, "group_doc_id").select("doc_id", "group_doc_id", (F.col("n_meta") + F.col("n_var")).alias("n_rows"), "split")


def report(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """(split, target_share, n_rows, n_groups, actual_share)."""
    total = assigned.agg(F.sum("n_rows").alias("total"))
    per = assigned.groupBy("split").agg(F.sum("n_rows").alias("n_rows"), F.countDistinct("group_doc_id").alias("n_groups"))
    return (
        targets.select("split", F.col("share").alias("target_share"))
        .join(per, "split", "left")
        .join(F.broadcast(total))  # one row
        .select("split", "target_share", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_groups", F.lit(0)).alias("n_groups"), F.round(F.coalesce("n_rows", F.lit(0)) / F.col("total"), 6).alias("actual_share"))
    )
