"""Corpus statistics shared by the text operators: counts of character pairs and of words, over all rows of a table.

Both live in hashed tables of a fixed number of cells, so what reaches the driver and the workers has a proven bound
(CELLS bytes each) however large the corpus is, while every row of the corpus adds to the counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of a table, each one byte after quantisation.
CELLS = 1 << 22
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(64 - 22)
#: Steps of the quantised natural logarithm of a count.
STEP = 12.0
WORD = re.compile(r"[^\W\d_]+", re.UNICODE)
LATIN_WORD = re.compile("[A-Za-zÀ-ɏ]+")


def codes(text: str) -> np.ndarray:
    """Code points, with digits folded together."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    a[(a >= 48) & (a <= 57)] = 48
    return a


def pair_cells(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (a.astype(np.uint64) * _A) ^ ((b.astype(np.uint64) + np.uint64(0x51ED)) * _B)
        h = (h ^ (h >> np.uint64(29))) * _A
    return (h >> _SHIFT).astype(np.int64)


def _cell(a: int, b: int) -> int:
    """pair_cells for one pair."""
    a, b = (48 if 48 <= x <= 57 else x for x in (a, b))
    h = ((a * int(_A)) ^ ((b + 0x51ED) * int(_B))) & 0xFFFFFFFFFFFFFFFF
    h = ((h ^ (h >> 29)) * int(_A)) & 0xFFFFFFFFFFFFFFFF
    return h >> int(_SHIFT)


def word_cells(words: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) >> 42 for w in words), np.int64, len(words))


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by a line feed, and the start of each text (one more entry than texts)."""
    ts = [t or "" for t in texts]
    starts = np.zeros(len(ts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in ts], out=starts[1:])
    return codes("\n".join(ts) + "\n"), starts


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CELLS, np.int64)
    for b in batches:
        a, _ = joined(b.column(0).to_pylist())
        if len(a) > 1:
            total += np.bincount(pair_cells(a[:-1], a[1:]), minlength=CELLS)
    at = np.nonzero(total)[0]
    for i in range(0, len(at), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 100_000].astype(np.int32)), pa.array(total[at[i : i + 100_000]])], names=["cell", "n"])


def add_words(n: np.ndarray, counts: dict[str, int]) -> None:
    """Add the counts of a batch to their cells: no partition keeps its words."""
    if counts:
        np.add.at(n, word_cells(list(counts)), np.fromiter(counts.values(), np.int64, len(counts)))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from collections import Counter

    n = np.zeros(CELLS, np.int64)
    for b in batches:
        c: Counter = Counter()
        for t in b.column(0).to_pylist():
            if t:
                c.update(LATIN_WORD.findall(t.lower()))
        add_words(n, c)
    at = np.nonzero(n)[0]
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["cell", "n"])


def _table(counts: DataFrame) -> tuple[np.ndarray, float]:
    rows = counts.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most CELLS rows
    n = np.zeros(CELLS, np.float64)
    n[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    total = float(n.sum())
    q = np.zeros(CELLS, np.uint8)
    some = n > 0
    q[some] = np.minimum(255, 1 + np.round(np.log(n[some]) * STEP)).astype(np.uint8)
    return q, total


def pair_table(df: DataFrame, col: str = "text") -> tuple[np.ndarray, float]:
    """Quantised log counts of character pairs and the number of pairs."""
    return _table(df.select(F.col(col).alias("t")).where("t IS NOT NULL").mapInArrow(_pairs, "cell int, n bigint"))


def word_table(df: DataFrame, col: str = "text") -> tuple[np.ndarray, float]:
    """Quantised log counts of words in the Latin alphabet (lower case) and the number of words."""
    return _table(df.select(F.col(col).alias("t")).where("t IS NOT NULL").mapInArrow(_words, "cell int, n bigint"))


class PairModel:
    """Log of the joint frequency of neighbouring characters."""

    def __init__(self, q: np.ndarray, total: float):
        self.cache: dict[str, float] = {}
        # a count below one stands for pairs never met
        self.logp = np.where(q == 0, -1.5, (q.astype(np.float32) - 1) / STEP).astype(np.float32) - np.float32(np.log(max(total, 1.0)))
        w = np.exp(self.logp.astype(np.float64)) * (q > 0)
        #: mean log frequency of a pair of the corpus
        self.mean = float((w * self.logp).sum() / max(w.sum(), 1e-12)) if q.any() else 0.0

    def pairs(self, a: np.ndarray) -> np.ndarray:
        return self.logp[pair_cells(a[:-1], a[1:])]

    def score(self, s: str) -> float:
        """Mean log frequency of the pairs of s."""
        a = codes(s)
        return float(self.pairs(a).mean()) if len(a) > 1 else self.mean

    def pair(self, x: str, y: str) -> float:
        v = self.cache.get(x + y)
        if v is None:
            if len(self.cache) > 500_000:
                self.cache.clear()
            v = self.cache[x + y] = float(self.logp[_cell(ord(x), ord(y))])
        return v


class WordModel:
    def __init__(self, q: np.ndarray, total: float):
        self.count_of = np.where(q == 0, 0.0, np.exp((q.astype(np.float64) - 1) / STEP)).astype(np.float32)
        self.total = total
        self.cache: dict[str, float] = {}

    def count(self, w: str) -> float:
        c = self.cache.get(w)
        if c is None:
            if len(self.cache) > 500_000:
                self.cache.clear()
            c = self.cache[w] = float(self.count_of[word_cells([w])[0]])
        return c


_KEPT: dict = {}


def kept(kind: type, broadcast):
    """A model built once per Python worker from its broadcast table."""
    key = (kind.__name__, broadcast.value[2])
    if key not in _KEPT:
        _KEPT.clear() if len(_KEPT) > 6 else None
        _KEPT[key] = kind(*broadcast.value[:2])
    return _KEPT[key]


def spread(spark, table: tuple[np.ndarray, float]):
    """Broadcast a table of CELLS bytes under a name of its own."""
    import uuid

    return spark.sparkContext.broadcast((*table, uuid.uuid4().hex))
