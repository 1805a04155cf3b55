"""Per-document text quality statistics and their outliers (problem 5).

Every text gets counts and ratios; for each language the mean and covariance of prose are estimated robustly over all
rows (medians first, then concentration steps that keep the rows close to the current estimate); the squared Mahalanobis
distance says how far a text is from prose and splits into one contribution per statistic. A text from FAR on is no prose: a
table or a list if the statistics of cells or of items put it there, junk if others did.

Defined results: null, empty and blank texts have zero counts, no distance and no kind; headings and one-line captions
have no kind; text damaged by scanning or by a wrong encoding is judged as the prose it was; a tie between kinds goes to
table, then list, then junk; texts of no known language, and languages of few rows, are measured by the most frequent
language of their script.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import language
from scriptorium.llm.encoding import LOST, NARROW, repair, suspicious
from scriptorium.llm.lm import PairModel, joined, kept, pair_table, spread
from scriptorium.runtime import cut

#: Function words and characters of running text (fixed values).
ZH_COMMON = "的了和在是与对为以及其中不有将于并而等能可会把被从这那也但或因由所之上下来着过个一出要自"
EN_COMMON = frozenset(
    "the of and to in a is that for it as was with be by on not he his are at from this have or an but which their they were been has would there will more than its into also these between such only through per since while among during after over under about".split()
)
MARK = re.compile(r"(?m)^[ \t]*(?:[-*•●○◆■·▪‣–]\s|\[?\d{1,3}(?:\.\d{1,2})*[\].、)）]?\s|[(（]\d{1,2}[)）]|[①-⑳]|[a-zA-Z][.)]\s|[一二三四五六七八九十]{1,3}、)|(?<=\s)(?:[(（]\d{1,2}[)）]|[①-⑳])")
ENDS = "。！？.!?；;…”\"』」）)]】"
#: Statistics that enter the distance, in order.
STATS = ("words", "word_length", "common", "letters", "digits", "symbols", "ends", "punct", "spaces", "distinct", "marks", "lines", "cells", "items", "runs", "odd")
N = len(STATS)
#: Squared distance (in units of the number of statistics) from which a text is no prose.
FAR = 2.4
#: Statistics of form, by the kind they speak for, and the share of the distance they must contribute, and at least half of what symbols do and, where no marks stand before items, 0.7 of what the lack of common words does; all others speak for junk.
FORMS = {"table": ("cells",), "list": ("marks", "items")}
FORM_SHARE = 0.125
#: Rows a language needs for an estimate of its own.
LEAST_ROWS = 200
_CLASS: np.ndarray | None = None


def classes() -> np.ndarray:
    """A class for every code point of the basic plane: 0 symbol, 1 ideograph, 2 other CJK letter, 3 Latin, 4 other letter, 5 digit, 6 space, 7 line feed, 8 sentence end, 9 punctuation, 11 common ideograph."""
    global _CLASS
    if _CLASS is None:
        c = np.zeros(65536, np.uint8)
        for i in range(65536):
            if 0xD800 <= i <= 0xDFFF:
                continue
            ch = chr(i)
            if 0x4E00 <= i <= 0x9FFF or 0x3400 <= i <= 0x4DBF:
                c[i] = 1
            elif 0x3041 <= i <= 0x30FF or 0xAC00 <= i <= 0xD7A3:
                c[i] = 2
            elif ch.isdigit():
                c[i] = 5
            elif ch.isalpha():
                c[i] = 3 if i < 0x250 else 4
            elif ch == "\n":
                c[i] = 7
            elif ch.isspace():
                c[i] = 6
        for ch in "。！？.!?；;":
            c[ord(ch)] = 8
        for ch in "，,、：:“”\"'‘’（）()《》—-–‐·%％[]【】…/¬\xad":
            c[ord(ch)] = 9
        for ch in ZH_COMMON:
            c[ord(ch)] = 11
        _CLASS = c
    return _CLASS


def _line_share(t: str) -> float:
    """The share of lines that end in punctuation, where a line that only was full does not count as ended."""
    lines = [x for x in re.split(r"[\r\n]+", t) if x.strip()]
    if len(lines) < 2:
        return 1.0 if not lines or lines[0].rstrip()[-1:] in ENDS else 0.0
    full = 0.72 * max(map(len, lines))
    ended = total = 0
    for i, x in enumerate(lines):
        x = x.rstrip()
        end = x[-1:] in ENDS
        if not end and i + 1 < len(lines) and len(x) >= full and not MARK.match(lines[i + 1]):
            continue
        total += 1
        ended += end
    return ended / total if total else 1.0


SEPARATED = re.compile(r"[\s|,，：:]+")
NUMBER = re.compile(r"[-+−]?\d{1,7}(?:[.,]\d+)*[%％]?|[-—–/]")
ITEMS = re.compile(r"[；;、/|·•]\s*|\s{2,}|[\r\n]+|\s+(?=[(（]\d{1,2}[)）]|[①-⑳])")
LATIN_ITEMS = re.compile(r"[;/|·•]\s+|\s{2,}|[\r\n]+|\s+(?=[(（]\d{1,2}[)）])")
LEADER = re.compile(r"[.…·]{4,}\s*\d+")
SENTENCE = re.compile(r"[。！？!?，]|[.,](?=\s|$)")
RUN, ODD = re.compile(r"\d{4,}"), re.compile(r"[A-Za-z0-9+/=&;<>{}]{18,}")
#: Function words by language; single letters are no votes, for random characters have them too.
ANCHORS = {k: frozenset(w for w in v.split() if len(w) > 1) for k, v in language.ANCHORS.items()}
#: Votes a language needs, and the share of a text's words they must be.
VOTES, VOTE_SHARE = 2, 0.08


def cells(t: str) -> float:
    """The share of numbers of a table among the tokens, where words stand beside them."""
    tokens = [x for x in SEPARATED.split(t) if x and not set(x) <= set("-:|")]
    numbers = sum(NUMBER.fullmatch(x) is not None for x in tokens)
    if numbers < 4 or sum(len(x) <= 14 and any(map(str.isalpha, x)) for x in tokens) < 2:
        return 0.0
    return numbers / len(tokens)


def items(t: str, latin: bool) -> float:
    """The share of the text in short items without a sentence, between the separators of a list."""
    parts = [x for x in (LATIN_ITEMS if latin else ITEMS).split(t) if x.strip()]
    if len(parts) < 3:
        return 0.0
    good = 0
    for x in parts:
        body = LEADER.sub("", MARK.sub("", x, count=1)).strip()
        letters = sum(map(str.isalpha, body))
        if 2 <= letters and len(body) <= min(2 * letters, 84 if latin else 32) and not SENTENCE.search(body):
            good += len(x)
    return good / sum(map(len, parts))


def is_heading(t: str) -> bool:
    """One short line of words, whatever numbers it begins with: a heading or a caption."""
    s = re.sub(r"^[#\s]*(?:\d+(?:\.\d+)*[.、]?\s)?", "", t.strip())
    return 0 < len(s) < 42 and not re.search(r"[\r\n]", s) and sum(map(str.isalpha, s)) >= 0.6 * sum(not c.isspace() for c in s)


def measure(texts: list[str | None]) -> dict[str, np.ndarray]:
    """All statistics of a batch, most of them by one pass over its code points."""
    a, starts = joined(texts)
    n = len(texts)
    cls = classes()[np.minimum(a, 65535)]
    row = np.repeat(np.arange(n), np.diff(starts))
    counts = np.bincount(row * 16 + cls, minlength=n * 16).reshape(n, 16)
    chars = np.diff(starts) - 1
    counts[:, 7] -= 1
    cjk = counts[:, 1] + counts[:, 11]
    latin, kana, other = counts[:, 3], counts[:, 2], counts[:, 4]
    dense = np.maximum(chars - counts[:, 6] - counts[:, 7], 1)
    wide = (cjk + kana) * 3 >= latin + other
    lang = np.where(wide, np.where(kana * 8 >= cjk + kana, "ja", "zh"), "").astype(object)
    lang[wide & (cjk + kana == 0)] = "zh"
    common = np.where(wide, counts[:, 11] / np.maximum(cjk, 1), 0.0)
    words, wlen, distinct, marks, table, listed, runs, odd = (np.zeros(n) for _ in range(8))
    lines = np.ones(n)
    heading = np.zeros(n, bool)
    nlines = counts[:, 7] + 1
    for i, t in enumerate(texts):
        if not t:
            continue
        if not wide[i]:
            w = re.findall(r"[^\W\d_]+", t.lower())
            words[i] = len(w)
            if w:
                votes = {k: sum(map(v.__contains__, w)) for k, v in ANCHORS.items()}
                best = max(votes, key=votes.__getitem__)
                lang[i] = best if votes[best] >= max(VOTES, VOTE_SHARE * len(w)) else ""
                common[i] = sum(map((EN_COMMON if lang[i] in ("en", "") else ANCHORS[lang[i]]).__contains__, w)) / len(w)
                wlen[i] = sum(map(len, w)) / len(w)
        distinct[i] = len(set(t))
        if counts[i, 7] or counts[i, 6] > 2:
            marks[i] = sum(1 for _ in MARK.finditer(t))
        lines[i] = _line_share(t) if counts[i, 7] else (1.0 if t.rstrip()[-1:] in ENDS else 0.0)
        if counts[i, 5] >= 4:
            table[i] = cells(t)
            runs[i] = sum(map(len, RUN.findall(t)))
        listed[i] = items(t, not wide[i])
        if latin[i] >= 6:
            odd[i] = sum(map(len, ODD.findall(t)))
        heading[i] = chars[i] < 64 and is_heading(t)
    words = np.where(wide, cjk + kana + latin // 5, words)
    wlen = np.where(wide, 1.0, wlen)
    m = np.maximum(chars, 1)
    return {
        "n_chars": chars, "n_words": words, "n_lines": np.where(chars > 0, nlines, 0), "mean_word_length": wlen, "cjk_ratio": cjk / m, "lang": lang, "wide": wide, "heading": heading,
        "words": np.log1p(words), "word_length": wlen, "common": common, "letters": (cjk + latin + kana + other) / dense, "digits": counts[:, 5] / dense, "symbols": counts[:, 0] / dense,
        "ends": np.log((counts[:, 8] + 0.3) / (dense + 10.0) * 60), "punct": counts[:, 9] / dense, "spaces": (counts[:, 6] + counts[:, 7]) / m,
        "distinct": distinct / np.power(m, 0.6), "marks": np.minimum(marks / np.maximum(nlines, 1), 1.0), "lines": lines, "cells": table, "items": listed, "runs": runs / m, "odd": odd / m,
    }


SCHEMA = "id {kind}, lang string, wide boolean, heading boolean, n_chars int, n_words int, n_lines int, mean_word_length double, cjk_ratio double, " + ", ".join(f"{s} double" for s in STATS)


COUNTS = ("n_chars", "n_words", "n_lines")


def _measured(kind: str, with_text: bool = False):
    idt = pa.int64() if kind == "bigint" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = measure(b.column(1).to_pylist())
            cols = [b.column(0).cast(idt), pa.array(m["lang"].tolist(), pa.string()), pa.array(m["wide"]), pa.array(m["heading"]), *(pa.array(m[k].astype(np.int32)) for k in COUNTS),
                    *(pa.array(m[k].astype(np.float64)) for k in ("mean_word_length", "cjk_ratio", *STATS))]
            names = ["id", "lang", "wide", "heading", *COUNTS, "mean_word_length", "cjk_ratio", *STATS]
            if with_text:
                cols.append(b.column(1))
                names.append("text")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def statistics(paragraphs: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """One row of statistics for every record."""
    rows = paragraphs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_measured(kind), SCHEMA.format(kind=kind)).withColumnRenamed("id", id_col)


def _refit(body: DataFrame, fit: dict, box: dict) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """One concentration step: mean and inverse covariance of the rows near the last fit, or of those in a box around the medians; partial sums are added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            x = np.stack([b.column(k + 1).to_numpy(zero_copy_only=False) for k in range(N)], 1)
            langs = np.array(b.column(0).to_pylist(), object)
            for k in fit or box:
                own = x[langs == k]
                if fit:
                    d = own - fit[k][0]
                    own = own[(d * (d @ fit[k][1])).sum(1) <= 2.5 * N]
                else:
                    lo, mid, hi = box[k].T
                    own = own[(np.abs(own - mid) <= 4 * np.maximum(hi - lo, 0.02)).all(1)]
                one = np.hstack([own, np.ones((len(own), 1))])
                sums[k] = sums.get(k, 0.0) + one.T @ one
        for k, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * v.size), pa.array(np.arange(v.size, dtype=np.int32)), pa.array(v.ravel())], names=["lang", "i", "v"])

    rows = body.select("lang", *STATS).mapInArrow(run, "lang string, i int, v double").groupBy("lang", "i").agg(F.sum("v").alias("v")).collect()
    out = {}
    for k in {r["lang"] for r in rows}:
        m = np.zeros((N + 1) ** 2)
        for r in rows:
            if r["lang"] == k:
                m[r["i"]] = r["v"]
        m = m.reshape(N + 1, N + 1)
        if m[N, N] > N:
            mu = m[N, :N] / m[N, N]
            # a floor for statistics that prose hardly varies in
            out[k] = mu, np.linalg.inv(m[:N, :N] / m[N, N] - np.outer(mu, mu) + np.diag([RIDGE[s] for s in STATS]))
    return out


def prose(stats: DataFrame, steps: int = 3) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per language the robust mean and inverse covariance of prose: aggregates over all rows but blank ones and headings, a few numbers each.

    The keys "wide" and "narrow" stand for the most frequent language of either script.
    """
    body = stats.where("n_chars > 0 AND NOT heading AND lang <> ''")
    med = body.groupBy("lang").agg(*(F.percentile_approx(s, [0.25, 0.5, 0.75], 2000).alias(s) for s in STATS), F.count("*").alias("n"), F.max("wide").alias("wide")).where(F.col("n") >= LEAST_ROWS).collect()
    if not med:  # few rows altogether
        body = stats.where("n_chars > 0 AND NOT heading").withColumn("lang", F.when(F.col("wide"), "zh").otherwise("en"))
        med = body.groupBy("lang").agg(*(F.percentile_approx(s, [0.25, 0.5, 0.75], 2000).alias(s) for s in STATS), F.count("*").alias("n"), F.max("wide").alias("wide")).collect()
    out: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    box = {r["lang"]: np.array([r[s] for s in STATS]) for r in med}
    for _ in range(steps):
        out = _refit(body, out, box)
    for script, wide in (("wide", True), ("narrow", False)):
        own = [r for r in med if r["wide"] == wide and r["lang"] in out] or [r for r in med if r["lang"] in out]
        if own:
            out[script] = out[max(own, key=lambda r: (r["n"], r["lang"]))["lang"]]
    return out


#: Least variance of each statistic.
RIDGE = {
    "words": 0.1, "word_length": 0.2, "common": 0.0005, "letters": 0.003, "digits": 0.003, "symbols": 0.0008, "ends": 0.25, "punct": 0.002, "spaces": 0.003,
    "distinct": 0.06, "marks": 0.02, "lines": 0.09, "cells": 0.006, "items": 0.012, "runs": 0.002, "odd": 0.002,
}


def distances(m: dict[str, np.ndarray], fit: dict[str, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Squared distance over N, and the contributions whose sum it is."""
    x = np.stack([np.asarray(m[s], float) for s in STATS], 1)
    lang, wide = np.asarray(m["lang"], object), np.asarray(m["wide"], bool)
    c = np.zeros_like(x)
    key = np.array([k if k in fit else "wide" if w else "narrow" for k, w in zip(lang, wide)], object)
    for k in set(key.tolist()):
        if k in fit:
            mu, inv = fit[k]
            sel = key == k
            d = x[sel] - mu
            c[sel] = d * (d @ inv) / N
    return c.sum(1), c


def kind_of(contributions: np.ndarray) -> str:
    """What a text far from prose is, by the statistics that put it there."""
    by = dict(zip(STATS, np.maximum(contributions, 0.0)))
    score = {k: sum(by[s] for s in names) for k, names in FORMS.items()}
    best = max(score, key=score.__getitem__)
    least = FORM_SHARE * float(contributions.sum())
    against = max(0.5 * by["symbols"], 0.0 if by["marks"] >= least else 0.7 * by["common"])
    return best if score[best] >= max(least, against) else "junk"


def judge(
    paragraphs: DataFrame, id_col: str = "row_id", text_col: str = "text", far: float = FAR, model=None
) -> DataFrame:
    """(id, kind, distance, contributions): every record far from prose, with what each statistic adds to its distance.

    One pass measures all rows, aggregates of a few numbers fit the prose of each language, and what was measured is set against the fit; texts that are
    far are read as they were before any wrong decoding. No row is shuffled.
    """
    spark = paragraphs.sparkSession
    rows = paragraphs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    idt = pa.int64() if kind == "bigint" else pa.string()
    stats = cut(rows.mapInArrow(_measured(kind, True), SCHEMA.format(kind=kind) + ", text string").select("id", "text", "lang", "wide", "heading", "n_chars", *STATS), "stats")
    fit = prose(stats.drop("id", "text"))
    b = model or spread(spark, pair_table(paragraphs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pm = kept(PairModel, b)
        for batch in batches:
            m = {s: batch.column(4 + k).to_numpy(zero_copy_only=False) for k, s in enumerate(STATS)}
            m |= {"lang": batch.column(2).to_pylist(), "wide": batch.column(3).to_pylist()}
            dist, con = distances(m, fit)
            batch = batch.take(pa.array(np.nonzero(dist >= far)[0]))
            dist, con = dist[dist >= far], con[dist >= far]
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            a, starts = joined(texts)
            hot = suspicious(a, starts, pm)
            for i, t in enumerate(texts):
                d, c = dist[i], con[i]
                if i in hot or NARROW.search(t) or LOST.search(t):
                    fixed, n, names = repair(t, pm, hot.get(i, []))
                    if n:
                        if LOST.search(fixed):
                            continue  # damage that can't be undone says nothing of the text
                        mm = measure([fixed])
                        dd, cc = distances(mm, fit)
                        d, c = dd[0], cc[0]
                        if d < far or mm["heading"][0]:
                            continue
                out.append((ids[i], kind_of(c), float(d), [float(v) for v in c]))
            cols = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], idt), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.list_(pa.float64()))], names=["id", "kind", "distance", "contributions"])

    some = stats.where("NOT heading AND text RLIKE '\\\\S'").select("id", "text", "lang", "wide", *STATS)
    out = some.mapInArrow(run, f"id {kind}, kind string, distance double, contributions array<double>")
    return out.select(F.col("id").alias(id_col), "kind", "distance", F.map_from_arrays(F.array(*(F.lit(s) for s in STATS)), "contributions").alias("contributions"))
