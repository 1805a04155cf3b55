"""Garbled text from wrong character encoding (problem 7).

A noisy channel: the text was written in encoding R and read as encoding W, perhaps with bytes lost on the way. Damaged
spans show in two ways: characters of a one-byte repertoire that line up as multi-byte sequences, and stretches of
characters whose neighbours the corpus hardly ever puts together. For such a span the bytes of each channel are laid out
again (a lattice, with wildcards where a character was lost) and a Viterbi search under corpus pair frequencies reads the
most probable text from them; a span counts as damaged if that text is much more probable than what stands there, or if a
replacement character shows that bytes were lost.

Defined results: null, empty and blank texts have no damage; accents, symbols and foreign words that are right as they
stand are left alone; a text damaged twice over is restored by applying the search to its own result; repeated rows and
ties are treated row by row (a row's result depends on its text and the corpus counts only); a very long text is worked on whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.lm import PairModel, joined, kept, pair_table, spread

#: One-byte encodings text is wrongly read in; bytes they leave undefined stand for themselves.
SINGLE = ("cp1252", "mac_roman", "cp437", "cp1251", "cp850", "koi8-r", "cp1250")
#: Multi-byte encodings text is wrongly read in.
MULTI = ("gb18030", "cp950", "cp932", "cp949", "euc_jp")
#: Nats by which a restored span must be more probable, per pair.
GAIN = 1.5
#: Pairs this many nats below the corpus mean are suspicious; a window of WINDOW pairs at WINDOW_DROP on average starts a span.
WINDOW, WINDOW_DROP = 5, 3.0
#: What stands among Latin letters without being one.
LATIN_MARKS = set("‘’“”–—…€£±éèêëçïîôöüäñßáíóúàâûùÉÈÇÜÖÄÑ°·×÷©®™«»§µ½¼¾²³¥¢¡¿ ")


@lru_cache(maxsize=None)
def byte_of(codec: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for b in range(128, 256):
        try:
            ch = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            ch = chr(b)
        out[ch] = b
        if codec == "cp1252":
            out.setdefault(chr(b), b)  # the control characters a strict Latin-1 reading leaves
    return out


def _cls(codec: str, lo: int, hi: int) -> str:
    return "".join(re.escape(c) for c, b in byte_of(codec).items() if lo <= b <= hi)


@lru_cache(maxsize=None)
def sequence(codec: str) -> re.Pattern:
    """A character of two or three bytes in UTF-8 as it looks when read in a one-byte encoding; a lost byte may be among the last ones."""
    cont = _cls(codec, 0x80, 0xBF)
    return re.compile(f"[{_cls(codec, 0xC2, 0xDF)}][{cont}]|[{_cls(codec, 0xE1, 0xEF)}][{cont}][{cont}�]|[{_cls(codec, 0xE1, 0xEF)}]�[{cont}]|[{_cls(codec, 0xF0, 0xF3)}][{cont}]{{3}}")


@lru_cache(maxsize=None)
def run_of(codec: str) -> re.Pattern:
    """A stretch of characters above ASCII of a one-byte repertoire, with what little ASCII may stand between."""
    return re.compile(f"(?:[{_cls(codec, 0x80, 0xFF)}�][ -~]{{0,2}})*[{_cls(codec, 0x80, 0xFF)}�]")


NARROW_CHAR = re.compile("[\x80-\u04ff\u2010-\u2bff\ufffd]")
NARROW = re.compile("[\x80-\u04ff\u2010-\u2bff\ufffd]{2}")
WIDE_IN_LATIN = re.compile("[a-z.,] ?[\u3041-\u9fff\uac00-\ud7a3\ufffd]{1,3}(?:[a-z0-9]| [a-z])")
#: A replacement character, also as it looks when its own bytes were read in GBK.
LOST = re.compile("\ufffd|锟斤拷|锟斤|斤拷")


@lru_cache(maxsize=200_000)
def _bytes(ch: str, codec: str) -> bytes | None:
    try:
        return ch.encode(codec)
    except UnicodeEncodeError:
        return None


def lattice(span: str, codec: str) -> list[int]:
    """Bytes of the span in the encoding it was read in; -1 where a character was lost or belongs to no such encoding."""
    out: list[int] = []
    one = byte_of(codec) if codec in SINGLE else None
    for ch in span:
        if ch == "�":
            out.append(-1)
        elif ch < "\x80":
            out.append(ord(ch))
        elif one is not None:
            out.append(one.get(ch, -1))
        else:
            b = _bytes(ch, codec)
            out.extend(b if b is not None else [-1])
    return out


@lru_cache(maxsize=1)
def _readable() -> dict[tuple, list[str]]:
    """Characters by their UTF-8 bytes with one or two of them unknown: the common ideographs (level 1 of GB 2312) and CJK punctuation."""
    chars = [bytes([a, b]).decode("gb2312") for a in range(0xB0, 0xD8) for b in range(0xA1, 0xFF) if not (a == 0xD7 and b > 0xF9)]
    chars += list("，。、；：？！“”‘’（）《》—…")
    index: dict[tuple, list[str]] = {}
    for c in chars:
        b = c.encode()
        for hide in ((0,), (1,), (2,), (1, 2), (0, 1), (0, 2)):
            index.setdefault(tuple(None if i in hide else x for i, x in enumerate(b)), []).append(c)
    return index


def viterbi(items: list[int], model: PairModel, left: str = "", right: str = "", beam: int = 4) -> str:
    """The most probable text between left and right whose UTF-8 bytes are the items; an unknown item stands for up to two bytes."""
    index, n = _readable(), len(items)
    best: dict[tuple[int, int], list[tuple[float, str]]] = {(0, 0): [(0.0, left[-1:])]}
    lost = -25.0

    def patterns(k: int, w: int, need: int) -> Iterator[tuple[list, tuple[int, int]]]:
        if need == 0:
            yield [], (k, w)
            return
        if k >= n:
            return
        if items[k] >= 0:
            for rest, at in patterns(k + 1, 0, need - 1):
                yield [items[k], *rest], at
        else:
            if w < 2:
                for rest, at in patterns(k, w + 1, need - 1):
                    yield [None, *rest], at
            if w:
                yield from patterns(k + 1, 0, need)

    def put(at: tuple[int, int], cost: float, ch: str, here: list[tuple[float, str]]) -> None:
        if at[0] < n and items[at[0]] < 0 and at[1] >= 2:
            at = (at[0] + 1, 0)
        row = best.setdefault(at, [])
        for s, t in here:
            row.append((s + cost + (model.pair(t[-1], ch) if t and ch else 0.0), t + ch))

    for k in range(n):
        for w in (0, 1, 2):
            here = best.pop((k, w), None)
            if not here:
                continue
            here = sorted(here, reverse=True)[:beam]
            if items[k] < 0 and w:
                put((k + 1, 0), 0.0, "", here)
            if 0 <= items[k] < 128:
                put((k + 1, 0), 0.0, chr(items[k]), here)
                continue
            if w == 0:
                put((k + 1, 0), lost, "" if items[k] < 0 else "�", here)
            for need in (3, 2):
                for pat, at in patterns(k, w, need):
                    if None not in pat:
                        try:
                            one = bytes(pat).decode()
                        except UnicodeDecodeError:
                            continue
                        if len(one) == 1:
                            put(at, 0.0, one, here)
                    elif need == 3 and any(p is not None for p in pat):
                        # of the characters the known bytes allow, those the corpus puts after what is read so far
                        some = index.get(tuple(pat), ())
                        if len(some) > 6:
                            prev = here[0][1][-1:] or "，"
                            some = sorted(some, key=lambda ch: -model.pair(prev, ch))[:6]
                        for ch in some:
                            put(at, -3.0 * pat.count(None), ch, here)
    ends = [x for (k, _), row in best.items() if k >= n for x in row] or [x for row in best.values() for x in row]
    if not ends:
        return ""
    if right:
        ends = [(s + (model.pair(t[-1], right[0]) if t else 0.0), t) for s, t in ends]
    return max(ends)[1][len(left[-1:]) :]


GOOD = re.compile(rb"(?:[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|[\xf0-\xf3][\x80-\xbf]{3})+")
VALID = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|[\xf0-\xf3][\x80-\xbf]{3}")
HIGH = bytes(range(128, 256))
#: Bytes that do not line up are searched in stretches of this many, each continuing the text read before it.
STRETCH = 24


def search(items: list[int], model: PairModel, left: str, right: str = "") -> str:
    """The search over a stretch of any length, cut where a character begins."""
    out = ""
    while len(items) > STRETCH:
        at = next((k for k in range(STRETCH, STRETCH // 2, -1) if items[k] >= 0 and not 0x80 <= items[k] < 0xC0), STRETCH)
        out += viterbi(items[:at], model, left + out)
        items = items[at:]
    return out + viterbi(items, model, left + out, right)


def read_utf8(items: list[int], model: PairModel) -> str:
    """Bytes that line up are read as they are; the search runs over the stretches between them."""
    raw = bytes(b if b >= 0 else 0xFF for b in items)
    out, at = "", 0
    for m in GOOD.finditer(raw):
        good = m.group().decode("utf-8", "replace")
        if m.start() > at:
            out += search(items[at : m.start()], model, out, good)
        out += good
        at = m.end()
    if at < len(items):
        out += search(items[at:], model, out)
    return out


def _plausible(s: str, model: PairModel) -> float:
    return model.score(s.replace("�", ""))


def _lined_up(items: list[int], least: int = 2) -> float:
    """The share of bytes above ASCII that line up as UTF-8."""
    raw = bytes(b if b >= 0 else 0x3F for b in items)
    high = sum(b >= 128 for b in items)
    hits = VALID.findall(raw)
    return sum(map(len, hits)) / high if len(hits) >= least else 0.0


def _as_gbk(items: list[int]) -> str | None:
    if not items or items.count(-1) > 0.3 * len(items):
        return None
    s = bytes(b for b in items if b >= 0).decode("gbk", "replace")
    return s if s.count("�") <= 0.1 * len(s) else None


def _narrow(text: str, model: PairModel) -> list[tuple[int, int, str, str]]:
    """Spans of a one-byte repertoire: the encoding under which most of its characters line up, else the one that reads best as GBK."""
    high = len(NARROW_CHAR.findall(text))
    best, top = None, 0
    for codec in SINGLE:
        hits = list(sequence(codec).finditer(text))
        if not hits or (codec not in ("cp1252", "mac_roman") and len(hits) < 2 and len(hits[0].group()) < 3):
            continue
        got = sum(m.end() - m.start() for m in hits)
        if got > top:
            best, top = (codec, hits), got
    if best and (top >= 0.75 * high or (top >= 4 and best[0] == "cp1252" and "Ã" not in text and top >= 0.6 * high)):
        codec, hits = best
        found, i = [], 0
        while i < len(hits):
            j = i
            while j + 1 < len(hits) and hits[j + 1].start() - hits[j].end() <= 2 and not text[hits[j].end() : hits[j + 1].start()].isalnum():
                j += 1
            lo, hi = hits[i].start(), hits[j].end()
            s = read_utf8(lattice(text[lo:hi], codec), model)
            if s and (len(hits) > 1 or any(c in LATIN_MARKS or "一" <= c <= "鿿" for c in s)):
                found.append((lo, hi, s, codec + ">utf-8"))
            i = j + 1
        return found
    # an encoding that reads but a few characters reads them well by chance: the share it reads counts too
    out, top = [], model.mean - 4.0
    for codec in SINGLE:
        found, read = [], ""
        for m in run_of(codec).finditer(text):
            if m.end() - m.start() >= 6:
                s = _as_gbk(lattice(m.group(), codec))
                if s:
                    found.append((m.start(), m.end(), s, codec + ">gbk"))
                    read += s
        share = sum(hi - lo for lo, hi, _, _ in found) / max(high, 1)
        if found and (p := _plausible(read, model)) > model.mean - 4.0 and p - 6.0 * (1.0 - min(share, 1.0)) > top - 6.0 * (not out):
            out, top = found, p - 6.0 * (1.0 - min(share, 1.0))
    return out


def _wide(text: str, spans: list[tuple[int, int]], model: PairModel) -> list[tuple[int, int, str, str]]:
    """Suspicious stretches of wide characters: every channel is tried cheaply, the most probable one is then read by the search."""
    out = []
    for lo, hi in spans:
        span = text[lo:hi]
        top, best = max(model.score(span) + GAIN, model.mean - 4.0), None
        whole = span.replace("�", "?")
        for codec in MULTI:
            raw = whole.encode(codec, "replace")
            if raw.count(b"?") - whole.count("?") > 0.06 * len(span):
                continue  # text read in this encoding would be made of its characters
            high = len(raw) - len(raw.translate(None, HIGH))
            hits = VALID.findall(raw)
            if len(hits) > 2 and sum(map(len, hits)) >= 0.6 * high:
                quick = raw.replace(b"?", b"").decode("utf-8", "ignore")
                if len(quick) > 2 and (p := _plausible(quick, model)) > top:
                    top, best = p, (codec + ">utf-8", None)
            if codec not in ("gb18030", "euc_jp") and raw.count(b"?") <= 0.3 * len(raw):
                s = raw.replace(b"?", b"").decode("gbk", "replace")
                if len(s) > 3 and s.count("�") <= 0.1 * len(s) and (p := _plausible(s, model)) > top:
                    top, best = p, (codec + ">gbk", s)
        if best:
            name, s = best
            out.append((lo, hi, read_utf8(lattice(span, name.split(">")[0]), model) if s is None else s, name))
    return out


def _in_latin(text: str, model: PairModel) -> list[tuple[int, int, str, str]]:
    """Single wide characters among Latin letters: an accented letter or a quotation mark read in a multi-byte encoding."""
    out = []
    for m in re.finditer("[぀-鿿가-힣�]{1,4}", text):
        around = text[max(0, m.start() - 2) : m.start()] + text[m.end() : m.end() + 2]
        if not re.search("[A-Za-z]", around) or re.search("[぀-鿿]", around):
            continue
        for codec in MULTI:
            items = lattice(m.group(), codec)
            s = read_utf8(items, model) if _lined_up(items, 1) >= 0.5 else None
            if s and all(c in LATIN_MARKS or c.isascii() or c == "�" for c in s):
                out.append((m.start(), m.end(), s, codec + ">utf-8"))
                break
    return out


def suspicious(a: np.ndarray, starts: np.ndarray, model: PairModel) -> dict[int, list[tuple[int, int]]]:
    """Per text the stretches of wide characters whose pairs are rare, from one pass over all texts of a batch."""
    if len(a) < WINDOW + 1:
        return {}
    p = model.pairs(a)
    c = np.concatenate([[0.0], np.cumsum(p, dtype=np.float64)])
    mean = (c[WINDOW:] - c[:-WINDOW]) / WINDOW
    wide = a > 0x2E7F
    cw = np.concatenate([[0], np.cumsum(wide)])
    nwide = cw[WINDOW + 1 :] - cw[: -WINDOW - 1]
    hot = (mean < model.mean - WINDOW_DROP) & (nwide[: len(mean)] >= WINDOW - 1)
    at = np.nonzero(hot)[0]
    out: dict[int, list[tuple[int, int]]] = {}
    if not len(at):
        return out
    gap = np.nonzero(np.diff(at) > 2 * WINDOW)[0]
    firsts, lasts = at[np.concatenate([[0], gap + 1])], at[np.concatenate([gap, [len(at) - 1]])]
    rows = np.searchsorted(starts, firsts, side="right") - 1
    for r, lo, hi in zip(rows, firsts, lasts):
        s, e = int(starts[r]), int(starts[r + 1]) - 1
        lo, hi = max(int(lo), s), min(int(hi) + WINDOW + 1, e)
        if hi - lo >= 4:
            out.setdefault(int(r), []).append((lo - s, hi - s))
    return out


def repair(text: str, model: PairModel, spans: list[tuple[int, int]] | None = None, depth: int = 3) -> tuple[str, int, list[str]]:
    """Restored text, number of damaged spans and the channels met."""
    if spans is None:
        a, starts = joined([text])
        spans = suspicious(a, starts, model).get(0, [])
    fixes = []
    if NARROW.search(text):
        fixes = _narrow(text, model)
    if not fixes and spans:
        fixes = _wide(text, spans, model)
    if WIDE_IN_LATIN.search(text):
        have = [(x[0], x[1]) for x in fixes]
        fixes += [x for x in _in_latin(text, model) if not any(x[0] < b and a < x[1] for a, b in have)]
    lost = LOST.search(text)
    if not fixes:
        return text, (1 if lost else 0), (["lost"] if lost else [])
    out, at = [], 0
    for lo, hi, s, _ in sorted(fixes):
        if lo < at:
            continue
        out += [text[at:lo], s]
        at = hi
    fixed = "".join(out) + text[at:]
    names = sorted({x[3] for x in fixes})
    if depth > 1 and names == ["cp1252>utf-8"]:
        # text that went through the same mistake twice
        again, n, more = repair(fixed, model, depth=depth - 1)
        if n and more == names:
            return again, len(fixes), names
    return fixed, len(fixes), names


def restore(paragraphs: DataFrame, id_col: str = "row_id", text_col: str = "text", model=None) -> DataFrame:
    """(id, n_spans, channels, restored): one row for each damaged record.

    One pass counts the corpus, one pass reads it; nothing is shuffled but the counts.
    """
    spark = paragraphs.sparkSession
    b = model or spread(spark, pair_table(paragraphs, text_col))
    rows = paragraphs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    kind = rows.schema["id"].dataType.simpleString()
    id_type = pa.int64() if kind == "bigint" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = kept(PairModel, b)
        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            a, starts = joined(texts)
            hot = suspicious(a, starts, m)
            out = []
            for i, t in enumerate(texts):
                if i in hot or NARROW.search(t) or LOST.search(t) or WIDE_IN_LATIN.search(t):
                    fixed, n, names = repair(t, m, hot.get(i, []))
                    if n:
                        out.append((ids[i], n, names, fixed))
            cols = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], id_type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.list_(pa.string())), pa.array(cols[3], pa.string())], names=["id", "n_spans", "channels", "restored"])

    return rows.mapInArrow(run, f"id {kind}, n_spans int, channels array<string>, restored string").withColumnRenamed("id", id_col)
