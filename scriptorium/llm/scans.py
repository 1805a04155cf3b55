"""Noise in text from scanned pages (problem 2).

The characters of a text are taken as one stream without line ends. Running heads and page numbers are lines (or, where
line ends got lost, stretches) whose removal joins their neighbours into text the corpus knows; words are decoded from
what is left by Viterbi over arcs that keep, split, merge, undo confusions or hyphens, each costing what corpus frequencies must
outweigh; ideographs by Viterbi over those that may be misread or halves of one; paragraph boundaries are put back by dynamic programming over lines and the boundary before each.

Defined results: null, empty and blank texts, lists, tables and junk have no noise; line ends alone are none; page
references inside sentences, captions and headings are none; a text may show several kinds, one row each; repeated rows
are treated each by itself; a tie between two readings keeps what is printed; texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import ceil, inf, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.lm import LATIN_WORD, PairModel, WordModel, kept, pair_table, spread, word_table
from scriptorium.llm.quality import EN_COMMON, ZH_COMMON

#: Characters taken for others by recognition (fixed values): printed -> read.
CONFUSED = {
    "的": "旳", "于": "干千", "以": "队从", "市": "巿", "系": "糸", "化": "花", "供": "洪", "本": "木夲", "人": "入⼈八", "合": "台", "业": "亚", "力": "刀⼒",
    "成": "戍戌", "口": "囗", "研": "砑", "场": "埸", "行": "彳", "效": "郊", "结": "给", "期": "斯", "理": "埋", "间": "问", "利": "刂", "明": "朋", "加": "如",
    "管": "菅", "大": "太犬", "比": "此", "优": "忧", "析": "折", "目": "日", "究": "宄", "未": "末", "己": "已", "土": "士", "天": "夫", "日": "曰", "几": "儿", "贷": "货",
    "政": "玫", "经": "轻", "住": "往", "竟": "竞", "处": "外", "治": "冶", "士": "土", "了": "孑", "无": "元", "风": "凤", "今": "令", "设": "没", "续": "绩", "微": "徽",
}
#: Characters read as two (fixed values): printed -> read.
SPLIT = {"的": "白勺", "利": "禾刂", "动": "云力", "行": "彳亍", "明": "日月", "好": "女子", "对": "又寸", "时": "日寸", "信": "亻言", "地": "土也", "化": "亻匕", "场": "土昜", "效": "交攵", "现": "王见", "加": "力口", "期": "其月", "相": "木目", "和": "禾口", "作": "亻乍", "位": "亻立", "研": "石开", "理": "王里", "结": "纟吉", "绩": "纟责", "组": "纟且"}
READ = {r: p for p, rs in CONFUSED.items() for r in rs}
JOIN = {r: p for p, r in SPLIT.items()}
#: Letters and digits taken for others in the Latin alphabet (fixed values): read -> printed.
LETTERS = (("rn", "m"), ("m", "in"), ("m", "rn"), ("ii", "u"), ("li", "h"), ("ci", "a"), ("cl", "d"), ("d", "ti"), ("d", "cl"), ("vv", "w"), ("f", "t"), ("t", "f"), ("c", "e"), ("e", "c"), ("l", "i"), ("i", "l"), ("1", "l"), ("1", "i"),
           ("0", "o"), ("6", "b"), ("5", "s"), ("8", "b"), ("9", "g"), ("a", "o"), ("o", "a"), ("h", "b"), ("b", "h"), ("u", "n"), ("n", "u"), ("j", "i"), ("I", "l"), ("nn", "m"), ("ni", "m"), ("in", "m"), ("ri", "n"), ("tl", "d"))
#: Digits read as letters.
NUMBER_LETTERS = re.compile(r"(?<![A-Za-z0-9])(?=[0-9.]*[OolIZSB])(?=[OolIZSB.]*[0-9])[0-9OolIZSB]+(?:\.[0-9OolIZSB]+)?(?![A-Za-z0-9])")
LONE_NUMBER = re.compile(r"(?<![A-Za-z0-9一-鿿])[OlIZSB]{1,2}\.[0-9OolIZSB]+|(?<=[一-鿿])[lZSBO](?=[条份家人年项页%个名])|\[[OlIZSB]{1,2}\]")
PAGE = re.compile(
    r"[\s\-–—~～·•|]*(?:[\[(（〔【]\s*\d{1,4}(?:\s*/\s*\d{1,4})?\s*[\])）〕】]|第\s*\d{1,4}\s*[页頁](?:\s*[,，]?\s*共\s*\d{1,4}\s*[页頁])?|[Pp](?:age|\.|g\.?)\s*\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?|\d{1,4}\s*/\s*\d{1,4}|\d{1,3}|[ivxlc]{1,6}|[IVXLC]{1,6})[\s\-–—~～·•|]*"
)
DECORATED = re.compile(r"[\-–—~～·•]\s*\d{1,4}\s*[\-–—~～·•]|[\[〔]\s*\d{1,4}\s*/\s*\d{1,4}\s*[\]〕]|〔\s*\d{1,4}\s*〕|第\s*\d{1,4}\s*[页頁]\s*共\s*\d{1,4}\s*[页頁]|第\s*\d{1,4}\s*頁|\b[Pp]age\s*\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?|\b[Pp]\.\s*\d{1,4}\b|(?<![\d.])\d{1,3}\s/\s\d{1,3}(?![\d.])")
#: The same inside a Chinese text, with the dashes and spaces around it; what a removal would glue together.
INSIDE = re.compile(r"[ \u3000]*[\-–—~～·•]*(?P<page>" + DECORATED.pattern + r")[\-–—~～·•]*[ \u3000]*")
WORDS_BESIDE = re.compile("[A-Za-z][A-Za-z]")
THESIS = re.compile(r"[一-鿿]{2,6}\s?[一-鿿]{0,4}(?:大学|学院|大學|學院)\s?(?:MBA|EMBA|MPA|硕士|博士|专业|学位|碩士|論文|论文|致谢|摘要|附录|目录|参考文献|第[一二三四五六七八九十\d]+章)[一-鿿A-Za-z \u3000]{0,16}")
SCHOOL = re.compile("大学|学院|大學|學院")
CHAPTER = re.compile(r"第[一二三四五六七八九十\d]{1,3}章\s*[一-鿿]{2,14}|(?:Chapter|CHAPTER)\s+\d+[A-Za-z ]*|(?:Abstract|ABSTRACT|References|REFERENCES|Appendix|APPENDIX|Contents|CONTENTS)\s*\((?:continued|CONTINUED)\)")
TITLE_RUN = re.compile(r"(?<=[a-z,;%\d\]] )((?:(?:[A-Z][a-z]+|[A-Z]{2,}|of|and|the|in|for|on|\d{1,2})\s+){1,8}(?:[A-Z][a-z]+|[A-Z]{2,}|\((?:continued|CONTINUED)\)))(?= [a-z\d])")
#: What stands between the parts of a word broken with a hyphen.
BROKEN = re.compile(r"[-‐]\s+|[¬\xad]\s*|‐")
TOKEN = re.compile(r"[A-Za-z0-9À-ɏ]*[A-Za-zÀ-ɏ][A-Za-z0-9À-ɏ]*")
WORD_OR_NUMBER = re.compile(LATIN_WORD.pattern + r"|\d+(?:\.\d+)?")
SOFT_COMMA = re.compile(r"[一-鿿%] ,[一-鿿]|[一-鿿] ;[一-鿿]")
KANGXI = re.compile("[⼀-⿕]")
LINE = re.compile(r"\r\n|[\n\r\u2028\u2029]")
HAN = re.compile("[一-鿿]")
HANS, LATINS, COMMON = re.compile("[一-鿿]+"), re.compile("[A-Za-z]+"), re.compile(f"[{ZH_COMMON}]")
BREAK = re.compile(r"(?<=[一-鿿，。；、：）)％%\]])[ \u3000]+|[ \u3000]+(?=[一-鿿，。；、（])")
#: Stretches of characters that may be misread, or be halves of one.
DOUBTFUL = re.compile("(?:" + "|".join(sorted(map(re.escape, JOIN), key=len, reverse=True)) + "|[" + "".join(map(re.escape, READ)) + "])+")
#: Characters that take the width of two.
WIDE = re.compile("[\u2e80-\uffef]")
#: Nats a paragraph boundary costs, and a paragraph of so many lines.
BREAK_COST = 2.5
LENGTHS = (0.0, 1.5, 0.5)
ENDS = "。！？!?；;.…"
#: What stands before a page that the sentence speaks of.
REFERRED = re.compile(r"(?:\b[Ss]ee|\bon|\bat|\bcf\.?|\bto|\bfrom|\bthe|\()\s*$")
#: Nats by which another reading must be more probable; the least ratio of word counts for one.
MARGIN = 5.5
RATIO = 20.0


def letters(t: str) -> tuple[int, int]:
    """Ideographs and Latin letters of a text."""
    return sum(map(len, HANS.findall(t))), sum(map(len, LATINS.findall(t)))


def prose(t: str) -> bool:
    """Running text: it has sentences and the words between them, whatever noise came into it."""
    han, latin = letters(t)
    if han * 3 >= latin:
        return han >= 12 and "。" in t and len(COMMON.findall(t)) >= 0.06 * han
    words = LATINS.findall(t.lower())
    if latin + t.count(" ") < 0.75 * len(t):
        return False
    return len(words) >= 8 and "." in t and sum(w in EN_COMMON for w in words) >= 0.1 * len(words)


def is_title(s: str) -> bool:
    """A line that reads like a heading: no sentence in it, capitals where the Latin alphabet has them."""
    s = s.strip()
    if not s or s[-1] in ENDS + "，,、" or any(c in s for c in "。，；;！"):
        return False
    words = re.findall(r"[A-Za-z]+", s)
    if words and not HAN.search(s):
        big = [w for w in words if w not in ("of", "and", "the", "in", "for", "on", "to", "a")]
        return bool(big) and sum(w[0].isupper() for w in big) >= 0.8 * len(big) and (len(big) > 1 or "(" in s or s.isupper())
    return True


def _places(s: str, part: str) -> Iterator[int]:
    i = s.find(part)
    while i >= 0:
        yield i
        i = s.find(part, i + 1)


class Decoder:
    def __init__(self, pairs: PairModel, words: WordModel):
        self.p, self.w = pairs, words
        self.seen: dict[str, float | None] = {}
        import xxhash

        self.cells, self.hash = words.count_of, xxhash.xxh3_64_intdigest  # as word_cells() has them
        self.token_seen: dict[str, list[tuple[str, float]]] = {}

    def count(self, w: str) -> float:
        """Count of a word or a pair of words: the least of its two cells, so that of the many readings tried none is taken for a word by sharing a cell."""
        n = self.cells.item(self.hash(w) >> 42)
        return min(n, self.cells.item(self.hash("\1" + w) >> 42)) if n else 0.0

    # words of the Latin alphabet -----------------------------------------------------------------------------------
    def options(self, token: str) -> list[tuple[str, float]]:
        """The other words a token may have been printed as, with the nats each must be better by: one or two confusions undone, or a space put back."""
        if token in self.token_seen:
            return self.token_seen[token]
        if len(self.token_seen) > 300_000:
            self.token_seen.clear()
        low = token.lower() if not any(c.isdigit() for c in token) else token
        have = self.count(low) if low.isalpha() else 0.0
        out: dict[str, float] = {}
        if len(token) >= 4 and (low.isalpha() or re.search("[a-z]", token)):
            top = max(have, 0.05)
            first = {low[:i] + p + low[i + len(r) :] for r, p in LETTERS for i in _places(low, r)}
            for c in first:
                c = c.lower()
                if len(c) >= 4 and c.isalpha() and c != low and (n := self.count(c)) >= 8 and n > top * RATIO:
                    out[c] = log(RATIO)
            if have < 3 or not low.isalpha():
                extra = 2.0 if out else 0.0
                for c in first:
                    for r, p in LETTERS:
                        for i in _places(c, r):
                            d = (c[:i] + p + c[i + len(r) :]).lower()
                            if len(d) >= 5 and d.isalpha() and d != low and d not in out and (n := self.count(d)) >= 30 and n > top * RATIO:
                                out[d] = log(RATIO) + extra
            if low.isalpha():
                for i in range(1, len(low)):
                    x, y = low[:i], low[i:]
                    if (i > 1 or x == "a") and len(y) > 1 and (n := self.count(x + " " + y)) >= 8 and n > top * RATIO and min(self.count(x), self.count(y)) >= n * 0.9:
                        out[x + " " + y] = MARGIN
        self.token_seen[token] = [*out.items()]
        return self.token_seen[token]

    def wholes(self, parts: tuple[str, ...], hyphen: bool) -> list[tuple[str, float]]:
        """The words that parts make, if one was broken between them: a hyphen tells of a break, a mere space must be outweighed."""
        whole = "".join(parts).lower()
        n = self.count(whole)
        out: list[tuple[str, float]] = []
        if n < 8 and not hyphen:
            return out
        least = min(self.count(x.lower()) for x in parts)
        if hyphen:
            if n >= 3 and n > 2 * least:
                out.append((whole, 0.0))
            if len(whole) >= 5:
                out += [(w, cost - log(RATIO)) for w, cost in self.options(whole) if " " not in w and self.count(w) > 5 * least]
        elif n > RATIO * max(least, 0.05):
            out.append((whole, log(RATIO)))
        return out

    def cost(self, prev: str | None, w: str) -> float:
        """Nats of a word after another; pairs met three times or less, the damaged ones among them, count as not met."""
        n = max(self.count(w) if w.isalpha() else 0.0, 0.05) / max(self.w.total / 2, 1.0)
        if prev is None:
            return -log(n)
        return -log(0.5 * n + 0.5 * max(self.count(prev + " " + w) - 3.0, 0.0) / max(self.count(prev), self.count(prev + " " + w), 1.0))

    def latin(self, flat: str, kinds: set[str], text: str) -> str:
        """Words decoded by Viterbi over the stream: arcs keep a token, undo confusions, split it, or merge it with the next one or two, over a space or a hyphen.

        A token with no other reading is a state every path goes through, so each stretch between such tokens is decoded by itself.
        """
        toks = list(TOKEN.finditer(flat))
        n = len(toks)
        if not n:
            return flat
        raw, seen = [m.group() for m in toks], self.token_seen
        seps = [flat[m.end() : k.start()] for m, k in zip(toks, toks[1:])]
        arcs: list[list[tuple[int, str, float]]] = [[(i + 1, w, c) for w, c in seen.get(t) or self.options(t)] if seen.get(t, True) else [] for i, t in enumerate(raw)]
        reach = [i + 1 if arcs[i] else 0 for i in range(n)]
        low = [t.lower() for t in raw]
        for i in range(n - 1):
            hyphen = False
            whole = low[i]
            for j in (i + 1, i + 2):
                if j >= n or seps[j - 1] != " " and not BROKEN.fullmatch(seps[j - 1]):
                    break
                hyphen = hyphen or seps[j - 1] != " "
                whole += low[j]
                if not hyphen and self.cells.item(self.hash(whole) >> 42) < 8:
                    continue
                for w, c in self.wholes(tuple(raw[i : j + 1]), hyphen):
                    arcs[i].append((j + 1, w, c))
                    reach[i] = j + 1
        if not any(reach):
            return flat
        # numbers are one word, and ideographs end what a word depends on
        between = [None if HAN.search(x) else "0" if re.search(r"\d", x) else "" for x in ["", *seps]]
        out: list[str] = []
        at = i = 0
        while i < n:
            if not reach[i]:
                i += 1
                continue
            start, end = i, reach[i]
            while i < end:
                end = max(end, reach[i])
                i += 1
            i = end
            # of each place, by the last word: cost, place and word before, and the word taken if it is not the one printed
            states: list[dict[str | None, tuple]] = [{} for _ in range(end - start + 1)]
            states[0][low[start - 1] if start else None] = (0.0, None, None, None)
            for k in range(start, end):
                for prev, (c0, *_) in states[k - start].items():
                    p = prev if between[k] == "" else between[k]
                    for j, w, c in [(k + 1, None, 0.0), *arcs[k]]:
                        total, q = c0 + c, p
                        for x in (w or low[k]).split(" "):
                            total += self.cost(q, x)
                            q = x
                        if j == end < n:
                            total += self.cost(q if between[end] == "" else between[end], low[end])
                        have = states[j - start].get(q)
                        if have is None or total < have[0]:
                            states[j - start][q] = (total, k, prev, w)
            k, word = end, min(states[-1], key=lambda q: states[-1][q][0])
            taken = []
            while k > start:
                _, before, prev, w = states[k - start][word]
                if w is not None:
                    taken.append((before, k, w))
                k, word = before, prev
            for k, j, w in reversed(taken):
                t = "".join(raw[k:j])
                if j - k > 1:
                    hyphen = any(x != " " for x in seps[k : j - 1])
                    over = re.search(r"[ \t]*(?:\r\n|[\n\r\u2028\u2029])\s*".join(map(re.escape, raw[k:j])), text)
                    kinds.add("hyphenation" if hyphen or over else "misread")
                if w != t.lower():
                    kinds.add("misread")
                    if w.replace(" ", "") == t.lower():  # only a space is put back
                        w = t[: w.index(" ")] + " " + t[w.index(" ") :]
                    else:
                        w = w.upper() if len(t) > 1 and t.isupper() else w[0].upper() + w[1:] if t[0].isupper() else w
                else:
                    w = t  # the letters as printed
                out += [flat[at : toks[k].start()], w]
                at = toks[j - 1].end()
        return "".join(out) + flat[at:]

    # ideographs --------------------------------------------------------------------------------------------------
    def misread(self, left: str, read: str, printed: str, right: str) -> float | None:
        """Nats by which a reading is better than what is printed between two characters; none if it may not be taken."""
        key = left + "\0" + read + "\0" + printed + right
        if key in self.seen:
            return self.seen[key]
        if len(self.seen) > 500_000:
            self.seen.clear()
        as_read = self.p.pair(left, read[0]) + self.p.pair(read[-1], right) + (self.p.pair(read[0], read[1]) if len(read) > 1 else 0.0)
        as_printed = self.p.pair(left, printed) + self.p.pair(printed, right)
        if len(read) > 1:
            as_printed += self.p.mean
        # the weaker link decides: a wrong character fits neither neighbour
        weak = min(self.p.pair(left, read[0]), self.p.pair(read[-1], right))
        gain = as_printed - as_read - MARGIN
        v = self.seen[key] = gain if gain > 0 and min(self.p.pair(left, printed), self.p.pair(printed, right)) > weak + 1.5 else None
        return v

    def ideographs(self, flat: str, kinds: set[str]) -> str:
        """Misread ideographs decoded by Viterbi: what stands beside one another is read together, so that each is judged between the right neighbours."""
        out: list[str] = []
        at = 0
        for m in DOUBTFUL.finditer(flat):
            lo, hi = m.span()
            s = m.group()
            left, right = flat[lo - 1] if lo else "\n", flat[hi] if hi < len(flat) else "\n"
            if len(s) == 1:  # nothing to decide beside it
                if self.misread(left, s, READ[s], right) is not None:
                    kinds.add("misread")
                    out += [flat[at:lo], READ[s]]
                    at = hi
                continue
            # a state is the arc last taken and the character before it; the arc is paid for once its right neighbour is known
            states: list[dict[tuple, tuple]] = [{} for _ in range(len(s) + 1)]
            states[0][("", left, None)] = (0.0, 0, None)
            for k in range(len(s)):
                arcs = [(k + 1, s[k], None)] + ([(k + 1, READ[s[k]], s[k])] if s[k] in READ else [])
                arcs += [(k + 2, JOIN[s[k : k + 2]], s[k : k + 2])] if s[k : k + 2] in JOIN else []
                for state, (c0, *_) in states[k].items():
                    for j, c, read in arcs:
                        cost = self._paid(state, c)
                        if cost is None:
                            continue
                        new = (state[1], c, read)
                        if new not in states[j] or c0 + cost < states[j][new][0]:
                            states[j][new] = (c0 + cost, k, state)
            best = None
            for state, (c0, *_) in states[-1].items():
                cost = self._paid(state, right)
                if cost is not None and (best is None or c0 + cost < best[0] or (c0 + cost == best[0] and state[2] is None)):
                    best = (c0 + cost, state)
            k, state = len(s), best[1]
            path = []
            while k > 0:
                _, before, prev = states[k][state]
                path.append(state)
                k, state = before, prev
            if any(x[2] is not None for x in path):
                kinds.add("misread")
                out += [flat[at:lo], "".join(x[1] for x in reversed(path))]
                at = hi
        return "".join(out) + flat[at:]

    def _paid(self, state: tuple, right: str) -> float | None:
        """Cost of going on from an arc to a character: the pair, and for a changed reading the margin, if it is better than the printed one there."""
        left, c, read = state
        cost = -self.p.pair(c, right)
        if read is None:
            return cost
        if self.misread(left, read, c, right) is None:
            return None
        return cost + MARGIN - (self.p.mean if len(read) > 1 else 0.0)

    def flows(self, a: str, b: str) -> float:
        """Log frequency of the pair where a text goes on from a to b."""
        return self.p.pair(a.rstrip()[-1], b.lstrip()[0]) if a.strip() and b.strip() else self.p.mean

    # lines -------------------------------------------------------------------------------------------------------
    def strip_lines(self, lines: list[str], lost: bool) -> tuple[list[str], set[str]]:
        """The lines of the text itself, and what stood between them."""
        kinds: set[str] = set()
        if len(lines) < 2:
            return lines, kinds
        sizes = sorted(len(x.strip()) for x in lines)
        full = sizes[int(0.7 * (len(sizes) - 1))]
        out: list[str] = []
        n = len(lines)
        for i, x in enumerate(lines):
            s = x.strip()
            prev = out[-1] if out else ""
            nxt = next((y for y in lines[i + 1 :] if y.strip() and not PAGE.fullmatch(y)), "")
            if not s:
                continue
            if PAGE.fullmatch(s) and not (lost and self._reference(prev, s, nxt)):
                if full >= 10 or s != x or n > 2:
                    kinds.add("page_number")
                    continue
            m = DECORATED.search(s)
            body = s
            if m and not re.search("[。，]", s) and is_title(s.replace(m.group(), "").strip() or s):
                body = s.replace(m.group(), " ").strip()
                if not body:
                    kinds.add("page_number")
                    continue
            if (prev or i == 0) and self._header(prev, body, nxt, full, i, n):
                kinds.add("running_header")
                if body != s or re.search(r"[\s\u3000]\d{1,3}$|^\d{1,3}[\s\u3000]", body) and not CHAPTER.fullmatch(body):
                    kinds.add("page_number")
                continue
            out.append(x)
        return out, kinds

    def _reference(self, prev: str, s: str, nxt: str) -> bool:
        """A page or a number that the sentence itself speaks of."""
        return bool(re.search(r"(附录|见|参见|详见|在|论文|本文|书)$", prev.strip())) or bool(re.match(r"(列出|所示|的|，共|条|家|份|人|年|项|%|％)", nxt.strip()) and re.fullmatch(r"\d+", s))

    def _header(self, prev: str, s: str, nxt: str, full: int, i: int, n: int) -> bool:
        if not is_title(s) or not nxt and i < n - 1:
            return False
        if THESIS.fullmatch(s) or CHAPTER.fullmatch(s):
            return bool(prev or nxt) and not (i == 0 and len(s) < 0.5 * full and prev == "" and nxt.strip()[:1] in "#")
        if not HAN.search(s):
            # Latin: the text goes on in small letters after a line of capitals
            return bool(prev) and prev.strip()[-1] not in ".!?" and (not nxt or nxt.strip()[:1].islower() or nxt.strip()[:1].isdigit()) or (bool(prev) and s.isupper() and len(s.split()) > 1)
        if not prev or not nxt:
            return False
        joined = self.flows(prev, nxt)
        apart = max(self.flows(prev, s), self.flows(s, nxt))
        short = len(s) < 0.75 * full
        if s.endswith("……") or s.endswith("…"):
            return joined > apart or short
        worst = min(self.flows(prev, s), self.flows(s, nxt))
        return (short and joined > worst + 1.0 and prev.strip()[-1] not in "。！？") or joined > apart + 2.0 or (short and prev.strip()[-1] in "。！？" and self.flows(s, nxt) < self.p.mean - 1.5 and len(s) >= 4)

    # the whole text ------------------------------------------------------------------------------------------------
    def read(self, text: str) -> tuple[set[str], str]:
        kinds: set[str] = set()
        lines = [x for x in LINE.split(text)]
        lines = [x for x in lines if x.strip()]
        han, latin = letters(text)
        zh = han * 3 >= latin
        lost = False
        if len(lines) == 1 and zh and BREAK.search(text):
            # line ends became spaces; a space inside a page reference or beside it is none
            held = re.sub(r"(第) ?(\d+) ?(页)", "\\1\x00\\2\x00\\3", text)
            held = held if not SCHOOL.search(held) else THESIS.sub(lambda m: m.group().replace(" ", "\x00").replace("\u3000", "\x01"), held)
            held = re.sub(r"(?<=\d) / (?=\d)", "\x00/\x00", held)
            held = re.sub(r"([\-–—~～·•]) (\d{1,4}) (?=[\-–—~～·•])", "\\1\x00\\2\x00", held)
            pieces = BREAK.split(held)
            if len(pieces) > 1:
                lines, lost = [p.replace("\x00", " ").replace("\x01", "\u3000") for p in pieces], True
        body, found = self.strip_lines(lines, lost)
        if not lost or "running_header" in found or found:
            kinds |= found
        flat = self.paragraphs(body, zh)
        # heads and numbers inside the stream
        def gone(m: re.Match, kind: str) -> str:
            kinds.add(kind)
            return " " if not zh else ""

        if not zh:
            if DECORATED.search(flat):
                flat = DECORATED.sub(lambda m: m.group() if REFERRED.search(flat[: m.start()]) or re.match(r" of the|[,;)]| shows| lists", flat[m.end() :]) else gone(m, "page_number"), flat)
            if CHAPTER.search(flat) and not CHAPTER.match(flat):
                flat = CHAPTER.sub(lambda m: gone(m, "running_header") if m.start() else m.group(), flat)
            if TITLE_RUN.search(flat):
                flat = TITLE_RUN.sub(lambda m: gone(m, "running_header") if self._run(m.group(1)) else m.group(), flat)
            flat = re.sub(r"(?<=[a-z,] )(\d{1,3}|[IVXLC]{2,6}|[ivxlc]{2,6})(?= [a-z]+)", lambda m: gone(m, "page_number") if self._stray(flat, m) else m.group(), flat)
            flat = re.sub(r" {2,}", " ", flat)
        else:
            if SCHOOL.search(flat) and THESIS.search(flat):
                flat = THESIS.sub(lambda m: gone(m, "running_header") if m.start() and self._inside(flat, m) else m.group(), flat)
            if DECORATED.search(flat):
                flat = INSIDE.sub(lambda m: gone(m, "page_number") + " " * bool(WORDS_BESIDE.match(flat[: m.start()][-1:] + flat[m.end() :][:1])) if self._page(flat, m) else m.group(), flat)
        flat = self.words(flat, kinds, zh, text)
        return kinds, flat

    def _run(self, s: str) -> bool:
        big = [w for w in s.split() if w[0].isupper()]
        return len(big) >= 2 or s.isupper() or "(" in s

    def _inside(self, flat: str, m: re.Match) -> bool:
        a, b = flat[: m.start()], flat[m.end() :]
        return bool(a and b) and self.flows(a, b) > min(self.flows(a, m.group()), self.flows(m.group(), b))

    def _page(self, flat: str, m: re.Match) -> bool:
        """A page number in a Chinese text that the sentence does not speak of."""
        lo, hi = m.span("page")
        return not (re.search(r"(附录|见|参见|详见)\s*$", flat[:lo]) or re.match(r"\s*(列出|所示|，共)", flat[hi:]) or re.match(r"〔\d+〕|第\s*\d+\s*[页頁]$", m["page"]))

    def _stray(self, flat: str, m: re.Match) -> bool:
        """A bare number between two words that go together without it."""
        prev = re.search(r"([a-z]+),? $", flat[: m.start()])
        nxt = re.match(r" ([a-z]+)", flat[m.end() :])
        if not prev or not nxt:
            return False
        a, b = prev.group(1), nxt.group(1)
        with_number = min(self.count(a + " 0"), self.count("0 " + b))
        return with_number * 4 < self.count(a + " " + b) or (with_number < 3 and self.count(a + " " + b) > 0)

    def words(self, flat: str, kinds: set[str], zh: bool, text: str) -> str:
        flat = self.latin(flat, kinds, text)
        if NUMBER_LETTERS.search(flat) or LONE_NUMBER.search(flat):
            kinds.add("misread")
            back = str.maketrans("OolIZSB", "0011258")
            flat = NUMBER_LETTERS.sub(lambda m: m.group().translate(back), flat)
            flat = LONE_NUMBER.sub(lambda m: m.group().translate(back), flat)
        if zh:
            if SOFT_COMMA.search(flat):
                kinds.add("misread")
                flat = re.sub(r"(?<=[一-鿿%]) ,(?=[一-鿿])", "，", flat)
            if KANGXI.search(flat):
                import unicodedata

                kinds.add("misread")
                flat = KANGXI.sub(lambda m: unicodedata.normalize("NFKC", m.group()), flat)
            flat = self.ideographs(flat, kinds)
        return flat

    def paragraphs(self, lines: list[str], zh: bool) -> str:
        """Lines joined into paragraphs: boundaries by dynamic programming over lines and the boundary before each.

        A line inside a paragraph falls short of the full width as little as those do that end in no sentence, one at its end by
        any length; a break costs more where no sentence ended and the better the text flows across it, and so do paragraphs of
        one line or two. Where every line ends in a sentence, widths tell nothing.
        """
        rows = [x.strip() for x in lines]
        if not rows:
            return ""
        if len(rows) == 1:
            return rows[0]
        widths = [len(x) + len(WIDE.findall(x)) for x in rows]
        full = sorted(widths)[ceil(0.7 * (len(rows) - 1))]
        short = [1 - min(1.0, w / max(full, 1)) for w in widths]
        ended = [x[-1:] in ENDS.replace("…", "") + "”）" for x in rows]  # dots are what cuts a head short
        inside = [x for x, e in zip(short[:-1], ended) if not e]
        typical = max(0.03, sum(inside) / len(inside)) if inside else None
        n = len(rows)
        joined = [0.0] * n  # of all lines up to one, if none of them began a paragraph
        apart = [0.0] * n
        for i in range(1, n):
            join = short[i - 1] / typical + log(typical) if typical else 0.0
            joined[i] = joined[i - 1] + join
            flow = min(2.0, max(-2.0, 0.5 * (self.flows(rows[i - 1], rows[i]) - self.p.mean)))
            apart[i] = BREAK_COST + (0.0 if ended[i - 1] else 6.0) + flow
        # best[e]: cost of the lines before e, if a paragraph ends there, and where it began; all of LENGTHS lines or more cost the same
        best: list[tuple[float, int]] = [(0.0, 0)]
        far, far_at = inf, 0
        for e in range(1, n + 1):
            if (s := e - len(LENGTHS)) >= 0 and (c := best[s][0] + apart[s] - joined[s]) < far:
                far, far_at = c, s
            options = [(best[e - k][0] + apart[e - k] + joined[e - 1] - joined[e - k] + LENGTHS[k], e - k) for k in range(1, min(e, len(LENGTHS) - 1) + 1)]
            best.append(min([*options, (far + joined[e - 1], far_at)]))
        marks, e = [], n
        while e > 0:
            e = best[e][1]
            marks.insert(0, e)
        out = []
        for s, e in zip(marks, [*marks[1:], len(rows)]):
            t = rows[s]
            for x in rows[s + 1 : e]:
                if zh and not (re.search("[A-Za-z][-‐]?$", t) and x[:1].isascii() and x[:1].isalpha()):
                    t += x
                else:
                    t += " " + x
            out.append(t)
        return "\n".join(out)


def _word_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words and of neighbouring words in every text, numbers folded together; ideographs part neighbours, as in Decoder.latin."""
    from scriptorium.llm.lm import CELLS, add_words

    n = np.zeros(CELLS, np.int64)
    for b in batches:
        total: Counter = Counter()
        for t in b.column(0).to_pylist():
            if not t:
                continue
            low = t.lower()
            words = LATIN_WORD.findall(low)
            if not words:  # nobody asks for pairs of numbers alone
                continue
            total.update(words)
            for s in HANS.split(low):
                if len(s) > 1:
                    ws = ["0" if w[0].isdigit() else w for w in WORD_OR_NUMBER.findall(s)]
                    total.update(map(" ".join, zip(ws, ws[1:])))
        add_words(n, total)
        add_words(n, {"\1" + k: v for k, v in total.items()})
    at = np.nonzero(n)[0]
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["cell", "n"])


def restore(paragraphs: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """(id, noise, restored): the kinds of noise of each noisy record and its text as continuous paragraphs.

    Two passes count the corpus, one reads it; only counts are shuffled.
    """
    from scriptorium.llm.lm import _table

    spark = paragraphs.sparkSession
    rows = paragraphs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    pairs = spread(spark, pair_table(paragraphs, text_col))
    words = spread(spark, _table(rows.select("text").mapInArrow(_word_pairs, "cell int, n bigint")))
    kind = rows.schema["id"].dataType.simpleString()
    idt = pa.int64() if kind == "bigint" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = Decoder(kept(PairModel, pairs), kept(WordModel, words))
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t.strip() and prose(t):
                    kinds, flat = d.read(t)
                    if kinds:
                        out.append((i, sorted(kinds), flat))
            cols = list(zip(*out)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], idt), pa.array(cols[1], pa.list_(pa.string())), pa.array(cols[2], pa.string())], names=["id", "noise", "restored"])

    return rows.mapInArrow(run, f"id {kind}, noise array<string>, restored string").withColumnRenamed("id", id_col)


def found(paragraphs: DataFrame) -> DataFrame:
    return restore(paragraphs).select("row_id", F.explode("noise").alias("noise"))
