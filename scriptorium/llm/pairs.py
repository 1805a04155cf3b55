"""Broken prompt and response pairs (problem 6).

The suffix automaton of a prompt measures how much of the response is copied from it and how much of the prompt is
covered; an Aho-Corasick automaton finds words of refusal outside quotations; a stack of delimiters and the endings the
corpus gives its sentences tell whether a response stops inside a sentence; votes of function words and scripts name its
language.

Defined results: a null, blank or placeholder answer is empty whatever the prompt is; with a null or blank prompt an
answer can't be copied or in another language; at most one defect a row, in the order empty, refusal, copied,
other_language, truncated; repeated rows are judged each by itself; texts are read whole at any length.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import language
from scriptorium.llm.lm import CELLS, STEP, _table, spread

#: What an answer says when it says nothing (fixed values, compared without punctuation).
NOTHING = frozenset("无 空 略 暂无 null none nil na nan n/a undefined empty nothing 没有 无内容 无答案 待补充 todo tbd".split())
#: Wording put before or after an answer (fixed values).
LEAD = re.compile(r"^\s*(?:(?:以下(?:是|为))?(?:最终)?(?:改写|润色|修改|重写|翻译|译文|答案|回答|结果)(?:后|结果|版本|文本|如下)*|译文|rewritten(?: version| text)?|revised(?: version| text)?|answer|translation|output|final version)\s*[：:]\s*", re.I)
TAIL = re.compile(r"\s*[（(\[【](?:以上(?:为|是)?(?:最终)?(?:改写|润色)|final version|end|完)[^（(]{0,6}[)）\]】]\s*$", re.I)
#: Words of refusal (fixed values): they decline a task, in one of the languages.
REFUSALS = (
    "无法改写|无法润色|无法重写|无法翻译|无法处理|无法完成|无法提供|无法协助|无法回答|无法满足|无法为您|我无法|我不能|我们不能为|不能帮|不能为您|不能为你|不能据此|不能改写|不能协助|不便处理|不便改写|不便回答|不便提供|不予改写|不予处理|不予回答|"
    "恕难从命|恕不|拒绝润色|拒绝处理|没有足够的信息|不适合由我|不适合我来|无能为力|超出了我的能力|超出我的能力|作为语言模型|作为人工智能|作为一个ai|作为ai|受限信息|敏感内容|违反了|请更换后重试|拒绝改写|拒绝回答|爱莫能助|"
    "i can't|i cannot|i can not|i am unable|i'm unable|i am not able|i'm not able|i won't|i will not be able|cannot assist|can't assist|can't help|cannot help|cannot be rewritten|can't be rewritten|unable to process|unable to comply|unable to rewrite|unable to assist|policy restriction|as an ai|as a language model|i must decline|not able to rewrite|against my guidelines|"
    "kann ich nicht|kann diesen text nicht|nicht umschreiben|kann leider nicht|ich darf nicht|je ne peux pas|je ne suis pas en mesure|impossible de traiter|no puedo|no me es posible|не могу|не в состоянии|できません|いたしかねます|お手伝いできない|対応できかねます"
).split("|")
#: Words of regret that make a short answer a refusal together with a word of inability.
REGRETS = "抱歉|对不起|很遗憾|遗憾|不好意思|请谅解|sorry|unfortunately|apologize|apologise|es tut mir leid|leider|désolé|lo siento|lamento|к сожалению|извините|申し訳|すみません".split("|")
INABILITY = "无法|不能|不可|不便|cannot|can't|unable|nicht|ne peux|no puedo|не могу|できません|できない".split("|")
OPEN = dict(zip("“‘（(【[《「『", "”’）)】]》」』"))
CLOSE = {v: k for k, v in OPEN.items()}
DONE = "。！？!?.．"
#: Length (normalised) from which what a refusal says outside quotations must not be taken from the prompt, and the share of it that may be.
REFUSAL_LENGTH = 160
REFUSAL_COPIED = 0.3


def normal(s: str) -> str:
    """Letters and digits only, in one case and width."""
    return NEITHER.sub("", unicodedata.normalize("NFKC", s).lower())


NEITHER = re.compile(r"[\W_]+")


def bare(s: str) -> str:
    """The answer without the wording put around it."""
    while True:
        t = TAIL.sub("", LEAD.sub("", s, count=1), count=1)
        if t == s:
            return s
        s = t


def outside_quotes(s: str) -> tuple[str, bool]:
    """Text outside quotation marks, by a stack of delimiters; and whether one is left open."""
    stack: list[str] = []
    out = []
    at = quoted = 0
    for m in DELIMITER.finditer(s):
        i, c = m.start(), m.group()
        if not quoted:
            out.append(s[at:i])
        at = i + 1
        if c == "’" and i and s[i - 1].isalpha() and i + 1 < len(s) and s[i + 1].isalpha():
            out.append("'")  # an apostrophe
        elif c in OPEN:
            stack.append(c)
        else:
            while stack:
                if stack.pop() == CLOSE[c]:
                    break
        quoted = any(q in "“‘「『" for q in stack)
    if not quoted:
        out.append(s[at:])
    return "".join(out), bool(stack)


DELIMITER = re.compile("[" + re.escape("".join(OPEN) + "".join(CLOSE)) + "]")


class SuffixAutomaton:
    """All substrings of a text; states are built online, transitions are dicts."""

    def __init__(self, text: str):
        nxt: list[dict[str, int]] = [{}]
        link, size = [-1], [0]
        last = 0
        for n, ch in enumerate(text, 1):
            cur = len(nxt)
            nxt.append({})
            size.append(n)
            p = last
            while p >= 0:
                t = nxt[p]
                if ch in t:
                    break
                t[ch] = cur
                p = link[p]
            if p < 0:
                link.append(0)
            else:
                q = t[ch]
                if size[q] == size[p] + 1:
                    link.append(q)
                else:
                    clone = cur + 1
                    link.append(clone)
                    nxt.append(nxt[q].copy())
                    size.append(size[p] + 1)
                    link.append(link[q])
                    link[q] = clone
                    while p >= 0 and nxt[p].get(ch) == q:
                        nxt[p][ch] = clone
                        p = link[p]
            last = cur
        self.next, self.link, self.len = nxt, link, size

    def matches(self, text: str) -> list[int]:
        """For each position of text the length of the longest substring of the automaton's text that ends there."""
        out, s, n = [], 0, 0
        for ch in text:
            while s and ch not in self.next[s]:
                s = self.link[s]
                n = self.len[s]
            if ch in self.next[s]:
                s = self.next[s][ch]
                n += 1
            else:
                s = n = 0
            out.append(n)
        return out


@lru_cache(maxsize=256)
def _automaton(prompt: str) -> SuffixAutomaton:
    """Kept for the other answers to the same prompt."""
    return SuffixAutomaton(prompt)


def _shares(a: str, b: str, k: int) -> bool:
    """Some substring of k characters is in both."""
    if len(b) < k:
        return False
    have = {a[i : i + k] for i in range(len(a) - k + 1)}
    return any(b[i : i + k] in have for i in range(len(b) - k + 1))


def coverage(prompt: str, answer: str, least: int = 12) -> tuple[float, int]:
    """The share of the normalised answer inside copies of at least `least` characters, and the longest copy."""
    if not prompt or not answer:
        return 0.0, 0
    if not _shares(prompt, answer, min(least, len(prompt))):
        return 0.0, 0  # what the automaton would find nothing of
    m = _automaton(prompt).matches(answer)
    covered, upto = 0, len(answer)
    for i in range(len(answer) - 1, -1, -1):
        if m[i] >= least:
            lo = i - m[i] + 1
            covered += max(0, min(upto, i + 1) - lo)
            upto = min(upto, lo)
    return covered / len(answer), max(m)


@lru_cache(maxsize=1)
def refusals():
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in REFUSALS:
        a.add_word(w, 2)
    for w in REGRETS:
        a.add_word(w, 1)
    for w in INABILITY:
        if not a.exists(w):
            a.add_word(w, 0)
    a.make_automaton()
    return a


def declines(answer: str, prompt: str = "") -> bool:
    """A refusal stands outside quotations, in an answer that is short or, at any length, begins with one and is hardly made of the prompt (normalised)."""
    hits = list(refusals().iter(unicodedata.normalize("NFKC", answer).lower().replace("’", "'")))
    kinds = {v for _, v in hits}
    if not (2 in kinds or {0, 1} <= kinds):
        return False
    rest, _ = outside_quotes(answer)
    said = unicodedata.normalize("NFKC", rest).lower().replace("’", "'")
    hits = list(refusals().iter(said))
    kinds = {v for _, v in hits}
    if not (2 in kinds or {0, 1} <= kinds):
        return False
    n = normal(rest)
    if len(n) <= REFUSAL_LENGTH:
        return True
    # in a long answer a refusal is a phrase of whole words near its start
    whole = any(v == 2 and end < REFUSAL_LENGTH and not (said[end].isalpha() and said[end] < "\u2e80" and said[end + 1 : end + 2].isalpha()) for end, v in hits)
    return whole and bool(prompt) and coverage(prompt, n, 6)[0] < REFUSAL_COPIED


def ending_cell(s: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s) >> 42


SHORT_ENDING = re.compile(r"(?:[^\W\d_]{1,2}|\d[%％])$")


def endings(t: str) -> list[str]:
    """The three characters, or the shorter word or percentage, before each end of a sentence."""
    out = []
    for m in SENTENCE_END.finditer(t):
        i = m.start()
        s = t[max(0, i - 3) : i]
        if len(s) == 3 and s.replace("_", "a").isalnum():
            out.append(s)
        elif x := SHORT_ENDING.search(s):
            out.append(x.group())
    return out


SENTENCE_END = re.compile("[。！？.!?]")


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the three characters (or the word) before a sentence ends, and of the same three in any place, in one table each half."""
    total = np.zeros(CELLS, np.int64)
    for b in batches:
        c: Counter = Counter()
        for t in b.column(0).to_pylist():
            c.update(endings(t))
        for w, n in c.items():
            total[ending_cell(w)] += n
    at = np.nonzero(total)[0]
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])


def complete(s: str, ends: np.ndarray) -> bool:
    """Does the text, its final ellipsis or missing stop aside, end like a sentence of the corpus?"""
    m = re.search(r"(\w\w\w|[^\W\d_]+|\d[%％])$", s)
    if not m:
        return False
    q = ends[ending_cell(m.group(1)[-3:])]
    return bool(q) and np.exp((q - 1) / STEP) >= 3


def truncated(answer: str, ends: np.ndarray) -> bool:
    """The answer stops inside a sentence."""
    s = answer.strip()
    t = s.rstrip("”’\"'）)】]》」』*`_ \n")
    if not t:
        return False
    last = t[-1]
    if last in DONE:
        dots = re.search(r"\.{2,}$", t)
        return bool(dots) and not complete(t.rstrip(".… "), ends)
    if t != s:
        # something is closed at the end: a citation, a remark or a quotation that stands complete
        opened = outside_quotes(s)[1]
        inner = re.search(r"[（(\[【《“‘「『][^（(\[【《“‘「『]*$", t)
        if inner and not opened:
            before = s[: inner.start()].rstrip()
            return bool(before) and before[-1] not in DONE and not complete(before, ends)
    if last == "…":
        # a full ellipsis may stand after a sentence; half of one is a cut
        return not (t.endswith("……") and complete(t.rstrip("…. "), ends)) and t.rstrip("…")[-1:] not in DONE
    return True


HAN, KANA, CYRILLIC, LATIN = (re.compile(f"[{c}]+") for c in ("一-鿿", "ぁ-ヿ", "Ѐ-ӿ", "A-Za-zÀ-ɏ"))
ANCHORS = {k: frozenset(v.split()) for k, v in language.ANCHORS.items()}


def language_vote(s: str) -> str | None:
    """The language of a text: by script, and among those in Latin letters by the votes of function words."""
    n = {k: sum(map(len, r.findall(s))) for k, r in (("zh", HAN), ("ja", KANA), ("ru", CYRILLIC), ("latin", LATIN))}
    if not any(n.values()):
        return None
    if n["ja"] * 8 >= n["zh"] + n["ja"] and n["ja"] + n["zh"] > n["latin"] / 3:
        return "ja"
    # an ideograph says about as much as three letters
    top = max((3 * n["zh"], "zh"), (n["ru"], "ru"), (n["latin"], "latin"))[1]
    if top != "latin":
        return top
    words = LATIN.findall(s.lower())
    votes = {k: sum(w in v for w in words) for k, v in ANCHORS.items()}
    best = max(votes, key=votes.__getitem__)
    return best if votes[best] >= 2 else None


def defect(prompt: str | None, answer: str | None, ends: np.ndarray) -> tuple[str | None, float]:
    """The defect of a pair, with the share of the answer that is copied."""
    text = bare(answer or "")
    a = normal(text)
    if not a or a in NOTHING or (text.strip().lower().strip("()（）[]。.") in NOTHING):
        return "empty", 0.0
    p = normal(prompt or "")
    if declines(text, p):
        return "refusal", 0.0
    share = 0.0
    if len(p) >= 8:
        share, longest = coverage(p, a)
        if longest >= len(p) and len(a) <= 1.5 * len(p) + 20 or (share >= 0.985 and len(a) >= 0.9 * len(p)):
            return "copied", share
        lp, la = language_vote(prompt), language_vote(text)
        if lp and la and lp != la and len(a) >= 8:
            return "other_language", share
    if truncated(text, ends):
        return "truncated", share
    return None, share


def judge(variants: DataFrame) -> DataFrame:
    """(row_id, defect, copied_share): every defective pair. Two passes over the rows; only counts of endings are shuffled."""
    spark = variants.sparkSession
    texts = variants.select(F.explode(F.array("original_text", "variant_text")).alias("t")).where("t IS NOT NULL")
    ends = spread(spark, _table(texts.mapInArrow(_endings, "cell int, n bigint")))
    rows = variants.select("row_id", "original_text", "variant_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = ends.value[0]
        for b in batches:
            out = []
            for i, p, a in zip(*(b.column(j).to_pylist() for j in range(3))):
                d, share = defect(p, a, e)
                if d:
                    out.append((i, d, round(share, 4)))
            cols = list(zip(*out)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], names=["row_id", "defect", "copied_share"])

    return rows.mapInArrow(run, "row_id bigint, defect string, copied_share double")
