"""Missing or wrong document language labels (problem 10).

The script of a word narrows its languages; scores of words learned from all labelled documents (with function words as
anchors) rank them; a Viterbi pass with a penalty for switching labels the spans of a text. A segment, the part between
blank lines, and a document have the language most of their letters are in.

Defined results: null, empty and blank texts and texts without letters have no language and are no case; an unlabelled
table is scored by function words alone; equal letter counts go to the language of the earlier span; repeated documents
are labelled each by itself; line ends of any kind separate lines; the length of a text does not matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.lm import CELLS, STEP, kept, spread, word_cells

LANGS = ("zh", "en", "ja", "de", "fr", "es", "ru")
LATIN = ("en", "de", "fr", "es")
#: Nats a change of language between neighbouring words costs.
SWITCH = 7.0
#: Letters of a Latin term that stands inside a Chinese or Japanese sentence, at most.
TERM = 40
#: Spellings of labels (fixed values): language codes of two and three letters, names in English and Chinese, own names.
SPELLINGS = {
    "zh": "zh zho chi cmn chinese mandarin 中文 汉语 漢語 华语 简体中文 zh-hans 国语 普通话",
    "en": "en eng english 英文 英语 英語",
    "ja": "ja jpn jp japanese 日文 日语 日本語",
    "de": "de deu ger german deutsch 德文 德语",
    "fr": "fr fra fre french français francais 法文 法语",
    "es": "es spa spanish español espanol castellano 西班牙文 西班牙语",
    "ru": "ru rus russian русский 俄文 俄语",
}
BY_SPELLING = {w: k for k, ws in SPELLINGS.items() for w in ws.split()}
#: Function words (fixed values).
ANCHORS = {
    "en": "the of and to in a is that for it as was with be by on not are from this have or which their they been has than its were while",
    "de": "der die das und ist nicht zu den dem ein eine mit von für auf im des sich auch werden wird sie es bei einer dass oder nach noch weder",
    "fr": "le la les des et est une du que qui dans pour pas sur au par avec ce sont plus ne cette ont aux être ces ou leur près",
    "es": "el la los las de y que en un una por con para del es se no su al como más son pero sus este esta ha o entre cerca",
}
#: Letters that point to one of the languages in the Latin alphabet (fixed values).
MARKS = {"de": "äöüß", "fr": "éèêëàâçùûîïôœ", "es": "ñáíóú¿¡"}
TOKEN = re.compile("[぀-ヿー々〆一-鿿㐀-䶿]+|[А-Яа-яЁё]+|[A-Za-zÀ-ÖØ-öø-ɏ]+|[가-힣]+")
KANA = re.compile("[぀-ヿー]")
LINE_END = re.compile("\r\n|[\n\r\x0b\x0c\x85  ]")


def label(c: Column) -> Column:
    """The language a label names, null if it names none of them."""
    x = F.lower(F.regexp_replace(c, r"(?U)^[\s　]+|[\s　]+$", ""))
    known = F.create_map(*[F.lit(v) for kv in BY_SPELLING.items() for v in kv])
    return F.coalesce(F.try_element_at(known, x), F.try_element_at(known, F.regexp_extract(x, r"^([^-_ (]+)[-_ (]", 1)))


def segments(text: str) -> list[str]:
    """Parts between blank lines, in order."""
    out, at = [], []
    for line in LINE_END.split(text):
        if line.strip():
            at.append(line)
        elif at:
            out.append("\n".join(at))
            at = []
    if at:
        out.append("\n".join(at))
    return out


class Words:
    """Scores of Latin words from their counts in each Latin language, in hashed tables of fixed size: every word of the corpus counts, however many there are.

    A word's count is the least of two cells, so that one rare word in a crowded table hardly takes another's.
    """

    def __init__(self, q: np.ndarray, totals: list[float]):
        self.n = np.where(q == 0, 0.0, np.exp((q.astype(np.float32) - 1) / STEP)).astype(np.float32)
        self.totals = totals
        self.cache: dict[str, tuple[float, ...] | None] = {}

    def get(self, word: str) -> tuple[float, ...] | None:
        """Scores of a word in lower case, none if no labelled document has it and it is no function word."""
        if word not in self.cache:
            if len(self.cache) > 500_000:
                self.cache.clear()
            a, b = word_cells([word, "\1" + word])
            n = np.minimum(self.n[:, a], self.n[:, b])
            known = any(word in v for v in WORDS.values())
            self.cache[word] = self._scores(word, n.tolist(), known) if known or n.any() else None
        return self.cache[word]

    def _scores(self, word: str, n: list[float], known: bool) -> tuple[float, ...]:
        # what a language's share of the labels may be wrong by is part of the floor
        p = [(x + 0.02) / (t + 400.0) for x, t in zip(n, self.totals)]
        noise = 0.03 * max(p)
        s = [math.log(max(x, noise)) for x in p]
        top = max(s)
        s = [max(x - top, -3.5) for x in s]
        return tuple(x + (1.0 if word in WORDS[k] else -0.5) for x, k in zip(s, LATIN)) if known else tuple(s)


WORDS = {k: frozenset(v.split()) for k, v in ANCHORS.items()}


def learn(documents: DataFrame) -> tuple[np.ndarray, list[float]]:
    """Quantised log counts of Latin words in each of the Latin languages, from all documents whose label names one, and the words of each: what Words is made of."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            texts = b.column(1).to_pylist()
            for k in set(langs.tolist()):
                c: Counter = Counter()
                for i in np.nonzero(langs == k)[0]:
                    c.update(re.findall("[A-Za-zÀ-ÖØ-öø-ɏ]+", texts[i].lower()))
                if c:
                    n = np.fromiter(c.values(), np.float64, len(c))
                    cells = word_cells([*c, *("\1" + w for w in c)])
                    totals[k] = totals.get(k, 0) + np.bincount(cells, weights=np.concatenate([n, n]), minlength=CELLS).astype(np.int64)
        for k, n in totals.items():
            at = np.nonzero(n)[0]
            yield pa.RecordBatch.from_arrays([pa.array([LATIN.index(k)] * len(at), pa.int32()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "cell", "n"])

    rows = documents.select(label(F.col("lang")).alias("lang"), "text").where(F.col("lang").isin(*LATIN) & F.col("text").isNotNull())
    counts = rows.mapInArrow(count, "lang int, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()  # at most CELLS rows a language
    n = np.zeros((len(LATIN), CELLS), np.float64)
    n[counts.column("lang").to_numpy(), counts.column("cell").to_numpy()] = counts.column("n").to_numpy()
    q = np.zeros(n.shape, np.uint8)
    some = n > 0
    q[some] = np.minimum(255, 1 + np.round(np.log(n[some]) * STEP)).astype(np.uint8)
    return q, [float(x) / 2 for x in n.sum(1)]


def score(word: str, table: Words) -> dict[str, float]:
    """Scores of the languages a word may be in, by its script first."""
    if "A" <= word[0] <= "z" or "À" <= word[0] <= "ɏ":
        w = word.lower()
        s = table.get(w)
        if s is None:
            s = tuple(0.8 if k in MARKS and any(c in MARKS[k] for c in w) else 0.0 for k in LATIN)
        return dict(zip(LATIN, s))
    if "Ѐ" <= word[0] <= "ӿ":
        return {"ru": 1.0}
    kana = len(KANA.findall(word))
    if kana:
        return {"ja": 1.0 + kana, "zh": -2.0 * kana}
    return {"zh": 0.4 * len(word), "ja": 0.0}


def spans(text: str, table: Words, switch: float = SWITCH) -> list[tuple[str, int, float]]:
    """(language, letters, margin) of each span of one language, by Viterbi over the words; the margin is what the span's words score more than in any other language."""
    tokens = TOKEN.findall(text)
    if not tokens:
        return []
    best = {k: 0.0 for k in LANGS}
    back: list[tuple[dict[str, str], int, dict[str, float], float]] = []
    for t in tokens:
        s = score(t, table)
        top = max(best, key=best.__getitem__)
        stay = best[top] - switch
        nxt, came = {}, {}
        far = -4.0 - 0.5 * min(len(t), 20)
        for k in LANGS:
            b = best[k]
            if b >= stay:
                came[k] = k
            else:
                b, came[k] = stay, top
            nxt[k] = b + s.get(k, far)
        best = nxt
        back.append((came, len(t), s, far))
    k = max(best, key=best.__getitem__)
    path = []
    for came, n, s, far in reversed(back):
        path.append((k, n, s, far))
        k = came[k]
    # spans with the scores of their words in each language
    out: list[list] = []
    for k, n, s, far in reversed(path):
        if not out or out[-1][0] != k:
            out.append([k, 0, dict.fromkeys(LANGS, 0.0)])
        out[-1][1] += n
        for q in LANGS:
            out[-1][2][q] += s.get(q, far)
    # a foreign term inside a sentence is of that sentence's language
    terms = []
    for i, (k, n, _) in enumerate(out):
        near = [out[j][0] for j in (i - 1, i + 1) if 0 <= j < len(out) and out[j][0] in ("zh", "ja")] if k in LATIN and n <= TERM else []
        terms.append(near[0] if near else None)
    merged: list[list] = []
    for (k, n, sums), term in zip(out, terms):
        margin = None if term else sums[k] - max(v for q, v in sums.items() if q != k)
        if merged and merged[-1][0] == (term or k):
            merged[-1][1] += n
            merged[-1][2] = max((m for m in (merged[-1][2], margin) if m is not None), default=None)
        else:
            merged.append([term or k, n, margin])
    return [(k, n, m if m is not None else 0.0) for k, n, m in merged]


def languages(text: str | None, table: Words) -> tuple[tuple[str, float] | None, list[tuple[str | None, float]]]:
    """The document's language with a confidence, and that of each segment."""
    if not text or not text.strip():
        return None, []
    total: Counter = Counter()
    parts: list[tuple[str | None, float]] = []
    sure = 0.0
    for seg in segments(text):
        c: Counter = Counter()
        sure_of: Counter = Counter()
        for k, n, margin in spans(seg, table):
            c[k] += n
            sure_of[k] += n * (1 - 0.5 * math.exp(-max(margin, 0.0)))
        if not c:
            parts.append((None, 0.0))
            continue
        k, n = c.most_common(1)[0]
        conf = sure_of[k] / sum(c.values())
        parts.append((k, round(conf, 4)))
        total.update(c)
        sure += conf * sum(c.values())
    if not total:
        return None, parts
    k, n = total.most_common(1)[0]
    return (k, round(n / total.total() * sure / total.total(), 4)), parts


def detect(documents: DataFrame, table: tuple[np.ndarray, list[float]] | None = None) -> DataFrame:
    """(doc_id, seg_no, lang, confidence, named, mixed): seg_no -1 for the document, from 0 for its segments; named is the language its label names.

    One pass learns the words, one pass labels; only word counts are shuffled.
    """
    spark = documents.sparkSession
    words = table if table is not None else learn(documents)
    b = spread(spark, words)  # CELLS bytes a language
    rows = documents.select("doc_id", F.col("text"), label(F.col("lang")).alias("named"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    idt = pa.int64() if kind == "bigint" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = kept(Words, b)
        for batch in batches:
            out = []
            for i, t, named in zip(*(batch.column(j).to_pylist() for j in range(3))):
                doc, parts = languages(t, w)
                if doc is None:
                    continue
                mixed = len({k for k, _ in parts if k}) > 1
                out.append((i, -1, doc[0], doc[1], named, mixed))
                for n, (k, c) in enumerate(parts):
                    out.append((i, n, k or doc[0], c, named, mixed))
            cols = list(zip(*out)) if out else [[]] * 6
            types = [idt, pa.int32(), pa.string(), pa.float64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types)], names=["doc_id", "seg_no", "lang", "confidence", "named", "mixed"])

    return rows.mapInArrow(run, f"doc_id {kind}, seg_no int, lang string, confidence double, named string, mixed boolean")


def found(documents: DataFrame) -> DataFrame:
    """(doc_id, seg_no, lang): documents whose label is missing or wrong, and every segment of a mixed document."""
    d = detect(documents)
    return d.where(F.when(F.col("seg_no") == -1, F.col("named").isNull() | (F.col("named") != F.col("lang"))).otherwise(F.col("mixed"))).select("doc_id", "seg_no", "lang")
