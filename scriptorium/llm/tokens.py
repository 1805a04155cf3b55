"""Token ids of a public byte-level BPE vocabulary (problem 8).

Texts of any length are encoded exactly. Short texts go straight through the tokenizer. A long text is cut into halves
again and again (as rows of their own, so that several tasks share one text); neighbouring encodings are then joined
pairwise, level by level, by re-encoding a window around the join that grows until it ends, on both sides, where a piece
of the split pattern ends in any surroundings.

Defined results: a null and an empty text give an empty list; repeated rows are encoded each by itself; columns besides
id and text are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from scriptorium.runtime import cut

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Split pattern of this family of vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A text above this many characters is cut into rows of this size.
LONG = 65_536
#: Neighbouring parts of a text that one task joins; more of them are joined level by level.
FAN = 64
#: Places where a piece of the split pattern ends whatever stands around them: a letter, a digit or another sign before a character of another class.
#: An apostrophe may hold on to the letters after it; white space may belong to what follows it.
CERTAIN = regex.compile(r"(?<=\p{L})(?=[^\p{L}])|(?<=\p{N})(?=[^\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\s\p{L}\p{N}])")

_ENC: dict = {}


def encoder(directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY):
    """The tokenizer, loaded once per Python worker from the directory given as a parameter."""
    key = (directory, vocabulary)
    if key not in _ENC:
        import tiktoken

        with open(os.path.join(directory, f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENC[key] = tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENC[key]


def _last(text: str, window: int = 256) -> int:
    """The last certain end of a piece inside the text, 0 if there is none: windows at its end grow until they hold one."""
    while True:
        lo = max(0, len(text) - window)
        at = [m.start() for m in CERTAIN.finditer(text, lo)]
        at = [i for i in at if i > lo]  # both neighbours lie in the window
        if at or lo == 0:
            return at[-1] if at else 0
        window *= 2


def _first(text: str, window: int = 256) -> int:
    """The first certain end of a piece inside the text, its length if there is none."""
    while True:
        hi = min(len(text), window)
        m = next((m for m in CERTAIN.finditer(text[:hi]) if 0 < m.start() < hi), None)
        if m or hi == len(text):
            return m.start() if m else hi
        window *= 2


def _tokens_of(enc, tokens, size: int, from_end: bool) -> int:
    """How many tokens, from one end, make up so many bytes."""
    n = k = 0
    for t in reversed(tokens) if from_end else tokens:
        if n >= size:
            break
        n += len(enc.decode_single_token_bytes(t))
        k += 1
    return k


def join_encoded(enc, a: str, ta: list[int], b: str, tb: list[int]) -> list[int]:
    """Tokens of a + b from the tokens of a and of b, exactly.

    The window around the join grows on either side to a place where a piece of the split pattern ends in a, in b and in a + b alike; pieces are encoded
    each by itself, so that both sides agree with the whole beyond the window and only the window is encoded again.
    """
    if not a or not b:
        return tb if not a else ta
    i, j = _last(a), _first(b)
    left = _tokens_of(enc, ta, len(a[i:].encode("utf-8", "replace")), True)
    right = _tokens_of(enc, tb, len(b[:j].encode("utf-8", "replace")), False)
    return [*ta[: len(ta) - left], *enc.encode_ordinary(a[i:] + b[:j]), *tb[right:]]


def join_all(enc, parts: list[tuple[str, list[int]]]) -> list[int]:
    """Pairwise tree over neighbouring parts."""
    while len(parts) > 1:
        nxt = []
        for i in range(0, len(parts) - 1, 2):
            (a, ta), (b, tb) = parts[i], parts[i + 1]
            nxt.append((a + b, join_encoded(enc, a, ta, b, tb)))
        if len(parts) % 2:
            nxt.append(parts[-1])
        parts = nxt
    return parts[0][1] if parts else []


def encode_text(text: str | None, enc, long: int = LONG) -> list[int]:
    """One text, by halves where it is long."""
    if not text:
        return []
    if len(text) <= long:
        return enc.encode_ordinary(text)
    return join_all(enc, [(text[i : i + long], enc.encode_ordinary(text[i : i + long])) for i in range(0, len(text), long)])


def _encode_batches(directory: str, vocabulary: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(directory, vocabulary)
        for b in batches:
            ids = [enc.encode_ordinary(t) if t else [] for t in b.column("text").to_pylist()]
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(ids, pa.list_(pa.int32()))], names=[*b.schema.names[:-1], "ids"])

    return run


def encode(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY, long: int = LONG
) -> DataFrame:
    """(id_col, ids): every row of the input, long texts by tree concatenation. Only long texts are shuffled."""
    rows = documents.select(F.col(id_col).alias("k"), F.col(text_col).alias("text"))
    kind = rows.schema["k"].dataType.simpleString()
    is_long = F.coalesce(F.length("text") > long, F.lit(False))
    short = rows.where(~is_long).mapInArrow(_encode_batches(directory, vocabulary), f"k {kind}, ids array<int>")
    # a repeated id keeps its rows apart
    big = rows.where(is_long).withColumn("u", F.monotonically_increasing_id())

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in enumerate(b.column(2).to_pylist()):
                for at in range(0, len(t), long * FAN):  # a batch for each stretch: pieces are never all in memory beside the text
                    pieces = [t[j : j + long] for j in range(at, min(len(t), at + long * FAN), long)]
                    n = len(pieces)
                    yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * n, b.column(0).type), pa.array([b.column(1)[i].as_py()] * n, pa.int64()), pa.array(range(at // long, at // long + n), pa.int32()), pa.array(pieces, pa.string())], names=["k", "u", "seq", "piece"])

    pieces = big.select("k", "u", "text").mapInArrow(cut_up, f"k {kind}, u bigint, seq int, piece string")
    schema = f"k {kind}, u bigint, seq int, piece string, ids array<int>"
    coded = cut(pieces.withColumn("text", F.col("piece")).repartition("u", "seq").mapInArrow(_encode_batches(directory, vocabulary), schema), "coded")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        enc = encoder(directory, vocabulary)
        pdf = pdf.sort_values("seq")
        ids = join_all(enc, [(p, i.tolist()) for p, i in zip(pdf["piece"], pdf["ids"])])
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "u": [pdf["u"].iloc[0]], "seq": [int(pdf["seq"].iloc[0]) // FAN], "piece": ["".join(pdf["piece"])], "ids": [ids]})

    most = coded.agg(F.max("seq")).first()[0] or 0
    while most > 0:
        coded = coded.groupBy("u", F.floor(F.col("seq") / FAN)).applyInPandas(merge, schema)
        most //= FAN
        if most > 0:
            coded = cut(coded, "joined")
    return short.unionByName(coded.select("k", "ids")).withColumnRenamed("k", id_col)


def count_tokens(documents: DataFrame, text_col: str = "text", out: str = "n_tokens", directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """The input with its number of tokens; null and empty texts have none."""
    @pandas_udf("bigint")
    def size(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(directory, vocabulary)
        for s in it:
            yield pd.Series([len(encode_text(t, enc)) if isinstance(t, str) else 0 for t in s], dtype="int64")

    return documents.withColumn(out, size(F.col(text_col)))
