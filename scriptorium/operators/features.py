"""Statistical features of texts, the training rows made of them, and their joining with embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from scriptorium.functions import patterns as P
from scriptorium.functions.text import count_any, count_chars, count_of, count_subs, distinct_chars, matches, pieces, ratio, rx, strip

#: Order of the online vector.
ONLINE = ("avg_sentence_length", "sentence_length_std", "comma_ratio", "period_ratio", "pronoun_ratio", "conjunction_ratio", "unique_word_ratio", "avg_word_length", "digit_ratio", "chinese_char_ratio", "paragraph_length", "burstiness", "formality_score")
#: Order of the training vector; the two counts after it are computed but not in it.
TRAINING = ("char_count", "sentence_count", "chinese_ratio", "english_ratio", "digit_ratio", "comma_count", "period_count", "vocab_diversity", "avg_sentence_length", "has_citation", "has_formula", "has_table_ref", "has_figure_ref")
#: Characters str.isdigit knows beyond decimal digits, as ranges.
OTHER_DIGITS = r"\x{b2}\x{b3}\x{b9}\x{1369}-\x{1371}\x{19da}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247c}\x{2488}-\x{2490}\x{24ea}\x{24f5}-\x{24fd}\x{24ff}\x{2776}-\x{277e}\x{2780}-\x{2788}\x{278a}-\x{2792}"


def with_online(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The thirteen online features as columns; shared parts are computed once."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    n = F.length(t)
    d = df.withColumn("_n", n).withColumn("_s", F.transform(F.filter(F.transform(F.split(t, rx(r"[。！？.\n]"), -1), strip), lambda x: x != ""), lambda x: F.length(x).cast("double")))
    total = F.aggregate("_s", F.lit(0.0), lambda a, x: a + x)
    d = d.withColumn("avg_sentence_length", ratio(total, F.size("_s")))
    sq = F.aggregate("_s", F.lit(0.0), lambda a, x: a + (x - F.col("avg_sentence_length")) * (x - F.col("avg_sentence_length")))
    d = d.withColumn("sentence_length_std", F.sqrt(ratio(sq, F.size("_s"))))
    words = F.filter(F.split(t, rf"{P.WS}+", -1), lambda x: x != "")
    d = d.withColumn("_w", F.transform(words, lambda x: F.length(x).cast("double")))
    n = F.col("_n")
    return (
        d.withColumn("comma_ratio", ratio(count_any(t, "，,"), n)).withColumn("period_ratio", ratio(count_any(t, "。."), n))
        .withColumn("pronoun_ratio", ratio(count_subs(t, P.PRONOUNS), n)).withColumn("conjunction_ratio", ratio(count_subs(t, P.CONJUNCTIONS), n))
        .withColumn("unique_word_ratio", ratio(distinct_chars(t), n)).withColumn("avg_word_length", ratio(F.aggregate("_w", F.lit(0.0), lambda a, x: a + x), F.size("_w")))
        .withColumn("digit_ratio", ratio(count_chars(t, rf"[\p{{Nd}}{OTHER_DIGITS}]"), n)).withColumn("chinese_char_ratio", ratio(count_chars(t, P.HAN), n))
        .withColumn("paragraph_length", n).withColumn("burstiness", ratio(F.col("sentence_length_std"), F.col("avg_sentence_length")))
        .withColumn("formality_score", ratio(count_subs(t, P.FORMAL), n)).drop("_n", "_s", "_w")
    )


def with_training(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The fifteen training features as columns."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    n = F.length(t)
    han = F.regexp_replace(t, rf"[^{P.HAN[1:-1]}]+", "")
    lengths = F.transform(pieces(t, P.SENTENCE_END), lambda x: F.length(x).cast("double"))
    d = df.withColumn("_h", han).withColumn("_l", lengths)
    return (
        d.withColumn("char_count", n).withColumn("sentence_count", count_of(t, P.SENTENCE_END) + 1)
        .withColumn("chinese_ratio", ratio(F.length("_h"), n)).withColumn("english_ratio", ratio(count_chars(t, "[a-zA-Z]"), n)).withColumn("digit_ratio", ratio(count_chars(t, P.DIGIT), n))
        .withColumn("comma_count", count_any(t, "，,")).withColumn("period_count", count_any(t, "。.")).withColumn("semicolon_count", count_any(t, "；;")).withColumn("colon_count", count_any(t, "：:"))
        .withColumn("vocab_diversity", ratio(distinct_chars(F.col("_h")), F.length("_h")))
        .withColumn("avg_sentence_length", ratio(F.aggregate("_l", F.lit(0.0), lambda a, x: a + x), F.size("_l")))
        .withColumn("has_citation", matches(t, rf"\[{P.DIGIT}+\]").cast("int")).withColumn("has_formula", matches(t, "[=∑∏∫√∂]").cast("int"))
        .withColumn("has_table_ref", matches(t, P.TABLE_REF).cast("int")).withColumn("has_figure_ref", matches(t, P.FIGURE_REF).cast("int")).drop("_h", "_l")
    )


def vector(names: tuple[str, ...]) -> Column:
    return F.array(*(F.col(c).cast("double") for c in names))


def combine(stat: Column, embedding: Column, online: bool) -> Column:
    """Online vectors lead with the statistics, training vectors with the embedding."""
    return F.concat(stat, embedding) if online else F.concat(embedding, stat)


def embedding_part(combined: Column, dim: int) -> Column:
    """The embedding at the end of an online vector."""
    return F.slice(combined, -dim, dim)


Encoder = Callable[[Iterator[pd.Series]], Iterator[pd.Series]]


def hashed_encoder(dim: int = 64, limit: int = 512) -> Encoder:
    """A deterministic stand-in for a text encoder: character trigrams hashed into signed cells, scaled to length 1; whole batches at a time."""
    import numpy as np

    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            texts = [(t or "")[:limit] for t in s]
            a = np.frombuffer("".join(t + "\0\0" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            row = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
            v = np.zeros((len(texts), dim))
            if len(a) > 2:
                with np.errstate(over="ignore"):
                    h = (a[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (a[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (a[2:] * np.uint64(0x165667B19E3779F9))
                    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                whole = (a[1:-1] != 0) & (a[2:] != 0) & (a[:-2] != 0)
                h, r = h[whole] >> np.uint64(20), row[:-2][whole]
                np.add.at(v, (r, (h % np.uint64(dim)).astype(np.int64)), np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0))
            n = np.sqrt((v * v).sum(1, keepdims=True))
            yield pd.Series(list(v / np.where(n > 0, n, 1.0)))

    return run


def model_encoder(folder: str, batch: int = 8, limit: int = 512) -> Encoder:
    """The first vector (that of the opening token) of a text encoder: model.onnx and tokenizer.json in a folder all workers can read.

    The model is loaded once a worker and reads `batch` texts at a time, 8 on processors, 32 where there are accelerators; the number of floats is the model's.
    """

    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np
        import onnxruntime
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(f"{folder}/tokenizer.json")
        tok.enable_truncation(limit)
        tok.enable_padding()
        model = onnxruntime.InferenceSession(f"{folder}/model.onnx", providers=onnxruntime.get_available_providers())
        wanted = [i.name for i in model.get_inputs()]
        for s in it:
            out: list = []
            texts = [(t or "")[:limit] for t in s]
            for i in range(0, len(texts), batch):
                e = tok.encode_batch(texts[i : i + batch])
                all_ = {"input_ids": [x.ids for x in e], "attention_mask": [x.attention_mask for x in e], "token_type_ids": [x.type_ids for x in e]}
                hidden = model.run(None, {k: np.array(all_[k], np.int64) for k in wanted})[0]
                out += [v.astype(float) for v in (hidden[:, 0] if hidden.ndim == 3 else hidden)]
            yield pd.Series(out)

    return run


def embed(df: DataFrame, text_col: str = "text", out: str = "embedding", encoder: Encoder | None = None, limit: int = 512) -> DataFrame:
    """Embeddings by a batch encoder that is loaded once per worker; it sees the first `limit` characters only, as encoders do."""
    run = encoder or hashed_encoder(limit=limit)

    @pandas_udf("array<double>")
    def apply(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from run(it)

    return df.withColumn(out, apply(F.substring(F.col(text_col), 1, limit)))


def training_features(rows: DataFrame, encoder: Encoder | None = None) -> DataFrame:
    """The rows of `training_rows` with bert_features, stat_features and combined_features, the embedding leading."""
    v = embed(with_training(rows.drop("char_count", "sentence_count", *(c for c in TRAINING if c in rows.columns))), encoder=encoder, out="bert_features")
    v = v.withColumn("stat_features", vector(TRAINING)).withColumn("combined_features", combine(F.col("stat_features"), F.col("bert_features"), online=False))
    return v.select(*rows.columns, "bert_features", "stat_features", "combined_features")


def human_rows(paragraphs: DataFrame) -> DataFrame:
    """Training rows of label 0: paragraphs of 50 to 500 characters; hard splits are hard."""
    return paragraphs.where(F.length("text").between(50, 500)).select(
        "text", "doc_id", "para_index", "year", "para_type", "chapter_role", F.lit(0).alias("label"),
        F.when(F.col("split").endswith("_hard"), "hard").otherwise("standard").alias("difficulty_level"), F.lit("human").alias("generation_path"), "split")


def variant_error(required: tuple[str, ...] = ("variant_text", "doc_id", "year", "para_type", "chapter_role", "variant_type")) -> Column:
    """Why a variant is no training row; null where it is one."""
    blank = [F.col(f).isNull() | ((F.col(f).cast("string") == "") if f != "year" else F.lit(False)) for f in required]
    missing = F.array_compact(F.array(*(F.when(b, F.lit(f)) for b, f in zip(blank, required))))
    return (
        F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ",")))
        .when(F.col("year") == 0, "year=0")
        .when(F.length("variant_text") < 50, F.concat(F.lit("short "), F.length("variant_text").cast("string")))
    )


def variant_rows(variants: DataFrame) -> DataFrame:
    """Training rows of label 1."""
    v = variants.where(variant_error().isNull())
    return v.select(
        F.col("variant_text").alias("text"), "doc_id", F.lit(-1).alias("para_index"), "year", "para_type", "chapter_role", F.lit(1).alias("label"),
        F.when(F.col("variant_type") == "hard_human", "hard").otherwise("standard").alias("difficulty_level"), F.col("variant_type").alias("generation_path"), "split")


def variant_rows_by_name(variants: DataFrame) -> DataFrame:
    """The same with the matching by file name of older runs: rows of type hard_human also stand in the hard split of their split."""
    rows = variant_rows(variants)
    also = rows.where((F.col("generation_path") == "hard_human") & ~F.col("split").endswith("_hard")).withColumn("split", F.concat("split", F.lit("_hard")))
    return rows.unionByName(also)


def training_rows(paragraphs: DataFrame, variants: DataFrame) -> DataFrame:
    return human_rows(paragraphs).unionByName(variant_rows(variants))


def variant_breakdown(variants: DataFrame) -> DataFrame:
    e = variant_error()
    return variants.groupBy("split", "variant_type").agg(F.count("*").alias("total"), F.count_if(e.isNull()).alias("valid"), F.count_if(e.isNotNull()).alias("invalid"))


def totals(rows: DataFrame) -> DataFrame:
    """Counts by split and path, their subtotals and the total, with the share of the total."""
    g = rows.rollup("split", "generation_path").agg(F.count("*").alias("n"), F.sum("label").alias("positive"), F.grouping_id().alias("level"))
    whole = rows.agg(F.count("*").alias("whole"))
    return g.join(F.broadcast(whole)).select(  # one row
        F.when(F.col("level") == 3, "*").otherwise(F.coalesce("split", F.lit("?"))).alias("split"), F.when(F.col("level") >= 1, "*").otherwise(F.col("generation_path")).alias("generation_path"),
        "n", "positive", F.round(100.0 * F.col("n") / F.col("whole"), 6).alias("percent"))
