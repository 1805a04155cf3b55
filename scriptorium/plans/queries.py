"""Queries of the core operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import patterns as P
from scriptorium.functions.text import count_of, distinct_chars, lines, newlines, r6, ratio, strip  # noqa: F401
from scriptorium.operators import cleaning, evaluation, features, fusion, metadata, quality_control, segmentation, splitting, training, variants
from scriptorium.runtime import table
from scriptorium.sources import documents, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", newlines(F.coalesce("text", F.lit(""))).alias("text"))


def paras(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "paragraphs").withColumn("t", F.coalesce("text", F.lit("")))


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in cols})


def probs(spark: SparkSession, d: str) -> DataFrame:
    """Probabilities made from row numbers: every model triggers somewhere, and somewhere none does."""
    p = table(spark, d, "paragraphs").select("row_id", "doc_id", "para_index")
    return p.withColumns({k: F.expr(f"((row_id * {a} + para_index * {b}) % 101) / CAST(100 AS DOUBLE)") for k, a, b in zip(P.MODELS, (37, 53, 71, 29, 83), (11, 7, 13, 17, 19))})


def scored(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "paragraphs").where("split IS NOT NULL").select("row_id", "split", F.explode(F.array(*(F.lit(k) for k in ("gbdt", "rf", "lr")))).alias("model"))
    y = F.expr("CASE WHEN row_id % 3 = 0 THEN 1 ELSE 0 END")
    p = F.expr("((CASE WHEN row_id % 3 = 0 THEN 30 ELSE 0 END) + (row_id * CASE model WHEN 'gbdt' THEN 37 WHEN 'rf' THEN 53 ELSE 29 END) % 71) / CAST(100 AS DOUBLE)")
    return s.select("model", "split", F.expr("CASE WHEN row_id % 2 = 0 THEN 'hard' ELSE 'standard' END").alias("difficulty"), y.alias("y"), p.alias("p")).withColumn("pred", (F.col("p") > 0.5).cast("int"))


def metadata_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents_metadata")


def hard(spark: SparkSession, d: str) -> DataFrame:
    return splitting.hard_samples(table(spark, d, "paragraphs").where("split IS NOT NULL").select("row_id", "doc_id", "split", "char_count", "has_citation", "has_formula", "chapter_role", "para_type"))


def fixed(spark: SparkSession, d: str) -> DataFrame:
    return splitting.repaired_years(table(spark, d, "variants"), metadata_of(spark, d))


@query
def flagship_stats_by_role(spark, d):
    p = paras(spark, d).select("chapter_role", F.length("t").alias("n"), *(ratio(count_of(F.col("t"), x), F.length("t")).alias(k) for k, x in (("c", P.HAN), ("g", P.DIGIT), ("k", "[，,]"))))
    return p.groupBy("chapter_role").agg(F.count("*").alias("paragraphs"), F.sum("n").alias("chars"), r6(F.avg("c")).alias("chinese_ratio"), r6(F.avg("g")).alias("digit_ratio"), r6(F.avg("k")).alias("comma_ratio"))


def _cleaning(name: str, f) -> None:
    QUERIES[name] = lambda spark, d: docs(spark, d).select("doc_id", f(F.col("text")).alias("cleaned"))


_cleaning("cl1_page_furniture", cleaning.drop_page_furniture)
_cleaning("cl2a_spaced_letters", cleaning.merge_spaced_letters)
_cleaning("cl2b_script_gaps", cleaning.close_script_gaps)
_cleaning("cl3_garbled_chars", cleaning.fix_garbled)
_cleaning("cl4_extra_spaces", cleaning.squeeze_spaces)


@query
def cl5_clean(spark, d):
    return cleaning.clean(docs(spark, d)).select("doc_id", "cleaned", F.array_join("fixes_applied", "|").alias("fixes_applied"))


def _measure(name: str, f, out: str) -> None:
    QUERIES[name] = lambda spark, d: docs(spark, d).select("doc_id", f(F.col("text")).alias(out))


_measure("q1_chinese_ratio", lambda c: r6(quality_control.chinese_ratio(c)), "chinese_ratio")
_measure("q2_garbled_ratio", lambda c: r6(quality_control.garbled_ratio(c)), "garbled_ratio")
_measure("q3_chapter_structure", quality_control.has_chapters, "has_chapter_structure")
_measure("q4_valid_ending", quality_control.has_ending, "has_valid_ending")
_measure("q6_dirty", lambda c: quality_control.needs_model_fix(c, quality_control.garbled_ratio(c)), "needs_model_fix")
_measure("sg1_headers", lambda c: F.size(F.filter(lines(c), segmentation.is_header)).cast("bigint"), "headers")
_measure("sg11_scoring_paragraphs", lambda c: F.array_join(segmentation.split_for_scoring(c), "\u241e"), "paragraphs")
_measure("md1_paper_hash", metadata.paper_hash, "paper_hash")
_measure("md3_title", metadata.title, "title")
_measure("md4_school", metadata.school, "school")
_measure("md5_major", metadata.major, "major")
_measure("md6_author", metadata.author, "author")
_measure("md7_chapter_count", lambda c: metadata.chapter_count(c).cast("bigint"), "chapter_count")


@query
def q5_paragraph_kind(spark, d):
    return paras(spark, d).select("row_id", quality_control.paragraph_kind(F.col("t")).alias("kind"))


@query
def q7_check(spark, d):
    c = quality_control.check(docs(spark, d))
    return rounded(c.select("doc_id", F.col("char_count").cast("bigint").alias("char_count"), "chinese_ratio", "garbled_ratio", "has_chapter_structure", "has_valid_ending", F.array_join(F.transform("issues", lambda x: x["desc"]), "|").alias("issues"), "needs_model_fix", "status"), "chinese_ratio", "garbled_ratio")


@query
def q8_process(spark, d):
    r = quality_control.process(table(spark, d, "documents").select("doc_id", newlines(F.col("text")).alias("text")))
    r = r.select("doc_id", "cleaned", F.array_join("fixes_applied", "|").alias("fixes_applied"), F.col("char_count").cast("bigint").alias("char_count"), "chinese_ratio", "garbled_ratio", "has_chapter_structure", "has_valid_ending", F.array_join(F.transform("issues", lambda x: x["desc"]), "|").alias("issues"), "needs_model_fix", "status")
    return rounded(r, "chinese_ratio", "garbled_ratio")


@query
def q9_summary(spark, d):
    return quality_control.summary(quality_control.process(table(spark, d, "documents").select("doc_id", newlines(F.col("text")).alias("text"))))


@query
def sg2_dropped(spark, d):
    return paras(spark, d).select("row_id", segmentation.is_dropped(F.col("t")).alias("dropped"))


@query
def sg3_paragraph_type(spark, d):
    return paras(spark, d).select("row_id", segmentation.paragraph_type(F.col("t")).alias("para_type"))


@query
def sg4_chapter_role(spark, d):
    return table(spark, d, "paragraphs").select("row_id", segmentation.chapter_role(F.coalesce("chapter", F.lit(""))).alias("chapter_role"))


@query
def sg5_flags(spark, d):
    t = F.col("t")
    s = segmentation
    return paras(spark, d).select("row_id", s.has_citation(t).alias("has_citation"), s.has_formula(t).alias("has_formula"), s.has_table_ref(t).alias("has_table_ref"), s.has_figure_ref(t).alias("has_figure_ref"))


@query
def sg6_sentences(spark, d):
    return paras(spark, d).select("row_id", segmentation.sentence_count(F.col("t")).cast("bigint").alias("sentence_count"))


@query
def sg7_segment(spark, d):
    return segmentation.segment(docs(spark, d))


@query
def sg8_word_count(spark, d):
    return paras(spark, d).select("row_id", count_of(F.col("t"), P.HAN).cast("bigint").alias("word_count"))


@query
def sg9_usable_lengths(spark, d):
    return segmentation.keep_lengths(segmentation.segment(docs(spark, d))).select("doc_id", "para_index", "char_count")


@query
def sg10_distributions(spark, d):
    return segmentation.distributions(table(spark, d, "paragraphs"))


@query
def md2_year_of_path(spark, d):
    return metadata_of(spark, d).select("source_path", metadata.year_of_path(F.col("source_path")).alias("year")).distinct()


@query
def md8_assemble(spark, d):
    x = table(spark, d, "documents").select("doc_id", newlines(F.coalesce("text", F.lit(""))).alias("text"), F.concat(F.lit("/corpus/"), F.col("year").cast("string"), F.lit("/x/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    return metadata.extract(x).withColumn("missing_fields", F.array_join("missing_fields", ",")).withColumn("chapter_count", F.col("chapter_count").cast("bigint")).withColumn("char_count", F.col("char_count").cast("bigint"))


@query
def md9_paragraph_counts(spark, d):
    return metadata_of(spark, d).select("doc_id").distinct().join(metadata.paragraph_counts(table(spark, d, "paragraphs")), "doc_id")


@query
def md10_completeness(spark, d):
    return metadata.completeness(metadata_of(spark, d))


@query
def md10_missing_fields(spark, d):
    return metadata.missing_by_field(metadata_of(spark, d))


@query
def src12_parent_year(spark, d):
    return metadata_of(spark, d).select("source_path", metadata.year_of_parent(F.col("source_path")).alias("year")).distinct()


@query
def src13_stem(spark, d):
    return metadata_of(spark, d).select("source_path", metadata.stem(F.col("source_path")).alias("doc_id")).distinct()


@query
def snk2_report_rows(spark, d):
    r = sinks.report_rows(quality_control.process(docs(spark, d)))
    return r.select("doc_id", "status", F.col("char_count").cast("bigint").alias("char_count"), "chinese_ratio", "garbled_ratio", "has_chapter_structure", "has_valid_ending", F.size("issues").cast("bigint").alias("issues"), F.array_join("fixes_applied", "|").alias("fixes_applied"), "needs_model_fix")


@query
def snk4_key_mapping(spark, d):
    return sinks.key_mapping(metadata_of(spark, d))


@query
def sp1_documents_by_year(spark, d):
    return metadata_of(spark, d).where((F.col("year") > 0) & (F.coalesce("doc_id", F.lit("")) != "")).groupBy("year").agg(F.countDistinct("doc_id").alias("documents"))


@query
def sp2_documents_by_split(spark, d):
    return splitting.documents_by_split(metadata_of(spark, d))


@query
def sp3_paragraphs_in_split(spark, d):
    return splitting.paragraphs_in_split(table(spark, d, "paragraphs"), splitting.documents_by_split(metadata_of(spark, d)), "dev").select("row_id")


@query
def sp4_hardness(spark, d):
    return splitting.scored(table(spark, d, "paragraphs")).select("row_id", "score")


@query
def sp5_sp7_hard_samples(spark, d):
    return hard(spark, d).select("row_id", "split", "score", "hard")


@query
def sp8_statistics(spark, d):
    return splitting.split_statistics(hard(spark, d))


@query
def sp9_split_index(spark, d):
    return splitting.split_index(splitting.documents_by_split(metadata_of(spark, d)))


@query
def sp10_hard_index(spark, d):
    return splitting.hard_index(hard(spark, d))


@query
def fx1_split_of_year(spark, d):
    return table(spark, d, "variants").select("row_id", splitting.split_of_year(F.col("year")).alias("split"))


@query
def fx2_repaired_years(spark, d):
    return fixed(spark, d).select("row_id", "year", "updated")


@query
def fx3_misplaced(spark, d):
    return splitting.misplaced(fixed(spark, d)).select("row_id", "target_split", "misplaced")


@query
def fx4_moved(spark, d):
    return splitting.moved(fixed(spark, d)).select("row_id", "final_split")


@query
def fx5_validation(spark, d):
    return splitting.validation_errors(table(spark, d, "variants")).select("row_id", F.array_join("errors", "|").alias("errors"))


@query
def fx6_year_histogram(spark, d):
    return splitting.year_histogram(table(spark, d, "variants"))


@query
def vg1_eligible(spark, d):
    return variants.eligible(table(spark, d, "paragraphs")).select("row_id")


@query
def vg2_unprocessed(spark, d):
    return variants.unprocessed(variants.eligible(table(spark, d, "paragraphs")), table(spark, d, "variants")).select("row_id")


def _targets(spark: SparkSession) -> DataFrame:
    return variants.fan_out(spark)


@query
def vg3_quota(spark, d):
    have = table(spark, d, "variants").groupBy("split", "variant_type").agg(F.count("*").alias("have"))
    return variants.quota(variants.eligible(table(spark, d, "paragraphs")), have, _targets(spark)).select("row_id", "split", "variant_type")


@query
def vg4_prompts(spark, d):
    return table(spark, d, "variants").select("row_id", variants.prompt(F.col("original_text"), F.col("variant_type")).alias("prompt"), variants.temperature(F.col("variant_type")).alias("temperature"))


@query
def vg5_vg6_generate(spark, d):
    return variants.generate(vg4_prompts(spark, d).where("prompt IS NOT NULL")).select("row_id", "answer", "ok", "status", "provider")


@query
def vg9_fan_out(spark, d):
    return _targets(spark)


@query
def vg10_progress(spark, d):
    return variants.progress(_targets(spark), table(spark, d, "variants"))


@query
def fv1_online_features(spark, d):
    f = features.with_online(table(spark, d, "paragraphs").select("row_id", "text")).drop("text")
    return rounded(f, *(c for c in features.ONLINE if c != "paragraph_length")).withColumn("paragraph_length", F.col("paragraph_length").cast("bigint"))


@query
def fv2_training_features(spark, d):
    f = features.with_training(table(spark, d, "paragraphs").select("row_id", "text")).drop("text")
    f = rounded(f, "chinese_ratio", "english_ratio", "digit_ratio", "vocab_diversity", "avg_sentence_length")
    return f.withColumns({c: F.col(c).cast("bigint") for c in ("char_count", "sentence_count", "comma_count", "period_count", "semicolon_count", "colon_count")})


@query
def emb1_embeddings(spark, d):
    return features.embed(table(spark, d, "paragraphs").select("row_id", "text"))


@query
def emb3_emb4_combine(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), F.array(F.col("vec_id").cast("double"), F.col("label").cast("double"), F.lit(3.0)).alias("s"))
    c = e.withColumn("online", features.combine(F.col("s"), F.col("e"), online=True)).withColumn("training", features.combine(F.col("s"), F.col("e"), online=False)).withColumn("tail", features.embedding_part(F.col("online"), 64))
    joined = lambda x: F.array_join(F.transform(x, lambda v: F.round(v * 1000).cast("bigint").cast("string")), ",")
    return c.select("vec_id", joined("online").alias("online"), joined("training").alias("training"), joined("tail").alias("tail"))


@query
def fe1_human_rows(spark, d):
    return features.human_rows(table(spark, d, "paragraphs"))


@query
def fe2_variant_errors(spark, d):
    return table(spark, d, "variants").select("row_id", features.variant_error().alias("error"))


@query
def fe3_variant_rows(spark, d):
    return features.variant_rows(table(spark, d, "variants"))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return features.training_rows(table(spark, d, "paragraphs"), table(spark, d, "variants"))


@query
def fe4_training_rows(spark, d):
    return _rows(spark, d).groupBy("label", "difficulty_level", "generation_path", "split").agg(F.count("*").alias("n"))


@query
def fe5_variant_breakdown(spark, d):
    return features.variant_breakdown(table(spark, d, "variants"))


@query
def fe6_totals(spark, d):
    return features.totals(_rows(spark, d))


@query
def fu2_fuse(spark, d):
    return fusion.fuse(probs(spark, d)).select("row_id", "is_ai", "confidence", "triggered_by", F.size("all_model_probs").cast("bigint").alias("evaluated"))


@query
def fu3_fused_probability(spark, d):
    return fusion.fuse(probs(spark, d)).select("row_id", F.col("confidence").alias("first_trigger"), "max_prob")


@query
def fu5_descriptors(spark, d):
    return fusion.model_descriptors(spark, dict(zip(P.MODELS, (5, 10, 15, 20, 768))))


@query
def fu6_explanations(spark, d):
    f = fusion.fuse(probs(spark, d))
    return f.select("row_id", fusion.explain(f).alias("explanation"))


@query
def fu7_paragraph_risk(spark, d):
    return fusion.fuse(probs(spark, d)).select("row_id", fusion.paragraph_risk(F.col("confidence")).alias("risk"))


@query
def fu8_document_scores(spark, d):
    s = fusion.document_scores(fusion.fuse(probs(spark, d)), metadata_of(spark, d))
    return rounded(s.select("doc_id", "doc_ai_score", "n", "high_risk_count", "medium_risk_count", "low_risk_count", "high_share"), "doc_ai_score", "high_share")


@query
def fu8_paragraph_list(spark, d):
    x = fusion.paragraph_list(fusion.fuse(probs(spark, d)), first=20)
    return x.select("doc_id", F.size("paragraphs").cast("bigint").alias("shown"), F.get("paragraphs", F.lit(0))["paragraph_id"].cast("bigint").alias("first_id"))


@query
def ca1_fuse_calibrated(spark, d):
    return rounded(fusion.fuse_calibrated(probs(spark, d)).select("row_id", "is_ai", "raw_probability", "calibrated_score", "triggered_by"), "calibrated_score")


@query
def ca2_document_scores(spark, d):
    return rounded(fusion.document_scores_calibrated(fusion.fuse_calibrated(probs(spark, d))), "doc_calibrated_score", "doc_raw_score", "ai_ratio")


@query
def ca3_report_lines(spark, d):
    s = fusion.document_scores_calibrated(fusion.fuse_calibrated(probs(spark, d)))
    return s.select("doc_id", fusion.report_line().alias("line"), fusion.report_text().alias("report"))


@query
def snk10_detection_json(spark, d):
    f = fusion.fuse(probs(spark, d))
    j = sinks.detection_json(fusion.document_scores(f), fusion.paragraph_list(f, first=20)).withColumn("x", F.from_json("json", "doc_ai_score double, n bigint, high_risk_count bigint, paragraphs array<struct<paragraph_id:bigint,is_ai:boolean,confidence:double,triggered_by:string,risk_level:string>>"))
    listed = F.array_join(F.transform("x.paragraphs", lambda p: F.concat_ws(":", p["paragraph_id"].cast("string"), p["triggered_by"], p["risk_level"])), ",")
    return j.select("doc_id", r6(F.col("x.doc_ai_score")).alias("score"), F.col("x.n").alias("n"), F.col("x.high_risk_count").alias("high"), F.size("x.paragraphs").cast("bigint").alias("shown"), listed.alias("paragraphs"))


KEYS = ["model", "split"]


@query
def ev1_metrics(spark, d):
    return rounded(evaluation.metrics(scored(spark, d), KEYS), "precision", "recall", "f1", "accuracy", "macro_f1", "uncertain_ratio")


@query
def tr2_train_time(spark, d):
    return rounded(training.train_time_metrics(scored(spark, d), KEYS), "precision", "recall", "f1", "auc", "hard_auc")


@query
def ev7_evaluation(spark, d):
    """The driver over models and splits on given probabilities: results, and an error for the model that fails."""
    rows = scored(spark, d).select("split", F.col("difficulty").alias("difficulty_level"), F.col("y").alias("label"), "model", "p", "pred")
    scorers = {k: (lambda x, k=k: x.where(F.col("model") == k)) for k in ("gbdt", "rf", "lr")} | {"broken": lambda x: x.withColumn("p", F.raise_error(F.lit("no model")).cast("double"))}
    r = evaluation.run(rows, scorers)[0]
    return rounded(r, "f1", "precision", "recall", "auc", "hard_auc", "uncertain_ratio").fillna(0, ["total_samples"]).select("model", "split", "total_samples", "precision", "recall", "f1", "auc", "hard_auc", "uncertain_ratio", F.col("error").isNotNull().alias("failed"))


@query
def snk5_split_index(spark, d):
    h = hard(spark, d)
    return h.select("doc_id", "split").distinct().unionByName(splitting.hard_index(h.where("split <> 'train'")))


@query
def snk7_src11_feature_rows(spark, d):
    """Feature rows in three layouts read as one: combined, in two parts, and old ones with six loose numbers."""
    e = table(spark, d, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 4).alias("e"), (F.col("label") % 2).alias("label"))
    k = F.col("vec_id") % 3
    none = F.lit(None).cast("array<double>")
    x = e.select(
        F.when(k == 0, F.concat("e", F.array(F.lit(1.0)))).otherwise(none).alias("combined_features"), F.when(k > 0, F.col("e")).otherwise(none).alias("bert_features"), F.when(k == 1, F.array(F.lit(2.0), F.lit(3.0))).otherwise(none).alias("stat_features"),
        F.col("vec_id").cast("double").alias("char_count"), F.lit(4.0).alias("period_count"), "label", F.col("vec_id").cast("string").alias("split"))
    r = documents.feature_rows(x)
    return r.select(F.col("split").cast("bigint").alias("vec_id"), F.array_join(F.transform("features", lambda v: F.round(v * 1000).cast("bigint").cast("string")), ",").alias("features"), "label", "difficulty_level", "generation_path")


@query
def vg6_run_statistics(spark, d):
    refuses = lambda prompt_text, temp: (False, "HTTP 500", 500) if len(prompt_text) % 2 else variants.offline_client(prompt_text, temp)
    return variants.run_statistics(variants.generate(vg4_prompts(spark, d).where("prompt IS NOT NULL"), client=refuses)).select("provider", "calls", "ok", "failed")


@query
def vg10_overall(spark, d):
    return variants.overall(vg10_progress(spark, d), 600.0)


@query
def ev2_auc(spark, d):
    return rounded(evaluation.auc(scored(spark, d), KEYS), "auc")


@query
def ev3_confusion(spark, d):
    return evaluation.confusion(scored(spark, d), KEYS)


@query
def ev4_by_difficulty(spark, d):
    return rounded(evaluation.by_difficulty(scored(spark, d), KEYS), "standard_auc", "hard_auc", "hard_precision", "hard_recall", "hard_precision_true")


@query
def ev6_overfit_risk(spark, d):
    return rounded(evaluation.overfit_risk(evaluation.metrics(scored(spark, d), KEYS)), "gap")


@query
def tr3_best_model(spark, d):
    return rounded(evaluation.best_model(evaluation.metrics(scored(spark, d), KEYS)), "f1")


@query
def ev8_summary(spark, d):
    return evaluation.metrics(scored(spark, d), KEYS).select(evaluation.summary_line().alias("line"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("features"), (F.col("label") < 5).cast("int").alias("label"))


@query
def tr1_logistic(spark, d):
    v = _vectors(spark, d)
    return training.score(training.fit(v, "lr"), v).select("vec_id", "label", r6(F.col("p")).alias("p"), "pred")


@query
def tr1_forest(spark, d):
    v = _vectors(spark, d)
    return training.score(training.fit(v, "rf"), v).select("vec_id", "label", r6(F.col("p")).alias("p"), "pred")


@query
def tr1_boosted(spark, d):
    v = _vectors(spark, d)
    return training.score(training.fit(v, "gbdt"), v).select("vec_id", "label", r6(F.col("p")).alias("p"), "pred")


@query
def tr4_fusion_trees(spark, d):
    v = _vectors(spark, d)
    specs = {k: training.tree_spec(training.fit_tree(v, k)) for k in P.MODELS}
    return fusion.fuse(training.score_trees(v, specs)).select("vec_id", "label", *P.MODELS, "is_ai", "triggered_by")
