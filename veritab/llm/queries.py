"""The operators applied to their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's words without repeats of 20 words and more, as counts and a digest."""
    from .substrings import remove_repeats

    out = remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's log10 probability by a Katz model of the others, and by the base model."""
    from .katz import score

    return score(_table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's ids, and the bytes that they decode to, as digests."""
    import public_tokenizers

    from .bpe import encode_decode

    out = encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's component of similar ones."""
    from .jaccard import similar_sets

    return similar_sets(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    from .mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's main language, by models of the labelled ones that aren't held out."""
    from .language import held_out, identify, train

    docs = _table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out(3, 1)))
    return identify(docs, model).select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's main text."""
    from .pages import extract_main_text

    return extract_main_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's personal data: base matches counted and digested, and all spans."""
    from .pii import KINDS, find_personal_data, joined

    out = find_personal_data(_table(spark, sf_dir, "documents"))

    def of_kind(kind: str):
        return lambda s: s["kind"] == kind

    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's measures, the base rules' verdict and the table's."""
    from .quality import quality_rules

    out = quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of each hundredth one."""
    from .neighbours import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of corpus_pipeline.run()."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    named = (op1_substring_dedup, op2_lm_scoring, op3_bpe, op4_jaccard_join, op5_mixing, op6_language, op7_html_extraction, op8_pii, op9_quality_rules, op10_nearest)
    return {f.__name__: f for f in named} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
