"""A corpus pipeline of five stages over documents; each is written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm._packed import WORD_PATTERN, discard, made, shared_dir
from veritab.llm.bpe import encode_decode
from veritab.llm.jaccard import similar_sets
from veritab.llm.mixing import mix_sources, take
from veritab.llm.pii import find_personal_data, sanitised
from veritab.llm.quality import good_texts


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return good_texts(docs)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: the one with the smallest id (null last), then the smallest hash of its text. Of rows equal in id and text one stays. Documents without words are in no group and stay."""
    groups = similar_sets(docs).select("doc_id", "text_key", "component_key")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key"))
    kept = groups.filter("component_key is not null").groupBy("component_key").agg(first.alias("f")).select(F.col("f.doc_id").alias("__id"), F.col("f.text_key").alias("__text"))
    keyed = docs.withColumn("__key", F.xxhash64(F.col("text").cast("string")))
    worded = F.coalesce(F.col("text").rlike(WORD_PATTERN), F.lit(False))
    rest = keyed.filter(~worded).drop("__key")
    named = keyed.filter(worded).join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__text")), "left_semi")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = F.min(F.struct("text", *others))
    one = named.groupBy("doc_id", "__key").agg(row.alias("__row")).select(*[F.col("doc_id") if c == "doc_id" else F.col(f"__row.{c}") for c in docs.columns])
    return one.unionByName(rest)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data generalised to its kind."""
    out = find_personal_data(docs).withColumn("text", sanitised(F.col("text"), F.col("spans")))
    return out.select([F.length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return take(docs, mix_sources(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of each text."""
    import public_tokenizers

    return encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids")


STAGES = [("quality rules", rules), ("n-gram Jaccard join", unique), ("personal data", private), ("mixing sources", mixed), ("byte-level BPE", tokens)]

#: Pivotal rounding draws by hashes of this engine, and BPE has no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what a stage has written for itself goes once the next one's documents are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before = made()
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = shared_dir(spark)
            docs.write.parquet(path)
            discard(spark, before, keep=(path,))
            docs = spark.read.parquet(path)
    return docs
