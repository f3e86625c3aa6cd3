"""The operators of this subpackage as queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm.centroids import cluster_vectors
from basketry.llm.codes import code_text, encode_vectors
from basketry.llm.decontaminate import find_leaks
from basketry.llm.extract import main_text
from basketry.llm.fingerprint import with_edits
from basketry.llm.langid import identify
from basketry.llm.lm import score_documents
from basketry.llm.minhash import near_duplicates
from basketry.llm.mixing import mix_sources
from basketry.llm.pieces import encode_texts
from basketry.llm.quality import quality_rules
from basketry.llm.suffixes import remove_repeats
from basketry.llm.urls import judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: where the vocabulary is on the driver; executors get its tables
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: the rules that the query holds URLs against
URL_RULES = {
    "org/": "allow",
    "example.org/es/": "block",
    "example.org/en/1": "block",
    "com/fr/": "allow",
    "com/de/": "block",
}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


@query
def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies among all documents."""
    return near_duplicates(documents(spark, sf_dir)).drop("group", "row")


@query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as pieces with merge dropout, and what they decode to."""
    return encode_texts(documents(spark, sf_dir), PIECE_MODEL)


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules over all documents, against references learned from all of them."""
    return quality_rules(documents(spark, sf_dir))


@query
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text(pages(spark, sf_dir))


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the labelled ones that are not held out."""
    return identify(documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score")


@query
def op6_gru_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document, by word counts and by a recurrent network."""
    return score_documents(documents(spark, sf_dir))


@query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document outside strings of 100 bytes that also start earlier."""
    return remove_repeats(documents(spark, sf_dir)).drop("kept_text", "row")


@query
def op8_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document, and how like those of its edited text and of the next document are."""
    return with_edits(documents(spark, sf_dir))


@query
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    mixed = mix_sources(documents(spark, sf_dir))
    return mixed.select(
        F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


@query
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return judge_urls(pages(spark, sf_dir), URL_RULES)


@query
def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside passages of the benchmark, and the items they come from."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_leaks(documents(spark, sf_dir), benchmark, keep=["doc_id"])
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as the nearest entries of four codebooks."""
    coded, books = encode_vectors(embeddings(spark, sf_dir))
    digest = books.digest() if books else None
    return coded.select(
        F.col("key").alias("vec_id"), code_text().alias("code"), "error", "label_error",
        F.lit(digest).cast("string").alias("codebooks_sha256"),
    )


@query
def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster after ten rounds."""
    return cluster_vectors(embeddings(spark, sf_dir)).drop("centroid").withColumnRenamed("key", "vec_id")
