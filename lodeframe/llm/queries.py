"""Queries of this subpackage: the operators with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm.exact_dedup import exact_duplicates
from lodeframe.llm.fill_middle import fill_in_middle
from lodeframe.llm.html_extract import extract_main_text
from lodeframe.llm.language import languages_of
from lodeframe.llm.line_dedup import drop_template_lines
from lodeframe.llm.mixing import mix_sources
from lodeframe.llm.ngram_join import ngram_jaccard_components
from lodeframe.llm.packing import pack_documents
from lodeframe.llm.quality import quality_of
from lodeframe.llm.secret_scan import BASE_RULES, joined, scan_secrets
from lodeframe.llm.substring_dedup import remove_repeated_passages
from lodeframe.llm.token_alignment import align_tokens
from lodeframe.llm.topk import exact_topk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """A file of a public tokenizer (by default that of the packing query), looked up where the tokenizers are installed."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from labels that are not held out."""
    return quality_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes at 4-word shingles and a Jaccard similarity of 0.85."""
    return ngram_jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left after removing repeated passages of 20 words and more."""
    kept = remove_repeated_passages(table(spark, sf_dir, "documents"), window=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract_main_text(table(spark, sf_dir, "pages"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix by weights 1, 2, 3 takes of every document."""
    return mix_sources(table(spark, sf_dir, "documents"), weights=(1, 2, 3), most=3)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of texts that are equal but for white space."""
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from documents that are not held out."""
    return languages_of(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines left after dropping templates that recur in five documents and more."""
    kept = drop_template_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector."""
    return exact_topk(table(spark, sf_dir, "embeddings"), k=5, query_mod=50, scale=256)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids."""
    pieces = pack_documents(table(spark, sf_dir, "documents"), tokenizer_file(), capacity=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: counts and a digest of the base rules, and the spans of all rules."""
    found = scan_secrets(table(spark, sf_dir, "documents"))
    kinds = tuple(r.kind for r in BASE_RULES)
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(joined(kinds=kinds), 256).alias("base_sha256"), joined().alias("spans"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens of two tokenizers over all documents."""
    aligned = align_tokens(table(spark, sf_dir, "documents"), tokenizer_file(), tokenizer_file("piece_bpe_32k.model"))
    return aligned.drop("pairs", "times")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut in three and put together again."""
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_classifier, op2_ngram_jaccard_join, op3_substring_dedup, op4_html_extraction, op5_source_mixing, op6_exact_dedup, op7_language_id, op8_line_dedup, op9_exact_topk, op10_packing, op11_secret_scan, op12_token_alignment, op13_fill_in_middle, pipeline)
}
