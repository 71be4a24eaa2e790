"""The queries of this subpackage for the driver: thin wrappers that derive the contracted columns from each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, sha256_of, table


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def tokenizer() -> tuple[bytes, str]:
    """The rank file and pattern of the tokenizer that the queries use."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return file.read(), public_tokenizers.PATTERN


def op1_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings, as melodies of 64 notes: no table holds sound."""
    from .chroma import matched, sonify

    found = matched(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, sonify, "vec_id", "embedding")
    return found.select(F.col("clip_id").alias("vec_id"), F.size("frames").cast("long").alias("n_frames"), F.sha2(F.array_join("frames", ","), 256).alias("frames_sha256"), "class_id", "n_links", "best_query", "offset", F.round("bit_error", 6).alias("bit_error"))


def op2_rlz_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rlz import deduplicate

    found = deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", sha256_of(F.col("kept_text")).alias("kept_sha256"), F.size("spans").cast("long").alias("n_spans"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    from .bpe import round_trip

    coded = round_trip(docs.select("doc_id", "text"), *tokenizer())
    return coded.select("doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, is_held_out, scored

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minmax import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op6_oph_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import edit_study

    return edit_study(table(spark, sf_dir, "documents"))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive

    return archive(table(spark, sf_dir, "pages"), new_path(spark, "warc"))


def op8_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import deduplicate_lines

    found = deduplicate_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", sha256_of(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


def op10_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, find_spans, written

    found = find_spans(table(spark, sf_dir, "documents"))
    def count(kind: int):  # a lambda with a default would be taken for one of element and index
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, sha256_of(written(F.col("base"))).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        found = pack(table(spark, sf_dir, "documents"), file.read())
    return found.select("doc_id", "start", (F.octet_length("token_ids") / 4).cast("long").alias("length"), F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_chroma_fingerprints, op2_rlz_substrings, op3_byte_bpe, op4_toxicity, op5_minmax_near_duplicates, op6_oph_fingerprints, op7_warc_revisits, op8_line_edit_join, op9_source_mix, op10_pii_spans, op11_filter_interactions, op12_bounded_packing, op13_phrase_collocations)}
