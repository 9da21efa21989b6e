"""The ten training-data operators as registered queries over their whole tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, mixing, ngram_join, perspectives, pseudonyms, quality, suffix_dedup, token_files, transport, url_lists
from .common import table
from .ngram_join import near_duplicates


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The path of a public tokenizer's file, which is never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.perspectives(table(spark, sf_dir, "conversations"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    out = quality.scored(docs, model)
    return out.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymize(table(spark, sf_dir, "documents"), key=spark.conf.get("spark.lodestone.pseudonyms.key", "a key for tests, not a secret"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op7_media_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport.features(transport.write_units(transport.write_media(table(spark, sf_dir, "documents")))).drop("units")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_digests(token_files.write_shards(table(spark, sf_dir, "documents"), vocabulary()))


def op10_url_list_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = url_lists.evaluate(url_lists.dated_captures(pages), url_lists.sample_events(pages))
    return out.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("fetched", "entry", "list", "valid_from")})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_chat_perspectives, op2_ngram_jaccard_join, op3_quality_classifier, op4_pii_pseudonyms, op5_mix_sources, op6_suffix_array_dedup, op7_media_transport_streams, op8_benchmark_decontamination, op9_token_files, op10_url_list_join)
}

ORACLES: dict[str, str] = {"op2_ngram_jaccard_join": ngram_join.SQL, "op5_mix_sources": mixing.SQL, "op8_benchmark_decontamination": decontaminate.SQL, "op1_chat_perspectives": perspectives.SQL, "op10_url_list_join": url_lists.SQL}
