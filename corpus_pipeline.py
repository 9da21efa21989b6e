"""A training corpus from raw documents: quality, near-duplicates, benchmark passages, mixing, token files.

Each stage takes all that the one before kept and its decision takes effect:
a rejected, copied or contaminated document is gone, a document that the mix
takes twice is there twice. Decisions are made in narrow tables that are
broadcast only if counted below a bound; texts stay where they are.

Rows are told apart by a key of their id and text and not by the id: null ids and
ids that repeat are decided row by row. Null and empty texts are documents
without words: they are scored, linked with nothing, never contaminated, and the
mix takes none. Rows equal in id and text are copies of each other. Empty tables
pass every stage as empty tables; further columns go along unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, mixing, ngram_join, quality, token_files
from lodestone.llm.common import small, store, table, text_key
from lodestone.llm.queries import vocabulary

KEY = "_row_key"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(KEY, text_key(F.col("doc_id"), F.col("text")))


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` but for the rows that have these keys."""
    gone = small(store(keys.select(F.col("key").alias(KEY)).distinct(), "dropped"))
    return docs.join(gone, KEY, "left_anti")


def _once(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """One row of all that share one of these keys, the least by all columns."""
    some = docs.join(small(keys.select(F.col("key").alias(KEY))), KEY, "left_semi")
    return some.groupBy(KEY).agg(F.min(F.struct(*[c for c in docs.columns if c != KEY])).alias("_row")).select("_row.*", KEY).select(*docs.columns)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of ``sf_dir``."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least id; of rows that share it, the least key.

    Null ids come after all others. Documents without words are in no group.
    """
    rows = store(ngram_join.near_duplicates(docs, keyed=True).where("comp is not null").groupBy("comp", "doc_id", "key").agg(F.count(F.lit(1)).alias("n")), "grouped")
    best = rows.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("best"), F.count(F.lit(1)).alias("kinds"))
    judged = rows.join(best.where("kinds > 1").select("comp", F.col("best.key").alias("kept")), "comp", "left")
    gone = store(judged.where("kept is not null and key != kept").select("key"), "gone")
    twice = store(judged.where("(kept is null or key = kept) and n > 1").select("key"), "twice")
    keyed = _keyed(docs)
    return _without(keyed, gone.unionByName(twice)).unionByName(_once(keyed, twice)).drop(KEY)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages don't contaminate; what holds for a text holds for all rows that have it."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), keyed=True).where("contaminated").select("key")
    keyed = docs.withColumn(KEY, F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)))
    return _without(keyed, found).drop(KEY)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; of equal rows, all together as often as it takes them."""
    taken = mixing.mix(docs, keyed=True).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("copies")).where("copies > 0")
    taken = store(taken.select("key", "n", F.floor(F.col("copies") / F.col("n")).alias("each"), (F.col("copies") % F.col("n")).alias("more")), "taken")
    keyed = _keyed(docs)

    def repeated(rows: DataFrame, times: str) -> DataFrame:
        counts = small(taken.where(f"{times} > 0").select(F.col("key").alias(KEY), F.col(times).alias("_times")))
        return rows.join(counts, KEY).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)

    return repeated(keyed, "each").unionByName(repeated(_once(keyed, taken.where("more > 0 and n > 1")), "more"))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digest of each document's ids as read back from the token shards; equal rows have one each."""
    return token_files.read_digests(token_files.write_shards(docs, vocabulary()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", deduplicate),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", tokenized),
]

#: SQL can't train the classifier; tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store(docs, "stage")
    return docs
