"""A corpus pipeline: classify, drop copies, drop near copies, mix, encode.

Each stage takes the documents that its predecessor kept and returns documents;
the last returns one row of token digests for each of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomfill.llm.bpe import round_trip, vocabulary
from loomfill.llm.common import table, written
from loomfill.llm.exact_dedup import drop_copies
from loomfill.llm.jaccard import keep_first
from loomfill.llm.mixing import in_order, mix
from loomfill.llm.quality import keep_good


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones; null and empty texts go by the model's bias.

    Null and repeated ids are scored like all others, by their own text. Repeated
    rows stay or go together; texts of any length are scored whole. An empty
    table stays empty, and further columns pass through under any name.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null: empty), one row with the largest id; a null id ranks last.

    Of repeated rows one stays. Whole texts are compared. An empty table stays
    empty, and further columns pass through under any name.
    """
    return drop_copies(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 or more of their runs of five words, one row with the smallest id.

    Null and blank texts link with nothing and stay; a null id ranks last, and
    of repeated rows one stays. Whole texts count. An empty table stays empty,
    and further columns pass through under any name.
    """
    return keep_first(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the shards of the mix draw them, by shard and in each shard's shuffled order.

    Null sources form a source of their own; texts without words are drawn with
    their block. Repeated rows are drawn alike. An empty table stays empty, and
    further columns pass through, but for ``mix_shard`` and ``mix_position``.
    """
    return in_order(mix(docs)).select(*docs.columns)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of every document, one row for each draw; null texts have no tokens.

    Whole texts are encoded; ids may be null or repeated. An empty table gives
    an empty result, and further columns are not read.
    """
    return round_trip(docs, *vocabulary())


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("mixing sources to target weights", mixing),
    ("byte-level BPE encoding and decoding", byte_level_bpe),
]

#: SQL can express neither the classifier nor the encoder; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
