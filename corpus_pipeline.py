"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and works on all rows. All but the last return the columns of ``documents``, whatever other columns docs has; the last
returns the packed pieces. Null and empty texts are documents like others: the classifier judges them as empty, they are no one's near-duplicate, hold no item and
no personal data, and are packed as their end id. Null and repeated identifiers stay as they are: documents are told apart by identifier and text. Very long texts are
read whole. Ties and repeated rows: of rows with equal shingles one stays, with the smallest identifier, then the smallest hash of its text. An empty table gives an empty
table at each stage. A stage that begins deletes the scratch tables of the pipeline's stage before it, whose result is written by then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, decontaminate, jaccard, packing, pii, quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_left: list[str] = []


def _stage(spark: SparkSession, build) -> DataFrame:
    """What ``build`` returns; its scratch tables go when the next stage begins."""
    common.release(spark, _left)
    before = set(common.made())
    out = build()
    _left[:] = [p for p in common.made() if p not in before]
    return out


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: rows by their own text, source and lang, so a repeated identifier is judged row by row."""
    return _stage(spark, lambda: quality.accepted(docs.select(*COLUMNS), common.table(spark, sf_dir, "labels")))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays; blank texts are classes of their own."""
    return _stage(spark, lambda: jaccard.deduplicated(docs.select(*COLUMNS)))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go; others with the same identifier stay."""
    return _stage(spark, lambda: decontaminate.clean(docs.select(*COLUMNS), common.table(spark, sf_dir, "benchmark")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind, and terms that reveal it are removed or generalised; n_chars follows. A null text stays null."""

    def build() -> DataFrame:
        out = pii.sanitised(docs.select(*COLUMNS))
        return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)

    return _stage(spark, build)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become packed sequences of token ids; each row is packed for itself."""
    return _stage(spark, lambda: packing.pack(spark, docs))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", personal_data),
    ("packing", pack),
]

#: Fitted weights, similarity classes and token ids aren't within SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = common.table(spark, sf_dir, "documents")
    root = common.scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        out.write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
