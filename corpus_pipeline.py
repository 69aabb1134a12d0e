"""The corpus pipeline over the documents table: five stages, each written as Parquet and reread as the next one's input.

Quality rules (documents that they reject go), exact dedup, near-dedup by 5-word shingles (one document of each group stays), the
mix of sources to target weights (a document appears as often as the mix takes it, to whole passes), and packing, whose
rows are pieces of documents in sequences. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm.exact_dedup import deduplicated
from seqloom.llm.mixing import mixed_documents
from seqloom.llm.near_copies import one_of_each
from seqloom.llm.packing import pack
from seqloom.llm.quality_rules import kept_documents
from seqloom.llm.queries import tokenizer_path
from seqloom.llm.shared import documents, fresh_path
from seqloom.session import delete, scratch, ship_package


#: Rows of whole texts that Python gets at a time: at Spark's 10,000 a batch of documents is some 20 MB, held several times over
#: by each task in the JVM's direct memory and in its worker.
BATCH_ROWS = 1024
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def with_python(spark: SparkSession) -> None:
    """Ship the package, and bound the batches that go to Python for the rest of the session."""
    ship_package(spark)
    given = int(spark.conf.get(_BATCH))
    if given <= 0 or given > BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with_python(spark)
    return deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with_python(spark)
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with_python(spark)
    return pack(docs, tokenizer_path())


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixing), ("packing", packing)]

#: SQL has no counterpart to the groups of near copies, the linear program and the token ids; tests/llm/test_pipeline.py holds
#: the rows of all stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole documents table.

    What a stage writes for itself is deleted once its result is written, and that once the next stage has read it.
    """
    docs, before = documents(spark, sf_dir), []
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name}")
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        delete(spark, before)
        docs, before = spark.read.schema(out.schema).parquet(path), [path]
    packed = STAGES[-1][1](spark, docs, sf_dir)  # has cut all documents into pieces, which it alone reads from now on
    delete(spark, before)
    return packed
