"""The corpus pipeline: from raw documents to sampled token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of documents; each result is written as Parquet and read again before the next, and what the one
before read is removed.

Defined results of the stages: each row is decided by its own text, so null and repeated ids lose no row, and equal rows fare alike
but for near-dedup. Null and empty texts are scored by the classifier's bias, stay without lines, are near no
document, hold no item, and have no pieces. Texts are worked on whole, however long. An empty table gives an empty one.
Other columns are carried along, whatever their names; n_chars follows the text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontam, linedup, neardup, pieces, quality
from lectern.llm.core import shared_folder, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled ones among docs."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without multi-line chunks that occur earlier; n_chars is that of the new text."""
    names = docs.columns
    own = docs.toDF(*[n if n in ("doc_id", "text") else f"c{i}" for i, n in enumerate(names)])
    done = linedup.deduplicated(own).select(*own.columns).toDF(*names)
    return done.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in names else done


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return neardup.representatives(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids and lossless."""
    return pieces.tokenize(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("linedup", without_repeated_lines),
    ("neardup", without_near_duplicates),
    ("decontam", decontaminated),
    ("pieces", encoded),
]

#: Hash functions, the fitted model and the sampling have no SQL; tests/llm compare the line, near-dedup and decontamination stages with brute
#: force, the classifier's decisions with its own scores, and the pieces with their texts.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    """A table in the shared folder, whatever file system that is on."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; the tables between them go to the shared folder, where the last one's input stays."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{folder}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                _remove(spark, before)
            before = path
    return docs
