"""The vector table and stored extractions: upsert, delete, fetch, and writes that replace only what changed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ids
from . import versions


def stamped(incoming: DataFrame, space: str, model: str) -> DataFrame:
    """incoming rows as rows of the space; the model is stamped where absent."""
    stamp = F.coalesce(F.col("embedding_model"), F.lit(model)) if "embedding_model" in incoming.columns else F.lit(model)
    return incoming.withColumn("space", F.lit(space)).withColumn("embedding_model", stamp)


def upserted(vectors: DataFrame, incoming: DataFrame, space: str, model: str) -> DataFrame:
    """vectors with incoming rows in place of those of their ids in the space; the model is stamped where absent."""
    new = stamped(incoming, space, model)
    return vectors.join(new.select("space", "vector_id"), ["space", "vector_id"], "left_anti").unionByName(new, allowMissingColumns=True)


def delete_vectors(vectors: DataFrame, vector_ids: DataFrame, space: str) -> DataFrame:
    gone = vector_ids.select(F.col("vector_id").alias("g")).distinct()
    return vectors.join(gone, (F.col("space") == space) & (F.col("vector_id") == F.col("g")), "left_anti")


def delete_documents(vectors: DataFrame, documents: DataFrame, space: str) -> DataFrame:
    gone = documents.select(F.col("document_id").alias("g")).distinct()
    return vectors.join(gone, (F.col("space") == space) & (F.col("document_id") == F.col("g")), "left_anti")


def pruned(vectors: DataFrame, space: str, count: int) -> DataFrame:
    """vectors without the space's chunks at or beyond a count; ids that can't be read stay."""
    index = ids.parsed_vector_id("vector_id")[1]
    return vectors.where(~((F.col("space") == space) & F.coalesce(index >= count, F.lit(False))))


def drop_space(vectors: DataFrame, space: str) -> DataFrame:
    if not space:
        raise ValueError("the original space has no name to drop it by")
    return vectors.where(F.col("space") != space)


def fetch(vectors: DataFrame, vector_ids: DataFrame, space: str) -> DataFrame:
    """Rows of the ids in the space; missing ids are absent."""
    return vectors.where(F.col("space") == space).join(vector_ids.select("vector_id").distinct(), "vector_id", "left_semi")


def list_ids(vectors: DataFrame, prefix: str, space: str) -> DataFrame:
    return vectors.where((F.col("space") == space) & F.col("vector_id").startswith(prefix)).select("vector_id").orderBy("vector_id")


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stored table; one that is not there reads as empty and nothing is created."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Writes df over the partitions (column `by`) that it holds and no others. df may read from path: it is staged first."""
    spark = df.sparkSession
    stage = f"{path.rstrip('/')}-stage-{uuid.uuid4().hex}"
    df.write.parquet(stage)
    spark.read.schema(df.schema).parquet(stage).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(stage)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def merged(stored: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """stored with changes in place of the rows of their keys: the upsert of history tables."""
    return stored.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes, allowMissingColumns=True)


def extractions_table(spark: SparkSession, path: str, schema) -> versions.VersionedTable:
    """The table of stored extractions of a schema, by bucket of their document."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return versions.VersionedTable(spark, path, T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())]), "bucket")


def save_extractions(extractions: DataFrame, path: str, buckets: int = 256) -> int:
    """Stores extractions (document_id, ...) as a new version of the table: only buckets that hold one of them are
    rewritten, with the other documents of the bucket kept. Returns the version."""
    table = extractions_table(extractions.sparkSession, path, extractions.schema)
    parent = table.version()
    new = extractions.withColumn("bucket", F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int"))
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # as many as buckets
    return table.commit(merged(table.read(parent, touched), new, ["document_id"]).select(*table.schema.names), touched, parent)


def pruned_artifacts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Table artifacts (document_id, table_id) that their document no longer has."""
    return before.join(after.select("document_id").distinct(), "document_id", "left_semi").join(after, ["document_id", "table_id"], "left_anti")
