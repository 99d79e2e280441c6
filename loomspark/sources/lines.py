"""Line formats: JSONL keyed by id, and text lines out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _tagged(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Lines with their file, the split that they begin in, a number that rises by one a line there, the parsed row, and whether
    they are bad."""
    nth = F.monotonically_increasing_id()
    lines = spark.read.text(path, wholetext=False).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), nth.alias("nth"))
    row = F.from_json("value", T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad"})
    wrong = F.col("row").isNull() | F.col("row._bad").isNotNull() | F.col("row.id").isNull()
    return lines.withColumn("row", row).withColumn("bad", (F.trim("value") != "") & wrong)


def _heads(tagged: DataFrame) -> DataFrame:
    """A row a split: lines of the file before it, number of its first line, and its first bad line."""
    first_bad = F.min(F.when(F.col("bad"), F.struct("nth", F.substring("value", 1, 200).alias("text"))))
    splits = tagged.groupBy("file", "split").agg(F.count(F.lit(1)).alias("lines"), F.min("nth").alias("first"), first_bad.alias("bad"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    return splits.withColumn("before", F.coalesce(F.sum("lines").over(earlier), F.lit(0))).drop("lines")


def bad_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """file, line (from 1), value of every line that isn't JSON or has no id, also in files that are read in splits: lines
    are counted a split, and the counts of the splits before it are added. Blank lines count but are not bad."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    tagged = _tagged(spark, path, schema)
    heads = _heads(tagged).select("file", "split", "first", "before")
    return tagged.where("bad").join(heads, ["file", "split"]).select("file", (F.col("before") + F.col("nth") - F.col("first") + 1).alias("line"), "value")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a JSONL file or folder. The lines are checked first, in one scan that returns a row a split: the first line that isn't
    JSON or has no id is a ValueError that names its file, its number and its text."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    found = _heads(_tagged(spark, path, schema)).where("bad is not null").select("file", (F.col("before") + F.col("bad.nth") - F.col("first") + 1).alias("line"), "bad.text")
    for r in found.orderBy("file", "line").limit(1).collect():
        raise ValueError(f"bad line {r.line} of {r.file}: {r.text}")
    lines = spark.read.text(path, wholetext=False).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("row")).select("row.*")


def write_lines(df: DataFrame, path: str, column: str = "value") -> None:
    df.select(F.col(column).alias("value")).write.text(path)
