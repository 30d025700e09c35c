"""Table sources: guarded loads, corpus variants, splits, manifests, schema reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read ``name`` from ``folder``; a missing table is reported by name."""
    try:
        return spark.read.parquet(f"{folder}/{name}.parquet")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"table {name!r} is not in {folder}; run the stage that writes it first") from e
        raise


def load_many(spark: SparkSession, pattern: str) -> DataFrame:
    """Scan many files by glob; columns missing in older files come out NULL."""
    return spark.read.option("mergeSchema", "true").parquet(pattern)


def describe(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, nullability."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, column_type string, is_nullable boolean")


def corpus_text(corpus: DataFrame, variant: str = "a") -> DataFrame:
    """``(doc_id, text)``: variant a is title and answer, b adds the question body between them.

    Concatenation follows SQL: a NULL part makes the text NULL.
    """
    gap = F.lit("\n\n")
    parts = {"a": ["title", "answer_body"], "b": ["title", "question_body", "answer_body"]}[variant]
    cols = [F.col(parts[0])]
    for p in parts[1:]:
        cols += [gap, F.col(p)]
    return corpus.select("doc_id", F.concat(*cols).alias("text"))


def split_queries(splits: DataFrame, split: str) -> DataFrame:
    """Queries of one split."""
    return splits.filter(F.col("split") == split).select("query_id", "query_text")


def file_manifest(spark: SparkSession, path: str, suffix: str = ".parquet") -> DataFrame:
    """Files below ``path`` with their sizes, without reading their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("n_bytes"))


def check_manifest(found: DataFrame, expected: DataFrame) -> DataFrame:
    """``expected(name, n_bytes)`` against files found: complete, partial or absent."""
    e, f = expected.alias("e"), found.alias("f")
    status = F.when(F.col("f.n_bytes").isNull(), "absent").when(F.col("f.n_bytes") == F.col("e.n_bytes"), "complete").otherwise("partial")
    return e.join(f, F.col("e.name") == F.col("f.name"), "left").select(
        F.col("e.name").alias("name"), F.col("e.n_bytes").alias("n_bytes"), F.coalesce(F.col("f.n_bytes"), F.lit(0)).alias("n_found"), status.alias("status")
    )


def write_table(df: DataFrame, folder: str, name: str, partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> str:
    """Write a table as Parquet and return its path."""
    path = f"{folder}/{name}.parquet"
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return path


CLAIMS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("citations", T.ArrayType(T.IntegerType()))]))
