"""Text readers and writers for bag-of-words files and dense matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectral_topics.functions.columns import matrix_columns


def _fields(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines split on whitespace."""
    return spark.read.text(path).select("value", F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+").alias("f"))


def _reject(condition: Column, message: str) -> Column:
    """A filter that keeps rows meeting the condition and fails the job on others."""
    return F.when(condition, True).otherwise(F.raise_error(F.concat(F.lit(message + ": "), F.col("value"))))


def _require_mode(mode: str) -> bool:
    if mode not in ("failfast", "permissive"):
        raise ValueError(f"mode must be failfast or permissive, not {mode!r}")
    return mode == "failfast"


def _documents(spark: SparkSession, path: str, strict: bool) -> DataFrame:
    lines = _fields(spark, path).withColumn("doc_id", F.expr("try_cast(f[0] AS BIGINT)"))
    usable = (F.size("f") >= 2) & F.col("doc_id").isNotNull()
    return lines.where(_reject(usable, "not a bag-of-words line") if strict else usable)


def _pairs(documents: DataFrame) -> DataFrame:
    """One row per ``word:count`` field; unparsable ids and counts are null."""
    rows = documents.select("value", "doc_id", F.explode(F.expr("slice(f, 3, size(f))")).alias("pair"))
    parts = rows.select("value", "doc_id", F.split("pair", ":", 2).alias("p"))
    return parts.select(
        "value",
        "doc_id",
        F.expr("try_cast(p[0] AS INT)").cast("bigint").alias("word_id"),
        F.expr("try_cast(get(p, 1) AS DOUBLE)").alias("cnt"),
    )


def read_bow_text(spark: SparkSession, path: str, mode: str = "failfast") -> tuple[DataFrame, DataFrame]:
    """``docs(doc_id)`` and ``tokens(doc_id, word_id, cnt)`` of lines ``docId nUnique id:count id:count ...``.

    The second field is not used. A line is a document, so ids must differ (``fit`` checks them). A
    document may have no tokens. ``failfast`` fails the job on a
    malformed line or token, ``permissive`` skips it; ``bow_text_quality`` counts them.
    """
    strict = _require_mode(mode)
    documents = _documents(spark, path, strict)
    parsed = F.col("word_id").isNotNull() & F.col("cnt").isNotNull()
    tokens = _pairs(documents).where(_reject(parsed, "malformed token in line") if strict else parsed)
    return documents.select("doc_id"), tokens.select("doc_id", "word_id", "cnt")


def bow_text_quality(spark: SparkSession, path: str) -> DataFrame:
    """One row: lines, lines that are no document, and malformed tokens of the documents."""
    lines = _fields(spark, path).withColumn("doc_id", F.expr("try_cast(f[0] AS BIGINT)"))
    good = (F.size("f") >= 2) & F.col("doc_id").isNotNull()
    bad_pair = "p -> try_cast(split(p, ':', 2)[0] AS INT) IS NULL OR try_cast(get(split(p, ':', 2), 1) AS DOUBLE) IS NULL"
    bad_tokens = F.when(good, F.expr(f"size(filter(slice(f, 3, size(f)), {bad_pair}))")).otherwise(0)
    return lines.agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(~good).alias("n_bad_lines"),
        F.coalesce(F.sum(bad_tokens), F.lit(0)).alias("n_bad_tokens"),
    )


def read_rows_text(spark: SparkSession, path: str, mode: str = "failfast") -> DataFrame:
    """``(row_id, vec)`` of lines ``rowId v1 v2 ...`` separated by whitespace, rows of any width."""
    strict = _require_mode(mode)
    rows = _fields(spark, path).select(
        "value",
        F.size("f").alias("n"),
        F.expr("try_cast(f[0] AS BIGINT)").alias("row_id"),
        F.expr("transform(slice(f, 2, size(f)), x -> try_cast(x AS DOUBLE))").alias("vec"),
    )
    parsed = (F.col("n") >= 2) & F.col("row_id").isNotNull() & ~F.exists("vec", lambda x: x.isNull())
    return rows.where(_reject(parsed, "not a matrix row") if strict else parsed).select("row_id", "vec")


def read_matrix_text(spark: SparkSession, path: str) -> DataFrame:
    """``(row_id, vec)`` of lines ``row <tab> lambda <tab> v1,v2,...``.

    The lambda field is not used and cells that are no numbers (a trailing comma) are skipped.
    """
    fields = spark.read.text(path).select("value", F.split("value", "\t").alias("f"))
    rows = fields.select(
        "value",
        F.expr("try_cast(f[0] AS BIGINT)").alias("row_id"),
        F.expr("filter(transform(split(get(f, 2), ','), x -> try_cast(x AS DOUBLE)), x -> x IS NOT NULL)").alias("vec"),
    )
    parsed = F.col("row_id").isNotNull() & F.col("vec").isNotNull()
    return rows.where(_reject(parsed, "not a saved matrix row")).select("row_id", "vec")


def matrix_lines(matrix: DataFrame, prefix: str | None = None, key: str = "row_id") -> DataFrame:
    """``(key, value)``: the row number and the values with six decimals, separated by tabs."""
    vec = F.array(*matrix_columns(matrix, prefix)) if prefix else F.col("vec")
    numbers = F.transform(vec, lambda x: F.format_string("%f", x))
    return matrix.select(key, F.concat_ws("\t", F.col(key).cast("string"), numbers).alias("value"))


def write_matrix_text(
    matrix: DataFrame, path: str, prefix: str | None = None, key: str = "row_id", files: int | None = None
) -> None:
    """Write the matrix as text, rows in key order across the part files."""
    lines = matrix_lines(matrix, prefix, key)
    ordered = lines.repartitionByRange(files, key) if files else lines.repartitionByRange(key)
    ordered.sortWithinPartitions(key).select("value").write.text(path)
