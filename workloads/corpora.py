"""Corpora, start matrices and tensors derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectral_topics.functions.storage import materialize
from spectral_topics.operators.recover import running_sum
from spectral_topics.operators.words import numbered_slices, slices, text_words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wave(index: Column, j: int) -> Column:
    """sin((index+1)(1.3 + 0.7 j)): columns of a well-conditioned matrix both engines can compute."""
    return F.sin((index + 1) * F.lit(1.3 + 0.7 * j))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as a token: document = order, word = part, count = quantity."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("word_id"), F.col("l_quantity").alias("cnt")
    )


def order_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))


def part_model(spark: SparkSession, sf_dir: str, width: int, prefix: str = "o", key: str = "word_id") -> DataFrame:
    part = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        part.alias(key), *[wave(part, j).alias(f"{prefix}{j}") for j in range(width)]
    )


def text_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id")


def text_corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``tokens(doc_id, word_id, cnt)`` of the documents' words, and ``vocabulary(word_id)``.

    A word's id is its place among all distinct words in byte order, numbered over ranges. Both are
    written once, since every moment query reads its tokens more than once. Texts are taken in slices (``slices``), so
    the numbering joins each slice's spellings, not each document's words, and a frequent word is no hot key.
    """
    texts = spread_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = texts.select("doc_id", *text_words())
    sliced = materialize(slices(found), "text-words")
    spelled = sliced.where("spellings IS NOT NULL").select("slice", F.posexplode("spellings").alias("code", "word"))
    spelled = spelled.withColumn("word", F.lower("word"))
    numbered = materialize(numbered_values(spelled, "word", "word_id"), "vocabulary")
    # New names, as both sides of the cogroup come from one table.
    ids = spelled.join(numbered, "word").select(F.col("slice").alias("slice"), F.col("code").alias("code"), "word_id")
    tokens = materialize(numbered_slices(sliced.where("spellings IS NULL"), ids), "text-tokens")
    return tokens, numbered.select("word_id")


def numbered_values(df: DataFrame, column: str, number: str) -> DataFrame:
    """``(column, number)``: the distinct values in ascending order, from 0, numbered over ranges."""
    distinct = df.select(column).distinct().select(column, F.lit(0).alias("all"), F.lit(1).alias("one"))
    return running_sum(distinct, "all", [F.asc(column)], "one").select(column, (F.col("position") - 1).cast("long").alias(number))


def spread_scan(df: DataFrame) -> DataFrame:
    """Give every core a share of a scan with fewer splits than cores; larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def text_model(vocabulary: DataFrame, width: int) -> DataFrame:
    word = F.col("word_id")
    return vocabulary.select(word, *[wave(word, j).alias(f"o{j}") for j in range(width)])


def sales_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity by customer segment (i, in order of name), part brand (j) and ship month (l)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = (
        lines.join(part, lines.l_partkey == part.p_partkey)
        .join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(customer, orders.o_custkey == customer.c_custkey)
    )
    segments = numbered_values(customer, "c_mktsegment", "segment")
    joined = joined.join(segments, "c_mktsegment")
    brand = F.regexp_replace("p_brand", "Brand#", "").cast("int") - 1
    month = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1
    return joined.groupBy(
        F.col("segment").cast("int").alias("i"), brand.alias("j"), month.cast("int").alias("l")
    ).agg(F.sum("l_quantity").alias("val"))


def wave_factor(tensor: DataFrame, mode: str, rank: int) -> DataFrame:
    """A factor for one mode of the tensor: the wave matrix on the indexes that occur."""
    index = F.col("idx")
    return tensor.select(F.col(mode).alias("idx")).distinct().select(
        "idx", *[wave(index, r).alias(f"f{r}") for r in range(rank)]
    )
