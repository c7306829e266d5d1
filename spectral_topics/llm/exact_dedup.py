"""Exact dedup: combine equal texts locally, then per salted digest, then globally.

Every stage groups by the digest and the whole text, so rows are only ever merged after their
content has been compared. The first aggregation combines inside each input task before its shuffle
(the local stage) and then merges what tasks sent for a (digest, salt) pair; the second combines the
few salt winners of a digest. A text that makes up a third of all rows reaches any task as at most
one row per input task, then as one row per salt.

Defined results
- A null text is the empty text; empty texts are equal to one another.
- Of equal texts the row with the largest id stays. Null ids are smaller than all others; a group
  of null ids only keeps one of them, with ``keep_id`` null.
- Rows that repeat the kept id and its text: exactly one of them is kept.
- An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectral_topics.functions.storage import materialize
from spectral_topics.llm.common import id_and_text, join_groups, quoted

#: Pieces into which the local winners of one digest are dealt before they are combined globally.
SALTS = 16


def sha256_text(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] = sha256_text,
) -> DataFrame:
    """``(id, keep_id, group_size, kept, digest)``: one row for each row of ``docs``.

    ``digest`` only routes rows: texts that share a digest but differ stay apart (tests pass a weak one).
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("digest", digest(F.col("text")))
    salted = rows.groupBy("digest", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"), "text").agg(
        F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    winners = salted.groupBy("digest", "text").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )
    # One small row per digest is stored. The text goes along only where a digest has several.
    groups = materialize(
        winners.groupBy("digest").agg(
            F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
        ),
        "digest-groups",
    )
    keys = rows.select("id", "digest")
    if groups.where("texts > 1").isEmpty():
        joined = join_groups(keys, groups.drop("texts"), "digest", "group_size", "id")
    else:
        shared = groups.where("texts > 1").select("digest")
        alone = groups.where("texts = 1").drop("texts")
        single = keys.join(shared, "digest", "left_anti")
        joined = join_groups(single, alone, "digest", "group_size", "id").unionByName(
            rows.join(shared, "digest", "left_semi").join(winners, ["digest", "text"]).drop("text")
        )
    # Among rows that repeat one id and text a single one can be the kept one.
    copy = F.row_number().over(Window.partitionBy("digest", "id").orderBy(F.lit(1)))
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (copy == 1)
    return joined.select("id", "keep_id", "group_size", kept.alias("kept"), "digest")


def keep_unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are; a repeated kept row is returned once."""
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(F.col("id").alias("kept_id"), F.col("digest").alias("kept_digest"))
    digest = sha256_text(F.coalesce(quoted(text_col).cast("string"), F.lit("")))
    rows = docs.select(quoted(id_col).cast("long").alias("id"), digest.alias("digest"), F.struct(*[quoted(c) for c in docs.columns]).alias("row"))
    copy = F.row_number().over(Window.partitionBy("id", "digest").orderBy(F.lit(1)))
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest"))
    return rows.join(kept, same, "left_semi").withColumn("copy", copy).where("copy = 1").select("row.*")
