"""Mixing sources to target weights by systematic sampling.

Each source gets a target: its weight's share of all sizes, at most ``max_repeats`` times its own
size; what lies above is dealt again to the others by weight until none is above. A document's
expected copies are target / source size. Within a source, in the order of size and id, expected
copies are summed up, one random offset is added, and a document is emitted once for every integer
that its stretch of the sum crosses. Copies of a document are therefore its expected copies rounded
down or up, and since the order is by size, a source's taken size misses its target by little more
than its largest document.

Prefix sums run over ranges of (source, size, id): a range adds up its own rows, then what the
ranges before it hold, so a source with a third of all rows is spread over many tasks. Sums are
kept as whole numbers of 2^-32 copies modulo 2^32: no rounding depends on the partitioning and
nothing overflows, and reruns agree.

Defined results
- A null source is a source of its own, after all others. A null text has size 0.
- A source of size 0 has target 0 and none of its documents is taken; in other sources a document of
  size 0 is emitted like any other.
- Ties in size and id fall in any order; they are interchangeable.
- An empty table gives an empty result. Other columns are kept by ``mix`` and not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectral_topics.functions.storage import materialize
from spectral_topics.llm.common import quoted, shuffles_deleted

ONE = 1 << 32
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeats: int = 3
) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, size)``.

    Sources in code-point order (null last) have the given weights, repeating. Each round of
    dealing out is one aggregation over the table of sources: a source whose share reaches its
    limit is fixed there, and the rest is dealt to the others.
    """
    totals = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    state = totals.join(source_weights(totals, weights), totals["source"].eqNullSafe(F.col("of_source"))).drop("of_source")
    limit = F.col("source_size") * F.lit(float(max_repeats))
    total = float(totals.agg(F.sum("source_size")).first()[0] or 0)
    # Whoever is above its limit at a level stays above it at every higher one, so the level only rises.
    level, capped = 0.0, -1
    while True:
        above = limit <= F.col("weight") * F.lit(level)
        row = state.agg(
            F.sum(F.when(above, limit).otherwise(0.0)).alias("fixed"),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("weights"),
            F.count_if(above).alias("n"),
        ).first()
        if row["n"] == capped or not row["weights"]:
            break
        capped, level = row["n"], (total - row["fixed"]) / row["weights"]
    target = F.when(limit <= F.col("weight") * F.lit(level), limit).otherwise(F.col("weight") * F.lit(level))
    return state.select("source", "source_size", target.cast("double").alias("target"))


def source_weights(totals: DataFrame, weights: Sequence[float]) -> DataFrame:
    """``(of_source, weight)``: sources numbered in code-point order, over ranges rather than in one task."""
    key = F.concat(F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.lit("0")), F.coalesce("source", F.lit("")))
    ranged = materialize(
        totals.select("source", key.alias("key")).repartitionByRange("key").withColumn("range", F.spark_partition_id()),
        "source-order",
    )
    counts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("range").orderBy("key")) - 1
    number = (place + F.col("before")) % F.lit(len(weights))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    return (
        ranged.withColumn("place", place)
        .join(counts.select("range", before.alias("before")), "range")
        .select(F.col("source").alias("of_source"), F.element_at(cycle, ((F.col("place") + F.col("before")) % len(weights) + 1).cast("int")).alias("weight"))
    )


def systematic_copies(rows: DataFrame, seed: int = 7) -> DataFrame:
    """``rows`` (source, size, id, expected, ...) with ``copies``.

    The rows are written once partitioned by ranges, since ranges come from a sample.
    """
    units = F.round(F.col("expected") * F.lit(float(ONE))).cast("long")
    ranged = materialize(
        rows.withColumn("units", units)
        .repartitionByRange("source", "size", "id")
        .withColumn("range", F.spark_partition_id()),
        "mix-ranges",
    )
    tag = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    keyed = ranged.withColumn("tag", tag)
    totals = keyed.groupBy("tag", "range").agg(F.pmod(F.sum(F.pmod("units", F.lit(ONE))), F.lit(ONE)).alias("s"))
    before = Window.partitionBy("tag").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.pmod(F.xxhash64("tag", F.lit(seed)), F.lit(ONE))
    starts = totals.select(
        "tag", "range", F.pmod(F.coalesce(F.sum("s").over(before), F.lit(0)) + offset, F.lit(ONE)).alias("start")
    )
    within = Window.partitionBy("tag", "range").orderBy("size", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = keyed.withColumn("here", F.sum(F.pmod("units", F.lit(ONE))).over(within) - F.pmod("units", F.lit(ONE)))
    at = F.pmod(F.col("start") + F.col("here"), F.lit(ONE))
    crossed = F.expr(f"(at + units) div {ONE}")
    return here.join(starts, ["tag", "range"]).withColumn("at", at).withColumn("copies", crossed).drop("tag", "range", "here", "start", "at", "units")


def mix_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    max_repeats: int = 3,
    seed: int = 7,
    keyed: bool = False,
) -> DataFrame:
    """``(id, source, size, source_size, target, copies)`` for each document; with ``keyed`` also ``row_key`` of its row."""
    columns = [quoted(id_col).alias("id"), quoted(source_col).cast("string").alias("source"), word_count(quoted(text_col)).alias("size")]
    if keyed:
        columns.append(row_key(id_col, text_col, source_col).alias("row_key"))
    sized = materialize(docs.select(*columns), "sizes")
    targets = source_targets(sized.select("source", "size"), weights, max_repeats)
    few = materialize(targets, "targets")
    # Sources may be many: the join is left to the planner, and a source's rows need no common task.
    tagged = sized.join(few.withColumnRenamed("source", "of_source"), F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return systematic_copies(tagged.withColumn("expected", expected), seed).drop("expected")


def row_key(id_col: str, text_col: str, source_col: str) -> Column:
    """Two hashes of what decides a row's copies; which of the columns are null counts too."""
    columns = [quoted(c) for c in (id_col, source_col, text_col)]
    nulls = [c.isNull() for c in columns]
    return F.struct(F.xxhash64(*nulls, *columns).alias("a"), F.xxhash64(F.lit(1), *columns[::-1]).alias("b"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, each as many times as it is taken.

    Ranges and sums are made of sizes and keys alone. Whole rows are shuffled once, to meet their copies by key, and
    aren't stored on the way. Rows of one key are interchangeable: they share its copies, to one more or less.
    """
    names = {"id_col": id_col, "text_col": text_col, "source_col": source_col}
    taken = mix_copies(docs, keyed=True, **names, **options)
    shared = taken.groupBy(F.col("row_key.a").alias("a"), F.col("row_key.b").alias("b")).agg(
        F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n")
    )
    with shuffles_deleted(docs.sparkSession):
        wanted = materialize(shared.where("copies > 0"), "copies")
    key = row_key(**names)
    rows = docs.select(key["a"].alias("a"), key["b"].alias("b"), F.struct(*[quoted(c) for c in docs.columns]).alias("row"))
    place = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.lit(1)))
    copies = F.expr("copies div n + if(place <= copies % n, 1, 0)")
    met = rows.join(wanted, ["a", "b"]).withColumn("place", place).withColumn("here", copies).where("here > 0")
    return met.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("here"))).alias("__copy")).select("row.*")
