"""From tensor factors back to words: priors, unwhitening, simplex projection, top words."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectral_topics.functions.columns import columns_to_cells, literal, matrix_columns
from spectral_topics.functions.storage import materialize
from spectral_topics.operators.linalg import gram, matmul_small

# Group thresholds up to this many rows travel through the driver, more stay in a table.
LOCAL_GROUPS = 10_000
# Spark cuts each task's rows to k before the shuffle for k up to this (its own default).
GROUP_LIMIT_ROWS = 1000
# Candidate thresholds looked at in one scan.
GRID_POINTS = 4


def dirichlet_prior(lambdas: DataFrame, alpha0: float) -> DataFrame:
    """``(topic, value)``: alpha0 * lambda^-2 / sum of lambda^-2 for a table ``(topic, lambda)``."""
    weight = 1.0 / (F.col("lambda") * F.col("lambda"))
    total = lambdas.agg(F.sum(weight)).first()[0]
    return lambdas.select("topic", (weight / F.lit(float(total)) * F.lit(float(alpha0))).alias("value"))


def unwhiten(model: DataFrame, a: np.ndarray, lambdas: np.ndarray, key: str = "word_id") -> DataFrame:
    """``(word_id, f0, ...)``: model (modelᵀ model)⁻¹ A diag(lambda). Reads the model twice."""
    weights = np.linalg.solve(gram(model, "o"), np.asarray(a) * np.asarray(lambdas))
    return matmul_small(model, "o", weights, "f", key)


def simplex_thresholds(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """``(group..., theta)``, marked for broadcast if they are few, such that the sum of max(value - theta, 0) over each group is 1.

    From a lower bound, theta moves to (sum of values above theta - 1) / (their number) until the
    set above it stops shrinking. Each round also looks at a grid of larger candidates up to an
    upper bound and moves on from the last one that is still too low, so few rounds are needed.
    A round is one partially aggregated group-by: no group is sorted or brought into one task.
    Scans ``df`` once per round. Group columns that may be null come in a struct.
    """
    group = list(group)
    bounds = df.groupBy(*group).agg(F.sum(value).alias("s"), F.count(value).alias("n"), F.max(value).alias("top"))
    lower = F.greatest((F.col("s") - 1.0) / F.col("n"), F.col("top") - 1.0)
    state, rows = _settle(bounds.select(*group, "n", lower.alias("theta"), (F.col("top") - lower).alias("width")))
    grid = [F.col("theta") + F.col("width") * (b / GRID_POINTS) for b in range(GRID_POINTS)]
    counts = [F.count_if(F.col(value) > t).alias(f"n{b}") for b, t in enumerate(grid)]
    sums = [F.coalesce(F.sum(F.when(F.col(value) > t, F.col(value))), F.lit(0.0)).alias(f"s{b}") for b, t in enumerate(grid)]
    while True:
        old = state.withColumnRenamed("n", "before")
        found = with_thresholds(df, old, rows is not None, group).groupBy(
            *group, "before", "theta", "width"
        ).agg(*counts, *sums)
        moved, rows = _settle(found.select(*group, _next_threshold(grid).alias("to")).select(*group, "to.*"))
        if rows is not None:
            done = all(r["done"] for r in rows)
        else:
            done = moved.where(~F.col("done")).isEmpty()
        if done:
            theta = moved.select(*group, "theta")
            return F.broadcast(theta) if rows is not None else theta
        state = moved.select(*group, "n", "theta", "width")


def _next_threshold(grid: Sequence[Column]) -> Column:
    """Where theta goes after one round: a struct (n, theta, width, done)."""
    done = F.struct(
        F.col("before").alias("n"), F.col("theta"), F.lit(0.0).alias("width"), F.lit(True).alias("done")
    )
    step = F.when((F.col("n0") == F.col("before")) | (F.col("n0") == 0), done)
    for b in reversed(range(len(grid))):
        count, total = F.col(f"n{b}"), F.col(f"s{b}")
        theta = (total - 1.0) / count
        upper = grid[b + 1] if b + 1 < len(grid) else F.col("theta") + F.col("width")
        move = F.struct(
            count.alias("n"), theta.alias("theta"), F.greatest(upper - theta, F.lit(0.0)).alias("width"), F.lit(False).alias("done")
        )
        too_low = (count > 0) & (total - count * grid[b] >= 1.0) if b else F.lit(True)
        step = step.when(too_low, move)
    return step


def with_thresholds(df: DataFrame, thresholds: DataFrame, few: bool, group: Sequence[str]) -> DataFrame:
    """Join by group: few thresholds are broadcast; with many groups Spark's own join splits large ones at run time."""
    return df.join(F.broadcast(thresholds) if few else thresholds, list(group))


def _settle(table: DataFrame) -> tuple[DataFrame, list | None]:
    """Compute the table now: as a local relation with its rows while small, else in shared storage."""
    rows = table.limit(LOCAL_GROUPS + 1).collect()
    if len(rows) <= LOCAL_GROUPS:
        return table.sparkSession.createDataFrame(rows, table.schema), rows
    return materialize(table, "thresholds"), None


def simplex_projection(df: DataFrame, group: str | Sequence[str], id: str, value: str) -> DataFrame:
    """``(group..., id, value)``: each group of values projected onto the probability simplex.

    Null groups are a group. A null value fails the job: nothing says where it should go.
    """
    group = [group] if isinstance(group, str) else list(group)
    known = F.coalesce(F.col(value).cast("double"), F.raise_error(F.lit("a null value cannot be projected")).cast("double"))
    # One key of its own name: a struct of nulls equals another, and no name of the caller's can clash.
    key = F.struct(*[F.col(g).alias(f"g{i}") for i, g in enumerate(group)])
    packed = df.select(key.alias("group"), F.col(id).alias("id"), known.alias("v"))
    theta = simplex_thresholds(packed, ["group"], "v")
    return packed.join(theta, "group").select(
        *[F.col(f"group.g{i}").alias(g) for i, g in enumerate(group)],
        F.col("id").alias(id),
        F.greatest(F.col("v") - F.col("theta"), F.lit(0.0)).alias(value),
    )


def admm_scale(iterations: int | None) -> float:
    """What ADMM's splitting with penalty 1 does to the vector before its last projection.

    Its rounds are m = (v + z - u)/2, z = P(m + u), u += m - z from zero, P being the projection.
    With w = m + u the update gives z + u = w, so the next w is (v + w)/2: after n rounds
    w = (1 - 2^-n) v and z = P(w). None stands for the limit.
    """
    if iterations is None:
        return 1.0
    if iterations < 1:
        raise ValueError("at least one iteration")
    return 1.0 - 2.0**-iterations


def recover_topic(
    df: DataFrame, group: str | Sequence[str] = "topic", id: str = "word_id", value: str = "value", iterations: int | None = 20
) -> DataFrame:
    """The distribution found by ``iterations`` ADMM rounds from each group's values (None: the limit)."""
    scaled = df.withColumn(value, F.col(value) * F.lit(admm_scale(iterations)))
    return simplex_projection(scaled, group, id, value)


def recover_topics(factors: DataFrame, iterations: int | None = 20, key: str = "word_id") -> DataFrame:
    """``(word_id, p0, ...)`` from ``(word_id, f0, ...)``: recover f and -f, keep the closer one.

    Scans ``factors`` several times, so pass a materialised table. It must hold a row for every
    word. Only a sign and a threshold per topic come to the driver.
    """
    cols = matrix_columns(factors, "f")
    scale = literal(admm_scale(iterations))
    cells = columns_to_cells(factors, "f", "topic", "f")
    sides = F.explode(F.array(F.lit(1), F.lit(-1))).alias("side")
    signed = cells.select("topic", "f", sides).withColumn("v", F.expr(f"f * side * {scale}"))
    theta = simplex_thresholds(signed, ["topic", "side"], "v")
    residual = F.greatest(F.col("v") - F.col("theta"), F.lit(0.0)) - F.col("f") * F.col("side")
    errors = signed.join(theta, ["topic", "side"]).groupBy("topic", "side", "theta").agg(
        F.sum(residual * residual).alias("err")
    )
    # The positive side wins only when strictly closer.
    best = {}
    for row in sorted(errors.collect(), key=lambda r: (r["err"], r["side"]), reverse=True):
        best[row["topic"]] = (row["side"], row["theta"])
    probabilities = []
    for topic, col in enumerate(cols):
        side, theta = best[topic]
        shifted = F.expr(f"{col} * {side} * {scale} - ({literal(theta)})")
        probabilities.append(F.greatest(shifted, F.lit(0.0)).alias(f"p{topic}"))
    return factors.select(key, *probabilities)


def top_k(df: DataFrame, group: str | Sequence[str], order: Sequence[Column], k: int, spread_by: str) -> DataFrame:
    """The first k rows of each group in the given order, with their ``rank``.

    Up to 1000 rows Spark cuts every task's rows before the shuffle. For larger k the groups are
    first cut within pieces hashed on ``spread_by``, so that no task sorts a whole group.
    """
    group = [group] if isinstance(group, str) else list(group)
    whole = Window.partitionBy(*group).orderBy(*order)
    if k > GROUP_LIMIT_ROWS:
        pieces = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        piece, place = free_name(df.columns, "piece"), free_name(df.columns, "place")
        pieced = df.withColumn(piece, F.pmod(F.xxhash64(spread_by), F.lit(pieces)))
        within = Window.partitionBy(*group, piece).orderBy(*order)
        df = pieced.withColumn(place, F.row_number().over(within)).where(F.col(place) <= k).drop(piece, place)
    return df.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k)


def top_words(beta: DataFrame, n: int) -> DataFrame:
    """``(topic, rank, word_id, prob)``: the n most probable words of each topic."""
    ranked = top_k(beta, "topic", [F.desc("prob"), F.asc("word_id")], n, spread_by="word_id")
    return ranked.select("topic", "rank", "word_id", "prob")


def running_sum(
    df: DataFrame, group: str, order: Sequence[Column], value: str, partitions: int | None = None
) -> DataFrame:
    """``df`` with ``running`` (sum so far in the group) and ``position`` (1, 2, ...).

    ``order`` must be total within a group. Rows are range partitioned on group and order, so a
    large group is split over tasks: each range sums its own rows and adds what the ranges before
    it hold. The ranges come from a sample, hence the partitioned rows are written before use.
    Null groups are a group, and a null value adds nothing. Columns ``running`` and ``position`` must be free.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = df.columns
    if {"running", "position"} & set(columns):
        raise ValueError("the columns running and position are added, so they must not be there")
    part, here, at, its, sums, rows = (free_name(columns, name) for name in ("range", "here", "at", "its_group", "s0", "n0"))
    ranged = df.repartitionByRange(n, F.col(group).asc(), *order).withColumn(part, F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    totals = ranged.groupBy(group, part).agg(F.coalesce(F.sum(value), F.lit(0)).alias(sums), F.count(F.lit(1)).alias(rows))
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col(group).alias(its),
        F.col(part).alias(f"{its}_range"),
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in (sums, rows)],
    )
    within = Window.partitionBy(group, part).orderBy(*order)
    local = ranged.select(
        "*",
        F.coalesce(F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias(here),
        F.row_number().over(within).alias(at),
    )
    same = F.col(group).eqNullSafe(F.col(its)) & (F.col(part) == F.col(f"{its}_range"))
    return local.join(offsets, same).select(
        *columns, (F.col(here) + F.col(sums)).alias("running"), (F.col(at) + F.col(rows)).alias("position")
    )


def free_name(columns: Sequence[str], name: str) -> str:
    """``name``, with underscores added until no column has it or begins with it."""
    while any(c.lower().startswith(name) for c in columns):
        name += "_"
    return name


def factor_array(table: DataFrame, rows: int) -> np.ndarray:
    """A k×k factor table as an array."""
    cols = matrix_columns(table, "f")
    out = np.zeros((rows, len(cols)))
    for row in table.select("idx", *cols).collect():
        out[row[0]] = row[1:]
    return out
