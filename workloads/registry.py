"""One query per operator, each over whole tables. Names match ``workloads.oracles``."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectral_topics.functions.columns import columns_to_cells, matrix_columns
from spectral_topics.functions.storage import materialize, scratch_path
from spectral_topics.operators import corpus, linalg, moments, recover, tensor
from spectral_topics.plans.model import fit, held_blocks, project_and_contract, whiten
from spectral_topics.sources import text
from workloads.corpora import (
    order_docs,
    order_lines,
    part_model,
    sales_tensor,
    table,
    text_corpus,
    text_docs,
    text_model,
    wave,
    wave_factor,
)

ALPHA0 = 1.0
# Orthonormal 2x2 starts for the topic-sized factors B and C.
B_START = [(0, 0.8, -0.6), (1, 0.6, 0.8)]
C_START = [(0, 0.6, 0.8), (1, -0.8, 0.6)]
# Change of A at which the decompositions compared with SQL stop.
ALS_TOLERANCE = 0.1
FIT_TOLERANCE = 1e-4
SIGMA = np.array([2.0, 1.5, 0.75])


def rounded(column: str, digits: int) -> Column:
    """Rounded with -0.0 folded into 0.0."""
    return (F.round(column, digits) + 0.0).alias(column)


def rounded_columns(df: DataFrame, digits: int, *prefixes: str, also: tuple[str, ...] = ()) -> DataFrame:
    names = {c for p in prefixes for c in matrix_columns(df, p)} | set(also)
    return df.select(*[rounded(c, digits) if c in names else F.col(c) for c in df.columns])


# sources and sinks


def bow_text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tokens = text.read_bow_text(spark, bow_text(spark, sf_dir))
    return docs.join(corpus.doc_terms(tokens), "doc_id", "left").select("doc_id", "word_id", "cnt")


def bow_text(spark: SparkSession, sf_dir: str) -> str:
    """The order-part corpus as bag-of-words text, a line per order; orders without lines have no tokens.

    Each count is split over two tokens, so that the reader meets repeated words in a line.
    """
    pairs = corpus.doc_terms(order_lines(spark, sf_dir))
    rest = (F.col("cnt") - 1).cast("string")
    token = F.format_string("%d:%s %d:1", "word_id", rest, "word_id")
    words = pairs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list(token)), " ").alias("words"))
    lines = order_docs(spark, sf_dir).join(words, "doc_id", "left").select(
        F.concat_ws(" ", F.col("doc_id").cast("string"), F.coalesce("n", F.lit(0)).cast("string"), "words")
    )
    path = scratch_path(spark, "bow-text")
    lines.write.text(path)
    return path


def dense_rows_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    line = F.concat_ws(" ", part.p_partkey, part.p_size, part.p_retailprice, F.when(part.p_size > 25, part.p_size * 2))
    path = scratch_path(spark, "rows-text")
    part.select(line).write.text(path)
    rows = text.read_rows_text(spark, path)
    return rows.select("row_id", F.posexplode("vec").alias("at", "val")).select("row_id", F.col("at").cast("bigint").alias("at"), "val")


def saved_matrix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    values = F.concat(F.concat_ws(",", part.p_size, part.p_retailprice, F.lit("n/a"), part.p_partkey), F.lit(","))
    path = scratch_path(spark, "matrix-text")
    part.select(F.concat_ws("\t", part.p_partkey, F.lit(""), values)).write.text(path)
    return text.read_matrix_text(spark, path).select("row_id", *[F.col("vec")[j].alias(f"v{j}") for j in range(3)])


def matrix_text_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier_rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("row_id")).agg(
        F.sum("l_quantity").alias("v0"), F.count(F.lit(1)).cast("double").alias("v1"), (F.min("l_quantity") / 4).alias("v2")
    )
    path = scratch_path(spark, "matrix-out")
    text.write_matrix_text(supplier_rows, path, prefix="v")
    return spark.read.text(path).withColumnRenamed("value", "line")


# corpus


def doc_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.doc_terms(order_lines(spark, sf_dir))


def min_length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.filter_min_len(corpus.doc_terms(order_lines(spark, sf_dir)), 3)


def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = corpus.term_frequency(corpus.doc_terms(order_lines(spark, sf_dir)))
    return found.select("doc_id", "word_id", rounded("tf", 12))


def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.doc_stats(order_docs(spark, sf_dir), order_lines(spark, sf_dir))


def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus_counts(doc_stats(spark, sf_dir))


def moment_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = corpus.moment_weights(doc_stats(spark, sf_dir), ALPHA0)
    return weights.select("doc_id", "len", *[rounded(c, 12) for c in ("pair", "s2", "s3")])


# moments


def model_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = corpus.doc_terms(order_lines(spark, sf_dir))
    found = moments.lookup_model(terms, part_model(spark, sf_dir, 3))
    return rounded_columns(found.select("doc_id", "word_id", "cnt", "o0", "o1", "o2"), 10, "o")


def pair_moment_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    sketch = moments.pair_moment_sketch(order_lines(spark, sf_dir), part_model(spark, sf_dir, 4))
    return rounded_columns(sketch, 7, "y", also=("mu_sum",))


def mean_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = order_docs(spark, sf_dir).count()
    found = moments.mean_frequency(order_lines(spark, sf_dir), n)
    return found.select("word_id", rounded("mu", 12))


def raw_mean_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = order_docs(spark, sf_dir).count()
    found = moments.mean_frequency(order_lines(spark, sf_dir), n, min_len=1)
    return found.select("word_id", rounded("mu", 12))


def doc_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    proj = moments.project_docs(order_lines(spark, sf_dir), part_model(spark, sf_dir, 4))
    return rounded_columns(proj, 7, "x")


def scaled_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    proj = moments.project_docs(order_lines(spark, sf_dir), part_model(spark, sf_dir, 3))
    return rounded_columns(linalg.scale_projection(proj, SIGMA), 7, "x")


def corrected_pair_moment(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = order_docs(spark, sf_dir).count()
    model = part_model(spark, sf_dir, 4)
    sketch = materialize(moments.pair_moment_sketch(order_lines(spark, sf_dir), model), "sketch")
    return rounded_columns(moments.correct_pair_moment(sketch, model, ALPHA0, n), 12, "y", also=("mu",))


def scaled_docs(spark: SparkSession, sf_dir: str, width: int = 3) -> DataFrame:
    """Order projections divided by the fixed sigma."""
    divisors = linalg.ridged(SIGMA[:width])
    return moments.project_docs(order_lines(spark, sf_dir), part_model(spark, sf_dir, width), divisors)


def first_moment(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = order_docs(spark, sf_dir).count()
    found = moments.first_moment(scaled_docs(spark, sf_dir), n)
    return found.select("i", rounded("val", 11))


def third_moment_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = moments.third_moment_sums(scaled_docs(spark, sf_dir), ALPHA0)
    return found.select("part", "i", "j", "l", rounded("val", 6))


def third_moment(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = materialize(moments.third_moment_sums(scaled_docs(spark, sf_dir), ALPHA0), "sums")
    m1 = moments.first_moment_of_sums(sums, 3, order_docs(spark, sf_dir).count())
    found = moments.third_moment(sums, m1, ALPHA0)
    return found.select("i", "j", "l", rounded("val", 10))


def third_moment_word_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = corpus.doc_terms(order_lines(spark, sf_dir))
    n = order_docs(spark, sf_dir).count()
    model = part_model(spark, sf_dir, 2)
    d = model.count()
    with held_blocks(tokens, d, 2) as (blocks, routes):
        found, _ = project_and_contract(blocks, model, np.array([1.25, 0.5]), ALPHA0, n, d, variant="whitened", routes=routes)
    return found.select("i", "j", "l", rounded("val", 10))


def matrix_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three matrices, of the lines that the order's number modulo 3 picks."""
    lines = table(spark, sf_dir, "lineitem")
    parts = [
        lines.where(F.pmod("l_orderkey", F.lit(3)) == part).groupBy(F.col("l_partkey").alias("row_id")).agg(
            F.array(F.sum("l_quantity"), F.count(F.lit(1)).cast("double")).alias("vec")
        )
        for part in range(3)
    ]
    total = moments.sum_matrices(*parts)
    return total.select("row_id", F.col("vec")[0].alias("v0"), F.col("vec")[1].alias("v1"))


# linear algebra


def gaussian_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part").count()
    return rounded_columns(linalg.gaussian_matrix(spark, d, 5, seed=20_010), 8, "o")


def part_vectors(spark: SparkSession, sf_dir: str, width: int) -> DataFrame:
    """(word_id, y0, ...): sizes, prices and waves of the parts, columns that are not orthogonal."""
    part = F.col("p_partkey")
    size, price = F.col("p_size") / F.lit(50.0), F.col("p_retailprice") / F.lit(1000.0)
    columns = [size, price, wave(part, 0) + size, wave(part, 1) + price][:width]
    return table(spark, sf_dir, "part").select(part.alias("word_id"), *[c.alias(f"y{j}") for j, c in enumerate(columns)])


def gram_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linalg.gram_table(part_vectors(spark, sf_dir, 4), "y").select("a", "b", rounded("val", 7))


def orthonormal_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_columns(linalg.orthonormalize(part_vectors(spark, sf_dir, 3), "y"), 10, "y")


def unit_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit, norms = linalg.normalize_columns(part_vectors(spark, sf_dir, 3), "y")
    with_norms = unit.select("*", *[F.lit(float(v)).alias(f"n{j}") for j, v in enumerate(norms)])
    return rounded_columns(with_norms, 9, "y", "n")


def tall_small_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = np.array([[1.0, 0.5], [-2.0, 0.25], [0.0, 3.0]])
    return rounded_columns(linalg.matmul_small(part_vectors(spark, sf_dir, 3), "y", weights, "z"), 10, "z")


def text_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrected pair moment of the text corpus times the 2-column wave matrix."""
    n = text_docs(spark, sf_dir).count()
    tokens, vocabulary = text_corpus(spark, sf_dir)
    model = text_model(vocabulary, 2)
    d = vocabulary.count()
    with held_blocks(tokens, d, 2) as (blocks, routes):
        sketch = materialize(moments.pair_moment_sketch(blocks, model, rows=d, routes=routes), "sketch")
    return materialize(moments.correct_pair_moment(sketch, model, ALPHA0, n), "corrected")


def spectral_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, sigma = linalg.spectral_factor(text_sketch(spark, sf_dir), "y", 2)
    out = model.select("*", *[F.lit(float(s)).alias(f"s{j}") for j, s in enumerate(sigma)])
    return rounded_columns(out, 8, "o", "s")


def range_finder(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = text_docs(spark, sf_dir).count()
    tokens, vocabulary = text_corpus(spark, sf_dir)
    d = vocabulary.count()
    with held_blocks(tokens, d, 2) as (blocks, routes):
        model, sigma = whiten(blocks, n, d, 2, 2, ALPHA0, start=text_model(vocabulary, 2), routes=routes)
    out = model.select("*", *[F.lit(float(s)).alias(f"s{j}") for j, s in enumerate(sigma)])
    return rounded_columns(out, 8, "o", "s")


# tensor


def sales_factors(cells: DataFrame, rank: int = 2) -> list[DataFrame]:
    return [wave_factor(cells, mode, rank) for mode in tensor.MODES]


def factor_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = sales_tensor(spark, sf_dir)
    found = tensor.lookup_factors(cells, sales_factors(cells), 0)
    return rounded_columns(found.select("i", "j", "l", "val", "p0", "p1", "q0", "q1"), 10, "p", "q")


def mttkrp(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = materialize(sales_tensor(spark, sf_dir), "sales")
    parts = []
    for mode, name in enumerate(tensor.MODES):
        parts.append(tensor.mttkrp(cells, sales_factors(cells), mode).select(F.lit(name).alias("mode"), "*"))
    return rounded_columns(parts[0].unionByName(parts[1]).unionByName(parts[2]), 5, "f")


def als_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = materialize(sales_tensor(spark, sf_dir), "sales")
    updated = tensor.als_update(cells, sales_factors(cells), 1, rho=0.01)
    return rounded_columns(updated, 7, "f")


def slice_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = part_model(spark, sf_dir, 2, prefix="f", key="idx")
    slices = [model.where(F.col("idx") % 3 == r) for r in range(3)]
    return rounded_columns(tensor.merge_slices(*slices), 10, "f")


def cp_als(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = materialize(sales_tensor(spark, sf_dir), "sales")
    found = tensor.cp_als(cells, 2, tol=ALS_TOLERANCE, start=(wave_factor(cells, "j", 2), wave_factor(cells, "l", 2)))
    named = [f.select(F.lit(name).alias("factor"), F.col("idx").cast("int").alias("idx"), "f0", "f1") for name, f in zip("ABC", (found.a, found.b, found.c))]
    weights = [F.lit(float(v)).alias(f"lambda{r}") for r, v in enumerate(found.lambdas)]
    out = named[0].unionByName(named[1]).unionByName(named[2]).select("*", *weights)
    return rounded_columns(rounded_columns(out, 8, "f"), 4, "lambda")


def sign_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("p_partkey")
    rows = table(spark, sf_dir, "part")
    # First rows (1, 1, -1), (-1, 1, 1), (1, -1, 1): B, C and A supply the columns.
    shifts = {"a": (0.0, 0.0, 3.0), "b": (3.0, 0.0, 0.0), "c": (0.0, 3.0, 0.0)}
    factors = [
        rows.select(part.alias("idx"), *[F.sin(part + 1 + s).alias(f"f{r}") for r, s in enumerate(shifts[name])])
        for name in "abc"
    ]
    return rounded_columns(tensor.sign_vote(*factors), 10, "f")


# recovery


def dirichlet_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    lambdas = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("topic")).agg(
        (F.count(F.lit(1)) / F.lit(10.0)).alias("lambda")
    )
    return recover.dirichlet_prior(lambdas, ALPHA0).select("topic", rounded("value", 12))


def unwhiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = np.array([[0.6, 0.8], [-0.8, 0.6]])
    found = recover.unwhiten(part_model(spark, sf_dir, 2), a, np.array([1.5, 0.5]))
    return rounded_columns(found, 12, "f")


def event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_type", "event_id", (F.col("value") / 1000).alias("value"))


def simplex_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recover.simplex_projection(event_values(spark, sf_dir), "event_type", "event_id", "value")
    return found.select("event_type", "event_id", rounded("value", 10))


def topic_recovery_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recover.recover_topic(event_values(spark, sf_dir), "event_type", "event_id", "value", iterations=20)
    return found.select("event_type", "event_id", rounded("value", 10))


def recovered_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("p_partkey")
    d = table(spark, sf_dir, "part").count()
    factors = materialize(
        table(spark, sf_dir, "part").select(
            part.alias("word_id"),
            (F.col("p_retailprice") / (F.lit(1000.0) * d) + wave(part, 0) / d).alias("f0"),
            (wave(part, 1) / d - F.col("p_size") / (F.lit(30.0) * d)).alias("f1"),
        ),
        "factors",
    )
    found = columns_to_cells(recover.recover_topics(factors, iterations=None), "p", "topic", "prob")
    return found.select("word_id", "topic", rounded("prob", 10))


def top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("topic"), F.col("l_partkey").alias("word_id"))
    return recover.top_words(sold.agg(F.sum("l_quantity").alias("prob")), 10)


def running_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_type", "event_id", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    found = recover.running_sum(events, "event_type", [F.desc("cents"), F.asc("event_id")], "cents")
    return found.select("event_type", "event_id", "running", F.col("position").cast("bigint").alias("position"))


# whole job


def fit_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job from fixed starts until convergence: probabilities and the prior of two topics of the text corpus."""
    return two_topics(spark, sf_dir, "reference")


def fit_topics_whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with full whitening and corrections in word space."""
    return two_topics(spark, sf_dir, "whitened")


def two_topics(spark: SparkSession, sf_dir: str, variant: str) -> DataFrame:
    starts = tuple(spark.createDataFrame(rows, "idx int, f0 double, f1 double") for rows in (B_START, C_START))
    tokens, vocabulary = text_corpus(spark, sf_dir)
    model = fit(
        text_docs(spark, sf_dir),
        tokens,
        k=2,
        k_prime=2,
        alpha0=ALPHA0,
        vocab_size=vocabulary.count(),
        tol=FIT_TOLERANCE,
        start=text_model(vocabulary, 2),
        als_start=starts,
        iterations=None,
        variant=variant,
    )
    joined = model.beta.join(F.broadcast(model.alpha.withColumnRenamed("value", "alpha")), "topic")
    return joined.select("word_id", "topic", rounded("prob", 8), rounded("alpha", 6))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        bow_text_scan,
        dense_rows_scan,
        saved_matrix_scan,
        matrix_text_sink,
        doc_terms,
        min_length_filter,
        term_frequency,
        moment_weights,
        scaled_projection,
        model_lookup,
        factor_lookup,
        pair_moment_sketch,
        mean_frequency,
        doc_stats,
        corpus_counts,
        doc_projection,
        corrected_pair_moment,
        first_moment,
        third_moment_sums,
        third_moment,
        third_moment_word_corrected,
        matrix_sum,
        raw_mean_document,
        gaussian_matrix,
        gram_matrix,
        orthonormal_columns,
        unit_columns,
        mttkrp,
        tall_small_product,
        spectral_factor,
        range_finder,
        als_update,
        slice_merge,
        cp_als,
        sign_vote,
        dirichlet_prior,
        unwhiten,
        simplex_projection,
        topic_recovery_rounds,
        recovered_topics,
        top_words,
        running_sum,
        fit_topics,
        fit_topics_whitened,
    )
}

