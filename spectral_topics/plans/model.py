"""The whole job: whiten, project, third moment, decompose, recover."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectral_topics.functions.columns import columns_to_cells, matrix_columns, named
from spectral_topics.functions.skew import fits_broadcast
from spectral_topics.functions.storage import current_run, materialize
from spectral_topics.operators.corpus import block_tokens, check_word_ids, count_documents
from spectral_topics.operators.linalg import gaussian_matrix, orthonormalize, ridged, spectral_factor
from spectral_topics.operators.moments import (
    correct_pair_moment,
    every_word,
    first_moment_of_sums,
    pair_moment_sketch,
    project_docs,
    third_moment,
    third_moment_sums,
    whitened_third_moment,
    word_correction_sums,
    word_corrections,
    word_routes,
)
from spectral_topics.operators.recover import dirichlet_prior, factor_array, recover_topics, unwhiten
from spectral_topics.operators.tensor import cp_als
from spectral_topics.sources.text import write_matrix_text

SEED = 20_010
VARIANTS = ("reference", "whitened")


@dataclass(frozen=True)
class TopicModel:
    """``alpha(topic, value)``, ``beta(word_id, topic, prob)`` and what the fit found on the way.

    ``topics(word_id, p0, ...)`` is beta with a column per topic.
    """

    alpha: DataFrame
    topics: DataFrame
    sigma: np.ndarray
    lambdas: np.ndarray
    n_docs: int
    n_iter: int
    converged: bool

    @property
    def beta(self) -> DataFrame:
        return columns_to_cells(self.topics, "p", "topic", "prob")

    def write_text(self, output: str) -> None:
        """``<output>.alpha`` (k rows) and ``<output>.beta`` (a row per word, a column per topic)."""
        write_matrix_text(self.alpha.select("topic", F.array("value").alias("vec")), f"{output}.alpha", key="topic", files=1)
        write_matrix_text(self.topics, f"{output}.beta", prefix="p", key="word_id")


@contextmanager
def held_blocks(
    tokens: DataFrame, vocab_size: int, width: int, partitions: int | None = None
) -> Iterator[tuple[DataFrame, DataFrame | None]]:
    """Blocked tokens and, for models of ``width`` columns beyond the broadcast limit, their ``word_routes``.

    Both are kept while the block runs; what is computed from them must be stored inside. Every pass reads the tokens more
    than once, and fetches model rows by block.
    """
    # Sorted once here, the joins of every pass need neither shuffle nor sort of the tokens.
    corpus = block_tokens(tokens, partitions).sortWithinPartitions("block", "doc_id").persist(StorageLevel.MEMORY_AND_DISK)
    routes = None
    if not fits_broadcast(tokens.sparkSession, vocab_size, width):
        # Which blocks need which word is found out once.
        routes = word_routes(corpus).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield corpus, routes
    finally:
        corpus.unpersist()
        if routes is not None:
            routes.unpersist()


def corrected_sketch(
    tokens: DataFrame, model: DataFrame, alpha0: float, n_docs: int, vocab_size: int, routes: DataFrame | None = None
) -> DataFrame:
    """One pass over the corpus: ``(word_id, y0, ...)``, the corrected pair moment times the model.

    Words without a usable document have no row, which stands for a zero row.
    """
    sketch = materialize(pair_moment_sketch(tokens, model, rows=vocab_size, routes=routes), "sketch")
    return correct_pair_moment(sketch, model, alpha0, n_docs).drop("mu")


def whiten(
    tokens: DataFrame,
    n_docs: int,
    vocab_size: int,
    k: int,
    k_prime: int,
    alpha0: float,
    seed: int = SEED,
    start: DataFrame | None = None,
    routes: DataFrame | None = None,
) -> tuple[DataFrame, np.ndarray]:
    """Two-pass randomized range finder: ``(word_id, o0, ...)`` with k columns, and sigma.

    ``start(word_id, o0, ...)`` replaces the seeded Gaussian start. Pass blocked tokens.
    """
    if not 1 <= k <= k_prime <= vocab_size:
        raise ValueError(f"need 1 <= k <= k_prime <= vocabulary size, got {k}, {k_prime}, {vocab_size}")
    if start is None:
        start = gaussian_matrix(tokens.sparkSession, vocab_size, k_prime, seed)
    if len(matrix_columns(start, "o")) != k_prime:
        raise ValueError(f"the start matrix must have {k_prime} columns")
    start = materialize(start, "start")
    first = corrected_sketch(tokens, start, alpha0, n_docs, vocab_size, routes)
    basis = orthonormalize(first, "y").toDF("word_id", *named("o", k_prime))
    basis = materialize(every_word(basis, vocab_size), "basis")
    second = corrected_sketch(tokens, basis, alpha0, n_docs, vocab_size, routes)
    model, sigma = spectral_factor(second, "y", k)
    return materialize(every_word(model, vocab_size), "model"), sigma


def project_and_contract(
    tokens: DataFrame,
    model: DataFrame,
    sigma: np.ndarray,
    alpha0: float,
    n_docs: int,
    vocab_size: int,
    variant: str = "reference",
    routes: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The third-moment tensor ``(i, j, l, val)`` and the projection matrix it was taken with.

    ``reference`` divides the projected documents by sigma and corrects repeated words in projected
    coordinates; ``whitened`` projects with model/sigma² and corrects them in word space.
    """
    if variant not in VARIANTS:
        raise ValueError(f"variant must be one of {VARIANTS}")
    if not (np.asarray(sigma) > 0).all():
        raise ValueError(f"sigma {sigma} is not positive; use a smaller k")
    divisors = ridged(sigma) if variant == "reference" else np.asarray(sigma) ** 2
    cols = matrix_columns(model, "o")
    scaled = model.select("word_id", *[(F.col(c) / F.lit(float(s))).alias(c) for c, s in zip(cols, divisors)])
    if variant == "whitened":
        scaled = materialize(scaled, "whitener")
    # Stored: the sums may read it once for each range of the tensor.
    proj = materialize(project_docs(tokens, scaled, rows=vocab_size, routes=routes), "projected")
    sums = materialize(third_moment_sums(proj, alpha0), "sums")
    m1 = first_moment_of_sums(sums, len(cols), n_docs)
    if variant == "reference":
        return third_moment(sums, m1, alpha0), model
    words = materialize(word_corrections(tokens, scaled, alpha0, rows=vocab_size, routes=routes), "words")
    return whitened_third_moment(sums, word_correction_sums(words, scaled), m1, alpha0), scaled


def fit(
    docs: DataFrame,
    tokens: DataFrame,
    k: int,
    k_prime: int,
    alpha0: float,
    vocab_size: int | None = None,
    rho: float = 0.0,
    tol: float = 1e-4,
    max_iter: int = 0,
    partitions: int | None = None,
    seed: int = SEED,
    variant: str = "reference",
    start: DataFrame | None = None,
    als_start: tuple[DataFrame, DataFrame] | None = None,
    iterations: int | None = 20,
    hard_cap: int | None = None,
) -> TopicModel:
    """Fit a topic model to ``docs(doc_id)`` and ``tokens(doc_id, word_id, cnt)``.

    ``vocab_size`` defaults to the largest word id + 1; a word id outside it fails the job, and so do
    repeated document ids. ``hard_cap`` bounds a decomposition that would run until it converges.
    ``start`` and ``als_start`` replace the seeded random starts. ``iterations`` is the number of
    ADMM rounds in recovery (None: exact projection).

    Inside a ``Scratch`` of a name a fit that broke off goes on from its last finished table; one of other settings,
    documents or tokens raises. Use the model inside it.
    """
    spark = tokens.sparkSession
    n_docs = count_documents(docs)
    if vocab_size is None:
        vocab_size = int(tokens.agg(F.max("word_id")).first()[0]) + 1
    if run := current_run():
        # Equal whatever the order of the tokens, and exact.
        digest = tokens.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("doc_id", "word_id", "cnt")), F.sum(F.xxhash64("doc_id", "word_id", "cnt").cast("decimal(38,0)"))).first()
        run.expect({
            "k": k, "k_prime": k_prime, "alpha0": alpha0, "vocab_size": vocab_size, "rho": rho, "tol": tol, "max_iter": max_iter,
            "seed": seed, "variant": variant, "iterations": iterations, "hard_cap": hard_cap, "started": [start is not None, als_start is not None],
            "n_docs": n_docs, "tokens": [str(v) for v in digest],
        })
    with held_blocks(check_word_ids(tokens, vocab_size), vocab_size, k_prime, partitions) as (corpus, routes):
        model, sigma = whiten(corpus, n_docs, vocab_size, k, k_prime, alpha0, seed, start, routes)
        tensor, projection = project_and_contract(corpus, model, sigma, alpha0, n_docs, vocab_size, variant, routes)
        cp = cp_als(
            tensor, k, tol, max_iter, rho, start=als_start, symmetric=True, shape=(k, k, k), hard_cap=hard_cap
        )
        factors = unwhiten(projection, factor_array(cp.a, k), cp.lambdas)
        factors = materialize(factors, "factors")
    weights = [(t, float(v)) for t, v in enumerate(cp.lambdas)]
    alpha = dirichlet_prior(spark.createDataFrame(weights, "topic int, lambda double"), alpha0)
    topics = recover_topics(factors, iterations)
    return TopicModel(alpha, topics, sigma, cp.lambdas, n_docs, cp.n_iter, cp.converged)
