import itertools

import numpy as np
import pytest
from brute import admm, corrected, counts, matrix, projected_tensor
from pyspark.errors import PySparkException
from test_tensor import factor, gram_schmidt, reference_als

from spectral_topics import fit
from spectral_topics.__main__ import main
from spectral_topics.functions.storage import Scratch, materialize, shared_folder
from spectral_topics.operators.corpus import block_tokens, doc_terms
from spectral_topics.plans import model as plans
from spectral_topics.plans.model import whiten


def lda(n, d, alpha, seed=0):
    rng = np.random.default_rng(seed)
    topics = rng.dirichlet(np.full(d, 0.1), size=len(alpha))
    rows = []
    for doc in range(n):
        mix = rng.dirichlet(alpha) @ topics
        words = rng.multinomial(rng.integers(1, 40), mix / mix.sum())
        rows += [(doc, int(w), float(words[w])) for w in np.flatnonzero(words)]
    return rows, topics.T


@pytest.fixture(scope="module")
def data(spark):
    rows, topics = lda(6000, 40, (0.5, 0.3, 0.2))
    docs = spark.range(6000).withColumnRenamed("id", "doc_id").persist()
    tokens = spark.createDataFrame(rows, "doc_id long, word_id long, cnt double").persist()
    return docs, tokens, rows, topics


def dense(beta, d, k):
    out = np.full((d, k), np.nan)
    for w, t, p in beta.select("word_id", "topic", "prob").collect():
        out[w, t] = p
    return out


def start_model(spark, d, width):
    values = np.sin((np.arange(d)[:, None] + 1) * (1.3 + 0.7 * np.arange(width)))
    columns = ", ".join(f"o{j} double" for j in range(width))
    return values, spark.createDataFrame([(w, *map(float, v)) for w, v in enumerate(values)], f"word_id long, {columns}")


def numpy_whiten(c, start, k, alpha0):
    y = corrected(c, gram_schmidt(corrected(c, start, alpha0)), alpha0)
    values, vectors = np.linalg.eigh(y.T @ y)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    sigma = np.maximum(values, 0) ** 0.25
    model = y @ vectors / (sigma + 1e-12)
    return model * np.sign(model[0]), sigma


def test_whiten(spark, data):
    _, tokens, rows, _ = data
    c = counts(rows, 6000, 40)
    values, start = start_model(spark, 40, 5)
    model, sigma = whiten(block_tokens(tokens), 6000, 40, 3, 5, 1.0, start=start)
    expected, scales = numpy_whiten(c, values, 3, 1.0)
    np.testing.assert_allclose(sigma, scales, rtol=1e-8)
    np.testing.assert_allclose(matrix(model, "o"), expected, atol=1e-8)


def test_fit_equals_the_formulas(spark, data):
    """Every stage in numpy, document by document."""
    docs, tokens, rows, _ = data
    c = counts(rows, 6000, 40)
    k, alpha0 = 3, 1.0
    values, start = start_model(spark, 40, 5)
    rng = np.random.default_rng(3)
    b, cc = gram_schmidt(rng.normal(size=(k, k))), gram_schmidt(rng.normal(size=(k, k)))
    found = fit(docs, tokens, k, 5, alpha0, vocab_size=40, max_iter=4, start=start, als_start=(factor(spark, b), factor(spark, cc)))

    model, sigma = numpy_whiten(c, values, k, alpha0)
    x, lengths = c @ model / (sigma + 1e-6 * sigma[0]), c.sum(axis=1)
    m1 = (x / np.maximum(lengths, 1)[:, None]).mean(axis=0)
    factors, norms, _ = reference_als(projected_tensor(x, lengths, m1, alpha0), b, cc, 1e-4, 4)
    a = factors[0].copy()
    for r in range(k):
        signs = [np.sign(f[0, r]) for f in factors]
        if signs[0] == signs[2] != signs[1]:
            a[:, r] = factors[1][:, r]
        elif signs[0] == signs[1] != signs[2]:
            a[:, r] = factors[2][:, r]
    f = model @ np.linalg.solve(model.T @ model, a * norms)
    expected = np.zeros_like(f)
    for t, col in enumerate(f.T):
        plus, minus = admm(col, 20), admm(-col, 20)
        expected[:, t] = plus if np.linalg.norm(plus - col) < np.linalg.norm(minus + col) else minus
    np.testing.assert_allclose(found.lambdas, norms, rtol=1e-6)
    np.testing.assert_allclose(dense(found.beta, 40, k), expected, atol=1e-7)
    prior = norms**-2 / (norms**-2).sum() * alpha0
    assert [r["value"] for r in found.alpha.orderBy("topic").collect()] == pytest.approx(list(prior), rel=1e-6)


def test_whitened_variant_recovers_the_topics(spark, data):
    docs, tokens, _, topics = data
    found = fit(docs, tokens, 3, 6, 1.0, vocab_size=40, variant="whitened")
    beta = dense(found.beta, 40, 3)
    np.testing.assert_allclose(beta.sum(axis=0), 1)
    assert (beta >= 0).all() and found.converged
    error = min(np.abs(beta[:, list(p)] - topics).sum(axis=0).mean() for p in itertools.permutations(range(3)))
    assert error < 0.12
    alpha = sorted((r["value"] for r in found.alpha.collect()), reverse=True)
    assert sum(alpha) == pytest.approx(1.0) and alpha == pytest.approx([0.5, 0.3, 0.2], abs=0.08)


def test_duplicates_partitions_and_unseen_words_change_nothing(spark, data):
    docs, tokens, rows, _ = data
    _, start = start_model(spark, 45, 4)
    halves = tokens.withColumn("cnt", tokens.cnt / 2)
    settings = dict(k=2, k_prime=4, alpha0=1.0, vocab_size=45, max_iter=1, start=start)
    one = dense(fit(docs, tokens, **settings).beta, 45, 2)
    two = dense(fit(docs, halves.unionByName(halves), partitions=7, **settings).beta, 45, 2)
    assert not np.isnan(one).any()
    np.testing.assert_allclose(one, two, atol=1e-8)


def test_arguments(spark, data):
    docs, tokens, _, _ = data
    with pytest.raises(ValueError, match="k_prime"):
        fit(docs, tokens, 5, 4, 1.0, vocab_size=40)
    with pytest.raises(ValueError, match="k_prime"):
        fit(docs, tokens, 3, 41, 1.0, vocab_size=40)
    with pytest.raises(PySparkException, match="outside 0..9"):
        fit(docs, tokens, 2, 3, 1.0, vocab_size=10)
    with pytest.raises(ValueError, match="variant"):
        fit(docs, tokens, 2, 3, 1.0, vocab_size=40, variant="other")


def test_command_line(spark, data, tmp_path):
    _, _, rows, _ = data
    lines = {}
    for doc, word, cnt in rows[:9000]:
        lines.setdefault(doc, []).append(f"{word}:{cnt:g}")
    source = tmp_path / "bow.txt"
    source.write_text("\n".join(f"{d} {len(p)} {' '.join(p)}" for d, p in lines.items()) + "\n99999 0\n")
    out = tmp_path / "model"
    main(["--input", str(source), "--output", str(out), "--d", "40", "--k", "2", "--kprime", "4", "--alpha0", "1", "--max_iterations", "3", "--partitions", "3"])

    def text(suffix):
        return [l.split("\t") for p in sorted(tmp_path.glob(f"model.{suffix}/part-*")) for l in p.read_text().splitlines()]

    alpha, beta = text("alpha"), text("beta")
    assert [row[0] for row in alpha] == ["0", "1"] and sum(float(r[1]) for r in alpha) == pytest.approx(1, abs=1e-5)
    assert [row[0] for row in beta] == [str(w) for w in range(40)]
    assert np.array([r[1:] for r in beta], dtype=float).sum(axis=0) == pytest.approx([1, 1], abs=1e-4)


def test_merged_tokens_equal_raw_tokens(spark, data):
    _, tokens, rows, _ = data
    assert doc_terms(tokens).count() == len(rows)


def test_a_broken_fit_goes_on(spark, monkeypatch):
    """Lost after whitening: the second attempt reads what was finished, gives the same model, and leaves no table."""
    rows, _ = lda(300, 12, (0.5, 0.3), seed=4)
    docs = spark.range(300).withColumnRenamed("id", "doc_id")
    tokens = spark.createDataFrame(rows, "doc_id long, word_id long, cnt double")
    settings = {"k": 2, "k_prime": 3, "alpha0": 0.8, "vocab_size": 12, "max_iter": 3}
    expected = dense(fit(docs, tokens, **settings).beta, 12, 2)

    def lost(*_):
        raise ConnectionError("driver lost")

    with monkeypatch.context() as patch:
        patch.setattr(plans, "third_moment_sums", lost)
        with pytest.raises(ConnectionError), Scratch(spark, "broken") as first:
            fit(docs, tokens, **settings)
    assert first.stored == 6 and first.reused == 0
    with pytest.raises(ValueError, match="other settings"), Scratch(spark, "broken"):
        fit(docs, tokens, **(settings | {"alpha0": 0.9}))
    with pytest.raises(ValueError, match="other settings"), Scratch(spark, "broken"):
        fit(docs, tokens.union(tokens.limit(1)), **settings)
    with Scratch(spark, "broken") as second:
        found = dense(fit(docs, tokens.repartition(3), **settings).beta, 12, 2)
    assert second.reused == 6 and second.stored > 6
    np.testing.assert_allclose(found, expected, atol=1e-9)
    path, files = second._at(shared_folder(spark))
    assert not [s for s in files.listStatus(path) if "run-broken" in s.getPath().getName()]


def test_an_unfinished_table_is_computed_again(spark):
    table = spark.range(5)
    with pytest.raises(KeyError), Scratch(spark, "half") as run:
        materialize(table, "numbers")
        marker, files = run._at(f"{run.folder}/0001-numbers/_SUCCESS")
        files.delete(marker, False)
        raise KeyError
    with Scratch(spark, "half") as again:
        assert materialize(table, "numbers").count() == 5 and again.reused == 0
        with pytest.raises(RuntimeError, match="open already"), Scratch(spark):
            pass
        assert materialize(table, "numbers").count() == 5 and again.stored == 2
    assert materialize(table, "numbers").count() == 5
