import itertools
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from brute import corrected, counts, matrix, pair_sketch, projected_tensor, word_corrected_tensor
from pyspark.errors import PySparkException

from spectral_topics.functions import segments
from spectral_topics.operators import corpus, linalg, moments

TOKENS = [(1, 0, 2.0), (1, 1, 1.0), (2, 1, 2.0), (2, 2, 2.0), (3, 0, 1.0), (5, 0, 1.0), (5, 2, 1.0)]
OMEGA = [(0, 1.0, 0.0), (1, 0.0, 1.0), (2, 1.0, 1.0)]


@pytest.fixture
def mini(spark):
    tokens = spark.createDataFrame(TOKENS, "doc_id long, word_id long, cnt double")
    return tokens, spark.createDataFrame(OMEGA, "word_id long, o0 double, o1 double")


def frac(*texts):
    return [float(Fraction(t)) for t in texts]


def test_worked_example_pair_moment(mini):
    tokens, model = mini
    sketch = moments.pair_moment_sketch(tokens, model)
    found = {r["word_id"]: (r["mu_sum"], r["y0"], r["y1"]) for r in sketch.collect()}
    assert found[0] == pytest.approx(frac("7/6", "5/6", "5/6"))
    assert found[1] == pytest.approx(frac("5/6", "2/3", "1/2"))
    assert found[2] == pytest.approx(frac("1", "2/3", "1/2"))
    y = matrix(moments.correct_pair_moment(sketch, model, 1.0, 5), "y")
    assert y.ravel() == pytest.approx(frac("209/900", "223/900", "7/36", "5/36", "9/50", "19/150"))


def test_worked_example_third_moment(mini):
    tokens, model = mini
    proj = moments.project_docs(tokens, model)
    m1 = [v for _, v in sorted(moments.first_moment(proj, 5).collect())]
    assert m1 == pytest.approx(frac("19/30", "11/30"))
    t = tensor(moments.third_moment(moments.third_moment_sums(proj, 1.0), m1, 1.0), 2)
    expected = frac("3473/3375", "2849/6750", "24349/27000", "53981/27000")
    for index in itertools.product(range(2), repeat=3):
        assert t[index] == pytest.approx(expected[sum(index)])


def test_no_long_document(spark, mini):
    tokens, model = mini
    short = tokens.where("doc_id > 2")
    with pytest.raises(ValueError, match="three words"):
        moments.third_moment(moments.third_moment_sums(moments.project_docs(short, model), 1.0), [0.1, 0.1], 1.0)


def test_word_without_model_row(mini):
    tokens, model = mini
    with pytest.raises(PySparkException, match="no row in the model"):
        moments.pair_moment_sketch(tokens, model.where("word_id < 2")).collect()


def tensor(cells, k):
    out = np.full((k, k, k), np.nan)
    for i, j, l, val in cells.select("i", "j", "l", "val").collect():
        out[i, j, l] = val
    return out


class Corpus:
    """A random corpus with an empty, a one-word and a two-word document, and one large document."""

    def __init__(self, spark, width, d=24, n=60):
        rng = np.random.default_rng(5)
        self.d, self.n = d, n
        lengths = rng.integers(3, 15, n)
        lengths[:3] = 0, 1, 2
        self.rows = [(doc, int(w), 1.0) for doc in range(n) for w in rng.integers(0, d - 1, lengths[doc])]
        self.rows += [(n - 1, int(w), 1.0) for w in rng.integers(0, d - 1, 400)]
        self.c = counts(self.rows, n, d)
        self.model = rng.normal(size=(d, width))
        self.tokens = spark.createDataFrame(self.rows, "doc_id long, word_id long, cnt double")
        columns = ", ".join(f"o{j} double" for j in range(width))
        self.table = spark.createDataFrame([(w, *map(float, v)) for w, v in enumerate(self.model)], f"word_id long, {columns}")


@pytest.fixture(params=["plain", "spread", "gathered", "spread and gathered"])
def layout(request, spark):
    """Tokens as they come, with the large document spread, with the model too large to broadcast, both."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if "gathered" in request.param:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    hot = 100 if "spread" in request.param else None
    yield lambda tokens: corpus.block_tokens(tokens, min_hot_rows=hot) if hot else tokens
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_every_layout_gives_the_same_moments(spark, layout):
    data = Corpus(spark, 3)
    tokens = layout(data.tokens)
    y, mu = pair_sketch(data.c, data.model)
    sketch = moments.pair_moment_sketch(tokens, data.table)
    np.testing.assert_allclose(matrix(sketch, "y", rows=data.d), y, atol=1e-12)
    found = {r["word_id"]: r["mu_sum"] for r in sketch.collect()}
    assert all(found.get(w, 0.0) == pytest.approx(v, abs=1e-12) for w, v in enumerate(mu))
    np.testing.assert_allclose(
        matrix(moments.correct_pair_moment(sketch, data.table, 0.7, data.n), "y", rows=data.d),
        corrected(data.c, data.model, 0.7),
        atol=1e-12,
    )
    x = matrix(moments.project_docs(tokens, data.table), "x", "doc_id", data.n)
    np.testing.assert_allclose(x, data.c @ data.model, atol=1e-10)
    raw = {r[0]: r[1] for r in moments.mean_frequency(tokens, data.n, min_len=1).collect()}
    lengths = data.c.sum(axis=1, keepdims=True)
    expected = np.divide(data.c, lengths, out=np.zeros_like(data.c), where=lengths > 0).mean(axis=0)
    assert all(raw.get(w, 0.0) == pytest.approx(v, abs=1e-12) for w, v in enumerate(expected))


def moved_caches(df):
    """How many persisted tables ``df`` reads, and how many of them it shuffled before a join or sum, as it ran."""
    df.collect()
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n+- == Initial Plan ==")[0].splitlines()
    read = moved = 0
    for at, line in enumerate(lines):
        if "TableCacheQueryStage" in line:
            last = max(i for i in range(at) if "Join" in lines[i] or "Aggregate" in lines[i])
            read += 1
            moved += any("Exchange" in between for between in lines[last:at])
    return read, moved


@pytest.mark.parametrize("hot", [None, 100])
def test_routes_give_the_same_without_moving_tokens(spark, no_broadcast, hot):
    """With routes kept, a pass shuffles only the model, its rows to the blocks, and the sums per word."""
    data = Corpus(spark, 3)
    tokens = corpus.block_tokens(data.tokens, min_hot_rows=hot).persist()
    routes = moments.word_routes(tokens).persist()
    assert {r["word_id"]: r["blocks"] for r in routes.collect()} == {
        w: sorted({r["block"] for r in tokens.where(tokens["word_id"] == w).collect()}) for w in {r["word_id"] for r in tokens.collect()}
    }
    y, _ = pair_sketch(data.c, data.model)
    sketch = moments.pair_moment_sketch(tokens, data.table, rows=data.d, routes=routes)
    np.testing.assert_allclose(matrix(sketch, "y", rows=data.d), y, atol=1e-12)
    x = matrix(moments.project_docs(tokens, data.table, routes=routes), "x", "doc_id", data.n)
    np.testing.assert_allclose(x, data.c @ data.model, atol=1e-10)
    if hot is None:
        found = moments.project_docs(tokens, data.table, rows=data.d, routes=routes)
        read, moved = moved_caches(found)
        assert read >= 2 and moved == 0
    routes.unpersist()
    tokens.unpersist()


def test_alpha0_zero_still_divides_by_documents(spark):
    data = Corpus(spark, 2)
    found = moments.correct_pair_moment(moments.pair_moment_sketch(data.tokens, data.table), data.table, 0.0, data.n)
    np.testing.assert_allclose(matrix(found, "y", rows=data.d), pair_sketch(data.c, data.model)[0] / data.n, atol=1e-12)


@pytest.mark.parametrize("k, constant_cells", [(2, moments.CONSTANT_CELLS), (4, 0), (11, moments.CONSTANT_CELLS)])
def test_third_moment_against_documents(spark, monkeypatch, k, constant_cells):
    monkeypatch.setattr(moments, "CONSTANT_CELLS", constant_cells)
    data = Corpus(spark, k)
    x, lengths = data.c @ data.model, data.c.sum(axis=1)
    m1 = np.divide(x, lengths[:, None], out=np.zeros_like(x), where=lengths[:, None] > 0).mean(axis=0)
    proj = moments.project_docs(data.tokens, data.table)
    assert [v for _, v in sorted(moments.first_moment(proj, data.n).collect())] == pytest.approx(list(m1))
    sums = moments.third_moment_sums(proj, 0.8)
    np.testing.assert_allclose(moments.first_moment_of_sums(sums, k, data.n), m1, atol=1e-12)
    t = tensor(moments.third_moment(sums, m1, 0.8), k)
    np.testing.assert_allclose(t, projected_tensor(x, lengths, m1, 0.8), atol=1e-9)
    for axes in itertools.permutations(range(3)):
        np.testing.assert_allclose(t, t.transpose(axes), atol=1e-12)


def test_word_corrected_third_moment_in_every_layout(spark, layout):
    check_word_corrected(spark, layout, 2)


def test_word_corrected_third_moment_in_numpy(spark):
    check_word_corrected(spark, lambda tokens: tokens, 9)


def check_word_corrected(spark, layout, k):
    data = Corpus(spark, k)
    tokens = layout(data.tokens)
    x, lengths = data.c @ data.model, data.c.sum(axis=1)
    m1 = np.divide(x, lengths[:, None], out=np.zeros_like(x), where=lengths[:, None] > 0).mean(axis=0)
    sums = moments.third_moment_sums(moments.project_docs(tokens, data.table), 0.8)
    words = moments.word_corrections(tokens, data.table, 0.8)
    t = tensor(moments.whitened_third_moment(sums, moments.word_correction_sums(words, data.table), m1, 0.8), k)
    np.testing.assert_allclose(t, word_corrected_tensor(data.c, data.model, m1, 0.8), atol=1e-9)


def test_partial_tensors_in_slices(spark, monkeypatch):
    """A tensor larger than a worker's memory is built in ranges of its first index."""
    data = Corpus(spark, 11)
    proj = moments.project_docs(data.tokens, data.table)
    whole = {tuple(r)[:4]: r[4] for r in moments.third_moment_sums(proj, 0.8).collect()}
    monkeypatch.setattr(moments, "TENSOR_BYTES", 8 * 130)
    monkeypatch.setattr(moments, "CHUNK_CELLS", 50)
    sliced = {tuple(r)[:4]: r[4] for r in moments.third_moment_sums(proj, 0.8).collect()}
    assert len(moments._row_ranges(11)) == 3
    assert whole.keys() == sliced.keys() and all(sliced[c] == pytest.approx(v) for c, v in whole.items())


def test_merging_and_repartitioning_change_nothing(spark):
    data = Corpus(spark, 3)
    base = matrix(moments.pair_moment_sketch(data.tokens, data.table), "y", rows=data.d)
    for tokens in (corpus.doc_terms(data.tokens), data.tokens.repartition(7)):
        np.testing.assert_allclose(matrix(moments.pair_moment_sketch(tokens, data.table), "y", rows=data.d), base, atol=1e-12)


def test_scaling_the_model_equals_scaling_the_projection(spark):
    data = Corpus(spark, 3)
    sigma = np.array([2.0, 1.0, 0.5])
    folded = moments.project_docs(data.tokens, data.table, linalg.ridged(sigma))
    after = linalg.scale_projection(moments.project_docs(data.tokens, data.table), sigma)
    np.testing.assert_allclose(matrix(folded, "x", "doc_id"), matrix(after, "x", "doc_id"), atol=1e-10)
    np.testing.assert_allclose(matrix(after, "x", "doc_id"), data.c @ data.model / (sigma + 2e-6), atol=1e-9)


def test_sum_of_matrices(spark):
    a = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "row_id long, vec array<double>")
    b = spark.createDataFrame([(1, [10.0, 20.0]), (2, [5.0, 6.0])], "row_id long, vec array<double>")
    found = {r[0]: r[1] for r in moments.sum_matrices(a, b).collect()}
    assert found == {0: [1.0, 2.0], 1: [13.0, 24.0], 2: [5.0, 6.0]}


def test_wide_third_moment_adds_dense_chunks(spark, monkeypatch):
    """k = 40 with chunks of 1,000 cells: one scan and one shuffle, whose rows are chunks and not cells."""
    k, n, alpha0 = 40, 500, 0.8
    monkeypatch.setattr(moments, "CHUNK_CELLS", 1000)
    rng = np.random.default_rng(3)
    x, lengths = rng.normal(size=(n, k)), rng.integers(0, 9, n).astype(float)
    columns = ", ".join(f"x{j} double" for j in range(k))
    proj = spark.createDataFrame([(d, float(lengths[d]), *map(float, x[d])) for d in range(n)], f"doc_id long, len double, {columns}").repartition(3)
    sums = moments.third_moment_sums(proj, alpha0)
    plan = sums._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 2 and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    assert moments._row_ranges(300) == [(0, 300)] and len(moments._row_ranges(1000)) > 1
    found = {tuple(r)[:4]: r[4] for r in sums.collect()}
    used = lengths >= 3
    u, size = x[used], lengths[used]
    s2, s3 = alpha0 * (alpha0 + 1) / (2 * size * (size - 1)), (alpha0 + 1) * (alpha0 + 2) / (2 * size * (size - 1) * (size - 2))
    cube = np.einsum("d,di,dj,dl->ijl", s3, u, u, u)
    cells = {("c3", i, j, m) for i in range(k) for j in range(i, k) for m in range(j, k)}
    assert {c for c in found if c[0] == "c3"} == cells
    np.testing.assert_allclose([found[c] for c in sorted(cells)], [cube[c[1:]] for c in sorted(cells)], atol=1e-12)
    pair = np.einsum("d,di,dj->ij", s2, u, u)
    assert all(found["p2", i, j, -1] == pytest.approx(pair[i, j], abs=1e-12) for i in range(k) for j in range(i, k))
    assert found["n3", -1, -1, -1] == used.sum() and found["h1", 7, -1, -1] == pytest.approx(s2 @ u[:, 7])


def test_wide_models_give_the_same_as_narrow_ones(spark, layout, monkeypatch):
    """Sums as numpy segments, in every layout; with pieces of ten rows documents cross pieces and sums are sent on early."""
    data = Corpus(spark, 4)
    narrow = [
        matrix(f(layout(data.tokens)), prefix, key)
        for f, prefix, key in (
            (lambda t: moments.pair_moment_sketch(t, data.table), "y", "word_id"),
            (lambda t: moments.word_corrections(t, data.table, 0.8), "z", "word_id"),
            (lambda t: moments.project_docs(t, data.table), "x", "doc_id"),
        )
    ]
    scalars = sorted(tuple(r) for r in moments.word_corrections(layout(data.tokens), data.table, 0.8).select("word_id", "f", "h").collect())
    monkeypatch.setattr(moments, "MAX_MODEL_COLUMNS", 3)
    monkeypatch.setattr(segments, "PIECE_CELLS", 40)
    monkeypatch.setattr(segments, "HELD_CELLS", 80)
    tokens = layout(data.tokens)
    sketch = moments.pair_moment_sketch(tokens, data.table)
    plan = sketch._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan
    np.testing.assert_allclose(matrix(sketch, "y"), narrow[0], atol=1e-12)
    mu = pair_sketch(data.c, data.model)[1]
    assert all(r["mu_sum"] == pytest.approx(mu[r["word_id"]], abs=1e-12) for r in sketch.collect())
    corrections = moments.word_corrections(tokens, data.table, 0.8)
    np.testing.assert_allclose(matrix(corrections, "z"), narrow[1], atol=1e-12)
    np.testing.assert_allclose(np.array(sorted(tuple(r) for r in corrections.select("word_id", "f", "h").collect())), np.array(scalars), atol=1e-12)
    projected = moments.project_docs(tokens, data.table)
    np.testing.assert_allclose(matrix(projected, "x", "doc_id"), narrow[2], atol=1e-10)
    lengths = data.c.sum(axis=1)
    assert all(r["len"] == lengths[r["doc_id"]] for r in projected.collect())


def test_wide_models_refuse_unknown_words_and_take_empty_tables(spark, mini, monkeypatch):
    monkeypatch.setattr(moments, "MAX_MODEL_COLUMNS", 1)
    tokens, model = mini
    for bad in (model.where("word_id < 2"), model.where("word_id > 0")):
        with pytest.raises(PySparkException, match="no row in the model"):
            moments.pair_moment_sketch(tokens, bad).collect()
        with pytest.raises(PySparkException, match="no row in the model"):
            moments.project_docs(tokens, bad).collect()
    none = tokens.where("doc_id > 99")
    assert moments.pair_moment_sketch(none, model).collect() == [] and moments.project_docs(none, model).collect() == []


def test_documents_that_were_torn_apart_fail(spark):
    rows = [(d, 2, w, 1.0, 1.0, 1.0, [1.0, 2.0]) for w in range(2) for d in range(3)]
    tokens = spark.createDataFrame(rows, "doc_id long, n long, word_id long, cnt double, w0 double, scale double, vec array<double>").coalesce(1)
    with pytest.raises(PySparkException, match="not together"):
        segments.words_of_documents(tokens, ["w0", "scale"], ["s"], 2).collect()
    found = segments.words_of_documents(tokens.sortWithinPartitions("doc_id"), ["w0", "scale"], ["s"], 2)
    assert {r["word_id"]: (r["s"], r["vec"]) for r in found.collect()} == {w: (3.0, [6.0, 12.0]) for w in range(2)}


def test_stretches_of_keys():
    assert segments._heads(pa.array([None, None, 1, 1, None, 2])).tolist() == [0, 2, 4, 5]
    assert segments._heads(pa.array(["a"])).tolist() == [0]
