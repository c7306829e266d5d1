"""First, second and third moments of the corpus as joins and group-bys."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectral_topics.functions.batches import merge_small_partitions, numpy_batches
from spectral_topics.functions.blocks import document_totals, word_totals
from spectral_topics.functions.columns import CONSTANT_CELLS, constants, literal, matrix_columns, named, row_to_cells
from spectral_topics.functions.segments import SPLIT, sum_by_key, sum_sorted, vec_cells, words_of_documents, words_of_vectors
from spectral_topics.functions.skew import fits_broadcast, skew_safe_join
from spectral_topics.functions.storage import materialize
from spectral_topics.operators.corpus import (
    block_count,
    block_tokens,
    dirichlet_weights,
    document_sums,
    join_document_sums,
    pair_weight,
)
from spectral_topics.operators.linalg import MAX_SUM_COLUMNS

# Memory for one partial tensor in a Python worker.
TENSOR_BYTES = 256 << 20
# Wider models are carried as one array and added up in numpy (functions/segments.py).
MAX_MODEL_COLUMNS = 100
# Narrower models that are fetched by block are added up in numpy there (functions/blocks.py).
MAX_BLOCK_COLUMNS = 32
# Cells of a partial tensor in one row of the shuffle that adds them up.
CHUNK_CELLS = 1 << 17


def lookup_model(
    tokens: DataFrame, model: DataFrame, rows: int | None = None, routes: DataFrame | None = None, width: int | None = None
) -> DataFrame:
    """Attach row ``word_id`` of the model (columns o0, o1, ...) to every token, all its rows and columns kept.

    A model within the broadcast limit is broadcast and the tokens do not move. A larger one is
    fetched by the blocks of blocked tokens, and joined by a shuffle with others, rows of hot words
    spread. ``rows`` is its row count if known. ``routes`` are the ``word_routes`` of blocked tokens, for callers that
    look up several models. ``width`` says how many numbers a model row has if o0 is an array of them all.
    A word without a model row fails the job.
    """
    cols = matrix_columns(model, "o")
    width = width or len(cols)
    model = model.select("word_id", *cols)
    rows = model.count() if rows is None else rows
    if fits_broadcast(tokens.sparkSession, rows, width):
        found = tokens.join(F.broadcast(model), "word_id", "left")
    elif "block" in tokens.columns:
        found = _gather_model(tokens, model, cols, routes)
    else:
        spread_by = F.struct(*[c for c in tokens.columns if c != "word_id"])
        found = skew_safe_join(tokens, model, "word_id", rows, width, spread_by, how="left")
    missing = F.raise_error(F.concat(F.lit("no row in the model for word id "), F.coalesce(F.col("word_id").cast("string"), F.lit("null"))))
    return found.select(*tokens.columns, F.coalesce("o0", missing.cast(model.schema["o0"].dataType)).alias("o0"), *cols[1:])


def word_routes(tokens: DataFrame) -> DataFrame:
    """``(word_id, blocks)``: the blocks of blocked tokens that use each word, ascending.

    Partitioned by word. Persist it when several models are looked up: each then goes through one shuffle by word
    and one to the blocks, and nothing is shuffled, sorted or made distinct on the side of the tokens.
    """
    used = tokens.select("block", "word_id").distinct()
    return used.groupBy("word_id").agg(F.array_sort(F.collect_list("block")).alias("blocks"))


def _gather_model(tokens: DataFrame, model: DataFrame, cols: Sequence[str], routes: DataFrame | None) -> DataFrame:
    """Bring each model row once to every block that uses the word.

    Tokens stay in their blocks: only the words of a block go out (or have gone, with ``routes``) and their model rows
    come back, one per block and word however often the word occurs. A word is asked for at most
    once per block, so no join key is hot.
    """
    return tokens.join(_fetched(tokens, model, cols, routes), ["block", "word_id"], "left")


def _fetched(tokens: DataFrame, model: DataFrame, cols: Sequence[str], routes: DataFrame | None) -> DataFrame:
    """``(block, word_id, cols...)``: the model rows of each block's words, partitioned as the blocks are."""
    if routes is None:
        needed = tokens.select("block", "word_id").distinct().join(model, "word_id", "left")
    else:
        needed = routes.join(model, "word_id").withColumn("block", F.explode("blocks"))
    return needed.select("block", "word_id", *cols).repartitionById(block_count(tokens), "block")


def _block_models(
    tokens: DataFrame, model: DataFrame, cols: Sequence[str], rows: int | None, routes: DataFrame | None
) -> tuple[DataFrame, DataFrame] | None:
    """Blocked tokens and the model rows of each block, if that is how sums are to be made.

    None if the model can be broadcast, or is wide, or if documents are spread over blocks.
    """
    if len(cols) > MAX_BLOCK_COLUMNS:
        return None
    rows = model.count() if rows is None else rows
    if fits_broadcast(tokens.sparkSession, rows, len(cols)):
        return None
    blocked = block_tokens(tokens)
    if "spread" in blocked.columns:
        return None
    return blocked, _fetched(blocked, model.select("word_id", *cols), cols, routes)


def _projection_sums(cols: Sequence[str]) -> dict:
    sums = {f"x{j}": F.sum(F.col("cnt") * F.col(c)) for j, c in enumerate(cols)}
    return {"len": F.sum("cnt"), **sums}


def pair_moment_sketch(
    tokens: DataFrame, model: DataFrame, rows: int | None = None, routes: DataFrame | None = None
) -> DataFrame:
    """``(word_id, mu_sum, y0, ...)`` for every word of a document of two words or more.

    y_w = sum over documents of c/(len(len-1)) (x - model_w), x being the projected document,
    which is the pair moment times the model; mu_sum = sum of c/len comes out of the same pass.
    The word's own model row is subtracted after the group-by, once per word.
    """
    cols = matrix_columns(model, "o")
    if len(cols) > MAX_MODEL_COLUMNS:
        pair = pair_weight(F.col("len"))
        weights = {"mu_sum": F.when(F.col("len") >= 2, 1.0 / F.col("len")), "own": pair}
        summed = _wide_word_sums(tokens, model, weights, pair, rows, routes)
        return summed.join(model.select("word_id", *cols), "word_id").select(
            "word_id",
            "mu_sum",
            *[(x - F.col("own") * F.col(c)).alias(f"y{j}") for j, (x, c) in enumerate(zip(vec_cells(len(cols)), cols))],
        )
    xs = named("x", len(cols))

    def weigh(per_doc: DataFrame) -> DataFrame:
        weight = pair_weight(F.col("len"))
        return per_doc.where(F.col("len") >= 2).select(
            "block", "doc_id", "len", weight.alias("pair"), *[(F.col(x) * weight).alias(x) for x in xs]
        )

    if in_blocks := _block_models(tokens, model, cols, rows, routes):
        def weights(length: np.ndarray) -> list[np.ndarray]:
            pair = 1.0 / (length * (length - 1.0))
            return [1.0 / length, pair, pair]

        partial = word_totals(*in_blocks, cols, ("mu_sum", "own"), 2, weights)
        by_word = partial.groupBy("word_id").agg(*[F.sum(c).alias(c) for c in ("mu_sum", "own", *xs)])
    else:
        used = join_document_sums(
            tokens, _projection_sums(cols), enrich=lambda t: lookup_model(t, model, rows, routes), shape=weigh
        )
        by_word = used.groupBy("word_id").agg(
            F.sum(F.col("cnt") / F.col("len")).alias("mu_sum"),
            F.sum(F.col("cnt") * F.col("pair")).alias("own"),
            *[F.sum(F.col("cnt") * F.col(x)).alias(x) for x in xs],
        )
    return by_word.join(model.select("word_id", *cols), "word_id").select(
        "word_id",
        "mu_sum",
        *[(F.col(x) - F.col("own") * F.col(c)).alias(f"y{j}") for j, (x, c) in enumerate(zip(xs, cols))],
    )


def _packed(model: DataFrame) -> DataFrame:
    """``(word_id, o0)``, o0 being the whole model row as an array."""
    return model.select("word_id", F.array(*matrix_columns(model, "o")).alias("o0"))


def _wide_word_sums(
    tokens: DataFrame, model: DataFrame, weights: dict, scale: Column, rows: int | None, routes: DataFrame | None
) -> DataFrame:
    """``(word_id, weights..., vec)`` per word: sums of cnt * weight, and of cnt * scale * x with the document's x.

    Weights are functions of the document's ``len``, null where a document doesn't count. Tokens pass once:
    a document's x is summed, and handed to its words, while its tokens stream by. Only documents that are spread over
    blocks are summed first and joined back.
    """
    width, names = len(matrix_columns(model, "o")), list(weights)
    cells = [f"w{i}" for i in range(len(names))]

    def weigh(per_doc: DataFrame) -> DataFrame:
        given = [w.alias(c) for w, c in zip(weights.values(), cells)]
        return per_doc.select("block", "doc_id", "n", *given, scale.alias("scale"))

    blocked = block_tokens(tokens)
    packed = _packed(model)
    rows = packed.count() if rows is None else rows
    found = lookup_model(blocked, packed, rows, routes, width).withColumnRenamed("o0", "vec")
    # The join by document comes last: it leaves the tokens of a document together and in order.
    weighed = join_document_sums(blocked, {"len": F.sum("cnt"), "n": F.count(F.lit(1))}, shape=weigh, onto=found)
    whole = weighed.where(~F.col("spread")) if "spread" in blocked.columns else weighed
    summed = words_of_documents(whole.sortWithinPartitions("block", "doc_id"), [*cells, "scale"], names, width)
    if "spread" in blocked.columns:
        totals = sum_by_key(found.where("spread"), "doc_id", [], width, weight="cnt")
        if fits_broadcast(tokens.sparkSession, blocked.schema["spread"].metadata["documents"], width):
            totals = F.broadcast(totals)
        split = weighed.where("spread").drop("vec").join(totals, "doc_id")
        summed = summed.unionByName(words_of_vectors(split, [*cells, "scale"], names, width))
    return sum_by_key(summed, "word_id", names, width, summed=True)


def correct_pair_moment(sketch: DataFrame, model: DataFrame, alpha0: float, n_docs: int) -> DataFrame:
    """``(word_id, mu, y0, ...)``: the Dirichlet-corrected sketch.

    y <- (1+alpha0)/N y - alpha0 mu (muᵀ model), mu = mu_sum/N. Reads ``sketch`` twice when
    alpha0 > 0, so pass a materialised one.
    """
    cols = matrix_columns(model, "o")
    ys = matrix_columns(sketch, "y")
    n = literal(n_docs)
    shift = np.zeros(len(cols))
    if alpha0 > 0:
        row = sketch.join(model, "word_id").agg(*[F.sum(F.col("mu_sum") * F.col(c)).alias(c) for c in cols]).first()
        shift = np.array([v or 0.0 for v in row]) / n_docs
    scale = literal((1.0 + alpha0) / n_docs)
    return sketch.select(
        "word_id",
        F.expr(f"mu_sum / {n}").alias("mu"),
        *[F.expr(f"{y} * {scale} - (mu_sum / {n}) * ({literal(alpha0 * s)})").alias(y) for y, s in zip(ys, shift)],
    )


def every_word(matrix: DataFrame, vocab_size: int) -> DataFrame:
    """``matrix`` with zero rows for the words it lacks."""
    words = matrix.sparkSession.range(vocab_size).withColumnRenamed("id", "word_id")
    return words.join(matrix, "word_id", "left").na.fill(0.0)


def mean_frequency(tokens: DataFrame, n_docs: int, min_len: float = 2) -> DataFrame:
    """``(word_id, mu)``: mean relative frequency over all documents, counting those of ``min_len`` or more.

    ``min_len=1`` gives the raw mean document.
    """
    used = join_document_sums(
        tokens,
        {"len": F.sum("cnt")},
        shape=lambda d: d.where((F.col("len") >= min_len) & (F.col("len") != 0)),
    )
    return used.groupBy("word_id").agg((F.sum(F.col("cnt") / F.col("len")) / F.lit(float(n_docs))).alias("mu"))


def project_docs(
    tokens: DataFrame,
    model: DataFrame,
    divisors: np.ndarray | None = None,
    rows: int | None = None,
    routes: DataFrame | None = None,
) -> DataFrame:
    """``(doc_id, len, x0, ...)``: x = sum of cnt * model row, optionally divided by column.

    The division is made in the model table, once per word instead of once per document.
    """
    cols = matrix_columns(model, "o")
    if divisors is not None:
        model = model.select("word_id", *[F.expr(f"{c} / {literal(s)}").alias(c) for c, s in zip(cols, divisors)])
    if len(cols) > MAX_MODEL_COLUMNS:
        return _wide_document_sums(tokens, model, rows, routes)
    if "block" in tokens.columns and (in_blocks := _block_models(tokens, model, cols, rows, routes)):
        return document_totals(*in_blocks, cols)
    return document_sums(tokens, _projection_sums(cols), enrich=lambda t: lookup_model(t, model, rows, routes))


def _wide_document_sums(tokens: DataFrame, model: DataFrame, rows: int | None, routes: DataFrame | None) -> DataFrame:
    """Blocked documents are summed where they are; others, and those spread over blocks, within partitions first."""
    width = len(matrix_columns(model, "o"))
    packed = _packed(model)
    rows = packed.count() if rows is None else rows
    found = lookup_model(tokens, packed, rows, routes, width).withColumnRenamed("o0", "vec")
    found = found.withColumn("len", F.col("cnt").cast("double"))
    if "block" not in tokens.columns:
        summed = sum_by_key(found, "doc_id", ["len"], width, weight="cnt")
    else:
        # The join by document leaves its tokens together; that all n of them are is checked on the sums.
        counted = join_document_sums(tokens, {"n": F.count(F.lit(1)).cast("double")}, onto=found.withColumn("one", F.lit(1.0)))
        whole = counted.where(~F.col("spread")) if "spread" in tokens.columns else counted
        summed = sum_sorted(whole.sortWithinPartitions("block", "doc_id"), "doc_id", ["len", "one", "n"], width, weight="cnt")
        together = F.when(F.col("one") * F.col("one") == F.col("n"), F.col("len")).otherwise(F.raise_error(F.lit(SPLIT)))
        summed = summed.select("doc_id", together.alias("len"), "vec")
        if "spread" in tokens.columns:
            summed = summed.unionByName(sum_by_key(found.where("spread"), "doc_id", ["len"], width, weight="cnt"))
    return summed.select("doc_id", "len", *[x.alias(f"x{j}") for j, x in enumerate(vec_cells(width))])


def first_moment(proj: DataFrame, n_docs: int) -> DataFrame:
    """``(i, val)``: mean of x/len over all documents; a document of length 0 counts as a zero vector."""
    cols = matrix_columns(proj, "x")
    row = proj.where(F.col("len") != 0).agg(
        *[F.expr(f"coalesce(sum({c} / len), 0D) / {literal(n_docs)}").alias(c) for c in cols]
    )
    return row_to_cells(row, ("i",), [((i,), c) for i, c in enumerate(cols)])


def third_moment_sums(proj: DataFrame, alpha0: float) -> DataFrame:
    """Sums over documents, as cells ``(part, i, j, l, val)``.

    Over documents of three words or more: ``c3``: s3 xxx for i <= j <= l; ``g2``: s3 xx and
    ``p2``: s2 xx for i <= j; ``g1``: s3 x; ``h1``: s2 x; ``n3``: their number. Over documents of
    any length but 0: ``x1``: x/len. Unused indexes are -1. None of them needs the first moment,
    so one pass over the projected documents serves both moments.
    """
    cols = matrix_columns(proj, "x")
    k = len(cols)
    s2, s3 = dirichlet_weights(F.col("len"), alpha0)
    inverse = F.when(F.col("len") != 0, 1.0 / F.col("len"))
    weighted = proj.select(s2.alias("s2"), s3.alias("s3"), inverse.alias("s1"), *cols)
    if k * (k + 1) * (k + 2) // 6 + k * (k + 1) + 3 * k <= 2 * MAX_SUM_COLUMNS:
        return _third_sums_generated(weighted, cols)
    return _third_sums_numpy(weighted, cols)


def first_moment_of_sums(sums: DataFrame, k: int, n_docs: int) -> np.ndarray:
    """The first moment from the ``x1`` cells of ``third_moment_sums``."""
    m1 = np.zeros(k)
    for i, val in sums.where(F.col("part") == "x1").select("i", "val").collect():
        m1[i] = val / n_docs
    return m1


def _third_sums_generated(weighted: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Null weights take a document out of a sum."""
    k = len(cols)
    terms = {("n3", -1, -1, -1): F.count("s3").cast("double")}
    for i in range(k):
        terms["x1", i, -1, -1] = F.sum(F.col("s1") * F.col(cols[i]))
        terms["g1", i, -1, -1] = F.sum(F.col("s3") * F.col(cols[i]))
        terms["h1", i, -1, -1] = F.sum(F.col("s2") * F.col(cols[i]))
        for j in range(i, k):
            pair = F.col(cols[i]) * F.col(cols[j])
            terms["g2", i, j, -1] = F.sum(F.col("s3") * pair)
            terms["p2", i, j, -1] = F.sum(F.col("s2") * pair)
            for m in range(j, k):
                terms["c3", i, j, m] = F.sum(F.col("s3") * pair * F.col(cols[m]))
    row = weighted.agg(*[F.coalesce(t, F.lit(0.0)).alias(f"t{n}") for n, t in enumerate(terms.values())])
    return row_to_cells(row, ("part", "i", "j", "l"), [(cell, f"t{n}") for n, cell in enumerate(terms)])


def _third_sums_numpy(weighted: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Partial sums per task in numpy, added up in chunks (``_dense_sums``)."""
    cols, k = list(cols), len(cols)

    def weigh(batch: pd.DataFrame) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        every, s1 = batch[cols].to_numpy(dtype=float), batch["s1"].to_numpy(dtype=float)
        used = batch["s3"].notna().to_numpy()
        x, s2, s3 = every[used], batch["s2"].to_numpy(dtype=float)[used], batch["s3"].to_numpy(dtype=float)[used]
        i, j = np.triu_indices(k)
        low = {
            "n3": np.array([float(len(x))]),
            "x1": np.nan_to_num(s1) @ every,
            "g1": s3 @ x,
            "h1": s2 @ x,
            "g2": (x.T @ (x * s3[:, None]))[i, j],
            "p2": (x.T @ (x * s2[:, None]))[i, j],
        }
        return (x, s3), low

    def cube_slice(made, i: int) -> np.ndarray:
        x, s3 = made
        return x[:, i:].T @ (x[:, i:] * (s3 * x[:, i])[:, None])

    return _dense_sums(weighted, k, weigh, ("n3", "x1", "g1", "h1", "g2", "p2"), "c3", cube_slice)


def _low_cells(names: Sequence[str], k: int) -> list[tuple[str, int, int]]:
    """Part and indexes of the low-order sums in the order in which ``_dense_sums`` packs them."""
    pairs = list(zip(*(a.tolist() for a in np.triu_indices(k))))
    shapes = {"n": [(-1, -1)], "1": [(i, -1) for i in range(k)], "2": pairs}
    return [(name, *at) for name in names for at in shapes["n" if name == "n3" else "2" if name in ("g2", "p2", "bb") else "1"]]


def _cube_starts(k: int) -> np.ndarray:
    """Where the cells of each first index begin in the packed cube of i <= j <= l, and their number at the end."""
    left = np.arange(k, 0, -1)
    return np.append(0, np.cumsum(left * (left + 1) // 2))


def _dense_sums(source: DataFrame, k: int, weigh, low_names: Sequence[str], part: str, cube_slice) -> DataFrame:
    """Cells ``(part, i, j, l, val)`` of low-order sums and of a symmetric cube, added up as dense chunks.

    Each task adds up its own rows, then cuts its cells i <= j <= l, in order, into binary chunks of CHUNK_CELLS
    numbers. Chunks of one number meet in one partition, where they are added in numpy: the shuffle has tasks x
    chunks rows, not tasks x cells, and a chunk is all that a reducing task holds. One scan does for all first
    indexes whose packed cells fit TENSOR_BYTES; larger cubes take one scan for each range of first indexes.
    """
    source = merge_small_partitions(source)
    starts = _cube_starts(k)
    low = _low_cells(low_names, k)

    def partial(start: int, stop: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = {name: 0.0 for name in low_names}
            cube = np.zeros(starts[stop] - starts[start])
            corners = [np.triu_indices(k - i) for i in range(start, stop)]
            for batch in batches:
                made, part_low = weigh(batch)
                for name in low_names:
                    sums[name] = sums[name] + part_low[name]
                for i, corner in zip(range(start, stop), corners):
                    cube[starts[i] - starts[start] : starts[i + 1] - starts[start]] += cube_slice(made, i)[corner]
            if start == 0 and low and not np.isscalar(sums[low_names[0]]):
                yield _chunk_rows(-1, np.concatenate([sums[name] for name in low_names]), len(low))
            if cube.any():
                # Chunks are cut at fixed places of the whole cube, so a range may begin inside one.
                first, at = int(starts[start]) // CHUNK_CELLS, int(starts[start]) % CHUNK_CELLS
                yield _chunk_rows(first, np.concatenate([np.zeros(at), cube]), CHUNK_CELLS)

        return run

    chunks = None
    for start, stop in _row_ranges(k):
        found = numpy_batches(source, partial(start, stop), "chunk int, cells binary")
        chunks = found if chunks is None else chunks.unionByName(found)
    total = int(starts[-1])
    n = 1 + -(-total // CHUNK_CELLS)

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, cells in zip(batch["chunk"], batch["cells"]):
                values = np.frombuffer(cells)
                held = sums.get(chunk)
                if held is None:
                    sums[chunk] = values.copy()
                elif len(held) < len(values):
                    sums[chunk] = values + np.append(held, np.zeros(len(values) - len(held)))
                else:
                    held[: len(values)] += values
        for chunk, values in sums.items():
            if chunk < 0:
                for name in low_names:
                    at = [c for c, cell in enumerate(low) if cell[0] == name]
                    i, j = zip(*((low[c][1], low[c][2]) for c in at))
                    yield _cells(name, i, j, [-1] * len(at), values[at])
                continue
            place = chunk * CHUNK_CELLS + np.arange(len(values))
            for i in range(np.searchsorted(starts, place[0], "right") - 1, k):
                inside = (place >= starts[i]) & (place < starts[i + 1])
                if not inside.any():
                    break
                j, m = (a[place[inside] - starts[i]] for a in np.triu_indices(k - i))
                yield _cells(part, np.full(len(j), i), j + i, m + i, values[inside])

    meeting = chunks.repartitionById(n, F.col("chunk") + 1)
    return numpy_batches(meeting, added, "part string, i int, j int, l int, val double")


def _chunk_rows(first: int, values: np.ndarray, size: int) -> pd.DataFrame:
    cut = [values[at : at + size] for at in range(0, len(values), size)]
    return pd.DataFrame({"chunk": np.arange(first, first + len(cut), dtype="int32"), "cells": [np.ascontiguousarray(c).tobytes() for c in cut]})


def _row_ranges(k: int) -> list[tuple[int, int]]:
    """Ranges of the first tensor index whose packed partial sums fit a Python worker."""
    starts, ranges, at = _cube_starts(k), [], 0
    while at < k:
        stop = int(np.searchsorted(starts, starts[at] + TENSOR_BYTES // 8, "right")) - 1
        ranges.append((at, max(at + 1, min(stop, k))))
        at = ranges[-1][1]
    return ranges


def _cells(part: str, i, j, m, val) -> pd.DataFrame:
    columns = {"i": i, "j": j, "l": m}
    frame = pd.DataFrame({c: np.asarray(v, dtype="int32") for c, v in columns.items()})
    frame.insert(0, "part", part)
    frame["val"] = np.asarray(val, dtype=float)
    return frame


def third_moment(sums: DataFrame, m1: np.ndarray, alpha0: float) -> DataFrame:
    """The third-moment tensor ``(i, j, l, val)``, all k³ cells, from the sums of the documents.

    T = c3 - sym(m1 p2), then on cells with equal indexes the repeated-word terms, then /n3, then
    + alpha0² m1 m1 m1. Correction terms are taken on projected coordinates. Reads ``sums`` twice,
    so pass a materialised table.
    """
    m1 = np.asarray(m1, dtype=float)
    k = len(m1)
    pairs, singles, n3 = _low_order_tables(sums, k)
    table = _expand_symmetric(sums.where(F.col("part") == "c3"))
    table = _attach_low_orders(table, pairs, singles, m1)

    shift = F.expr("m_i * p_jl + m_j * p_il + m_l * p_ij")
    value = F.col("val") - shift
    value += F.when(F.col("i") == F.col("j"), F.expr("h_i * m_l - g_il")).otherwise(0.0)
    value += F.when(F.col("i") == F.col("l"), F.expr("h_i * m_j - g_ij")).otherwise(0.0)
    value += F.when(F.col("j") == F.col("l"), F.expr("m_i * h_j - g_ij")).otherwise(0.0)
    every = (F.col("i") == F.col("j")) & (F.col("j") == F.col("l"))
    value += F.when(every, F.expr(f"g_i * {literal(2.0 * k)}")).otherwise(0.0)
    return _finish(table, value, n3, alpha0)


def word_corrections(
    tokens: DataFrame, model: DataFrame, alpha0: float, rows: int | None = None, routes: DataFrame | None = None
) -> DataFrame:
    """``(word_id, f, h, z0, ...)``: per word the sums of s3 c, s2 c and s3 c x over documents of three words or more."""
    cols = matrix_columns(model, "o")
    if len(cols) > MAX_MODEL_COLUMNS:
        s2, s3 = dirichlet_weights(F.col("len"), alpha0)
        summed = _wide_word_sums(tokens, model, {"f": s3, "h": s2}, s3, rows, routes)
        return summed.select("word_id", "f", "h", *[z.alias(f"z{j}") for j, z in enumerate(vec_cells(len(cols)))])
    xs = named("x", len(cols))

    def weigh(per_doc: DataFrame) -> DataFrame:
        s2, s3 = dirichlet_weights(F.col("len"), alpha0)
        return per_doc.where(F.col("len") >= 3).select(
            "block", "doc_id", s2.alias("s2"), s3.alias("s3"), *[(F.col(x) * s3).alias(x) for x in xs]
        )

    if in_blocks := _block_models(tokens, model, cols, rows, routes):
        def weights(length: np.ndarray) -> list[np.ndarray]:
            pairs = length * (length - 1.0)
            s3 = (alpha0 + 1.0) * (alpha0 + 2.0) / (2.0 * pairs * (length - 2.0))
            return [s3, alpha0 * (alpha0 + 1.0) / (2.0 * pairs), s3]

        partial = word_totals(*in_blocks, cols, ("f", "h"), 3, weights)
        zs = [F.sum(x).alias(f"z{j}") for j, x in enumerate(xs)]
        return partial.groupBy("word_id").agg(F.sum("f").alias("f"), F.sum("h").alias("h"), *zs)

    used = join_document_sums(
        tokens, _projection_sums(cols), enrich=lambda t: lookup_model(t, model, rows, routes), shape=weigh
    )
    return used.groupBy("word_id").agg(
        F.sum(F.col("cnt") * F.col("s3")).alias("f"),
        F.sum(F.col("cnt") * F.col("s2")).alias("h"),
        *[F.sum(F.col("cnt") * F.col(x)).alias(f"z{j}") for j, x in enumerate(xs)],
    )


def word_correction_sums(words: DataFrame, model: DataFrame) -> DataFrame:
    """Cells ``(part, i, j, l, val)`` of the word-space corrections, B being the model row of a word.

    ``bb``: sum h B B for i <= j; ``t3``: -sym(sum B B z) + 2 sum f B B B for i <= j <= l.
    """
    cols = matrix_columns(model, "o")
    zs = matrix_columns(words, "z")
    rows = words.join(model, "word_id").select("f", "h", *cols, *zs)
    k = len(cols)
    if k * (k + 1) * (k + 2) // 6 + k * (k + 1) // 2 <= MAX_SUM_COLUMNS:
        terms = {}
        for i in range(k):
            for j in range(i, k):
                terms["bb", i, j, -1] = F.expr(f"sum(h * {cols[i]} * {cols[j]})")
                for m in range(j, k):
                    a, b, c = cols[i], cols[j], cols[m]
                    terms["t3", i, j, m] = F.expr(
                        f"sum(2D * f * {a} * {b} * {c} - {a} * {b} * z{m} - {a} * {c} * z{j} - {b} * {c} * z{i})"
                    )
        row = rows.agg(*[F.coalesce(t, F.lit(0.0)).alias(f"t{n}") for n, t in enumerate(terms.values())])
        return row_to_cells(row, ("part", "i", "j", "l"), [(cell, f"t{n}") for n, cell in enumerate(terms)])

    names, others = list(cols), list(zs)

    def weigh(batch: pd.DataFrame):
        b, z = batch[names].to_numpy(dtype=float), batch[others].to_numpy(dtype=float)
        i, j = np.triu_indices(k)
        low = {"bb": (b.T @ (b * batch["h"].to_numpy(dtype=float)[:, None]))[i, j]}
        return (b, z, batch["f"].to_numpy(dtype=float)), low

    def cube_slice(made, i: int) -> np.ndarray:
        b, z, f = made
        tail = b[:, i:]
        outer = (2.0 * f * b[:, i] - z[:, i])[:, None] * tail
        cross = (b[:, i][:, None] * tail).T @ z[:, i:]
        return outer.T @ tail - cross - cross.T

    return _dense_sums(rows, k, weigh, ("bb",), "t3", cube_slice)


def whitened_third_moment(sums: DataFrame, corrections: DataFrame, m1: np.ndarray, alpha0: float) -> DataFrame:
    """The third moment with the repeated-word terms taken in word space.

    T = (c3 + t3 - sym(m1 (p2 - bb))) / n3 + alpha0² m1 m1 m1.
    """
    m1 = np.asarray(m1, dtype=float)
    merged = sums.unionByName(corrections).groupBy(
        F.when(F.col("part") == "t3", "c3").otherwise(F.col("part")).alias("part"), "i", "j", "l"
    ).agg(F.sum("val").alias("val"))
    merged = materialize(merged, "third-sums")
    pairs, singles, n3 = _low_order_tables(merged, len(m1))
    pairs["p"] -= pairs["bb"]
    table = _expand_symmetric(merged.where(F.col("part") == "c3"))
    table = _attach_low_orders(table, pairs, singles, m1)
    value = F.col("val") - F.expr("m_i * p_jl + m_j * p_il + m_l * p_ij")
    return _finish(table, value, n3, alpha0)


def _low_order_tables(sums: DataFrame, k: int) -> tuple[dict, dict, float]:
    """The k×k and k-sized sums as arrays, and the document count."""
    parts = {"g2": np.zeros((k, k)), "p2": np.zeros((k, k)), "bb": np.zeros((k, k)), "g1": np.zeros(k), "h1": np.zeros(k)}
    n3 = 0.0
    for part, i, j, val in sums.where(F.col("part") != "c3").select("part", "i", "j", "val").collect():
        if part == "n3":
            n3 = val
        elif part == "x1":
            continue
        elif j < 0:
            parts[part][i] = val
        else:
            parts[part][i, j] = parts[part][j, i] = val
    if not n3:
        raise ValueError("no document has three words or more, so there is no third moment")
    pairs = {"g": parts["g2"], "p": parts["p2"], "bb": parts["bb"]}
    return pairs, {"g": parts["g1"], "h": parts["h1"]}, n3


def _expand_symmetric(cells: DataFrame) -> DataFrame:
    """All index permutations of cells stored for i <= j <= l."""
    orders = ["i,j,l", "i,l,j", "j,i,l", "j,l,i", "l,i,j", "l,j,i"]
    structs = ", ".join("struct({} AS i, {} AS j, {} AS l)".format(*o.split(",")) for o in orders)
    spread = cells.select("val", F.expr(f"explode(array_distinct(array({structs})))").alias("at"))
    return spread.select("at.i", "at.j", "at.l", "val")


def _attach_low_orders(table: DataFrame, pairs: dict, singles: dict, m1: np.ndarray) -> DataFrame:
    """Columns m_i, g_i, h_i, p_ij, g_ij and so on: the low-order sums at each index and index pair.

    Small ones become constants of the query. Others are joined, broadcast within the limit.
    """
    spark = table.sparkSession
    k = len(m1)
    ones = {"m": m1, "g": singles["g"], "h": singles["h"]}
    twos = {"p": pairs["p"], "g": pairs["g"]}
    couples = (("i", "j"), ("i", "l"), ("j", "l"))
    if k * k <= CONSTANT_CELLS:
        single = [F.expr(f"get({constants(v)}, {at})").alias(f"{n}_{at}") for n, v in ones.items() for at in "ijl"]
        double = [
            F.expr(f"get({constants(v.ravel())}, {a} * {k} + {b})").alias(f"{n}_{a}{b}") for n, v in twos.items() for a, b in couples
        ]
        return table.select("*", *single, *double)
    a, b = (v.ravel() for v in np.indices((k, k)))
    pair_rows = pd.DataFrame({"a": a, "b": b, "p": twos["p"].ravel(), "g": twos["g"].ravel()})
    pair_table = spark.createDataFrame(pair_rows, "a int, b int, p double, g double")
    one_table = spark.createDataFrame(pd.DataFrame({"a": np.arange(k), **ones}), "a int, m double, g double, h double")
    if fits_broadcast(spark, k * k, 3):
        pair_table, one_table = F.broadcast(pair_table), F.broadcast(one_table)
    for index in ("i", "j", "l"):
        table = table.join(one_table.toDF(index, f"m_{index}", f"g_{index}", f"h_{index}"), index)
    for left, right in couples:
        table = table.join(pair_table.toDF(left, right, f"p_{left}{right}", f"g_{left}{right}"), [left, right])
    return table


def _finish(table: DataFrame, value, n3: float, alpha0: float) -> DataFrame:
    cube = F.expr(f"{literal(alpha0 * alpha0)} * m_i * m_j * m_l")
    return table.select("i", "j", "l", (value / F.lit(float(n3)) + cube).alias("val"))


def sum_matrices(*matrices: DataFrame, prefix: str | None = None, key: str = "row_id") -> DataFrame:
    """Cell-by-cell sum of tall matrices ``(key, vec)``, or ``(key, prefix0, ...)`` when a prefix is given.

    Vectors of unequal length are an error, found in a pass over the vectors' sizes.
    """
    if not matrices:
        raise ValueError("no matrix to add")
    total = matrices[0]
    for other in matrices[1:]:
        total = total.unionByName(other)
    if prefix:
        cols = matrix_columns(total, prefix)
        return total.groupBy(key).agg(*[F.sum(c).alias(c) for c in cols])
    least, width = total.agg(F.min(F.size("vec")), F.max(F.size("vec"))).first()
    if least != width:
        raise ValueError(f"vectors of {least} to {width} values cannot be added")
    if width is not None and width <= MAX_SUM_COLUMNS:
        sums = [F.sum(F.col("vec")[j]) for j in range(width)]
        return total.groupBy(key).agg(F.array(*sums).alias("vec"))
    cells = total.select(key, F.posexplode("vec").alias("at", "val"))
    summed = cells.groupBy(key, "at").agg(F.sum("val").alias("val"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "val")))
    return summed.groupBy(key).agg(F.transform(ordered, lambda c: c["val"]).alias("vec"))

