"""Language identification with a string kernel.

The kernel of two texts is the number of character n-grams (of ``NGRAMS`` characters, letters
lower-cased, everything else a space) that both have, over the root of the product of how many each
has: the blended spectrum presence kernel. N-grams are hashed into ``SLOTS`` slots.

Fitting (driver, bounded): labelled texts outside the held-out fold, at most ``PER_LANGUAGE`` of a
language and ``MOST_ROWS`` in all, none longer than ``FIT_BYTES``; ``LANDMARKS`` of them, languages in turn, are the
Nyström landmarks. One-versus-rest kernel ridge regression on the Nyström features gives a weight
for each landmark and language.

Scoring (one pass, no shuffle, whole texts): a batch of texts becomes a matrix of presences. Its
kernel against all landmarks is one matrix product, and the regression another; since nothing lies
between them, the landmarks and weights are multiplied once beforehand, and each batch takes a
single product with a table of SLOTS rows and a column for each language.

A text of more than ``SCORED`` characters is cut into even pieces of at most that many, each with the n-grams that begin in
it, and its regression values are the mean of theirs. The presences of a whole long text would fill all slots, in
any language; those of a piece can't.

Defined results
- A null text, or one without a letter, is ``und`` with score 0; so is everything if nothing could be learned.
- Labels that are null teach nothing. Ties between languages go to the first by name.
- Repeated rows give repeated rows. An empty table gives an empty result. Language, source and id are not read for a prediction.
"""

from __future__ import annotations

import functools
import itertools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectral_topics.functions.dense import one_blas_thread
from spectral_topics.functions.storage import materialize
from spectral_topics.llm.common import arrow_map, crc_bucket, hash_share, id_and_text, quoted, text_bytes, worker_memory

NGRAMS = (1, 2, 3, 4)
SLOTS = 1 << 16
PER_LANGUAGE = 300
MOST_ROWS = 3000
FIT_BYTES = 8192
LANDMARKS = 240
RIDGE = 1e-3
#: Texts in a presence matrix.
BATCH = 64
#: Characters hashed at once; longer texts are taken in overlapping pieces.
PIECE = 1 << 20
#: Characters of a text, or a piece of it, that are scored as one row.
SCORED = 8192
#: Turns differences of regression values into odds.
SHARPNESS = 4.0
UNDETERMINED = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    #: (SLOTS, languages): landmark presences times regression weights.
    table: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


@functools.cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def slots_of(text: str) -> Iterator[np.ndarray]:
    """Slots of a text's n-grams, with repeats; nothing for a text without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    known = letters()[codes]
    if not known.any():
        return
    codes = np.where(known, codes, 32).astype(np.uint64)
    longest = max(NGRAMS)
    for at in range(0, len(codes), PIECE):
        part = codes[at : at + PIECE + longest - 1]
        hashed = np.zeros(len(part), np.uint64)
        for n in range(1, longest + 1):
            if len(part) < n:
                break
            # The hash of n characters from that of the first n - 1.
            hashed = (hashed[: len(part) - n + 1] + part[n - 1 :] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            hashed ^= hashed >> np.uint64(29)
            if n in NGRAMS:
                yield (hashed >> np.uint64(48)).astype(np.int64) if SLOTS == 1 << 16 else (hashed % np.uint64(SLOTS)).astype(np.int64)


class Presences:
    """A matrix of presences that is used again for each batch."""

    def __init__(self) -> None:
        self.matrix = np.zeros((BATCH, SLOTS), np.float32)

    def fill(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows divided by the root of their counts, and whether each text has a letter."""
        used = self.matrix[: len(texts)]
        used[:] = 0
        found = np.zeros(len(texts), bool)
        for i, text in enumerate(texts):
            row = used[i]
            for slots in slots_of(text):
                row[slots] = 1
                found[i] = True
        return used, found

    @staticmethod
    def norms(used: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(used.sum(axis=1, dtype=np.float64), 1.0))


def kernel(texts: list[str], landmarks: np.ndarray, presences: Presences) -> np.ndarray:
    """Kernel values of texts (rows) against normalised landmark rows."""
    parts = []
    for at in range(0, len(texts), BATCH):
        used, _ = presences.fill(texts[at : at + BATCH])
        parts.append((used @ landmarks.T) / presences.norms(used)[:, None])
    return np.concatenate(parts).astype(np.float64)


def fit(texts: list[str], languages: list[str]) -> LanguageModel:
    """Nyström features and one-versus-rest kernel ridge regression on sample texts."""
    one_blas_thread()
    names = sorted(set(languages))
    if not names:
        return LanguageModel([], np.zeros((SLOTS, 0), np.float32))
    places = [[i for i, x in enumerate(languages) if x == name] for name in names]
    turns = [p[r] for r in range(max(map(len, places))) for p in places if r < len(p)]
    chosen = turns[:LANDMARKS]
    presences = Presences()
    landmarks = np.zeros((len(chosen), SLOTS), np.float32)
    for at in range(0, len(chosen), BATCH):
        used, _ = presences.fill([texts[i] for i in chosen[at : at + BATCH]])
        landmarks[at : at + len(used)] = used / presences.norms(used)[:, None]
    among = (landmarks @ landmarks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(among)
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = kernel(texts, landmarks, presences) @ root
    target = np.where(np.array(languages)[:, None] == np.array(names), 1.0, -1.0)
    # Every language counts as much as the others.
    weight = np.array([1.0 / languages.count(n) for n in names])[np.searchsorted(names, languages)]
    weighted = features * weight[:, None]
    solved = np.linalg.solve(weighted.T @ features + RIDGE * np.eye(features.shape[1]), weighted.T @ target)
    return LanguageModel(names, (landmarks.T @ (root @ solved)).astype(np.float32))


def pieces_of(text: str) -> Iterator[str]:
    """Even pieces that cover a text; each goes on into the next so that no n-gram is lost."""
    count = max(1, -(-len(text) // SCORED))
    edges = [len(text) * i // count for i in range(count + 1)]
    for start, end in zip(edges, edges[1:]):
        yield text[start : end + max(NGRAMS) - 1]


def regression_values(model: LanguageModel, texts: list[str], presences: Presences) -> tuple[np.ndarray, np.ndarray]:
    """A value for each text and language, and whether each text has a letter. Pieces without a letter don't count."""
    values = np.zeros((len(texts), len(model.languages)))
    counted = np.zeros(len(texts), np.int64)
    pieces = ((i, piece) for i, text in enumerate(texts) for piece in pieces_of(text))
    while batch := list(itertools.islice(pieces, BATCH)):
        used, lettered = presences.fill([piece for _, piece in batch])
        owner = np.array([i for i, _ in batch])
        np.add.at(counted, owner, lettered)
        if model.languages:
            np.add.at(values, owner, (used @ model.table) / presences.norms(used)[:, None])
    return values / np.maximum(counted, 1)[:, None], counted > 0


def predict(model: LanguageModel, texts: list[str], presences: Presences) -> tuple[list[str], np.ndarray]:
    values, lettered = regression_values(model, texts, presences)
    if not model.languages:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    best = values.argmax(axis=1)
    odds = np.exp(SHARPNESS * (values - values.max(axis=1, keepdims=True)))
    found = [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, lettered, strict=True)]
    return found, np.where(lettered, 1.0 / odds.sum(axis=1), 0.0)


def fit_languages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    folds: int = 4,
    held_out: int = 2,
    per_language: int = PER_LANGUAGE,
    most_rows: int = MOST_ROWS,
) -> LanguageModel:
    """Fit on rows outside the held-out fold: crc32 of the id as text, modulo ``folds``."""
    labelled = docs.where(quoted(lang_col).isNotNull() & quoted(id_col).isNotNull() & (crc_bucket(id_col, folds) != held_out)).select(
        quoted(id_col).cast("long").alias("id"), quoted(lang_col).cast("string").alias("lang"), F.octet_length(quoted(text_col)).alias("size")
    )
    order = [F.xxhash64("id"), F.col("id")]
    # Only ids are ranked, and a language's rows are cut by their hash to a few times what is taken, so
    # that what meets in a task doesn't grow with the input. The stored table has a row for each language.
    fitting = labelled.where(F.col("size").between(1, FIT_BYTES))
    counts = materialize(fitting.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    few = fitting.join(counts, "lang").where(hash_share("id", F.lit(3.0 * per_language) / F.col("n")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    ids = few.withColumn("rank", rank).where(F.col("rank") <= per_language)
    ids = ids.orderBy("rank", *order).limit(most_rows).select("id", "lang")
    rows = (
        id_and_text(docs, id_col, text_col)
        .where(F.octet_length("text") <= FIT_BYTES)
        .join(F.broadcast(ids), "id")
        .orderBy("lang", *order)
        .limit(most_rows)
        .select("text", "lang")
        .toArrow()
    )
    texts = [t.decode("utf-8", "replace") for t in text_bytes(rows.column("text").combine_chunks())]
    return fit(texts, rows.column("lang").to_pylist())


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)`` of every row. The model's size is that of its table, whatever the input."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        presences = worker_memory("presences", Presences)
        for rows in batches:
            for at in range(0, rows.num_rows, 1024):
                part = rows.slice(at, 1024)
                texts = [t.decode("utf-8", "replace") for t in text_bytes(part.column("text"))]
                found, scores = predict(shared.value, texts, presences)
                yield pa.record_batch([part.column("id"), pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    return arrow_map(id_and_text(docs, id_col, text_col), find, "id long, lang_pred string, score double")
