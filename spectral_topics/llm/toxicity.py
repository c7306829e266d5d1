"""Toxic spans and document scores from a linear-chain conditional random field.

Fitting
1. A bounded sample of labelled documents (``PER_CLASS`` of each label, the first by the hash of
   their ids, none longer than ``FIT_BYTES``) comes to the driver. Nothing else is learned from.
2. Document labels become token labels. Word beginnings that documents labelled toxic have and
   others hardly do are picked one after the other, each time the one that explains most of the
   toxic documents not explained so far; then those that at least ``COMMON`` of the toxic documents
   share. Near copies within the sample count once, or a rare word of an often copied document
   would pass for toxic. Tokens with a picked beginning, in toxic documents, are toxic; all others
   are clean.
3. The field has two states. A token's features are the word, its beginnings and endings, and the
   words before and after, hashed into tables of fixed size. It is fitted on sentences by gradient
   steps on the likelihood, whose gradients are forward-backward marginals.
4. Logistic regression turns a document's marginals (the largest, and the sum of those over a half)
   into a probability of the label, weighted so that the label's share in all labelled rows holds.

Scoring runs over every whole text in one pass without a shuffle: forward-backward over the chain of all its
words, the score, and the character offsets of spans whose marginals exceed a half. For many documents at once the
chains are laid out in pieces of ``PIECE`` words; products of each piece's transitions carry the messages from
piece to piece, so a document's marginals are those of one whole chain.

Defined results
- A null or empty text has no tokens; it gets the score of a document without any toxic marginal.
- Without labelled rows of both kinds every score is the share of toxic rows (0 without any).
- Several labels for one id: toxic if any says so. Null ids and labels teach nothing.
- Repeated rows give repeated rows. An empty table gives an empty result. Labels, language, source
  and id are not read for a score.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectral_topics.llm.common import arrow_map, crc_bucket, give_back, hash_share, id_and_text, quoted, text_bytes, worker_memory

#: At most this many labelled documents of each label are fitted, each of at most so many bytes.
PER_CLASS = 1500
FIT_BYTES = 16_384
#: Sentences fitted: all with a toxic token, and so many for each of them without.
CLEAN_SENTENCES = 6
MAX_SENTENCES = 15_000
#: Features are hashed into tables of so many weights.
TABLE = 1 << 18
BEGINNINGS = range(4, 8)
STEPS = 60
#: A word beginning is toxic if its share in clean documents is below this part of that in toxic ones.
CLEAN_PART = 0.1
LEAST_GAIN = 3
#: Beginnings that this share of the toxic documents has, and at least LEAST_COMMON, are picked as well.
COMMON = 0.02
LEAST_COMMON = 4
#: Sentences are fitted in pieces of at most so many words; scoring lays documents out in such pieces.
PIECE = 60
MEMO = 120_000

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")


@dataclass
class ToxicityModel:
    """Weights of fixed size: what a word adds to the log-odds of its own, the next and the previous token."""

    share: float
    fitted: bool = False
    own: np.ndarray = field(default_factory=lambda: np.zeros(TABLE, np.float32))
    before: np.ndarray = field(default_factory=lambda: np.zeros(TABLE, np.float32))
    after: np.ndarray = field(default_factory=lambda: np.zeros(TABLE, np.float32))
    bias: float = 0.0
    #: Log potentials of the transitions, from clean to clean and toxic, then from toxic to clean and toxic.
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    #: Tells models apart in workers that outlive a task.
    name: str = field(default_factory=lambda: uuid.uuid4().hex)
    #: Logistic regression on what ``summary`` returns.
    document: np.ndarray = field(default_factory=lambda: np.zeros(3))


def words_of(text: str) -> list[str]:
    """Lower-cased words; lower-casing comes second, since it may add characters that aren't letters."""
    return [w.lower() for w in WORD.findall(text)]


def word_features(word: str) -> list[int]:
    """Slots of a lower-case word, its beginnings and its endings (of UTF-8 bytes)."""
    w = word.encode()
    n = len(w)
    names = [b"=" + w]
    names += [b"^" + w[:k] for k in range(3, min(n, 7) + 1)]
    names += [w[-k:] + b"$" for k in range(3, min(n, 5) + 1)]
    return [x % TABLE for x in map(zlib.crc32, names)]


def forward_backward(
    odds: np.ndarray, lengths: np.ndarray, moves: np.ndarray, enter: np.ndarray | float = 0.0, leave: np.ndarray | float = 0.0
) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log-odds of the toxic state, for chains in the rows of a padded array.

    Rows come longest first, so the chains still running at a step are the first ones. A token's
    marginal has the sum of its two log-odds; the forward one holds the token's own. ``enter`` and ``leave`` are
    the messages of what stands before and behind each row.
    """
    steps = odds.shape[1]
    running = np.searchsorted(-lengths, -np.arange(steps), side="left")  # how many chains reach each step
    (a00, a01), (a10, a11) = moves
    forward, backward = odds.copy(), np.zeros_like(odds)
    forward[:, 0] += enter
    backward[np.arange(len(odds)), lengths - 1] = leave
    for t in range(1, steps):
        f = forward[: running[t], t - 1]
        forward[: running[t], t] += np.logaddexp(a01, f + a11) - np.logaddexp(a00, f + a10)
    for t in range(steps - 2, -1, -1):
        n = running[t + 1]
        b = odds[:n, t + 1] + backward[:n, t + 1]
        backward[:n, t] = np.logaddexp(a10, a11 + b) - np.logaddexp(a00, a01 + b)
    return forward, backward


def messages(odds: np.ndarray, lengths: np.ndarray, moves: np.ndarray, number: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What enters and leaves each row of ``odds`` (see ``forward_backward``) when rows are pieces of longer chains.

    ``number`` is each piece's place in its chain, in order of the chains, and ``row`` the piece's row.
    """
    step = np.exp(moves - moves.max())
    # A piece's product of transitions, a step at a time over all rows that are as long; scaled, as only ratios count.
    product = np.tile(np.eye(2), (len(odds), 1, 1))
    running = np.searchsorted(-lengths, -np.arange(odds.shape[1]), side="left")
    first = row[number == 0]
    for t in range(odds.shape[1]):
        n = running[t]
        p = product[:n] @ step
        if t == 0:
            p[first] = np.eye(2)
        high = np.maximum(odds[:n, t], 0.0)
        p[:, :, 0] *= np.exp(-high)[:, None]
        p[:, :, 1] *= np.exp(odds[:n, t] - high)[:, None]
        product[:n] = p / p.max(axis=(1, 2), keepdims=True)
    before, behind = np.ones((len(odds), 2)), np.ones((len(odds), 2))
    for k in range(1, int(number.max(initial=0)) + 1):
        at = np.flatnonzero(number == k)
        v = np.einsum("ri,rij->rj", before[row[at - 1]], product[row[at - 1]])
        before[row[at]] = v / v.max(axis=1, keepdims=True)
    for k in range(int(number.max(initial=0)), 0, -1):
        at = np.flatnonzero(number == k)
        v = np.einsum("rij,rj->ri", product[row[at]], behind[row[at]])
        behind[row[at - 1]] = v / v.max(axis=1, keepdims=True)
    coming = before @ step
    enter = np.log(np.maximum(coming[:, 1], 1e-300)) - np.log(np.maximum(coming[:, 0], 1e-300))
    enter[first] = 0.0
    return enter, np.log(np.maximum(behind[:, 1], 1e-300)) - np.log(np.maximum(behind[:, 0], 1e-300))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def summary(marginals: np.ndarray) -> tuple[float, float, float]:
    """What a document's score depends on: a constant, the log-odds of its largest marginal, the sum of those over a half."""
    top = float(marginals.max()) if len(marginals) else 0.0
    top = min(max(top, 1e-4), 1 - 1e-4)
    return 1.0, np.log(top / (1 - top)), float(np.log1p(marginals[marginals > 0.5].sum()))


class Scorer:
    """Marginals of texts. Remembers what each word adds, since it depends on the word alone."""

    def __init__(self, model: ToxicityModel) -> None:
        self.model = model
        self.own = array("f", model.own)
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.parts: dict[bytes, tuple[int, ...]] = {}
        self.adds = array("f")

    def _part(self, part: bytes) -> tuple[int, ...]:
        found = []
        for word in words_of(part.decode("utf-8", "replace")):
            row = self.rows.get(word)
            if row is None:
                slots = word_features(word)
                m, own = self.model, self.own
                self.adds.extend((sum([own[s] for s in slots]), m.before[slots[0]], m.after[slots[0]]))
                row = self.rows[word] = len(self.rows)
            found.append(row)
        self.parts[part] = tuple(found)
        return self.parts[part]

    def marginals(self, texts: list[bytes]) -> list[np.ndarray]:
        """A marginal for each word of each text."""
        if len(self.parts) > MEMO:
            self._forget()
        known, part = self.parts, self._part
        words = []
        for text in texts:
            found = [known[p] if p in known else part(p) for p in text.split()]
            words.append(np.fromiter(chain.from_iterable(found), np.int64))
        return chain_marginals(self.model, words, np.array(self.adds, np.float64).reshape(-1, 3))


def scorer_of(model: ToxicityModel) -> Scorer:
    """The worker's scorer for this model; what it remembers lasts over tasks."""
    return worker_memory(("toxicity", model.name), lambda: Scorer(model))


def chain_marginals(model: ToxicityModel, words: list[np.ndarray], adds: np.ndarray) -> list[np.ndarray]:
    """Marginals of documents given as word rows, all documents together: each is one chain, laid out in pieces."""
    lengths = np.array([len(w) for w in words])
    flat = np.concatenate(words) if len(words) else np.zeros(0, np.int64)
    if not len(flat):
        return [np.zeros(0)] * len(words)
    ends = np.cumsum(lengths)
    place = np.arange(len(flat)) - np.repeat(ends - lengths, lengths)
    odds = model.bias + adds[flat, 0]
    odds[1:] += np.where(place[1:] > 0, adds[flat[:-1], 1], 0.0)
    odds[:-1] += np.where(place[1:] > 0, adds[flat[1:], 2], 0.0)
    starts = np.flatnonzero(place % PIECE == 0)
    sizes = np.diff(np.append(starts, len(flat)))
    order = np.argsort(-sizes, kind="stable")
    row = np.empty(len(sizes), np.int64)
    row[order] = np.arange(len(sizes))
    number, piece = place[starts] // PIECE, row
    row, column = np.repeat(row, sizes), place % PIECE
    padded = np.zeros((len(sizes), PIECE))
    padded[row, column] = odds
    enter, leave = messages(padded, sizes[order], model.moves, number, piece)
    forward, backward = forward_backward(padded, sizes[order], model.moves, enter, leave)
    marginals = sigmoid(forward + backward)[row, column]
    return np.split(marginals, ends[:-1])


def spans_of(text: bytes, marginals: np.ndarray) -> list[dict]:
    """Character offsets of runs of words whose marginals exceed a half, with the run's largest marginal."""
    found: list[dict] = []
    last = -2
    for i, word in enumerate(WORD.finditer(text.decode("utf-8", "replace"))):
        if i < len(marginals) and marginals[i] > 0.5:
            if i == last + 1:
                found[-1]["end"] = word.end()
                found[-1]["marginal"] = max(found[-1]["marginal"], float(marginals[i]))
            else:
                found.append({"start": word.start(), "end": word.end(), "marginal": float(marginals[i])})
            last = i
    return found


# --- fitting ---


def toxic_beginnings(toxic: list[str], clean: list[str]) -> set[str]:
    """Word beginnings (or whole words, marked $) that explain toxic documents."""

    def keys(text: str) -> set[str]:
        words = set(words_of(text))
        return {w[:n] for w in words for n in BEGINNINGS if len(w) >= n} | {w + "$" for w in words}

    counts = Counter()
    for text in toxic:
        counts.update(keys(text))
    often = {k: n for k, n in counts.items() if n >= LEAST_GAIN}
    del counts
    seen = Counter()
    for text in clean:
        seen.update(keys(text) & often.keys())
    rare = CLEAN_PART * len(clean) / max(1, len(toxic))
    where: dict[str, set[int]] = {k: set() for k, n in often.items() if seen[k] <= rare * n}
    for i, text in enumerate(toxic):
        for k in keys(text) & where.keys():
            where[k].add(i)
    least = max(LEAST_GAIN, len(toxic) // 200)
    common = max(LEAST_COMMON, COMMON * len(toxic))
    picked = {k for k, v in where.items() if len(v) >= common}
    while where:
        best = max(where, key=lambda k: (len(where[k]), len(k), k))
        covered = where.pop(best)
        if len(covered) < least:
            break
        picked.add(best)
        where = {k: left for k, v in where.items() if len(left := v - covered) >= least}
    return picked


def without_near_copies(texts: list[bytes]) -> list[bytes]:
    """One text of those that share a smallest word-triple hash; two hashes, so that few copies slip through."""
    seen: set[tuple[int, int]] = set()
    kept = []
    for text in texts:
        words = text.lower().split()
        hashes = [zlib.crc32(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))]
        marks = {(0, min(hashes)), (1, min(h * 0x9E3779B1 % (1 << 32) for h in hashes))}
        if not marks & seen:
            kept.append(text)
        seen |= marks
    return kept


def is_toxic_word(word: str, picked: set[str]) -> bool:
    return word + "$" in picked or any(word[:n] in picked for n in BEGINNINGS if len(word) >= n)


def fit(texts: list[bytes], labels: list[int], counts: dict[int, int]) -> ToxicityModel:
    """Fit on sample documents; ``counts`` has the labelled rows of each label."""
    total = counts.get(0, 0) + counts.get(1, 0)
    model = ToxicityModel(share=counts.get(1, 0) / total if total else 0.0)
    unique = dict(zip(texts, labels, strict=True))
    unique = {t: unique[t] for t in without_near_copies(list(unique))}
    docs = [(t.decode("utf-8", "replace"), y) for t, y in unique.items()]
    picked = toxic_beginnings([t for t, y in docs if y], [t for t, y in docs if not y])
    if not picked or len({y for _, y in docs}) < 2:
        return model
    rows: dict[str, int] = {}
    marks: list[bool] = []
    with_toxic, without = [], []
    for text, y in docs:
        for sentence in SENTENCE.split(text):
            found = words_of(sentence)
            for word in found:
                if word not in rows:
                    rows[word] = len(rows)
                    marks.append(is_toxic_word(word, picked))
            ids = np.array([rows[w] for w in found], np.int32)
            tags = np.array([y and marks[i] for i in ids], bool)
            for at in range(0, len(ids), PIECE):
                part = ids[at : at + PIECE], tags[at : at + PIECE]
                (with_toxic if part[1].any() else without).append(part)
    del docs
    generator = np.random.default_rng(1)
    with_toxic = [with_toxic[i] for i in generator.permutation(len(with_toxic))[: MAX_SENTENCES // 2]]
    taken = generator.permutation(len(without))[: min(CLEAN_SENTENCES * len(with_toxic), MAX_SENTENCES - len(with_toxic))]
    _fit_chain(model, list(rows), with_toxic + [without[i] for i in taken])
    del rows, with_toxic, without
    model.fitted = True
    scorer = Scorer(model)
    found = np.array([summary(m) for m in scorer.marginals(list(unique))])
    y = np.array(list(unique.values()), float)
    weight = np.where(y == 1, counts[1] / y.sum(), counts[0] / (len(y) - y.sum()))
    model.document = logistic(found, y, weight / weight.sum())
    return model


def _fit_chain(model: ToxicityModel, words: list[str], sentences: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Gradient steps (Adam) on the regularised likelihood of sentences, given as word numbers and tags."""
    sentences = sorted(sentences, key=lambda s: -len(s[0]))
    lengths = np.array([len(s[0]) for s in sentences])
    shape = (len(sentences), int(lengths.max()))
    inside = np.arange(shape[1]) < lengths[:, None]
    used, ids = np.unique(np.concatenate([s[0] for s in sentences]), return_inverse=True)
    tags = np.zeros(shape)
    tags[inside] = np.concatenate([s[1] for s in sentences])
    slots = [np.array(word_features(words[i]), np.int32) for i in used]
    owner = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
    flat = np.concatenate(slots)
    first = np.array([s[0] for s in slots])
    cell = np.full(shape, -1)
    cell[inside] = ids
    left = np.where(np.arange(shape[1]) > 0, np.roll(cell, 1, axis=1), -1)[inside]
    right = np.where(np.arange(shape[1]) < lengths[:, None] - 1, np.roll(cell, -1, axis=1), -1)[inside]

    theta = np.zeros(3 * TABLE + 5)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    n = len(ids)
    for step in range(1, STEPS + 1):
        own, before, after = theta[:TABLE], theta[TABLE : 2 * TABLE], theta[2 * TABLE : 3 * TABLE]
        moves = theta[3 * TABLE + 1 :].reshape(2, 2)
        add = np.bincount(owner, own[flat], len(slots))
        at = theta[3 * TABLE] + add[ids] + np.where(left >= 0, before[first[left]], 0) + np.where(right >= 0, after[first[right]], 0)
        odds = np.zeros(shape)
        odds[inside] = at
        forward, backward = forward_backward(odds, lengths, moves)
        wrong = (tags - sigmoid(forward + backward))[inside]
        by_word = np.bincount(ids, wrong, len(slots))
        gradient = np.zeros_like(theta)
        gradient[:TABLE] = np.bincount(flat, by_word[owner], TABLE)
        gradient[TABLE : 2 * TABLE] = np.bincount(first[left[left >= 0]], wrong[left >= 0], TABLE)
        gradient[2 * TABLE : 3 * TABLE] = np.bincount(first[right[right >= 0]], wrong[right >= 0], TABLE)
        gradient[3 * TABLE] = wrong.sum()
        gradient[3 * TABLE + 1 :] = _move_gradient(forward, backward, odds, moves, tags, inside)
        gradient = gradient / n - 1e-6 * theta
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        theta += 0.15 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    model.own, model.before, model.after = (theta[i * TABLE : (i + 1) * TABLE].astype(np.float32) for i in range(3))
    model.bias, model.moves = float(theta[3 * TABLE]), theta[3 * TABLE + 1 :].reshape(2, 2).copy()


def _move_gradient(forward, backward, odds, moves, tags, inside) -> np.ndarray:
    """Observed less expected number of each transition."""
    pairs = inside[:, 1:]
    f, b = forward[:, :-1][pairs], (odds + backward)[:, 1:][pairs]
    joint = np.stack([moves[i, j] + i * f + j * b for i in (0, 1) for j in (0, 1)])
    joint = np.exp(joint - joint.max(axis=0))
    expected = (joint / joint.sum(axis=0)).sum(axis=1)
    was, now = tags[:, :-1][pairs], tags[:, 1:][pairs]
    seen = np.array([((1 - was) * (1 - now)).sum(), ((1 - was) * now).sum(), (was * (1 - now)).sum(), (was * now).sum()])
    return seen - expected


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method on weighted, regularised logistic loss."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = sigmoid(x @ w)
        gradient = x.T @ (weight * (p - y)) + ridge * w
        curvature = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(curvature, gradient)
        w -= move
        if np.abs(move).max() < 1e-9:
            break
    return w


# --- Spark ---


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    folds: int = 3,
    held_out: int = 1,
    per_class: int = PER_CLASS,
    max_bytes: int = FIT_BYTES,
) -> ToxicityModel:
    """Fit on labelled rows outside the held-out fold: crc32 of the id as text, modulo ``folds``."""
    known = (
        labels.where(quoted(id_col).isNotNull() & quoted(label_col).isNotNull() & (crc_bucket(id_col, folds) != held_out))
        .groupBy(quoted(id_col).cast("long").alias("id"))
        .agg(F.max((quoted(label_col) == 1).cast("int")).alias("y"))
    )
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts, tags = [], []
    for y in sorted(counts):
        order = [F.xxhash64("id"), F.col("id")]
        # Some labelled ids may have no document, or one too long: twice as many ids as needed. They are
        # cut to a few times that by their hash first, so that the tasks together don't send more with more input.
        few = hash_share("id", 4 * per_class / counts[y])
        ids = known.where((F.col("y") == y) & few).orderBy(*order).limit(2 * per_class).select("id")
        rows = (
            id_and_text(docs, id_col, text_col)
            .where(F.octet_length("text") <= max_bytes)
            .join(F.broadcast(ids), "id")
            .orderBy(*order)
            .limit(per_class)
            .select("text")
            .toArrow()
        )
        texts += text_bytes(rows.column("text").combine_chunks())
        tags += [y] * rows.num_rows
        del rows
    model = fit(texts, tags, counts)
    # The sample and what was made of it would stay with the driver's process during all later steps.
    del texts, tags
    give_back()
    return model


def _score(model: ToxicityModel, scorer: Scorer, texts: list[bytes]) -> tuple[list[float], list[np.ndarray]]:
    if not model.fitted:
        return [model.share] * len(texts), [np.zeros(0)] * len(texts)
    marginals = scorer.marginals(texts)
    scores = sigmoid(np.array([summary(m) for m in marginals]).reshape(-1, 3) @ model.document)
    return scores.tolist(), marginals


SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))
#: Texts scored together.
GROUP = 1000


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score, spans)`` of every row; spans are character offsets with the largest marginal."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = scorer_of(model)
        for rows in batches:
            for at in range(0, rows.num_rows, GROUP):
                part = rows.slice(at, GROUP)
                texts = text_bytes(part.column("text"))
                scores, marginals = _score(model, scorer, texts)
                spans = [spans_of(t, m) if len(m) and m.max() > 0.5 else [] for t, m in zip(texts, marginals, strict=True)]
                columns = [part.column("id"), pa.array(scores, pa.float64()), pa.array(spans, SPAN)]
                yield pa.record_batch(columns, names=["id", "score", "spans"])

    schema = "id long, score double, spans array<struct<start: long, end: long, marginal: double>>"
    return arrow_map(id_and_text(docs, id_col, text_col), score, schema)


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = scorer_of(model)
        for rows in batches:
            for at in range(0, rows.num_rows, GROUP):
                part = rows.slice(at, GROUP)
                scores, _ = _score(model, scorer, text_bytes(part.column(place)))
                yield part.filter(pa.array(np.array(scores, float) < threshold))

    return arrow_map(docs, keep, docs.schema)
