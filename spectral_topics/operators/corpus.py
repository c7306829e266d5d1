"""Documents and tokens.

``tokens(doc_id, word_id, cnt)`` has one row per token; repeated rows add up. ``docs(doc_id)``
lists every document, also those without tokens. *Blocked* tokens carry a ``block`` column and
are partitioned by it, so that sums per document and the join back to tokens need no further
shuffle. When documents hold too many tokens for one task, their tokens are spread over all
blocks and marked in a ``spread`` column.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectral_topics.functions.skew import MIN_HOT_ROWS, fits_broadcast, hot_keys

# Tokens in a block: blocks grow in number with the corpus, not in size.
BLOCK_ROWS = 4_000_000


def flatten_documents(documents: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Tokens of documents stored as ``(doc_id, tokens ARRAY<STRUCT<word_id, cnt>>)``, merged."""
    rows = documents.select("doc_id", F.explode(tokens).alias("t"))
    return doc_terms(rows.select("doc_id", "t.word_id", "t.cnt"))


def doc_terms(df: DataFrame, doc: str = "doc_id", word: str = "word_id", cnt: str = "cnt") -> DataFrame:
    """Merge repeated words of a document by adding their counts."""
    return df.groupBy(F.col(doc).alias("doc_id"), F.col(word).alias("word_id")).agg(
        F.sum(F.col(cnt).cast("double")).alias("cnt")
    )


def check_word_ids(tokens: DataFrame, vocab_size: int) -> DataFrame:
    """Fail the job on a word id outside 0..vocab_size-1."""
    inside = (F.col("word_id") >= 0) & (F.col("word_id") < vocab_size)
    message = F.format_string("word id %d is outside 0.." + str(vocab_size - 1), F.col("word_id"))
    return tokens.where(F.when(inside, True).otherwise(F.raise_error(message)))


def block_tokens(
    tokens: DataFrame, partitions: int | None = None, min_hot_rows: int | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Partition tokens by document, every row as it is. Already blocked tokens are returned unchanged.

    There are ``partitions`` blocks, by default one for ``block_rows`` tokens and at least
    ``spark.sql.shuffle.partitions``. Documents with more tokens than an average block (and than
    ``min_hot_rows``) are spread over all blocks by word; there are fewer of them than blocks.
    A null document or word id fails the job.
    """
    if "block" in tokens.columns:
        return tokens
    known = F.col("doc_id").isNotNull() & F.col("word_id").isNotNull()
    tokens = tokens.select("doc_id", "word_id", F.col("cnt").cast("double").alias("cnt")).where(
        F.when(known, True).otherwise(F.raise_error(F.lit("a token without a document or word id")))
    )
    least = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total, hot = hot_keys(
        tokens,
        "doc_id",
        lambda rows: max(MIN_HOT_ROWS if min_hot_rows is None else min_hot_rows, rows // (partitions or max(least, -(-rows // block_rows)))),
    )
    n = partitions or max(least, -(-total // block_rows))
    if hot is None:
        place = F.xxhash64("doc_id")
    else:
        marked = F.broadcast(hot.withColumn("spread", F.lit(True)))
        spread = F.coalesce("spread", F.lit(False)).alias("spread", metadata={"documents": hot.count()})
        tokens = tokens.join(marked, "doc_id", "left").select("doc_id", "word_id", "cnt", spread)
        place = F.when(F.col("spread"), F.xxhash64("doc_id", "word_id")).otherwise(F.xxhash64("doc_id"))
    block = F.pmod(place, F.lit(n)).cast("int").alias("block", metadata={"blocks": n})
    return tokens.select("*", block).repartitionById(n, "block")


def block_count(tokens: DataFrame) -> int:
    return tokens.schema["block"].metadata["blocks"]


def document_sums(
    tokens: DataFrame,
    sums: Mapping[str, Column],
    enrich: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One row ``(doc_id, sums...)`` per document that has tokens.

    ``enrich`` adds the columns the sums need. Unblocked tokens are summed before the shuffle.
    """
    enrich = enrich or (lambda rows: rows)
    columns = [c.alias(name) for name, c in sums.items()]
    if "spread" in tokens.columns:
        whole = enrich(tokens.where(~F.col("spread"))).groupBy("block", "doc_id").agg(*columns).drop("block")
        return whole.unionByName(enrich(tokens.where("spread")).groupBy("doc_id").agg(*columns))
    rows = enrich(tokens)
    if "spread" in rows.columns or "block" not in rows.columns:
        return rows.groupBy("doc_id").agg(*columns)
    return rows.groupBy("block", "doc_id").agg(*columns).drop("block")


def join_document_sums(
    tokens: DataFrame,
    sums: Mapping[str, Column],
    enrich: Callable[[DataFrame], DataFrame] | None = None,
    shape: Callable[[DataFrame], DataFrame] | None = None,
    onto: DataFrame | None = None,
) -> DataFrame:
    """Attach per-document sums to every token of the document.

    ``onto`` are the blocked tokens with more columns, if those are wanted in the result.

    ``shape`` filters or rewrites the per-document rows before the join. Sums of spread
    documents (fewer than blocks) are broadcast to the blocks that hold their tokens if they fit.
    """
    blocked = block_tokens(tokens)
    enrich = enrich or (lambda rows: rows)
    columns = [c.alias(name) for name, c in sums.items()]
    per_doc = enrich(blocked).groupBy("block", "doc_id").agg(*columns)
    if "spread" in blocked.columns:
        totals = enrich(blocked.where("spread")).groupBy("doc_id").agg(*[c.alias(f"{n}_all") for n, c in sums.items()])
        few = blocked.schema["spread"].metadata["documents"]
        if fits_broadcast(tokens.sparkSession, few, len(sums)):
            totals = F.broadcast(totals)
        per_doc = per_doc.join(totals, "doc_id", "left").select(
            "block", "doc_id", *[F.coalesce(f"{n}_all", n).alias(n) for n in sums]
        )
    if shape:
        per_doc = shape(per_doc)
    return (blocked if onto is None else onto).join(per_doc, ["block", "doc_id"])


def doc_stats(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """``(doc_id, len)`` for every document; documents without tokens have length 0."""
    lengths = document_sums(tokens, {"len": F.sum("cnt")})
    return docs.select("doc_id").join(lengths, "doc_id", "left").select(
        "doc_id", F.coalesce("len", F.lit(0.0)).alias("len")
    )


def count_documents(docs: DataFrame) -> int:
    """The number of documents; an id that occurs twice, or is null, is an error."""
    per_id = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    total, most, nulls = per_id.agg(F.sum("n"), F.max("n"), F.count_if(F.col("doc_id").isNull())).first()
    if nulls or (most or 0) > 1:
        raise ValueError("documents need ids that differ and are not null")
    return total or 0


def corpus_counts(stats: DataFrame) -> DataFrame:
    """One row: all documents, documents usable for pair moments, for triple moments."""
    return stats.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if(F.col("len") >= 2).alias("n_pair"),
        F.count_if(F.col("len") >= 3).alias("n_triple"),
    )


def filter_min_len(tokens: DataFrame, n: float) -> DataFrame:
    """Tokens of documents of total count ``n`` or more."""
    rows = join_document_sums(
        tokens, {"len": F.sum("cnt")}, shape=lambda d: d.where(F.col("len") >= n)
    )
    return rows.select("doc_id", "word_id", "cnt")


def term_frequency(tokens: DataFrame) -> DataFrame:
    """``tf = cnt / len`` per token; documents of length 0 have no frequencies."""
    rows = join_document_sums(
        tokens, {"len": F.sum("cnt")}, shape=lambda d: d.where(F.col("len") != 0)
    )
    return rows.select("doc_id", "word_id", (F.col("cnt") / F.col("len")).alias("tf"))


def pair_weight(length: Column) -> Column:
    """1 / (len (len-1)), null below two words."""
    return F.when(length >= 2, 1.0 / (length * (length - 1.0)))


def dirichlet_weights(length: Column, alpha0: float) -> tuple[Column, Column]:
    """Second- and third-order weights of a document, null below three words."""
    usable = length >= 3
    pairs = length * (length - 1.0)
    s2 = F.when(usable, alpha0 * (alpha0 + 1.0) / (2.0 * pairs))
    s3 = F.when(usable, (alpha0 + 1.0) * (alpha0 + 2.0) / (2.0 * pairs * (length - 2.0)))
    return s2, s3


def moment_weights(stats: DataFrame, alpha0: float) -> DataFrame:
    s2, s3 = dirichlet_weights(F.col("len"), alpha0)
    return stats.select(
        "doc_id", "len", pair_weight(F.col("len")).alias("pair"), s2.alias("s2"), s3.alias("s3")
    )
