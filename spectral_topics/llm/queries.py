"""The registered queries of this subpackage and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectral_topics.llm import (
    conversation_repair,
    decontaminate,
    exact_dedup,
    language_id,
    mixing,
    periodic_runs,
    sentence_pieces,
    simhash,
    suffix_dedup,
    token_counts,
    token_output,
    toxicity,
    warc,
)
from spectral_topics.llm.common import crc_bucket, id_and_text, table

END_ID = 2


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix_copies(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_output.token_output(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), END_ID)
    return found.withColumnRenamed("id", "doc_id")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.warc_round_trip(table(spark, sf_dir, "pages"))
    return found.select(
        warc.page_of(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.page_of(F.col("refers_to")).alias("refers_to"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).select(
        F.col("id").alias("doc_id"),
        (crc_bucket("id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        F.size("spans").alias("n_spans"),
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict_languages(docs, language_id.fit_languages(docs))
    return found.select(F.col("id").alias("doc_id"), (crc_bucket("id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda total, h: total + h["end"] - h["start"])
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def repeated_on_purpose(docs: DataFrame) -> DataFrame:
    """``(id, text)`` of documents; in a tenth of them by hash, the words from some place on repeat with some period."""
    h = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))
    word = F.lit("[^\\x20\\x09-\\x0D]+")
    chosen = id_and_text(docs, "doc_id", "text").withColumn("h", h)
    chosen = chosen.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", word, F.lit(0))))
    g, n = F.floor(F.col("h") / 10), F.size("words")
    a = g % n
    placed = chosen.withColumn("a", F.when(n > 0, a).cast("int"))
    placed = placed.withColumn("p", F.when(n > 0, 1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    moved = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", F.col("a") + (i - F.col("a")) % F.col("p"))))
    return placed.select("id", F.when(n > 0, F.array_join(moved, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(repeated_on_purpose(table(spark, sf_dir, "documents")), "id")
    order = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    longest = F.array_max(order)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.withColumn("longest", longest).select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` with faults put in by hash; a null counts as one space."""
    space = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("role", "text"))
    changed = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return (
        conversations.where(kind != 0)
        .select(
            "conv_id",
            "turn",
            F.when(kind == 4, "user").otherwise(role).alias("role"),
            changed.alias("text"),
            F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
        )
        .drop("copy")
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    counts, pieces = conversation_repair.repair_conversations(damaged(conversations))
    digests = conversation_repair.conversation_digests(pieces).withColumnRenamed("conv", "its_conv")
    found = counts.join(digests, F.col("conv").eqNullSafe(F.col("its_conv")))
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    every = conversations.select("conv_id").distinct()
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select(
        "conv_id",
        *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer("piece_bpe_32k.model")
    found = sentence_pieces.decode(sentence_pieces.encode(table(spark, sf_dir, "documents"), model), model)
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_source_mixing": op2_source_mixing,
    "op3_token_output": op3_token_output,
    "op4_warc": op4_warc,
    "op5_toxicity": op5_toxicity,
    "op6_token_counts": op6_token_counts,
    "op7_language_id": op7_language_id,
    "op8_simhash": op8_simhash,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_sentence_pieces": op13_sentence_pieces,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(text) AS text_sha256
        FROM t WINDOW g AS (PARTITION BY text)""",
    # Base 32 writes five bits a character; five hexadecimal digits of the digest make four characters.
    "op4_warc": """
        WITH t AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        r AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS keep, sha1(html) AS h FROM t)
        SELECT page_id, strlen(html) AS payload_bytes,
               array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   ((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1, 1)
                   FOR i IN range(0, 32)], '')
                   AS payload_digest,
               CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> keep THEN keep END AS refers_to
        FROM r""",
    "op10_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bw AS (SELECT CAST(item_id AS VARCHAR) AS item, w[i:i + 9] AS g
               FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
        lens AS (SELECT DISTINCT len(g) AS n FROM bw),
        dw AS (SELECT doc_id, i, n, w[i:i + n - 1] AS g
               FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
        hits AS (SELECT DISTINCT doc_id, i, n, item FROM dw JOIN bw USING (g)),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
        found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
                  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)""",
}
