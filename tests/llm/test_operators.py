"""Each operator against brute force on messy documents: nulls, empty and long texts, repeats, clashing names, no rows."""

import base64
import hashlib
import json
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spectral_topics.llm import (
    common,
    components,
    decontaminate,
    exact_dedup,
    language_id,
    mixing,
    simhash,
    suffix_dedup,
    token_counts,
    token_output,
    toxicity,
    warc,
)
from tests.llm.conftest import DOCUMENTS, LONG

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [t or "" for _, t, _, _ in DOCUMENTS]
IDS = [i for i, _, _, _ in DOCUMENTS]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# exact dedup


@pytest.mark.parametrize("digest", [exact_dedup.sha256_text, lambda text: F.substring(F.sha2(text, 256), 1, 1)])
def test_exact_dedup(docs, digest):
    """With the weak digest many different texts share one."""
    groups = defaultdict(list)
    for i, t in zip(IDS, TEXTS):
        groups[t].append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    found = exact_dedup.exact_dedup(docs, digest=digest).collect()
    assert len(found) == len(DOCUMENTS)
    expected = Counter((i, keep[t], len(groups[t])) for i, t in zip(IDS, TEXTS))
    assert Counter((r["id"], r["keep_id"], r["group_size"]) for r in found) == expected
    assert sorted((r["keep_id"] for r in found if r["kept"]), key=str) == sorted(keep.values(), key=str)


def test_exact_dedup_digest(plain):
    found = {r["digest"] for r in exact_dedup.exact_dedup(plain).collect()}
    assert found == {hashlib.sha256(t.encode()).hexdigest() for t in TEXTS}


def test_exact_dedup_hot_text(spark):
    """A text that most rows have is joined by broadcast, the others by shuffle."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    found = exact_dedup.exact_dedup(df)
    assert found.where("kept").count() == 1001
    assert found.groupBy("group_size").count().orderBy("group_size").collect() == [(1, 1000), (2000, 2000)]


def test_keep_unique(docs):
    kept = exact_dedup.keep_unique(docs)
    assert kept.columns == docs.columns
    assert sorted(r["text"] or "" for r in kept.collect()) == sorted(set(TEXTS))


# mixing


def targets_by_hand(sizes, weights, most):
    """Deal by weight, fix whoever is above its limit, deal the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > most * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in above}


def test_mix_targets_and_copies(docs):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes = defaultdict(int)
    for (_, t, _, s) in DOCUMENTS:
        sizes[s] += size(t or "")
    expected = targets_by_hand(sizes, (5, 2, 1), 3)
    found = mixing.mix_copies(docs)
    once, again = rows(found), rows(mixing.mix_copies(docs))
    assert once == again and len(once) == len(DOCUMENTS)
    for r in found.collect():
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(expected[r["source"]])
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert int(rate - 1e-6) <= r["copies"] <= min(3, int(rate + 1e-6) + 1)


def test_mix_comes_near_its_targets(spark):
    df = spark.range(4000).select(
        F.col("id").alias("doc_id"),
        F.repeat(F.lit("w "), (F.col("id") % 37).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 11)).alias("source"),
    )
    taken = mixing.mix_copies(df).groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("k"))
    for r in taken.collect():
        assert abs(r["k"] - r["t"]) <= 80
    copies = mixing.mix_copies(df).collect()
    mixed = Counter(r["doc_id"] for r in mixing.mix(df).collect())
    assert mixed == Counter({r["id"]: r["copies"] for r in copies if r["copies"]})


def test_mixing_stores_no_texts(spark, docs, monkeypatch):
    """Ranges are made of sizes and keys; the rows themselves are shuffled once, to the result."""
    stored, plain = [], mixing.materialize
    monkeypatch.setattr(mixing, "materialize", lambda df, label: stored.append(df.columns) or plain(df, label))
    found = mixing.mix(docs)
    assert stored and not any({"row", "text"} & set(columns) for columns in stored)
    data = [(d, t, s) for d, t, _, s in DOCUMENTS]
    copies = Counter(map(tuple, found.select("doc_id", "text", "source").collect()))
    expected = Counter()
    for r in mixing.mix_copies(docs, keyed=True).collect():
        expected[r["id"], r["source"], r["size"]] += r["copies"]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by_key = Counter()
    for (d, t, s), n in copies.items():
        assert (d, t, s) in data
        by_key[d, s, size(t)] += n
    assert by_key == +expected


def test_mix_deals_a_key_s_copies_to_its_rows(spark):
    """Twenty equal rows and one other: targets are met by rows of one key too, each within its bounds."""
    df = spark.createDataFrame([(1, "a b", "s", i) for i in range(20)] + [(2, "c d e", "t", 20)], "doc_id long, text string, source string, n int")
    copies = mixing.mix_copies(df).where("id = 1").agg(F.sum("copies"), F.min("copies"), F.max("copies")).first()
    mixed = Counter(r["n"] for r in mixing.mix(df).where("doc_id = 1").collect())
    assert sum(mixed.values()) == copies[0]
    assert all(copies[1] <= mixed[i] <= copies[2] for i in range(20))


def test_mix_keeps_columns(docs):
    assert mixing.mix(docs).columns == docs.columns


def test_mix_crosses_integers(spark):
    """Copies of a source are the integers between prefix sums of expected copies, whatever the partitions."""
    data = [("s", 1, i, 0.3 * (i % 5)) for i in range(50)]
    for n in (1, 7):
        df = spark.createDataFrame(data, "source string, size long, id long, expected double").repartition(n)
        copies = [r["copies"] for r in sorted(mixing.systematic_copies(df).collect(), key=lambda r: r["id"])]
        sums = np.cumsum([d[3] for d in data])
        assert all(abs(c - s) <= 1 for c, s in zip(np.cumsum(copies), sums))


# token output


def library_ids(texts, path=WORDS):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_known_words_are_found_without_arrow_scalars():
    """Encoding words that are all remembered takes less time than listing them by Arrow's scalars alone would."""
    import time

    import pyarrow as pa

    def best(work):
        took = []
        for _ in range(3):
            began = time.process_time()
            work()
            took.append(time.process_time() - began)
        return min(took)

    encoder = token_output.WordEncoder(open(WORDS, "rb").read())
    texts = [" ".join(f"w{i}" for i in range(at, at + 500)).encode() for at in range(0, 100_000, 500)]
    first = encoder.encode(texts)
    listed = pa.array([w for t in texts for w in t.split()], pa.large_binary())
    assert best(lambda: encoder.encode(texts)) < best(listed.to_pylist)
    assert encoder.encode(texts) == first == [np.array(x, encoder.type).tobytes() for x in library_ids([t.decode() for t in texts])]
    assert encoder.encode([b"", b" "]) == [b"", b""] and encoder.encode([]) == []


def test_token_output(spark, docs, tmp_path):
    folder = str(tmp_path)
    manifest = token_output.write_tokens(docs, folder, open(WORDS, "rb").read(), 2, length=16, batch=3)
    found = token_output.read_documents(manifest).collect()
    order = sorted(range(len(IDS)), key=lambda k: (IDS[k] is not None, IDS[k] or 0, TEXTS[k].encode()))
    ids = [x + [2] for x in library_ids([TEXTS[k] for k in order])]
    start, expected = 0, []
    for k, x in zip(order, ids):
        expected.append((IDS[k], start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    assert sorted(map(tuple, found), key=lambda r: r[1]) == expected
    stream, files = [], sorted(manifest.collect(), key=lambda r: r["shard"])
    for r in files:
        sequences = token_output.SequenceFile(r["path"] + ".arrow")
        whole = [t for i in range(len(sequences)) for t, m in zip(sequences.ids_of(i).tolist(), sequences.mask_of(i).tolist()) if m]
        assert len(whole) == r["n_tokens"] and all(len(sequences.ids_of(i)) == 16 for i in range(len(sequences)))
        assert sequences.ids_of(0).base is not None  # a view, not a copy
        stream += whole
    assert stream == [t for x in ids for t in x]


def no_replace(spec):
    spec["normalizer"]["normalizers"].pop(1)


def another_replace(spec):
    spec["normalizer"]["normalizers"][1] = {"type": "Replace", "pattern": {"String": "-"}, "content": "x"}


def compatible_letters(spec):
    spec["normalizer"]["normalizers"][0] = {"type": "NFKC"}


def prefix_space(spec):
    spec["pre_tokenizer"]["pretokenizers"][1]["add_prefix_space"] = True


def another_pattern(spec):
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": "[\\p{L}]+ ?|[^\\p{L}]"}


def stripping_token(spec):
    spec["added_tokens"][0]["lstrip"] = True


@pytest.mark.parametrize("change", [None, no_replace, another_replace, compatible_letters, prefix_space, another_pattern, stripping_token])
def test_altered_vocabularies_give_the_librarys_ids(change):
    spec = json.load(open(WORDS))
    if change:
        change(spec)
    vocabulary = json.dumps(spec).encode()
    rng = np.random.default_rng(9)
    parts = [*"abC- \n\té漢.,'\u0130\u00df\x1c\u00a0\uff21", "The ", "<|startoftext|>", "<|endoftext|>", "don't", " x-ray ", "  "]
    texts = ["".join(rng.choice(parts, rng.integers(0, 25))) for _ in range(400)]
    found = token_output.encoder(vocabulary)
    assert token_output.splits_at_white_space(vocabulary) == (change is None)
    expected = Tokenizer.from_str(vocabulary.decode()).encode_batch(texts, add_special_tokens=False)
    assert found.encode([t.encode() for t in texts]) == [np.array(e.ids, found.type).tobytes() for e in expected]


def test_word_encoder_with_little_memory(monkeypatch):
    for name in ("WORDS", "PIECES", "GATHERED"):
        monkeypatch.setattr(token_output, name, 5)
    found = token_output.WordEncoder(open(WORDS, "rb").read())
    for texts in (["a b c d e f", "", " g h "], ["a b", "i j k a, a."], ["x"] * 20):
        assert found.encode([t.encode() for t in texts]) == [np.array(i, found.type).tobytes() for i in library_ids(texts)]


def test_word_encoder_fuzz():
    rng = np.random.default_rng(5)
    encode = token_output.WordEncoder(open(WORDS, "rb").read()).encode
    alphabet = [*"aBzéÑÜß01½²ª'.!,_ \t\n\x0b\x1c\x00\x85\xa0İ́ͅÅΣ中\U0001f600", "'s", "'LL", "<|endoftext|>", "<|", "|>", "  "]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 14))) for _ in range(3000)]
    found = [np.frombuffer(x, "<u2").tolist() for x in encode([t.encode() for t in texts])]
    assert found == library_ids(texts)


# warc


@pytest.mark.parametrize("least", [0, 1000])
def test_warc(spark, tmp_path, least):
    pages = [(i, f"http://x/{i}", t) for i, (_, t, _, _) in enumerate(DOCUMENTS)] + [(100, None, "x\r\n\r\ny"), (101, "u\nv", "x\r\n\r\ny"), (None, "n", "x\r\n\r\ny")]
    df = spark.createDataFrame([(*p, "c", "d") for p in pages], "page_id long, url string, html string, payload string, digest string")
    manifest = warc.write_warc(df, str(tmp_path), min_bytes=least)
    found = {r["record_id"]: r for r in warc.read_warc(manifest).collect()}
    assert len(found) == len(pages)
    largest = {}
    for p, _, t in pages:
        largest[t or ""] = max(largest.get(t or "", -1), -1 if p is None else p)
    for p, _, t in pages:
        payload = (t or "").encode()
        r = found[warc.record_id(p)]
        revisit = p is not None and p != largest[t or ""] and len(payload) >= least
        assert r["record_type"] == ("revisit" if revisit else "response")
        assert r["refers_to"] == (warc.record_id(largest[t or ""]) if revisit else None)
        assert r["payload_bytes"] == len(payload)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_bundle_is_seekable(tmp_path):
    path = str(tmp_path / "b.warc.zst")
    data = {f"r{i}": bytes([65 + i % 26]) * (i * 37 % 900) for i in range(200)}
    out = warc.BundleWriter(path, frame=2000)
    for k, v in data.items():
        out.add(k, v)
    out.close()
    bundle = warc.Bundle(path)
    assert len(bundle.frames) > 10
    assert all(bundle.record(k) == v for k, v in data.items())
    # Any Zstandard reader gets all records in order, passing over the seek table.
    with open(path, "rb") as f:
        whole = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    assert whole == b"".join(data.values())


# toxicity


def toxic_fixture():
    rng = np.random.default_rng(3)
    clean = ["".join(rng.choice(["ba", "co", "di", "fu", "ge"], rng.integers(1, 4))) for _ in range(300)]
    docs, labels = [], []
    for i in range(600):
        words = list(rng.choice(clean, rng.integers(5, 60)))
        bad = i % 4 == 0
        if bad:
            for _ in range(rng.integers(1, 4)):
                words.insert(rng.integers(0, len(words)), str(rng.choice(["vilest", "grubling", "vilecur", "grubface"])))
        docs.append((i, " ".join(words) + "."))
        labels.append((i, int(bad)))
    return docs, labels


def test_toxicity(spark):
    docs, labels = toxic_fixture()
    extra = [(1000, None), (1001, ""), (1002, "nothing " * 30_000), (None, "a vilehound"), (1003, "İ vilecur here")]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs + extra], "doc_id long, text string, score string")
    known = spark.createDataFrame([*labels, (0, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(df, known)
    found = {r["id"]: r for r in toxicity.score_toxicity(df, model).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    right = [(found[i]["score"] >= 0.7) == bool(y) for i, y in labels if i in set(held)]
    assert len(held) > 100 and np.mean(right) > 0.97
    assert found[1000]["score"] == found[1001]["score"] < 0.3 and found[1002]["score"] < 0.3
    text = dict(docs)
    for i, y in labels:
        for s in found[i]["spans"]:
            assert re.search("vile|grub", text[i][s["start"] : s["end"]])
    assert [("İ vilecur here"[s["start"] : s["end"]]) for s in found[1003]["spans"]] == ["vilecur"]
    kept = toxicity.drop_toxic(df, model)
    assert kept.columns == df.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, r in found.items() if r["score"] < 0.7)


def test_toxicity_without_labels(docs, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    found = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, none)).collect()
    assert len(found) == len(DOCUMENTS) and {r["score"] for r in found} == {0.0}


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(0)
    lengths = np.array([5, 4, 4, 1])
    odds, moves = rng.normal(size=(4, 5)), rng.normal(size=(2, 2))
    forward, backward = toxicity.forward_backward(odds, lengths, moves)
    for r, n in enumerate(lengths):
        total = np.zeros(n)
        norm = 0.0
        for path in np.ndindex(*(2,) * n):
            w = np.exp(sum(odds[r, t] * s for t, s in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            norm += w
            total += w * np.array(path)
        np.testing.assert_allclose(toxicity.sigmoid(forward + backward)[r, :n], total / norm, rtol=1e-9)


@pytest.mark.parametrize("piece", [1, 2, 7, 60])
def test_chains_run_through_pieces(monkeypatch, piece):
    """Documents laid out in pieces have the marginals of one chain each, with weak, strong and extreme weights."""
    monkeypatch.setattr(toxicity, "PIECE", piece)
    rng = np.random.default_rng(piece)
    for strength in (1, 4, 40):
        adds = rng.normal(size=(30, 3)) * strength
        model = toxicity.ToxicityModel(share=0.5, fitted=True, bias=-0.3, moves=rng.normal(size=(2, 2)) * min(strength, 6))
        words = [rng.integers(0, 30, n) for n in (0, 1, 5, 59, 60, 61, 130, 0, 400)]
        for w, found in zip(words, toxicity.chain_marginals(model, words, adds), strict=True):
            if not len(w):
                assert not len(found)
                continue
            odds = model.bias + adds[w, 0]
            odds[1:] += adds[w[:-1], 1]
            odds[:-1] += adds[w[1:], 2]
            forward, backward = toxicity.forward_backward(odds[None, :], np.array([len(w)]), model.moves)
            np.testing.assert_allclose(found, toxicity.sigmoid(forward + backward)[0], rtol=1e-6, atol=1e-12)


def test_gradients_by_differences():
    """Of the likelihood of tags, by every odds and every transition."""
    rng = np.random.default_rng(2)
    lengths = np.array([4, 3])
    inside = np.arange(4) < lengths[:, None]
    odds, moves = rng.normal(size=(2, 4)) * inside, rng.normal(size=(2, 2))
    tags = (rng.random((2, 4)) < 0.5) * inside * 1.0

    def likelihood(odds, moves):
        total = 0.0
        for r, n in enumerate(lengths):
            def score(path):
                return sum(odds[r, t] * s for t, s in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:]))
            total += score(tags[r, :n].astype(int)) - np.log(sum(np.exp(score(p)) for p in np.ndindex(*(2,) * n)))
        return total

    def differences(x, f):
        out = np.zeros_like(x)
        for at in np.ndindex(x.shape):
            step = np.zeros_like(x)
            step[at] = 1e-5
            out[at] = (f(x + step) - f(x - step)) / 2e-5
        return out

    forward, backward = toxicity.forward_backward(odds, lengths, moves)
    wrong = (tags - toxicity.sigmoid(forward + backward)) * inside
    np.testing.assert_allclose(wrong, differences(odds, lambda x: likelihood(x, moves)), atol=1e-7)
    found = toxicity._move_gradient(forward, backward, odds, moves, tags, inside).reshape(2, 2)
    np.testing.assert_allclose(found, differences(moves, lambda x: likelihood(odds, x)), atol=1e-7)


def test_words_are_the_same_fitted_and_scored():
    assert toxicity.words_of("İstanbulvile ÄB c1d") == ["İstanbulvile".lower(), "äb", "c", "d"]


# token counts


def test_token_counts(docs):
    found = token_counts.token_counts(docs, BYTES).collect()
    expected = Counter((i, len(t.encode()), len(x)) for i, t, x in zip(IDS, TEXTS, library_ids(TEXTS, BYTES)))
    assert Counter(map(tuple, found)) == expected


def test_token_counter_fuzz():
    rng = np.random.default_rng(6)
    data = open(BYTES, "rb").read()
    whole = token_counts.whole_tokens(data)
    counter = token_counts.TokenCounter(data, whole)
    alphabet = [*"aBé01½'.!, \t\n\x0b\x1c\x00\x85\xa0 ́Σ中֍\U0001f600", " the", " and", "'s", "'ll", "<|endoftext|>", "  ", "ing"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 16))) for _ in range(3000)]
    assert [counter.count(t) for t in texts] == [len(x) for x in library_ids(texts, BYTES)]
    assert " the" in whole and len(whole) > 40_000
    sample = sorted(whole)[::500]
    assert all(len(x) == 1 for x in library_ids(sample, BYTES))


# language


def language_fixture(seed=4):
    rng = np.random.default_rng(seed)
    parts = {"en": ["the", "ing", "and", "er"], "de": ["sch", "ung", "der", "ü"], "fr": ["eau", "que", "les", "é"]}
    return [(i, " ".join("".join(rng.choice(parts[k], 3)) for _ in range(rng.integers(2, 40))), k) for i in range(300) for k in [list(parts)[i % 3]]]


def test_language(spark):
    data = language_fixture()
    extra = [(1000, None, "en"), (1001, "", None), (1002, "12 !?", "de"), (None, "the and ing", "en"), (1003, "und der schung " * 20_000, None)]
    df = spark.createDataFrame([(*r, "x") for r in data + extra], "doc_id long, text string, lang string, score string")
    model = language_id.fit_languages(df)
    found = {r["id"]: r for r in language_id.predict_languages(df, model).collect()}
    held = [(i, k) for i, _, k in data if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([found[i]["lang_pred"] == k for i, k in held]) > 0.98
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert found[1003]["lang_pred"] == "de" and all(0 <= r["score"] <= 1 for r in found.values())


def chinese(rng, lexicon, n):
    """Words of two letters out of 3,000; languages differ in their words, not in their letters."""
    return "".join(lexicon[i] for i in rng.integers(0, len(lexicon), n // 2))


def test_language_of_very_long_texts():
    """A million characters over thousands of letters fill every slot; the language is still found."""
    rng = np.random.default_rng(8)
    letters = [chr(0x4E00 + i) for i in range(3000)]
    lexicons = {name: ["".join(rng.choice(letters, 2)) for _ in range(4000)] for name in ("one", "two")}
    labels = ["one", "two"] * 60
    model = language_id.fit([chinese(rng, lexicons[x], 1500) for x in labels], labels)
    presences = language_id.Presences()
    for name in lexicons:
        long = chinese(rng, lexicons[name], 1_000_000)
        used, _ = presences.fill([long])
        assert used.mean() > 0.9
        found, scores = language_id.predict(model, [long, long[:900], "1" * 50_000 + long[:900], "1" * 50_000], presences)
        assert found == [name, name, name, "und"] and scores[0] > 0.5 and scores[3] == 0.0


def test_pieces_keep_every_n_gram():
    for n in (0, 1, 5, 8192, 8193, 30_000):
        text = "".join(chr(97 + i * i % 26) for i in range(n))
        pieces = list(language_id.pieces_of(text))
        assert max(map(len, pieces)) <= 8192 + 3
        whole = {text[i : i + k] for k in (1, 2, 3, 4) for i in range(n - k + 1)}
        assert {p[i : i + k] for p in pieces for k in (1, 2, 3, 4) for i in range(len(p) - k + 1)} == whole


def test_language_regression_is_kernel_ridge(monkeypatch):
    """With every text a landmark, the values are those of weighted kernel ridge regression on kernels of sets."""
    rng = np.random.default_rng(2)
    labels = ["a"] * 10 + ["b"] * 20 + ["c"] * 15
    texts = ["".join(rng.choice(list("abcdefgh "), 80, p=np.roll([0.3, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05], ord(x)))) for x in labels]
    grams = [frozenset(np.concatenate(list(language_id.slots_of(t)))) for t in texts]
    among = np.array([[len(x & y) / np.sqrt(len(x) * len(y)) for y in grams] for x in grams])
    weight = np.array([1.0 / labels.count(x) for x in labels])
    target = np.where(np.array(labels)[:, None] == np.array(["a", "b", "c"]), 1.0, -1.0)
    expected = among @ np.linalg.solve(among + language_id.RIDGE * np.diag(1 / weight), target)
    found, _ = language_id.regression_values(language_id.fit(texts, labels), texts, language_id.Presences())
    np.testing.assert_allclose(found, expected, atol=1e-3)


def test_language_without_labels(spark, docs):
    df = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.predict_languages(df, language_id.fit_languages(df)).collect()} == {"und"}


def test_kernel_by_hand():
    """Folding landmarks into the table changes no value."""
    data = language_fixture()[:60]
    texts, labels = [t for _, t, _ in data], [k for _, _, k in data]
    grams = [frozenset(np.concatenate(list(language_id.slots_of(t)))) for t in texts]
    rows_ = np.zeros((2, language_id.SLOTS), np.float32)
    for r, g in enumerate(grams[:2]):
        rows_[r, list(g)] = 1 / np.sqrt(len(g))
    expected = [[len(a & b) / np.sqrt(len(a) * len(b)) for b in grams[:2]] for a in grams]
    np.testing.assert_allclose(language_id.kernel(texts, rows_, language_id.Presences()), expected, atol=1e-5)
    assert language_id.predict(language_id.fit(texts, labels), texts, language_id.Presences())[0] == labels


# simhash


def print_by_hand(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return [find(x) for x in range(n)]


def test_simhash(docs):
    found = simhash.simhash_components(docs).collect()
    prints = [print_by_hand(t, 3) for t in TEXTS]
    root = union(len(IDS), [(i, j) for i in range(len(IDS)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    least = {r: min((i for i, x in zip(IDS, root) if x == r and i is not None), default=None) for r in root}
    expected = Counter((i, p, least[r]) for i, p, r in zip(IDS, prints, root))
    assert Counter((r["id"], r["fp"] % (1 << 64), r["component_id"]) for r in found) == expected


def test_ball_links_find_every_pair(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-(1 << 62), 1 << 62, 40)
    prints = sorted({int(b) ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 4), replace=False)) for b in base for _ in range(6)})
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    roots = {r["node"]: r["root"] for r in components.connected_components(simhash.ball_links(df, 2)).collect()}
    near = [(i, j) for i in range(len(prints)) for j in range(i) if ((prints[i] ^ prints[j]) & ((1 << 64) - 1)).bit_count() <= 2]
    expected = union(len(prints), near)
    found = [roots.get(p, p) for p in prints]
    assert len(near) > 50
    assert all((found[i] == found[j]) == (expected[i] == expected[j]) for i in range(len(prints)) for j in range(i))


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60) if i % 20 != 19] + [(100, i) for i in range(101, 160)] + [(5, 5), (5, 6)]
    found = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: i // 20 * 20 for i in range(60)} | {i: 100 for i in range(100, 160)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_unique(spark, docs):
    rng = np.random.default_rng(1)
    base = [" ".join(str(w) for w in rng.integers(0, 5000, 400)) for _ in range(8)]
    near = [b.replace(b.split()[200], "changed") for b in base]
    data = [(i, t) for i, t in enumerate(base + near + base)] + [(500, base[0]), (0, base[0])]
    df = spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, fp0 string").repartition(4)
    kept = simhash.near_unique(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(8))
    messy = simhash.near_unique(docs)
    assert messy.columns == docs.columns
    shingled = {" ".join((t or "").lower().split()) for t in TEXTS}
    assert messy.count() == len(shingled)


def set_groups(texts, similarity):
    """Roots by the exact Jaccard similarity of five-word shingle sets of all pairs."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    pairs = [(i, j) for i in range(len(sets)) for j in range(i)]
    # Whole numbers: J >= similarity in hundredths.
    return union(len(sets), [(i, j) for i, j in pairs if 100 * len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])])


def kept_by_hand(texts, similarity=80):
    roots = set_groups(texts, similarity)
    return sorted({r: i for i, r in reversed(list(enumerate(roots)))}.values())


def changed(rng, text, times):
    words = text.split()
    for at in rng.choice(len(words), times, replace=False):
        words[at] = f"n{rng.integers(1 << 40)}"
    return " ".join(words)


def kept_ids(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return sorted(r["doc_id"] for r in simhash.near_unique(df).collect())


def test_near_unique_leaves_no_shuffle_files(spark, docs, monkeypatch):
    """Each stored table's shuffle goes with it; else all of them lie on disk together until the driver collects garbage."""
    setting, seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    before, plain = spark.conf.get(setting), simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, label: seen.append(spark.conf.get(setting)) or plain(df, label))
    kept = simhash.near_unique(docs)
    assert seen and set(seen) == {"true"} and spark.conf.get(setting) == before
    assert kept.count() > 0


def test_few_rows_without_a_partner_are_left(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc"), F.hash("id").cast("long").alias("tie"), F.lit("x").alias("text"))
    keys = rows.where("doc % 100 = 7").select("doc", "tie")
    left = common.maybe_among(rows, keys, ["doc", "tie"])
    found = {r["doc"] for r in left.collect()}
    assert left.columns == rows.columns and found >= {r["doc"] for r in keys.collect()}
    assert len(found) < 250
    # Three bits for all keys: whatever is hashed to them stays.
    assert {r["doc"] for r in common.maybe_among(rows, keys, ["doc", "tie"], bits=3).collect()} >= {r["doc"] for r in keys.collect()}
    assert common.maybe_among(rows, keys.limit(0), ["doc", "tie"]).count() == 0


def test_near_unique_of_templated_texts(spark):
    rng = np.random.default_rng(3)
    template = " ".join(f"t{i}" for i in range(200))
    texts = [template + " " + " ".join(f"w{rng.integers(1 << 40)}" for _ in range(100)) for _ in range(150)]
    # A copy of about 0.9 of each, hidden among strangers of 0.49.
    texts += [changed(rng, t, 3) for t in texts]
    expected = kept_by_hand(texts)
    assert expected == list(range(150))
    assert kept_ids(spark, texts) == expected


def test_near_unique_finds_all_at_the_threshold(spark):
    rng = np.random.default_rng(4)
    bases = [" ".join(f"w{rng.integers(1 << 40)}" for _ in range(300)) for _ in range(60)]
    # Similarities from about 0.65 to 0.95, on both sides of 0.8.
    texts = bases + [changed(rng, b, k) for k in (2, 4, 6, 7, 8, 10, 12) for b in bases[:40]]
    expected = kept_by_hand(texts)
    assert 60 < len(expected) < len(texts) - 60
    assert kept_ids(spark, texts) == expected


def test_near_unique_of_a_large_group(spark):
    rng = np.random.default_rng(5)
    base = " ".join(f"w{rng.integers(1 << 40)}" for _ in range(200))
    # Copies near the base, not near each other; chains; texts that are nearly all template.
    texts = [changed(rng, base, 3) for _ in range(80)] + [base]
    for _ in range(5):
        texts.append(changed(rng, texts[-1], 3))
    texts += [changed(rng, base, k) for k in (5, 6, 7) for _ in range(30)]
    assert kept_ids(spark, texts) == kept_by_hand(texts)


def pairs_compared(spark, monkeypatch, texts):
    """How many pairs ``near_unique`` compares by their whole sets; what it keeps is checked."""
    compared, plain = [], simhash.similar

    def counted(pairs, sets, similarity):
        compared.append(pairs.count())
        return plain(pairs, sets, similarity)

    monkeypatch.setattr(simhash, "similar", counted)
    assert kept_ids(spark, texts) == kept_by_hand(texts)
    return sum(compared)


def test_strangers_of_one_template_are_not_compared(spark, monkeypatch):
    """460 shingles, 400 of them of one template: no two texts are similar, and pairs don't grow with their square."""
    rng = np.random.default_rng(6)
    template = " ".join(f"t{i}" for i in range(404))
    texts = [template + " " + " ".join(f"w{rng.integers(1 << 40)}" for _ in range(60)) for _ in range(120)]
    assert pairs_compared(spark, monkeypatch, texts) <= len(texts)


def test_copies_of_a_base_below_the_threshold_are_not_compared(spark, monkeypatch):
    """Copies at about 0.8 of one base and 0.65 of each other, some edits in common."""
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(150)]
    edits = [(int(at), f"e{n}") for n, at in enumerate(rng.integers(0, 150, 60))]
    texts = []
    for _ in range(200):
        words = list(base)
        for n in rng.choice(len(edits), 4, replace=False):
            words[edits[n][0]] = edits[n][1]
        texts.append(" ".join(words))
    assert pairs_compared(spark, monkeypatch, texts) <= 10 * len(texts)


def test_parity_sketches_differ_in_no_more_than_the_sets():
    rng = np.random.default_rng(8)
    for size in (0, 5, 300, 5000):
        for change in (0, 1, 40):
            a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            b = np.unique(np.append(a[change:], rng.integers(0, 1 << 63, change).astype(np.uint64)))
            bits = int(np.unpackbits((simhash.parity_sketch(a) ^ simhash.parity_sketch(b)).view(np.uint8)).sum())
            assert bits <= len(np.setxor1d(a, b))
    assert (simhash.parity_sketch(a) == simhash.parity_sketch(a[::-1])).all()


# repeated substrings


def removed_by_hand(documents, length):
    """Kept bytes and number of spans of each (id, text)."""
    order = sorted(set(documents), key=lambda d: (d[0] is not None, d[0] or 0, zlib.crc32(d[1])))
    seen, out = set(), {}
    for doc, text in order:
        gone = np.zeros(len(text) + 1, bool)
        for s in range(len(text) - length + 1):
            if text[s : s + length] in seen:
                gone[s : s + length] = True
            seen.add(text[s : s + length])
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[doc, text] = bytes(np.frombuffer(text, np.uint8)[~gone[:-1]]), spans
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_without_repeats(spark, monkeypatch, hot):
    """Texts pasted together from few pieces; in the second run every gram counts as hot."""
    if hot:

        def every_gram(rows, shape, buckets, total):
            bounds, _ = SPLITTERS(rows, shape, buckets, total)
            return bounds, bounds

        monkeypatch.setattr(suffix_dedup, "splitters", every_gram)
    rng = np.random.default_rng(9)
    pieces = ["".join(map(chr, rng.integers(97, 100, rng.integers(5, 90)))) for _ in range(12)] + ["é" * 30, "a" * 80, "\x00" * 50]
    data = [(i, "".join(rng.choice(pieces, rng.integers(0, 8)))) for i in range(60)] + [(7, "x"), (None, pieces[0] * 2), (3, None)]
    data += data[5:8]
    df = spark.createDataFrame([(*d, "x") for d in data], "doc_id long, text string, spans string").repartition(5)
    found = suffix_dedup.without_repeats(df, length=40).collect()
    expected = removed_by_hand([(i, (t or "").encode()) for i, t in data], 40)
    got = Counter((r["id"], r["n_bytes"], bytes(r["kept"]), len(r["spans"])) for r in found)
    assert got == Counter((i, len((t or "").encode()), *expected[i, (t or "").encode()]) for i, t in data)


SPLITTERS = suffix_dedup.splitters


def test_few_very_long_documents_give_splitters(spark):
    """Four texts of a megabyte, a share of a two-hundredth: stretches of all of them are sampled, and buckets get bounds."""
    rng = np.random.default_rng(6)
    texts = [rng.choice(list("abcdefghijklmnop "), 1_000_000).astype("<U1").tobytes().decode("utf-32-le") for _ in range(4)]
    df = spark.createDataFrame([*enumerate([*texts, "", "x" * 99, None])], "doc_id long, text string")
    rows, shape = suffix_dedup.prepared(df, "doc_id", "text"), suffix_dedup.Shape(100, 28)
    found = suffix_dedup.stretches(rows, shape, 0.05).collect()
    assert 10 <= len(found) <= 45 and {r["doc"] for r in found} == {0, 1, 2, 3}
    assert all(bytes(r["text"]).decode() in texts[r["doc"]] and len(r["text"]) <= 8192 + 99 for r in found)
    whole = suffix_dedup.stretches(rows, shape, 1.0).groupBy("doc").sum().collect()
    assert len(whole) == 4
    starts = sum(len(r["text"]) - 99 for r in suffix_dedup.stretches(rows, shape, 1.0).collect())
    assert starts == sum(len(t) - 99 for t in texts)
    bounds, hot = SPLITTERS(rows, shape, 64, 4_000_000)
    assert len(bounds) == 63 and not len(hot)


def test_long_texts_are_taken_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 500)
    monkeypatch.setattr(suffix_dedup, "GROUP", 900)
    rng = np.random.default_rng(4)
    text = "".join(map(chr, rng.integers(97, 123, 3000)))
    df = spark.createDataFrame([(1, text), (2, text[700:1500] + text[:300])], "doc_id long, text string")
    found = {r["id"]: r for r in suffix_dedup.without_repeats(df).collect()}
    assert found[1]["spans"] == [] and bytes(found[2]["kept"]) == b""


# decontamination

SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return SPLIT.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def hits_by_hand(texts, items, window=10):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add("" if i is None else str(i))
    out = []
    for t in texts:
        w = words(t)
        hit, found = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if items_ := windows.get(tuple(w[k : k + n])):
                    found |= items_
                    hit[k : k + n] = [True] * n
        out.append((len(w), sum(hit), tuple(sorted(found))))
    return out


ITEMS = [(1, "brown fox jumps over the lazy dog and runs away now"), (2, "Lorem ipsum dolor sit amet lorem ipsum dolor sit amet"), (3, "two"), (3, "same ID"), (None, "über öl"), (4, None), (5, "")]


@pytest.mark.parametrize("limits", [{}, {"chunk_bytes": 20}, {"shard_bytes": 50}])
def test_contamination(spark, docs, limits):
    bench = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, hits string")
    found = decontaminate.contamination(docs, bench, **limits).collect()
    got = Counter((r["id"], r["n_words"], sum(h["end"] - h["start"] for h in r["hits"]), tuple(sorted(r["items"]))) for r in found)
    assert got == Counter((i, *x) for i, x in zip(IDS, hits_by_hand(TEXTS, ITEMS)))


def test_remove_contamination(spark, docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.remove_contamination(docs, bench)
    assert found.columns == docs.columns
    left = Counter((r["doc_id"], r["text"]) for r in found.collect())
    for (i, t, _, _), (n, hit, _) in zip(DOCUMENTS, hits_by_hand(TEXTS, ITEMS)):
        if not hit:
            assert left[i, t]
    assert LONG not in {t for _, t in left} and (6, "") not in left
    assert (9, "12 345 it's they'll    spaces\n\nlines\ttabs ") in left


def test_empty_benchmark(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert all(not r["hits"] and not r["items"] for r in decontaminate.contamination(docs, bench).collect())


def test_fm_index():
    from spectral_topics.llm.fm_index import FMIndex, suffix_array

    rng = np.random.default_rng(0)
    for _ in range(40):
        s = rng.integers(0, 4, rng.integers(1, 150))
        ended = np.concatenate((s + 1, [0]))
        assert suffix_array(ended).tolist() == sorted(range(len(ended)), key=lambda i: ended[i:].tolist())
        index = FMIndex(s, 4)
        for n in (1, 2, 4):
            patterns = rng.integers(1, 4, (15, n))
            for p, a, b in zip(patterns, *index.search(patterns)):
                places = [i for i in range(len(s) - n + 1) if (s[i : i + n] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == places


# nothing at all


def test_no_documents(spark, no_docs, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for found in (
        exact_dedup.exact_dedup(no_docs),
        exact_dedup.keep_unique(no_docs),
        mixing.mix_copies(no_docs),
        mixing.mix(no_docs),
        token_output.token_output(no_docs, WORDS, 2, folder=str(tmp_path)),
        warc.warc_round_trip(pages),
        toxicity.score_toxicity(no_docs, toxicity.fit_toxicity(no_docs, labels)),
        token_counts.token_counts(no_docs, BYTES),
        language_id.predict_languages(no_docs, language_id.fit_languages(no_docs)),
        simhash.simhash_components(no_docs),
        simhash.near_unique(no_docs),
        suffix_dedup.without_repeats(no_docs),
        decontaminate.contamination(no_docs, bench),
        decontaminate.remove_contamination(no_docs, bench),
    ):
        assert found.collect() == []


def test_vocabularies_are_of_the_known_kinds():
    assert token_output.splits_at_white_space(open(WORDS, "rb").read())
    assert not token_output.splits_at_white_space(open(BYTES, "rb").read())
    assert token_output.id_type(json.load(open(WORDS))) == "<u2"
