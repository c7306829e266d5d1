"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits have a common neighbour within half of it. So every distinct
fingerprint emits all variants within ``radius / 2`` bits of itself, variants are shuffled, and
fingerprints that meet at a variant are linked. All fingerprints at a variant lie within ``radius``
of each other, so linking them to the smallest one connects them without listing pairs; each link is
verified by its differing bits and kept once. A variant has at most 1 + 64 (radius 2) fingerprints
around it, whatever the input, because equal fingerprints are merged first.

Copies of a text share a fingerprint: a group of a third of all rows is one row here.

``near_unique`` keeps one document of each group of similar ones: texts are linked if the sets of their
word shingles have a Jaccard similarity of at least 0.8, and linked texts form groups. A fingerprint of 64 bits tells
such texts apart too coarsely to decide alone, so ball hashing makes the first links and an exact join of the sets by
their rare shingles finds the others:

1. Texts of one set are one node. A set of n shingles shares at least 0.8 n of them with a similar one,
   so nodes with fewer shingles that occur in another node go. Shingles are counted in buckets of hashes.
2. Nodes whose fingerprints meet by ball hashing are linked if their sets are similar.
3. The shingles of the nodes left are ordered by how many of these nodes have them. Similar sets share one
   of their first n - ceil(0.8 n) + 1 shingles: nodes that do are candidates, and every candidate
   link is verified with the whole sets.
4. Candidates of large groups are compared with the most shared node of a shingle first, in rounds. Then all pairs
   of nodes with a common shingle that aren't connected yet are compared, so no link between groups is missed. Two bounds
   keep pairs that can't be similar from being made at all. A set that shares m of its n shingles with any others has no partner of
   more than 2.25 m - n. And each shingle flips one bit of its set's parity sketch, so sketches differ in no more
   bits than sets do in shingles; similar sets differ in at most a ninth of their shingles together.

Defined results
- A null text is empty. A text without words has fingerprint 0 and no shingles and is linked like any other.
- ``component_id`` is the smallest id reachable; null ids count only where a component has no other.
- Repeated rows give repeated rows. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from spectral_topics.functions.storage import materialize
from spectral_topics.llm.common import arrow_map, forget, id_and_text, join_groups, maybe_among, quoted, shuffles_deleted, slices, text_bytes
from spectral_topics.llm.components import connected_components

SEED = 42
BITS = 64
#: Shingles whose bits are added up at once.
CHUNK = 1 << 15


def shingles(text: bytes, width: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each of a text's word shingles (one for a text of fewer words, none without). A-Z are lower-cased."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    spans = zip(starts[:n].tolist(), last.tolist(), strict=True)
    return np.fromiter((xxh64_intdigest(joined[s:e], seed) for s, e in spans), np.uint64, n)


def fingerprint(text: bytes, width: int, seed: int = SEED, prints: int = 1) -> np.ndarray:
    """SimHash fingerprints of a text's word shingles as unsigned numbers.

    The first is made from the shingles' XXH64, each further one from these hashes mixed anew.
    """
    hashes = shingles(text, width, seed)
    return np.array([majority(hashes, k) for k in range(prints)], np.uint64)


def majority(hashes: np.ndarray, k: int = 0) -> np.uint64:
    """The bits that are set in over half of the ``k``-th hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = mixed(hashes[at : at + CHUNK], k).astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0]


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th hash of what has these hashes; the hashes themselves for 0."""
    if not k:
        return np.ascontiguousarray(hashes)
    out = (hashes + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(30)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def fingerprints(rows: DataFrame, width: int, prints: int = 1, seed: int = SEED) -> DataFrame:
    """``rows`` with ``fp0``, ``fp1``, ... (signed 64-bit numbers) in place of ``text``."""
    carried = [c for c in rows.columns if c != "text"]
    names = [f"fp{k}" for k in range(prints)]

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            found = np.array([fingerprint(t, width, seed, prints) for t in text_bytes(batch.column("text"))], np.uint64)
            columns = [pa.array(np.ascontiguousarray(c)) for c in found.reshape(-1, prints).view(np.int64).T]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], *columns], names=[*carried, *names])

    schema = StructType([rows.schema[c] for c in carried] + [StructField(n, LongType()) for n in names])
    return arrow_map(rows, hashes, schema)


def ball(radius: int, bits: int = BITS) -> list[int]:
    """All masks of ``bits`` bits, at most ``radius`` of them set, as signed 64-bit numbers."""
    masks = [sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in combinations(range(bits), r)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def ball_links(distinct: DataFrame, radius: int) -> DataFrame:
    """``(a, b)``: links that connect all of ``distinct(fp)`` within ``radius`` bits of each other."""
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be even, so that two equal halves meet")
    masks = F.array(*[F.lit(m).cast("long") for m in ball(radius // 2)])
    variants = distinct.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    least = F.min("fp").over(Window.partitionBy("variant"))
    met = variants.withColumn("least", least).where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()
    return met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2
) -> DataFrame:
    """``(id, fp, component_id)`` for each row of ``docs``."""
    prints = materialize(fingerprints(id_and_text(docs, id_col, text_col), width).withColumnRenamed("fp0", "fp"), "fingerprints")
    distinct = materialize(
        prints.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints"
    )
    roots = connected_components(ball_links(distinct, radius))
    nodes = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "first", "n", F.coalesce("root", "fp").alias("root")
    )
    named = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = materialize(nodes.join(named, "root").select("fp", "component_id", "n"), "fingerprint-components")
    return join_groups(prints, groups, "fp", "n", "id").select("id", "fp", "component_id")


LAST_ID = (1 << 63) - 1
#: Shingles counted in one bucket, and bytes of texts whose shingles are sorted at once.
BUCKET_SHINGLES = 1_000_000
SLICE_BYTES = 1 << 22
#: Bits of a set's parity sketch. Sets of up to twice as many shingles are told apart by it.
SKETCH_BITS = 512
#: A round of comparing with leaders that links less than this share of the nodes is the last one.
LAST_ROUND = 0.01


def bits_apart(similarity: float, bits: int) -> int:
    """Expected differing bits of texts whose shingle sets have this Jaccard similarity."""
    return int(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def least_overlap(size: Column, similarity: float) -> Column:
    """Shingles that a set of this size has in common with any set as similar as this."""
    return F.ceil(size * F.lit(similarity) - F.lit(1e-9))


def shingle_set(text: bytes, width: int) -> tuple[int, np.ndarray]:
    """A name for the set (XXH64 of its sorted hashes, as a signed number), and the hashes."""
    from xxhash import xxh64_intdigest

    found = np.unique(shingles(text, width))
    return int(np.uint64(xxh64_intdigest(found.astype("<u8").tobytes(), SEED)).astype(np.int64)), found


def set_nodes(texts: DataFrame, width: int) -> DataFrame:
    """``(doc, tie, node, size)`` of the rows of ``texts(doc, tie, text)``: the name and size of the shingle set."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            found = [(node, len(h)) for node, h in (shingle_set(t, width) for t in text_bytes(batch.column("text")))]
            columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("tie"), *columns], names=["doc", "tie", "node", "size"])

    schema = StructType([texts.schema["doc"], texts.schema["tie"], StructField("node", LongType()), StructField("size", LongType())])
    return arrow_map(texts, named, schema)


def shared_shingles(texts: DataFrame, width: int, buckets: int) -> DataFrame:
    """``(node, shared)``: how many of its shingles another node has as well; never too few.

    A shingle that several nodes of a batch have is counted for them there, and its bucket gets it once, so a shingle
    of most texts doesn't fill its bucket. A node whose copies lie in several batches may then count it repeatedly.
    """

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                sets = dict(shingle_set(t, width) for t in text_bytes(batch.column("text")))
                nodes = np.fromiter(sets, np.int64, len(sets))
                flat = np.concatenate([np.zeros(0, np.uint64), *sets.values()])
                owner = np.repeat(np.arange(len(nodes)), [len(h) for h in sets.values()])
                order = np.argsort(flat, kind="stable")
                flat, owner = flat[order], owner[order]
                first = np.append(True, flat[1:] != flat[:-1])[: len(flat)]
                times = np.diff(np.append(np.flatnonzero(first), len(flat)))
                common = np.repeat(times > 1, times)
                credit = np.bincount(owner[common], minlength=len(nodes))
                some = np.flatnonzero(credit)
                rows = []
                if len(some):
                    rows.append((int(nodes[some[0]]) % buckets, nodes[some], credit[some], None, None))
                bucket = ((flat >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                low = (flat & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                order = np.lexsort((owner, bucket))
                order = order[(~common | first)[order]]
                bucket, low, owner, common = bucket[order], low[order], owner[order], common[order]
                cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)]), len(bucket))
                for start, end in zip(cuts[:-1], cuts[1:]):
                    alone = ~common[start:end]
                    own, counts = np.unique(owner[start:end][alone], return_counts=True)
                    rows.append((int(bucket[start]), nodes[own], counts, low[start:end][alone], low[start:end][~alone]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int32()),
                        pa.array([r[1].astype("<i8").tobytes() for r in rows], pa.binary()),
                        pa.array([r[2].astype("<u4").tobytes() for r in rows], pa.binary()),
                        pa.array([None if r[3] is None else r[3].astype("<u4").tobytes() for r in rows], pa.binary()),
                        pa.array([None if r[4] is None else r[4].astype("<u4").tobytes() for r in rows], pa.binary()),
                    ],
                    names=["bucket", "nodes", "counts", "alone", "common"],
                )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: dict[int, list[tuple]] = {}
        found = []
        for batch in batches:
            for r in batch.to_pylist():
                nodes, counts = np.frombuffer(r["nodes"], "<i8"), np.frombuffer(r["counts"], "<u4")
                if r["alone"] is None:
                    found.append((nodes, counts.astype(np.int64)))
                else:
                    held.setdefault(r["bucket"], []).append(
                        (nodes, counts, np.frombuffer(r["alone"], "<u4"), np.frombuffer(r["common"], "<u4"))
                    )
        for bucket in sorted(held):
            parts = held.pop(bucket)
            node = np.concatenate([np.repeat(p[0], p[1]) for p in parts])
            low = np.concatenate([p[2] for p in parts])
            sure = np.unique(np.concatenate([p[3] for p in parts]))
            order = np.lexsort((node, low))
            node, low = node[order], low[order]
            first = np.append(True, (low[1:] != low[:-1]) | (node[1:] != node[:-1]))[: len(low)]
            node, low = node[first], low[first]
            starts = np.flatnonzero(np.append(True, low[1:] != low[:-1])[: len(low)])
            times = np.diff(np.append(starts, len(low)))
            shared = np.repeat((times > 1) | np.isin(low[starts], sure), times)
            found.append((node[shared], np.ones(int(shared.sum()), np.int64)))
        if found:
            nodes, sums = sum_by_node(found)
            to = nodes % buckets
            order = np.argsort(to, kind="stable")
            to, nodes, sums = to[order], nodes[order], sums[order]
            cuts = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])[: len(to)]), len(to))
            spans = list(zip(cuts[:-1], cuts[1:]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(to[cuts[:-1]], pa.int32()),
                    pa.array([nodes[s:e].astype("<i8").tobytes() for s, e in spans], pa.binary()),
                    pa.array([sums[s:e].astype("<i8").tobytes() for s, e in spans], pa.binary()),
                ],
                names=["part", "nodes", "sums"],
            )

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held, waiting = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                held.append((np.frombuffer(r["nodes"], "<i8"), np.frombuffer(r["sums"], "<i8")))
                waiting += len(held[-1][0])
            if waiting > BUCKET_SHINGLES:
                held, waiting = [sum_by_node(held)], 0
        if held:
            nodes, sums = sum_by_node(held)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(sums)], names=["node", "shared"])

    blobs = arrow_map(texts.select("text"), dealt, "bucket int, nodes binary, counts binary, alone binary, common binary")
    sums = arrow_map(blobs.repartitionById(buckets, F.col("bucket")), counted, "part int, nodes binary, sums binary")
    return arrow_map(sums.repartitionById(buckets, F.col("part")), added, "node long, shared long")


def sum_by_node(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    nodes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return nodes, np.bincount(at, np.concatenate([p[1] for p in parts]), len(nodes)).astype(np.int64)


def parity_sketch(hashes: np.ndarray) -> np.ndarray:
    """A bit for each of SKETCH_BITS classes of hashes: whether an odd number of these are of the class."""
    odd = np.bincount((hashes % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """``(node, size, fp, s0, s1, ..., hashes)`` of ``texts(node, text)``: fingerprint, parity sketch and set."""
    sketch = [f"s{i}" for i in range(SKETCH_BITS // 64)]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                sets = [shingle_set(t, width)[1] for t in text_bytes(batch.column("text"))]
                sizes = np.array([len(h) for h in sets], np.int64)
                sketches = np.array([parity_sketch(h) for h in sets], np.int64).reshape(-1, len(sketch))
                flat = np.concatenate([np.zeros(0, np.int64), *(h.view(np.int64) for h in sets)])
                hashes = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat))
                prints = np.array([majority(h) for h in sets], np.uint64).view(np.int64)
                columns = [batch.column("node"), pa.array(sizes), pa.array(prints), *map(pa.array, np.ascontiguousarray(sketches.T)), hashes]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "size", "fp", *sketch, "hashes"])

    longs = ", ".join(f"{c} long" for c in ("node", "size", "fp", *sketch))
    return arrow_map(texts, listed, f"{longs}, hashes array<long>")


def first_shingles(sets: DataFrame, similarity: float) -> DataFrame:
    """``(shingle, node, size, rank, most)``: the rarest shingles of each set, one of which every similar set has among its own.

    Shingles that no other set has come first and have no partner, so they only count. The lower
    its rank, the larger the part of a set that others have as well. ``most`` is the greatest size of a similar set.
    """
    each = sets.select("node", "size", F.explode("hashes").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = each.join(often, "shingle").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("found"))
    length = F.size("found") - least_overlap(F.col("size"), similarity) + 1
    taken = shared.where(length > 0).select(
        "node",
        "size",
        (-F.size("found") / F.col("size")).alias("rank"),
        F.floor(F.size("found") * F.lit((1 + similarity) / similarity) - F.col("size") + F.lit(1e-6)).alias("most"),
        F.slice("found", F.lit(1), length.cast("int")).alias("found"),
    )
    return taken.select("node", "size", "rank", "most", F.explode("found.shingle").alias("shingle"))


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs(a, b)`` of nodes whose sets have at least this Jaccard similarity."""
    a, b = (sets.select(F.col("node").alias(x), F.col("hashes").alias(f"{x}_hashes")) for x in "ab")
    total = F.size("a_hashes") + F.size("b_hashes")
    overlap = F.size(F.array_intersect("a_hashes", "b_hashes"))
    near = overlap * (1 + similarity) >= total * F.lit(similarity) - F.lit(1e-9)
    return pairs.join(a, "a").join(b, "b").where(near).select("a", "b")


def met_in_a_ball(sets: DataFrame, radius: int = 2) -> DataFrame:
    """``(a, b)``: nodes of one fingerprint with the least of them, and the least nodes of fingerprints that ball hashing links."""
    least = materialize(sets.groupBy("fp").agg(F.min("node").alias("least")), "least-nodes")
    same = sets.select("fp", "node").join(least, "fp").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    a, b = (least.select(F.col("fp").alias(x), F.col("least").alias(f"{x}_least")) for x in "ab")
    near = ball_links(least.select("fp"), radius).join(a, "a").join(b, "b").select(F.col("a_least").alias("a"), F.col("b_least").alias("b"))
    return same.unionByName(near)


def set_components(sets: DataFrame, similarity: float) -> DataFrame:
    """``(node, root)`` of the nodes of ``sets`` (see ``shingle_sets``) that are linked to others."""
    sketch = [c for c in sets.columns if c[0] == "s" and c[1:].isdigit()]
    postings = materialize(
        first_shingles(sets, similarity).join(sets.select("node", *sketch), "node"), "first-shingles"
    )
    n = postings.agg(F.count_distinct("node")).first()[0]
    links = materialize(similar(met_in_a_ball(sets), sets, similarity), "links")

    def placed() -> DataFrame:
        return postings.join(connected_components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))

    def near(x: str, y: str) -> Column:
        """Whether two postings may be of similar sets, by sizes and sketches."""
        a, b = ({c: F.col(f"{p}{c}") for c in ("size", "most", *sketch)} for p in (x, y))
        sizes = F.least(a["size"], b["size"]) >= F.greatest(a["size"], b["size"]) * similarity - 1e-9
        differ = sum((F.bit_count(a[c].bitwiseXOR(b[c])) for c in sketch), F.lit(0))
        few = differ * (1 + similarity) <= (a["size"] + b["size"]) * (1 - similarity) + F.lit(1e-6)
        return sizes & (a["size"] <= b["most"]) & (b["size"] <= a["most"]) & few

    before = links.count()
    while True:
        now = materialize(placed(), "placed")
        leaders = now.groupBy("shingle").agg(F.min(F.struct("rank", "node", "size", "root", "most", *sketch)).alias("leader"))
        met = now.join(leaders, "shingle").where(F.col("root") != F.col("leader.root")).where(near("", "leader."))
        # One leader a round, so that a node of a large group isn't compared with one for each of its shingles.
        pairs = met.groupBy(F.col("node").alias("a")).agg(F.min("leader").alias("l")).select("a", F.col("l.node").alias("b"))
        links = links.unionByName(materialize(similar(pairs, sets, similarity), "links"))
        after = links.count()
        if after - before <= n * LAST_ROUND:
            break
        before = after
    now = materialize(placed(), "placed")
    a, b = (now.select("shingle", *[F.col(c).alias(f"{x}_{c}") for c in ("node", "size", "root", "most", *sketch)]) for x in "ab")
    met = a.join(b, "shingle").where("a_node < b_node and a_root <> b_root").where(near("a_", "b_"))
    pairs = materialize(met.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct(), "pairs")
    return connected_components(links.unionByName(similar(pairs, sets, similarity)))


def kept_documents(texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """``(doc, tie)`` of the first of each group of similar ``texts(doc, tie, text)``."""
    named = materialize(set_nodes(texts, width), "shingle-sets")
    distinct = materialize(
        named.groupBy("node").agg(F.first("size").alias("size"), F.min(F.struct("doc", "tie")).alias("first")), "distinct-sets"
    )
    buckets = 1 + (named.agg(F.sum("size")).first()[0] or 0) // BUCKET_SHINGLES
    shared = shared_shingles(texts, width, buckets)
    enough = distinct.join(shared, "node").where(F.col("shared") >= least_overlap(F.col("size"), similarity))
    left = materialize(enough.select("node", "first.doc", "first.tie"), "nodes-left")
    # Few texts are left as a rule; the others needn't be shuffled for the join.
    few = maybe_among(texts, left, ["doc", "tie"])
    # A repeated row has its twin's key, and the same set.
    sets = materialize(shingle_sets(few.join(left, ["doc", "tie"]).select("node", "text"), width).dropDuplicates(["node"]), "sets-left")
    roots = set_components(sets, similarity)
    nodes = distinct.join(roots, "node", "left").select("first", F.coalesce("root", "node").alias("root"))
    return materialize(nodes.groupBy("root").agg(F.min("first").alias("first")).select("first.*"), "kept-documents")


def near_unique(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8
) -> DataFrame:
    """One row of each group of similar texts: that of the smallest id (null ids last), all columns as they are."""
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    key = [F.coalesce(quoted(id_col).cast("long"), F.lit(LAST_ID)).alias("doc"), F.xxhash64(text).alias("tie")]
    texts = docs.select(*key, text.alias("text"))
    # What is shuffled for one stored table would lie on disk beside the shuffles of all later ones.
    with shuffles_deleted(docs.sparkSession):
        kept = kept_documents(texts, width, similarity)
    # One of the rows of a key stays.
    copy = F.row_number().over(Window.partitionBy("doc", "tie").orderBy(F.lit(1)))
    rows = docs.select(*key, F.struct(*[quoted(c) for c in docs.columns]).alias("row"))
    return rows.join(kept, ["doc", "tie"], "left_semi").withColumn("copy", copy).where("copy = 1").select("row.*")
