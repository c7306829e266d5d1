"""What stays in the driver's process after a fit."""

from pathlib import Path

import pyarrow as pa
import pytest

from spectral_topics.llm import common, decontaminate, toxicity


def resident_mb():
    return next(int(line.split()[1]) for line in Path("/proc/self/status").read_text().splitlines() if line.startswith("VmRSS")) / 1024


def test_freed_memory_goes_back_to_the_system():
    """Small pieces with survivors in between, and an Arrow table: allocators keep both when they are freed."""
    pieces = [b"x" * 1000 + bytes([i % 256]) for i in range(200_000)]
    table = pa.table({"text": pieces})
    kept = pieces[::5000]
    before = resident_mb()
    del pieces, table
    common.give_back()
    assert resident_mb() < before - 150
    assert len(kept) == 40


def test_a_fit_gives_its_memory_back(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "vile word" if i % 2 else "fine word") for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    called = []
    monkeypatch.setattr(toxicity, "give_back", lambda: called.append(True))
    toxicity.fit_toxicity(docs, labels)
    assert called


@pytest.mark.parametrize("chunk_bytes", [decontaminate.CHUNK_BYTES, 20])
def test_cutting_passages_takes_one_python_worker(spark, plain, chunk_bytes):
    """Each Python step of a stage has worker processes of its own, which stay and hold memory in later stages."""
    bench = spark.createDataFrame([("a", "quick brown fox jumps"), ("b", "two spaces"), ("c", "no id at all")], "item_id string, text string")
    docs = plain.where("doc_id IS NULL OR doc_id NOT IN (6, 11)")
    cut = decontaminate.remove_contamination(docs, bench, chunk_bytes=chunk_bytes)
    assert cut._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    at_once = decontaminate.remove_contamination(docs, bench)
    assert sorted(map(str, cut.collect())) == sorted(map(str, at_once.collect()))
    assert cut.count() < docs.count()


def test_what_a_worker_kept_goes_back_to_the_system(monkeypatch):
    called = []
    monkeypatch.setattr(common, "give_back", lambda: called.append(True))
    monkeypatch.setattr(common, "_kept", {})
    for key in ("a", "a", "b", "b"):
        assert common.worker_memory(key, lambda key=key: [key]) == [key]
    assert called == [True, True]
