"""What Python workers of the language and packing stages hold, whatever the size of a partition."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from hitloom.llm import common, language_id, packing
from hitloom.llm.common import kept_by_worker, light_batches, slices


def scorer():
    pieces = [bytes([b]) for b in range(1, 256)]
    return language_id.Scorer(language_id.Model(["de", "en"], pieces, np.full((256, 2), 1 / 256)))


def peak_mb(texts, encode, limit) -> float:
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    tracemalloc.start()
    try:
        for part in slices(iter([batch]), limit=limit):
            encode(part.column("text"))
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("make, limit", [(scorer, language_id.TEXT_BYTES), (lambda: packing.WordIds(packing.default_tokenizer()), packing.TEXT_BYTES)])
def test_a_large_batch_takes_little(make, limit):
    assert peak_mb(["on a hill " * 1_000] * 1_600, make(), limit) < 60


def test_remembered_words_are_bounded():
    rng, score = random.Random(5), scorer()
    for _ in range(9):
        score(pa.array([" ".join("".join(rng.choices("abcdefghij", k=9)) for _ in range(40_000))]))
    assert len(score.known) <= 150_000 and len(score.rows) == len(score.known)


def test_slices_change_no_result():
    score, words = scorer(), "eine kleine Mühle by the river".split()
    rng = random.Random(3)
    texts = [None, "", "12 34", *(" ".join(rng.choices(words, k=n)) for n in range(1, 200))]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    parts = [score(part.column("text")) for part in slices(iter([batch]), limit=500)]
    assert len(parts) > 100 and np.allclose(np.concatenate(parts), scorer()(batch.column("text")), rtol=1e-12, atol=1e-9)


def test_a_worker_keeps_one_operators_tables(monkeypatch):
    monkeypatch.setattr(common, "_kept", {})
    made = [kept_by_worker(key, object) for key in ("a", "a", "b", "a")]
    assert made[0] is made[1] and made[3] is not made[0] and list(common._kept) == ["a"]


@pytest.fixture
def usual_rows(spark):
    before = spark.conf.get(common.BATCH_SETTING)
    spark.conf.set(common.BATCH_SETTING, "10000")
    yield
    spark.conf.set(common.BATCH_SETTING, before)


def test_arrow_batches_end_by_bytes(spark, usual_rows):
    light_batches(spark)

    def measure(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": pa.array([batch.num_rows], pa.int64()), "size": pa.array([batch.nbytes], pa.int64())})

    wide = spark.range(0, 3_000, 1, 1).selectExpr("repeat('x', 10000) text").mapInArrow(measure, "rows long, size long").collect()
    assert sum(r.rows for r in wide) == 3_000 and max(r["size"] for r in wide) < 2 * common.BATCH_BYTES
    numbers = spark.range(0, 20_000, 1, 1).mapInArrow(measure, "rows long, size long").collect()
    assert sum(r.rows for r in numbers) == 20_000 and len(numbers) == 2
