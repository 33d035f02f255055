"""The Jaccard join where groups are dense, and what the near-duplicate stage keeps."""

import random
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hitloom.llm import jaccard_join
from hitloom.llm.common import SHUFFLE_CLEANUP, stored


def family(seed: int, n: int, edits: int) -> list[str]:
    rng = random.Random(seed)
    base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([12, 40, 90]))]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(50)}"
        out.append(" ".join(w))
    return out


def brute_components(texts: dict[int, str]) -> dict[int, int]:
    sets = {}
    for i, t in texts.items():
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


@pytest.fixture(scope="module")
def texts():
    out = [t for seed in range(12) for t in family(seed, 20, 3)]
    passage = " ".join(f"common{i}" for i in range(60))
    out += [f"{passage} " + " ".join(f"tail{i}x{k}" for k in range(15 + i % 5)) for i in range(30)]
    return dict(enumerate(out))


@pytest.mark.parametrize("pivots, allowance, step, tile", [(8, 16, 16, 4096), (0, 1, 4, 16), (1, 1, 64, 7)])
def test_every_link_is_found_however_the_work_is_cut(spark, monkeypatch, texts, pivots, allowance, step, tile):
    for name, value in {"MAX_PIVOT_ROUNDS": pivots, "FIRST_ALLOWANCE": allowance, "ALLOWANCE_STEP": step, "TILE_ROWS": tile, "PAIRS_PER_ROW": 0}.items():
        monkeypatch.setattr(jaccard_join, name, value)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.join(df).collect()} == brute_components(texts)


def test_one_of_each_keeps_unlinked_texts_whatever_their_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(None, a), (None, b), (None, c), (5, a + " end"), (5, b), (5, d), (5, d), (7, d), (8, None), (8, ""), (8, ""), (None, " ")]
    df = spark.createDataFrame([(i, t, k, "x", 1.5) for k, (i, t) in enumerate(rows)], "doc_id long, text string, __kept int, __row string, root double")
    got = jaccard_join.one_of_each(df)
    assert got.columns == df.columns
    want = [(5, a + " end"), (5, b), (None, c), (5, d), (8, None), (8, ""), (8, ""), (None, " ")]
    assert sorted(map(str, [(r.doc_id, r.text) for r in got.collect()])) == sorted(map(str, want))
    assert jaccard_join.one_of_each(df.limit(0)).collect() == []


def test_points_are_packed_and_read_back():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 40, 550, 5_000)] + [np.arange(300, dtype=np.uint64) << np.uint64(10)]
    for groups in (jaccard_join.GROUPS, jaccard_join.FINE_GROUPS):
        packed = [jaccard_join.point_of(s, groups) for s in sets]
        plain = [np.minimum(np.bincount((s % np.uint64(groups)).astype(np.int64), minlength=groups), jaccard_join.FULL) for s in sets]
        assert (jaccard_join.points_of(pa.array(packed, pa.binary()), groups) == np.array(plain)).all()
        assert len(packed[2]) < groups / 2.5


def test_blocks_do_not_depend_on_turns(spark, monkeypatch, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    signed = stored(jaccard_join.signatures(df), "signatures")
    parts = [[tuple(r) for r in jaccard_join.blocks(signed, turn).collect()] for turn in range(jaccard_join.BLOCK_TURNS)]
    monkeypatch.setattr(jaccard_join, "BLOCK_TURNS", 1)
    assert sorted(r for p in parts for r in p) == sorted(tuple(r) for r in jaccard_join.blocks(signed, 0).collect())
    assert len(parts) > 1 and max(map(len, parts)) < 0.5 * sum(map(len, parts))


def test_a_stored_table_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {p.name for d in disk.localDirs() for p in Path(d.getPath()).rglob("shuffle_*")}

    before, setting = files(), spark.conf.get(SHUFFLE_CLEANUP)
    df = spark.range(20_000).groupBy((F.col("id") % 5_000).alias("k")).agg(F.sum("id").alias("s"))
    rows = stored(df.join(spark.range(5_000).repartition(3, "id"), F.col("k") == F.col("id")), "cleaned")
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(SHUFFLE_CLEANUP) == setting
    assert rows.count() == 5_000 and df.count() == 5_000
