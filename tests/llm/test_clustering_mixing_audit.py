"""Centroid clustering, source mixing and the filter audit against brute force, with nulls, ties, repeated rows and extra columns."""

import hashlib
import math
import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from hitloom.llm import clustering, filter_audit, mixing
from hitloom.llm.clustering import Settings

SMALL = Settings(k=4, rounds=3, dims=6, width=4)


def lloyd(rows, s):
    kept = [(i, [math.floor(s.scale * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == s.dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{s.seed}{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[: s.k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids)) for _, v in kept]

    for _ in range(s.rounds):
        at = assign()
        for k in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, at) if c == k]
            if mine:
                centroids[k] = [sum(x) // len(mine) for x in zip(*mine)]
    at = assign()
    of = {k: sum(d for d, c in at if c == k) for k in range(len(centroids))}
    return sorted((str(i), k, d, of[k], sum(of.values()), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest())
                  for (i, _), (d, k) in zip(kept, at))


def vectors(n):
    rng = random.Random(n)
    rows = [(i, [rng.uniform(-1, 1) + (i % 3) for _ in range(6)]) for i in range(n)]
    odd = [(n + 1, None), (n + 2, [1.0] * 5), (n + 3, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (n + 4, [float("nan")] + [0.0] * 5),
           (n + 5, [float("inf")] + [0.0] * 5), (None, [0.5] * 6), (None, [0.25] * 6), (7, [0.0] * 6), (7, [0.0] * 6), (n + 6, [-300.0] * 6)]
    return rows + odd


@pytest.mark.parametrize("n", [0, 1, 60])
def test_clustering_equals_plain_lloyd(spark, n):
    rows = vectors(n) if n != 1 else vectors(1)[:3]
    df = spark.createDataFrame([(i, v, 1, 2, "t") for i, v in rows], "vec_id long, embedding array<double>, cluster int, tile int, x string")
    got = clustering.cluster(df.repartition(3), SMALL)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == lloyd(rows, SMALL)


def test_clustering_of_nothing_and_of_huge_components(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert clustering.cluster(empty).collect() == []
    huge = spark.createDataFrame([(1, [1e30] * 6)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="exact distance"):
        clustering.cluster(huge, SMALL).collect()


def test_partial_distances_survive_packing():
    import numpy as np

    rng = np.random.default_rng(1)
    for top in (10, 40_000, 1 << 26):
        x, c = rng.integers(-top, top, (7, 5)), rng.integers(-top, top, (4, 5))
        want = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (clustering.from_planes(clustering.sparse_planes(clustering.partial_distances(x, c))) == want).all()
        assert (clustering.unpacked(clustering.packed(x), 5) == x).all()


def test_a_round_adds_up_each_tile_once_and_keeps_blocks_apart(spark, monkeypatch):
    from hitloom.llm.common import stored

    s = Settings(k=4, rounds=1, dims=6, width=2)
    whole = clustering.whole_vectors(spark.createDataFrame(vectors(60), "vec_id long, embedding array<double>").repartition(16), s)
    laid = stored(clustering.tiles(whole, s), "tiles")
    assert laid.count() == 16
    centroids = clustering.first_centroids(whole, s)
    done, plain = spark.sparkContext.accumulator(0), clustering.nearest

    def counted(p):
        done.add(1)
        return plain(p)

    monkeypatch.setattr(clustering, "nearest", counted)
    shards = clustering.Shards(laid, s)
    shards.update(shards.assign(centroids), centroids)
    assert done.value == 16  # three blocks: it was done for each of them
    dealt = [[block for (block, _), _ in rows] for rows in shards.blocks.glom().collect()]
    assert len(dealt) == 3 * shards.partitions and all(len(set(rows)) == 1 for rows in dealt)
    assert max(map(len, dealt)) <= -(-16 // shards.partitions) + 1


def test_clustering_with_more_partitions_than_tiles(spark, monkeypatch):
    from pyspark import RDD

    plain = RDD.partitionBy
    monkeypatch.setattr(RDD, "partitionBy", lambda self, n, *a, **b: plain(self, max(n, 23), *a, **b))
    rows = vectors(60)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert sorted((str(r[0]), *r[1:]) for r in clustering.cluster(df, SMALL).collect()) == lloyd(rows, SMALL)


WORD = re.compile(r"[^\x20\x09-\x0D]+")
SOURCES = ["b", None, "a", "z", "é", "", "m"]


def mixing_docs():
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)) + f" {i}", SOURCES[i % 7] if i % 3 else "big") for i in range(700)]
    return rows + [(9001, None, "a"), (9002, "", "only empty"), (None, "x y", "a"), (None, None, None), (5, "same", "b"), (5, "same", "b"),
                   (9003, "\t \n", None), (9004, "word " * 40_000, "long")]


def mixing_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        open_ = [s for s in order if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        share = {s: float(weight[s]) * float(rest) / float(sum(weight[x] for x in open_)) for s in open_}
        over = {s for s in open_ if 3 * sizes[s] <= share[s]}
        if not over or len(over) == len(open_):
            return {s: 3.0 * sizes[s] if s in capped | over else share[s] for s in order}
        capped |= over


def test_mixing_equals_brute_force(spark):
    rows = mixing_docs()
    df = spark.createDataFrame([(*r, 1.0, 2, 3) for r in rows], "doc_id long, text string, source string, rate double, weight int, place int")
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    target = mixing_targets(sizes)
    want, copies = [], []
    for i, text, source in rows:
        size, rate = len(WORD.findall(text or "")), min(3.0, target[source] / sizes[source]) if sizes[source] else 0.0
        digest = hashlib.md5((text or "").encode()).hexdigest()
        u = int(hashlib.md5(f"20240601:{'' if i is None else i}:{digest}".encode()).hexdigest()[:13], 16) / 2**52
        n = math.floor(rate) + (u < rate - math.floor(rate))
        want.append((str(i), size, sizes[source], target[source], size * n))
        copies.extend([(str(i), text)] * n)
    got = mixing.mix(df.repartition(4)).collect()
    assert sorted((str(r.doc_id), r.size, r.source_size, r.target, r.taken) for r in got) == sorted(want)
    assert all(r.taken <= 3 * r["size"] for r in got)
    out = mixing.emit(df)
    assert out.columns == df.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in out.collect()) == sorted((i, str(t)) for i, t in copies)


def test_mixing_with_many_sources_and_none(spark, monkeypatch):
    df = spark.createDataFrame(mixing_docs(), "doc_id long, text string, source string")
    want = sorted(map(str, mixing.mix(df).collect()))
    monkeypatch.setattr(mixing, "MAX_BROADCAST", 0)
    monkeypatch.setattr(mixing, "SOURCES_PER_TASK", 3)
    assert sorted(map(str, mixing.mix(df).collect())) == want
    assert mixing.mix(df.limit(0)).collect() == [] and mixing.emit(df.limit(0)).collect() == []


def test_mixing_comes_near_its_targets(spark):
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")), F.col("id")).alias("text"),
                                      F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    fraction = F.col("target") / F.col("source_size") - F.floor(F.col("target") / F.col("source_size"))
    per = mixing.mix(rows).groupBy("source").agg(
        F.sum("taken").alias("taken"), F.max("target").alias("target"), F.sum(F.col("size") ** 2 * fraction * (1 - fraction)).alias("variance")).collect()
    assert all(abs(r.taken - r.target) < 4 * r.variance**0.5 + 1 for r in per), per
    assert all(abs(r.taken - r.target) < 0.1 * r.target for r in per)


def fails(i, text, smaller):
    t, w = text or "", WORD.findall(text or "")
    checks = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), re.search(r"[#$%&*|]", t), smaller]
    return {f for f, c in zip("ABCDE", checks) if c}


def audit_docs():
    long = " ".join(f"wörd{i}" for i in range(220))
    return [(1, long, "en"), (2, long, "en"), (3, long, None), (2, long, "en"), (None, long, "en"), (4, None, "fr"), (5, "", "fr"), (6, "A B C", ""),
            (7, "same " * 300, "de"), (8, "SAME " * 300, "de"), (9, long + " 5%", "de"), (0, long + " 5%", "fr"), (10, long * 300, "en")]


def test_filter_audit_equals_simulation(spark):
    rows = audit_docs()
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, None), (4, None, 1), (7, 0, 1), (9, 1, 0), (None, 1, 1)]
    known = {i: (any(q == 1 for j, q, _ in labels if j == i), any(t == 1 for j, _, t in labels if j == i)) for i in range(11)}
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, mask int, n int")
    got = {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in filter_audit.audit(
        docs, spark.createDataFrame([(*x, "p") for x in labels], "doc_id long, quality int, toxic int, part string")).collect()}
    want, shapley = {}, {}
    for part in {lang or "" for _, _, lang in rows}:
        mine = []
        for i, t, lang in rows:
            if (lang or "") == part:
                smaller = i is not None and any(j is not None and j < i and (u or "") == (t or "") for j, u, _ in rows)
                mine.append((fails(i, t, smaller), *known.get(i, (False, False))))
        for order in map("".join, permutations("ABCDE")):
            left = list(mine)
            for step, f in enumerate(order, 1):
                out = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                earlier = [d for d in mine if f in d[0] and d[0] & set(order[: step - 1])]
                shapley[part, f] = shapley.get((part, f), 0) + len(out)
                want[part, order, step] = (len(left), len(out), len(earlier), sum(d[0] == {f} for d in mine), sum(d[1] for d in out), sum(d[2] for d in out))
    assert got == {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in want.items()}
    assert filter_audit.audit(docs.limit(0), docs.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
