"""Centroid clustering: Lloyd's algorithm on whole-number vectors, sharded by dimension.

The vectors are kept in tiles of rows, and every tile as one column per block of dimensions, so that a shard's tasks
read only their block. A round is

1. every column-block task computes exact partial squared distances of its rows to its slice of the centroids;
2. ``reduceByKey`` adds the blocks of a tile, and the smallest sum (ties: the smaller number) is the assignment;
3. the assignments, a number per row and block, go to where the blocks lie, every shard sums its own columns per
   cluster and replaces its own slice of the centroids.

That is four stages with one Python worker per task, however many blocks there are. Such a task costs some 50 ms even
without rows, and the number of tasks may be set by the cluster rather than by the rows.

The driver sees k x d centroid numbers per round, never rows. Lost executors cost a recomputation from the stored
tiles; no round depends on an earlier one but through the centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from hitloom.llm.common import stored

#: Rows that share one tile, and tiles that share one partition of the reduction.
TILE_ROWS = 1024
TILES_PER_PARTITION = 256
#: With components up to 2^27, 64 squared differences add up to less than 2^63. Larger ones raise an error.
LIMIT = 1 << 27
#: Sums of products below this are exact in a float matrix product.
EXACT = float(1 << 52)


@dataclass(frozen=True)
class Settings:
    k: int = 40
    rounds: int = 5
    dims: int = 64
    scale: int = 256
    seed: str = "2:"
    #: Dimensions of one shard.
    width: int = 32

    def blocks(self) -> list[slice]:
        return [slice(a, min(a + self.width, self.dims)) for a in range(0, self.dims, self.width)]


def whole_vectors(vectors: DataFrame, s: Settings) -> DataFrame:
    """vec_id and the components as whole numbers, of the vectors that have all of them."""

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    def whole(x: Column) -> Column:
        y = F.floor(F.lit(float(s.scale)) * x.cast("double"))
        return F.when(F.abs(x.cast("double")) * s.scale < LIMIT, y).otherwise(
            F.raise_error(F.lit(f"a component of {LIMIT // s.scale} or more has no exact distance in a long")).cast("long"))

    e = F.col("embedding")
    kept = vectors.filter(F.coalesce((F.size(e) == s.dims) & F.forall(e, finite), F.lit(False)))
    return kept.select("vec_id", F.transform(e, whole).alias("x"))


def packed(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as hold them all; the first byte tells how many."""
    for kind in (np.int8, np.int16, np.int32):
        info = np.iinfo(kind)
        if not x.size or (x.min() >= info.min and x.max() <= info.max):
            return bytes([info.bits // 8]) + x.astype(kind).tobytes()
    return b"\x08" + x.astype(np.int64).tobytes()


def unpacked(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64).reshape(-1, width)


def tiles(whole: DataFrame, s: Settings) -> DataFrame:
    """tile, ids, b0, b1, ...: up to TILE_ROWS rows, with one column per block of dimensions."""
    id_type = whole.schema["vec_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a in range(0, batch.num_rows, TILE_ROWS):
                part = batch.slice(a, TILE_ROWS)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, s.dims)
                ids = part.column("vec_id")
                row = {"tile": pa.array([number], pa.int64()), "ids": pa.ListArray.from_arrays([0, len(ids)], ids)}
                row |= {f"b{i}": pa.array([packed(x[:, cut])], pa.binary()) for i, cut in enumerate(s.blocks())}
                yield pa.RecordBatch.from_pydict(row)
                number += 1

    schema = StructType().add("tile", "long").add("ids", ArrayType(id_type))
    for i in range(len(s.blocks())):
        schema = schema.add(f"b{i}", "binary")
    return whole.mapInArrow(run, schema)


def first_centroids(whole: DataFrame, s: Settings) -> np.ndarray:
    """The k vectors with the smallest hashes of their ids; equal ids in the order of their components."""
    text = F.concat(F.lit(s.seed), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = whole.select("x", F.sha2(text, 256).alias("h")).orderBy("h", "x").limit(s.k).collect()
    return np.array([r["x"] for r in rows], np.int64).reshape(-1, s.dims)


def partial_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to those of ``c`` within a block, as whole numbers."""
    largest = float(max(np.abs(x).max(initial=1), np.abs(c).max(initial=1)))
    if 4 * largest * largest * x.shape[1] < EXACT:
        x, c = x.astype(np.float64), c.astype(np.float64)
    squares = (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :]
    return (squares - 2 * (x @ c.T)).astype(np.int64)


def sparse_planes(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Row minima and what lies above them, low and high halves apart: the high half is mostly zeros, and compresses."""
    least = d.min(axis=1)
    above = d - least[:, None]
    top = above >> 32
    return least, (above & 0xFFFF).astype(np.uint16), ((above >> 16) & 0xFFFF).astype(np.uint16), top if top.any() else None


def from_planes(p) -> np.ndarray:
    if isinstance(p, np.ndarray):
        return p
    least, low, high, top = p
    d = least[:, None] + low.astype(np.int64) + (high.astype(np.int64) << 16)
    return d if top is None else d + (top << 32)


def added(p, q) -> np.ndarray:
    return from_planes(p) + from_planes(q)


def nearest(p) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of every row of a tile; argmin takes the first, so the smaller number wins a tie."""
    d = from_planes(p)
    cluster = d.argmin(axis=1)
    return cluster.astype(np.int32), d[np.arange(len(d)), cluster]


def spread(tile: int) -> int:
    """What tiles are dealt by: their numbers begin with the partition that laid them, which a plain remainder may drop."""
    return (tile >> 32) + (tile & 0xFFFFFFFF)


class Shards:
    """The column blocks as one RDD of ((block, tile), data) in which every partition has tiles of one block only."""

    def __init__(self, stored_tiles: DataFrame, s: Settings):
        self.s, self.spark = s, stored_tiles.sparkSession
        sc = self.spark.sparkContext
        count = stored_tiles.count()
        self.partitions = each = max(1, min(count, max(sc.defaultParallelism, -(-count // TILES_PER_PARTITION))))

        def home(key: tuple[int, int]) -> int:
            block, tile = key
            return block * each + spread(tile) % each

        self.home, self.homes = home, each * len(s.blocks())
        parts = [stored_tiles.select("tile", f"b{i}").rdd.map(lambda r, i=i: ((i, r[0]), bytes(r[1]))) for i in range(len(s.blocks()))]
        self.blocks: RDD = sc.union(parts).partitionBy(self.homes, home)

    def assign(self, centroids: np.ndarray) -> RDD:
        """(tile, (clusters, distances)), dealt by tile."""
        slices = [centroids[:, cut] for cut in self.s.blocks()]

        def measure(rows):
            for (i, tile), data in rows:
                yield tile, sparse_planes(partial_distances(unpacked(data, slices[i].shape[1]), slices[i]))

        return self.blocks.mapPartitions(measure).reduceByKey(added, self.partitions, spread).mapValues(nearest)

    def update(self, assigned: RDD, centroids: np.ndarray) -> np.ndarray:
        """The next centroids: every shard replaces its own slice by the floors of its clusters' means."""
        k, slices = len(centroids), [centroids[:, cut] for cut in self.s.blocks()]
        count = len(slices)
        labels = assigned.flatMap(lambda v: [((i, v[0]), v[1][0]) for i in range(count)]).partitionBy(self.homes, self.home)

        def total(rows):
            sums, counts = {}, {}
            for (i, _), pair in rows:
                data, cluster = sorted(pair, key=lambda v: not isinstance(v, bytes))
                x = unpacked(data, slices[i].shape[1])
                order = np.argsort(cluster, kind="stable")
                present, starts = np.unique(cluster[order], return_index=True)
                if i not in sums:
                    sums[i], counts[i] = np.zeros((k, x.shape[1]), object), np.zeros(k, object)
                sums[i][present] += np.add.reduceat(x[order], starts, axis=0).astype(object)
                counts[i][present] += np.bincount(cluster, minlength=k)[present].astype(object)
            for i in sums:
                yield i, (sums[i], counts[i])

        def mean(entry):
            i, (sums, counts) = entry
            return i, [[int(t) // int(n) if n else int(o) for t, o in zip(ts, os)] for ts, n, os in zip(sums, counts, slices[i])]

        # Both lie as dealt, and a partition's labels and data pass one worker. RDD.join would take three.
        met = labels.union(self.blocks).groupByKey(self.homes, self.home)
        new = dict(met.mapPartitions(total).reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1]), count).map(mean).collect())
        return np.concatenate([np.array(new[i], np.int64) for i in range(count)], axis=1)


def cluster(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector.

    A null vector, one of another length or with a null or non-finite component is not kept. Repeated rows and ids
    each give a row; a null id stays null (its hash is that of the prefix alone). With fewer than k kept vectors there
    are as many centroids; equal starting vectors keep the later one empty, and an empty centroid stays. An empty
    table gives no rows. Components whose distances do not fit a long raise an error. Other columns play no part.
    """
    s = settings
    spark = vectors.sparkSession
    whole = whole_vectors(vectors.select("vec_id", "embedding"), s)
    laid = stored(tiles(whole, s), "tiles")
    centroids = first_centroids(whole, s)
    id_type = whole.schema["vec_id"].dataType
    if not len(centroids):
        return spark.createDataFrame([], StructType([StructField("vec_id", id_type)]).add("cluster", "integer").add("distance", "long")
                                     .add("cluster_inertia", "long").add("inertia", "long").add("centroid_sha256", "string"))
    shards = Shards(laid, s)
    for _ in range(s.rounds):
        centroids = shards.update(shards.assign(centroids), centroids)
    last = shards.assign(centroids).map(lambda v: (v[0], v[1][0].astype("<i4").tobytes(), v[1][1].astype("<i8").tobytes()))
    assigned = spark.createDataFrame(last, "tile long, clusters binary, distances binary", verifySchema=False)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                columns = [one.column("ids").flatten(), pa.array(np.frombuffer(one.column("clusters")[0].as_py(), "<i4")),
                           pa.array(np.frombuffer(one.column("distances")[0].as_py(), "<i8"))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    schema = StructType([StructField("vec_id", id_type)]).add("cluster", "integer").add("distance", "long")
    found = stored(laid.select("tile", "ids").join(assigned, "tile").mapInArrow(rows, schema), "assigned")
    per_cluster = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # k rows at most
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    inertia = sum(r["cluster_inertia"] for r in per_cluster)
    of_cluster = spark.createDataFrame([(r["cluster"], r["cluster_inertia"], inertia, digests[r["cluster"]]) for r in per_cluster],
                                       "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
