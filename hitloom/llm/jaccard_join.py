"""N-gram Jaccard self-join with a count-vector R-tree.

A document is its set of distinct 5-word shingles; two link if 100 * intersection >= 75 * union. Equal sets are one
class from the start. Shingles are hashed into GROUPS groups; the counts per group are a point, and the sum of the
coordinate minima of two points bounds their overlap from above. Points are compared within blocks: two linked sets
share one of the first n - ceil(0.75 n) + 1 shingles of any common order, here one that puts frequent shingles last,
so a block holds the classes that share such a shingle and no link is lost. A pair whose first common shingle stands
too far back in either order cannot link, so within a block each class has a reach. Candidates come from

1. pivots: in every block each class against the first one, a number of pairs in proportion to the rows;
2. the R-tree over the points of a block, for classes that are still in different components.

Only pairs whose bound reaches the needed overlap are verified on the sets. Large groups of near copies become one
component in the first step, so their pairs are never written out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from hitloom.llm.common import SLICE_BYTES, Words, fresh, give_back, slices, stored

SHINGLE = 5
THRESHOLD = 75
GROUPS = 256
#: Groups that the nodes of the tree tell apart (points are folded to them); its finds are held against whole points.
TREE_GROUPS = 64
#: Groups of the finer point that pairs are held against before their sets are fetched; fewer say little of long texts.
FINE_GROUPS = 1024
#: A count is one byte; this one stands for itself and all above, and bounds nothing where both points have it.
FULL = 255
#: Cells that shingles are counted in; only the order of shingles depends on them.
CELL_BITS = 20
#: Rows of a block that one tree holds; larger blocks are compared tile by tile.
TILE_ROWS = 4096
LEAF = 16
#: While the trees would compare more rows with each row than this, further pivots are tried first, as long as they link anything.
PAIRS_PER_ROW, MAX_PIVOT_ROUNDS = 1_000, 8
#: The keys are dealt in so many turns, so that only a part of them lies shuffled on disk at a time.
BLOCK_TURNS = 4
#: Pairs that a row of a tile gives at first, and how that grows while any row had more; a tile's rows end the growth.
FIRST_ALLOWANCE, ALLOWANCE_STEP = 4, 64
PAIRS_PER_BATCH = 100_000
#: Bits of the table that tells most classes without partner apart before their sets are written.
BITMAP_BITS = 24
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text; a shorter text is one shingle, without words none."""
    words = Words(texts, lower=True)
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in words.distinct), np.uint64, len(words.distinct))
    h, out = hashed[words.codes], []
    with np.errstate(over="ignore"):
        for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist()):
            n, width = b - a, min(b - a, SHINGLE)
            rolled = np.full(max(0, n - width + 1) if n else 0, width, np.uint64)
            for k in range(width):
                rolled = _mixed(rolled * _STEP + h[a + k : b - width + 1 + k])
            out.append(np.unique(rolled))
    return out


def point_of(s: np.ndarray, groups: int) -> bytes:
    counts = np.bincount((s % np.uint64(groups)).astype(np.int64), minlength=groups)
    packer = zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
    return packer.compress(np.minimum(counts, FULL).astype(np.uint8).tobytes()) + packer.flush()


def points_of(column: pa.Array | pa.ChunkedArray, groups: int) -> np.ndarray:
    """The counts of points, which are stored and shuffled packed: small counts take two bits or so, not a byte."""
    return np.frombuffer(b"".join(zlib.decompress(x, -15, groups) for x in column.to_pylist()), np.uint8).reshape(-1, groups)


def folded(points: np.ndarray, groups: int) -> np.ndarray:
    return np.minimum(points.reshape(len(points), -1, groups).sum(axis=1, dtype=np.int64), FULL).astype(np.uint8)


def most_common(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """What the points allow the overlap to be at most: the sum of the smaller counts, or no bound."""
    least = np.minimum(p, q)
    return np.where((least == FULL).any(axis=1), np.int64(1) << 40, least.sum(axis=1, dtype=np.int64))


def _class_of(s: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s)))))


def frequent_cells(docs: DataFrame) -> np.ndarray:
    """A level for every cell of shingles, from counts over all documents: 0, or the binary logarithm of a count far above the usual.

    A task reports only the cells far above its mean, so little is shuffled. The table has 2^CELL_BITS bytes.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELL_BITS, np.int64)
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"))
            if sets:
                cells += np.bincount((np.concatenate(sets) >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=len(cells))
        heavy = np.flatnonzero(cells >= max(16.0, 8 * cells.mean()))
        yield pa.RecordBatch.from_arrays([pa.array(heavy.astype(np.int32)), pa.array(cells[heavy])], ["cell", "n"])

    levels = np.zeros(1 << CELL_BITS, np.uint8)
    found = docs.select("text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    found = found.select("cell", F.floor(F.log2("n")).cast("int").alias("level")).toArrow()
    levels[found["cell"].to_numpy()] = found["level"].to_numpy()
    return levels


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, h1, h2 (hashes of the text), n, cls (the set's hash), keys (the first shingles in the common order), point and fine point of every document.

    Of equal sets in one task only the first row has keys and points. Sets without shingles have none and no class.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent_cells(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, seen = shared.value, set()
        for batch in slices(batches):
            n, cls, keys, points, fine = [], [], [], [], []
            for s in shingle_sets(batch.column("text")):
                n.append(len(s))
                c = _class_of(s) if len(s) else None
                cls.append(c)
                if c is None or c in seen:
                    keys.append(None)
                    points.append(None)
                    fine.append(None)
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(c)
                first = len(s) - -(-THRESHOLD * len(s) // 100) + 1
                level = levels[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
                order = np.lexsort((s * _STEP, level))[:first]
                keys.append(s[order].view(np.int64))
                points.append(point_of(s, GROUPS))
                fine.append(point_of(s, FINE_GROUPS))
            columns = [*(batch.column(c) for c in ("doc_id", "h1", "h2")), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(points, pa.binary()), pa.array(fine, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h1", "h2", "n", "cls", "keys", "point", "fine"])

    schema = docs.select("doc_id").schema.add("h1", "long").add("h2", "long").add("n", "long").add("cls", "long").add("keys", ArrayType(LongType())).add("point", "binary").add("fine", "binary")
    h1, h2 = text_hashes()
    return docs.select("doc_id", "text", h1.alias("h1"), h2.alias("h2")).mapInArrow(run, schema)


def text_hashes() -> tuple[Column, Column]:
    """Two hashes of the text with different seeds."""
    return F.xxhash64("text"), F.xxhash64(F.lit(1), F.col("text"))


def reach_of(n, pos):
    """The largest partner that a set of size ``n`` can link with if the key at place ``pos`` is their first common one.

    The overlap is at most n - pos then, and a link needs 7 * overlap >= 3 * (both sizes). A pair with an earlier
    common key meets in that key's block, so in each block only pairs within reach of each other need be looked at.
    """
    return F.floor(((100 + THRESHOLD) * (n - pos) - THRESHOLD * n) / THRESHOLD).cast("int")


BLOCK = {"key": "long", "cls": "long", "n": "int", "reach": "int"}


def blocks(signed: DataFrame, turn: int) -> DataFrame:
    """key, cls, n, reach and those of the pivot (the block's first class), of the blocks of a turn with two classes or more.

    The rows are sorted by key, and a task reads them as a stream, so a block of any size takes no memory.
    """
    rows = signed.filter(F.col("keys").isNotNull()).select("cls", F.col("n").cast("int").alias("n"), F.posexplode("keys").alias("pos", "key"))
    rows = rows.filter(F.pmod("key", F.lit(BLOCK_TURNS)) == turn)
    rows = rows.select("key", "cls", "n", reach_of(F.col("n"), F.col("pos")).alias("reach"))
    rows = rows.repartition("key").sortWithinPartitions("key", "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, its block's pivot, and whether it has been written
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in BLOCK]
            if held is not None:
                columns = [np.concatenate([[h], x]).astype(x.dtype) for h, x in zip(held[0], columns)]
            if not len(columns[0]):
                continue
            new = np.concatenate([[True], (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])])
            columns = [c[new] for c in columns]
            key = columns[0]
            starts = np.concatenate([[True], key[1:] != key[:-1]])
            first = np.maximum.accumulate(np.where(starts, np.arange(len(key)), 0))
            pivots = [c[first] for c in columns[1:]]
            more = np.concatenate([key[1:] == key[:-1], [False]])
            keep = ~starts | more
            if held is not None:
                for pivot, value in zip(pivots, held[1]):
                    pivot[key == held[0][0]] = value
                keep[0] = more[0] and not held[2]
                if len(key) == 1:
                    continue
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in [*columns, *pivots]], [*BLOCK, "pivot", "pivot_n", "pivot_reach"])
            held = [c[-1] for c in columns], [p[-1] for p in pivots], bool(keep[-1])

    schema = ", ".join(f"{name} {kind}" for name, kind in BLOCK.items())
    return rows.mapInArrow(run, f"{schema}, pivot long, pivot_n int, pivot_reach int")


def sets_of(docs: DataFrame, signed: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls and shingles of the classes in ``wanted``, one row each.

    One text stands for each class. A bit table of fixed size (2 MB), computed from the hashes of all of these, tells
    most other texts apart before they are cut into shingles.
    """
    spark = docs.sparkSession
    texts = signed.select("cls", "h1").join(wanted, "cls", "left_semi").groupBy("cls").agg(F.min("h1").alias("h1"))
    bytes_ = texts.select(F.pmod("h1", F.lit(1 << BITMAP_BITS)).alias("bit")).groupBy(F.expr("bit div 8").alias("at")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("bit") % 8).cast("int"))).alias("bits")).toArrow()
    table = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    table[bytes_["at"].to_numpy()] = bytes_["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = shared.value, set()
        for whole in batches:
            bit = whole.column("h1").to_numpy() % (1 << BITMAP_BITS)
            for batch in slices(iter([whole.filter(pa.array((table[bit >> 3] >> (bit & 7) & 1) == 1))])):
                cls, sets = [], []
                for s in shingle_sets(batch.column("text")):
                    c = _class_of(s) if len(s) else None
                    if c is None or c in seen:
                        continue
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(c)
                    cls.append(c)
                    sets.append(s.view(np.int64))
                yield pa.RecordBatch.from_pydict({"cls": pa.array(cls, pa.int64()), "shingles": pa.array(sets, pa.list_(pa.int64()))})

    hashed = docs.select("text", text_hashes()[0].alias("h1"))
    found = hashed.mapInArrow(run, "cls long, shingles array<long>").join(wanted.select("cls"), "cls", "left_semi")
    return found.groupBy("cls").agg(F.any_value("shingles").alias("shingles"))


class CountTree:
    """An R-tree over count points, packed bottom-up: a node keeps the coordinate maxima and least size below it."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        # Packing order: by size, then by the place of the largest coordinate, so like points lie together.
        self.order = np.lexsort((points.argmax(axis=1), sizes))
        levels, self.points, self.sizes = [], points[self.order], sizes[self.order]
        top, least = self.points, self.sizes
        while len(top) > LEAF:
            starts = np.arange(0, len(top), LEAF)
            top, least = np.maximum.reduceat(top, starts), np.minimum.reduceat(least, starts)
            levels.append((top, least))
        self.levels = levels[::-1]

    def reach(self, point: np.ndarray, size: int) -> np.ndarray:
        """Indexes of the points whose summed minima with ``point`` allow a link, found from the root down."""
        some = None
        for top, least in [*self.levels, (self.points, self.sizes)]:
            if some is None:
                some = np.arange(len(top))
            else:
                some = (some[:, None] * LEAF + np.arange(LEAF)).ravel()
                some = some[some < len(top)]
            some = some[may_link(most_common(top[some], point), size, least[some])]
        return self.order[some]


def may_link(overlap: np.ndarray, size_a, size_b) -> np.ndarray:
    """Whether an overlap of at most this much can give the threshold; sizes may be lower bounds."""
    return (100 + THRESHOLD) * overlap >= THRESHOLD * (size_a + size_b)


def bounded(pairs: DataFrame, points: DataFrame, groups: int = GROUPS) -> DataFrame:
    """The pairs (a, b) whose points allow a link."""
    with_points = pairs.join(points.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("point").alias("p_a")), "a")
    with_points = with_points.join(points.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("point").alias("p_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(iter([whole]), "p_a", SLICE_BYTES // 8):
                p, q = (points_of(batch.column(c), groups) for c in ("p_a", "p_b"))
                ok = may_link(most_common(p, q), batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy())
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    # Sizes alone rule out most pairs before the points are looked at.
    fits = with_points.filter(100 * F.least("n_a", "n_b") >= THRESHOLD * F.greatest("n_a", "n_b"))
    return fits.mapInArrow(run, "a long, b long")


def verified(docs: DataFrame, signed: DataFrame, pairs: DataFrame) -> DataFrame:
    """The stored pairs with whether they link by their sets, which only now are fetched; stored too."""
    if pairs.limit(1).count() == 0:
        return pairs.withColumn("linked", F.lit(False))
    sets = sets_of(docs, signed, pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("s_a")), "a")
    both = both.join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("s_b")), "b")
    both = both.select("a", "b", (F.size("s_a") + F.size("s_b")).alias("total"), F.size(F.array_intersect("s_a", "s_b")).alias("common"))
    return stored(both.select("a", "b", (100 * F.col("common") >= THRESHOLD * (F.col("total") - F.col("common"))).alias("linked")), "verified")


def within_bounds(pairs: DataFrame, points: DataFrame, fine: DataFrame) -> DataFrame:
    """The pairs that both points let through, stored."""
    return stored(bounded(bounded(pairs, points), fine, FINE_GROUPS), "pairs")


def ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def components(links: DataFrame) -> DataFrame:
    """cls and root (the least class) of every class in the links (a, b): alternating large and small stars.

    Each round hangs neighbours on smaller nodes; it ends when the edges no longer change, all of them then being
    (node, root). Every group is an aggregate with partial sums, so a root with very many nodes does no harm.
    """
    edges, before = stored(links.select("a", "b").filter("a <> b").distinct(), "edges"), None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct()
        least = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        kept = large.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least, "u")
        small = kept.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        edges = stored(small.filter("a <> b").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("b").alias("cls"), F.col("a").alias("root"))


def _apart(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The block rows with their component, as far as a class of another component can be within reach.

    Of two linked sets the smaller reaches its own size, and each the other's.
    """
    rows = rows.drop("root").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    indexed = F.when(F.col("reach") >= F.col("n"), F.col("n"))
    block = rows.groupBy("key").agg(F.min(indexed).alias("least"), F.max("reach").alias("most"))
    rows = rows.join(block, "key").filter("reach >= least and n <= most").drop("least", "most")
    many = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
    return rows.join(many.select("key"), "key", "left_semi")


def merged_blocks(rows: DataFrame) -> DataFrame:
    """The rows of blocks that hold the same classes put together: one block, with the longest reach of every class."""
    content = rows.groupBy("key").agg(F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("h"), F.sum(F.xxhash64(F.lit(1), "cls").cast("decimal(38,0)")).alias("h2"),
                                      F.count(F.lit(1)).alias("m"))
    same = content.select("key", F.min("key").over(Window.partitionBy("h", "h2", "m")).alias("as_key"))
    return rows.join(same, "key").groupBy(F.col("as_key").alias("key"), "cls").agg(
        F.any_value("n").alias("n"), F.max("reach").alias("reach"), F.any_value("root").alias("root"))


def tree_pairs(rows: DataFrame, points: DataFrame, allowance: int) -> DataFrame:
    """Pairs (a, b, key, more) of block rows (key, cls, n, reach, root) in different components that the block's R-tree lets through.

    Blocks of more than TILE_ROWS rows are dealt into tiles, and every two tiles of a block meet once. A row gives the
    ``allowance`` likeliest pairs of a tile; ``more`` tells that it had others, which a later call with a larger
    allowance gives unless they have come into one component by then.
    """
    sizes = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TILE_ROWS).cast("int").alias("tiles"))
    rows = rows.join(sizes, "key").withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "cls", "n", "reach", "root")
    rows = rows.join(points.select("cls", "point"), "cls").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def compare(cls, root, tile, n, reach, points, i, j) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        one, two = (np.flatnonzero(tile == x) for x in (i, j))
        coarse = folded(points, TREE_GROUPS)
        tree = CountTree(coarse[two], n[two])
        for x in one.tolist():
            y = two[tree.reach(coarse[x], n[x])]
            y = y[(root[y] != root[x]) & ((cls[y] > cls[x]) | (i != j)) & (n[y] <= reach[x]) & (n[x] <= reach[y])]
            bound = most_common(points[y], points[x])
            fits = may_link(bound, n[x], n[y])
            y, bound = y[fits], bound[fits]
            if len(y):
                best = y[np.argsort(-bound / (n[y] + n[x]), kind="stable")[:allowance]]
                yield np.minimum(cls[best], cls[x]), np.maximum(cls[best], cls[x]), len(y) > allowance

    def pairs_of(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, i, j, tile, cls, root, n, reach = (t[c].to_numpy() for c in ("key", "i", "j", "tile", "cls", "root", "n", "reach"))
        n, reach = n.astype(np.int64), reach.astype(np.int64)
        pts = points_of(t["point"], FINE_GROUPS)
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        waiting, size = [], 0

        def batch():
            lo, hi, at, more = (np.concatenate([w[k] for w in waiting]) for k in range(4))
            # Once per pair, but for the keys of blocks that are not done.
            _, first = np.unique(np.stack([lo, hi, np.where(more, at, 0)]), axis=1, return_index=True)
            return pa.RecordBatch.from_pydict({"a": lo[first], "b": hi[first], "key": at[first], "more": more[first]})

        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
            for lo, hi, more in compare(cls[a:b], root[a:b], tile[a:b], n[a:b], reach[a:b], pts[a:b], i[a], j[a]):
                waiting.append((lo, hi, np.full(len(lo), key[a]), np.full(len(lo), more)))
                size += len(lo)
                if size >= PAIRS_PER_BATCH:
                    yield batch()
                    waiting, size = [], 0
        if waiting:
            yield batch()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                t = pa.Table.from_batches(waiting)
                key, i, j = (t[c].to_numpy() for c in ("key", "i", "j"))
                last = int(np.flatnonzero((key == key[-1]) & (i == i[-1]) & (j == j[-1]))[0])
                if last:  # the last group may go on in the next batch
                    yield from pairs_of(t.slice(0, last))
                waiting = t.slice(last).combine_chunks().to_batches()
                give_back()
        if waiting:
            yield from pairs_of(pa.Table.from_batches(waiting))
        give_back()

    return rows.mapInArrow(run, "a long, b long, key long, more boolean")


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The signatures of all rows, and the root of every class that is linked with another."""
    signed = stored(signatures(docs), "signatures")
    classes = signed.filter("point is not null").groupBy("cls").agg(F.any_value("n").alias("n"), F.any_value("point").alias("point"), F.any_value("fine").alias("fine"))
    rows = reduce(DataFrame.unionByName, [stored(blocks(signed, turn), "blocks") for turn in range(BLOCK_TURNS)])
    wanted = rows.select("cls").distinct()
    points = stored(classes.join(wanted, "cls", "left_semi"), "points")
    fine = points.select("cls", "n", F.col("fine").alias("point"))
    points = points.drop("fine")
    pairs = rows.filter("cls <> pivot and n <= pivot_reach and pivot_n <= reach").select(*ordered("cls", "pivot")).distinct()
    done = verified(docs, signed, within_bounds(pairs, points, fine))
    roots = components(done.filter("linked"))
    rows = stored(merged_blocks(_apart(rows.select(*BLOCK), roots)), "apart")
    apart = rows
    for turn in range(MAX_PIVOT_ROUNDS):
        per_root = apart.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"))
        per_key = per_root.groupBy("key").agg(F.sum("m").alias("rows"), F.sum(F.col("m") * F.col("m")).alias("within"))
        total, across = per_key.agg(F.sum("rows"), F.sum((F.col("rows") * F.col("rows") - F.col("within")) / 2)).first()
        if not total or across <= PAIRS_PER_ROW * total:
            break
        # Another class of each block, by chance, takes the pivot's place.
        pick = F.min_by(F.struct("cls", "n", "reach", "root"), F.xxhash64("cls", F.lit(turn)))
        pivots = apart.groupBy("key").agg(pick.alias("p"))
        more = apart.join(pivots, "key").filter("root <> p.root and n <= p.reach and p.n <= reach").select(*ordered("cls", "p.cls")).distinct()
        more = more.join(done, ["a", "b"], "left_anti")
        found = verified(docs, signed, within_bounds(more, points, fine))
        done = done.unionByName(found)
        if found.filter("linked").limit(1).count() == 0:
            break
        roots = components(done.filter("linked"))
        apart = stored(_apart(rows, roots), "apart")
    allowance = FIRST_ALLOWANCE
    while True:
        found = stored(tree_pairs(apart, fine, allowance), "found")
        more = stored(found.select("a", "b").distinct().join(done, ["a", "b"], "left_anti"), "pairs")
        done = done.unionByName(verified(docs, signed, more))
        roots = components(done.filter("linked"))
        unfinished = found.filter("more").select("key").distinct()
        if unfinished.limit(1).count() == 0:
            break
        allowance *= ALLOWANCE_STEP
        apart = stored(_apart(apart.join(unfinished, "key", "left_semi"), roots), "apart")
    return signed, roots


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: the smallest doc_id reachable by links, itself included.

    A null or empty text, or one without words, has no shingles and is linked with nothing: its component is its own
    id. A null doc_id never is the smallest; it is a component's id only if there is no other. Repeated rows share
    their component. An empty table gives no rows. Columns besides doc_id and text play no part.
    """
    signed, roots = linked(docs)
    ids = signed.groupBy("cls").agg(F.min("doc_id").alias("id")).filter("cls is not null")
    in_component = ids.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = in_component.groupBy("root").agg(F.min("id").alias("component_id"))
    of_class = in_component.join(least, "root").select("cls", "component_id")
    result = signed.select("doc_id", F.col("n").alias("n_shingles"), "cls").join(of_class, "cls", "left")
    return result.select("doc_id", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component; documents without shingles stay. Columns as they are.

    The texts decide what is one component, so rows with null or equal ids but unlinked texts all stay. Of a component
    the row with the least id stays (null last), of equal ids the one whose text has the least hash, and of rows equal
    in id and text one. An empty table gives no rows; extra columns may have any names.
    """
    one, two, copies = fresh("one", "two", "copies")
    signed, roots = linked(docs)
    rows = signed.filter("cls is not null").groupBy("cls", "doc_id", "h1", "h2").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.join(roots, "cls", "left").groupBy(F.coalesce("root", "cls").alias("root")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h1", "h2", "copies")).alias("r"))
    kept = rows.select(F.col("r.doc_id").alias("id"), F.col("r.h1").alias(one), F.col("r.h2").alias(two), F.col("r.copies").alias(copies))
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    h1, h2 = text_hashes()
    same = docs["doc_id"].eqNullSafe(kept["id"]) & (h1 == kept[one]) & (h2 == kept[two])
    found = docs.filter(has_words).join(kept, same)
    columns = [docs[c] for c in docs.columns]
    single = found.filter(F.col(copies) == 1).select(*columns)
    # Rows equal in id and text: combined before they are shuffled.
    row = F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias(copies)
    repeated = found.filter(F.col(copies) > 1).groupBy("id", one, two).agg(row).select(*[F.col(copies)[c].alias(c) for c in docs.columns])
    return single.unionByName(repeated).unionByName(docs.filter(~has_words))
