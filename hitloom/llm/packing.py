"""Best-fit packing of tokenized documents into sequences of fixed capacity.

Tokenizing is one narrow pass. The pieces that fill a sequence alone are placed at once; all others are dealt into
groups of about ``GROUP_ROWS`` rows, and each group is packed by best-fit decreasing on its own, so no task sees more
than one group and a group wastes less than one sequence more than packing all at once would.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitloom.llm.common import Words, kept_by_worker, light_batches, slices, stored

CAPACITY = 2048
END_ID = 0
GROUP_ROWS = 32_000
#: Words whose ids a Python worker remembers.
CACHED_WORDS = 200_000
#: Text bytes tokenized at once: a word that repeats among them is looked up once, every id takes some 30 bytes meanwhile.
TEXT_BYTES = 2 << 20

PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long, row_key long"
PACKED = "doc_id {id}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of texts, word by word: this tokenizer drops white space and no token spans it, so words are independent.

    Words of plain letters, digits and signs are lower-cased and cut here, and only their parts go through the merges;
    whatever else a word holds (an apostrophe, another script, a special token) goes through the whole tokenizer.
    """

    PLAIN = re.compile(r"[!-&(-~À-ÖØ-öø-ÿ]+")
    PART = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        # What stands for each byte of a letter above ASCII.
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xC0, 0x100))})
        self.known: dict[str, bytes] = {}

    def part(self, part: str) -> bytes:
        data = self.known.get(part)
        if data is None:
            data = array("I", [t.id for t in self.merges.tokenize(part.translate(self.letters))]).tobytes()
            self.known[part] = data
        return data

    def word(self, word: str) -> bytes:
        data = self.known.get(word)
        if data is None:
            if self.PLAIN.fullmatch(word) and "<|" not in word:
                data = b"".join(map(self.part, self.PART.findall(word.lower())))
            else:
                data = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
            self.known[word] = data
        return data

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's ids end."""
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        words = Words(texts)
        data = [self.word(w) for w in words.distinct]
        sizes = np.fromiter(map(len, data), np.int64, len(data)) >> 2
        flat, starts = np.frombuffer(b"".join(data), "<u4"), np.cumsum(sizes) - sizes
        lengths = sizes[words.codes]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(starts[words.codes] - ends[:-1], lengths) + np.arange(ends[-1])
        return flat[at], ends[words.offsets[1:]]


def _word_ids(path: str) -> WordIds:
    """One per Python worker, kept between tasks."""
    return kept_by_worker(f"ids {path}", lambda: WordIds(path))


def tokenized(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: its ids and the end id, cut into runs of ``capacity``. A null text is empty.

    ``row_key`` is the place of the row in its task; with ``with_ids`` a column ``ids`` holds the ids of the piece.
    """
    light_batches(docs.sparkSession)
    path = tokenizer_path or default_tokenizer()
    schema = PIECES.format(id=docs.schema["doc_id"].dataType.simpleString()) + (", ids binary" if with_ids else "")
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, key = _word_ids(path), TaskContext.get().partitionId() << 33
        for batch in slices(batches, limit=TEXT_BYTES):
            rows, piece, start, length, crc, keys, ids = [], [], [], [], [], [], []
            numbers, ends = encode(batch.column("text"))
            for i, (begin, end) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
                data = numbers[begin:end].tobytes() + END_ID.to_bytes(4, "little")
                for at in range(0, len(data), step):
                    part = data[at : at + step]
                    rows.append(i)
                    piece.append(at // step)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    keys.append(key)
                    key += 1
                    if with_ids:
                        ids.append(part)
            columns = [
                batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                *[pa.array(c, pa.int64()) for c in (start, length, crc, keys)], *([pa.array(ids, pa.binary())] if with_ids else []),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "row_key", *(["ids"] if with_ids else [])]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


class OpenBins:
    """A segment tree over remaining capacities: a node is set if an open bin has a capacity of its range left."""

    def __init__(self, capacity: int):
        self.half = 1 << capacity.bit_length()
        self.tree = bytearray(2 * self.half)
        self.bins: list[list[int]] = [[] for _ in range(self.half)]

    def add(self, left: int, bin_: int) -> None:
        self.bins[left].append(bin_)
        node = left + self.half
        while node and not self.tree[node]:
            self.tree[node] = 1
            node >>= 1

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """Least remaining capacity that is ``need`` or more, and a bin with it, which is taken out."""
        tree, node = self.tree, need + self.half
        if not tree[node]:
            while node & 1 or not tree[node + 1]:  # up until a set node lies to the right
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            while node < self.half:  # down to its leftmost set leaf
                node = 2 * node if tree[2 * node] else 2 * node + 1
        left = node - self.half
        bin_ = self.bins[left].pop()
        if not self.bins[left]:
            while node and not (node < self.half and (tree[2 * node] or tree[2 * node + 1])):
                tree[node] = 0
                node >>= 1
        return left, bin_


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item, by best-fit decreasing; equal lengths in the given order."""
    open_bins, opened = OpenBins(capacity), 0
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = open_bins.take_tightest(need)
        if found is None:
            found, opened = (capacity, opened), opened + 1
        left, bin_ = found
        bins[i], offsets[i] = bin_, capacity - left
        if left > need:
            open_bins.add(left - need, bin_)
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Sequence and offset of every piece. ``pieces`` must be stored rows, as two jobs read them."""
    keep = [c for c in pieces.columns if c != "row_key"]
    open_ = pieces.filter(F.col("length") < capacity)
    groups = max(1, -(-open_.count() // GROUP_ROWS))
    schema = pieces.select(*keep).schema.add("sequence_id", "long").add("offset", "long")

    def pack_group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row_key")
        bins, offsets = best_fit(rows["length"].to_numpy(), capacity)
        return rows[keep].assign(sequence_id=2 * (int(key[0]) * (GROUP_ROWS << 12) + bins) + 1, offset=offsets)

    grouped = open_.withColumn("__group", F.pmod(F.xxhash64("row_key"), F.lit(groups)))
    packed = grouped.groupBy("__group").applyInPandas(pack_group, schema)
    full = pieces.filter(F.col("length") == capacity)
    # Odd numbers are packed sequences, even ones hold one full piece.
    full = full.select(*keep, (2 * F.col("row_key")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and offset; all ids, or with ``with_ids`` also their bytes.

    Null and empty texts are one piece of the end id. Repeated rows are packed like any others; a null doc_id stays
    null. An empty table gives no rows. Columns besides doc_id and text play no part. Ties in length keep no
    particular order. Rows come out in any order.
    """
    return pack(stored(tokenized(docs, tokenizer_path, capacity, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of every sequence, from pieces packed ``with_ids``: at most one sequence's pieces meet in a group."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    hexes = F.array_join(F.transform(parts, lambda p: F.hex(p["ids"])), "")
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.unhex(hexes).alias("ids"))
