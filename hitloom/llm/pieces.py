"""SentencePiece encoding and decoding; giant documents by a max-plus scan over chunks.

The segmentation of a text is the one with the largest sum of piece scores; of equal sums the longest last piece wins,
from the end of the text on. No piece of the vocabulary goes on past the start of a run of spaces, so an ordinary text
is encoded word by word, all distinct words of a batch together. A text of more than CHUNK characters is cut into chunks wherever CHUNK characters end. The
state at a cut is how many characters the piece across it reaches into the next chunk. Every chunk gives a matrix of
best scores from entry to exit state; an associative max-plus scan gives the true scores at every cut; with these each
chunk maps exit states to entry states, the maps are composed from the end, and each chunk is traced back on its own.

The vocabulary is fixed and public; its stored scores are taken as they are and add up along a path. The default file
comes from a merge model, whose stored scores are ranks: its own encoder merges greedily by rank, which no sum over a
path expresses, so the ids here are those of the best path by score and not that encoder's. Decoding inverts both.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from hitloom.llm.common import fresh, slices, small_batches, stored, unsigned_crc32

CHUNK = 1 << 16
CHUNKS_PER_TASK = 4
SPACE = "▁"
#: A character without a piece costs this much more than the worst piece, and becomes its UTF-8 bytes.
UNKNOWN_COST = 10
#: Words up to this length are encoded together, longer ones one by one.
WORD_CHARS = 64
#: Characters of words, text bytes and ids that a worker handles at once: what it holds besides the batch grows with these.
CHARS_AT_ONCE, BYTES_AT_ONCE, IDS_AT_ONCE = 1 << 16, 2 << 20, 1 << 19
#: Ids that a worker remembers, with their words, from one run of texts to the next; beyond that it starts anew.
IDS_REMEMBERED = 1 << 21
NEVER = -(1 << 60)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Ids and scores of the pieces, and what each id stands for in bytes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        # Whole numbers, so that sums are exact in any order: the scores if they are whole, else millionths.
        scale = 1 if all(float(model.get_score(i)).is_integer() for i in range(model.get_piece_size())) else 1_000_000
        self.known: dict[str, tuple[int, int]] = {}
        self.bytes_of, byte_ids = [], {}
        for i in range(model.get_piece_size()):
            piece, special = model.id_to_piece(i), model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
            if model.is_byte(i):
                byte_ids[int(piece[1:-1], 16)] = i
                self.bytes_of.append(bytes([int(piece[1:-1], 16)]))
            else:
                self.bytes_of.append(b"" if special else piece.replace(SPACE, " ").encode())
                if not special:
                    self.known[piece] = (i, round(model.get_score(i) * scale))
        self.byte_ids = [byte_ids[b] for b in range(256)]
        self.unknown = min(s for _, s in self.known.values()) - UNKNOWN_COST * scale
        if -self.unknown * (4 * CHUNK) >= -NEVER:
            raise ValueError("the scores of a chunk may not fit a long")
        self.longest = max(map(len, self.known))
        lengths: dict[str, set[int]] = {}
        for piece in self.known:
            lengths.setdefault(piece[0], set()).add(len(piece))
        self.lengths = {c: sorted(x) for c, x in lengths.items()}
        if any(SPACE in p.lstrip(SPACE) for p in self.known):
            raise ValueError("a piece goes on past the start of a run of spaces")
        self._grow()
        self._forget()

    def _forget(self) -> None:
        """The remembered words, with the place of their ids in one array and how many they are."""
        self._seen, self._seen_ids = pa.array([], pa.string()), np.zeros(0, np.int32)
        self._seen_at, self._seen_n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _grow(self) -> None:
        """The pieces as a tree of characters in arrays: (node, character) keys in a hash table and the nodes they lead to."""
        nodes: dict[tuple[int, int], int] = {}
        piece, score = [-1], [0]
        for text, (i, value) in self.known.items():
            at = 0
            for c in text:
                step = (at, ord(c))
                if step not in nodes:
                    nodes[step] = len(piece)
                    piece.append(-1)
                    score.append(0)
                at = nodes[step]
            piece[at], score[at] = i, value
        steps = sorted(nodes)
        keys, leads = np.array([n << 21 | c for n, c in steps], np.int64), np.array([nodes[x] for x in steps], np.int64)
        self._bits = max(10, len(steps).bit_length() + 2)
        self._keys, self._next = np.full(1 << self._bits, -1, np.int64), np.zeros(1 << self._bits, np.int64)
        slot, self._probes = self._slot(keys), 0
        while len(keys):
            free = np.flatnonzero(self._keys[slot] < 0)
            free = free[np.unique(slot[free], return_index=True)[1]]
            self._keys[slot[free]], self._next[slot[free]] = keys[free], leads[free]
            left = np.delete(np.arange(len(keys)), free)
            keys, leads, slot = keys[left], leads[left], (slot[left] + 1) & (len(self._keys) - 1)
            self._probes += 1
        self._piece, self._score = np.array(piece, np.int64), np.array(score, np.int64)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self._bits)).astype(np.int64)

    def _find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slots of the keys, and which are there: a key lies in the first slot of its own on that was free."""
        place = self._slot(key)
        there = self._keys[place]
        hit, open_ = there == key, np.flatnonzero((there != key) & (there >= 0))
        for _ in range(1, self._probes):
            if not len(open_):
                break
            place[open_] = (place[open_] + 1) & (len(self._keys) - 1)
            there = self._keys[place[open_]]
            hit[open_] = there == key[open_]
            open_ = open_[(there != key[open_]) & (there >= 0)]
        return place, hit

    def lattice(self, chars: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All pieces that begin at a character and end within its room: start, length, id and score.

        A character that is no piece has id -1 and the unknown score.
        """
        at, node = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        found = []
        for n in range(1, self.longest + 1):
            fits = room[at] >= n
            at, node = at[fits], node[fits]
            place, hit = self._find(node << 21 | chars[at + n - 1])
            if n == 1:
                lost = at[~hit | (self._piece[self._next[place]] < 0)]
                found.append((lost, np.ones(len(lost), np.int64), np.full(len(lost), -1), np.full(len(lost), self.unknown)))
            at, node = at[hit], self._next[place[hit]]
            whole = self._piece[node] >= 0
            found.append((at[whole], np.full(int(whole.sum()), n), self._piece[node[whole]], self._score[node[whole]]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and the offsets of each word's; runs of words at a time."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        runs = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // CHARS_AT_ONCE)) + 1
        parts = [self._run_ids(words[a:b], sizes[a:b]) for a, b in zip([0, *runs.tolist()], [*runs.tolist(), len(words)])]
        return np.concatenate([ids for ids, _ in parts]), np.concatenate([[0], np.cumsum(np.concatenate([n for _, n in parts]))])

    def known_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An array of ids, and where in it the ids of each of the words begin and how many they are."""
        place = pc.index_in(words, value_set=self._seen)
        new = words.filter(place.is_null())
        flat, offsets = self.word_ids(new.to_pylist())
        ids, at = np.concatenate([self._seen_ids, flat]), np.concatenate([self._seen_at, len(self._seen_ids) + offsets[:-1]])
        n = np.concatenate([self._seen_n, np.diff(offsets)])
        where = place.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        where[where < 0] = len(self._seen) + np.arange(len(new))
        if len(ids) > IDS_REMEMBERED:
            self._forget()
        else:
            self._seen, self._seen_ids, self._seen_at, self._seen_n = pa.concat_arrays([self._seen, new]), ids, at, n
        return ids, at[where], n[where]

    def _run_ids(self, words: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words one after the other, and how many each has."""
        together = np.flatnonzero(sizes <= WORD_CHARS)
        chars = np.frombuffer("".join(words[i] for i in together.tolist()).encode("utf-32-le"), np.uint32).astype(np.int64)
        size = sizes[together]
        start = np.cumsum(size) - size
        within = np.arange(len(chars)) - np.repeat(start, size)
        at, n, piece, score = self.lattice(chars, np.repeat(size, size) - within)
        # Every word has one slot more than characters: its places from 0 to its end.
        slot = at + np.repeat(np.arange(len(size)), size)[at]
        step = within[at].astype(np.uint8)
        order = np.argsort(step, kind="stable")
        slot, n, piece, score = slot[order], n[order], piece[order], score[order]
        cuts = np.searchsorted(step[order], np.arange(WORD_CHARS + 1))
        first = start + np.arange(len(size))
        slots = int(size.sum()) + len(size)
        best, last, last_id = np.full(slots, NEVER), np.zeros(slots, np.int64), np.full(slots, -1)
        best[first] = 0
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            # Places in order, so the first of equal sums has the longest last piece; targets of one place differ.
            to, sums = slot[a:b] + n[a:b], best[slot[a:b]] + score[a:b]
            better = sums > best[to]
            to = to[better]
            best[to], last[to], last_id[to] = sums[better], n[a:b][better], piece[a:b][better]
        on_path, here = np.zeros(slots, bool), first + size
        while len(here):
            here = here[last[here] > 0]
            on_path[here] = True
            here = here - last[here]
        chosen = np.flatnonzero(on_path)
        owner = np.repeat(np.arange(len(size)), size + 1)[chosen]
        ids, width = last_id[chosen][:, None].repeat(4, axis=1), np.ones(len(chosen), np.int64)
        # A character of no piece becomes the ids of its bytes.
        lost = np.flatnonzero(ids[:, 0] < 0)
        kinds, which = np.unique(chars[chosen[lost] - owner[lost] - 1], return_inverse=True)
        as_bytes = [self.ids(chr(c)) for c in kinds.tolist()]
        ids[lost] = np.array([b + [0] * (4 - len(b)) for b in as_bytes], np.int64).reshape(-1, 4)[which]
        width[lost] = np.array([len(b) for b in as_bytes], np.int64)[which]
        alone = {int(i): self.word(words[int(i)]) for i in np.flatnonzero(sizes > WORD_CHARS)}
        counts = np.zeros(len(words), np.int64)
        counts[together] = np.bincount(owner, width, len(together)).astype(np.int64)
        for i, found in alone.items():
            counts[i] = len(found)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        flat = np.zeros(offsets[-1], np.int32)
        ends = np.cumsum(width)
        before = np.concatenate([[0], np.cumsum(counts[together])])[owner]  # ids of the words before, of those together
        place = offsets[together[owner]] + ends - width - before
        for k in range(4):
            some = width > k
            flat[place[some] + k] = ids[some, k]
        for i, found in alone.items():
            flat[offsets[i] : offsets[i + 1]] = found
        return flat, counts

    def steps(self, text: str, p: int) -> list[tuple[int, int]]:
        """Lengths and scores of the pieces at a place, shortest first; the single character always is one."""
        found, end = [], len(text)
        for n in self.lengths.get(text[p], ()):
            if p + n > end:
                break
            hit = self.known.get(text[p : p + n])
            if hit is not None:
                found.append((n, hit[1]))
        return found if found and found[0][0] == 1 else [(1, self.unknown), *found]

    def ids(self, piece: str) -> list[int]:
        hit = self.known.get(piece)
        if hit is not None:
            return [hit[0]]
        return [self.byte_ids[b] for b in piece.replace(MARK, SPACE).encode()]

    def forward(self, text: str, size: int, entry: list[int]) -> tuple[list[int], list[int]]:
        """Best score at every place up to ``size`` and the reach beyond, and the length of the best last piece (0: entry)."""
        best, last = entry + [NEVER] * (size + self.longest - len(entry)), [0] * (size + self.longest)
        for p in range(size):
            here = best[p]
            if here <= NEVER:
                continue
            for n, score in self.steps(text, p):
                # Places are met in order, so the first of equal sums has the longest last piece; an entry is longer still.
                if here + score > best[p + n]:
                    best[p + n], last[p + n] = here + score, n
        return best, last

    def trace(self, text: str, last: list[int], place: int) -> tuple[list[int], int]:
        """The ids of the pieces that begin in the text and end at ``place``, and where their path enters."""
        pieces = []
        while last[place]:
            pieces.append(text[place - last[place] : place])
            place -= last[place]
        return [i for piece in reversed(pieces) for i in self.ids(piece)], place

    def word(self, text: str) -> list[int]:
        return self.trace(text, self.forward(text, len(text), [0])[1], len(text))[0]

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """The ids of every text; of a null or empty one none."""
        split = [WORD.findall(shown(t)) if t else [] for t in texts]
        coded = pa.array([w for words in split for w in words], pa.string()).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        flat, start, n = self.known_ids(coded.dictionary)
        sizes = n[codes]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = flat[np.repeat(start[codes] - ends[:-1], sizes) + np.arange(ends[-1])]
        of_text = np.concatenate([[0], np.cumsum([len(w) for w in split])]).astype(np.int64)
        return pa.ListArray.from_arrays(pa.array(ends[of_text].astype(np.int32)), pa.array(ids, pa.int32()))

    def decode(self, ids: pa.Array) -> list[str]:
        """The texts of lists of ids. Ids of no piece count as nothing; bytes that are no UTF-8 become the replacement character."""
        offsets = ids.offsets.to_numpy().astype(np.int64)
        values = ids.values.slice(offsets[0], offsets[-1] - offsets[0]).fill_null(-1).to_numpy(zero_copy_only=False)
        known = np.where((values >= 0) & (values < len(self.bytes_of)), values, len(self.bytes_of))
        parts = pa.array([*self.bytes_of, b""], pa.binary()).take(pa.array(known))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), parts), b"")
        return [b.decode("utf-8", "replace").removeprefix(" ") for b in joined.to_pylist()]

    def transfer(self, text: str, size: int) -> np.ndarray:
        """Best scores of a chunk from each entry state (row) to each exit state."""
        best = np.full((size + self.longest, self.longest), NEVER, np.int64)
        best[np.arange(self.longest), np.arange(self.longest)] = 0
        for p in range(size):
            for n, score in self.steps(text, p):
                np.maximum(best[p + n], best[p] + score, out=best[p + n])
        return np.maximum(best[size:].T, NEVER)


#: Stands for the character SPACE of a text itself, which is no space: it is written as bytes.
MARK = "﷐"
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def shown(text: str) -> str:
    """The text as pieces see it: a space in front, every space visible. It is one character longer."""
    return SPACE + text.replace(SPACE, MARK).replace(" ", SPACE)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def level(m: np.ndarray) -> np.ndarray:
    """Stacks of matrices with their largest entries at 0: only differences decide, and these stay small."""
    top = m.max(axis=(1, 2), keepdims=True)
    return np.where(m <= NEVER, NEVER, m - top)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus products of two stacks of matrices, each with its largest entry at 0."""
    out = np.full(a.shape, NEVER, np.int64)
    for k in range(a.shape[-1]):
        np.maximum(out, a[:, :, k, None] + b[:, None, k, :], out=out)
    return level(np.maximum(out, NEVER))


def prefix_products(m: np.ndarray) -> np.ndarray:
    """Entry k: the product of the matrices 0 to k, by doubling (the product is associative)."""
    m, step = level(m), 1
    while step < len(m):
        m[step:] = product(m[:-step], m[step:])
        step *= 2
    return m


def _giant_ids(giant: DataFrame, row: str, text: str, model: str, chunk: int) -> DataFrame:
    """``row`` and ids of texts longer than a chunk. The matrices of one text meet in one group: 32 000 at most, for a
    Spark string holds 2 GB; the text itself never does."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = pieces(model).longest - 1
        for batch in batches:
            for r, whole in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen = shown(whole.as_py())
                for k, start in enumerate(range(0, len(seen), chunk)):
                    part = seen[start : start + chunk + reach]
                    yield pa.RecordBatch.from_pydict({"row": pa.array([r], pa.int64()), "k": pa.array([k], pa.int32()), "size": pa.array([min(chunk, len(seen) - start)], pa.int32()), "part": [part]})

    def matrices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"row": f["row"], "k": f["k"], "m": [pieces(model).transfer(t, n).tobytes() for t, n in zip(f["part"], f["size"])]})

    def entries(group: pd.DataFrame) -> pd.DataFrame:
        group, n = group.sort_values("k"), pieces(model).longest
        first = np.full((1, n), NEVER, np.int64)
        first[0, 0] = 0
        m = np.frombuffer(b"".join(group["m"]), np.int64).reshape(-1, n, n)
        vectors = np.concatenate([first, prefix_products(m)[:-1, 0, :]])
        return pd.DataFrame({"row": group["row"], "k": group["k"], "entry": [v.tobytes() for v in vectors]})

    def entered(f: pd.DataFrame):
        for t, n, e in zip(f["part"], f["size"], f["entry"]):
            yield t, n, pieces(model).forward(t, n, np.frombuffer(e, np.int64).tolist())[1]

    def maps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            back = [[pieces(model).trace(t, last, n + j)[1] for j in range(pieces(model).longest)] for t, n, last in entered(f)]
            yield pd.DataFrame({"row": f["row"], "k": f["k"], "back": back})

    def exits(group: pd.DataFrame) -> pd.DataFrame:
        group, state, out = group.sort_values("k"), 0, []
        for back in reversed(group["back"].tolist()):
            out.append(state)
            state = int(back[state])
        return pd.DataFrame({"row": group["row"], "k": group["k"], "exit": out[::-1]})

    def traced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids = [pieces(model).trace(t, last, n + j)[0] for (t, n, last), j in zip(entered(f), f["exit"])]
            yield pd.DataFrame({"row": f["row"], "k": f["k"], "ids": ids})

    chunks = stored(giant.select(row, text).mapInArrow(cut, "row long, k int, size int, part string"), "chunks")
    # A chunk is little to read and much to compute, so small partitions: a number is not merged by adaptive execution.
    tasks = max(1, -(-chunks.count() // CHUNKS_PER_TASK))
    chunks = chunks.repartition(tasks, "row", "k")
    first = chunks.mapInPandas(matrices, "row long, k int, m binary").groupBy("row").applyInPandas(entries, "row long, k int, entry binary")
    chunks = stored(chunks.join(first, ["row", "k"]), "chunks").repartition(tasks, "row", "k")
    last = chunks.mapInPandas(maps, "row long, k int, back array<int>").groupBy("row").applyInPandas(exits, "row long, k int, exit int")
    found = chunks.join(last, ["row", "k"]).mapInPandas(traced, "row long, k int, ids array<int>")
    in_order = F.array_sort(F.collect_list(F.struct("k", "ids")))
    return found.groupBy(F.col("row").alias(row)).agg(F.flatten(F.transform(in_order, lambda x: x["ids"])).alias("ids"))


def encode(docs: DataFrame, text_column: str = "text", output: str = "ids", model: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """All rows and columns, and ``output``: the piece ids of the text as array of int.

    Null and empty texts have no ids. Repeated rows get equal ids; an empty table stays empty. Other columns may have
    any names; one named ``output`` is replaced. Nothing is normalised: decode() gives every text back, but for one that
    holds the noncharacter U+FDD0, which comes back as U+2581.
    """
    model = model or default_model()
    small_batches(docs.sparkSession)
    row, long_ids = fresh("row", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(iter([whole]), text_column, BYTES_AT_ONCE):
                ids = pieces(model).encode(batch.column(text_column).to_pylist())
                names = [c for c in batch.schema.names if c != output]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), ids], [*names, output])

    docs = docs.drop(output) if output != text_column else docs
    giant = F.coalesce(F.char_length(f"`{text_column}`") >= chunk, F.lit(False))
    schema = type(docs.schema)([*docs.schema.fields]).add(output, ArrayType(IntegerType()))
    short = docs.filter(~giant).mapInArrow(run, schema)
    # Row numbers are not stable when a task runs again: the giant rows are written with theirs.
    long = stored(docs.filter(giant).withColumn(row, F.monotonically_increasing_id()), "giant")
    ids = _giant_ids(long, row, text_column, model, chunk).withColumnRenamed("ids", long_ids)
    long = long.join(ids, row).withColumn(output, F.col(long_ids)).drop(row, long_ids)
    return short.unionByName(long)


def decode(df: DataFrame, ids_column: str = "ids", output: str = "decoded", model: str | None = None) -> DataFrame:
    """All rows and columns, and ``output``: the text of the ids. Null ids give an empty text."""
    model = model or default_model()
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ids_column, IDS_AT_ONCE, pc.list_value_length):
            lists = batch.column(ids_column)
            texts = pieces(model).decode(pc.if_else(lists.is_valid(), lists, pa.scalar([], lists.type)) if lists.null_count else lists)
            names = [c for c in batch.schema.names if c != output]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], [*names, output])

    df = df.drop(output)
    return df.mapInArrow(run, type(df.schema)([*df.schema.fields]).add(output, "string"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of the ids joined by commas) and round_trip (whether decoding gives the text back)."""
    df = decode(encode(docs.select("doc_id", "text")))
    joined = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return df.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), unsigned_crc32(joined).alias("ids_crc32"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )
