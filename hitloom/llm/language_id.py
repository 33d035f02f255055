"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. The probability of a word is the sum
over all its segmentations into pieces (forward algorithm, all words of a batch at once in numpy), that of a text the
product over its words. Probabilities come from expectation maximisation over word counts of a bounded sample; the
expected counts are computed and summed in Spark.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitloom.llm.common import Words, held_out, kept_by_worker, light_batches, slices, stored

#: Longest piece in bytes: a piece is one unsigned 64-bit number.
PIECE_BYTES = 8
#: A run of letters longer than this is cut, and no piece spans a cut.
WORD_BYTES = 48
#: Documents of a language that its probabilities are learned from.
MAX_DOCUMENTS = 1500
ROUNDS = 4
SMOOTHING = 0.01
#: Words whose scores a Python worker remembers. Most words that a text has once come never again.
CACHED_WORDS = 100_000
#: Text bytes scored at once: every word of them takes some 50 bytes a language meanwhile.
TEXT_BYTES = 2 << 20
UNDETERMINED = "und"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def read_pieces(path: str) -> list[bytes]:
    """All single bytes, then the longer pieces that hold letters (after a space or not) and are short enough."""
    with open(path, "rb") as f:
        found = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    longer = {p for p in found if 1 < len(p) <= PIECE_BYTES and not any(b < 0x80 and not chr(b).islower() for b in p[p[:1] == b" " :])}
    return [bytes([b]) for b in range(1, 256)] + sorted(longer)


class Pieces:
    """Piece numbers by packed bytes: a hash table in numpy with linear probing. Number 0 stands for no piece."""

    BITS = 19
    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[bytes]):
        self.count = len(pieces) + 1
        self.keys, self.ids = np.zeros(1 << self.BITS, np.uint64), np.zeros(1 << self.BITS, np.int32)
        self.probes = 1
        for number, p in enumerate(pieces, 1):
            key = np.uint64(int.from_bytes(p, "big"))
            at, n = int(self._slot(np.array([key]))[0]), 1
            while self.keys[at]:
                at, n = (at + 1) & ((1 << self.BITS) - 1), n + 1
            self.keys[at], self.ids[at], self.probes = key, number, max(self.probes, n)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * self.FACTOR) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        ids = np.where(self.keys[at] == keys, self.ids[at], 0)
        for _ in range(self.probes - 1):
            left = np.flatnonzero((ids == 0) & (self.keys[at] != 0))
            if not len(left):
                break
            at[left] = (at[left] + 1) & ((1 << self.BITS) - 1)
            ids[left] = np.where(self.keys[at[left]] == keys[left], self.ids[at[left]], 0)
        return ids


def word_bytes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of every word after a space, zero-padded, one row per word; and their numbers."""
    data = [b" " + w.encode("utf-8") for w in words]
    sizes = np.array([len(d) for d in data], np.int64)
    grid = np.zeros((len(data), int(sizes.max(initial=1))), np.uint8)
    grid[np.arange(grid.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(data), np.uint8)
    return grid, sizes


def cut(words: list[str]) -> list[list[str]]:
    """Every word as itself, or as runs of letters of at most WORD_BYTES / 4 each if it is too long."""
    step = WORD_BYTES // 4
    return [[w] if len(w) <= step or len(w.encode()) <= WORD_BYTES else [w[i : i + step] for i in range(0, len(w), step)] for w in words]


def segment_ids(grid: np.ndarray, pieces: Pieces) -> dict[tuple[int, int], np.ndarray]:
    """Piece numbers of all substrings: by end and length."""
    out, packed = {}, grid.astype(np.uint64)
    for end in range(1, grid.shape[1] + 1):
        key = np.zeros(len(grid), np.uint64)
        for length in range(1, min(PIECE_BYTES, end) + 1):
            key = key + (packed[:, end - length] << np.uint64(8 * (length - 1)))
            out[end, length] = pieces[key]
    return out


def forward(ids: dict, sizes: np.ndarray, width: int, table: np.ndarray) -> np.ndarray:
    """alpha[position, word, language]: probability of all segmentations up to a position."""
    alpha = np.zeros((width + 1, len(sizes), table.shape[1]))
    alpha[0] = 1
    for end in range(1, width + 1):
        for length in range(1, min(PIECE_BYTES, end) + 1):
            alpha[end] += alpha[end - length] * table[ids[end, length]]
        alpha[end][sizes < end] = 0
    return alpha


def word_scores(words: list[str], pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """log p(word | language), one row per word; words of like length are computed together."""
    out = np.zeros((len(words), table.shape[1]))
    parts = cut(words)
    owner = np.repeat(np.arange(len(words)), [len(p) for p in parts])
    flat = [x for p in parts for x in p]
    sizes = np.array([len(x.encode()) + 1 for x in flat], np.int64)
    order = np.argsort(sizes, kind="stable")
    for some in np.array_split(order, max(1, len(order) // 4096)):
        if len(some):
            grid, n = word_bytes([flat[i] for i in some])
            alpha = forward(segment_ids(grid, pieces), n, grid.shape[1], table)
            np.add.at(out, owner[some], np.log(alpha[n, np.arange(len(n))] + 1e-300))
    return out


def expected_counts(words: list[str], weights: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the words of one language, over all their segmentations."""
    total = np.zeros(pieces.count)
    parts = cut(words)
    weights = np.repeat(weights, [len(x) for x in parts])
    flat = [x for part in parts for x in part]
    order = np.argsort([len(x.encode()) for x in flat], kind="stable")
    for some in np.array_split(order, max(1, len(order) // 4096)):
        if not len(some):
            continue
        grid, n = word_bytes([flat[i] for i in some])
        width, ids = grid.shape[1], segment_ids(grid, pieces)
        alpha = forward(ids, n, width, p[:, None])[:, :, 0]
        beta = np.zeros((width + 1, len(n)))
        beta[n, np.arange(len(n))] = 1
        for start in range(width - 1, -1, -1):
            for length in range(1, min(PIECE_BYTES, width - start) + 1):
                beta[start] += p[ids[start + length, length]] * beta[start + length]
        whole = weights[some] / np.maximum(alpha[n, np.arange(len(n))], 1e-300)
        for (end, length), i in ids.items():
            total += np.bincount(i, whole * alpha[end - length] * p[i] * beta[end], pieces.count)
    total[0] = 0
    return total


def letters(texts: pa.Array) -> pa.Array:
    """Lower case, everything but letters turned to spaces."""
    return pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}]+", " ")


@dataclass
class Model:
    """Languages in order and the piece probabilities, one row per piece: vocabulary times languages."""

    languages: list[str]
    pieces: list[bytes]
    table: np.ndarray


def train(docs: DataFrame, learn, vocabulary: str | None = None) -> Model:
    """Learn from the rows with a language that ``learn`` (a Column over doc_id) admits."""
    light_batches(docs.sparkSession)
    pieces = read_pieces(vocabulary or default_vocabulary())
    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & learn(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    lookup = Pieces(pieces)
    if not languages:
        return Model([], pieces, np.zeros((lookup.count, 0)))
    share = F.create_map(*[F.lit(x) for l in languages for x in (l, int(min(1.0, MAX_DOCUMENTS / sizes[l]) * (1 << 30)))])
    sample = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < F.element_at(share, F.col("lang")))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(letters(batch.column("text")))
            lang = pc.dictionary_encode(batch.column("lang"))
            k = max(1, len(words.distinct))
            pair, n = np.unique(np.repeat(lang.indices.to_numpy(), words.counts()) * np.int64(k) + words.codes, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [lang.dictionary.take(pa.array(pair // k)), pa.array(words.distinct, pa.string()).take(pa.array(pair % k)), pa.array(n, pa.int64())], ["lang", "word", "n"]
            )

    counts = sample.mapInArrow(split, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = stored(counts, "language-words")
    table = np.full((lookup.count, len(languages)), 1.0 / len(pieces))
    table[0] = 0
    for _ in range(ROUNDS):
        shared = docs.sparkSession.sparkContext.broadcast((pieces, languages, table))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces, languages, table = shared.value
            lookup = Pieces(pieces)
            for batch in batches:
                lang, words = batch.column("lang").to_numpy(zero_copy_only=False), batch.column("word").to_numpy(zero_copy_only=False)
                n = batch.column("n").to_numpy().astype(float)
                for j, name in enumerate(languages):
                    mine = np.flatnonzero(lang == name)
                    if len(mine):
                        c = expected_counts(words[mine].tolist(), n[mine], lookup, table[:, j])
                        i = np.flatnonzero(c)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), j, np.int32)), pa.array(i.astype(np.int32)), pa.array(c[i])], ["language", "piece", "n"])

        sums = counts.mapInArrow(expect, "language int, piece int, n double").groupBy("language", "piece").agg(F.sum("n").alias("n"))
        fresh = np.full(table.shape, SMOOTHING)
        fresh[0] = 0
        for r in sums.collect():  # vocabulary times languages at most
            fresh[r["piece"], r["language"]] += r["n"]
        table = fresh / fresh.sum(axis=0)
    return Model(languages, pieces, table)


class Scorer:
    """Scores words by a model and remembers them between batches of a worker."""

    def __init__(self, model: Model):
        self.model, self.pieces = model, Pieces(model.pieces)
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.languages)))

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """log p(text | language), one row per text."""
        words = Words(letters(texts))
        if len(self.known) > CACHED_WORDS:
            self.known, self.rows = {}, self.rows[:0]
        new = [w for w in words.distinct if w not in self.known]
        if new:
            self.known.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.rows = np.concatenate([self.rows, word_scores(new, self.pieces, self.model.table)])
        rows = self.rows[np.fromiter((self.known[w] for w in words.distinct), np.int64, len(words.distinct))]
        ends = np.concatenate([np.zeros((1, rows.shape[1])), np.cumsum(rows[words.codes], axis=0)])
        return ends[words.offsets[1:]] - ends[words.offsets[:-1]]


def _predictor(shared, name: str):
    """A function from texts to languages and scores; one scorer per model and Python worker."""
    scorer = kept_by_worker(f"language {name}", lambda: Scorer(shared.value))

    def predict(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        languages = np.array([*scorer.model.languages, UNDETERMINED], object)
        lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        if len(languages) == 1:
            return np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
        logs = scorer(texts)
        p = np.exp(logs - logs.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = np.where(lettered, p.argmax(axis=1), len(languages) - 1)
        return languages[best], np.where(lettered, p.max(axis=1), 0.0)

    return predict


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every text: one narrow pass. Ties go to the language first in the alphabet."""
    import uuid

    light_batches(docs.sparkSession)
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guess = _predictor(shared, name)
        for batch in slices(batches, limit=TEXT_BYTES):
            lang, score = guess(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    schema = docs.select("doc_id").schema.add("lang_pred", "string").add("score", "double")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document.

    Nothing is learned from rows whose crc32(doc_id) mod 4 is 2. A text that is null or has no letter is ``und`` with
    score 0, and so is every text if no row has a language. Repeated rows get equal results; a null doc_id is not held
    out. An empty table gives no rows. Other columns play no part.
    """
    model = train(docs, lambda c: ~held_out(c, 4, 2))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def filter_documents(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """The documents whose language is determined with at least ``min_score``; all columns as they are."""
    import uuid

    model = train(docs, lambda c: ~held_out(c, 4, 2))
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guess = _predictor(shared, name)
        for batch in slices(batches, limit=TEXT_BYTES):
            lang, score = guess(batch.column("text"))
            yield batch.filter(pa.array((lang != UNDETERMINED) & (score >= min_score)))

    return docs.mapInArrow(run, docs.schema)
