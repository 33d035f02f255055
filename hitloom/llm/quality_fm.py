"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]): all pairwise interactions in
time linear in the features. Learned in numpy on a bounded sample of labelled rows, scored in one narrow pass.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitloom.llm.common import Words, held_out, slices

WORD_BITS = 15
RANK = 8
#: Labelled documents to learn from, of each class.
MAX_PER_CLASS = 1500
STEPS, RATE, DECAY = 120, 0.05, 1e-5
TEXT_BYTES = 16 << 20
#: Characters of each kind as a share of the text. Expressions of the RE2 kind.
CHARACTERS = {
    "upper": r"\p{Lu}", "digit": r"[0-9]", "symbol": r"[#*$%&<>{}\\^~_=+]", "bar": r"[|»•·]", "shout": r"[!?]{2}",
    "stop": r"[.!?](\s|$)", "comma": r"[,;:]", "line": r"\n", "url": r"https?://|www\.",
}
STATISTICS = [*CHARACTERS, "log_words", "log_chars", "word_length", "distinct", "adjacent_repeats", "bytes_per_char"]


def _word_bucket(word: str) -> int:
    return zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) & ((1 << WORD_BITS) - 1)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every text: word buckets and their values in runs (ids, values, run ends), and the statistics matrix."""
    texts = pc.fill_null(texts, "")
    words = Words(texts)
    n, k = len(words), max(1, len(words.distinct))
    counts = words.counts()
    doc = np.repeat(np.arange(n), counts)
    pairs, times = np.unique(doc * np.int64(k) + words.codes, return_counts=True)
    owner = pairs // k
    buckets = np.fromiter(map(_word_bucket, words.distinct), np.int64, len(words.distinct))
    ids = buckets[pairs % k] if len(pairs) else np.zeros(0, np.int64)
    values = times / np.sqrt(np.bincount(owner, times.astype(float) ** 2, n))[owner]
    chars = pc.utf8_length(texts).to_numpy().astype(float)
    size = pc.binary_length(texts).to_numpy().astype(float)
    some = np.maximum(chars, 1)
    same = np.concatenate([[False], words.codes[1:] == words.codes[:-1]]) if len(words.codes) else np.zeros(0, bool)
    columns = [np.sqrt(pc.count_substring_regex(texts, p).to_numpy() / some) for p in CHARACTERS.values()]
    columns += [
        np.log1p(counts), np.log1p(chars), chars / np.maximum(counts, 1) / 10, np.bincount(owner, minlength=n) / np.maximum(counts, 1),
        np.bincount(doc, same, n) / np.maximum(counts, 1), size / some,
    ]
    return ids, values, np.searchsorted(owner, np.arange(n), side="right"), np.stack(columns, axis=1)


@dataclass
class Model:
    """Weights and factors: hashed words first, statistics after them. A fixed size, whatever the data."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def logits(self, ids, values, ends, stats) -> np.ndarray:
        n, base = len(ends), 1 << WORD_BITS
        dense = np.clip((stats - self.mean) / self.scale, -4, 4)
        owner = np.repeat(np.arange(n), np.diff(np.concatenate([[0], ends])))
        z = self.w0 + dense @ self.w[base:] + np.bincount(owner, self.w[ids] * values, n)
        for f in range(self.v.shape[1]):
            factor = self.v[:, f]
            word = factor[ids] * values
            total = np.bincount(owner, word, n) + dense @ factor[base:]
            squares = np.bincount(owner, word * word, n) + (dense * dense) @ (factor[base:] ** 2)
            z = z + 0.5 * (total * total - squares)
        return z


def fit(ids, values, ends, stats, labels: np.ndarray, seed: int = 11) -> Model:
    """Logistic loss on the whole sample, minimised by Adam."""
    n, base, d = len(labels), 1 << WORD_BITS, stats.shape[1]
    mean, scale = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-3)
    dense = np.clip((stats - mean) / scale, -4, 4)
    used, at = np.unique(ids, return_inverse=True)
    owner = np.repeat(np.arange(n), np.diff(np.concatenate([[0], ends])))
    u, k = len(used), len(used) + d
    w0, w = 0.0, np.zeros(k)
    v = np.random.default_rng(seed).normal(0, 0.02, (k, RANK))
    moments = [np.zeros((k, RANK + 1)), np.zeros((k, RANK + 1)), 0.0, 0.0]
    for t in range(1, STEPS + 1):
        sums = np.empty((n, RANK))
        z = w0 + dense @ w[u:] + np.bincount(owner, w[at] * values, n)
        for f in range(RANK):
            word = v[at, f] * values
            sums[:, f] = np.bincount(owner, word, n) + dense @ v[u:, f]
            z += 0.5 * (sums[:, f] ** 2 - np.bincount(owner, word * word, n) - (dense**2) @ (v[u:, f] ** 2))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / n
        grad = np.empty((k, RANK + 1))
        gx, gxx = g[owner] * values, np.bincount(at, g[owner] * values**2, u)
        grad[:u, 0], grad[u:, 0] = np.bincount(at, gx, u), dense.T @ g
        for f in range(RANK):
            grad[:u, f + 1] = np.bincount(at, gx * sums[owner, f], u) - v[:u, f] * gxx
            grad[u:, f + 1] = dense.T @ (g * sums[:, f]) - v[u:, f] * ((dense**2).T @ g)
        grad += DECAY * np.column_stack([w, v])
        m1, m2, a1, a2 = moments
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        a1, a2 = 0.9 * a1 + 0.1 * g.sum(), 0.999 * a2 + 0.001 * g.sum() ** 2
        moments = [m1, m2, a1, a2]
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        step = RATE * (m1 / c1) / (np.sqrt(m2 / c2) + 1e-8)
        w, v = w - step[:, 0], v - step[:, 1:]
        w0 -= RATE * (a1 / c1) / (np.sqrt(a2 / c2) + 1e-8)
    all_w, all_v = np.zeros(base + d), np.zeros((base + d, RANK))
    rows = np.concatenate([used, base + np.arange(d)]).astype(np.int64)
    all_w[rows], all_v[rows] = w, v
    return Model(float(w0), all_w, all_v, mean, scale)


def train(docs: DataFrame, labels: DataFrame, learn) -> Model:
    """Learn from the labelled rows that ``learn`` (a Column over doc_id) admits: MAX_PER_CLASS of each on average.

    The intercept is then moved from the sample's share of label 1 to that of all these labels.
    """
    flags = labels.groupBy("doc_id").agg(F.min("quality").alias("__quality")).filter(learn(F.col("doc_id")) & F.col("__quality").isin(0, 1))
    sizes = {r["__quality"]: r["count"] for r in flags.groupBy("__quality").count().collect()}
    d, base = len(STATISTICS), 1 << WORD_BITS
    empty = Model(0.0, np.zeros(base + d), np.zeros((base + d, RANK)), np.zeros(d), np.ones(d))
    if len(sizes) < 2:
        empty.w0 = {(): 0.0, (0,): -5.0, (1,): 5.0}[tuple(sizes)]
        return empty
    share = F.when(F.col("__quality") == 1, int(min(1, MAX_PER_CLASS / sizes[1]) * (1 << 30))).otherwise(int(min(1, MAX_PER_CLASS / sizes[0]) * (1 << 30)))
    # 2 * MAX_PER_CLASS ids on average: small enough to send to every executor.
    chosen = flags.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < share)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, values, ends, stats = features(batch.column("text"))
            starts = pa.array([0, *ends.tolist()], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.string()), batch.column("__quality").cast(pa.int32()), pa.ListArray.from_arrays(starts, pa.array(ids.astype(np.int32))),
                 pa.ListArray.from_arrays(starts, pa.array(values)), pa.array(stats.tolist(), pa.list_(pa.float64()))],
                ["id", "quality", "ids", "x", "stats"],
            )

    rows = sample.mapInArrow(measure, "id string, quality int, ids array<int>, x array<double>, stats array<double>").toArrow()
    if not len(rows):
        return empty
    rows = rows.sort_by("id").combine_chunks()
    ids, values = rows["ids"].combine_chunks(), rows["x"].combine_chunks()
    ends = np.cumsum(pc.list_value_length(ids).to_numpy())
    y = rows["quality"].to_numpy().astype(float)
    if y.min() == y.max():
        empty.w0 = 5.0 if y[0] else -5.0
        return empty
    model = fit(ids.flatten().to_numpy().astype(np.int64), values.flatten().to_numpy(), ends, np.array(rows["stats"].to_pylist()), y)
    model.w0 += np.log(sizes[1] / sizes[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the score of every text. A null or empty text has no words; its statistics are those of ""."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, limit=TEXT_BYTES):
            z = model.logits(*features(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))], ["doc_id", "score"])

    schema = docs.select("doc_id").schema.add("score", "double")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from 0.7 on) of every document.

    Nothing is learned from rows whose crc32(doc_id) mod 4 is 2. If an id has several labels, the lowest counts.
    Repeated rows get equal scores; a null doc_id is not held out. With labels of one class only, all scores are near
    that class; with none they are 0.5. Empty tables give no rows. Other columns play no part.
    """
    model = train(docs, labels, lambda c: ~held_out(c, 4, 2))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )
