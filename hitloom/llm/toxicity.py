"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples are the positives; all other learning text is unlabelled, whatever its label. Each classifier
is linear over hashed words and word beginnings and minimises the non-negative risk
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` with the logistic loss, in numpy. The members of the ensemble
train side by side as Spark tasks on a bounded sample; scoring is one narrow pass.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitloom.llm.common import Words, held_out, slices, stored

BITS = 18
MEMBERS = 3
#: Bounds of the training sample: documents that are confirmed toxic, and unlabelled ones.
MAX_POSITIVE = 2500
MAX_UNLABELLED = 7500
STEPS, RATE, DECAY = 150, 0.05, 1e-4
#: A feature has a weight if it is in so many positives of the sample and in this share of them (else copies of one
#: text would make its words features), and PURITY / prior times as common among them as in unlabelled text. (A word
#: of toxic text alone is 1 / prior times as common.)
MIN_POSITIVES, MIN_SHARE, PURITY = 3, 0.01, 0.75
TEXT_BYTES = 16 << 20
_EDGE = string.punctuation + "“”‘’«»…–—¡¿"


def word_features(word: str) -> tuple[int, ...]:
    """Hashes of a lower-cased word without signs at its edges, and of its first four to seven letters."""
    core = word.lower().strip(_EDGE)
    if not core:
        return ()
    mask = (1 << BITS) - 1
    parts = [core] + [f"{core[:n]}*" for n in (4, 5, 6, 7) if len(core) > n]
    return tuple(zlib.crc32(p.encode("utf-8", "surrogatepass")) & mask for p in parts)


def document_features(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct features of every text."""
    words = Words(texts)
    of_word = [word_features(w) for w in words.distinct]
    flat = [np.unique(words.codes[a:b]) for a, b in zip(words.offsets[:-1], words.offsets[1:])]
    return [np.array(sorted({f for c in codes.tolist() for f in of_word[c]}), np.int32) for codes in flat]


@dataclass
class Model:
    """Dense weights of all hashed features (1 MB) and the intercept; without training data the prior alone."""

    weights: np.ndarray
    intercept: float


def _risk_gradients(z_p: np.ndarray, z_u: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the non-negative risk by the scores of positives and unlabelled.

    Where the corrected negative risk is below zero, the step goes up that part instead, as the method prescribes.
    """
    p, u = 1 / (1 + np.exp(-z_p)), 1 / (1 + np.exp(-z_u))
    negative = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
    g_plus, g_minus = prior * (p - 1) / len(z_p), -prior * p / len(z_p)
    if negative >= 0:
        return g_plus + g_minus, u / len(z_u)
    return -g_minus, -u / len(z_u)


def train_member(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Feature ids, their weights and the intercept of one classifier (Adam on the whole sample)."""
    in_p, in_u = (np.bincount(np.concatenate([*rows, np.zeros(0, np.int32)]), minlength=1 << BITS) for rows in (positive, unlabelled))
    used = np.flatnonzero((in_p >= max(MIN_POSITIVES, MIN_SHARE * len(positive))) & (in_p / len(positive) >= PURITY / prior * in_u / len(unlabelled)))
    place = np.full(1 << BITS, -1, np.int64)
    place[used] = np.arange(len(used))

    def matrix(rows):
        at = [place[r] for r in rows]
        at = [a[a >= 0] for a in at]
        return np.concatenate([*at, np.zeros(0, np.int64)]), np.repeat(np.arange(len(at)), [len(a) for a in at])

    (ip, rp), (iu, ru) = matrix(positive), matrix(unlabelled)
    n_p, n_u, n = len(positive), len(unlabelled), len(used)
    w, b = np.zeros(n), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, STEPS + 1):
        z_p, z_u = (np.bincount(r, w[i], k) + b for i, r, k in ((ip, rp, n_p), (iu, ru, n_u)))
        g_p, g_u = _risk_gradients(z_p, z_u, prior)
        g = np.bincount(ip, g_p[rp], n) + np.bincount(iu, g_u[ru], n) + DECAY * w / n_p
        g = np.append(g, g_p.sum() + g_u.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return used, w, float(b)


def train(docs: DataFrame, labels: DataFrame, learn) -> Model:
    """Learn from the rows that ``learn`` (a Column over doc_id) admits; ``labels`` holds doc_id and toxic."""
    flags = labels.groupBy("doc_id").agg(F.max("toxic").alias("__toxic")).filter(learn(F.col("doc_id")))
    n_pos, n_lab = flags.agg(F.sum((F.col("__toxic") == 1).cast("long")), F.count("__toxic")).first()
    n_docs = docs.filter(learn(F.col("doc_id"))).count()
    if not n_pos or not n_docs or n_pos == n_lab:
        share = min(max((n_pos or 0) / n_lab, 1e-3), 1 - 1e-3) if n_lab else 1e-3
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))))
    prior = n_pos / n_lab

    def chosen(salt: int, bound: int, total: int):
        share = min(1.0, bound / total)
        return F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30)) < int(share * (1 << 30))

    admitted = docs.select("doc_id", "text").filter(learn(F.col("doc_id")))
    # At most MAX_POSITIVE ids on average: small enough to send to every executor.
    ids = flags.filter((F.col("__toxic") == 1) & chosen(1, MAX_POSITIVE, n_pos)).select("doc_id")
    positive = admitted.join(F.broadcast(ids), "doc_id", "left_semi").withColumn("__positive", F.lit(True))
    unlabelled = admitted.filter(chosen(2, MAX_UNLABELLED, n_docs)).withColumn("__positive", F.lit(False))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = document_features(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.string()), batch.column("__positive"), pa.array(rows, pa.list_(pa.int32()))], ["id", "positive", "features"]
            )

    def member(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "positive"], kind="stable")
        draw = np.random.default_rng(int(key[0])).integers(0, len(rows), len(rows))
        rows = rows.iloc[np.sort(draw)]
        lists = rows["features"].map(lambda x: np.asarray(x, np.int32)).tolist()
        is_p = rows["positive"].to_numpy()
        pos, unl = ([x for x, p in zip(lists, is_p) if p == want] for want in (True, False))
        pos = list({x.tobytes(): x for x in pos}.values())  # copies count once
        used, w, b = train_member(pos, unl, prior) if pos and unl else (np.zeros(0, np.int64), np.zeros(0), np.log(prior / (1 - prior)))
        return pd.DataFrame({"used": [used.tolist()], "weight": [w.tolist()], "intercept": [float(b)]})

    sample = positive.unionByName(unlabelled).mapInArrow(features, "id string, positive boolean, features array<int>")
    sample = stored(sample, "toxicity-sample")
    copies = sample.withColumn("member", F.explode(F.array(*[F.lit(i) for i in range(MEMBERS)])))
    found = copies.groupBy("member").applyInPandas(member, "used array<long>, weight array<double>, intercept double").collect()
    weights = np.zeros(1 << BITS)
    for r in found:
        weights[np.array(r["used"], np.int64)] += np.array(r["weight"]) / len(found)
    return Model(weights.astype(np.float32), float(np.mean([r["intercept"] for r in found])))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the score of every text, one narrow pass. A null or empty text gets what the intercept says."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercept = shared.value.weights, shared.value.intercept
        for batch in slices(batches, limit=TEXT_BYTES):
            words = Words(batch.column("text"))
            of_word = [word_features(w) for w in words.distinct]
            # Only features with a weight count; each once for a document.
            flat = np.fromiter((f for fs in of_word for f in fs), np.int64)
            owner = np.repeat(np.arange(len(of_word)), [len(fs) for fs in of_word])
            heavy = weights[flat] != 0
            flat, owner = flat[heavy], owner[heavy]
            first = np.searchsorted(owner, np.arange(len(of_word) + 1))
            sizes = np.diff(first)
            doc = np.repeat(np.arange(len(words)), words.counts())
            some = sizes[words.codes] > 0
            pairs = np.unique(doc[some] * len(of_word) + words.codes[some]) if some.any() else np.zeros(0, np.int64)
            doc, code = pairs // max(1, len(of_word)), pairs % max(1, len(of_word))
            n = sizes[code]
            at = np.repeat(first[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            pairs = np.unique(np.repeat(doc, n) * (1 << BITS) + flat[at])
            z = np.bincount(pairs >> BITS, weights[pairs & ((1 << BITS) - 1)], len(words)) + intercept
            result = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(result)], ["doc_id", "score"])

    schema = docs.select("doc_id").schema.add("score", "double")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Nothing is learned from rows whose crc32(doc_id) mod 5 is 0. Null and empty texts get the score of a text
    without words; repeated rows equal scores; a null doc_id is not held out. Repeated labels of an id count as toxic
    if one is. Without a toxic example or a document every score is the share of toxic labels. Empty tables give no
    rows. Other columns play no part.
    """
    model = train(docs, labels, lambda c: ~held_out(c, 5, 0))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
