"""Encoding against a plain best-path search over the whole text, chunked or not, and exact round trips."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import sentencepiece
from pyspark.sql import functions as F

from hitloom.llm import pieces
from hitloom.llm.common import slices

RANDOM = random.Random(5)
TEXTS = [
    None, "", " ", "   two  spaces ", "plain words of a text", "naïve café ▁ literal", "日本語テキスト🙂\n\ttab", "a" * 700,
    "w" * 63 + " " + "wonder" * 11 + "é" * 3 + " 日", "".join(RANDOM.choice("abé日 \t.▁") for _ in range(500)),
    "".join(RANDOM.choice("abcehilnorst ") for _ in range(900)), "x y" * 64, "the end " * 100, "the end " * 100,
]


def vocabulary():
    """Pieces, ids and scores read from the model file by themselves."""
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    table, raw = {}, {}
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            raw[int(model.id_to_piece(i)[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            table[model.id_to_piece(i)] = (i, round(model.get_score(i) * 1_000_000))
    return table, raw


TABLE, BYTES = vocabulary()
UNKNOWN, LONGEST = min(s for _, s in TABLE.values()) - 10_000_000, max(map(len, TABLE))


def best_path(text):
    """The ids by the definition: the largest sum, ties to the longest last piece, over the whole text at once."""
    if not text:
        return []
    seen = "\u2581" + text.replace("\u2581", "\ufdd0").replace(" ", "\u2581")
    best = [(0, 0)] + [None] * len(seen)
    for end in range(1, len(seen) + 1):
        for n in range(min(end, LONGEST), 0, -1):
            hit = TABLE.get(seen[end - n : end])
            score = hit[1] if hit else UNKNOWN if n == 1 else None
            if score is not None and (best[end] is None or best[end - n][0] + score > best[end][0]):
                best[end] = (best[end - n][0] + score, n)
    out, end = [], len(seen)
    while end:
        piece = seen[end - best[end][1] : end]
        out = ([TABLE[piece][0]] if piece in TABLE else [BYTES[b] for b in piece.replace("\ufdd0", "\u2581").encode()]) + out
        end -= best[end][1]
    return out


@pytest.mark.parametrize("chunk", [64, 100, pieces.CHUNK])
def test_ids_do_not_depend_on_chunks(spark, chunk):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, row string")
    out = pieces.decode(pieces.encode(docs, chunk=chunk)).orderBy("doc_id").collect()
    assert [r.ids for r in out] == [best_path(t) for t in TEXTS]
    assert [r.decoded for r in out] == [t or "" for t in TEXTS] and {r.row for r in out} == {"x"}


def test_characters_of_no_piece_in_giant_texts():
    """Their cost is large, and there may be very many of them: scores of chunks must neither overflow nor seem impossible."""
    p = pieces.pieces(pieces.default_model())
    text = pieces.shown("\u4e00\u9fff " * 3_000)
    m = np.stack([p.transfer(text[a : a + 100 + p.longest - 1], 100) for a in range(0, 8_000, 100)])
    many = np.concatenate([m] * 50)  # as of 400 000 characters
    assert (pieces.prefix_products(many)[:, 0, :].max(axis=1) > pieces.NEVER // 4).all()
    best, last = p.forward(text, len(text), [0])
    assert last[len(text)] > 0 and best[len(text)] > pieces.NEVER // 4


def test_digest_and_empty_table(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    rows = pieces.digest(docs).collect()
    assert len(rows) == len(TEXTS) and all(r.round_trip for r in rows)
    assert pieces.digest(docs.filter(F.lit(False))).collect() == []


def test_memory_of_large_batches():
    """What encoding and decoding hold at once does not grow with the words of a batch: a Spark batch has up to 10 000 rows."""
    rows = [" ".join("".join(RANDOM.choice("abcehilnorst") for _ in range(9)) for _ in range(2_000)) for _ in range(100)]
    p = pieces.pieces(pieces.default_model())
    words = sorted({w for t in rows for w in pieces.WORD.findall(pieces.shown(t))})
    tracemalloc.start()
    flat, offsets = p.word_ids(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    for i in range(0, len(words), 20_011):
        assert flat[offsets[i] : offsets[i + 1]].tolist() == p.word(words[i])
    batch = pa.RecordBatch.from_pydict({"ids": p.encode([*rows, None, "a" * 900])})
    parts = list(slices(iter([batch]), "ids", 30_000, pc.list_value_length))
    assert pa.concat_arrays([x.column(0) for x in parts]).equals(batch.column(0)) and len(parts) > 10
    assert [t for x in parts for t in p.decode(x.column(0))] == [*rows, "", "a" * 900]


@pytest.mark.parametrize("limit", [0, 900, pieces.IDS_REMEMBERED])
def test_ids_do_not_depend_on_remembered_words(monkeypatch, limit):
    monkeypatch.setattr(pieces, "IDS_REMEMBERED", limit)
    p = pieces.Pieces(pieces.default_model())
    for texts in (TEXTS[:7], TEXTS, TEXTS[::-1], [None]):
        assert p.encode(texts).to_pylist() == [best_path(t) for t in texts]
    assert len(p._seen_ids) <= limit and (len(p._seen) > 50) == (limit > 900)
