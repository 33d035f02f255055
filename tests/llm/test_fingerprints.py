"""Winnowed fingerprints and both likenesses against a plain version."""

import hashlib
import re

import xxhash

from hitloom.llm import fingerprints as fp


def signed(x: int) -> bytes:
    return x.to_bytes(8, "little")


def marks(text: str) -> list[tuple[int, int]]:
    tokens = [xxhash.xxh64_intdigest(t.encode(), seed=42) for t in re.findall(r"[^\x20\x09-\x0D]{1,%d}" % fp.TOKEN_CHARS, text)]
    grams = []
    for i in range(max(1, len(tokens) - fp.K + 1) if tokens else 0):
        h = 42
        for j in range(fp.K):
            if i + j < len(tokens):
                h = xxhash.xxh64_intdigest(signed(tokens[i + j]), seed=h)
        grams.append(h >> 33)
    kept = []
    for i in range(max(1, len(grams) - fp.WINDOW + 1) if grams else 0):
        window = grams[i : i + fp.WINDOW]
        least = min(window)
        at = i + max(j for j, g in enumerate(window) if g == least)
        if (least, at) not in kept:
            kept.append((least, at))
    return kept


def likeness(a, b):
    x, y = {h for h, _ in a}, {h for h, _ in b}
    return len(x & y) / len(x | y) if x | y else 1.0


def printed(found):
    return " ".join(f"{h:x}:{p}" for h, p in found)


def test_fingerprints_equal_the_plain_version(spark):
    base = "the quick brown fox jumps over the lazy dog while naïve éclairs bake " * 3
    texts = {1: base, 2: base, 3: base.upper(), 4: "", 5: None, 6: "one", 7: "a b", 8: "x" * 100, 9: " \t\n", 10: base + "tail", 11: "same " * 40,
             None: "no id but a text of several words", 12: "ünï " * 25}
    rows = list(texts.items()) + [(3, base + " another text with the id of three"), (10, base + "tail"), (10, base + "tail")]
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, h long, id string, key int")
    got = fp.compare_neighbours(df.repartition(3)).collect()
    # Descending ids, null last; equal ids by the hash of their text.
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), int.from_bytes(xxhash.xxh64_digest(r[1].encode(), seed=42), "big", signed=True)))
    want = []
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        own, changed = marks(text), marks(edited)
        want.append((str(i), len(text), hashlib.sha256(edited.encode()).hexdigest(), printed(own), printed(changed), likeness(own, changed), likeness(own, marks(after))))
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == sorted(want)
