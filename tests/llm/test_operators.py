"""The operators against brute-force versions on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import re
import zlib

import pytest

from hitloom.llm import fingerprints, jaccard_join, quality_rules, queries, sharding

WORDS = "the river bends past a mill where millers once ground corn and rye for every farm along its quiet green banks".split()


def sentence(seed: int, n: int) -> str:
    return " ".join(f"{WORDS[(seed * 7 + i * i) % len(WORDS)]}{(seed + i) % 13}" for i in range(n))


BASE = sentence(1, 120)
TEXTS = {
    1: BASE + ".", 2: BASE + ".", 3: BASE.upper() + ".", 4: BASE + " end.", 5: sentence(2, 90), 6: None, 7: "", 8: " \t\n", 9: "one two",
    10: "one two", 11: "ONE  TWO", 12: "Home | News | Sport | About | Contact\n" + sentence(5, 60) + ".", 13: sentence(3, 20000), 14: "é" * 31,
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1) for i, t in TEXTS.items()] + [(5, TEXTS[5], "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, n string, key long")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_jaccard_join_finds_every_link(docs):
    sets = {i: shingles(t) for i, t in TEXTS.items()}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                common = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                    root[a] = root[b] = min(root[a], root[b])
    got = jaccard_join.join(docs).collect()
    assert len(got) == len(TEXTS) + 1
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), root[i]) for i in sets}
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in root if root[i] == i)


def test_base_measures_of_quality_rules(docs):
    for r in quality_rules.report(docs).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", TEXTS[r.doc_id] or "")
        seen = {}
        for i in range(len(words) - 7):
            seen.setdefault(tuple(words[i : i + 8]), []).append(i)
        repeated = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(repeated))
        assert r.base_failed == (len(words) < 20 or 100 * len(repeated) > 30 * len(words))
        assert not (r.base_failed and r.kept)


def test_quality_filter_removes_failing_lines(docs):
    kept = {r.doc_id: r.text for r in quality_rules.filter_documents(docs).collect()}
    assert 12 in kept and "Sport" not in kept[12] and not {6, 7, 8, 9} & set(kept)


def test_fingerprints_and_edited_texts(docs):
    unique = docs.dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in fingerprints.compare_neighbours(unique).collect()}
    ids = sorted(TEXTS, reverse=True)
    for k, i in enumerate(ids):
        text, after = TEXTS[i] or "", TEXTS[ids[(k + 1) % len(ids)]] or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert got[1].fingerprint == got[2].fingerprint and got[2].near_next == 1.0
    assert got[7].fingerprint == ""
    assert fingerprints.compare_neighbours(docs).count() == len(TEXTS) + 1


def test_winnowing_keeps_one_position_of_every_window(docs):
    rows = fingerprints.fingerprints(docs).filter("doc_id = 13").first().marks
    at = [m.position for m in rows]
    n_hashes = len(re.findall(r"[^\x20\x09-\x0D]{1,6}", TEXTS[13])) - fingerprints.K + 1
    assert at == sorted(at) and at[0] < fingerprints.WINDOW and at[-1] >= n_hashes - fingerprints.WINDOW
    assert all(0 < b - a <= fingerprints.WINDOW for a, b in zip(at, at[1:]))
    assert len(at) < 0.4 * n_hashes


def test_shards(docs):
    got = sharding.shard(docs).collect()
    slots = {}
    for r in got:
        text = (TEXTS[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(text) + 1, zlib.crc32(text))
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(got) == len(TEXTS) + 1


@pytest.mark.parametrize("name", ["op3_quality_rules", "op4_best_fit_packing", "op7_sharding", "op8_fingerprints", "op10_jaccard_join"])
def test_empty_table(spark, docs, tmp_path, name):
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    found = [f for f in queries.queries() if f.startswith(name)]
    assert queries.queries()[found[0]](spark, str(tmp_path)).count() == 0


def test_packing_is_gapless_and_full(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()["op4_best_fit_packing"](spark, str(tmp_path)).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(by) <= 1.25 * -(-total // 2048) + 1
