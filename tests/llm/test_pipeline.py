"""Every stage of the corpus pipeline against a plain version on its own input."""

import random
import zlib

import pytest
from test_near_duplicates import brute_components

import corpus_pipeline
from hitloom.llm import language_id, packing, quality_rules
from hitloom.llm.common import held_out

ENGLISH = "the river bends past a mill where millers once ground corn and rye for every farm along its quiet green banks".split()
FRENCH = "le fleuve tourne devant un moulin où les meuniers ont jadis moulu le blé de chaque ferme près des rives vertes".split()


def prose(seed: int, words, n: int) -> str:
    rng = random.Random(seed)
    return "\n".join(" ".join(rng.choice(words) for _ in range(12)) + f" {rng.choice(words)}{rng.randrange(999)}." for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = [(i, prose(i, ENGLISH, 8), "en") for i in range(40)] + [(100 + i, prose(i + 50, FRENCH, 8), "fr") for i in range(40)]
    rows += [(200 + i, rows[i][1], "en") for i in range(10)] + [(300 + i, rows[i][1] + " One more sentence ends this text.", None) for i in range(5)]
    rows += [(400, None, "en"), (401, "", "en"), (402, "too short", "en"), (403, "Home | News | Sport | About | Contact\n" + prose(7, ENGLISH, 9), "en"), (404, "1 2 3\n" * 60, None),
             (None, prose(90, ENGLISH, 8), "en"), (None, prose(91, ENGLISH, 8), "en"), (1, prose(92, ENGLISH, 8), "en"), (405, prose(93, ENGLISH, 400), "en")]
    path = str(tmp_path_factory.mktemp("pipeline"))
    df = spark.createDataFrame([(i, t, lang, "s", len(t or ""), k) for k, (i, t, lang) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, __kept int")
    df.write.parquet(f"{path}/documents.parquet")
    return path


def keyed(df):
    return sorted(((str(r.doc_id), r.text) for r in df.collect()), key=str)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {name: stage for name, stage in corpus_pipeline.STAGES}
    assert list(kept) == ["quality rules", "language identification", "n-gram Jaccard join", "best-fit packing"]

    clean = kept["quality rules"](spark, docs, folder)
    assert clean.columns == docs.columns
    verdicts = {r.doc_id: r.kept for r in quality_rules.report(docs.where("doc_id is not null and doc_id <> 1")).collect()}
    ids = {r.doc_id for r in clean.select("doc_id").collect()} - {None, 1}
    assert ids == {i for i, ok in verdicts.items() if ok} and not ids & {400, 401, 402} and len(ids) >= 90
    assert all(r.n_chars == len(r.text) and "Sport" not in r.text for r in clean.collect())
    clean = spark.createDataFrame(clean.collect(), clean.schema)

    spoken = kept["language identification"](spark, clean, folder)
    model = language_id.train(clean, lambda c: ~held_out(c, 4, 2))
    sure = language_id.predict(clean.where("doc_id is not null and doc_id <> 1"), model).where("lang_pred <> 'und' and score >= 0.5")
    assert {r.doc_id for r in spoken.collect()} - {None, 1} == {r.doc_id for r in sure.collect()}
    assert spoken.columns == docs.columns and 404 not in {r.doc_id for r in spoken.collect()}
    spoken = spark.createDataFrame(spoken.collect(), spoken.schema)

    unique = kept["n-gram Jaccard join"](spark, spoken, folder)
    texts = dict(enumerate(r.text for r in spoken.collect()))
    groups = brute_components({i: t.lower() for i, t in texts.items()})
    assert unique.columns == docs.columns
    found = [groups[next(i for i, t in texts.items() if t == r.text)] for r in unique.collect()]
    assert sorted(found) == sorted(set(groups.values()))
    unique = spark.createDataFrame(unique.collect(), unique.schema)

    packed = kept["best-fit packing"](spark, unique, folder).collect()
    encode = packing_ids()
    want = sorted((str(r.doc_id), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)), len(part), k) for r in unique.collect()
                  for k, part in enumerate(pieces(encode(r.text) + [0])))
    assert sorted((str(r.doc_id), r.ids_crc32, r.length, r.piece) for r in packed) == want
    held = {}
    for r in packed:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
    total = sum(r.length for r in packed)
    assert len(held) <= 1.2 * -(-total // 2048) + 1


def pieces(ids, size=2048):
    return [ids[a : a + size] for a in range(0, len(ids), size)]


def packing_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def test_run_is_the_stages_one_after_the_other(spark, folder, tmp_path):
    rows = corpus_pipeline.run(spark, folder)
    assert rows.count() >= 75 and set(packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).columns) == set(rows.columns)
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
