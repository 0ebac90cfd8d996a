"""The pipeline's stages against brute force on a small corpus."""

import random

import corpus_pipeline as P
from tests.llm.test_ops import brute_components, prose


def test_stages(spark, tmp_path):
    rng = random.Random(4)
    base = [prose(rng, rng.randint(60, 120)) for _ in range(30)]
    item = prose(rng, 30)
    passage = prose(rng, 80)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(40 + i, base[i] + " one more") for i in range(5)] + [(50, base[3]), (60, prose(rng, 60) + " " + item + " " + prose(rng, 10))]
    rows += [(70 + i, prose(rng, 100) + " " + passage) for i in range(3)] + [(90, None), (91, ""), (92, "?")]
    docs = spark.createDataFrame([(i, t, "en", "s0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")

    kept, texts = dict(rows), None
    for name, stage in P.STAGES[:-1]:
        docs = P.materialize(stage(spark, docs, sf), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        texts = {r.doc_id: r.text for r in docs.collect()}
        if name == "language_id":
            assert set(kept) - set(texts) == {90, 91, 92}
        elif name == "ngram_join":
            assert set(texts) == {d for d, _, c in brute_components(sorted(kept.items())) if d == c}
        elif name == "suffix_dedup":
            assert sum(passage[10:-10] in t for t in texts.values()) == 1 and set(texts) == set(kept)
            assert all(texts[d] == kept[d] for d in texts if d not in (71, 72))
        elif name == "decontaminate":
            assert set(kept) - set(texts) == {60}
        kept = texts
    packed = P.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == set(kept)
    again = P.run(spark, sf)
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in again.collect()) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in packed)


def test_stages_with_null_and_repeated_ids(spark, tmp_path):
    rng = random.Random(5)
    a, b, item = prose(rng, 80), prose(rng, 80), prose(rng, 30)
    rows = [(1, a), (1, "?"), (2, b), (2, item + " " + prose(rng, 20)), (None, prose(rng, 50)), (None, ""), (None, item), (3, None), (4, prose(rng, 40)), (4, prose(rng, 40))]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", None, 0) for i, t in rows], schema)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = lambda df: sorted((str(r.doc_id), r.text) for r in df.collect())
    told = P.language_id(spark, docs, str(tmp_path))
    assert texts(told) == sorted((str(i), t) for i, t in rows if t not in (None, "", "?"))
    told = P.materialize(told, "told")
    assert texts(P.ngram_join(spark, told, str(tmp_path))) == texts(told)
    assert texts(P.suffix_dedup(spark, told, str(tmp_path))) == [x for x in texts(told)]
    clean = P.decontaminate(spark, told, str(tmp_path))
    assert texts(clean) == [x for x in texts(told) if not x[1].startswith(item)]
    assert {r.doc_id for r in P.pack(spark, clean, str(tmp_path)).collect()} == {1, 2, None, 4}
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
