"""Faults found in round 4: each test failed before."""

import itertools
import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.functions import similarity
from recordloom.functions.similarity import indel_ratio, lcs_length
from recordloom.operators import dedupe as D
from recordloom.operators import pairs as P
from recordloom.plans.catalogue import oracle_sql, queries
from tests.test_oracle import norm


def against_sql(spark, path, rows, name):
    """Documents (doc_id, text, lang, source) written to a folder: the query's rows there are those of its SQL."""
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{path}/documents.parquet/*.parquet'")
    df = queries()[name](spark, path)
    cols = sorted(df.columns)
    want = duck.sql(oracle_sql()[name])
    at = [want.columns.index(x) for x in cols]
    got = sorted((tuple(norm(r[x]) for x in cols) for r in df.collect()), key=repr)
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=repr)
    return got


def test_csv_keeps_empty_texts_and_nul(spark, tmp_path):
    """an empty title isn't null, and a NUL beside a quote stays."""
    heads = ["", None, '""', "null", " ", "a\r", "\\", *("".join(x) for x in itertools.product('"\0,\\\r a', repeat=3))]
    rows = [(60 * i + k, None if h is None else f"{h}\nbody", "en", "src1") for i, h in enumerate(heads) for k in (1, 19)]
    got = against_sql(spark, str(tmp_path / "csv"), rows, "S13_csv_round_trip")
    assert len(got) == len(rows)


def test_long_texts_are_squashed_once(spark, tmp_path):
    """documents of one line of 12,000 words; a search that squashes the text again for each word takes many minutes."""
    words = [f"wörd{i}" for i in range(12_000)]
    texts = [" ".join(words), " ".join(words) + " - - Ünd", "\n".join(["wörd1 absent"] + words), "\n".join(["wörd1 " * 9 + "absent"] + words), "... ---\nrest", "- Smith -\nsmith o'neil kim ng"]
    rows = [(60 * i + k, t, "en", "src1") for i, t in enumerate(texts) for k in (1, 7, 29, 30)]
    began = time.monotonic()
    got = against_sql(spark, str(tmp_path / "long"), rows, "Q26_text_defects")
    assert len(got) > 5 and time.monotonic() - began < 100


def _odd_texts(rng, n):
    some = lambda: "".join(rng.choice("abcde ß😀" if rng.random() < 0.95 else "qz") for _ in range(rng.choice((0, 1, 62, 63, 64, 126, 127, rng.randint(0, 300)))))
    return list(dict.fromkeys([some() for _ in range(n)] + ["x" * 100 + "y" * 63, "y" + "x" * 100, "z" * 63, "z" * 126 + "a" * 63, "ab" * 200, "".join(chr(19968 + i) for i in range(500))]))


@pytest.mark.parametrize(("words", "masks", "cost"), [(1, 1 << 22, 0), (20_000, 40, 0), (2000, 1 << 22, 0), (1 << 40, 1 << 22, 0), (2000, 1 << 22, 7)])
def test_texts_step_through_rows_of_others(monkeypatch, words, masks, cost):
    """F2-F5, F8: all of a text's partners step as one row; lengths are those of single pairs, and no pair's ratio exceeds its bounds."""
    monkeypatch.setattr(similarity, "ROW_WORDS", words)
    monkeypatch.setattr(similarity, "ROW_MASKS", masks)
    monkeypatch.setattr(similarity, "ROW_NS", cost)
    monkeypatch.setattr(similarity, "STEP_NS", cost)
    rng = random.Random(5)
    texts = _odd_texts(rng, 60)
    pairs = [(i, j) for i in range(len(texts)) for j in range(len(texts))]
    rng.shuffle(pairs)
    x, y = (np.array(v) for v in zip(*pairs))
    assert similarity.lcs_of_pairs(texts, x, y).tolist() == [lcs_length(texts[i], texts[j]) for i, j in pairs]
    bounds = similarity.Bounds(texts, own=3)
    ratio = np.array([indel_ratio(texts[i], texts[j]) for i, j in pairs])
    assert (bounds.by_characters(x, y) >= ratio - 1e-9).all() and (bounds.by_length(x, y) >= bounds.by_characters(x, y) - 1e-9).all()


def _issue(spark, n=130):
    """Records of which most stand in one issue, with copies, near copies and one ID twice."""
    rng = random.Random(8)
    base = _odd_texts(rng, 12)
    titles = [rng.choice(base) if i % 3 else (t := rng.choice(base))[: len(t) // 2] + rng.choice(("", "q", "new")) + t[len(t) // 2 + rng.randint(0, 2) :] for i in range(n)]
    rows = [(f"R{max(i, 1):03d}", "article", None if i == 5 else t, rng.choice(("Lee, K.", "Lee, K. and Ng, W.", "Garcia, José", "")), "Journal", None, "1", "1" if i % 5 else "2", "2001", f"10.1/{min(i % 9, 3)}") for i, t in enumerate(titles)]
    return spark.createDataFrame(rows, "ID string, ENTRYTYPE string, title string, author string, journal string, booktitle string, volume string, number string, year string, doi string")


@pytest.mark.parametrize("tile", [7, 1000])
def test_issues_are_compared_in_blocks(spark, tile):
    """F2, F3, F8: pairs, ranks and alike titles of issues met in blocks are those of all pairs, ties and copies included."""
    r = _issue(spark)
    rows = [x for x in r.collect() if x.title is not None]
    known = [(x.ID, x.number, x.title.lower(), x.author.lower()) for x in rows]
    sims, alike = {}, []
    for a, b in itertools.permutations(known, 2):
        if a[0] != b[0] and a[1] == b[1]:
            sims.setdefault(a[0], []).append((-round(0.4 * indel_ratio(a[3], b[3]) + 0.6 * indel_ratio(a[2], b[2]), 4), b[0]))
            if a[0] < b[0] and round(indel_ratio(a[2], b[2]), 4) > 95:
                alike.append((a[0], b[0], round(indel_ratio(a[2], b[2]), 4)))
    assert sorted(tuple(x) for x in P.issue_pairs(r, tile=tile).collect()) == sorted((a, b, -s) for a, of in sims.items() for s, b in of if a < b and s <= -70)
    assert sorted(tuple(x) for x in P.alike_titles(r, tile=tile).collect()) == sorted(alike)
    want = [(a, b, -s, i + 1, -s > 80) for a, of in sims.items() for i, (s, b) in enumerate(sorted(of)[:5])]
    assert sorted(tuple(x) for x in P.ranked_candidates(r, top=5, tile=tile).collect()) == sorted(want)


@pytest.mark.parametrize("tile", [7, 1000])
def test_records_of_a_key_are_compared_in_blocks(spark, tile):
    """similarities and labels of blocks are those of pairs as rows; no row holds a pair's texts."""
    r = _issue(spark).withColumn("ENTRYTYPE", F.expr("element_at(array('article', 'book', 'inbook', 'proceedings'), cast(substr(ID, 2) as int) % 4 + 1)"))
    r = r.withColumns({"title": F.expr("case when ID like '%8' then 'Editorial' else title end"), "journal": F.expr("case when ID like '%3' then null else journal end")})
    c = D.comparable(r)
    pairs = D.pairs_on(c, {"doi": F.col("doi")}, ["ID", "ENTRYTYPE", *(x for x in c.columns if x.startswith("s_"))])
    rows = lambda df, *cols: sorted(tuple(x) for x in df.select("a_ID", "b_ID", *cols).collect())
    got = D.keyed_similarity(r, F.col("doi"), tile=tile)
    assert rows(got, "similarity") == rows(D.pair_similarity(pairs), "similarity")
    assert rows(D.keyed_labels(r, F.col("doi"), tile=tile), "label") == rows(D.pair_labels(pairs), "label")
    assert "a_s_title" not in got._jdf.queryExecution().analyzed().toString()
