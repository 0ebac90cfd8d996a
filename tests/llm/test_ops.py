"""Operators of recordloom.llm against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from recordloom.llm.decontaminate import find_leaks, leak_report
from recordloom.llm.html_text import extract, extract_main_text
from recordloom.llm.language_id import address_parts, document_rows, fit, fit_documents, fit_sample, identify, markup_language
from recordloom.llm.nearest import nearest
from recordloom.llm.ngram_join import ngram_components
from recordloom.llm.pack import Encoder, pack_tokens, tokenizer_path
from recordloom.llm.phrase_dedup import remove_repeats
from recordloom.llm.shard import histogram_shards
from recordloom.llm.token_counts import PieceCounter, word_piece_counts
from recordloom.llm.warc_zip import read_archives, write_archives, zip_members

# extra columns whose names clash with those that operators make
DOCS = "doc_id long, text string, size int, shard int, n long, component string, block string, kind string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, "c", "b", "k") for i, t in rows], DOCS)


def prose(rng, n):
    return " ".join("".join(rng.choice(["the", "an", "er", "on", "re", "thn", "ou"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(n)]
    passage = prose(rng, 70)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i % 7]) for i in range(12)]  # exact copies
    for i in range(25):  # near copies
        words = base[i % 5 + 20].split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = "edited%d" % rng.randint(0, 99)
        rows.append((200 + i, " ".join(words)))
    rows += [(300 + i, prose(rng, 20) + " " + passage + " " + prose(rng, 5)) for i in range(8)]
    rows += [(400, None), (401, ""), (402, "  \n "), (403, "one two"), (404, "ONE  two"), (405, "ab " * 400), (406, "é" * 300), (407, "long " + prose(rng, 4000)), (300, None)]
    return rows


def brute_components(rows, words=5):
    up = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    sets, out = [], []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(up))
        sets.append((d, frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    least = defaultdict(lambda: 1 << 60)
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least[find(i)], d)
    return sorted((d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets))


@pytest.mark.parametrize(("block_sets", "seen_sets"), [(4000, 500_000), (3, 2)])
def test_ngram_components(spark, block_sets, seen_sets):
    rows = corpus()
    got = ngram_components(docs(spark, rows).repartition(3), block_sets=block_sets, block_tokens=500, seen_sets=seen_sets).collect()
    assert sorted(map(tuple, got)) == brute_components(rows)


def test_long_text_shingles(monkeypatch):
    """A long text's shingles, words put together from pieces, are those of the whole."""
    import recordloom.llm.ngram_join as N

    rng = random.Random(5)
    for text in (prose(rng, 300), "  \n" + prose(rng, 40).upper() + " ", "x" * 3000 + " a b c d e", "one two", "", "  ", "w" * 700, "a b c d e " * 50):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        want = N.shingles(data, np.array([0, len(data)]), 5)[1]
        for piece in (1 << 20, 97):
            monkeypatch.setattr(N, "PIECE", piece)
            assert N.long_text_shingles(data, 5).tolist() == want.tolist()


def test_ngram_components_empty_and_null_ids(spark):
    assert ngram_components(docs(spark, [])).count() == 0
    assert ngram_components(docs(spark, [(None, "a b c d e f"), (1, None)])).collect() == [(1, 0, 1)]


def text_order(t):
    """The operator's order of rows of one doc_id."""
    h = xxhash.xxh64((t or "").encode(), seed=42).intdigest()
    return h - (1 << 64) if h >> 63 else h


def brute_repeats(rows, length=100):
    """By row (doc_id, text); rows alike in both are one document."""
    seen, out = {}, {}
    for d, t in sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0], text_order(r[1]))):
        b = t.encode()
        cut = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                cut[i : i + length] = b"\1" * length
            else:
                seen[w] = 1
        kept = bytes(x for x, y in zip(b, cut) if not y)
        spans = sum(1 for i in range(len(b)) if cut[i] and (i == 0 or not cut[i - 1]))
        out[d, t] = (sum(cut), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore"))
    return out


@pytest.mark.parametrize(("hot", "hold"), [(2000, 1_000_000), (1, 50), (3, 7)])
def test_remove_repeats(spark, hot, hold):
    rng = random.Random(12)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = corpus(2) + [(901, a), (905, "zz" + a), (905, b), (905, b), (906, b[3:] + a[:150]), (907, "ab" * 400), (908, "ab" * 90), (909, "\u00e9" * 130)]
    want = brute_repeats(rows)
    got = remove_repeats(docs(spark, rows).repartition(3), hot_phrases=hot, hold=hold).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.kept_text) for r in got) == sorted((d, len((t or "").encode()), *want[d, t or ""]) for d, t in rows)
    assert all(len(r.spans) == r.n_spans and sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)
    assert {r.n_removed for r in got if r.kept_text == b} == {0}
    assert remove_repeats(docs(spark, [])).count() == 0


def test_suffix_order():
    import recordloom.llm.phrase_dedup as P

    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 900).astype(np.uint8)
    data[400:700] = data[100:400]
    start = np.arange(0, len(data) - 100)
    order, new = P.suffix_order(data, start, 100)
    strings = [data[i : i + 100].tobytes() for i in start]
    assert order.tolist() == sorted(range(len(start)), key=lambda i: (strings[i], i))
    assert new.tolist() == [k == 0 or strings[order[k]] != strings[order[k - 1]] for k in range(len(order))]


def test_remove_repeats_segments(spark, monkeypatch):
    """A text longer than a segment is parsed piecewise with the same result."""
    import recordloom.llm.phrase_dedup as P

    rng = random.Random(5)
    a = prose(rng, 400)
    rows = [(1, a + " x " + a), (2, a)]
    data = np.frombuffer(rows[0][1].encode(), dtype=np.uint8)
    whole = P.parse(data, np.array([0, len(data)]), 100, 24)
    assert int(whole[4].sum()) == len(data) - 99
    want = {d: v[0] for (d, _), v in brute_repeats(rows).items()}
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "ver": [7, 8], "text": ["short", a]})
    for segment in (1 << 20, 500):
        monkeypatch.setattr(P, "SEGMENT", segment)
        blobs = [r for b in P._parse_texts(100, 24, 1, 1, 10**9)(iter([batch])) for r in b.to_pylist()]
        phrases = [P.K.unpack(r["blob"], *P.PHRASE) for r in blobs if r["kind"] == P.PHRASES]
        strings = sorted((d, lo + k) for _, _, doc, _, start, count, _ in phrases for d, lo, n in zip(doc.tolist(), start.tolist(), count.tolist()) for k in range(n))
        assert strings == [(2, k) for k in range(len(a) - 99)]
    assert {r.doc_id: r.n_removed for r in remove_repeats(docs(spark, rows)).collect()} == want


def edit_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_find_leaks(spark):
    rng = random.Random(3)
    items = [(i, prose(rng, 25)) for i in range(6)] + [(7, "short"), (8, None), (9, "")]
    rows = []
    for d in range(40):
        text = list(items[d % 6][1])
        for _ in range(d // 4):
            p = rng.randrange(len(text))
            op = rng.random()
            if op < 0.4:
                text[p] = "x"
            elif op < 0.7:
                del text[p]
            else:
                text.insert(p, "y")
        rows.append((d, prose(rng, 30) + "\n" + "".join(text).upper() + " " + prose(rng, 30)))
    rows += [(100, None), (101, ""), (102, prose(rng, 200))]
    got = {(r.doc_id, r.item_id): r.edits for r in leak_report(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    budget = {i: len(x.encode()) // 10 for i, x in items if x}
    want = {}
    for d, t in rows:
        for i, x in items:
            if i in budget:
                e = edit_distance(x.lower().replace("\n", " "), (t or "").lower().replace("\n", " "))
                if e <= budget[i]:
                    want[d, i] = e
    assert got == want and len(want) > 10
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(docs(spark, rows), none).count() == 0
    assert find_leaks(docs(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_find_leaks_in_blocks(spark):
    rng = random.Random(4)
    items = [(i, prose(rng, 25)) for i in range(12)]
    rows = [(i, "a " + x + " b") for i, x in items]
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, find_leaks(docs(spark, rows), bench).collect()))
    assert sorted(map(tuple, find_leaks(docs(spark, rows), bench, block_bytes=500).collect())) == one and len(one) == 12


def scan(items, rows, rate=0.1):
    import recordloom.llm.decontaminate as D

    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([d for d, _ in rows], pa.int64()), "text": [t for _, t in rows]})
    return [tuple(r.values()) for b in D._scan(items, rate)(iter([batch])) for r in b.to_pylist()]


def test_find_leaks_in_windows_and_slices(monkeypatch):
    """Long texts are looked up in windows and hits counted in slices, with the same places."""
    import recordloom.llm.decontaminate as D

    rng = random.Random(6)
    items = [(i, prose(rng, 25)) for i in range(4)] + [(9, "ab" * 150)]
    rows = [(1, " ".join(prose(rng, 15) + " " + items[i % 4][1][: -1 - i % 3] + "x" for i in range(12))), (2, "ab" * 400), (2, "z" + "ab" * 160), (3, None), (4, items[1][1]), (4, items[1][1]), (5, "a" * 3000)]
    whole = scan(items, rows)
    assert {r[:2] for r in whole} == {(1, i) for i in range(4)} | {(2, 9), (4, 1)} and sum(r[0] == 4 for r in whole) == 2
    monkeypatch.setattr(D, "BLOCK", 700)
    monkeypatch.setattr(D, "HITS", 50)
    monkeypatch.setattr(D, "LOOK", 33)
    assert scan(items, rows) == whole


def test_find_leaks_far_into_a_text():
    """Items at both ends of 20 MB and about byte 8 Mi, many of them and one alone."""
    rng = random.Random(12)
    items = [(i, prose(rng, 25)) for i in range(5)]
    text = bytearray(b"\n" * 20_000_000)
    at = {0: 0, 1: 8_388_607, 2: 8_388_608 + 1000, 3: 8_388_609 + 5000, 4: len(text) - len(items[4][1].encode())}
    for i, x in items:
        raw = x.encode().replace(b" ", b"_", 1)
        text[at[i] : at[i] + len(raw)] = raw
    rows = [(7, text.decode())]
    want = [(7, i, at[i], at[i] + len(x.encode()), 1) for i, x in items]
    assert sorted(scan(items, rows)) == want
    assert scan(items[3:4], rows) == want[3:4]


def test_find_leaks_of_short_items():
    """Items of one to forty bytes, whole and with their budget of edits."""
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    for m in [*range(1, 42), 60]:
        item = "".join(rng.choice(letters) for _ in range(m))
        k = m // 10
        wrong, over = list(item), list(item)
        for j in range(k):
            wrong[(2 * j + 1) * m // (2 * k)] = "#"
        for j in range(k + 1):
            over[(2 * j + 1) * m // (2 * k + 2)] = "#"
        rows = [(1, f"0123 {item} 4567"), (2, f"0123 {''.join(wrong)} 4567"), (3, f"0123 {''.join(over)} 4567"), (4, "")]
        assert {(r[0], r[4]) for r in scan([(1, item)], rows)} == {(1, 0), (2, k)}, m


def test_find_leaks_in_repetitive_text_stays_small():
    """A million bytes of the letters that an item repeats: no place's hits are spelled out one by one."""
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert scan([(1, "ab" * 600)], [(1, "a" * 1_000_000), (2, "ba" * 100_000)])
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600 << 10


def test_pack_tokens(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    rows = [(d, t) for d, t in corpus(7) if d != 300] + [((1 << 60) + 1, "large id " * 90), (None, "no id"), ((1 << 60) + 3, "x<|endoftext|> y")]
    got = pack_tokens(docs(spark, rows).repartition(5), windows=3).collect()
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: np.array([*reference.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4") for d, t in rows}
    seen, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and bytes(r.ids) == own.tobytes() and r.ids_crc32 == zlib.crc32(own.tobytes())
        seen[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for d, x in ids.items():
        at = 0
        for start, length in sorted(seen[d]):
            assert start == at
            at += length
        assert at == len(x)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 1024 or at & (at - 1) == 0
    assert pack_tokens(docs(spark, [])).count() == 0


def test_pack_tokens_matches_added_tokens_inside_texts(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["one<|endoftext|>two", "<|endoftext|>", "a  <|endoftext|><|endoftext|>  b\n<|endoftext|>\n", "<|endoftext", "no <|ENDOFTEXT|> here", "plain"]
    got = {r.doc_id: r for r in pack_tokens(docs(spark, list(enumerate(texts)))).collect() if r.start == 0}
    for d, text in enumerate(texts):
        ids = [*reference.encode(text, add_special_tokens=False).ids, 0]
        assert got[d].doc_tokens == len(ids) and np.frombuffer(got[d].ids, dtype="<u4").tolist() == ids[: got[d].length]
    assert reference.encode(texts[0], add_special_tokens=False).ids == [505, 50256, 11545]


def test_encoder_equals_its_library():
    from tokenizers import Tokenizer

    rng = random.Random(1)
    parts = list(" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2000\u200b\u2028\u202f\u205f\u3000\ufeff") + [*"aZ9'\u00e9\u65e5.!-\u0663\u00b2", "'s", "'ll", " the", "<|endoftext|>", "<|endof", "  ", "\n\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + [prose(rng, 500), "", "a" * 5000]
    whole = Tokenizer.from_file(tokenizer_path())
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    for keep in (200_000, 50):
        own = Encoder(tokenizer_path(), keep)
        assert own.by_word and [x.tolist() for i in range(0, len(texts), 100) for x in own.encode(texts[i : i + 100])] == want and own.encode([]) == []
    words = Tokenizer.from_file(tokenizer_path().replace("byte_bpe_50k", "word_bpe_49k"))
    own = Encoder(tokenizer_path().replace("byte_bpe_50k", "word_bpe_49k"))
    assert not own.by_word and [x.tolist() for x in own.encode(texts[:50])] == [words.encode(t, add_special_tokens=False).ids for t in texts[:50]]


def test_token_counts(spark):
    import base64

    from recordloom.llm.token_counts import vocabulary_path

    vocabulary = [base64.b64decode(line.split()[0]) for line in open(vocabulary_path(), "rb")]
    known = set(vocabulary)

    def brute(word):
        n = 0
        while word:
            k = next(k for k in range(min(len(word), 130), 0, -1) if word[:k] in known)
            word, n = word[k:], n + 1
        return n

    rows = [(1, "Straße über the tokenization 日本語 unbelievably"), (2, None), (3, ""), (4, " \n"), (None, "x"), (5, "a" * 5000 + " the"), (1, "again")]
    got = word_piece_counts(docs(spark, rows)).collect()
    want = []
    for d, t in rows:
        w = [brute(b" " + x) for x in (t or "").encode().split()]
        want.append((d, len((t or "").encode()), len(w), sum(w), max(w, default=0)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert word_piece_counts(docs(spark, [])).count() == 0


def test_piece_counter_small_vocabularies():
    rng = random.Random(9)
    for _ in range(30):
        vocabulary = [bytes([c]) for c in range(256)] + ["".join(rng.choice("abc") for _ in range(rng.randint(2, 6))).encode() for _ in range(20)]
        counter, known = PieceCounter(vocabulary), set(vocabulary)
        for _ in range(50):
            word = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 15))).encode()
            rest, n = word, 0
            while rest:
                k = next(k for k in range(len(rest), 0, -1) if rest[:k] in known)
                rest, n = rest[k:], n + 1
            assert counter.count(word) == n
    with pytest.raises(ValueError, match="single byte"):
        PieceCounter([b"a"])


def test_histogram_shards(spark):
    rows = corpus(11) + [(None, "no id"), (None, None)] + [(1000 + i, "copy " * 40) for i in range(300)]
    got = histogram_shards(docs(spark, rows).repartition(4), shards=8).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        assert r.size == len((r.text or "").encode()) + 1
        by[r.shard].append(r)
    sizes = [sum(r.size for r in by[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in got)
    for s in by:
        assert sorted(r.slot for r in by[s]) == list(range(len(by[s])))
    assert histogram_shards(docs(spark, [])).count() == 0
    assert {r.shard for r in histogram_shards(docs(spark, [(1, "a"), (2, "b")])).collect()} <= set(range(8))


def test_histogram_shards_counts_and_names(spark):
    """Bytes below each boundary counted anew; internal names of the input stay; without the text the same places."""
    rng = random.Random(2)
    rows = [(i, "t" * rng.randint(0, 300) if i % 7 else "copy " * 40, "h", "d", "n") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _h string, _d string, _n string")
    got = histogram_shards(df, shards=5, part_rows=10).collect()
    assert {(r._h, r._d, r._n) for r in got} == {("h", "d", "n")} and sorted((r.doc_id, r.text) for r in got) == sorted(r[:2] for r in rows)
    total, below = sum(len(t) + 1 for _, t, *_ in rows), 0
    groups = defaultdict(int)
    for r in got:
        groups[r.text] += r.size
    for s in range(1, 5):
        below += sum(r.size for r in got if r.shard == s - 1)
        assert abs(below - total * s / 5) <= max(301, 0.001 * total / 5)
    narrow = histogram_shards(df, shards=5, with_text=False).collect()
    assert "text" not in narrow[0] and sorted((r.doc_id, r.size, r.shard, r.slot) for r in narrow) == sorted((r.doc_id, r.size, r.shard, r.slot) for r in got)


def test_histogram_shards_is_native(spark):
    plan = histogram_shards(docs(spark, corpus(1))).select("doc_id", "slot")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "MapInArrow" not in plan


def test_nearest(spark):
    rng = np.random.default_rng(1)
    vecs = [(i, rng.normal(size=16).tolist()) for i in range(300)]
    vecs += [(400 + i, vecs[7][1]) for i in range(30)] + [(500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] + [1.0] * 15), (504, [None] + [1.0] * 15), (505, [1e200] * 16), (506, [1.0, 2.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame([(i, v, "x") for i, v in vecs], "vec_id long, embedding array<double>, score string")
    got = defaultdict(list)
    for r in nearest(df.union(df.filter("vec_id in (3, 200)")), F.col("vec_id") % 100 == 0, k=10, block_bytes=9000, query_tile=2, candidate_tile=20, fan=3).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    vecs += [vecs[3], vecs[200]]  # repeated candidates count each time, a repeated query once
    ok = [(i, v) for i, v in vecs if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for q, qv in dict(ok).items():
        if q % 100:
            continue
        d = sorted((float(np.sqrt(np.add.accumulate((np.array(v) - np.array(qv)) ** 2)[-1])), i) for i, v in ok if i != q and len(v) == len(qv))[:10]
        assert sorted(got[q]) == [(k + 1, i, s) for k, (s, i) in enumerate(d)], q
    assert nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


PAGE = """<!DOCTYPE html><html lang='en'><head><title>T</title><style>p{x:1}</style></head><body><header>Site name</header><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Head &amp; more</h1><p>First paragraph of the text with   <b>bold</b>
words<br>and a line.<p>Second one, unclosed <a href=x>link</a> here.<aside>See also</aside><ul><li>item one<li>item two</ul><script>var a = "<p>no</p>";</script><!-- <p>no</p> -->
<div class="comments"><p>I disagree with all of this.</p></div></article><form><input><button>Go</button></form><footer>&copy; me</footer></body></html>"""


def test_extract():
    assert extract(PAGE) == "Head & more\n\nFirst paragraph of the text with bold words and a line.\n\nSecond one, unclosed link here.\n\nitem one\n\nitem two"
    assert extract("") == extract("<html></html>") == extract("<script>x</script>") == ""
    assert extract("only text &lt;b&gt;") == "only text <b>"
    assert extract("<p>a<b>b</p><p>c</p>") == "ab\n\nc"
    divs = "<body><div id=menu><a href=1>one</a> <a href=2>two</a></div><div id=content>" + "".join(f"<p>{'word ' * 30}{i}</p>" for i in range(4)) + "</div><div><a href=3>more links here</a></div></body>"
    assert extract(divs).count("\n\n") == 3 and "links" not in extract(divs) and "one" not in extract(divs)
    for broken in ("<", "<a", "</", "<p class=", "<!--", "<p>" * 3000, "<a href='x", "&#0; &bogus;"):
        extract(broken)


ARTICLE = "<article><p>First paragraph of the text.</p><p>Second one of it.</p></article>"
SHOWN = "First paragraph of the text.\n\nSecond one of it."


@pytest.mark.parametrize("page", [
    f"<html><head><title>T</title><body>{ARTICLE}</body></html>",
    f"<html><head><title>T</title><meta charset=utf-8>{ARTICLE}",
    "<head><title>T</title>First paragraph of the text.<p>Second one of it.",
    "<body><p class='notice'>Cookies<p>First paragraph of the text.<p>Second one of it.",
    "<body><p class='notice'>Cookies<p>First paragraph of the text.</p><p>Second one of it.</p></body>",
    "<body><ul><li class=ad>Buy<li>First paragraph of the text.<li>Second one of it.</ul></body>",
    "<body><table><tr class=ad><td>Buy<tr><td class=sidebar>More<td>First paragraph of the text.<td>Second one of it.</table></body>",
    f"<body><nav><a href=/>Home</a>{ARTICLE}<nav><a href=/>End</a></nav></body>",
    f"<body><div><nav><a href=/>Home</a></div>{ARTICLE}<nav><a href=/>End</a></nav></body>",
    f"<body><aside>See also{ARTICLE}<aside>More</aside></body>",
    f"<body><div><select><option>a<option>b</div>{ARTICLE}</body>",
    *(f"<body><{tag}>x{ARTICLE}</body>" for tag in ("select", "button", "noscript")),
    f"<body><nav><ul><li>a<ul><li>b</ul><p>c<div>d</div></ul></nav>{ARTICLE}<div class=ad><p>x<p>y</div></body>",
    f"<body><script>if (a) '<nav>'; <!-- <script></script> --></script>{ARTICLE}</body>",
])
def test_extract_ends_dropped_elements_without_end_tags(page):
    assert extract(page) == SHOWN


@pytest.mark.parametrize("part", [
    "<figure><pre>let x = 1</pre><figcaption>Listing</figcaption></figure>", "<figure><table><tr><td>cell</table></figure>", "<figure><blockquote>said</blockquote></figure>", "<math><mi>x</mi></math>",
    "<object data=x><p>let</object>", "<audio src=x>no sound</audio>", "<video src=x>no film</video>", "<dialog open>cell</dialog>", "<svg><path d='M0'/><text>cell</text></svg>", "<canvas>cell</canvas>",
    "<iframe src=x>cell</iframe>", "<xmp>a &lt; <b></xmp>", "<div data-hidden='false' data-id='comments'>cell</div>", "<div data-role=navigation title='a class=ad b'>cell</div>", "<p x-style='display:none' my-class=ad>cell</p>",
])
def test_extract_keeps_what_no_rule_names(part):
    want = {"<figure><pre>": ["let x = 1", "Listing"], "<figure><blo": ["said"], "<math><mi>x": ["x"], "<object data": ["let"], "<audio src=x": ["no sound"], "<video src=x": ["no film"], "<xmp>a &lt; ": ["a &lt; <b>"]}
    page = f"<body><article><p>First paragraph of the text.</p>{part}<p>Second one of it.</p></article></body>"
    assert extract(page).split("\n\n") == ["First paragraph of the text.", *next((v for k, v in want.items() if part.startswith(k)), ["cell"]), "Second one of it."]


@pytest.mark.parametrize("part", ["<div hidden>x</div>", "<div\nid=comments>x</div>", "<div data-x='1'class='ad'>x</div>", "<p STYLE='display: none'>x</p>", "<div aria-hidden=true>x</div>"])
def test_extract_drops_what_a_mark_names(part):
    assert extract(f"<body><article><p>First paragraph of the text.</p>{part}<p>Second one of it.</p></article></body>") == SHOWN


@pytest.mark.parametrize(("page", "want"), [
    ('<div><p class="ad">Buy<p>text</p><p>more</p></div>', "text|more"),
    ('<ul><li class="ad">Buy<li>text<li>more</ul>', "text|more"),
    ("<body><article><p>first one</p></article><article><p>the second, longer one</p></article></body>", "first one|the second, longer one"),
    ("<article><p>outer text</p><article><p>inner text that is quite a bit longer</p></article></article>", "outer text|inner text that is quite a bit longer"),
    ('<section id="related"><p>All of the article</p><p>more</p></section>', "All of the article|more"),
    ('<div class="article social"><p>All of the article</p></div>', "All of the article"),
    ('<div class="widget"><h1>Head</h1><p>All of the article</p><div class="share">Share it</div></div>', "Head|All of the article"),
    ("<body><header>Site</header><main><header><h1>Head</h1></header><p>All of the article</p></main></body>", "Head|All of the article"),
    ('<body><div class="related"><a href=1>Other</a></div><div><p>Long paragraph of the article, with its words.</p><p>Ok.</p></div></body>', "Long paragraph of the article, with its words.|Ok."),
    ("<body><div><a href=1>one</a> <a href=2>two</a></div><h2>Head</h2><div><p>Long paragraph of the article, <a href=x>linked</a>.</p><div>And another that has no paragraph's tag at all.</div></div></body>",
     "Head|Long paragraph of the article, linked.|And another that has no paragraph's tag at all."),
])
def test_extract_chooses_by_density(page, want):
    assert extract(page).split("\n\n") == want.split("|")


def test_densities_by_a_walk():
    """Against the definition, node by node."""
    import math

    from recordloom.llm.html_text import densities

    rng = random.Random(5)
    for _ in range(40):
        k = rng.randint(2, 25)
        parents = [-1, 0, *(rng.randrange(i) for i in range(2, k))]
        tags = ["html", "body", *(rng.choice(["div", "p", "a", "b"]) for _ in range(2, k))]
        above = lambda i: [] if i < 0 else [i, *above(parents[i])]
        out = [False] * k
        for i in range(2, k):
            out[i] = out[parents[i]] or rng.random() < 0.1
        runs = [(i, "x y" * rng.randint(0, 9), any(tags[j] == "a" for j in above(i)), 0) for i in (rng.randrange(k) for _ in range(30))]
        within = [[j for j in range(k) if i in above(j) and not out[j]] for i in range(k)]
        letters = lambda nodes, links: sum(len(t.replace(" ", "")) for n, t, linked, _ in runs if n in nodes and (linked or not links))

        def density(c, lc, t, lt):
            if not c:
                return 0
            lcb, cb = letters(within[1], True), max(1, letters(within[1], False))
            base = max(math.e, math.log(c / max(1, c - lc) * lc + lcb / cb * c + math.e))
            return c / t * max(0, math.log(c / max(1, lc) * t / max(1, lt), base))

        want = [density(letters(w, False), letters(w, True), len(w), sum(tags[j] == "a" for j in w)) for w in within]
        own = [density(0 if out[i] else sum(len(t.replace(" ", "")) for n, t, linked, _ in runs if n == i and not linked), 0, 1, 0) for i in range(k)]
        dense, total, *_ = densities(tags, parents, out, runs)
        assert np.allclose(dense, want)
        assert np.allclose(total, [own[i] + sum(want[j] for j in range(k) if parents[j] == i) for i in range(k)])


def test_extract_needs_no_article_tag(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect() if r.html]
    for page in pages:
        assert extract(page.replace("<article>", "<div>").replace("</article>", "</div>")) == extract(page) != ""


def test_extract_main_text(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "u", "", "x"), (1, "u", PAGE, "x"), (3, "u", "<p>" + "long text " * 50_000 + "</p>", "x")]
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((str(r.page_id), r.n_chars, len(r.text)) for r in got) == sorted((str(p), len(extract(h or "")), len(extract(h or ""))) for p, _, h, _ in rows)


def test_language_id(spark):
    rng = random.Random(2)
    words = {"en": ["the", "and", "with", "from"], "de": ["und", "der", "nicht", "schön"], "fr": ["les", "dans", "être", "pour"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(10, 60))), lang, "s%d" % (i % 3)) for i in range(240) for lang in [list(words)[i % 3]]]
    train = spark.createDataFrame(rows[:120], "doc_id long, text string, lang string, source string")
    held = spark.createDataFrame([(i, t, None, s) for i, t, _, s in rows[120:]] + [(900, None, "en", "s0"), (901, "", None, None), (902, "12", "en", "s1"), (903, "漢字漢字漢字漢字", "en", "s0"), (None, rows[0][1], None, None)], "doc_id long, text string, lang string, source string")
    model = fit_documents(train)
    got = {r.doc_id: r for r in identify(document_rows(held), model, ["doc_id"]).collect()}
    truth = {i: lang for i, _, lang, _ in rows[120:]}
    assert np.mean([got[i].lang == lang for i, lang in truth.items()]) >= 0.98
    assert all(got[i].rejected is None for i in truth)
    assert got[900].rejected == got[901].rejected == "no text" and got[903].rejected == "unknown language" and None in got
    assert identify(document_rows(held.limit(0)), model, ["doc_id"]).count() == 0
    empty = fit_documents(train.limit(0))
    assert {r.rejected for r in identify(document_rows(held), empty, ["doc_id"]).collect()} == {"unknown language"}


def test_language_posterior_by_hand(spark, monkeypatch):
    """The posterior recomputed from its definition, term by term; long texts in slices."""
    import recordloom.llm.language_id as L

    rng = random.Random(8)
    words = {"en": ["the", "and", "with"], "de": ["und", "der", "nicht"]}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    model = fit_documents(spark.createDataFrame([(i, text(x, 30), x, "s") for i, x in enumerate(["en", "de"] * 10)], "doc_id long, text string, lang string, source string"))
    rows = [(i, text(rng.choice(["en", "de"]), rng.randint(1, 4)) + " q" * 3, rng.choice(["en", "de", "xx", None]), rng.choice(["fr", "de", "uk", None]), rng.choice(["h1", "h2", None]), "dom") for i in range(30)]
    rows = [(*r[:5], r[5] if r[4] else None) for r in rows] + [(99, "the with " * 200, None, None, "h1", "dom")]
    got = {r.id: r for r in identify(spark.createDataFrame(rows, "id long, text string, declared string, suffix string, host string, domain string"), model, ["id"], host_weight=3.0, domain_weight=2.0).collect()}
    langs, log_p = model.languages, model.log_p.astype(float)
    share = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    logs, posts = {}, {}
    for i, t, declared, suffix, *_ in rows:
        slots = L.trigram_slots(np.frombuffer(t.encode(), dtype=np.uint8))
        x = log_p[:, slots].mean(axis=1) * min(len(slots), 200)
        for value, trust in ((declared, 0.9), (L.SUFFIXES.get(suffix), 0.8)):
            if value in langs:
                x = x + np.log([trust if lang == value else 1 - trust for lang in langs])
        logs[i], posts[i] = x, share(x)
    whole = sum(posts.values()) + 1
    for i, _, _, _, host, domain in rows:
        prior = whole / whole.sum()
        for level, name, weight in ((5, domain, 2.0), (4, host, 3.0)):
            rest = sum((posts[r[0]] for r in rows if name and r[level] == name and r[0] != i), np.zeros(2))
            prior = (rest + weight * prior) / (rest.sum() + weight)
        want = share(logs[i] + np.log(prior))
        assert got[i].lang == langs[int(want.argmax())] and abs(got[i].confidence - want.max()) < 1e-4, i
    score = L._score(model, ["id"], 200.0, 0.9, 0.8)
    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 3], "declared": pa.array([None] * 3, pa.string()), "suffix": pa.array([None] * 3, pa.string()), "text": [text("de", 400), "ab", text("en", 3)]})
    whole = pa.Table.from_batches(score(iter([batch]))).to_pydict()
    monkeypatch.setattr(L, "SLICE", 64)
    parts = pa.Table.from_batches(score(iter([batch]))).to_pydict()
    assert parts["_grams"] == whole["_grams"] and np.allclose(parts["_logs"], whole["_logs"]) and np.allclose(parts["_known"], whole["_known"])


def test_language_id_keeps_a_rare_language_among_many_rows(spark):
    rng = random.Random(3)
    words = {"en": ["the", "and", "with", "from"], "de": ["und", "der", "nicht", "schön"], "fi": ["ja", "että", "kanssa", "mutta"]}
    text = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(40))
    rows = [(i, lang, text(lang)) for i, lang in enumerate(["en", "de"] * 1500 + ["fi"] * 9)] + [(None, "en", text("en")) for _ in range(300)] + [(9000, None, "x"), (9001, "sv", None)]
    labelled = spark.createDataFrame(rows, "id long, lang string, text string").repartition(3)
    kept = {r["lang"]: r["count"] for r in fit_sample(labelled, 200).groupBy("lang").count().collect()}
    assert kept["fi"] == 9 and all(32 <= kept[x] <= 100 for x in ("en", "de")) and len(kept) == 3
    held = spark.createDataFrame([(i, text("fi"), "fi" if i % 2 else None, None) for i in range(20)], "doc_id long, text string, lang string, source string")
    assert {(r.lang, r.rejected) for r in identify(document_rows(held), fit(labelled, 200), ["doc_id"]).collect()} == {("fi", None)}


def test_host_prior_decides_what_the_text_leaves_open(spark):
    train = spark.createDataFrame([(i, t, lang, "x") for i, (t, lang) in enumerate([("aaa bbb ccc", "en"), ("xxx yyy zzz", "de")] * 20)], "doc_id long, text string, lang string, source string")
    rows = [(i, "xxx yyy zzz", None, "h.example.de") for i in range(30)] + [(100, "aaa xxx", None, "h.example.de"), (101, "aaa xxx", None, "other")]
    rows = spark.createDataFrame(rows, "id long, text string, declared string, host string").withColumn("suffix", F.lit(None).cast("string")).withColumn("domain", F.lit(None).cast("string"))
    got = {r.id: r for r in identify(rows, fit_documents(train), ["id"]).collect()}
    assert (got[100].lang, got[101].lang) == ("de", "en")


def test_address_and_markup(spark):
    row = spark.createDataFrame([("https://user@www.Example.co.de:80/x?y", '<!doctype html><HTML class="a" lang="DE-at">'), (None, None), ("mailto:x", "<p lang=fr>")], "u string, h string")
    got = row.select(*(c.alias(n) for c, n in zip(address_parts(F.col("u")), "hds")), markup_language(F.col("h")).alias("m")).collect()
    assert [tuple(r) for r in got] == [("www.example.co.de", "co.de", "de", "de"), (None, None, None, None), (None, None, None, None)]


def test_warc_round_trip(spark):
    big = "<p>" + "x" * 1200 + "</p>"
    rows = [(1, "http://a/ b", big), (2, None, big), (3, "u3", "small"), (4, "u4", "small"), (5, "u5", None), (6, "u6", "é" * 700), (None, "u7", big), (8, "u8", "\r\n\r\nbody\r\n"), (2, None, big)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    packages = write_archives(df, member_bytes=300)
    got = read_archives(packages).collect()
    want = []
    for p, _, h in rows:
        raw = (h or "").encode()
        revisit = h == big and p is not None and p < 2
        want.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None))
    assert sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == sorted(map(repr, want))
    by_id = {r.page_id: r for r in got}
    assert bytes(by_id[8].payload).decode() == "\r\n\r\nbody\r\n" and by_id[1].payload is None and by_id[1].url == "http://a/%20b"
    assert read_archives(write_archives(df.limit(0))).count() == 0


def test_zip64_directory(tmp_path):
    import zipfile

    import recordloom.llm.warc_zip as W

    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        with z.open(zipfile.ZipInfo("one"), "w", force_zip64=True) as f:
            f.write(b"hello")
        z.writestr("two", b"world!")
        z.comment = b"a comment PK\x05\x06 inside"
    with open(path, "rb") as f:
        members = zip_members(f, path.stat().st_size)
        assert [W.read_range(f, *members[n][:2]) for n in ("one", "two")] == [b"hello", b"world!"]
    # more members than 16 bits count: the ZIP64 end record
    many = tmp_path / "b.zip"
    with zipfile.ZipFile(many, "w") as z:
        for i in range(65_600):
            z.writestr(f"m{i}", b"")
    with open(many, "rb") as f:
        assert len(zip_members(f, many.stat().st_size)) == 65_600
    with pytest.raises(ValueError, match="not a ZIP"), open(__file__, "rb") as f:
        zip_members(f, 100)


def test_cut_repeats_keeps_columns(spark):
    from recordloom.llm.phrase_dedup import cut_repeats

    rng = random.Random(8)
    a = prose(rng, 60)
    rows = [(1, "x" + a), (2, "y" + a), (3, None), (4, ""), (None, a), (5, "short")]
    df = docs(spark, rows).withColumn("n_removed", F.lit("mine"))
    out, removed = cut_repeats(df)
    assert removed == "n_removed_" and out.columns == [*df.columns, removed]
    got = {r.doc_id: (r.text, r.n_removed_, r.size, r.n_removed) for r in out.collect()}
    assert got == {1: ("x" + a, 0, 1, "mine"), 2: ("y", len(a), 1, "mine"), 3: (None, 0, 1, "mine"), 4: ("", 0, 1, "mine"), None: (a, 0, 1, "mine"), 5: ("short", 0, 1, "mine")}
