"""Operators 11 to 13 against brute force or SQL, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm.divergence import shares, source_divergence
from recordloom.llm.html_text import extract, extract_main_text
from recordloom.llm.line_rules import broken_rule, clean_lines
from recordloom.llm.queries import oracle_sql
from recordloom.llm.spelling import ErrataTrie, common_prefix, near_words, spelling_variants
from recordloom.session import materialize

# extra columns whose names clash with those that operators make
DOCS = "doc_id long, text string, lang string, source string, n long, word string, term string, kept boolean, t string, chunk int, form string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 3, "w", "t", True, "x", 1, "f") for i, t, lang, source in rows], DOCS)


def prose(rng, n, parts=("the", "an", "er", "on", "ré", "thn", "öu")):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(seed=1, n=150):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(1, 90)) + rng.choice([".", "\nHome | News | About | Contact\n", "\n\nAll rights reserved.\n", "!! no!! no!! ??"]), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "", None])) for i in range(n)]
    rows += [(i, t, lang, source) for i, t, lang, source in rows[:9]]  # repeated rows
    rows += [(None, prose(rng, 60), "en", "a"), (900, None, "en", "b"), (901, "", None, None), (902, " \n\t ", "en", "only blank"), (903, "一二三四五 六七", "zh", "a")]
    rows += [(904, prose(rng, 30_000), "en", "a"), (905, "x" * 100_000 + " wörd", "en", "b"), (906, "the end of it " * 4000, "de", "a"), (907, " ".join(w + "!!" for w in prose(rng, 80).split()), "de", "b")]
    return rows


def table(df):
    cols = df.columns
    return cols, sorted((tuple(r) for r in df.collect()), key=str)


def with_sql(name, rows):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?)", rows) if rows else None
    out = con.sql(oracle_sql()[name])
    return out.columns, sorted(out.fetchall(), key=str)


# --- operator 11


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def near_by_pairs(words):
    out = {}
    for w in words:
        if found := [x for x in words if near(w, x)]:
            best = min(found, key=lambda x: (-words[x], x))
            out[w] = (len(found), words[best], best)
    return out


def some_words(rng, alphabet, n, longest=6):
    return {"".join(rng.choice(alphabet) for _ in range(rng.randint(1, longest))): rng.randint(1, 9) for _ in range(n)}


@pytest.mark.parametrize("seed", range(30))
def test_errata_trie(seed):
    rng = random.Random(seed)
    words = some_words(rng, ["ab", "abcd", "aéö𝒳"][seed % 3], rng.randint(0, 70))
    words |= {"a" * k: k for k in range(1, rng.randint(2, 9))}
    trie = ErrataTrie(list(words), list(words.values()))
    trie.merge()
    assert {w: tuple(r) for w, *r in trie.rows()} == near_by_pairs(words)


def test_common_prefix():
    assert [common_prefix(*x) for x in (("", "a"), ("abc", "abd"), ("ab", "abd"), ("x" * 5000 + "a", "x" * 5000 + "b"))] == [0, 2, 2, 5000]


@pytest.mark.parametrize("most_words", [1, 4])
def test_large_nodes_by_joins(spark, most_words):
    words = some_words(random.Random(most_words), "abé", 60) | {"aa": 5, "aaa": 5, "aaaa": 5}
    df = materialize(spark.createDataFrame(list(words.items()), "word string, n long"), "words")
    assert {r.word: (r.n_near, r.near_n, r.near_word) for r in near_words(df, most_words).collect()} == near_by_pairs(words)


def variants_by_pairs(rows):
    count = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    found = near_by_pairs(words)
    form = {w: b for w, (_, n, b) in found.items() if n >= 2 * words[w]}
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, found.get(w, (0,))[0], words[form[w]] if w in form else None))
    return sorted(out, key=str)


def test_spelling_variants(spark):
    rng = random.Random(7)
    rows = [r for r in corpus(3) if r[0] not in (904, 906)]
    rows += [(2000 + i, " ".join(w[: i % 5] + rng.choice("xyzÉ") + w[i % 5 :] for w in ["thnthn", "ANTHER", "thérer"] * 3) + " thnthn" * 9, "en", "a") for i in range(40)]
    rows += [(3000 + i, "k" * 30_000 + "ab " + "k" * 30_000 + "b", "en", "a") for i in range(3)]  # long words
    rows += [(4000, "chain " * 3 + "chainx " * 6 + "chainxy " * 13 + "chainxyz " * 30 + "tiede tiede tiede tieda tieda tieda tiedb tiedb tiedb", "en", "a")]
    got = spelling_variants(docs(spark, rows))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = variants_by_pairs(rows)
    assert table(got)[1] == want and any(r[2] not in (r[0], r[1]) for r in want)
    assert table(spelling_variants(docs(spark, rows), most_words=50))[1] == want
    assert spelling_variants(docs(spark, [])).collect() == []
    assert spelling_variants(docs(spark, [(1, None, None, None), (2, "", "", "")])).collect() == []


# --- operator 12


def test_line_rules_against_sql(spark):
    rows = corpus(5)
    out = clean_lines(docs(spark, rows))
    cols, want = with_sql("op12_line_rules", rows)
    assert table(out.select(*cols))[1] == want
    assert {(r[-2], r[-1]) for r in want} == {(True, False), (False, True), (False, False)}
    assert clean_lines(docs(spark, [])).collect() == []
    assert "Python" not in (plan := out._jdf.queryExecution().toString()) and "Exchange" not in plan


def test_windows_by_hand(spark):
    """Repeated windows cover their words, overlapping ones each word once."""

    def by_hand(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        return len({j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)})

    rng = random.Random(2)
    texts = ["a a a", "a a a a", "a b c x a b c", "a b c a b c a b", "a b", "", "\x0b\x0ca\x0bb c\x1fd a b c\x1fd"] + [prose(rng, n, ("a", "b")) for n in (5, 20, 200, 3000)]
    got = {r.doc_id: r.n_repeat_words for r in clean_lines(docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    assert got == {i: by_hand(t) for i, t in enumerate(texts)}


def test_rules_of_lines(spark):
    lines = {
        "This is a sentence that ends with a mark.": None, "A line of verse without a mark at its end": None, "": None, " \t": None, "इस वाक्य में कुछ शब्द हैं।": None, "这是一个没有空格的句子。": None,
        "Home | News | About us | Contact": "navigation", "Read more": "navigation", "Next »": "navigation", "one / two / three / four": "navigation", "He said: either this one | or that one with many words | or yet another of them all": None,
        "© 2020 Example Ltd.": "boilerplate", "Copyright 1999 by us": "boilerplate", "Licensed under the MIT License.": "boilerplate", "TOUS DROITS RÉSERVÉS.": "boilerplate", "We use cookies to improve your visit.": "boilerplate",
        "*** $$$ %%% &&&": "punctuation", "BUY!! NOW!! IT!! IS!! CHEAP!!": "punctuation", "Menu item": "punctuation", "-----": "punctuation", "Yes!": None, "The recookied cake was unlicensed undergrowth, they said.": None,
    }
    got = spark.createDataFrame([(x,) for x in lines], "x string").select("x", broken_rule(F.col("x")).alias("rule")).collect()
    assert {r.x: r.rule for r in got} == lines


def test_clean_text(spark):
    body = "\n".join(" ".join(f"{w}{i}" for w in "every line has words of its own".split()) + "." for i in range(10))
    text = f"Home | News | About\n{body}\n\nAll rights reserved."
    r = clean_lines(docs(spark, [(1, text, "en", "a"), (2, None, "en", "a")])).orderBy("doc_id").collect()
    assert r[0].clean_text == body and r[0].kept and r[0].n_removed == 2 and r[0].lost_words == 8 and r[0].n_lines == 12
    assert (r[1].clean_text, r[1].kept, r[1].base_failed) == ("", False, True)


# --- operator 13


@pytest.mark.parametrize("sizes", [(64, 8192), (2, 16), (1, 1)])
def test_divergence_against_sql(spark, sizes):
    rows = corpus(9) + [(5000, "Größe", "de", "s" + str(i)) for i in range(3)]
    got = source_divergence(docs(spark, rows), block_groups=sizes[0], chunk_terms=sizes[1])
    cols, want = with_sql("op13_source_divergence", rows)
    assert got.columns == cols and table(got)[1] == want


def test_divergence_of_nothing(spark):
    assert source_divergence(docs(spark, [])).collect() == []
    few = source_divergence(docs(spark, [(1, None, None, None), (2, "a b", None, "x"), (3, "c", "en", "x")]))
    assert sorted(map(tuple, few.collect())) == [("", "", "pair", "x", 0, 1), ("", "x", "pair", "", 0, 1)]


def test_shares_of_large_counts():
    n, total = np.array([[0, 10**12, 8 * 10**14]]), np.array([[9 * 10**14]])
    assert shares(n, total).tolist() == [[1 + 10**9 * (int(x) + 2) // (9 * 10**14) for x in n[0]]]


# --- operator 1: names of wrappers, deep nesting

ARTICLE = "<p>" + "The article has a body of running text, which goes on for some time. " * 6 + "</p>"


@pytest.mark.parametrize("name", "notice menu comments alert footer respond ad-hoc nav-target comment-free sidebar cookie-free ads-r-us".split())
def test_wrappers_keep_the_article(name):
    assert extract(f'<main><div class="{name}">{ARTICLE}</div></main>').startswith("The article has")
    page = f'<html><head><title>T</title></head><body><nav>Home About</nav><h1>Title</h1><div id="{name}">{ARTICLE}</div><div class="comments">nice one</div><form>Send</form><footer>imprint</footer></body></html>'
    got = extract(page)
    assert "The article has" in got and not any(x in got for x in ("nice one", "Send", "imprint", "Home"))


@pytest.mark.parametrize("name", ["comments", "comment-list", "sidebar", "ad-slot", "cookie-banner", "notice"])
def test_named_parts_go_beside_an_article(name):
    """Also where they hold far more text than the article does."""
    other = "".join(f"<p>Part number {i} by someone who disagrees at length with all of it.</p>" for i in range(80))
    assert extract(f'<h1>Head</h1><p>{"An article of some length that says a thing or two. " * 3}</p><div class="{name}">{other}</div>') == "Head\n\n" + " ".join(["An article of some length that says a thing or two."] * 3)


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x", "<p><b><span>" * 30_000 + "x</b>", "<ul><li>" * 30_000 + "x", "<a>" * 50_000 + "x" + "</b></div>" * 50_000, "<table><tr><td>" * 20_000 + "x"])
def test_deep_nesting_is_linear(page):
    began = time.process_time()
    assert extract(page) == "x"
    assert time.process_time() - began < 8


def test_pages_of_nothing(spark):
    schema = "page_id long, url string, html string, text int, n_chars string"
    assert extract_main_text(spark.createDataFrame([], schema)).collect() == []
    got = extract_main_text(spark.createDataFrame([(1, None, None, 1, "a"), (None, "u", "", 1, "a"), (1, "u", "<p>", 1, "a")], schema)).collect()
    assert [(r.text, r.n_chars) for r in got] == [("", 0)] * 3
