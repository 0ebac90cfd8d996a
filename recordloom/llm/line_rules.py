"""Quality rules, lines first (operator 12), in DataFrame operations only.

Each line of a text is held against three kinds of rules, lines that break one are removed, and a document that loses too large a share
of its words so is rejected. Beside that verdict stand counts of the whole text (words, symbols, equal lines, words in repeated windows), of
which two reject a document by themselves.

Everything is an expression over one row, so there is no exchange and a task holds one text at a time. The words' windows are sorted within the row: equal
ones are neighbours then, whatever the text's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col

SPACE = r" \t-\r"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

# fixed values: what lines end with, what stands between items of a menu, and what notices and controls of a page say
END_MARKS = r"""[.!?:;,…。！？：；،؟।"'”’»)\]]\z"""
SEPARATORS = r"|»›•·→>/\\"
NOTICES = (
    r"(?iu)(?:^|[^a-zA-Z])(?:all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados|copyright *[0-9]{4}|licen[sc]ed under|released under|terms of (?:use|service)"
    r"|privacy policy|cookie|enable javascript|powered by|lorem ipsum|subscribe to|newsletter|spdx-license|© *[0-9]{4}|\(c\) *[0-9]{4})"
)
CONTROLS = (
    r"(?iu)\A(?:home|menu|search|next|previous|prev|back|top|skip to [a-z ]+|read more|more|click here|share|print|reply|log ?in|sign ?(?:in|up|out)|register|contact(?: us)?|about(?: us)?|sitemap|[<«‹]+[^\n]*|[^\n]*[>»›]+)\z"
)


def broken_rule(line: Column, marks_share: float = 0.3, shouts: int = 3, short_words: int = 3, short_chars: int = 20, menu_items: int = 3, item_words: float = 3.0, control_chars: int = 40, notice_chars: int = 240) -> Column:
    """Which kind of rule a line breaks: navigation, boilerplate or punctuation, the first of several; null for a good line and for one without a word.

    * punctuation: more than ``marks_share`` of its characters are neither letters, digits, marks of letters nor white space; or ``shouts`` runs of !! or ?? and as many as a third of its words; or
      it has no end mark and both fewer than ``short_words`` words and ``short_chars`` characters;
    * navigation: at least ``menu_items`` items between separators, with at most ``item_words`` words each on average; or, with at most ``control_chars`` characters, it says no more than a control of a page does;
    * boilerplate: a notice (rights, licence, terms, cookies) in a line of at most ``notice_chars`` characters.
    """

    # a line's parts are made once, by binding it and then them
    def parts(bare: Column) -> Column:
        items = F.when(bare.rlike(f"[{SEPARATORS}]"), F.size(F.split(bare, rf"[ \t]+[{SEPARATORS}]+[ \t]+"))).otherwise(1)
        marks = F.char_length(F.regexp_replace(bare, rf"[a-zA-Z0-9{SPACE}\p{{L}}\p{{N}}\p{{M}}]+", ""))
        return F.struct(bare.alias("bare"), items.alias("items"), (F.size(F.split(bare, r"[!?]{2,}")) - 1).alias("runs"), F.char_length(bare).alias("chars"), marks.alias("marks"))

    def rule(x: Column) -> Column:
        words = F.size(F.split(x["bare"], f"[{SPACE}]+"))
        short = (x["chars"] < short_chars) & ~x["bare"].rlike(END_MARKS) & (words < short_words)
        punctuation = (x["marks"] > marks_share * x["chars"]) | ((x["runs"] >= shouts) & (x["runs"] * 3 >= words)) | short
        navigation = ((x["items"] >= menu_items) & (words - (x["items"] - 1) <= item_words * x["items"])) | ((x["chars"] <= control_chars) & x["bare"].rlike(CONTROLS))
        boilerplate = (x["chars"] <= notice_chars) & x["bare"].rlike(NOTICES)
        return F.when(x["chars"] > 0, F.when(navigation, "navigation").when(boilerplate, "boilerplate").when(punctuation, "punctuation"))

    return F.get(F.transform(F.transform(F.array(F.btrim(line, F.lit(SPACES))), parts), rule), F.lit(0))


def clean_lines(docs: DataFrame, lost_share: float = 0.3, least_words: int = 50, repeat_share: int = 50, with_text: bool = True) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_removed, lost_words and, ``with_text``, clean_text.

    Words are runs of other than ASCII white space, lines are cut at \\n. word_chars: code points in words; n_symbols: characters of ``SYMBOLS``; n_dup_lines: lines with a
    word that are equal to an earlier one; n_repeat_words: words in windows of three words that are found twice or more in the text. base_failed: under ``least_words`` words, or more than
    ``repeat_share`` of 100 words in repeated windows. kept: not base_failed, and lines that break a rule (see broken_rule) hold at most ``lost_share`` of the words.
    n_lines counts lines with a word, n_removed those removed; clean_text is what is left of a text, in order.

    Null and empty texts have no words, fail, and stay empty. Rows are judged one by one: repeated rows and doc_ids each give a row, null doc_ids are
    passed on, an empty table gives none, other columns don't matter. A text is held whole, with its windows, by one task.
    """
    long = lambda x: x.cast("long")
    base = docs.select(c("doc_id").cast("long").alias("doc_id"), F.coalesce(c("text").cast("string"), F.lit("")).alias("t"))
    # what is used more than once stays a column of its own: the planner keeps such projections apart, so nothing is computed twice
    cut = base.select("doc_id", "t", F.array_remove(F.split("t", f"[{SPACE}]+"), "").alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("lines"))
    n_words = lambda x: F.size(F.array_remove(F.split(x, f"[{SPACE}]+"), ""))
    lost = F.aggregate(
        "lines", F.struct(F.lit(0).alias("lines"), F.lit(0).alias("words")),
        lambda n, x: F.when(broken_rule(x).isNull(), n).otherwise(F.struct((n["lines"] + 1).alias("lines"), (n["words"] + n_words(x)).alias("words"))),
    )
    kept = [F.array_join(F.filter("lines", lambda x: broken_rule(x).isNull()), "\n").alias("clean_text")] if with_text else []
    cut = cut.select(
        "doc_id", "w", long(F.size("w")).alias("n_words"), long(F.char_length(F.array_join("w", ""))).alias("word_chars"),
        long(F.char_length("t") - F.char_length(F.regexp_replace("t", f"[{SYMBOLS}]+", ""))).alias("n_symbols"), long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        long(F.size("lines")).alias("n_lines"), lost.alias("lost"), (F.pow(2, F.ceil(F.log2(F.size("w") + 1))).cast("long") - 1).alias("m"), *kept,
    )
    rest = [x for x in cut.columns if x not in ("w", "m")]
    # hashes of the windows tell texts without a repeated one; of the others windows are sorted as (upper bits of the hash, place), plain longs: equal windows
    # are neighbours then, and few others are
    cut = cut.select(*rest, "w", "m", F.transform(F.expr("slice(w, 3, size(w))"), lambda last, i: F.xxhash64(F.get("w", i), F.get("w", i + 1), last)).alias("h"))
    key = lambda x, i: x.bitwiseAND(F.bitwise_not(c("m"))).bitwiseOR(i.cast("long"))
    some = F.size(F.array_distinct("h")) < F.size("h")
    cut = cut.select(*rest, "w", "m", F.when(some, F.sort_array(F.transform("h", key))).otherwise(F.array().cast("array<long>")).alias("p"))
    alike = lambda x, i: x.bitwiseXOR(F.get("p", i)).between(F.lit(0), c("m"))
    cut = cut.select(*rest, "w", F.transform(F.filter("p", lambda x, i: alike(x, i + 1) | alike(x, i - 1)), lambda x: x.bitwiseAND(c("m")).cast("int")).alias("at"))
    # those are compared as words
    window = lambda i: F.struct(F.concat(F.get("w", i), F.lit(" "), F.get("w", i + 1), F.lit(" "), F.get("w", i + 2)).alias("s"), i.alias("i"))
    cut = cut.select(*rest, F.sort_array(F.transform("at", window)).alias("s"))
    same = lambda x, i: (x["s"] == F.get("s", i + 1)["s"]) | (x["s"] == F.get("s", i - 1)["s"])
    at = F.sort_array(F.transform(F.filter("s", same), lambda x: x["i"]))
    # windows cover three words each, those that overlap only what is new
    covered = F.aggregate(at, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])
    counted = cut.select(*rest, long(covered).alias("n_repeat_words"), long(c("lost.lines")).alias("n_removed"), long(c("lost.words")).alias("lost_words"))
    failed = (c("n_words") < least_words) | (100 * c("n_repeat_words") > repeat_share * c("n_words"))
    out = counted.withColumns({"base_failed": failed, "kept": ~failed & (c("lost_words") <= lost_share * c("n_words"))})
    named = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_removed", "lost_words"]
    return out.select(*named, *(["clean_text"] if with_text else []))
