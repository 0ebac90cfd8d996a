"""Language identification by Bayesian evidence fusion (operator 3).

For each row the posterior of a language multiplies four kinds of evidence:

* the text: byte trigrams under a multinomial model of each language, over the whole text. The weight of long
  texts is capped (``text_weight`` trigrams), since trigrams of one text aren't independent;
* the declared language (a page's markup, or a column), right with ``declared_trust``;
* the suffix of the address, right with ``suffix_trust`` for suffixes that belong to a language;
* a prior of the host, smoothed towards its domain, and that towards the corpus. The host's and domain's
  languages are sums, over all their rows, of posteriors from the other three kinds; a row's own share is taken out of its
  prior. Sums are grouped aggregations with partial sums, so a host with a third of all rows costs one row per task; the sums of large hosts are
  broadcast to their rows, and rows without a host pass by the join.

The trigram model is fitted on a bounded sample of labelled rows: labels are counted over all rows, and each language keeps
about ``fit_rows`` / languages of its own rows (``LEAST_ROWS`` at least, all of them where it has no more), so no label is lost
and none depends on how many rows the others have. Everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm import kernels as K
from recordloom.llm.skew import join_by_weight
from recordloom.session import materialize, release

SLOTS = 1 << 15
LEAST_ROWS = 64
#: bytes scored at once
SLICE = 1 << 18
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0x20
# fixed values: country suffixes whose sites are mostly in one language
SUFFIXES = {
    "at": "de", "de": "de", "es": "es", "mx": "es", "ar": "es", "cl": "es", "pe": "es", "fr": "fr", "it": "it", "pt": "pt", "br": "pt",
    "nl": "nl", "pl": "pl", "se": "sv", "dk": "da", "fi": "fi", "uk": "en", "us": "en", "au": "en", "nz": "en", "ie": "en",
}


def trigram_slots(data: np.ndarray) -> np.ndarray:
    x = LOWER[data].astype(np.uint32)
    g = x[:-2] | (x[1:-1] << np.uint32(8)) | (x[2:] << np.uint32(16))
    return ((g * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = batch.column(0).to_pylist()
        data, off = K.buffers(batch.column(1))
        lang, slot, n = [], [], []
        for label in sorted(set(labels)):
            total = np.zeros(SLOTS, dtype=np.int64)
            for i, own in enumerate(labels):
                if own == label and off[i + 1] - off[i] > 2:
                    total += np.bincount(trigram_slots(data[off[i] : off[i + 1]]), minlength=SLOTS)
            at = np.flatnonzero(total)
            lang += [label] * len(at)
            slot.append(at)
            n.append(total[at])
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(np.concatenate(slot) if slot else np.zeros(0, np.int64)), pa.array(np.concatenate(n) if n else np.zeros(0, np.int64))], names=["lang", "slot", "n"]
        )


class TrigramModel:
    """languages; log P(trigram slot | language); which slots each language has."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + 0.5
        self.log_p = np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32)
        self.has = counts > 0


def fit_sample(labelled: DataFrame, fit_rows: int = 4000) -> DataFrame:
    """The rows of labelled (id, lang, text) with a label and a text; of a language with more than its share of ``fit_rows`` every so manieth by hash."""
    rows = labelled.filter("lang is not null and text is not null")
    counts = rows.groupBy("lang").count().collect()  # a row for each language
    share = max(LEAST_ROWS, fit_rows // max(1, len(counts)))
    steps = {r["lang"]: -(-r["count"] // share) for r in counts if r["count"] > share}
    if not steps:
        return rows
    step = F.coalesce(F.create_map(*(F.lit(x) for kv in steps.items() for x in kv))[F.col("lang")].cast("long"), F.lit(1).cast("long"))
    # rows without an id are told apart by their texts
    return rows.filter(F.pmod(F.xxhash64("id", F.when(F.col("id").isNull(), F.col("text"))), step) == 0)


def fit(labelled: DataFrame, fit_rows: int = 4000) -> TrigramModel:
    """labelled (id, lang, text): fitted on ``fit_sample``. Rows without a label or text are left out."""
    sample = fit_sample(labelled, fit_rows)
    got = sample.select("lang", "text").mapInArrow(_count_trigrams, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(got["lang"].unique())  # at most SLOTS rows for each language came back
    counts = np.zeros((len(languages), SLOTS))
    for i, lang in enumerate(languages):
        own = got[got["lang"] == lang]
        counts[i, own["slot"].to_numpy()] = own["n"].to_numpy()
    return TrigramModel(languages, counts)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(np.ascontiguousarray(x).ravel()))


def _agreement(values: pa.Array, languages: list[str], trust: float, names: dict[str, str] | None = None) -> np.ndarray:
    """Log-likelihood of what each row declares under each language; zero where it declares none of them."""
    rows = {lang: np.full(len(languages), np.log(max((1.0 - trust) / max(1, len(languages) - 1), 1e-9))) for lang in languages}
    for i, lang in enumerate(languages):
        rows[lang][i] = np.log(trust)
    silent = np.zeros(len(languages))
    return np.array([rows.get(names.get(v) if names else v, silent) for v in values.to_pylist()]).reshape(len(values), len(languages))


def _score(model: TrigramModel, names: list[str], text_weight: float, declared_trust: float, suffix_trust: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(names..., declared, suffix, text) -> names..., n_grams, share of known trigrams, log evidence and posterior without the host, by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, m = len(model.languages), len(names)
        table = np.ascontiguousarray(np.concatenate([model.log_p, model.has], axis=0).T.astype(np.float32))
        for batch in batches:
            data, off = K.buffers(batch.column(m + 2))
            means = np.zeros((len(off) - 1, 2 * k))
            grams = np.maximum(np.diff(off) - 2, 0)
            for lo, hi in K.chunks(off, SLICE):
                for at in range(int(off[lo]), max(int(off[hi]) - 2, int(off[lo]) + 1), SLICE):  # more than one slice: one very long text
                    part = data[at : min(int(off[hi]), at + SLICE + 2)] if hi - lo == 1 else data[off[lo] : off[hi]]
                    own = off[lo : hi + 1] - off[lo] if hi - lo > 1 else np.array([0, len(part)])
                    if len(part) < 3:
                        continue
                    slots = trigram_slots(part)
                    sums = np.zeros((len(slots) + 1, 2 * k))
                    np.cumsum(table[slots], axis=0, dtype=np.float64, out=sums[1:])
                    s = np.minimum(own[:-1], len(slots))
                    means[lo:hi] += sums[np.maximum(s, own[1:] - 2)] - sums[s]
                    if hi - lo > 1:
                        break
            means /= np.maximum(grams, 1)[:, None]
            logs = means[:, :k] * np.minimum(grams, text_weight)[:, None]
            logs += _agreement(batch.column(m), model.languages, declared_trust) + _agreement(batch.column(m + 1), model.languages, suffix_trust, SUFFIXES)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:m], pa.array(grams.astype(np.int64)), _lists(means[:, k:]), _lists(logs), _lists(_softmax(logs))], names=[*names, "_grams", "_known", "_logs", "_p"]
            )

    return run


def _fuse(languages: list[str], names: list[str], base: list[float], domain_weight: float, host_weight: float, min_known: float, min_confidence: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, m = len(languages), len(names)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            matrix = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, k)  # noqa: B023, E731
            grams, known, logs, p, domain, host = batch.column(m).to_numpy(), *(matrix(m + j) for j in range(1, 6))
            prior = np.array([base])
            for sums, strength in ((domain, domain_weight), (host, host_weight)):
                rest = np.maximum(sums - p, 0.0)  # without the row itself
                prior = (rest + strength * prior) / (rest.sum(axis=1, keepdims=True) + strength)
            q = _softmax(logs + np.log(prior))
            best = q.argmax(axis=1)
            top, seen = q[np.arange(n), best], known[np.arange(n), best]
            why = ["no text" if g == 0 else "unknown language" if s < min_known else "uncertain" if t < min_confidence else None for g, s, t in zip(grams, seen, top)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:m], pa.array([languages[i] for i in best], pa.string()), pa.array(top), pa.array(why, pa.string())], names=[*names, "lang", "confidence", "rejected"]
            )

    return run


def address_parts(address: Column) -> tuple[Column, Column, Column]:
    """(host, domain: its last two labels, suffix) of an address; null where there is none."""
    host = F.lower(F.nullif(F.regexp_extract(address, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    labels = F.split(host, r"\.")
    return host, F.when(F.size(labels) > 1, F.concat_ws(".", F.slice(labels, -2, 2))), F.when(F.size(labels) > 1, F.element_at(labels, -1))


def markup_language(html: Column) -> Column:
    """The primary subtag of the html element's lang attribute."""
    return F.nullif(F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1)), F.lit(""))


def identify(
    rows: DataFrame, model: TrigramModel, keys: list[str], text_weight: float = 200.0, declared_trust: float = 0.9, suffix_trust: float = 0.8,
    host_weight: float = 10.0, domain_weight: float = 10.0, min_known: float = 0.3, min_confidence: float = 0.5,
) -> DataFrame:
    """rows (keys..., text, declared, suffix, host, domain) -> keys..., lang, confidence, rejected (reason or null).

    Any column may be null: evidence that is missing says nothing. A text without three bytes is rejected ("no text"), so is one whose
    best language knows under ``min_known`` of its trigrams ("unknown language"), and one whose best posterior is under
    ``min_confidence`` ("uncertain"). Ties go to the language first in the alphabet. Repeated rows each get a row; an empty
    table gives none. With a model without languages every row is rejected.
    """
    langs = model.languages
    if not langs:
        return rows.select(*keys, F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), F.lit("unknown language").alias("rejected"))
    kinds = dict(rows.dtypes)
    typed = lambda names: "".join(f"`{n}` {kinds[n]}, " for n in names)
    names, k = [*keys, "host", "domain"], len(langs)
    scored = rows.select(*names, "declared", "suffix", F.col("text").cast("string")).mapInArrow(
        _score(model, names, text_weight, declared_trust, suffix_trust), typed(names) + "_grams long, _known array<double>, _logs array<double>, _p array<double>"
    )
    first = materialize(scored, "op3")
    by_host = materialize(first.groupBy("host", "domain").agg(F.count("*").alias("_rows"), *(F.sum(F.col("_p")[i]).alias(f"s{i}") for i in range(k))), "op3-host")
    sums = [F.sum(f"s{i}").alias(f"s{i}") for i in range(k)]
    n_rows, *whole = by_host.agg(F.sum("_rows"), *sums).first()
    whole = [float(x or 0.0) + 1.0 for x in whole]
    packed = F.array(*(F.col(f"s{i}") for i in range(k)))
    hosts = by_host.filter("host is not null").groupBy("host").agg(F.max("domain").alias("_domain"), F.sum("_rows").alias("_rows"), *sums).select("host", "_domain", "_rows", packed.alias("_h"))
    domains = by_host.filter("domain is not null").groupBy("domain").agg(*sums).select(F.col("domain").alias("_domain"), packed.alias("_d"))
    priors = hosts.join(domains, "_domain", "left").drop("_domain")
    none = F.array(*([F.lit(0.0)] * k))
    joined = join_by_weight(first.select("host", *keys, "_grams", "_known", "_logs", "_p"), priors, "host", "_rows", n_rows or 0).select(*keys, "_grams", "_known", "_logs", "_p", F.coalesce("_d", none).alias("_d"), F.coalesce("_h", none).alias("_h"))
    fused = _fuse(langs, keys, [x / sum(whole) for x in whole], domain_weight, host_weight, min_known, min_confidence)
    out = materialize(joined.mapInArrow(fused, typed(keys) + "lang string, confidence double, rejected string"), "op3-out")
    release(first, by_host)
    return out


def document_rows(docs: DataFrame) -> DataFrame:
    """documents (doc_id, text, lang, source, ...) as rows for identify: lang is what is declared, source stands for the host."""
    empty = F.lit(None).cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("lang").cast("string")).alias("declared"), empty.alias("suffix"),
        F.col("source").cast("string").alias("host"), empty.alias("domain"), F.col("text").cast("string").alias("text"),
    )


def page_rows(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html, ...) as rows for identify; the text is the html without tags, comments, scripts and styles."""
    host, domain, suffix = address_parts(F.col("url").cast("string"))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), markup_language(F.col("html").cast("string")).alias("declared"), suffix.alias("suffix"),
        host.alias("host"), domain.alias("domain"), F.regexp_replace(F.col("html").cast("string"), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ").alias("text"),
    )


def fit_documents(docs: DataFrame, fit_rows: int = 4000) -> TrigramModel:
    return fit(docs.select(F.col("doc_id").alias("id"), F.lower(F.col("lang").cast("string")).alias("lang"), F.col("text").cast("string").alias("text")), fit_rows)
