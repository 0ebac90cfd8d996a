"""Free citation texts into fields: a text is cut into segments, each is scored for what it may be, and the best sequence is found (Viterbi).

Years, quoted titles and volume, issue and pages are cut out by their form; what stands between is cut at ends of sentences, but not after initials and abbreviations.
"""

from __future__ import annotations

import re
from functools import lru_cache

PAGES = r"[A-Za-z]?\d+\s*[-–—]+\s*[A-Za-z]?\d+|[A-Za-z]?\d+"
NUMBERS = re.compile(
    rf"(?:\bvol(?:ume)?\b\.?\s*)?\b(?P<v1>\d+)\s*\(\s*(?P<n1>[^()]{{1,12}}?)\s*\)(?:\s*[:,]\s*(?:pp?\.?\s*)?(?P<p1>{PAGES}))?"
    rf"|\bvol(?:ume)?\b\.?\s*(?P<v2>\d+)(?:[,;]?\s*(?:no|nr|iss(?:ue)?)\b\.?\s*(?P<n2>\d+))?(?:[,;:]?\s*(?:pp?\b\.?\s*)?(?P<p2>{PAGES}))?"
    rf"|\b(?P<v3>\d+)\s*[:,]\s*(?:pp?\.?\s*)?(?P<p3>[A-Za-z]?\d+\s*[-–—]+\s*[A-Za-z]?\d+)"
    rf"|\bpp?\.\s*(?P<p4>{PAGES})",
    re.I,
)
YEAR = re.compile(r"\(\s*((?:1[5-9]|20)\d\d)[a-z]?\s*\)|(?<![\d–-])((?:1[5-9]|20)\d\d)[a-z]?(?=\s*(?:[;.,]|$))")
QUOTED = re.compile(r"[“\"]([^”\"]{8,})[”\"]")
DOI = re.compile(r"(?:\bdoi:?\s*|https?://(?:dx\.)?doi\.org/)?\b(10\.\d{4,9}/[^\s\"<>]+?)(?=[.,;]?(?:\s|$))", re.I)
URL = re.compile(r"(?:(?:available (?:at|from)|retrieved from)\s*:?\s*)?(https?://[^\s\"<>]+?)(?=[.,;]?(?:\s|$))", re.I)
MARKER = re.compile(r"^\s*(?:[-*•]|\[\d+\]|\d{1,4}[.)])\s+")
# a sentence's end: not after an initial or an abbreviation
END = re.compile(r"(?<=[.?!])\s+(?=[\w“\"(])")
ABBREVIATION = re.compile(r"(?:^|[\s.(-])(?:[A-Z]|[A-Z]\.-[A-Z]|al|vol|no|pp?|eds?|proc|int|conf|j|trans|rev|res|sci|st|jr|dr|vs|e\.g|i\.e|comput|inf|syst|manag|soc|assoc|am|univ)\.$", re.I)
# names as Last FM: the last initials end the list of authors where several names are written so, or where a title follows
LAST_INITIALS = re.compile(r"[A-Z][\w'’-]+ [A-Z]{1,3}\.$")
SEVERAL = re.compile(r"[A-Z][\w'’-]+ [A-Z]{1,3}(?:, | and )")
TITLE = re.compile(r"[A-Z\d][\w'’-]*:? (?!(?:and|et|y|und)\b)[a-z]")
INITIALS = re.compile(r"^(?:[A-Z]\.?-?){1,4},?$")
PARTICLE = frozenset("and & et al al. von van de der den la le di da dos du".split())
# fixed values: words of outlets' and publishers' names
OUTLET = re.compile(r"\b(journal|proceedings|conference|review|transactions|quarterly|annals|bulletin|letters|magazine|symposium|workshop|lecture notes|communications of|research policy|advances in|archives of)\b", re.I)
MEETING = re.compile(r"\b(proceedings|conference|symposium|workshop|congress)\b", re.I)
PUBLISHER = re.compile(r"\b(press|springer|elsevier|wiley|sage|routledge|verlag|publish\w*|publications|editors?|eds?\.|edn|edition|university)\b", re.I)

LABELS = ("author", "year", "title", "outlet", "numbers", "rest")
BEFORE = {"author": 2.0, "title": -1.0, "year": -6.0, "outlet": -6.0, "numbers": -8.0, "rest": -8.0}
NEXT = {
    ("author", "author"): 0.0, ("author", "year"): 1.0, ("author", "title"): 1.0, ("year", "title"): 2.0, ("year", "outlet"): -2.0, ("year", "numbers"): 0.5, ("year", "rest"): 0.0, ("title", "title"): -0.5,
    ("title", "outlet"): 2.0, ("title", "year"): 0.0, ("title", "numbers"): -2.0, ("title", "rest"): -0.5, ("outlet", "numbers"): 2.0, ("outlet", "year"): 1.0, ("outlet", "outlet"): -1.5, ("outlet", "rest"): 0.0,
    ("numbers", "year"): 1.0, ("numbers", "numbers"): 0.0, ("numbers", "rest"): 0.0, ("rest", "rest"): 0.0, ("rest", "year"): 0.0, ("rest", "numbers"): -1.0,
}
UNLIKELY = -5.0


def segments(text: str) -> list[tuple[str, str]]:
    """(form, text): year, numbers, quoted or text."""
    cut: list[tuple[int, int, str]] = []
    taken = lambda s, e: any(a < e and s < b for a, b, _ in cut)
    for m in QUOTED.finditer(text):
        cut.append((*m.span(), "quoted"))
    for m in YEAR.finditer(text):
        if m[1] and not taken(*m.span()):
            cut.append((*m.span(), "year"))
    for m in NUMBERS.finditer(text):
        if m.start() > 10 and not taken(*m.span()):
            cut.append((*m.span(), "numbers"))
    if not any(k == "year" for _, _, k in cut):
        for m in YEAR.finditer(text):
            if not taken(*m.span()):
                cut.append((*m.span(), "year"))
    out, at = [], 0
    for s, e, kind in [*sorted(cut), (len(text), len(text), "")]:
        start = at
        between = text[at:s]
        pieces, last = [], 0
        for m in END.finditer(between):
            piece = between[last : m.start()]
            if not ABBREVIATION.search(piece) or LAST_INITIALS.search(piece) and (SEVERAL.search(piece) or TITLE.match(between, m.end())):
                pieces.append(between[last : m.start()])
                last = m.end()
        pieces.append(between[last:])
        out += [("text", p.strip(" ,;:")) for p in pieces if re.search(r"\w", p)]
        if kind:
            out.append((kind, text[s:e]))
        at = max(e, start)
    return out


def _scores(kind: str, text: str, first: bool) -> dict[str, float]:
    if kind == "year":
        return {"year": 8.0}
    if kind == "numbers":
        return {"numbers": 8.0}
    if kind == "quoted":
        return {"title": 8.0}
    words = text.split()
    plain = [w for w in words if re.match(r"[^\W\d_]", w) and w.lower() not in PARTICLE]
    lower = sum(w[0].islower() for w in plain) / max(1, len(plain))
    initials = sum(bool(INITIALS.match(w)) for w in words)
    known, publisher, within = bool(OUTLET.search(text)), bool(PUBLISHER.search(text)), bool(re.match(r"in:?\s+[A-Z]", text, re.I)) and not first
    return {
        "author": (3.0 if initials else 0.0) + min(2.0, initials + text.count(",") * 0.3) - 6 * lower + (1.5 if first else -3.0) - (2.0 if known else 0.0),
        "title": min(len(words), 8) / 4 + (1.5 if lower > 0.2 else 0.0) - (1.5 if known else 0.0) - (2.0 if within else 0.0) - (1.0 if initials > 1 and lower < 0.1 else 0.0) - (1.0 if publisher and len(words) < 6 else 0.0),
        "outlet": (2.5 if known else 0.0) + (4.0 if within else 0.0) + (1.0 if lower < 0.35 else -1.0) - (2.5 if publisher and not known and not within else 0.0) - max(0, len(words) - 14) * 0.3,
        "rest": 0.5 + (1.5 if publisher and not known else 0.0) - (1.0 if len(words) > 8 else 0.0),
    }


def label(parts: list[tuple[str, str]]) -> list[str]:
    """The best sequence of labels."""
    best: dict[str, tuple[float, list[str]]] = {}
    for i, (kind, text) in enumerate(parts):
        now: dict[str, tuple[float, list[str]]] = {}
        for name, score in _scores(kind, text, i == 0).items():
            if i == 0:
                now[name] = (score + BEFORE[name], [name])
            else:
                value, path = max(((v + NEXT.get((p, name), UNLIKELY), path) for p, (v, path) in best.items()), key=lambda x: x[0])
                now[name] = (value + score, [*path, name])
        best = now
    return max(best.values(), key=lambda x: x[0])[1] if best else []


def names(text: str) -> str:
    """Authors as "Last, First and Last, First"; et al. as others."""
    text = re.sub(r"[,;]?\s+et\s+al\.?", " and others", text.strip(" ,;:"))
    text = re.sub(r",?\s+(?:and|&|und|y)\s+", " and ", text)
    initials = r"(?:[A-Z]\.?[\s-]?){1,4}"
    if ";" in text:
        people = [p for part in text.split(";") for p in part.split(" and ")]
    elif re.match(rf"[^,]+,\s*{initials}(?:,|\s+and|$)", text):  # Last, F. M., Last, F. M.
        people = [re.sub(r"\s*,\s*", ", ", p.strip(" ,")) for part in text.split(" and ") for p in re.findall(rf"[^,]+,\s*{initials}(?=,|$)|[^,]+$", part)]
    elif all(re.match(r"[^,]+,\s*[A-Z][\w'’.-]*(?: [A-Z][\w'’.-]*)*$", p) or p == "others" for p in text.split(" and ")) and not INITIALS.match((text.split(",")[0].split() or [""])[-1]):  # Last, First and Last, First
        people = text.split(" and ")
    else:
        people = [p for part in text.split(" and ") for p in part.split(",")]
    out = []
    for p in (" ".join(x.split()).strip(" ,;") for x in people):
        words = p.split()
        if not words:
            continue
        if "," in p or p == "others" or len(words) == 1:
            out.append(p)
        elif INITIALS.match(words[-1]) and not INITIALS.match(words[0]):  # Last FM
            k = next(i for i in range(1, len(words)) if all(INITIALS.match(w) for w in words[i:]))
            out.append(re.sub(r" ([A-Z]{1,3})\.$", r" \1", f"{' '.join(words[:k])}, {' '.join(words[k:])}"))  # a point there ends the sentence
        else:  # F. M. Last, with particles
            k = next((i for i, w in enumerate(words[:-1]) if w in PARTICLE), len(words) - 1)
            out.append(f"{' '.join(words[k:])}, {' '.join(words[:k])}" if k else p)
    return " and ".join(out)


@lru_cache(maxsize=4096)
def _parse(text: str) -> tuple[str, tuple[tuple[str, str], ...]]:
    fields: dict[str, str] = {}
    rest = MARKER.sub("", " ".join(text.split()))
    for key, pattern in (("doi", DOI), ("url", URL)):
        if m := pattern.search(rest):
            fields[key] = m[1]
            rest = rest[: m.start()] + " " + rest[m.end() :]
    parts = segments(rest)
    labels = label(parts)
    of = lambda name: [t for (_, t), n in zip(parts, labels) if n == name]
    if of("author"):
        fields["author"] = names(" ".join(of("author")))
    if of("year"):
        fields["year"] = re.search(r"\d{4}", of("year")[0])[0]
    if of("title"):
        title = " ".join(t.strip("“”\" ,") for t in of("title"))
        fields["title"] = re.sub(r"[.,]$", "", title).strip()
    meeting = False
    if of("outlet"):
        name = re.sub(r"^in:?\s+", "", " ".join(of("outlet")), flags=re.I).strip(" .,;:")
        meeting = bool(MEETING.search(name)) or bool(re.match(r"in:", of("outlet")[0], re.I))
        fields["booktitle" if meeting else "journal"] = name
    for numbers in of("numbers"):
        m = NUMBERS.fullmatch(numbers) or NUMBERS.search(numbers)
        for key, groups in (("volume", ("v1", "v2", "v3")), ("number", ("n1", "n2")), ("pages", ("p1", "p2", "p3", "p4"))):
            if value := next((m[g] for g in groups if m[g]), None):
                fields.setdefault(key, re.sub(r"\s*[-–—]+\s*", "--", value))
    if of("rest") and "journal" not in fields:
        fields["publisher" if "booktitle" not in fields else "address"] = ", ".join(of("rest")).strip(" .,")
    kind = "inproceedings" if meeting else "article" if "journal" in fields else "book" if "publisher" in fields else "misc"
    return kind, tuple(fields.items())


def parse_reference(text: str) -> tuple[str | None, str | None, dict[str, str]]:
    """(type, no local id, fields) of one citation text."""
    kind, fields = _parse(text)
    return kind, None, dict(fields)
