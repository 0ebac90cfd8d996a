"""Personal names in the grammar First von Last, von Last, First and von Last, Jr, First."""

from __future__ import annotations

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

NAME = StructType([StructField(f, StringType()) for f in ("first", "von", "last", "jr")])


def _words(text: str) -> list[str]:
    """Words split at white space outside of braces."""
    out, depth, word = [], 0, ""
    for ch in text:
        depth += (ch == "{") - (ch == "}")
        if ch.isspace() and depth <= 0:
            if word:
                out.append(word)
            word = ""
        else:
            word += ch
    return [*out, word] if word else out


def _is_von(word: str) -> bool:
    letter = next((ch for ch in word if ch.isalpha()), "") if not word.startswith("{") else ""
    return letter.islower()


def parse_name(name: str) -> dict[str, str | None]:
    """One name; the words in lower case before the last name are its von part."""
    parts = [p.strip() for p in name.split(",")]
    join = lambda w: " ".join(w) or None
    if len(parts) == 1:
        words = _words(parts[0])
        lower = [i for i, w in enumerate(words[:-1]) if _is_von(w)]
        if lower:
            a, b = lower[0], lower[-1] + 1
            return {"first": join(words[:a]), "von": join(words[a:b]), "last": join(words[b:]), "jr": None}
        return {"first": join(words[:-1]), "von": None, "last": join(words[-1:]), "jr": None}
    words = _words(parts[0])
    n = 0
    while n < len(words) - 1 and _is_von(words[n]):
        n += 1
    first = parts[-1] or None
    return {"first": first, "von": join(words[:n]), "last": join(words[n:]), "jr": (parts[1] or None) if len(parts) > 2 else None}


@pandas_udf(ArrayType(NAME))
def parse_names_udf(authors: pd.Series) -> pd.Series:
    return pd.Series([[parse_name(n) for n in a.split(" and ")] if isinstance(a, str) else None for a in authors])
