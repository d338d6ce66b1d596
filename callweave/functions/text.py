"""String functions of the query catalogue, as Columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def escaped(text: str) -> str:
    """``text`` with the wildcards of LIKE escaped."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def glob_regex(glob: str) -> str:
    """An anchored regular expression for a GLOB: ``*`` and ``?`` cross ``/``, sets are kept."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "^!" else body) + "]", end + 1
            continue
        out += {"*": "(?s:.*)", "?": "(?s:.)"}.get(c) or ("\\" + c if not c.isalnum() and c not in "_ " else c)
        i += 1
    return f"^{out}$"


def like_ci(text: Column, pattern: Column) -> Column:
    """Case-insensitive LIKE whose pattern is data: its own ``%`` and ``_`` are wildcards."""
    return F.lower(text).like(F.lower(pattern)) if isinstance(pattern, str) else F.call_function("like", F.lower(text), F.lower(pattern))


def normalized_path(path: Column) -> Column:
    """A path with ``.`` and ``..`` folded; a leading ``..`` beyond the root is dropped."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    fold = F.aggregate(parts, F.array().cast("array<string>"), lambda done, p: F.when(p == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p))))
    return F.array_join(fold, "/")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("([\\p{L}\\p{N}]+)"), F.lit(1))


def _jaro_winkler(a: str | None, b: str | None) -> float:
    a, b = a or "", b or ""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, hits = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    other = [c for j, c in enumerate(b) if used[j]]
    m, t = len(hits), sum(x != y for x, y in zip(hits, other, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


@pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity; equal pairs of a batch are computed once."""
    seen: dict = {}
    return pd.Series([seen[p] if p in seen else seen.setdefault(p, _jaro_winkler(*p)) for p in zip(a, b, strict=True)])
