"""String and regular-expression column functions (JVM-side, codegen-friendly).

Regular expressions are Java patterns; the ones used by the registered
queries stay inside the subset that RE2 reads the same way.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def str_length(c) -> Column:
    return F.char_length(_c(c))


def str_case(c, kind: str = "upper") -> Column:
    c = _c(c)
    if kind == "upper":
        return F.upper(c)
    if kind == "lower":
        return F.lower(c)
    if kind == "title":
        return F.initcap(c)
    raise ValueError(f"kind={kind!r}")


def str_trim(c, side: str = "both") -> Column:
    c = _c(c)
    return {"both": F.trim, "left": F.ltrim, "right": F.rtrim}[side](c)


def str_squish(c) -> Column:
    """Trim and collapse internal runs of whitespace to one space."""
    return F.trim(F.regexp_replace(_c(c), r"\s+", " "))


def str_pad(c, width: int, side: str = "left", pad: str = " ") -> Column:
    """Pad to ``width``; longer strings are cut to ``width`` (Spark's lpad/rpad rule)."""
    c = _c(c)
    return (F.lpad if side == "left" else F.rpad)(c, width, pad)


def str_sub(c, start: int, end: int) -> Column:
    """Characters start..end inclusive, 1-based."""
    return F.substring(_c(c), start, end - start + 1)


def str_replace(c, old: str, new: str) -> Column:
    """Literal (not regex) replacement of every occurrence."""
    return F.replace(_c(c), F.lit(old), F.lit(new))


def str_concat(sep: str, *cs) -> Column:
    return F.concat_ws(sep, *[_c(c) for c in cs])


def str_starts(c, s: str) -> Column:
    return F.startswith(_c(c), F.lit(s))


def str_ends(c, s: str) -> Column:
    return F.endswith(_c(c), F.lit(s))


def re_detect(c, p: str) -> Column:
    return _c(c).rlike(p)


def re_count(c, p: str) -> Column:
    return F.regexp_count(_c(c), F.lit(p))


def re_extract(c, p: str, all: bool = False, group: int = 0) -> Column:
    """First match (empty string when none, Spark's rule) or all matches."""
    if all:
        return F.regexp_extract_all(_c(c), F.lit(p), F.lit(group))
    return F.regexp_extract(_c(c), p, group)


def re_replace(c, p: str, r: str) -> Column:
    return F.regexp_replace(_c(c), p, r)


def re_split(c, p: str) -> Column:
    return F.split(_c(c), p)
