"""Text statistics that feed the text branch."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from mediaguard import fixed


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def squeeze(s) -> Column:
    return F.trim(F.regexp_replace(_c(s), r"\s+", " "))


def clip_text(s, n: int = fixed.CLIP_CHARS) -> Column:
    """Whitespace collapsed, then cut to ``n`` characters with an ellipsis."""
    t = squeeze(s)
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.substring(t, 1, n - 1), F.lit("…")))


def token_is_plausible(t) -> Column:
    t = _c(t)
    return (F.length(F.trim(t)) >= 2) & t.rlike(r"^[\p{L}\p{N}\s]+$")


def frac_nonascii(s) -> Column:
    s = _c(s)
    return F.when(F.length(s) > 0,
                  F.length(F.regexp_replace(s, r"[\x00-\x7F]", "")) / F.length(s)).otherwise(0.0)


def letter_share(t) -> Column:
    """Share of ASCII letters in a token; the stand-in for an OCR confidence."""
    t = _c(t)
    return F.length(F.regexp_replace(t, r"[^A-Za-z]", "")) / F.length(t)
