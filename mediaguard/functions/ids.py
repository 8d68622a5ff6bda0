"""Content identifiers and the deterministic draws taken from them."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def content_id(data) -> Column:
    """16 hex characters of the SHA-256 of the canonical bytes."""
    return F.substring(F.sha2(data, 256), 1, 16)


def hex_int(col, start: int = 1, length: int = 8) -> Column:
    """Integer value of ``length`` hex characters beginning at 1-based ``start``."""
    return F.conv(F.substring(col, start, length), 16, 10).cast("long")


def seed(image_id) -> Column:
    return hex_int(image_id, 1, 8)


def half(image_id, bit: int = 0) -> Column:
    """'a' or 'b': parity of the ``bit``-th group of 8 hex characters of the id."""
    return F.when(hex_int(image_id, 1 + 8 * bit, 8) % 2 == 0, "a").otherwise("b")


def one_in(image_id, n: int) -> Column:
    """True for one id in ``n``."""
    return seed(image_id) % n == 0


def variant_name(kind, param) -> Column:
    return F.regexp_replace(F.concat(kind, param), r"\.", "")


def draw_key(*parts) -> Column:
    """Stable random ordering key; the same ids give the same order on any cluster."""
    return F.md5(F.concat_ws(":", *[p if isinstance(p, Column) else F.col(p) for p in parts]))
