"""Class codes to labels."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from mediaguard.fixed import SUBCLASS_BY_CODE


def to_label(code, tampered_only: bool = False) -> Column:
    """0 real, 1 AI, null skip.  Codes may be digits or class names."""
    code = code if isinstance(code, Column) else F.col(code)
    text = F.lower(F.trim(code.cast("string")))
    number = text.try_cast("int")
    if tampered_only:
        numeric = F.when(number == 2, 1)
        named = F.when(text.contains("tamper"), 1)
    else:
        numeric = F.when(number == 0, 0).when(number == 1, 1)
        named = (F.when(text.contains("tamper"), F.lit(None).cast("int"))
                 .when(text.contains("real"), 0).otherwise(1))
    return F.when(text.rlike(r"^\d+$"), numeric).otherwise(named).cast("int")


def subclass(code) -> Column:
    code = code if isinstance(code, Column) else F.col(code)
    text = F.trim(code.cast("string"))
    names = F.create_map(*[F.lit(v) for k, name in SUBCLASS_BY_CODE.items() for v in (str(k), name)])
    return F.when(text.rlike(r"^\d+$"), names[text]).otherwise(F.lower(code.cast("string")))
