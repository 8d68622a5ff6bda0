"""Classification of recovered metadata and the verdict over one file's fields."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from mediaguard import fixed

MARKERS = ([("ai", m) for m in fixed.AI_MARKERS] + [("camera", m) for m in fixed.CAMERA_MARKERS]
           + [("editor", m) for m in fixed.EDITOR_MARKERS])


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def marker(column: str) -> Column:
    """STRUCT<kind, marker> of the first marker in list order that the value holds, else null.

    The value is lowered once and bound to a lambda variable for all the tests; parsing one
    SQL string also spares building some two hundred column objects.
    """
    tests = " ".join(f"WHEN contains(t, '{m}') THEN named_struct('kind', '{kind}', 'marker', '{m}')" for kind, m in MARKERS)
    return F.expr(f"transform(array(lower(`{column}`)), t -> CASE {tests} END)[0]")


def marker_kind(value: str) -> Column:
    return marker(value)["kind"]


def marker_hit(value: str) -> Column:
    return marker(value)["marker"]


def png_generator(key) -> Column:
    known = F.create_map(*[F.lit(v) for kv in fixed.PNG_GENERATOR_KEYS.items() for v in kv])
    return known[F.lower(_c(key))]


def png_kind(key, value: str) -> Column:
    """A known generator key decides; otherwise the value does."""
    return F.when(png_generator(key).isNotNull(), "ai").otherwise(marker_kind(value))


def verdict(kinds, has_c2pa, n_fields) -> Column:
    kinds = _c(kinds)
    return (F.when(F.array_contains(kinds, "ai"), "ai_declared")
            .when(_c(has_c2pa), "c2pa_present")
            .when(F.array_contains(kinds, "camera"), "camera_declared")
            .when(F.array_contains(kinds, "editor"), "editor_declared")
            .when(_c(n_fields) > 0, "metadata_only").otherwise("none"))


def summary(verdict_col, asserts_iptc, first_claims) -> Column:
    """One sentence per verdict; ``first_claims`` is the joined ``key=value`` of two AI fields."""
    v = _c(verdict_col)
    return (F.when((v == "ai_declared") & _c(asserts_iptc), fixed.SUMMARY_IPTC)
            .when(v == "ai_declared", F.concat(
                F.lit(fixed.SUMMARY_AI_HEAD), _c(first_claims), F.lit(fixed.SUMMARY_AI_TAIL)))
            .when(v == "c2pa_present", fixed.SUMMARY_C2PA)
            .when(v == "camera_declared", fixed.SUMMARY_CAMERA)
            .when(v == "editor_declared", fixed.SUMMARY_EDITOR)
            .when(v == "metadata_only", fixed.SUMMARY_METADATA).otherwise(fixed.SUMMARY_NONE))
