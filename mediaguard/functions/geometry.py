"""Quads, boxes, strips and tiles as struct arithmetic."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from mediaguard import fixed


def order_quad(q: Column) -> Column:
    """Corners as top-left, top-right, bottom-right, bottom-left, whatever order came in.

    The sum x+y is least at the top-left and largest at the bottom-right; the difference
    y-x is least at the top-right and largest at the bottom-left.  The first corner wins a tie.
    """
    n = F.size(q) - 1

    def pick(score, largest):
        # array_min over (score, position): position breaks ties in input order
        keyed = F.transform(q, lambda p, i: F.struct(
            (-score(p) if largest else score(p)).alias("s"), i.alias("i")))
        return F.element_at(q, F.array_min(keyed)["i"] + 1)

    total, slope = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])
    return F.when(n == 3, F.array(pick(total, False), pick(slope, False),
                                  pick(total, True), pick(slope, True)))


def edge(q: Column, i: int, j: int) -> Column:
    return F.hypot(q[i]["x"] - q[j]["x"], q[i]["y"] - q[j]["y"])


def quad_area(q: Column) -> Column:
    """Shoelace area of four ordered corners."""
    terms = [q[i]["x"] * q[(i + 1) % 4]["y"] - q[(i + 1) % 4]["x"] * q[i]["y"] for i in range(4)]
    return F.abs(terms[0] + terms[1] + terms[2] + terms[3]) / 2.0


def quad_size(q: Column) -> tuple[Column, Column]:
    """Longer of the two opposite edges in each direction: (width, height)."""
    return (F.greatest(edge(q, 1, 0), edge(q, 2, 3)), F.greatest(edge(q, 3, 0), edge(q, 2, 1)))


def strip_width(w: Column, h: Column) -> Column:
    """Width of the rectified strip, or null when the region is too small for a glyph."""
    raw = F.bround(fixed.STRIP_HEIGHT * w / h, 0)
    clipped = F.greatest(F.least(raw, F.lit(float(fixed.STRIP_MAX))), F.lit(float(fixed.STRIP_MIN)))
    return F.when((h >= fixed.MIN_GLYPH_PX) & (w >= fixed.MIN_GLYPH_PX), clipped.cast("int"))


def bbox(q: Column) -> Column:
    xs, ys = F.transform(q, lambda p: p["x"]), F.transform(q, lambda p: p["y"])
    x0, y0 = F.array_min(xs), F.array_min(ys)
    return F.struct(F.rint(x0).cast("int").alias("x"), F.rint(y0).cast("int").alias("y"),
                    F.rint(F.array_max(xs) - x0).cast("int").alias("width"),
                    F.rint(F.array_max(ys) - y0).cast("int").alias("height"))


def tile_offsets(width: Column) -> Column:
    """Left edges of up to three square tiles; a narrow strip is one padded tile at 0."""
    side = fixed.STRIP_HEIGHT
    n = F.least(F.lit(3), F.greatest(F.lit(1), F.bround(width / side, 0).cast("int")))
    span = (width - side).cast("double")
    spaced = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(n == 1, 0.0).otherwise(
        F.rint(i * span / F.greatest(n - 1, F.lit(1)))).cast("int"))
    return F.when(width <= side, F.array(F.lit(0))).otherwise(spaced)
