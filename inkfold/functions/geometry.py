"""Integer geometry as Column expressions: milli-units, rectangles, classes by cross-multiplied integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floordiv(a: Column, b: Column | int) -> Column:
    """Division that rounds down, also below zero."""
    b = F.lit(b) if isinstance(b, int) else b
    return ((a - F.pmod(a, b)) / b).cast("long")


def mu(v: Column) -> Column:
    """Milli-units, half up."""
    return F.floor(v * 1000.0 + 0.5).cast("long")


def scaled(v: Column, scale: Column | int) -> Column:
    """A coordinate as an integer: nearest even at scale 1, else half up."""
    scale = F.lit(scale) if isinstance(scale, int) else scale
    return F.when(scale == 1, F.bround(v, 0)).otherwise(F.floor(v * scale + 0.5)).cast("long")


def mu_to_scale(v: Column, scale: Column | int) -> Column:
    scale = F.lit(scale) if isinstance(scale, int) else scale
    return floordiv(v * scale + 500, 1000)


def quad(poly: Column) -> Column:
    """Eight numbers as they are, four as a rectangle, another even count of six or more as its extent, else null."""
    xs = F.filter(poly, lambda _, i: i % 2 == 0)
    ys = F.filter(poly, lambda _, i: i % 2 == 1)
    box = lambda a, b, c, d: F.array(a, b, c, b, c, d, a, d)
    n = F.size(poly)
    return (
        F.when(poly.isNull() | (n < 4), F.lit(None))
        .when(n == 8, poly)
        .when(n == 4, box(poly[0], poly[1], poly[2], poly[3]))
        .when((n >= 6) & (n % 2 == 0), box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))
    )


def rect(q: Column, scale: Column | int = 1) -> Column:
    """The integer rectangle of a quad; null without eight numbers."""
    xs = F.transform(F.filter(q, lambda _, i: (i % 2 == 0) & (i < 8)), lambda v: scaled(v, scale))
    ys = F.transform(F.filter(q, lambda _, i: (i % 2 == 1) & (i < 8)), lambda v: scaled(v, scale))
    s = F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))
    return F.when(F.size(q) >= 8, s)


def lower_quantile(values: Column, part: int) -> Column:
    """The exact order statistic (n - 1) div part of an array."""
    s = F.array_sort(values)
    return F.element_at(s, ((F.size(s) - 1) / part).cast("int") + 1)


def height_class(h: Column, em: Column) -> Column:
    return F.when((em <= 0) | (h <= 0), "body").when(100 * h < 85 * em, "small").when(100 * h >= 180 * em, "display").when(100 * h >= 125 * em, "large").otherwise("body")


def alignment(x0: Column, x1: Column, em: Column, content_x0: Column, content_x1: Column) -> Column:
    left, right = x0 - content_x0, content_x1 - x1
    return (
        F.when(x0.isNull() | (em <= 0) | content_x0.isNull() | content_x1.isNull() | (left < 0) | (right < 0), "unknown")
        .when((left <= em) & (right <= em), "justified")
        .when(left <= em, "left")
        .when(right <= em, "right")
        .when(F.abs(left - right) <= em, "center")
        .otherwise("unknown")
    )


def width_class(w: Column, page_w: Column) -> Column:
    return (
        F.when((page_w <= 0) | (w <= 0) | (16 * w < page_w), "lt_1_16")
        .when(8 * w < page_w, "lt_1_8")
        .when(4 * w < page_w, "lt_1_4")
        .when(2 * w < page_w, "lt_1_2")
        .when(4 * w < 3 * page_w, "lt_3_4")
        .otherwise("ge_3_4")
    )


def char_class(n: Column) -> Column:
    return F.when(n < 8, "xs").when(n < 32, "s").when(n < 128, "m").when(n < 512, "l").otherwise("xl")


def line_class(n: Column) -> Column:
    return F.when(n <= 1, "one").when(n <= 3, "two_three").otherwise("four_plus")


def grid_pm(p: Column, extent: Column) -> Column:
    """Permille of a place within an extent, on a grid of one percent."""
    c = F.least(F.greatest(p, F.lit(0)), extent)
    return F.when(extent > 0, F.least(((200 * c + extent) / (2 * extent)).cast("long"), F.lit(100)) * 10)


def spans_overlap(a_off: Column, a_len: Column, b_off: Column, b_len: Column) -> Column:
    return (a_off < b_off + F.greatest(b_len, F.lit(1))) & (b_off < a_off + F.greatest(a_len, F.lit(1)))
