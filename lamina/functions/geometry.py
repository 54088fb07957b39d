"""Scalar geometry on box columns x0, y0, x1, y1, as Column expressions that stay inside whole-stage code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("x0", "y0", "x1", "y1")


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    """The four box columns of an alias, or of the frame itself."""
    dot = f"{prefix}." if prefix else ""
    return tuple(F.col(f"{dot}{c}") for c in BOX)  # type: ignore[return-value]


def width(p: str = "") -> Column:
    x0, _, x1, _ = box(p)
    return x1 - x0


def height(p: str = "") -> Column:
    _, y0, _, y1 = box(p)
    return y1 - y0


def area(p: str = "") -> Column:
    return width(p).cast("long") * height(p).cast("long")


def perimeter(p: str = "") -> Column:
    return 2 * (width(p).cast("long") + height(p).cast("long"))


def touches(a: str, b: str, d: int = 0) -> Column:
    """Closed boxes meet, ``a`` enlarged by ``d``."""
    ax0, ay0, ax1, ay1 = box(a)
    bx0, by0, bx1, by1 = box(b)
    return (ax0 - d <= bx1) & (bx0 <= ax1 + d) & (ay0 - d <= by1) & (by0 <= ay1 + d)


def overlaps(a: str, b: str) -> Column:
    """Boxes share area; a common border does not count."""
    ax0, ay0, ax1, ay1 = box(a)
    bx0, by0, bx1, by1 = box(b)
    return (ax0 < bx1) & (bx0 < ax1) & (ay0 < by1) & (by0 < ay1)


def inside(a: str, b: str) -> Column:
    """``a`` lies in ``b``; a shared border is still inside."""
    ax0, ay0, ax1, ay1 = box(a)
    bx0, by0, bx1, by1 = box(b)
    return (ax0 >= bx0) & (ax1 <= bx1) & (ay0 >= by0) & (ay1 <= by1)


def empty(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return (x1 < x0) | (y1 < y0)


def is_point(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return (x0 == x1) & (y0 == y1)


def enlarged(dx: int, dy: int) -> list[Column]:
    x0, y0, x1, y1 = box()
    return [(x0 - dx).alias("x0"), (y0 - dy).alias("y0"), (x1 + dx).alias("x1"), (y1 + dy).alias("y1")]


def snapped(c: Column, grid: int) -> Column:
    """The nearest multiple of ``grid``, halves up, in whole numbers."""
    return (F.floor((2 * c + grid) / F.lit(2 * grid)) * grid).cast("int")


def off_grid(c: Column, grid: int) -> Column:
    return c % grid != 0


def moved(dx: int, dy: int) -> list[Column]:
    x0, y0, x1, y1 = box()
    return [(x0 + dx).alias("x0"), (y0 + dy).alias("y0"), (x1 + dx).alias("x1"), (y1 + dy).alias("y1")]


def rotated(quarter: int, mirror: bool = False) -> list[Column]:
    """Box of the shape after an optional mirroring at the x axis and ``quarter`` turns to the left."""
    x0, y0, x1, y1 = box()
    if mirror:
        y0, y1 = -y1, -y0
    for _ in range(quarter % 4):
        x0, y0, x1, y1 = -y1, x0, -y0, x1
    return [c.cast("int").alias(n) for c, n in zip((x0, y0, x1, y1), BOX, strict=True)]


def glob_regex(pattern: str) -> str:
    """A glob with ``*``, ``?``, ``[...]`` and ``{a,b}`` as an anchored regular expression."""
    out, depth, k = [], 0, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in pattern[k + 2 :]:
            end = pattern.index("]", k + 2)
            inner = pattern[k + 1 : end]
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]")
            k = end
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
        k += 1
    return "^" + "".join(out) + "$"


def matches_glob(c: Column, pattern: str) -> Column:
    return c.rlike(glob_regex(pattern))


#: Unit suffixes of lengths and areas, in micrometres.
UNITS = {"nm": 1e-3, "um": 1.0, "mic": 1.0, "micron": 1.0, "mm": 1e3, "m": 1e6}


def to_dbu(literal: str, dbu: float) -> int:
    """A literal such as ``1um`` or ``2um2`` in database units; it must be a whole number of them."""
    m = re.fullmatch(r"([-+]?[0-9.]+)\s*(nm|um|micron|mic|mm|m)(2?)", literal.strip())
    if not m:
        raise ValueError(f"not a length: {literal}")
    power = 2 if m[3] else 1
    value = float(m[1]) * (UNITS[m[2]] / dbu) ** power
    if abs(value - round(value)) > 1e-6:
        raise ValueError(f"{literal} is not a multiple of the database unit {dbu}")
    return round(value)
