"""Scalar functions as Column expressions: strict parsing, activations, primitives, splines, schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number as a cell may write it; anything else is text, also what a lenient cast would take.
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
#: The primitives in order of preference.
PRIMITIVES = ("x", "x^2", "x^3", "sqrt", "exp", "log", "1/x", "sin", "tanh")


#: The blanks of Unicode, and the least number that rounds to an infinite one of 32 bits.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
INFINITE = 3.4028235677973366e38


def trimmed(cell: Column) -> Column:
    return F.btrim(cell, F.lit(BLANKS))


def is_missing(cell: Column) -> Column:
    return trimmed(F.coalesce(cell, F.lit(""))) == ""


def parse_number(cell: Column) -> Column:
    """The cell's value, or null where it is missing, text or not finite as a 32-bit number."""
    text = trimmed(cell)
    value = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(F.abs(value) < INFINITE, value)


def is_number(cell: Column) -> Column:
    return parse_number(cell).isNotNull()


def parse_code(cell: Column, levels: list[str], codes_allowed: bool) -> Column:
    """Position of a level; with ``codes_allowed`` also a whole number within 1e-4 below the number of levels."""
    named = F.array_position(F.array(*map(F.lit, levels)), trimmed(cell)) - 1
    number = parse_number(cell)
    code = F.when((F.abs(number - F.round(number)) <= 1e-4) & F.round(number).between(0, len(levels) - 1), F.round(number).cast("int"))
    return F.coalesce(F.when(named >= 0, named.cast("int")), code if codes_allowed else F.lit(None).cast("int"))


def gelu(x: Column) -> Column:
    inner = F.lit(math.sqrt(2.0 / math.pi)) * (x + F.lit(0.044715) * x * x * x)
    return F.lit(0.5) * x * (F.lit(1.0) + F.tanh(inner))


def primitive(name: str, u: Column) -> Column:
    """One of nine primitives, kept finite everywhere: exp up to 15, log from 1e-6, 1/x from 1e-3 away from nought."""
    return {
        "x": lambda: u, "x^2": lambda: u * u, "x^3": lambda: u * u * u,
        "sqrt": lambda: F.sqrt(F.greatest(u, F.lit(0.0))), "exp": lambda: F.exp(F.least(u, F.lit(15.0))),
        "log": lambda: F.log(F.greatest(u, F.lit(1e-6))),
        "1/x": lambda: F.lit(1.0) / F.when(F.abs(u) > 1e-3, u).otherwise(F.when(u < 0, F.lit(-1e-3)).otherwise(F.lit(1e-3))),
        "sin": lambda: F.sin(u), "tanh": lambda: F.tanh(u), "const": lambda: F.lit(0.0) * u,
    }[name]()


def in_domain(name: str, u: Column) -> Column:
    """Where a primitive may be fitted: outside of it the value is only a stand-in."""
    return {"sqrt": u >= 0, "exp": u < 15, "log": u > 1e-4, "1/x": F.abs(u) > 1e-3}.get(name, u.isNotNull())


def affine_edge(name: str, x: Column, a: float, b: float, c: float, d: float) -> Column:
    """a * f(b x + c) + d."""
    return F.lit(a) * primitive(name, F.lit(b) * x + F.lit(c)) + F.lit(d)


def knots(grid: int, low: float = -3.0, high: float = 3.0, degree: int = 3) -> list[float]:
    step = (high - low) / grid
    return [low + step * (i - degree) for i in range(grid + 2 * degree + 1)]


def bspline(x: Column, grid: int, low: float = -3.0, high: float = 3.0, degree: int = 3) -> list[Column]:
    """Cubic B-spline basis: ``grid + degree`` columns, all nought outside of the extended knots.

    On equal knots the recursion has one closed form per piece, so each basis is a polynomial of the distance to
    its centre instead of a tree of recursive terms.
    """
    step = (high - low) / grid
    out = []
    for i in range(grid + degree):
        centre = low + step * (i - degree + 2)
        t = F.abs(x - F.lit(centre)) / F.lit(step)
        near = F.lit(2.0 / 3.0) - t * t + F.lit(0.5) * t * t * t
        rest = (F.lit(2.0) - t) * (F.lit(2.0) - t) * (F.lit(2.0) - t) / F.lit(6.0)
        out.append(F.when(t < 1, near).when(t < 2, rest).otherwise(F.lit(0.0)))
    return out


def warmup_cosine(step: Column, warmup: int, total: int, least: float) -> Column:
    """Share of the base rate: linear to 1 over ``warmup`` steps, then cosine down to ``least``."""
    progress = F.least(F.lit(1.0), (step - F.lit(float(warmup))) / F.lit(float(max(1, total - warmup))))
    wave = F.lit(least) + F.lit(1.0 - least) * F.lit(0.5) * (F.lit(1.0) + F.cos(F.lit(math.pi) * progress))
    return F.when(step < warmup, (step + F.lit(1.0)) / F.lit(float(max(1, warmup)))).otherwise(wave)
