"""Column expressions of decoding arithmetic; all stay in whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pow2(s: Column) -> Column:
    return F.expr("1L") * F.call_function("shiftleft", F.lit(1).cast("long"), s)


def ceil_shift(v: Column, s: Column) -> Column:
    """v / 2**s rounded up, for v >= 0; shifts of 32 and more leave whether anything was there."""
    part = F.call_function("shiftright", v.cast("long") + F.call_function("shiftleft", F.lit(1).cast("long"), F.least(s, F.lit(32))) - 1, F.least(s, F.lit(32)))
    return F.when(s >= 32, (v > 0).cast("long")).otherwise(part)


def ceil_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a.cast("long") + b - 1, b) if isinstance(b, Column) else F.floor((a.cast("long") + b - 1) / b).cast("long")


def floor_shift(v: Column, s: Column) -> Column:
    return F.call_function("shiftright", v.cast("long"), s)


def step_size(depth: Column, gain: Column, exponent: Column, mantissa: Column) -> Column:
    return (F.pow(F.lit(2.0), depth + gain - exponent).cast("float") * (F.lit(1.0).cast("float") + mantissa.cast("float") / F.lit(2048.0).cast("float")).cast("float")).cast("float")


def planes(guard: Column, exponent: Column) -> Column:
    return F.greatest(guard + exponent - 1, F.lit(0))


def rct_inverse(y: Column, u: Column, v: Column) -> dict[str, Column]:
    """Floors, unlike division by ``div``, which truncates."""
    g = y - F.call_function("shiftright", u + v, F.lit(2))
    return {"r": v + g, "g": g, "b": u + g}


def rct_forward(r: Column, g: Column, b: Column) -> dict[str, Column]:
    return {"y": F.call_function("shiftright", r + 2 * g + b, F.lit(2)), "u": b - g, "v": r - g}


def ict_inverse(y: Column, cb: Column, cr: Column) -> dict[str, Column]:
    """In single precision, rounded half away from zero as Spark's ``round`` does."""
    f = lambda x: F.lit(x).cast("float")
    y, cb, cr = y.cast("float"), cb.cast("float"), cr.cast("float")
    return {"r": F.round(y + f(1.402) * cr).cast("int"), "g": F.round(y - f(0.344136) * cb - f(0.714136) * cr).cast("int"), "b": F.round(y + f(1.772) * cb).cast("int")}


def level_shift_clamp(v: Column, depth: Column, signed: Column) -> Column:
    half = F.call_function("shiftleft", F.lit(1).cast("long"), depth - 1)
    low = F.when(signed, -half).otherwise(F.lit(0).cast("long"))
    return F.least(F.greatest(F.when(signed, v).otherwise(v + half), low), low + 2 * half - 1)


def export_scale8(v: Column, depth: Column, signed: Column) -> Column:
    top = F.call_function("shiftleft", F.lit(1).cast("long"), depth) - 1
    x = F.least(F.greatest(v + F.when(signed, F.call_function("shiftleft", F.lit(1).cast("long"), depth - 1)).otherwise(F.lit(0).cast("long")), F.lit(0).cast("long")), top)
    return F.call_function("div", x * 255, top)


def pass_kind(index: Column) -> Column:
    return F.when((index == 0) | (index % 3 == 0), "cleanup").when(index % 3 == 1, "significance").otherwise("refinement")


def ends_segment(index: Column, style: Column) -> Column:
    """The rule of ``kernels.blocks.ends_segment`` as a column."""
    bypass = (style.bitwiseAND(1) != 0) & ((index == 9) | ((index > 9) & ((index - 10) % 3 != 0)))
    return (style.bitwiseAND(4) != 0) | bypass


def step_index(steps: Column, at: Column) -> Column:
    """The step of a band, or the last one where the list is too short."""
    return F.coalesce(F.get(steps, at), F.element_at(steps, -1))


def sample(values: Column, at: Column) -> Column:
    """An element, 0 outside."""
    return F.coalesce(F.get(values, at), F.lit(0))
