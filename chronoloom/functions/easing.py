"""Easing curves and interpolation as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the bounce curve: curvature, and for each piece its end, centre (in units of 1/2.75) and floor.
BOUNCE_CURVATURE, BOUNCE_UNIT = 7.5625, 2.75
BOUNCE_PIECES = ((1.0, 0.0, 0.0), (2.0, 1.5, 0.75), (2.5, 2.25, 0.9375), (None, 2.625, 0.984375))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once and hand it to ``body`` as a bound variable; expressions would be copied instead."""
    return F.element_at(F.transform(F.array(value), body), 1)


def linear(t: Column) -> Column:
    return t


def bounce(t: Column) -> Column:
    """Four parabolas, each bounce lower than the one before."""
    out = None
    for end, centre, floor in reversed(BOUNCE_PIECES):
        x = t - F.lit(centre / BOUNCE_UNIT)
        piece = F.lit(BOUNCE_CURVATURE) * x * x + F.lit(floor)
        out = piece if out is None else F.when(t < F.lit(end / BOUNCE_UNIT), piece).otherwise(out)
    return out


def _bezier(t: Column, a: Column, b: Column) -> Column:
    """A cubic Bezier curve from 0 to 1 with the inner controls a and b."""
    s = F.lit(1.0) - t
    return 3 * s * s * t * a + 3 * s * t * t * b + t * t * t


def cubic_bezier(progress: Column, x1, y1, x2, y2, steps: int = 60) -> Column:
    """Height of the curve where its x is ``progress``, from 0 to 1.

    With x controls between 0 and 1 the curve's x rises with its parameter, so
    halving an interval finds it to the last bit, inside one expression.
    """
    x1, y1, x2, y2 = (c if isinstance(c, Column) else F.lit(float(c)) for c in (x1, y1, x2, y2))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        below = _bezier(mid, x1, x2) < progress
        return F.struct(F.when(below, mid).otherwise(s["lo"]).alias("lo"), F.when(below, s["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    height = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: _bezier((s["lo"] + s["hi"]) / 2, y1, y2))
    inner = F.greatest(F.lit(0.0), F.least(F.lit(1.0), height))
    return F.when(F.abs(progress) < 1e-7, 0.0).when(F.abs(progress - 1) < 1e-7, 1.0).otherwise(inner)


def first_root(p0: Column, p1: Column, p2: Column, p3: Column, slack: float = 1e-7) -> Column:
    """The parameter from 0 to 1 at which a cubic Bezier curve with these controls is zero; NaN if there is none.

    Of several the first in the order of Cardano's formulas: for three real
    roots by the angles 0, 120 and 240 degrees.
    """
    zero, over, nan = (lambda x: F.abs(x) < slack), F.try_divide, F.lit(float("nan"))
    cubic = F.struct((3 * (p0 - 2 * p1 + p2)).alias("a"), (3 * (p1 - p0)).alias("b"), p0.alias("c"), (-p0 + 3 * (p1 - p2) + p3).alias("d"))

    def options(x: Column) -> Column:
        a, b, c, d = (x[n] for n in "abcd")
        straight = F.when(zero(b), F.array(nan)).otherwise(F.array(over(-c, b)))
        parabola = let(F.sqrt(b * b - 4 * a * c), lambda root: F.array(over(root - b, 2 * a), over(-root - b, 2 * a)))
        return F.when(zero(d) & zero(a), straight).when(zero(d), parabola).otherwise(let(F.struct(over(a, d).alias("a"), over(b, d).alias("b"), over(c, d).alias("c")), reduced))

    def reduced(x: Column) -> Column:
        a, b, c = (x[n] for n in "abc")
        return let(F.struct((a / 3).alias("third"), ((3 * b - a * a) / 9).alias("q"), ((2 * a * a * a - 9 * a * b + 27 * c) / 54).alias("r")), lambda y: let(y["r"] * y["r"] + y["q"] * y["q"] * y["q"], lambda rest: by_sign(y["third"], y["q"], y["r"], rest)))

    def by_sign(third: Column, q: Column, r: Column, rest: Column) -> Column:
        angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), over(-r, F.sqrt(-q * q * q)))))
        three = let(angle, lambda t: F.array(*[2 * F.sqrt(-q) * F.cos((t + turn * 2 * math.pi) / 3) - third for turn in range(3)]))
        two = F.array(-2 * F.cbrt(r) - third, F.cbrt(r) - third)
        return F.when(rest < 0, three).when(rest == 0, two).otherwise(F.array(F.cbrt(F.sqrt(rest) - r) - F.cbrt(F.sqrt(rest) + r) - third))

    inside = F.filter(let(cubic, options), lambda t: (t >= -slack) & (t <= 1 + slack))
    return let(F.get(inside, 0), lambda t: F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)), nan))


def cubic_bezier_any(progress: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """:func:`cubic_bezier` for x controls of any size, where a curve may have several heights or none: then 1."""
    height = lambda t: F.when(F.isnan(t), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), _bezier(t, y1, y2))))
    inner = let(first_root(-progress, x1 - progress, x2 - progress, 1 - progress), height)
    return F.when(F.abs(progress) < 1e-7, 0.0).when(F.abs(progress - 1) < 1e-7, 1.0).otherwise(inner)


def eased(kind: Column, t: Column, controls: tuple = (0.25, 0.1, 0.25, 1.0)) -> Column:
    return F.when(kind == "bounce", bounce(t)).when(kind == "cubic_bezier", cubic_bezier(t, *controls)).otherwise(linear(t))


def lerp(start: Column, end: Column, state: Column, whole: bool = False) -> Column:
    """Between two values; where the start is missing, the end.  Whole numbers are cut towards zero."""
    out = start + (end - start) * state
    if whole:
        out = F.when(out < 0, F.ceil(out)).otherwise(F.floor(out))
    return F.when(start.isNull() | end.isNull(), end).otherwise(out)


def lerp_side(start_kind: Column, start: Column, end_kind: Column, end: Column, state: Column) -> Column:
    """A position measured from one side; from another side it jumps to the end."""
    return F.when(start_kind == end_kind, lerp(start, end, state)).otherwise(end)


def lerp_position(start: Column, end: Column, state: Column) -> Column:
    """Struct (kind, width, height, x_side, x, y_side, y, rotation): sizes and offsets move, sides and kinds jump.

    A static position has no sides; between a static and an absolute one
    everything jumps to the end.
    """
    same = start["kind"] == end["kind"]
    go = lambda f: F.when(same, lerp(start[f], end[f], state)).otherwise(end[f]).alias(f)
    side = lambda f, k: F.when(same, lerp_side(start[k], start[f], end[k], end[f], state)).otherwise(end[f]).alias(f)
    return F.struct(end["kind"].alias("kind"), go("width"), go("height"), end["x_side"].alias("x_side"), side("x", "x_side"), end["y_side"].alias("y_side"), side("y", "y_side"), go("rotation"))


def lerp_shadows(start: Column, end: Column, state: Column) -> Column:
    """Shadows in pairs, as long as both lists have some; more of the end's as they are."""

    def one(e: Column, i: Column) -> Column:
        s = F.get(start, i)
        return F.struct(*[F.when(s.isNull(), e[f]).otherwise(lerp(s[f], e[f], state)).alias(f) for f in ("offset_x", "offset_y", "blur")], e["color"].alias("color"))

    return F.transform(end, one)


def lerp_component(start: Column, end: Column, state: Column, moving: tuple[str, ...] = ("radius", "border_width", "padding")) -> Column:
    """A view or rescaler between two states: struct (position, the ``moving`` numbers, shadows); all else is the end's.

    A rescaler has no padding: leave it out of ``moving``.
    """
    return F.struct(lerp_position(start["position"], end["position"], state).alias("position"), *[lerp(start[f], end[f], state).alias(f) for f in moving], lerp_shadows(start["shadows"], end["shadows"], state).alias("shadows"))


def transition_state(kind: Column, pts: Column, start: Column, duration: Column, offset: Column | None = None, controls: tuple = (0.25, 0.1, 0.25, 1.0), begun_kind: Column | None = None) -> Column:
    """How far a transition is, 0 to 1.

    A transition that took over from an unfinished one starts at ``offset`` of
    the curve; the part of the curve beyond the height that the unfinished one
    (of ``begun_kind``) had there is stretched to the whole range.
    """
    offset = F.lit(0.0) if offset is None else offset
    run = (pts - start) / duration
    progress = F.greatest(F.lit(0.0), F.least(F.lit(1.0), offset + run * (1 - offset)))
    begun = F.when(offset == 0, F.lit(0.0)).otherwise(eased(kind if begun_kind is None else F.coalesce(begun_kind, kind), offset, controls))
    return (eased(kind, progress, controls) - begun) / (1 - begun)


class Chain:
    """Transitions of one component, each of which may take over from the one before: (start, length, kind, offset, begun_kind)."""

    def __init__(self):
        self.now: tuple | None = None

    def __call__(self, pts: int, duration: int | None, kind: str | None, changed: bool, interrupt: bool) -> tuple:
        asked = None if duration is None or duration != duration else (pts, int(duration), kind, 0.0, None)
        if self.now and self.now[0] + self.now[1] > pts and not (changed and interrupt):
            start, length, old, *_ = self.now
            rest = start + length - pts
            self.now = (pts, rest, asked[2] if asked else old, 1 - rest / length, old)
        else:
            self.now = asked if changed else None
        return self.now or (None,) * 5


def chained(versions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add start_pts, length, curve, offset, begun_kind: the transition that each version of a component runs, null for none.

    ``versions``: pts, duration (null for no transition), kind, changed (its
    properties did), interrupt.  An unfinished transition goes on over what is
    left of its time, by the new curve if there is one, unless a change interrupts it.
    """
    from ..operators.folds import fold

    added = [("start_pts", T.LongType()), ("length", T.LongType()), ("curve", T.StringType()), ("offset", T.DoubleType()), ("begun_kind", T.StringType())]
    return fold(versions, keys, order, ["pts", "duration", "kind", "changed", "interrupt"], added, Chain)
