"""Boxes, matrices and scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shared_area(a: tuple, b: tuple) -> Column:
    """Area of the intersection of two boxes (x, y, x2, y2)."""
    wide = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    high = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return wide * high


def area(a: tuple) -> Column:
    return (a[2] - a[0]) * (a[3] - a[1])


def overlap_ratio(a: tuple, b: tuple) -> Column:
    """Shared area over the first box's area (null where that is empty)."""
    return F.try_divide(shared_area(a, b), area(a))


def iou(a: tuple, b: tuple) -> Column:
    both = shared_area(a, b)
    return F.try_divide(both, area(a) + area(b) - both)


def overlaps(a: tuple, b: tuple) -> Column:
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def y_overlap_of_lower(a: tuple, b: tuple) -> Column:
    """Shared height over the smaller height."""
    both = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return F.try_divide(both, F.least(a[3] - a[1], b[3] - b[1]))


def gap_distance(a: tuple, b: tuple) -> Column:
    """Euclidean length of the gaps between two boxes along the axes."""
    dx = F.greatest(F.lit(0.0), b[0] - a[2], a[0] - b[2])
    dy = F.greatest(F.lit(0.0), b[1] - a[3], a[1] - b[3])
    return F.sqrt(dx * dx + dy * dy)


def box(prefix: str = "") -> tuple:
    return tuple(F.col(f"{prefix}{c}") for c in ("x", "y", "x2", "y2"))


def clip(v: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(v, high))


def multiply(m: list[Column], n: list[Column]) -> list[Column]:
    """Product of two affine matrices (a, b, c, d, e, f)."""
    a, b, c, d, e, f = m
    a2, b2, c2, d2, e2, f2 = n
    return [a * a2 + c * b2, b * a2 + d * b2, a * c2 + c * d2, b * c2 + d * d2, a * e2 + c * f2 + e, b * e2 + d * f2 + f]


def rotation(a: Column, b: Column) -> Column:
    return F.degrees(F.atan2(b, a))


def applied(m: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """A point under an affine matrix."""
    a, b, c, d, e, f = m
    return a * x + c * y + e, b * x + d * y + f


def inverted(m: list[Column]) -> list[Column]:
    """The inverse of an affine matrix; nulls where it has none."""
    a, b, c, d, e, f = m
    det = a * d - b * c
    part = lambda v: F.try_divide(v, det)
    return [part(d), part(-b), part(-c), part(a), part(c * f - d * e), part(b * e - a * f)]


def decomposed(m: list[Column]) -> dict[str, Column]:
    """Translation, rotation in degrees, scales and shear in degrees of an affine matrix."""
    a, b, c, d, e, f = m
    wide = F.hypot(a, b)
    across = F.try_divide(a * c + b * d, wide)
    return {"tx": e, "ty": f, "angle": rotation(a, b), "sx": wide, "sy": F.try_divide(a * d - b * c, wide), "shear": F.degrees(F.atan2(across, F.try_divide(a * d - b * c, wide)))}


def scaled_to(old: tuple, new: tuple) -> dict[str, Column]:
    """The translation and the scale that bring one box to another: by widths, by heights where the old one has no width."""
    scale = F.coalesce(F.try_divide(new[2] - new[0], F.nullif(old[2] - old[0], F.lit(0.0))), F.try_divide(new[3] - new[1], F.nullif(old[3] - old[1], F.lit(0.0))), F.lit(1.0))
    return {"scale": scale, "tx": new[0] - old[0] * scale, "ty": new[1] - old[1] * scale}


def relocated(box_: tuple, origin: tuple, x: Column, y: Column, scale: Column, dx: Column | float = 0.0, dy: Column | float = 0.0) -> tuple[Column, ...]:
    """A box whose place within a unit (from the unit's origin, with a formula's offsets) is scaled and set at a new origin."""
    left, low = x + (box_[0] - origin[0] + dx) * scale, y + (box_[1] - origin[1] + dy) * scale
    return left, low, left + (box_[2] - box_[0]) * scale, low + (box_[3] - box_[1]) * scale


def holds_vertically(a: tuple, b: tuple) -> Column:
    """Whether one of two boxes lies within the other's height."""
    return (a[1] >= b[1]) & (a[3] <= b[3]) | (b[1] >= a[1]) & (b[3] <= a[3])


def holds_in_x(a: tuple, b: tuple) -> Column:
    return (a[0] >= b[0]) & (a[2] <= b[2]) | (b[0] >= a[0]) & (b[2] <= a[2])


def meets_in_y(a: tuple, b: tuple, slack: float = 1.0) -> Column:
    return (a[1] <= b[3] + slack) & (b[1] <= a[3] + slack)


def beside_in_x(a: tuple, b: tuple, most: float = 2.0) -> Column:
    return (F.abs(a[2] - b[0]) <= most) | (F.abs(b[2] - a[0]) <= most)


def y_iou(a: tuple, b: tuple) -> Column:
    """Shared height over joint height."""
    both = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return F.try_divide(both, F.greatest(a[3], b[3]) - F.least(a[1], b[1]))
