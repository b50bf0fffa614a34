"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def count_if(condition: Column) -> Column:
    """``COUNT(*) FILTER (WHERE condition)``: 0, never null, for an empty group."""
    return F.count(F.when(condition, F.lit(1)))


def safe_div(numerator: Column, denominator: Column) -> Column:
    """Division that is null where the denominator is zero or null."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def zero_div(numerator: Column, denominator: Column) -> Column:
    """Division that is 0.0 where the denominator is zero or null."""
    return F.coalesce(safe_div(numerator, denominator), F.lit(0.0))


def clip(value: Column | str, low: float, high: float) -> Column:
    """Limit to ``[low, high]``; a null stays null (least/greatest skip nulls)."""
    v = col(value)
    return F.when(v.isNotNull(), F.greatest(F.lit(float(low)), F.least(v, F.lit(float(high)))))


def logit(probability: Column | str, epsilon: float = 1e-6) -> Column:
    """Log odds of a probability clipped away from 0 and 1."""
    p = clip(probability, epsilon, 1.0 - epsilon)
    return F.log(p / (1.0 - p))


def active_on(start: Column | str, end: Column | str, as_of: Column) -> Column:
    """Interval contains ``as_of``: started on or before it, ends strictly later."""
    return (col(start) <= as_of) & (col(end).isNull() | (col(end) > as_of))


def calendar_months(later: Column, earlier: Column, floor_zero: bool = False) -> Column:
    """Whole calendar months between two dates; the day of the month is ignored."""
    months = (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)
    return F.greatest(F.lit(0), months) if floor_zero else months


def cut(
    value: Column | str,
    edges: Sequence[float | None],
    labels: Sequence[str | int],
    *,
    right: bool = False,
    include_lowest: bool = False,
) -> Column:
    """Label the interval between fixed edges; outside all of them the result is null.

    Left-closed by default, ``right=True`` closes the right edge instead.
    ``include_lowest`` closes the outermost edge that would be open. ``None``
    as first or last edge means unbounded.
    """
    if len(edges) != len(labels) + 1:
        raise ValueError("cut needs one more edge than labels")
    v = col(value)
    out = F.when(v.isNull(), F.lit(None))
    last = len(labels) - 1
    for i, label in enumerate(labels):
        low, high = edges[i], edges[i + 1]
        condition = F.lit(True)
        if low is not None:
            closed = not right or (include_lowest and i == 0)
            condition = condition & ((v >= low) if closed else (v > low))
        if high is not None:
            closed = right or (include_lowest and i == last)
            condition = condition & ((v <= high) if closed else (v < high))
        out = out.when(condition, F.lit(label))
    return out


def missing_label(value: Column | str, label: str = "Missing") -> Column:
    return F.coalesce(col(value).cast("string"), F.lit(label))


def band(value: Column | str, high: Column, medium: Column) -> Column:
    """High / Medium / Low by two thresholds, both inclusive."""
    v = col(value)
    return F.when(v >= high, "High").when(v >= medium, "Medium").otherwise("Low")


def boolean_text(value: Column | str, default: str = "False") -> Column:
    """Title-cased boolean text; anything that is no boolean becomes ``default``."""
    text = F.initcap(F.trim(col(value).cast("string")))
    return F.when(text.isin("True", "False"), text).otherwise(F.lit(default))


def normal_z(confidence: float) -> float:
    return NormalDist().inv_cdf(0.5 + confidence / 2.0)


def wilson(successes: Column, trials: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Score interval of a proportion clipped to [0, 1]; null where there are no trials."""
    z = normal_z(confidence)
    n = trials.cast("double")
    p = safe_div(successes, n)
    shrink = 1.0 + F.lit(z * z) / F.nullif(n, F.lit(0.0))
    centre = (p + F.lit(z * z) / F.nullif(2.0 * n, F.lit(0.0))) / shrink
    half = (
        F.lit(z)
        * F.sqrt(p * (1.0 - p) / F.nullif(n, F.lit(0.0)) + F.lit(z * z) / F.nullif(4.0 * n * n, F.lit(0.0)))
        / shrink
    )
    return clip(centre - half, 0.0, 1.0), clip(centre + half, 0.0, 1.0)


def draw(*parts: Column | str) -> Column:
    """Non-negative 60-bit draw from the md5 of the parts joined by ``|``.

    The text form is the same in every engine, so a draw can be repeated outside Spark.
    """
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def exact_mean(value: Column | str, decimals: int = 2) -> Column:
    """Mean of an amount added up as a decimal, then rounded half up: independent of row order."""
    return F.round(F.avg(col(value).cast("decimal(28,10)")), decimals).cast("double")


def transform_feature(raw: Column | str, spec: dict) -> Column:
    """Configured feature transform: binary, capped_count, z_score or robust_z_score."""
    value = col(raw).cast("double")
    kind = spec["type"]
    if kind == "binary":
        return F.when(value.isNotNull() & (value != 0.0), 1.0).otherwise(0.0)
    if kind == "capped_count":
        return F.least(value, F.lit(float(spec["maximum"])))
    if kind == "z_score":
        value = (value - float(spec["center"])) / float(spec["scale"])
    elif kind != "robust_z_score":
        raise ValueError(f"unknown feature transform: {kind}")
    return clip(value, spec["minimum"], spec["maximum"])


def latest(values: Sequence[str], order: Sequence[Column | str]) -> Column:
    """Struct of ``values`` from the row with the greatest ``order`` tuple."""
    return F.max_by(F.struct(*values), F.struct(*order))


def earliest(values: Sequence[str], order: Sequence[Column | str]) -> Column:
    return F.min_by(F.struct(*values), F.struct(*order))
