"""Time-to-event tables: cohort, product-limit curves, log-rank tests, proportional hazards, concordance.

Rows are collapsed to distinct durations before any running sum, and running sums
use duration ranges, so the cost after the first aggregate depends on the number
of distinct durations only.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.functions.expr import count_if, normal_z, safe_div
from stayline.operators.fairness import by_attribute
from stayline.operators.gram import buffers, summed_by_fit
from stayline.operators.rank import Key, RangePlan, attach, average_ranks, exact_quantiles, plan_ranges, ranked, running_totals
from stayline.operators.resample import row_folds
from stayline.session import settle

DAYS_PER_MONTH = 30.4375
HORIZONS = (6, 12, 24, 36, 48, 60)


# ---- cohort -------------------------------------------------------------------------------------


def parse_hire_notes(events: DataFrame, fields: dict[str, str], check: bool = True) -> DataFrame:
    """Integers written in the hire notes, one row per employee.

    With ``check`` a second hire event or a note that lacks a field raises.
    """
    hires = events.where(F.col("event_type") == "Hire")
    parsed = hires.select(
        "employee_id",
        *[F.nullif(F.regexp_extract("notes", f"{name}=([0-9]+)", 1), F.lit("")).try_cast("int").alias(out) for name, out in fields.items()],
    )
    if check:
        bad = F.lit(False)
        for out in fields.values():
            bad = bad | F.col(out).isNull()
        row = (
            parsed.groupBy("employee_id")
            .agg(F.count(F.lit(1)).alias("n"), F.max(bad.cast("int")).alias("bad"))
            .agg(count_if(F.col("n") > 1).alias("repeated"), count_if(F.col("bad") == 1).alias("unparsed"))
            .first()
        )
        if row["repeated"] or row["unparsed"]:
            raise ValueError(f"hire events: {row['repeated']} employees repeat, {row['unparsed']} notes lack a field")
    return parsed


def survival_cohort(
    employees: DataFrame,
    hire: DataFrame,
    first_salary: DataFrame,
    locations: DataFrame,
    job_roles: DataFrame,
    as_of: str,
    eligible_levels: Sequence[str],
) -> DataFrame:
    """Duration in inclusive days and months, event flag, and what was true at hire."""
    end = F.coalesce("termination_date", F.lit(as_of).cast("date"))
    duration = F.datediff(end, "hire_date") + 1
    joined = (
        employees.select("employee_id", "hire_date", "termination_date", "birth_year", "employment_type", "education_level", "organizational_level")
        .join(hire, "employee_id", "left")
        .join(first_salary, "employee_id", "left")
        .join(locations.select(F.col("location_id").alias("hire_location_id"), F.col("region").alias("hire_region")), "hire_location_id", "left")
        .join(
            job_roles.select(
                F.col("job_role_id").alias("hire_job_role_id"),
                F.col("job_family").alias("hire_job_family"),
                F.col("job_level").cast("string").alias("hire_job_level"),
                ((F.col("salary_band_min") + F.col("salary_band_max")) / 2.0).alias("_mid"),
            ),
            "hire_job_role_id",
            "left",
        )
    )
    return joined.select(
        "employee_id",
        duration.cast("bigint").alias("duration_days"),
        (duration / F.lit(DAYS_PER_MONTH)).alias("duration_months"),
        F.col("termination_date").isNotNull().cast("int").alias("event_observed"),
        (F.year("hire_date") - F.col("birth_year")).cast("double").alias("age_at_hire"),
        safe_div(F.col("hire_base_salary"), F.col("_mid")).alias("salary_position_at_hire"),
        "employment_type",
        "education_level",
        "organizational_level",
        "hire_region",
        "hire_job_family",
        "hire_job_level",
        F.col("organizational_level").isin(*eligible_levels).alias("survival_model_eligible"),
    )


# ---- product-limit curves -------------------------------------------------------------------------


def kaplan_meier(
    df: DataFrame, duration: str, event: str, by: Sequence[str] = (), confidence: float = 0.95, rows_per_bucket: int | None = None
) -> DataFrame:
    """Survival at each distinct duration with a log-log band from Greenwood's variance."""
    collapsed = df.groupBy(*by, duration).agg(
        F.count(F.lit(1)).alias("leaving"), count_if(F.col(event) == 1).alias("events")
    )
    plan = plan_ranges(collapsed, [Key(duration)], rows_per_bucket, by)
    counted = running_totals(collapsed, [Key(duration)], {"_cum": "leaving"}, by, plan=plan)
    totals = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    at_risk = (F.col("_n") - F.col("_cum") + F.col("leaving")).alias("at_risk")
    base = attach(counted, totals, by).select(*by, duration, "leaving", "events", at_risk)
    d, n = F.col("events"), F.col("at_risk")
    steps = {
        # a step on which everybody at risk leaves has no logarithm; it is counted apart
        "_log": F.when(d < n, F.log(1.0 - d / n)).otherwise(F.lit(0.0)),
        "_var": F.when(d < n, d / (n.cast("double") * (n - d))).otherwise(F.lit(0.0)),
        "_gone": F.when(d == n, 1).otherwise(0).cast("bigint"),
    }
    curve = running_totals(base, [Key(duration)], steps, by, plan=plan)
    alive = F.col("_gone") == 0
    survival = F.when(alive, F.exp("_log")).otherwise(0.0)
    z = normal_z(confidence)
    width = F.lit(z) * F.sqrt("_var") / F.col("_log")
    inside = alive & (F.col("_log") < 0)

    def bound(sign: int) -> Column:
        return F.when(inside, F.exp(-F.exp(F.log(-F.col("_log")) + sign * width))).when(alive, 1.0)

    return curve.select(
        *by,
        duration,
        "at_risk",
        "events",
        (F.col("leaving") - d).alias("censored"),
        survival.alias("survival"),
        bound(-1).alias("survival_lower_95"),
        bound(1).alias("survival_upper_95"),
    )


def horizon_summary(curve: DataFrame, duration: str, horizons: Sequence[float] = HORIZONS, by: Sequence[str] = ()) -> DataFrame:
    """Curve value at each horizon: the last step on or before it, 1.0 before the first step."""
    at = [
        F.struct(
            F.lit(float(h)).alias("horizon_months"),
            F.max_by(
                F.struct("survival", "survival_lower_95", "survival_upper_95"), F.when(F.col(duration) <= h, F.col(duration))
            ).alias("v"),
        )
        for h in horizons
    ]
    rows = curve.groupBy(*by).agg(F.array(*at).alias("_h")).select(*by, F.explode("_h").alias("_h"))
    value = F.coalesce("_h.v.survival", F.lit(1.0))
    return rows.select(
        *by,
        "_h.horizon_months",
        value.alias("retention_probability"),
        F.when(F.col("_h.v").isNull(), 1.0).otherwise(F.col("_h.v.survival_lower_95")).alias("retention_lower_95"),
        F.when(F.col("_h.v").isNull(), 1.0).otherwise(F.col("_h.v.survival_upper_95")).alias("retention_upper_95"),
        (1.0 - value).alias("cumulative_attrition_probability"),
    )


def median_survival(curve: DataFrame, duration: str, by: Sequence[str] = ()) -> DataFrame:
    """First duration at which survival is at most one half; null where it is never reached."""
    return curve.groupBy(*by).agg(
        F.min(F.when(F.col("survival") <= 0.5, F.col(duration))).alias("median_retention_months")
    )


def grouped_curves(
    df: DataFrame, features: Sequence[str], duration: str, event: str, horizons: Sequence[float] = HORIZONS, minimum: int = 100
) -> DataFrame:
    """Exits, censored, median and horizon values for each large enough group of each feature."""
    long = by_attribute(df, features, [duration, event])
    by = ["attribute", "group"]
    sizes = long.groupBy(*by).agg(
        F.count(F.lit(1)).alias("employees"),
        count_if(F.col(event) == 1).alias("observed_exits"),
        count_if(F.col(event) == 0).alias("right_censored"),
    ).where(F.col("employees") >= minimum)
    curve = kaplan_meier(long, duration, event, by)
    values = curve.groupBy(*by).agg(
        F.min(F.when(F.col("survival") <= 0.5, F.col(duration))).alias("median_retention_months"),
        *[
            F.coalesce(F.max_by("survival", F.when(F.col(duration) <= h, F.col(duration))), F.lit(1.0)).alias(f"retention_{int(h)}m")
            for h in horizons
        ],
    )
    return sizes.join(values, by).withColumn(
        "observed_exit_share", safe_div(F.col("observed_exits"), F.col("employees"))
    )


def chi_square_tail(statistic: float, freedom: int) -> float:
    """Upper tail of the chi-square distribution."""
    a, x = freedom / 2.0, statistic / 2.0
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1.0 - total * scale
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2.0
        d = step * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + step / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h * scale


def _vectors(rows: DataFrame, size: int, make) -> np.ndarray:
    """Sum over all rows of ``make(time, group, leaving)``, a vector of ``size``: one buffer per partition."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += make(*(np.asarray(c) for c in batch.columns))
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["_g", "_sums"])

    return summed_by_fit(rows.mapInArrow(partial, "_g int, _sums binary")).get(0, np.zeros(size))


def log_rank_statistic(df: DataFrame, group: Column, duration: str, event: str, tolerance: float = 1e-13, maximum: int = 500) -> tuple[int, float]:
    """(groups, statistic) of the log-rank test between any number of groups.

    Rows are collapsed to one per time and group. With H and W the running sums of d/n and of the variance weights over
    event times, a row of a group at time t adds H(t) to its expectation and W(t) to the diagonal of the covariance. The
    rest of the covariance is a sum over times of outer products of the numbers at risk, which is never formed: its
    product with a vector is a suffix sum and a prefix sum over times. Conjugate gradients, scaled by the diagonal, need
    few products, since the outer products are small beside the diagonal when groups are many. The driver holds one
    number per distinct event time and per group.
    """
    held = settle(
        df.select(F.coalesce(group.cast("string"), F.lit("Missing")).alias("g"), F.col(duration).alias("t"), F.col(event).alias("e"))
        .where(F.col("t").isNotNull()).groupBy("t", "g").agg(F.count(F.lit(1)).alias("l"), count_if(F.col("e") == 1).alias("d"))
    )
    labels = held.groupBy("g").agg(F.sum("d").alias("d")).orderBy("g").collect()
    k = len(labels)
    if k < 2:
        return k, 0.0
    per_time = held.groupBy("t").agg(F.sum("l").alias("l"), F.sum("d").alias("d"))
    risk = running_totals(per_time, [Key("t", True)], {"n": "l"}).where((F.col("d") > 0) & (F.col("n") > 1))
    steps = sorted(risk.select("t", F.col("n").cast("double"), F.col("d").cast("double")).collect(), key=lambda r: r["t"])
    n, d = (np.array([r[c] for r in steps], float) for c in ("n", "d"))
    weight = d * (n - d) / (n - 1.0)
    spark = df.sparkSession
    names = spark.createDataFrame([(r["g"], i) for i, r in enumerate(labels)], "g string, j int")
    moments = np.array([float(r["t"]) for r in steps])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # a row is at risk in all event times up to its own
            last = np.searchsorted(moments, np.asarray(batch.column(0)), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(last), *batch.columns[1:]], names=["i", "j", "l"])

    named = held.join(names, "g").select(F.col("t").cast("double"), "j", F.col("l").cast("double"))
    rows = named.mapInArrow(number, "i int, j int, l double").groupBy("i", "j").agg(F.sum("l").alias("l"))
    rows = settle(rows)
    hazard, spread = (np.concatenate([[0.0], np.cumsum(x)]) for x in (d / n, weight / n))
    expected = _vectors(rows, k, lambda i, j, l: np.bincount(j, l * hazard[i], k))
    diagonal = _vectors(rows, k, lambda i, j, l: np.bincount(j, l * spread[i], k))
    gap = np.array([float(r["d"]) for r in labels]) - expected
    known = diagonal > 0
    scale = np.where(known, diagonal, 1.0)

    def product(x: np.ndarray) -> np.ndarray:
        at_time = _vectors(rows, len(n) + 1, lambda i, j, l: np.bincount(i, l * x[j], len(n) + 1))
        reached = np.cumsum(at_time[::-1])[::-1][1:]
        total = np.concatenate([[0.0], np.cumsum(weight / n**2 * reached)])
        return diagonal * x - _vectors(rows, k, lambda i, j, l: np.bincount(j, l * total[i], k))

    x = np.zeros(k)
    residual = np.where(known, gap, 0.0)
    first = float(residual @ (residual / scale))
    z = residual / scale
    direction, size = z, float(residual @ z)
    for _ in range(min(maximum, k)):
        if size <= tolerance * first or size == 0.0:
            break
        moved = product(direction)
        step = size / float(direction @ moved)
        x, residual = x + step * direction, residual - step * moved
        z = residual / scale
        before, size = size, float(residual @ z)
        direction = z + size / before * direction
    return k, float(gap @ x)


def log_rank_test(df: DataFrame, features: Sequence[str], duration: str, event: str) -> DataFrame:
    """k-sample log-rank statistic and p-value per feature, for any number of groups."""
    rows = []
    for feature in features:
        k, statistic = log_rank_statistic(df, F.col(feature), duration, event)
        p = chi_square_tail(statistic, k - 1) if k > 1 else 1.0
        rows.append((feature, k, statistic, p, p < 0.05))
    return df.sparkSession.createDataFrame(
        rows, "group_feature string, groups int, test_statistic double, p_value double, descriptive_difference_detected boolean"
    )


# ---- proportional hazards -----------------------------------------------------------------------


def cox_design(
    df: DataFrame, numeric: Sequence[str], categorical: dict[str, str], keep: Sequence[str]
) -> tuple[DataFrame, list[dict]]:
    """z-scored numerics (population deviation) and indicators against a reference, with a manifest.

    Raises on a missing value, a numeric without variation, or an absent reference.
    """
    required = [*numeric, *categorical]
    row = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in numeric],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in numeric],
        *[count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required],
        *[F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(f"levels_{c}") for c in categorical],
    ).first()
    missing = {c: row[f"null_{c}"] for c in required if row[f"null_{c}"]}
    if missing:
        raise ValueError(f"design features contain missing values: {missing}")
    columns, manifest = [], []
    for c in numeric:
        if not row[f"s_{c}"]:
            raise ValueError(f"{c} has no variation")
        columns.append(((F.col(c) - row[f"m_{c}"]) / row[f"s_{c}"]).alias(f"{c}_z"))
        manifest.append({"encoded_feature": f"{c}_z", "raw_feature": c, "reference_category": None, "level": None})
    for c, reference in categorical.items():
        if reference not in row[f"levels_{c}"]:
            raise ValueError(f"reference {reference!r} of {c} does not occur")
        for level in row[f"levels_{c}"]:
            if level != reference:
                name = f"{c}_{''.join(ch if ch.isalnum() else '_' for ch in level).lower()}"
                columns.append((F.col(c).cast("string") == level).cast("double").alias(name))
                manifest.append({"encoded_feature": name, "raw_feature": c, "reference_category": reference, "level": level})
    return df.select(*keep, *columns), manifest


@dataclass
class CoxFit:
    """Coefficients in feature order, their covariance and the fit's log partial likelihood.

    ``converged`` is false where the steps ran out before the coefficients stood still.
    """

    features: list[str]
    beta: np.ndarray
    covariance: np.ndarray
    log_likelihood: float
    iterations: int
    converged: bool


def _upper(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i, d)]


def _risk_sets(df: DataFrame, features: Sequence[str], duration: str, event: str, beta: np.ndarray, plan: RangePlan) -> DataFrame:
    """Per distinct duration: weighted sums of x and xxᵀ over the risk set and over the exits."""
    pairs = _upper(len(features))
    x = [F.col(f) for f in features]
    linear = sum((x[i] * float(b) for i, b in enumerate(beta)), F.lit(0.0))
    weighted = df.select(duration, event, *features, F.exp(linear).alias("_r"), linear.alias("_l"))
    r, e = F.col("_r"), F.col(event) == 1
    exits = F.when(e, r).otherwise(0.0)
    sums = {"s0": r, **{f"s1_{i}": r * x[i] for i in range(len(x))}, **{f"s2_{i}_{j}": r * x[i] * x[j] for i, j in pairs}}
    out = {
        "d0": exits,
        **{f"d1_{i}": exits * x[i] for i in range(len(x))},
        **{f"d2_{i}_{j}": exits * x[i] * x[j] for i, j in pairs},
        **{f"x_{i}": F.when(e, x[i]).otherwise(0.0) for i in range(len(x))},
        "lin": F.when(e, F.col("_l")).otherwise(0.0),
    }
    per_time = weighted.groupBy(duration).agg(
        count_if(e).alias("d"), *[F.sum(c).alias(f"own_{n}") for n, c in sums.items()], *[F.sum(c).alias(n) for n, c in out.items()]
    )
    return running_totals(per_time, [Key(duration, True)], {n: f"own_{n}" for n in sums}, plan=plan)


TIES_PER_ROW = 10_000


def _tied_sums(risk: DataFrame, duration: str) -> DataFrame:
    """Sums of f^p/φ^q and log φ over the tied exits l = 0..d-1, with f = l/d and φ = s0 − f·d0.

    Ties are worked off in chunks, so that one duration with very many exits is
    neither one huge array nor one task.
    """
    chunks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("d") - 1) / F.lit(TIES_PER_ROW)))
    rows = risk.select(duration, "d", "s0", "d0", F.explode(chunks).alias("_c"))
    first = F.col("_c") * TIES_PER_ROW
    members = F.sequence(first, F.least(first + TIES_PER_ROW - 1, F.col("d") - 1))

    def fold(value) -> Column:
        return F.aggregate(members, F.lit(0.0), lambda acc, l: acc + value(l / F.col("d")))

    def phi(f: Column) -> Column:
        return F.col("s0") - f * F.col("d0")

    parts = rows.select(
        duration,
        fold(lambda f: 1.0 / phi(f)).alias("a1"),
        fold(lambda f: f / phi(f)).alias("a2"),
        fold(lambda f: 1.0 / (phi(f) * phi(f))).alias("b1"),
        fold(lambda f: f / (phi(f) * phi(f))).alias("b2"),
        fold(lambda f: f * f / (phi(f) * phi(f))).alias("b3"),
        fold(lambda f: F.log(phi(f))).alias("lg"),
    )
    return parts.groupBy(duration).agg(*[F.sum(c).alias(c) for c in ("a1", "a2", "b1", "b2", "b3", "lg")])


DIRECT_TIES = 100_000


def _polygamma(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digamma and trigamma of large arguments, by their asymptotic series."""
    i = 1.0 / z
    return np.log(z) - i / 2 - i**2 / 12 + i**4 / 120 - i**6 / 252, i + i**2 / 2 + i**3 / 6 - i**5 / 30 + i**7 / 42


def efron_sums(d: np.ndarray, s0: np.ndarray, d0: np.ndarray) -> np.ndarray:
    """Sums of 1/φ, f/φ, 1/φ², f/φ², f²/φ² and log φ over the tied exits l = 0..d-1, f = l/d and φ = s0 − f·d0.

    Very many ties at one time are summed in closed form, so the work does not grow with the exits.
    """
    out = np.zeros((6, len(d)))
    for i, (n, s, x) in enumerate(zip(d.astype(int).tolist(), s0.tolist(), d0.tolist())):
        if n <= DIRECT_TIES:
            f = np.arange(n) / n
            phi = s - f * x
            out[:, i] = [(1 / phi).sum(), (f / phi).sum(), (1 / phi**2).sum(), (f / phi**2).sum(), (f**2 / phi**2).sum(), np.log(phi).sum()]
            continue
        # φ = (x/n)·(z − l) with z = s·n/x; the last few terms directly, since the series needs large arguments
        tail = min(n, 1000)
        l = np.arange(n - tail, n)
        phi = s - l / n * x
        z = s * n / x
        (psi_a, tri_a), (psi_b, tri_b) = (_polygamma(np.array(v)) for v in (z + 1.0, z - (n - tail) + 1.0))
        one = n / x * (psi_a - psi_b) + (1 / phi).sum()
        two = (n / x) ** 2 * (tri_b - tri_a) + (1 / phi**2).sum()
        a, b = z + 1.0, z - (n - tail) + 1.0
        gamma = [(v - 0.5) * math.log(v) - v + 0.5 * math.log(2 * math.pi) + 1 / (12 * v) - 1 / (360 * v**3) for v in (a, b)]
        logs = (n - tail) * math.log(x / n) + gamma[0] - gamma[1] + np.log(phi).sum()
        out[:, i] = [one, (s * one - n) / x, two, (s * two - one) / x, (s * s * two - 2 * s * one + n) / x**2, logs]
    return out


def fit_cox_without(
    df: DataFrame, features: Sequence[str], duration: str, event: str, left_out: Sequence[int] = (0,), fold: str | None = None,
    penalizer: float = 0.05, tolerance: float = 1e-7, maximum: int = 25,
) -> dict[int, CoxFit]:
    """Ridge-penalised Cox models with Efron ties for all ``left_out`` folds together, each without the rows of its fold.

    Maximises the mean log partial likelihood minus ½·penalizer·Σ(σ·β)², where σ is the feature's sample deviation over
    the fit's rows: the penalty does not depend on a feature's unit. A step that lowers the objective is halved. Fits that
    run out of steps warn and say so in ``converged``.

    A step reads the rows twice, for all fits. First sums of risk and risk-weighted features per event time; suffix sums
    over times give the risk sets. The curvature's sum over risk sets of outer products turns into one over rows: a row
    counts with the sum of its risk sets' weights up to its own time, so the second pass is one blocked product. Rows are
    not copied for the fits. A partition yields a buffer per fit, added up in a tree; the driver holds d numbers per
    distinct event time and fit.
    """
    features, fits = list(features), list(left_out)
    d = len(features)
    held = F.col(fold).cast("int") if fold else F.lit(-1)
    rows = settle(df.select(F.col(duration).cast("double").alias("t"), (F.col(event) == 1).cast("double").alias("e"), held.alias("f"), *features))
    times = np.array(sorted(r["t"] for r in rows.where("e = 1").select("t").distinct().collect()), float)
    size = len(times)
    kind = "_g int, _sums binary"

    def over(make) -> dict[int, np.ndarray]:
        """The sums of ``make(last event time, exit, features, fit)`` over the rows that each fit holds."""

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                at = np.searchsorted(times, np.asarray(batch.column(0)), "right")
                order = np.argsort(at, kind="stable")
                e, f = (np.asarray(batch.column(k))[order] for k in (1, 2))
                x = np.column_stack([np.asarray(c.cast(pa.float64())) for c in batch.columns[3:]])[order] if d else np.zeros((batch.num_rows, 0))
                for g in fits:
                    mine = f != g
                    if mine.any():
                        sums[g] = sums.get(g, 0.0) + make(at[order][mine], e[mine], x[mine], g)
            yield buffers(sums)

        return summed_by_fit(rows.mapInArrow(partial, kind))

    def moments(at, e, x, g):
        return np.concatenate([[len(at), e.sum()], x.sum(axis=0), (x * x).sum(axis=0), e @ x])

    first = over(moments)
    fits = [g for g in fits if g in first and first[g][1] > 0]
    n = {g: first[g][0] for g in fits}
    ridge = {}
    for g in fits:
        mean, square = first[g][2 : 2 + d] / n[g], first[g][2 + d : 2 + 2 * d] / n[g]
        spread = np.maximum(square - mean**2, 0.0) * n[g] / max(n[g] - 1, 1)
        ridge[g] = penalizer * np.where(spread > 0, spread, 1.0)
    exits = {g: first[g][2 + 2 * d :] for g in fits}
    beta, move = {g: np.zeros(d) for g in fits}, {g: np.zeros(d) for g in fits}
    best, fitted, open_ = dict.fromkeys(fits, -math.inf), {}, list(fits)
    for done in range(1, maximum + 1):
        fits = open_  # the passes below serve the open fits alone
        coefficients = dict(beta)

        def per_time(at, e, x, g):
            linear = x @ coefficients[g]
            r = np.exp(linear)
            wide = np.column_stack([r, r[:, None] * x, r * e, (r * e)[:, None] * x, e, e * linear])
            total = np.zeros((size + 1, wide.shape[1]))
            heads = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else []
            if len(at):
                total[at[heads]] = np.add.reduceat(wide, heads, axis=0)
            return total.ravel()

        sums = {g: v.reshape(size + 1, 2 * d + 4) for g, v in over(per_time).items()}
        state = {}
        for g in open_:
            own = sums[g]
            risk = np.cumsum(own[::-1, : d + 1], axis=0)[::-1][1:]  # rows whose last event time is this one or later
            out = own[1:, d + 1 : 2 * d + 2]
            # exits stand at their own time, which is the last event time up to it
            count, active = own[1:, 2 * d + 2], own[1:, 2 * d + 2] > 0
            ties = np.zeros((6, size))
            ties[:, active] = efron_sums(count[active], risk[active, 0], out[active, 0])
            state[g] = (risk[:, 1:], out[:, 1:], ties, float(own[:, 2 * d + 3].sum()))
        weights = {g: (np.concatenate([[0.0], np.cumsum(state[g][2][0])]), np.concatenate([[0.0], state[g][2][1]])) for g in open_}

        def products(at, e, x, g):
            whole, own = weights[g]
            w = np.exp(x @ coefficients[g]) * (whole[at] - e * own[at])
            return (x.T @ (w[:, None] * x)).ravel()

        seconds = over(products)
        still = []
        for g in open_:
            s1, d1, (a1, a2, b1, b2, b3, lg), linear = state[g]
            gradient = (exits[g] - (a1 @ s1 - a2 @ d1)) / n[g] - ridge[g] * beta[g]
            cross = s1.T @ (b2[:, None] * d1)
            outer = s1.T @ (b1[:, None] * s1) - cross - cross.T + d1.T @ (b3[:, None] * d1)
            information = (seconds[g].reshape(d, d) - outer) / n[g] + np.diag(ridge[g])
            likelihood = linear - float(lg.sum())
            objective = likelihood / n[g] - 0.5 * float(ridge[g] @ beta[g] ** 2)
            if objective < best[g] - 1e-9 * abs(best[g]):
                move[g] = move[g] / 2.0  # the step was too long: go half way back
                beta[g] = beta[g] - move[g]
                still.append(g)
                continue
            move[g] = np.linalg.solve(information, gradient)
            small = np.max(np.abs(move[g]) * np.sqrt(ridge[g] / penalizer if penalizer else 1.0), initial=0.0) < tolerance
            converged = bool(small or abs(objective - best[g]) < tolerance * 1e-3)
            fitted[g] = CoxFit(features, beta[g], np.linalg.inv(information) / n[g], likelihood, done, converged)
            if not converged:
                beta[g], best[g] = beta[g] + move[g], objective
                still.append(g)
        open_ = still
        if not open_:
            break
    if open_:
        warnings.warn(f"{len(open_)} proportional-hazards fits did not converge in {maximum} steps", RuntimeWarning, stacklevel=2)
    return {g: CoxFit(f.features, beta[g] if g in open_ else f.beta, f.covariance, f.log_likelihood, f.iterations, f.converged and g not in open_) for g, f in fitted.items()}


def fit_cox(
    df: DataFrame, features: Sequence[str], duration: str, event: str, penalizer: float = 0.05, tolerance: float = 1e-7, maximum: int = 25
) -> CoxFit:
    """One penalised Cox model over all rows, see ``fit_cox_without``."""
    return fit_cox_without(df, features, duration, event, penalizer=penalizer, tolerance=tolerance, maximum=maximum)[0]


def hazard_ratios(fit: CoxFit, df: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Coefficient, hazard ratio with its interval, z, p and direction per feature."""
    z0 = normal_z(confidence)
    rows = []
    for name, b, v in zip(fit.features, fit.beta, np.diag(fit.covariance), strict=True):
        se = math.sqrt(v)
        z = b / se
        direction = "Higher modeled exit hazard" if b > 0 else "Lower modeled exit hazard"
        rows.append(
            (name, float(b), math.exp(b), math.exp(b - z0 * se), math.exp(b + z0 * se), se, float(z), math.erfc(abs(z) / math.sqrt(2.0)), direction, fit.converged)
        )
    return df.sparkSession.createDataFrame(
        rows,
        "encoded_feature string, log_hazard_coefficient double, hazard_ratio double, hazard_ratio_lower_95 double, "
        "hazard_ratio_upper_95 double, standard_error double, z double, p_value double, association_direction string, converged boolean",
    )


def with_linear_predictor(df: DataFrame, fit: CoxFit, out: str = "log_partial_hazard") -> DataFrame:
    terms = sum((F.col(f) * float(b) for f, b in zip(fit.features, fit.beta, strict=True)), F.lit(0.0))
    return df.withColumn(out, terms)


def concordance(df: DataFrame, score: str, duration: str, event: str, by: Sequence[str] = ()) -> DataFrame:
    """Harrell's C per group, counted exactly and without forming pairs.

    A pair is comparable when the shorter duration ended in an event (at equal
    durations: event against censored). Distinct scores are numbered; pairs of
    different scores first differ in exactly one bit of these numbers. For each bit
    the rows with equal higher bits form a block, and running counts over the
    durations of a block give its ordered pairs. Blocks are collapsed to distinct
    durations, so the work is n·log(distinct scores).
    """
    usable = df.select(*by, score, duration, event)
    distinct = usable.select(score).distinct()
    numbered = ranked(distinct, [Key(score)], out="_k").withColumn("_k", F.col("_k") - 1)
    top = numbered.agg(F.max("_k").alias("m")).first()["m"] or 0
    bits = max(1, int(top).bit_length())
    cells = attach(usable, numbered, [score]).groupBy(*by, "_k", duration).agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col(event) == 1).alias("e")
    )
    cells = settle(cells)

    def ordered_pairs(frame: DataFrame, keys: Sequence[str], low: Column, high: Column, out: str) -> DataFrame:
        """Events of ``high`` rows times the later (or equally long, censored) ``low`` rows."""
        zero = F.lit(0).cast("bigint")
        per_time = frame.groupBy(*keys, duration).agg(
            F.sum(F.when(low, F.col("n")).otherwise(zero)).alias("_low"),
            F.sum(F.when(low, F.col("n") - F.col("e")).otherwise(zero)).alias("_low_censored"),
            F.sum(F.when(high, F.col("e")).otherwise(zero)).alias("_events"),
        )
        running = running_totals(per_time, [Key(duration, True)], {"_later": "_low"}, keys)
        later = F.col("_later") - F.col("_low") + F.col("_low_censored")
        return running.groupBy(*by).agg(F.sum(F.col("_events") * later).alias(out))

    everyone = F.lit(True)
    comparable = ordered_pairs(cells, by, everyone, everyone, "comparable")
    tied = ordered_pairs(cells, [*by, "_k"], everyone, everyone, "tied")
    levels = cells.withColumn("_bit", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
    size = F.pow(F.lit(2.0), F.col("_bit")).cast("bigint")
    levels = levels.withColumn("_block", F.floor(F.col("_k") / (size * 2))).withColumn(
        "_one", (F.floor(F.col("_k") / size) % 2) == 1
    )
    right = ordered_pairs(levels, [*by, "_bit", "_block"], ~F.col("_one"), F.col("_one"), "concordant")
    joined = attach(attach(comparable, tied, by), right, by)
    return joined.select(
        *by,
        F.col("comparable").alias("comparable_pairs"),
        F.col("concordant").alias("concordant_pairs"),
        F.col("tied").alias("tied_pairs"),
        safe_div(F.col("concordant") + F.col("tied") / 2.0, F.col("comparable")).alias("concordance_index"),
    )


def cross_validated_concordance(
    design: DataFrame, features: Sequence[str], row_id: str, duration: str, event: str, folds: int = 5, seed: int = 42, penalizer: float = 0.05
) -> DataFrame:
    """Out-of-fold concordance: the fits of all folds share their passes, one scoring and counting job for all of them."""
    placed = settle(design.join(row_folds(design, row_id, event, folds, seed), row_id))
    score = F.lit(None).cast("double")
    for fold, fit in fit_cox_without(placed, features, duration, event, range(1, folds + 1), "fold", penalizer).items():
        linear = sum((F.col(f) * float(b) for f, b in zip(fit.features, fit.beta, strict=True)), F.lit(0.0))
        score = F.when(F.col("fold") == fold, linear).otherwise(score)
    scored = placed.withColumn("_score", score)
    sizes = placed.groupBy("fold").agg(
        F.count(F.lit(1)).alias("validation_rows"), count_if(F.col(event) == 1).alias("validation_events")
    )
    return sizes.join(concordance(scored, "_score", duration, event, ["fold"]), "fold")


def proportionality_check(
    df: DataFrame, fit: CoxFit, duration: str, event: str, flag_below: float = 0.01
) -> DataFrame:
    """Scaled Schoenfeld residuals against the rank of the event time, per feature.

    All exits of one duration share their rank, so sums of residuals per distinct
    duration are enough. Tied exits have the Efron means of the fit.
    """
    df = settle(df.select(duration, event, *fit.features))
    plan = plan_ranges(df.select(duration).distinct(), [Key(duration, True)])
    risk = _risk_sets(df, fit.features, duration, event, fit.beta, plan).where(F.col("d") > 0)
    risk = risk.join(_tied_sums(risk, duration), duration)
    ranks = average_ranks(df.where(F.col(event) == 1).select(duration), duration, out="_g").distinct()
    joined = risk.join(ranks, duration)
    d = len(fit.features)
    residual = [F.col(f"x_{i}") - (F.col("a1") * F.col(f"s1_{i}") - F.col("a2") * F.col(f"d1_{i}")) for i in range(d)]
    g, w = F.col("_g"), F.col("d").cast("double")
    row = joined.agg(
        F.sum(w).alias("events"), F.sum(w * g).alias("g1"), F.sum(w * g * g).alias("g2"),
        *[F.sum(r).alias(f"r_{i}") for i, r in enumerate(residual)],
        *[F.sum(g * r).alias(f"gr_{i}") for i, r in enumerate(residual)],
    ).first()
    mean = row["g1"] / row["events"]
    spread = row["g2"] - row["events"] * mean * mean
    centred = np.array([row[f"gr_{i}"] - mean * row[f"r_{i}"] for i in range(d)])
    scaled = row["events"] * fit.covariance @ centred
    rows = []
    for i, name in enumerate(fit.features):
        statistic = float(scaled[i] ** 2 / (row["events"] * fit.covariance[i, i] * spread))
        p = chi_square_tail(statistic, 1)
        rows.append((name, statistic, p, flag_below, p < flag_below))
    return df.sparkSession.createDataFrame(
        rows, "encoded_feature string, test_statistic double, p double, configured_flag_p_value double, proportional_hazards_review_flag boolean"
    )


def cohort_summary(cohort: DataFrame, duration: str, event: str, curve: DataFrame, eligible: str) -> DataFrame:
    """Sizes, events, censored rows and median durations of the cohort."""
    model = F.col(eligible)
    sizes = cohort.agg(
        F.count(F.lit(1)).alias("all_employees"),
        count_if(model).alias("model_eligible_employees"),
        count_if(~model).alias("protected_employees_excluded"),
        count_if(model & (F.col(event) == 1)).alias("observed_exits"),
        count_if(model & (F.col(event) == 0)).alias("right_censored_active_employees"),
        F.max(F.when(model, F.col(duration))).alias("maximum_observed_duration_months"),
    )
    middle = exact_quantiles(cohort.where(model), duration, {"median_observed_duration_months": 0.5}).drop("_n")
    reached = median_survival(curve, duration)
    out = attach(attach(sizes, middle, []), reached, [])
    return out.select(
        "*",
        safe_div(F.col("observed_exits"), F.col("model_eligible_employees")).alias("observed_exit_share"),
        F.col("median_retention_months").isNotNull().alias("kaplan_meier_median_reached"),
    )
