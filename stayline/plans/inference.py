"""Queries for isotonic fits, bootstrap counts in place, calibrated folds and the encoded matrix."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stayline.operators import association, diff, isotonic, metrics, model, multinomial, panel, quality, resample
from stayline.plans.features import HR, PANEL_SQL, full_panel
from stayline.plans.modelling import CATEGORICAL, ID, NUMERIC, Y, encoder, split
from stayline.plans.outcomes import CLASSES, orders_twice
from stayline.plans.ranking import draw_sql
from stayline.plans.registry import Tables, query, round_all
from stayline.session import checkpoint_dir, store
from stayline.sources import tables as src
from stayline.sources.contracts import Contract

ITERATIONS = 500

# A pool's value is the largest over its left ends of the least mean over its right ends.
POOLS_SQL = """WITH pt AS (SELECT region, FLOOR(attrition_probability::DOUBLE * 100) AS low, COUNT(*) AS w, SUM(actual_attrition) AS s FROM scored GROUP BY ALL),
    cm AS (SELECT *, SUM(w) OVER o AS cw, SUM(s) OVER o AS cs FROM pt WINDOW o AS (PARTITION BY region ORDER BY low)),
    pr AS (SELECT a.region, a.low AS a, b.low AS b, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w)::DOUBLE AS m
      FROM cm a JOIN cm b ON a.region IS NOT DISTINCT FROM b.region AND a.low <= b.low),
    mn AS (SELECT region, a, b AS i, MIN(m) OVER (PARTITION BY region, a ORDER BY b DESC) AS m FROM pr),
    vl AS (SELECT region, i AS low, MAX(m) AS value FROM mn GROUP BY ALL),
    pools AS (SELECT vl.region, MIN(vl.low) AS low, MAX(vl.low) AS high, SUM(w)::DOUBLE AS weight, value
      FROM vl JOIN pt ON vl.region IS NOT DISTINCT FROM pt.region AND vl.low = pt.low GROUP BY vl.region, value)"""


def scores(t: Tables):
    """Scores in whole per cent: ties inside a region are pooled before the fit."""
    return t["scored"].select("*", F.floor(F.col("attrition_probability").cast("double") * 100).cast("double").alias("percent"))


@query(
    "l6_isotonic_pools",
    "scored",
    f"{POOLS_SQL} SELECT region, low, high, weight, ROUND(value, 8) AS value FROM pools",
)
def _(t: Tables):
    return round_all(isotonic.isotonic_pools(scores(t), "percent", Y, ["region"]), 8)


@query(
    "l6_isotonic_applied",
    "scored",
    f"""{POOLS_SQL}, kn AS (SELECT region, low AS x, value AS v FROM pools UNION SELECT region, high, value FROM pools),
    rw AS (SELECT employee_id, region, attrition_probability::DOUBLE * 100 AS x FROM scored),
    lo AS (SELECT rw.employee_id, rw.region, rw.x, k.x AS a, k.v AS va FROM rw ASOF LEFT JOIN kn k ON rw.region = k.region AND rw.x >= k.x),
    hi AS (SELECT lo.*, k.x AS b, k.v AS vb FROM lo ASOF LEFT JOIN kn k ON lo.region = k.region AND lo.x <= k.x)
    SELECT employee_id, ROUND(CASE WHEN a IS NULL THEN vb WHEN b IS NULL OR x = a THEN va ELSE va + (x - a) / (b - a) * (vb - va) END, 6) AS isotonic FROM hi""",
)
def _(t: Tables):
    rows = scores(t)
    pools = isotonic.isotonic_pools(rows, "percent", Y, ["region"])
    asked = rows.select(ID, "region", (F.col("attrition_probability").cast("double") * 100).alias("x"))
    return round_all(isotonic.apply_isotonic(asked, pools, "x", ["region"]).select(ID, "isotonic"))


@query("r5_calibrated_models_out_of_fold", "scored")
def _(t: Tables):
    people = t["scored"].drop("attrition_probability")
    return round_all(model.repeated_calibrated_models(people, NUMERIC, CATEGORICAL, ID, Y, 5, 10, 3, 9), 6)


@query(
    "r7_tree_bootstrap_draws",
    "labeled",
    f"""SELECT CAST(i AS INT) AS iteration, toxic, COUNT(*) AS rows, COUNT(*) AS draws FROM labeled, range(1, {ITERATIONS + 1}) r(i) GROUP BY ALL""",
)
def _(t: Tables):
    """Every resample of every class has exactly as many draws as the class has rows."""
    counted = multinomial.bootstrap_counts(t["labeled"].select("doc_id", "toxic"), "doc_id", "toxic", ITERATIONS, 42)
    long = counted.select("toxic", F.posexplode("counts").alias("at", "n"))
    return long.groupBy((F.col("at") + 1).alias("iteration"), "toxic").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("draws"))


def grid(t: Tables):
    return multinomial.bootstrap_grid(t["labeled"], "quality_score", "toxic", "doc_id", metrics.GRID_FRACTIONS, ITERATIONS, 42)


@query("r9_grid_intervals", "labeled")
def _(t: Tables):
    return round_all(multinomial.grid_intervals(grid(t)))


@query(
    "m7_bootstrap_grid_totals",
    "labeled",
    "SELECT f AS requested_fraction, CAST(CEIL(ROUND(n * f, 9)) AS BIGINT) AS selected_count, 500::BIGINT AS iterations, "
    "CASE WHEN f = 1 THEN p END AS captured FROM (SELECT COUNT(*) AS n, CAST(SUM(toxic) AS BIGINT) AS p FROM labeled), "
    f"(VALUES {', '.join(f'({float(f)}::DOUBLE)' for f in metrics.GRID_FRACTIONS)}) g(f)",
)
def _(t: Tables):
    """Each fraction is answered once per resample; the whole table holds every class's own number of draws."""
    hits = F.col("captured_positive_cases")
    every = F.when(F.min(hits) == F.max(hits), F.min(hits))
    return grid(t).groupBy("requested_fraction", "selected_count").agg(
        F.count(F.lit(1)).alias("iterations"), F.when(F.col("requested_fraction") == 1.0, every).alias("captured")
    )


@query("d6_encoded_matrix", "scored")
def _(t: Tables):
    enc = encoder(t)
    return round_all(association.matrix_diagnostics(enc.transform(split(t, "train"), []), enc.columns)[0])


@query(
    "d6_encoded_summary",
    "scored",
    """SELECT 'Development rows' AS metric, COUNT(*)::DOUBLE AS value FROM scored WHERE period = 'train'
    UNION ALL SELECT 'Encoded features', """
    + str(float(len(NUMERIC) + sum(len(v) - 1 for v in CATEGORICAL.values())))
    + """::DOUBLE""",
)
def _(t: Tables):
    enc = encoder(t)
    summary = association.matrix_diagnostics(enc.transform(split(t, "train"), []), enc.columns)[1]
    return summary.where(F.col("metric").isin("Development rows", "Encoded features"))


# ---- folds, comparison and load ---------------------------------------------------------------------------

FOLDS = 5
# The profiles' remainders, one step at a time: each goes to the fold with the least load so far.
BALANCED_SQL = f"""WITH RECURSIVE e AS (SELECT user_id, COUNT(*) AS n, CAST(SUM(actual_attrition) AS BIGINT) AS p FROM scored GROUP BY user_id),
    tt AS (SELECT CAST(SUM(n) AS BIGINT) AS n, CAST(SUM(p) AS BIGINT) AS p FROM e),
    pf AS (SELECT n, p, COUNT(*) AS m FROM e GROUP BY ALL),
    lf AS (SELECT pf.n, pf.p, m // {FOLDS} * {FOLDS} + k AS r, pf.n * GREATEST(tt.p, 1) + pf.p * tt.n AS w,
      ROW_NUMBER() OVER (ORDER BY pf.n DESC, pf.p DESC, k) AS step FROM pf, tt, range(1, {FOLDS}) x(k) WHERE k <= m % {FOLDS}),
    st AS (SELECT 0::BIGINT AS step, [0::HUGEINT, 0, 0, 0, 0] AS ld, 0 AS fold
      UNION ALL SELECT lf.step, list_transform(st.ld, lambda x, i: CASE WHEN i = list_position(st.ld, list_min(st.ld)) THEN x + lf.w ELSE x END),
        list_position(st.ld, list_min(st.ld)) FROM st JOIN lf ON lf.step = st.step + 1),
    rk AS (SELECT user_id, n, p, ROW_NUMBER() OVER (PARTITION BY n, p ORDER BY {draw_sql("'42'", 'user_id')}, user_id) AS r FROM e),
    fo AS (SELECT user_id, CAST(COALESCE(st.fold, (rk.r - 1) % {FOLDS} + 1) AS INT) AS fold
      FROM rk LEFT JOIN lf USING (n, p, r) LEFT JOIN st ON st.step = lf.step)"""


@query("r3_balanced_folds", "scored", f"{BALANCED_SQL} SELECT user_id, fold FROM fo")
def _(t: Tables):
    return resample.balanced_folds(t["scored"], "user_id", Y, FOLDS, 42)


@query(
    "r3_balanced_summary",
    "scored",
    f"""{BALANCED_SQL} SELECT fold, COUNT(*) AS rows, COUNT(DISTINCT user_id) AS entities, CAST(SUM(actual_attrition) AS BIGINT) AS positives,
    ROUND(AVG(actual_attrition), 6) AS positive_rate, 0::BIGINT AS entities_in_several_folds FROM scored JOIN fo USING (user_id) GROUP BY fold""",
)
def _(t: Tables):
    return round_all(resample.fold_summary(t["scored"], resample.balanced_folds(t["scored"], "user_id", Y, FOLDS, 42), "user_id", Y))


MISSING = "o_orderkey % 1000 = 3"
CELLS_SQL = " UNION ALL ".join(
    f"SELECT o_orderkey, '{c}' AS feature, {a} AS first_value, CASE WHEN {MISSING} THEN NULL ELSE {b} END AS second_value FROM o WHERE {MISSING} OR o_orderkey % {step} = 0"
    for c, step, a, b in [
        ("o_custkey", 50, "o_custkey::VARCHAR", "NULL"), ("o_orderstatus", 70, "o_orderstatus", "'X'"),
        ("o_totalprice", 90, "printf('%.4f', o_totalprice)", "printf('%.4f', o_totalprice + 0.5)"),
        ("o_orderdate", 110, "strftime(d, '%Y-%m-%d')", "strftime(d + 1, '%Y-%m-%d')"),
        ("large", 130, "CASE WHEN big THEN 'True' ELSE 'False' END", "CASE WHEN big THEN 'False' ELSE 'True' END"),
    ]
)


@query(
    "x1_located_differences",
    oracle="WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice::DOUBLE AS o_totalprice, CAST(o_orderdate AS DATE) AS d, "
    f"o_totalprice > 250000 AS big FROM orders) SELECT * FROM ({CELLS_SQL}) WHERE first_value IS DISTINCT FROM second_value",
)
def _(t: Tables):
    first, second = orders_twice(t)
    return diff.located_differences(first, second, ["o_orderkey"], CLASSES, 4, 500, 8)


@query(
    "x1_located_in_equal_tables",
    oracle="SELECT COUNT(*) AS rows_compared, 0::BIGINT AS unequal_buckets FROM orders",
)
def _(t: Tables):
    """Tables with the same rows in another order: no bucket is opened."""
    first = t.raw("orders")
    second = first.repartition(7, "o_custkey")
    columns = [c for c in first.columns if c != "o_orderkey"]
    nodes = diff.unequal_buckets(first, second, ["o_orderkey"], columns, {}, 64, 8)
    return first.agg(F.count(F.lit(1)).alias("rows_compared")).crossJoin(nodes.agg(F.count(F.lit(1)).alias("unequal_buckets")))  # one row each


LOADED = ["departments", "locations", "job_roles"]


@query(
    "s3_bulk_load",
    " ".join(LOADED),
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, COUNT(*) AS row_count FROM {n}" for n in LOADED),
)
def _(t: Tables):
    """CSV files of the tables, loaded with checked headers; the counts are those observed while loading."""
    folder = f"{checkpoint_dir(t.spark)}/load-{uuid.uuid4().hex}"
    chosen = []
    for name in LOADED:
        declared = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in t[name].schema)
        chosen.append(Contract(name, (t[name].columns[0],), declared))
        t[name].write.option("header", True).csv(f"{folder}/source/{name}.csv")
    return src.bulk_load(t.spark, f"{folder}/source", f"{folder}/target", chosen).select("table_name", "row_count")


# ---- fits with the whole panel, and leakage by data -----------------------------------------------------------

NEWTON_STEPS = 25
# Newton steps of two coefficients per group, the 2 x 2 system solved by hand.
NEWTON_SQL = f"""WITH RECURSIVE ba AS (SELECT user_id % 7 AS g, attrition_probability::DOUBLE * 10 AS x, actual_attrition::DOUBLE AS y FROM scored),
    cw AS (SELECT g, COUNT(*)::DOUBLE AS n, SUM(y) AS p FROM ba GROUP BY g),
    fr AS (SELECT ba.*, n / (2 * CASE WHEN y = 1 THEN p ELSE n - p END) AS w FROM ba JOIN cw USING (g)),
    st AS (SELECT g, 0 AS step, 0::DOUBLE AS b0, 0::DOUBLE AS b1 FROM cw
      UNION ALL SELECT g, step + 1, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
      FROM (SELECT st.g, step, b0, b1, SUM(w * (y - 1 / (1 + exp(-b0 - b1 * x)))) AS g0, SUM(w * (y - 1 / (1 + exp(-b0 - b1 * x))) * x) - b1 AS g1,
        SUM(w * exp(-b0 - b1 * x) / pow(1 + exp(-b0 - b1 * x), 2)) AS h00, SUM(w * exp(-b0 - b1 * x) / pow(1 + exp(-b0 - b1 * x), 2) * x) AS h01,
        SUM(w * exp(-b0 - b1 * x) / pow(1 + exp(-b0 - b1 * x), 2) * x * x) + 1 AS h11
        FROM st JOIN fr ON st.g = fr.g WHERE step < {NEWTON_STEPS} GROUP BY st.g, step, b0, b1))"""


@query(
    "l2_logistic_per_group",
    "scored",
    f"""{NEWTON_SQL} SELECT CAST(g AS INT) AS fit, unnest(['intercept', 'x']) AS encoded_feature, ROUND(unnest([b0, b1]), 6) AS coefficient, true AS converged
    FROM st WHERE step = {NEWTON_STEPS}""",
)
def _(t: Tables):
    """One balanced ridge fit per group, all in the same steps."""
    frame = t["scored"].select((F.col("user_id") % 7).alias("g"), (F.col("attrition_probability").cast("double") * 10).alias("x"), Y)
    return round_all(model.fit_logistic(frame, ["x"], Y, "g").table(t.spark))


PANEL_CATEGORICAL = [
    "employment_type", "education_level", "organizational_level", "department_name", "department_group", "region", "location_type", "job_family", "job_level",
]
PANEL_OTHER = {"employee_id", "dataset_type", "snapshot_sequence", "snapshot_date", "prediction_end_date", "city", "job_title", "attrition_next_12m"}
PANEL_NUMERIC = [c for c in panel.PANEL_COLUMNS if c not in PANEL_OTHER and c not in PANEL_CATEGORICAL]


@query("l2_panel_logistic", HR)
def _(t: Tables):
    """A fit to all features of the first labelled snapshot, scored on the second."""
    rows = store(full_panel(t).where("attrition_next_12m IS NOT NULL").withColumns({c: F.col(c).cast("double") for c in PANEL_NUMERIC}))
    train, later = (rows.where(F.col("snapshot_sequence") == s) for s in (1, 2))
    enc = model.fit_encoder(train, PANEL_NUMERIC, dict.fromkeys(PANEL_CATEGORICAL))
    fits = model.fit_logistic(enc.transform(train, ["attrition_next_12m"]), enc.columns, "attrition_next_12m")
    scored = model.score_by_fit(enc.transform(later, [ID, "attrition_next_12m"]).withColumn("fit", F.lit(0)), fits, "score")
    out = metrics.rank_metrics(scored, "score", "attrition_next_12m")
    return round_all(out.select(F.lit(len(enc.columns)).alias("encoded_features"), "roc_auc", "pr_auc"), 4)


TOLD_BY = [c for c in panel.PANEL_COLUMNS if c not in PANEL_OTHER] + ["termination_date"]


@query(
    "q23_columns_that_tell_the_outcome",
    HR,
    f"""WITH p AS ({PANEL_SQL}), l AS (SELECT p.*, e.termination_date FROM p JOIN employees e USING (employee_id) WHERE attrition_next_12m IS NOT NULL),
    c AS ("""
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, COUNT(*) FILTER ({c} IS NULL) AS missing, AVG(attrition_next_12m) FILTER ({c} IS NULL) AS a, AVG(attrition_next_12m) FILTER ({c} IS NOT NULL) AS b FROM l"
        for c in TOLD_BY
    )
    + """) SELECT feature, missing, ROUND(a, 6) AS rate_where_missing, ROUND(b, 6) AS rate_where_present,
    COALESCE(missing > 0 AND (a = 0 OR a = 1 OR b = 0 OR b = 1), false) AS tells_the_outcome FROM c""",
)
def _(t: Tables):
    """The panel's columns, and one that it must not have, by whether their presence settles the label."""
    leaving = t["employees"].select(ID, "termination_date")
    rows = full_panel(t).where("attrition_next_12m IS NOT NULL").join(leaving, ID)
    return round_all(quality.outcome_telling(rows, TOLD_BY, "attrition_next_12m"))


@query(
    "q26_windows_of_each_entity",
    HR,
    f"""WITH p AS (SELECT employee_id, snapshot_date, prediction_end_date, LEAD(snapshot_date) OVER (PARTITION BY employee_id ORDER BY snapshot_sequence) AS following FROM ({PANEL_SQL}))
    SELECT COUNT(*) AS rows, COUNT(following) AS followed, COUNT(*) FILTER (following < prediction_end_date) AS overlapping FROM p""",
)
def _(t: Tables):
    return quality.entity_windows(full_panel(t), ID, "snapshot_sequence", "snapshot_date", "prediction_end_date")
