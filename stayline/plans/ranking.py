"""Queries for ranks, reshaping, resampling and scoring metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from stayline.functions import expr as x
from stayline.operators import metrics, rank, reports, resample
from stayline.operators.rank import Key, keys
from stayline.plans.foundations import located
from stayline.plans.registry import Tables, query, round_all
from stayline.plans.reporting import LOCATED_NEEDS, LOCATED_SQL
from stayline.session import settle
from stayline.sources.tables import union_all

P, Y, ID = "attrition_probability", "actual_attrition", "employee_id"
BY_SCORE = [Key(P, True), Key(ID)]
ORDER_SQL = "attrition_probability DESC, employee_id"


@query("w1_global_rank", "scored", f"SELECT employee_id, ROW_NUMBER() OVER (ORDER BY {ORDER_SQL}) AS rank FROM scored")
def _(t: Tables):
    return rank.ranked(t["scored"], BY_SCORE).select(ID, "rank")


@query(
    "w1_global_rank_in_ranges",
    "scored",
    f"SELECT employee_id, region, ROW_NUMBER() OVER (PARTITION BY region ORDER BY {ORDER_SQL}) AS rank FROM scored",
)
def _(t: Tables):
    # small ranges, so that the split and its offsets are at work on small inputs too
    return rank.ranked(t["scored"], BY_SCORE, ["region"], rows_per_bucket=500).select(ID, "region", "rank")


@query(
    "w2_top_fraction_flag",
    "scored",
    f"""SELECT employee_id, ROW_NUMBER() OVER (ORDER BY {ORDER_SQL}) <= LEAST(COUNT(*) OVER (), GREATEST(1,
    CAST(CEIL(COUNT(*) OVER () * 0.1) AS BIGINT))) AS selected FROM scored""",
)
def _(t: Tables):
    return rank.flag_top_fraction(t["scored"], BY_SCORE, 0.10).select(ID, "selected")


NET_SQL = "attrition_probability * 0.25 * base_salary - 8000"


@query(
    "w3_best_prefix",
    "scored",
    f"""WITH r AS (SELECT employee_id, attrition_probability, SUM({NET_SQL}) OVER (ORDER BY {ORDER_SQL} ROWS UNBOUNDED PRECEDING) AS total,
    ROW_NUMBER() OVER (ORDER BY {ORDER_SQL}) AS n FROM scored)
    SELECT n AS prefix_rows, ROUND(total, 2) AS prefix_total, ROUND(attrition_probability, 6) AS attrition_probability FROM r WHERE total > 0 ORDER BY total DESC, n LIMIT 1""",
)
def _(t: Tables):
    net = t["scored"].withColumn("net", F.col(P) * 0.25 * F.col("base_salary") - 8000)
    return round_all(rank.best_prefix(net, BY_SCORE, "net", keep=[P]).withColumn("prefix_total", F.round("prefix_total", 2)))


@query(
    "w4_quantile_groups",
    "scored",
    """WITH r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY base_salary, employee_id) AS r, COUNT(*) OVER () AS n,
      ROW_NUMBER() OVER (PARTITION BY job_level ORDER BY base_salary, employee_id) AS rl, COUNT(*) OVER (PARTITION BY job_level) AS nl FROM scored)
    SELECT employee_id, CAST(GREATEST(1, CEIL((r - 1) * 5 / (n - 1)::DOUBLE)) AS INT) AS quintile,
    CAST(GREATEST(1, CEIL((rl - 1) * 4 / (nl - 1)::DOUBLE)) AS INT) AS quartile_in_level FROM r""",
)
def _(t: Tables):
    order = keys("base_salary", ID)
    out = rank.quantile_groups(t["scored"], order, 5, out="quintile")
    return rank.quantile_groups(out, order, 4, ["job_level"], "quartile_in_level").select(ID, "quintile", "quartile_in_level")


@query(
    "w5_equal_frequency_bins",
    "scored",
    "SELECT employee_id, CAST(NTILE(7) OVER (ORDER BY attrition_probability, employee_id) AS INT) AS bin FROM scored",
)
def _(t: Tables):
    return rank.equal_frequency_bins(t["scored"], keys(P, ID), 7).select(ID, "bin")


@query(
    "w6_value_quintiles",
    "scored",
    """WITH e AS (SELECT quantile_cont(base_salary, [0.2, 0.4, 0.6, 0.8]) AS q FROM scored)
    SELECT employee_id, CAST(CASE WHEN base_salary <= q[1] THEN 1 WHEN base_salary <= q[2] THEN 2 WHEN base_salary <= q[3] THEN 3
    WHEN base_salary <= q[4] THEN 4 ELSE 5 END AS INT) AS quintile FROM scored, e""",
)
def _(t: Tables):
    return rank.value_quantile_groups(t["scored"], "base_salary", 5, out="quintile").select(ID, "quintile")


@query(
    "w7_previous_value",
    "compensation_history",
    """SELECT compensation_id, employee_id, base_salary, LAG(base_salary) OVER (PARTITION BY employee_id ORDER BY effective_date, compensation_id)
    AS previous_salary FROM compensation_history""",
)
def _(t: Tables):
    from stayline.operators import quality

    out = quality.with_previous(
        t["compensation_history"], "employee_id", keys("effective_date", "compensation_id"), "base_salary", "previous_salary"
    )
    return out.select("compensation_id", "employee_id", "base_salary", "previous_salary")


@query(
    "w8_share_of_total",
    "scored",
    """SELECT department_name, COUNT(*) AS n, ROUND(100.0::DOUBLE * COUNT(*) / SUM(COUNT(*)) OVER (), 2) AS share_percent
    FROM scored GROUP BY department_name""",
)
def _(t: Tables):
    grouped = t["scored"].groupBy("department_name").agg(F.count(F.lit(1)).alias("n"))
    return reports.with_share(grouped, "n", "share_percent")


@query(
    "w9_event_sequence_ids",
    "employee_events",
    """SELECT employee_id, event_date, event_type, 900000 + ROW_NUMBER() OVER (ORDER BY employee_id, event_date,
    CASE event_type WHEN 'Hire' THEN 0 WHEN 'Promotion' THEN 1 WHEN 'Transfer' THEN 2 ELSE 3 END, event_id) AS new_event_id FROM employee_events""",
)
def _(t: Tables):
    priority = F.when(F.col("event_type") == "Hire", 0).when(F.col("event_type") == "Promotion", 1)
    events = t["employee_events"].withColumn("priority", priority.when(F.col("event_type") == "Transfer", 2).otherwise(3))
    out = rank.sequence_ids(events, keys("employee_id", "event_date", "priority", "event_id"), 900001, "new_event_id")
    return out.select("employee_id", "event_date", "event_type", "new_event_id")


AVG_RANK = "RANK() OVER (PARTITION BY department_name ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY department_name, {c}) - 1) / 2.0::DOUBLE"


@query(
    "w10_spearman",
    "scored",
    f"""WITH r AS (SELECT department_name, {AVG_RANK.format(c='attrition_probability')} AS a, {AVG_RANK.format(c='base_salary')} AS b FROM scored)
    SELECT department_name, ROUND(CORR(a, b), 6) AS spearman FROM r GROUP BY department_name""",
)
def _(t: Tables):
    return round_all(rank.spearman(t["scored"], P, "base_salary", ["department_name"]))


@query(
    "w11_top_per_domain",
    LOCATED_NEEDS,
    f"""WITH {LOCATED_SQL} SELECT 'Compensation records' AS domain, employee_id, effective_date AS record_date, current_location,
    historical_location, ROW_NUMBER() OVER (ORDER BY effective_date, compensation_id)::INT AS position FROM loc
    WHERE current_location <> historical_location QUALIFY position <= 20""",
)
def _(t: Tables):
    records = located(t, "compensation_history", "effective_date")
    return reports.changed_samples(records, "Compensation records", "effective_date", ["compensation_id"])


# ---- set operations and reshaping ---------------------------------------------------------------


@query(
    "u1_population_union",
    "scored",
    """SELECT 'train' AS population, employee_id, base_salary FROM scored WHERE period = 'train'
    UNION ALL SELECT 'test', employee_id, base_salary FROM scored WHERE period = 'test'""",
)
def _(t: Tables):
    return union_all(
        t["scored"].where(F.col("period") == p).select(F.lit(p).alias("population"), ID, "base_salary")
        for p in ("train", "test")
    )


@query(
    "u3_duplicate_keys",
    oracle="""SELECT COUNT(*) AS rows, CAST(COUNT(*) - COUNT(DISTINCT (l_orderkey, l_linenumber)) AS BIGINT) AS surplus_rows,
    CAST((SELECT COUNT(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1)) AS BIGINT) AS repeated_keys FROM lineitem""",
)
def _(t: Tables):
    from stayline.operators import quality

    return quality.duplicate_keys(t.raw("lineitem"), ["l_orderkey", "l_linenumber"])


TOPS_SQL = f"""SELECT *, ROW_NUMBER() OVER (ORDER BY {ORDER_SQL}) <= 1000 AS a,
    ROW_NUMBER() OVER (ORDER BY {NET_SQL} DESC, employee_id) <= 1000 AS b FROM scored"""


@query(
    "u4_overlap_and_jaccard",
    "scored",
    f"""SELECT COUNT(*) FILTER (WHERE a AND b) AS overlap, COUNT(*) FILTER (WHERE a OR b) AS either,
    ROUND(COUNT(*) FILTER (WHERE a AND b) / COUNT(*) FILTER (WHERE a OR b)::DOUBLE, 6) AS jaccard FROM ({TOPS_SQL})""",
)
def _(t: Tables):
    from stayline.operators import policy

    net = t["scored"].withColumn("net", F.col(P) * 0.25 * F.col("base_salary") - 8000)
    flagged = rank.ranked(rank.ranked(net, BY_SCORE, out="ra"), keys("-net", ID), out="rb")
    return round_all(policy.overlap(flagged, F.col("ra") <= 1000, F.col("rb") <= 1000))


# ---- splits and resampling ------------------------------------------------------------------------

SPLITS = {"1998-06-30": "train", "1999-06-30": "validation", "2000-06-30": "test"}
SPLIT_SQL = """SELECT employee_id, snapshot_date, CASE snapshot_date WHEN DATE '1998-06-30' THEN 'train' WHEN DATE '1999-06-30' THEN 'validation'
    ELSE 'test' END AS split, label FROM (SELECT employee_id, CAST(s.d AS DATE) AS snapshot_date,
      CAST(COALESCE(termination_date > s.d AND termination_date <= s.d + INTERVAL 1 YEAR, false) AS INT) AS label
      FROM employees, (VALUES (DATE '1998-06-30'), (DATE '1999-06-30'), (DATE '2000-06-30')) s(d)
      WHERE hire_date <= s.d AND (termination_date IS NULL OR termination_date > s.d))"""


def labelled_snapshots(t: Tables):
    from stayline.operators import asof, panel
    from stayline.plans.binding import SNAPSHOTS

    people = asof.expand_snapshots(
        t["employees"].select(ID, "hire_date", "termination_date"), "hire_date", "termination_date", SNAPSHOTS[:3]
    )
    label = panel.future_label(F.col("termination_date"), F.col("snapshot_date"), F.col("prediction_end_date"))
    return people.select(ID, "snapshot_date", label.alias("label"))


@query(
    "r1_temporal_split",
    "employees",
    f"SELECT employee_id, snapshot_date, split, CASE WHEN split <> 'test' THEN label END AS label FROM ({SPLIT_SQL})",
)
def _(t: Tables):
    return resample.temporal_split(labelled_snapshots(t), "snapshot_date", SPLITS, "label")


@query(
    "r2_split_summary",
    "employees",
    f"""SELECT split, COUNT(*) AS rows, COUNT(DISTINCT employee_id) AS entities,
    CASE WHEN split <> 'test' THEN CAST(SUM(label) AS VARCHAR) ELSE 'RESERVED' END AS positives,
    CASE WHEN split <> 'test' THEN ROUND(AVG(label), 6) END AS positive_rate FROM ({SPLIT_SQL}) GROUP BY split""",
)
def _(t: Tables):
    split = resample.temporal_split(labelled_snapshots(t), "snapshot_date", SPLITS, "label")
    return round_all(resample.split_summary(split, ID, "label"))


def draw_sql(*parts: str) -> str:
    text = " || '|' || ".join(f"CAST({p} AS VARCHAR)" if not p.startswith("'") else p for p in parts)
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


FOLDS_SQL = f"""WITH e AS (SELECT user_id, SUM(actual_attrition) AS pos FROM scored GROUP BY user_id)
    SELECT user_id, CAST((ROW_NUMBER() OVER (ORDER BY pos DESC, {draw_sql("'42'", 'user_id')}, user_id) - 1) % 5 + 1 AS INT) AS fold FROM e"""


@query("r3_grouped_folds", "scored", FOLDS_SQL)
def _(t: Tables):
    return resample.grouped_folds(t["scored"], "user_id", Y, 5, 42)


@query(
    "r3_fold_summary",
    "scored",
    f"""WITH f AS ({FOLDS_SQL}) SELECT fold, COUNT(*) AS rows, COUNT(DISTINCT user_id) AS entities, CAST(SUM(actual_attrition) AS BIGINT) AS positives,
    ROUND(AVG(actual_attrition), 6) AS positive_rate,
    (SELECT COUNT(*) FROM (SELECT user_id FROM f GROUP BY user_id HAVING COUNT(DISTINCT fold) > 1)) AS entities_in_several_folds
    FROM scored JOIN f USING (user_id) GROUP BY fold""",
)
def _(t: Tables):
    folds = resample.grouped_folds(t["scored"], "user_id", Y, 5, 42)
    return round_all(resample.fold_summary(t["scored"], folds, "user_id", Y))


@query(
    "r4_stratified_row_folds",
    "labeled",
    f"""SELECT doc_id, repeat, CAST((ROW_NUMBER() OVER (PARTITION BY repeat, toxic ORDER BY {draw_sql("'7'", 'repeat', 'doc_id')}, doc_id) - 1) % 5 + 1 AS INT) AS fold
    FROM labeled, (SELECT CAST(unnest(range(1, 11)) AS INT) AS repeat)""",
)
def _(t: Tables):
    return resample.row_folds(t["labeled"], "doc_id", "toxic", 5, 7, repeats=10)


@query(
    "r5_repeated_out_of_fold",
    "scored",
    f"""WITH f AS (SELECT employee_id, repeat, department_name AS g, actual_attrition AS y,
      (ROW_NUMBER() OVER (PARTITION BY repeat, actual_attrition ORDER BY {draw_sql("'9'", 'repeat', 'employee_id')}, employee_id) - 1) % 5 + 1 AS fold
      FROM scored, (SELECT unnest(range(1, 11)) AS repeat)),
    c AS (SELECT repeat, g, fold, SUM(y) AS p, COUNT(*) AS n FROM f GROUP BY ALL),
    t AS (SELECT repeat, g, SUM(p) AS tp, SUM(n) AS tn FROM c GROUP BY ALL),
    r AS (SELECT c.repeat, c.g, c.fold, COALESCE((tp - p)::DOUBLE / NULLIF(tn - n, 0), (SELECT AVG(actual_attrition) FROM scored)) AS score FROM c JOIN t USING (repeat, g))
    SELECT employee_id, ROUND(AVG(score), 8) AS mean_score, COUNT(*) AS scores, COUNT(*) = 10 AS covered FROM f JOIN r USING (repeat, g, fold) GROUP BY employee_id""",
)
def _(t: Tables):
    return round_all(resample.repeated_out_of_fold(t["scored"], ID, Y, 5, 10, 9, "department_name"), 8)


@query(
    "r6_stratified_holdout",
    "labeled",
    f"""SELECT doc_id, toxic, ROW_NUMBER() OVER (PARTITION BY toxic ORDER BY {draw_sql("'5'", 'doc_id')}, doc_id)
    <= CAST(CEIL(COUNT(*) OVER (PARTITION BY toxic) * 0.2) AS BIGINT) AS holdout FROM labeled""",
)
def _(t: Tables):
    return resample.stratified_holdout(t["labeled"].select("doc_id", "toxic"), "doc_id", "toxic", 0.2, 5)


ITERATIONS = 500
WEIGHTS_SQL = f"""ix AS (SELECT doc_id, toxic, toxic_score, quality_score, ROW_NUMBER() OVER (PARTITION BY toxic ORDER BY doc_id) AS slot,
      COUNT(*) OVER (PARTITION BY toxic) AS n FROM labeled),
    dr AS (SELECT iteration, toxic, {draw_sql("'42'", 'iteration', 'toxic', 'slot')} % n + 1 AS slot FROM ix,
      (SELECT CAST(unnest(range(1, {ITERATIONS + 1})) AS INT) AS iteration)),
    cn AS (SELECT iteration, toxic, slot, COUNT(*) AS weight FROM dr GROUP BY ALL),
    wt AS (SELECT iteration, toxic, weight, doc_id, toxic_score, quality_score FROM cn JOIN ix USING (toxic, slot))"""


def label_weights(t: Tables):
    return resample.bootstrap_weights(t["labeled"], "doc_id", ITERATIONS, 42, "toxic", ["toxic_score", "quality_score"])


@query(
    "r7_stratified_bootstrap",
    "labeled",
    f"WITH {WEIGHTS_SQL} SELECT iteration, doc_id, toxic, weight, toxic_score, quality_score FROM wt",
)
def _(t: Tables):
    return label_weights(t)


@query(
    "r8_cluster_bootstrap",
    "scored",
    f"""WITH u AS (SELECT user_id, SUM(actual_attrition) AS p, COUNT(*) AS n FROM scored GROUP BY user_id),
    ix AS (SELECT *, ROW_NUMBER() OVER (ORDER BY user_id) AS slot, COUNT(*) OVER () AS m FROM u),
    dr AS (SELECT iteration, {draw_sql("'11'", 'iteration', 'slot')} % m + 1 AS slot FROM ix, (SELECT CAST(unnest(range(1, 201)) AS INT) AS iteration))
    SELECT iteration, COUNT(DISTINCT user_id) AS clusters, CAST(COUNT(*) AS BIGINT) AS draws, ROUND(SUM(p) / SUM(n)::DOUBLE, 6) AS positive_rate
    FROM dr JOIN ix USING (slot) GROUP BY iteration""",
)
def _(t: Tables):
    # the unit is the user: draw users, then weight their collapsed rows
    users = t["scored"].groupBy("user_id").agg(F.sum(Y).alias("p"), F.count(F.lit(1)).alias("n"))
    weights = resample.bootstrap_weights(users, "user_id", 200, 11, values=["p", "n"])
    return round_all(
        weights.groupBy("iteration").agg(
            F.count(F.lit(1)).alias("clusters"),
            F.sum("weight").alias("draws"),
            x.safe_div(F.sum(F.col("weight") * F.col("p")), F.sum(F.col("weight") * F.col("n"))).alias("positive_rate"),
        )
    )


def model_counts(t: Tables):
    """Draws of the labelled documents, long by score so that both scores share them."""
    pairs = F.array(
        F.struct(F.lit("quality").alias("model"), F.col("quality_score").alias("score")),
        F.struct(F.lit("toxicity").alias("model"), F.col("toxic_score").alias("score")),
    )
    counted = resample.bootstrap_counts(t["labeled"], "doc_id", ITERATIONS, 42, "toxic", ["toxic_score", "quality_score"])
    return counted.select("doc_id", "toxic", "counts", F.explode(pairs).alias("_m")).select("doc_id", "toxic", "counts", "_m.*")


BOOT_SQL = f"""{WEIGHTS_SQL}, ml AS (SELECT iteration, doc_id, toxic, weight, 'toxicity' AS model, toxic_score AS score FROM wt
      UNION ALL SELECT iteration, doc_id, toxic, weight, 'quality', quality_score FROM wt),
    st AS (SELECT iteration, model, score, SUM(weight * toxic) AS pos, SUM(weight * (1 - toxic)) AS neg FROM ml GROUP BY ALL),
    cm AS (SELECT *, SUM(pos) OVER w AS cp, SUM(neg) OVER w AS cn FROM st WINDOW w AS (PARTITION BY iteration, model ORDER BY score DESC)),
    rm AS (SELECT iteration, model, SUM(neg * (cp - pos / 2.0::DOUBLE)) / (SUM(pos)::DOUBLE * SUM(neg)) AS roc_auc,
      SUM(pos * cp / (cp + cn)::DOUBLE) / SUM(pos)::DOUBLE AS pr_auc FROM cm GROUP BY ALL),
    br AS (SELECT iteration, model, SUM(weight * pow(score - toxic, 2)) / SUM(weight)::DOUBLE AS brier_score FROM ml GROUP BY ALL),
    ru AS (SELECT *, SUM(weight) OVER (PARTITION BY iteration, model ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING) AS cum,
      SUM(weight) OVER (PARTITION BY iteration, model) AS n, SUM(weight * toxic) OVER (PARTITION BY iteration, model) AS pos FROM ml),
    tp AS (SELECT iteration, model, MAX(CEIL(n * 0.1)) AS k, MAX(n) AS n, MAX(pos) AS pos,
      SUM(toxic * GREATEST(0, LEAST(weight, CEIL(n * 0.1) - (cum - weight)))) AS hit FROM ru GROUP BY ALL),
    bm AS (SELECT iteration, model, roc_auc, pr_auc, brier_score, hit / k::DOUBLE AS top_precision, hit / pos::DOUBLE AS top_capture,
      (hit / k::DOUBLE) / (pos / n::DOUBLE) AS top_lift FROM rm JOIN br USING (iteration, model) JOIN tp USING (iteration, model))"""
BOOT_COLUMNS = ["roc_auc", "pr_auc", "brier_score", "top_precision", "top_capture", "top_lift"]


def boot(t: Tables):
    return metrics.resampled_metrics(model_counts(t), "score", "toxic", "doc_id", ["model"])


@query(
    "r7_bootstrap_metrics",
    "labeled",
    f"WITH {BOOT_SQL} SELECT iteration, model, {', '.join(f'ROUND({c}, 6) AS {c}' for c in BOOT_COLUMNS)} FROM bm",
)
def _(t: Tables):
    return round_all(boot(t))


@query(
    "r9_percentile_intervals",
    "labeled",
    f"WITH {BOOT_SQL} "
    + " UNION ALL ".join(
        f"SELECT model, '{c}' AS metric, ROUND(AVG({c}), 6) AS bootstrap_mean, ROUND(quantile_cont({c}, 0.025), 6) AS lower, ROUND(quantile_cont({c}, 0.975), 6) AS upper FROM bm GROUP BY model"
        for c in BOOT_COLUMNS
    ),
)
def _(t: Tables):
    return round_all(resample.percentile_intervals(boot(t), ["model"], BOOT_COLUMNS))


@query(
    "u5_metric_pivot",
    "labeled",
    f"""WITH {BOOT_SQL} SELECT iteration, ROUND(MAX(pr_auc) FILTER (WHERE model = 'quality'), 6) AS quality,
    ROUND(MAX(pr_auc) FILTER (WHERE model = 'toxicity'), 6) AS toxicity FROM bm GROUP BY iteration""",
)
def _(t: Tables):
    return round_all(resample.pivot_metric(boot(t), "model", "pr_auc", ["quality", "toxicity"]))


@query(
    "m10_paired_difference",
    "labeled",
    f"""WITH {BOOT_SQL}, ob AS (WITH s AS (SELECT 'toxicity' AS model, toxic_score AS score, toxic FROM labeled UNION ALL SELECT 'quality', quality_score, toxic FROM labeled),
      g AS (SELECT model, score, SUM(toxic) AS pos, COUNT(*) AS n FROM s GROUP BY ALL),
      c AS (SELECT *, SUM(pos) OVER w AS cp, SUM(n) OVER w AS cn FROM g WINDOW w AS (PARTITION BY model ORDER BY score DESC))
      SELECT model, SUM(pos * cp / cn::DOUBLE) / SUM(pos)::DOUBLE AS pr_auc FROM c GROUP BY model),
    df AS (SELECT a.iteration, a.pr_auc - b.pr_auc AS d FROM bm a JOIN bm b USING (iteration) WHERE a.model = 'quality' AND b.model = 'toxicity'),
    iv AS (SELECT AVG(d) AS m, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi FROM df)
    SELECT 'quality' AS model_a, 'toxicity' AS model_b, ROUND((SELECT pr_auc FROM ob WHERE model = 'quality') - (SELECT pr_auc FROM ob WHERE model = 'toxicity'), 6) AS observed_difference,
    ROUND(m, 6) AS bootstrap_mean_difference, ROUND(lo, 6) AS difference_lower, ROUND(hi, 6) AS difference_upper, lo <= 0 AND hi >= 0 AS interval_includes_zero,
    CASE WHEN lo > 0 THEN 'quality higher' WHEN hi < 0 THEN 'toxicity higher' ELSE 'Inconclusive' END AS conclusion FROM iv""",
)
def _(t: Tables):
    pairs = F.array(
        F.struct(F.lit("quality").alias("model"), F.col("quality_score").alias("score")),
        F.struct(F.lit("toxicity").alias("model"), F.col("toxic_score").alias("score")),
    )
    long = t["labeled"].select("toxic", F.explode(pairs).alias("_m")).select("toxic", "_m.*")
    observed = metrics.rank_metrics(long, "score", "toxic", ["model"])
    return round_all(resample.paired_differences(boot(t), observed, "model", "pr_auc"))


# ---- scoring metrics --------------------------------------------------------------------------------


@query(
    "m1_confusion_counts",
    "scored",
    """SELECT department_name, COUNT(*) FILTER (WHERE actual_attrition = 0 AND attrition_probability < 0.4) AS true_negative,
    COUNT(*) FILTER (WHERE actual_attrition = 0 AND attrition_probability >= 0.4) AS false_positive,
    COUNT(*) FILTER (WHERE actual_attrition = 1 AND attrition_probability < 0.4) AS false_negative,
    COUNT(*) FILTER (WHERE actual_attrition = 1 AND attrition_probability >= 0.4) AS true_positive FROM scored GROUP BY department_name""",
)
def _(t: Tables):
    return metrics.confusion(t["scored"], Y, F.col(P) >= 0.4, ["department_name"])


THRESHOLDS = [round(0.10 + 0.05 * i, 2) for i in range(17)]
SWEEP_SQL = f"""WITH c AS (SELECT h.t AS threshold, COUNT(*) FILTER (WHERE attrition_probability >= h.t AND actual_attrition = 1) AS tp,
      COUNT(*) FILTER (WHERE attrition_probability >= h.t AND actual_attrition = 0) AS fp,
      COUNT(*) FILTER (WHERE attrition_probability < h.t AND actual_attrition = 1) AS fn,
      COUNT(*) FILTER (WHERE attrition_probability < h.t AND actual_attrition = 0) AS tn
      FROM scored, (VALUES {', '.join(f'({t}::DOUBLE)' for t in THRESHOLDS)}) h(t) GROUP BY h.t),
    m AS (SELECT *, COALESCE(tp / NULLIF(tp + fp, 0)::DOUBLE, 0) AS pr, COALESCE(tp / NULLIF(tp + fn, 0)::DOUBLE, 0) AS rc FROM c)
    SELECT threshold, ROUND((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 4) AS accuracy, ROUND(pr, 4) AS precision, ROUND(rc, 4) AS recall,
    ROUND(COALESCE(2 * pr * rc / NULLIF(pr + rc, 0), 0), 4) AS f1, tp + fp AS predicted_attrition_count, tn AS true_negative,
    fp AS false_positive, fn AS false_negative, tp AS true_positive FROM m"""


@query("m2_threshold_sweep", "scored", SWEEP_SQL)
def _(t: Tables):
    return metrics.threshold_sweep(t["scored"], P, Y, THRESHOLDS)


@query(
    "m3_recommended_threshold",
    "scored",
    f"""SELECT * FROM ({SWEEP_SQL}) ORDER BY recall >= 0.6 DESC, CASE WHEN recall >= 0.6 THEN precision ELSE f1 END DESC, f1 DESC, threshold DESC LIMIT 1""",
)
def _(t: Tables):
    return metrics.recommended_threshold(metrics.threshold_sweep(t["scored"], P, Y, THRESHOLDS))


def curve_sql(by: str) -> str:
    group = f"GROUP BY {by}" if by else ""
    part = f"PARTITION BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""st AS (SELECT {lead}attrition_probability AS s, SUM(actual_attrition) AS pos, SUM(1 - actual_attrition) AS neg FROM scored GROUP BY {lead}s),
    cm AS (SELECT *, SUM(pos) OVER w AS cp, SUM(neg) OVER w AS cn FROM st WINDOW w AS ({part} ORDER BY s DESC)),
    rm AS (SELECT {lead}SUM(neg * (cp - pos / 2.0::DOUBLE)) / NULLIF(SUM(pos)::DOUBLE * SUM(neg), 0) AS roc_auc,
      SUM(pos * cp / (cp + cn)::DOUBLE) / NULLIF(SUM(pos), 0)::DOUBLE AS pr_auc FROM cm {group})"""


@query("m4_roc_auc", "scored", f"WITH {curve_sql('region')} SELECT region, ROUND(roc_auc, 8) AS roc_auc FROM rm")
def _(t: Tables):
    return round_all(metrics.rank_metrics(t["scored"], P, Y, ["region"]).select("region", "roc_auc"), 8)


@query("m5_average_precision", "scored", f"WITH {curve_sql('')} SELECT ROUND(pr_auc, 8) AS pr_auc FROM rm")
def _(t: Tables):
    return round_all(metrics.rank_metrics(t["scored"], P, Y).select("pr_auc"), 8)


PROB_SQL = """SELECT period, COUNT(*) AS rows, CAST(SUM(actual_attrition) AS BIGINT) AS positive_cases, ROUND(AVG(actual_attrition), 8) AS observed_attrition_rate,
    ROUND(AVG(attrition_probability), 8) AS mean_predicted_probability, ROUND(AVG(attrition_probability) - AVG(actual_attrition), 8) AS mean_calibration_gap,
    ROUND(AVG(pow(attrition_probability - actual_attrition, 2)), 8) AS brier_score,
    ROUND(1 - AVG(pow(attrition_probability - actual_attrition, 2)) / (AVG(actual_attrition) * (1 - AVG(actual_attrition))), 8) AS brier_skill_score,
    ROUND(-AVG(actual_attrition * ln(attrition_probability) + (1 - actual_attrition) * ln(1 - attrition_probability)), 8) AS log_loss
    FROM scored GROUP BY period"""


@query("m6_probability_metrics", "scored", PROB_SQL)
def _(t: Tables):
    return round_all(metrics.probability_metrics(t["scored"], P, Y, ["period"]), 8)


FRACTION_VALUES = ", ".join(f"({f})" for f in metrics.GRID_FRACTIONS)
GRID_SQL = """WITH r AS (SELECT period, attrition_probability AS p, actual_attrition AS y, ROW_NUMBER() OVER (PARTITION BY period ORDER BY attrition_probability DESC, employee_id) AS r,
      COUNT(*) OVER (PARTITION BY period) AS n, SUM(actual_attrition) OVER (PARTITION BY period) AS pos FROM scored),
    g AS (SELECT period, f::DOUBLE AS requested_fraction, MAX(LEAST(n, GREATEST(1, CAST(CEIL(n * f) AS BIGINT)))) AS k, MAX(n) AS n, MAX(pos) AS pos,
      SUM(y) FILTER (WHERE r <= LEAST(n, GREATEST(1, CEIL(n * f)))) AS hit, MIN(p) FILTER (WHERE r <= LEAST(n, GREATEST(1, CEIL(n * f)))) AS lo,
      MAX(p) FILTER (WHERE r > LEAST(n, GREATEST(1, CEIL(n * f)))) AS hi FROM r, (VALUES {values}) v(f) GROUP BY period, f)
    SELECT period, requested_fraction, k AS selected_count, ROUND(k / n::DOUBLE, 8) AS actual_selected_fraction, CAST(hit AS BIGINT) AS captured_positive_cases,
    CAST(k - hit AS BIGINT) AS false_positive_cases, ROUND(hit / k::DOUBLE, 8) AS precision_at_k, ROUND(hit / pos::DOUBLE, 8) AS capture_rate_at_k,
    ROUND((hit / k::DOUBLE) / (pos / n::DOUBLE), 8) AS lift_at_k, ROUND(k * (pos / n::DOUBLE), 8) AS expected_random_positive_cases,
    ROUND(lo, 8) AS minimum_selected_probability, ROUND(hi, 8) AS maximum_unselected_probability, ROUND(k / NULLIF(hit, 0)::DOUBLE, 8) AS reviews_per_captured_case FROM g"""


@query("m7_ranking_grid", "scored", GRID_SQL.format(values=FRACTION_VALUES))
def _(t: Tables):
    return round_all(metrics.ranking_grid(t["scored"], P, Y, ID, by=["period"]), 8)


@query(
    "m8_curve_points",
    "scored",
    f"""WITH {curve_sql('')}, tt AS (SELECT SUM(actual_attrition) AS pp, SUM(1 - actual_attrition) AS nn, COUNT(*) AS n FROM scored),
    r AS (SELECT attrition_probability AS p, actual_attrition AS y, ROW_NUMBER() OVER (ORDER BY {ORDER_SQL}) AS r FROM scored),
    kk AS (SELECT i, CAST(CEIL(n * i / 100.0::DOUBLE) AS BIGINT) AS k, pp, n FROM tt, (SELECT unnest(range(1, 101)) AS i)),
    gg AS (SELECT i, MAX(k) AS k, MAX(pp) AS pp, MAX(n) AS n, SUM(y) AS hit, MIN(p) AS lo FROM kk JOIN r ON r.r <= kk.k GROUP BY i)
    SELECT 'precision_recall' AS curve_type, ROUND(cp / pp::DOUBLE, 8) AS x, ROUND(cp / (cp + cn)::DOUBLE, 8) AS y, ROUND(s, 8) AS threshold FROM cm, tt
    UNION ALL SELECT 'roc', ROUND(cn / nn::DOUBLE, 8), ROUND(cp / pp::DOUBLE, 8), ROUND(s, 8) FROM cm, tt
    UNION ALL SELECT 'precision_recall', 0, 1, NULL UNION ALL SELECT 'roc', 0, 0, NULL
    UNION ALL SELECT 'cumulative_gains', ROUND(k / n::DOUBLE, 8), ROUND(hit / pp::DOUBLE, 8), ROUND(lo, 8) FROM gg
    UNION ALL SELECT 'lift', ROUND(k / n::DOUBLE, 8), ROUND((hit / k::DOUBLE) / (pp / n::DOUBLE), 8), ROUND(lo, 8) FROM gg""",
)
def _(t: Tables):
    return round_all(metrics.curve_points(t["scored"], P, Y, ID), 8)


BINS_SQL = """bn AS (SELECT period, actual_attrition AS y, attrition_probability AS p, CAST(NTILE(10) OVER (PARTITION BY period ORDER BY attrition_probability, employee_id) AS INT) AS bin FROM scored),
    ct AS (SELECT period, bin, COUNT(*) AS records, CAST(SUM(y) AS BIGINT) AS positive_cases, MIN(p) AS minimum_probability, MAX(p) AS maximum_probability,
      AVG(p) AS mean_predicted_probability, AVG(y) AS observed_attrition_rate FROM bn GROUP BY ALL)"""


@query(
    "m9_calibration_table",
    "scored",
    f"""WITH {BINS_SQL} SELECT period, bin, records, positive_cases, ROUND(minimum_probability, 8) AS minimum_probability, ROUND(maximum_probability, 8) AS maximum_probability,
    ROUND(mean_predicted_probability, 8) AS mean_predicted_probability, ROUND(observed_attrition_rate, 8) AS observed_attrition_rate,
    ROUND(mean_predicted_probability - observed_attrition_rate, 8) AS calibration_gap,
    ROUND(ABS(mean_predicted_probability - observed_attrition_rate), 8) AS absolute_calibration_gap FROM ct""",
)
def _(t: Tables):
    return round_all(metrics.calibration_table(t["scored"], P, Y, ID, by=["period"]), 8)


@query(
    "m9_calibration_errors",
    "scored",
    f"""WITH {BINS_SQL} SELECT period, ROUND(SUM(records * ABS(mean_predicted_probability - observed_attrition_rate)) / SUM(records), 8) AS expected_calibration_error,
    ROUND(MAX(ABS(mean_predicted_probability - observed_attrition_rate)), 8) AS maximum_calibration_error FROM ct GROUP BY period""",
)
def _(t: Tables):
    return round_all(metrics.calibration_errors(metrics.calibration_table(t["scored"], P, Y, ID, by=["period"]), ["period"]), 8)


ROBUST_SQL = f"""WITH fo AS ({FOLDS_SQL}), lg AS (SELECT s.*, fo.fold, m.model, CASE WHEN m.model = 'flat' THEN 0.2 + 0 * attrition_probability ELSE attrition_probability END AS score
      FROM scored s JOIN fo USING (user_id), (VALUES ('flat'), ('score')) m(model)),
    st AS (SELECT model, fold, score AS s, SUM(actual_attrition) AS pos, SUM(1 - actual_attrition) AS neg FROM lg GROUP BY ALL),
    cm AS (SELECT *, SUM(pos) OVER w AS cp, SUM(neg) OVER w AS cn FROM st WINDOW w AS (PARTITION BY model, fold ORDER BY s DESC)),
    rm AS (SELECT model, fold, SUM(neg * (cp - pos / 2.0::DOUBLE)) / (SUM(pos)::DOUBLE * SUM(neg)) AS roc_auc, SUM(pos * cp / (cp + cn)::DOUBLE) / SUM(pos)::DOUBLE AS pr_auc FROM cm GROUP BY ALL),
    br AS (SELECT model, fold, AVG(pow(score - actual_attrition, 2)) AS brier_score FROM lg GROUP BY ALL),
    tp AS (SELECT model, fold, AVG(actual_attrition) FILTER (WHERE r <= CEIL(n * 0.1)) AS precision_at_k, AVG(actual_attrition) FILTER (WHERE r <= CEIL(n * 0.1)) / AVG(actual_attrition) AS lift_at_k
      FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY model, fold ORDER BY score DESC, employee_id) AS r, COUNT(*) OVER (PARTITION BY model, fold) AS n FROM lg) GROUP BY ALL)
    SELECT model, COUNT(*) AS folds, """ + ", ".join(
    f"ROUND(AVG({c}), 8) AS {c}_mean, ROUND(STDDEV_SAMP({c}), 8) AS {c}_std" for c in ["pr_auc", "roc_auc", "brier_score", "precision_at_k", "lift_at_k"]
) + " FROM rm JOIN br USING (model, fold) JOIN tp USING (model, fold) GROUP BY model"


@query("m11_fold_robustness", "scored", ROBUST_SQL)
def _(t: Tables):
    folds = resample.grouped_folds(t["scored"], "user_id", Y, 5, 42)
    models = F.array(
        F.struct(F.lit("flat").alias("model"), (F.lit(0.2) + F.lit(0.0) * F.col(P)).alias("score")),
        F.struct(F.lit("score").alias("model"), F.col(P).alias("score")),
    )
    long = t["scored"].join(folds, "user_id").select(ID, Y, "fold", F.explode(models).alias("_m")).select(ID, Y, "fold", "_m.*")
    _, summary = metrics.fold_robustness(settle(long), "score", Y, ID, "model", "fold")
    return round_all(summary, 8)


@query(
    "m12_ranking_summary",
    "scored",
    f"""WITH {curve_sql('')}, r AS (SELECT attrition_probability AS p, actual_attrition AS y, ROW_NUMBER() OVER (ORDER BY {ORDER_SQL}) AS r, COUNT(*) OVER () AS n FROM scored),
    q AS (SELECT MAX(n) AS n, SUM(y) AS pos, COUNT(*) FILTER (WHERE r <= CEIL(n * 0.1)) AS k, SUM(y) FILTER (WHERE r <= CEIL(n * 0.1)) AS tp, MIN(p) FILTER (WHERE r <= CEIL(n * 0.1)) AS lo FROM r)
    SELECT n AS validation_rows, CAST(pos AS BIGINT) AS positive_cases, ROUND(pos / n::DOUBLE, 8) AS positive_rate, ROUND(pr_auc, 8) AS pr_auc,
    ROUND(pr_auc / (pos / n::DOUBLE), 8) AS pr_auc_lift_over_no_skill, ROUND(roc_auc, 8) AS roc_auc, 0.1::DOUBLE AS reporting_fraction, k AS reporting_selected_count,
    ROUND(tp / k::DOUBLE, 8) AS reporting_precision, ROUND(tp / pos::DOUBLE, 8) AS reporting_capture_rate, ROUND((tp / k::DOUBLE) / (pos / n::DOUBLE), 8) AS reporting_lift,
    ROUND(lo, 8) AS reporting_probability_cutoff, CAST(n - pos - (k - tp) AS BIGINT) AS true_negative, CAST(k - tp AS BIGINT) AS false_positive,
    CAST(pos - tp AS BIGINT) AS false_negative, CAST(tp AS BIGINT) AS true_positive FROM q, rm""",
)
def _(t: Tables):
    return round_all(metrics.ranking_summary(t["scored"], P, Y, ID), 8)
