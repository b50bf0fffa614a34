"""Queries for scans, projections and joins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stayline.functions import expr as x
from stayline.operators import asof, panel, rank, reports
from stayline.plans.binding import AS_OF, SNAPSHOTS, snapshot_values
from stayline.plans.registry import Tables, query
from stayline.session import checkpoint_dir, store
from stayline.sources import tables as src

def today():
    return F.lit(AS_OF).cast("date")



# ---- scans and sinks ------------------------------------------------------------------------


@query(
    "s1_typed_scan",
    oracle="""SELECT o_orderkey AS compensation_id, o_custkey AS employee_id, CAST(o_orderdate AS DATE) AS effective_date,
              CAST(o_totalprice AS DOUBLE) AS base_salary FROM orders""",
)
def _(t: Tables):
    renamed = t.raw("orders").select(
        F.col("o_orderkey").alias("compensation_id"),
        F.col("o_custkey").alias("employee_id"),
        F.col("o_orderdate").alias("effective_date"),
        F.col("o_totalprice").alias("base_salary"),
    )
    return src.typed_scan(renamed, "compensation_id bigint, employee_id bigint, effective_date date, base_salary double")


@query(
    "s2_least_privilege_view",
    "employees",
    """SELECT employee_id, hire_date, termination_date, employment_status, termination_type, department_id, location_id,
       job_role_id, employment_type, birth_year, education_level, organizational_level FROM employees""",
)
def _(t: Tables):
    src.create_views({"employees": t["employees"]}, {"employees": ["manager_id", "account_balance"]}, "analytics_v2_")
    return t.spark.sql("SELECT * FROM analytics_v2_employees")


COUNTED = ["customer", "orders", "lineitem", "part", "supplier", "nation", "region", "events", "documents", "labels"]


@query(
    "s3_loaded_row_counts",
    oracle=" UNION ALL ".join(f"SELECT '{n}' AS table_name, COUNT(*) AS row_count FROM {n}" for n in COUNTED),
)
def _(t: Tables):
    return src.row_counts({n: t.raw(n) for n in COUNTED})


@query(
    "s4_count_reconciliation",
    "employees compensation_history performance_reviews",
    """SELECT n.table_name, source_rows, target_rows, source_rows = target_rows AS matches FROM
       (SELECT 'employees' AS table_name, COUNT(*) AS source_rows FROM customer
        UNION ALL SELECT 'compensation_history', COUNT(*) FROM orders
        UNION ALL SELECT 'performance_reviews', COUNT(*) FROM lineitem) n
       JOIN (SELECT 'employees' AS table_name, COUNT(*) AS target_rows FROM employees
        UNION ALL SELECT 'compensation_history', COUNT(*) FROM compensation_history
        UNION ALL SELECT 'performance_reviews', COUNT(*) FROM performance_reviews) m ON n.table_name = m.table_name""",
)
def _(t: Tables):
    source = {"employees": "customer", "compensation_history": "orders", "performance_reviews": "lineitem"}
    return src.reconcile_counts({k: t.raw(v) for k, v in source.items()}, t.pick(*source))


def _digest_sql(texts: str, table: str) -> str:
    sums = ", ".join(
        f"CAST(SUM(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT) AS BIGINT) AS digest_{i + 1}" for i in range(4)
    )
    return f"SELECT COUNT(*) AS row_count, {sums} FROM (SELECT md5({texts}) AS h FROM {table})"


ORDER_TEXT = "concat_ws(chr(31), o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d'), printf('%.2f', o_totalprice))"


@query("s5_content_fingerprint", oracle=_digest_sql(ORDER_TEXT, "orders"))
def _(t: Tables):
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_totalprice"]
    return src.fingerprint(t.raw("orders"), columns, {"o_totalprice": 2})


@query(
    "s6_provenance",
    oracle=" UNION ALL ".join(
        f"SELECT 'parquet' AS backend, '{n}' AS relation, '{k}' AS key_column, {c} AS column_count, d.* FROM ({_digest_sql(e, n)}) d"
        for n, k, c, e in [
            ("labels", "doc_id", 3, "concat_ws(chr(31), doc_id::VARCHAR, quality::VARCHAR, toxic::VARCHAR)"),
            ("nation", "n_nationkey", 3, "concat_ws(chr(31), n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR)"),
            ("benchmark", "item_id", 2, "concat_ws(chr(31), item_id::VARCHAR, text)"),
        ]
    ),
)
def _(t: Tables):
    return src.provenance(
        {n: ("parquet", k, t.raw(n)) for n, k in (("labels", "doc_id"), ("nation", "n_nationkey"), ("benchmark", "item_id"))}
    )


@query(
    "s7_partitioned_layout",
    "employees",
    """SELECT 'S' || CAST(year(hire_date) AS VARCHAR) AS partition_value, COUNT(*) AS rows, MIN(employee_id) AS first_id
       FROM employees GROUP BY 1""",
)
def _(t: Tables):
    # written by year of hire and read back: the partition value comes from the folder names
    path = f"{checkpoint_dir(t.spark)}/layout-{uuid.uuid4().hex}"
    value = F.concat(F.lit("S"), F.year("hire_date").cast("string"))
    src.write_partitioned(t["employees"].withColumn("partition_value", value), path, "partition_value")
    written = t.spark.read.parquet(path)
    return written.groupBy("partition_value").agg(F.count(F.lit(1)).alias("rows"), F.min("employee_id").alias("first_id"))


@query(
    "s8_two_source_parity",
    "compensation_history",
    """WITH changed AS (
         SELECT compensation_id, CASE WHEN compensation_id % 7 = 3 THEN base_salary + 1 ELSE base_salary END AS base_salary FROM compensation_history
         UNION ALL SELECT compensation_id, base_salary FROM compensation_history WHERE compensation_id % 11 = 5
       ), versions AS (
         SELECT 'changed' AS table_name, compensation_id, base_salary FROM changed
         UNION ALL SELECT 'written', compensation_id, base_salary FROM compensation_history
       ), sizes AS (
         SELECT table_name, COUNT(*) AS n, COUNT(*) - COUNT(DISTINCT compensation_id) AS k FROM versions GROUP BY table_name
       ), gaps AS (
         SELECT table_name, COUNT(*) AS g FROM (
           SELECT table_name, compensation_id, base_salary, COUNT(*) AS n FROM versions GROUP BY ALL
           EXCEPT SELECT v.name, compensation_id, base_salary, COUNT(*) FROM compensation_history, (VALUES ('changed'), ('written')) v(name) GROUP BY ALL
         ) GROUP BY table_name
       )
       SELECT table_name, f.n AS first_rows, s.n AS second_rows, f.k AS first_duplicate_keys, s.k AS second_duplicate_keys,
         true AS same_columns, f.n = s.n AS same_rows, COALESCE(g, 0) = 0 AND f.n = s.n AS same_content
       FROM sizes s CROSS JOIN (SELECT n, k FROM sizes WHERE table_name = 'written') f LEFT JOIN gaps USING (table_name)""",
)
def _(t: Tables):
    # against a copy that was written and read back, and one with changed and repeated rows
    first = t["compensation_history"]
    salary = F.when(F.col("compensation_id") % 7 == 3, F.col("base_salary") + 1).otherwise(F.col("base_salary"))
    changed = first.withColumn("base_salary", salary).unionByName(first.where("compensation_id % 11 = 5"))
    second = {"written": store(first), "changed": changed}
    report = src.parity_report({n: first for n in second}, second, {n: ["compensation_id"] for n in second})
    return report.drop("first_digest", "second_digest")


# ---- projections and predicates ---------------------------------------------------------------


@query(
    "p1_active_as_of",
    "employees",
    f"""SELECT employee_id, hire_date, termination_date FROM employees
       WHERE hire_date <= DATE '{AS_OF}' AND (termination_date IS NULL OR termination_date > DATE '{AS_OF}')
       AND employment_status = 'Active'""",
)
def _(t: Tables):
    active = x.active_on("hire_date", "termination_date", today()) & (F.col("employment_status") == "Active")
    return t["employees"].where(active).select("employee_id", "hire_date", "termination_date")


ELIGIBLE = ["Individual Contributor", "Manager"]


@query(
    "p2_eligible_levels",
    "employees",
    """SELECT department_id, COUNT(*) AS headcount,
       COUNT(*) FILTER (WHERE organizational_level IN ('Individual Contributor', 'Manager')) AS eligible
       FROM employees GROUP BY department_id""",
)
def _(t: Tables):
    return t["employees"].groupBy("department_id").agg(
        F.count(F.lit(1)).alias("headcount"), x.count_if(F.col("organizational_level").isin(*ELIGIBLE)).alias("eligible")
    )


BANDED_SQL = """WITH q AS (SELECT quantile_cont(attrition_probability, 0.9) AS hi,
       quantile_cont(attrition_probability, 0.7) AS mid FROM scored)
       SELECT employee_id, attrition_probability, CASE WHEN attrition_probability >= hi THEN 'High'
       WHEN attrition_probability >= mid THEN 'Medium' ELSE 'Low' END AS probability_band FROM scored, q"""


@query("p3_probability_bands", "scored", BANDED_SQL)
def _(t: Tables):
    return bands(t["scored"]).select("employee_id", "attrition_probability", "probability_band")


def bands(df):
    cuts = rank.exact_quantiles(df, "attrition_probability", {"_hi": 0.9, "_mid": 0.7}).drop("_n")
    return rank.attach(df, cuts, []).withColumn(
        "probability_band", x.band("attrition_probability", F.col("_hi"), F.col("_mid"))
    )


@query(
    "p4_fixed_edge_bins",
    "scored",
    """SELECT employee_id,
       CASE WHEN base_salary < 5E4 THEN 'under 50k' WHEN base_salary < 1E5 THEN '50k-100k'
            WHEN base_salary >= 1E5 THEN '100k+' END AS left_closed,
       CASE WHEN base_salary > 2E4 AND base_salary <= 5E4 THEN 1 WHEN base_salary > 5E4 AND base_salary <= 1E5 THEN 2
       END AS right_closed,
       CASE WHEN birth_year >= 1960 AND birth_year < 1980 THEN 'early' WHEN birth_year >= 1980 AND birth_year <= 1999
            THEN 'late' END AS both_closed FROM scored""",
)
def _(t: Tables):
    return t["scored"].select(
        "employee_id",
        x.cut("base_salary", [None, 5e4, 1e5, None], ["under 50k", "50k-100k", "100k+"]).alias("left_closed"),
        x.cut("base_salary", [2e4, 5e4, 1e5], [1, 2], right=True).alias("right_closed"),
        x.cut("birth_year", [1960, 1980, 1999], ["early", "late"], include_lowest=True).alias("both_closed"),
    )


@query(
    "p5_missing_category",
    "employees scored",
    """SELECT employee_id, COALESCE(education_level, 'Missing') AS education, 'person' AS kind FROM employees
       UNION ALL SELECT employee_id, COALESCE(CAST(birth_year AS VARCHAR), 'Missing'), 'score' FROM scored""",
)
def _(t: Tables):
    people = t["employees"].select(
        "employee_id", x.missing_label("education_level").alias("education"), F.lit("person").alias("kind")
    )
    return people.unionByName(
        t["scored"].select("employee_id", x.missing_label("birth_year").alias("education"), F.lit("score").alias("kind"))
    )


@query(
    "p6_slice_filter",
    "scored",
    """SELECT employee_id, department_name, region, employment_type, job_level FROM scored
       WHERE department_name IN ('D0', 'D1', 'D2') AND region IN ('Hot', 'R1') AND employment_type IN ('Salaried')
       AND job_level IN ('L1', 'L3')""",
)
def _(t: Tables):
    slices = {"department_name": ["D0", "D1", "D2"], "region": ["Hot", "R1"], "employment_type": ["Salaried"], "job_level": ["L1", "L3"]}
    out = t["scored"]
    for column, values in slices.items():
        out = out.where(F.col(column).isin(*values))
    return out.select("employee_id", *slices)


@query(
    "p7_feature_normalisation",
    "scored",
    """SELECT employee_id, CAST(birth_year AS VARCHAR) AS level_text,
       CASE WHEN base_salary > 1E5 THEN 'True' WHEN base_salary > 5E4 THEN 'False' ELSE 'False' END AS recommended,
       CASE WHEN actual_attrition = 1 THEN NULL ELSE attrition_probability END AS recency FROM scored""",
)
def _(t: Tables):
    messy = F.when(F.col("base_salary") > 1e5, " true").when(F.col("base_salary") > 5e4, "FALSE ").otherwise("n/a")
    return t["scored"].select(
        "employee_id",
        F.col("birth_year").cast("string").alias("level_text"),
        x.boolean_text(messy).alias("recommended"),
        F.when(F.col("actual_attrition") != 1, F.col("attrition_probability")).alias("recency"),
    )


# ---- joins --------------------------------------------------------------------------------------


@query(
    "j1_dimension_enrichment",
    "employees departments locations job_roles",
    """SELECT employee_id, department_name, city, region, job_title FROM employees e
       JOIN departments d ON e.department_id = d.department_id LEFT JOIN locations l ON e.location_id = l.location_id
       LEFT JOIN job_roles r ON e.job_role_id = r.job_role_id""",
)
def _(t: Tables):
    people = t["employees"].select("employee_id", "department_id", "location_id", "job_role_id")
    return (
        people.join(t["departments"], "department_id")
        .join(t["locations"], "location_id", "left")
        .join(t["job_roles"], "job_role_id", "left")
        .select("employee_id", "department_name", "city", "region", "job_title")
    )


@query(
    "j2_checked_join",
    "employees compensation_history",
    """SELECT compensation_id, employee_id, base_salary, employment_type FROM compensation_history
       LEFT JOIN (SELECT employee_id AS e, employment_type FROM employees) ON e = employee_id""",
)
def _(t: Tables):
    pay = t["compensation_history"].select("compensation_id", "employee_id", "base_salary")
    people = t["employees"].select("employee_id", "employment_type")
    return asof.checked_join(pay, people, ["employee_id"], "left", "many_to_one")


LATEST_SQL = """SELECT employee_id, effective_date, base_salary, bonus_target FROM compensation_history
       WHERE effective_date {op} DATE '1999-06-30'
       QUALIFY ROW_NUMBER() OVER (PARTITION BY employee_id ORDER BY effective_date {d}, compensation_id {d}) = 1"""


@query("j3_asof_latest", "compensation_history", LATEST_SQL.format(op="<=", d="DESC"))
def _(t: Tables):
    return asof.latest_on_or_before(
        t["compensation_history"], "employee_id", "effective_date", "1999-06-30", ["compensation_id"], ["base_salary", "bonus_target"]
    )


@query("j3_asof_latest_exclusive", "compensation_history", LATEST_SQL.format(op="<", d="DESC"))
def _(t: Tables):
    return asof.latest_on_or_before(
        t["compensation_history"], "employee_id", "effective_date", "1999-06-30", ["compensation_id"],
        ["base_salary", "bonus_target"], inclusive=False,
    )


@query("j4_asof_first", "compensation_history", LATEST_SQL.format(op="<=", d="ASC"))
def _(t: Tables):
    return asof.first_on_or_before(
        t["compensation_history"], "employee_id", "effective_date", "1999-06-30", ["compensation_id"], ["base_salary", "bonus_target"]
    )


@query(
    "j5_lagged_asof",
    "compensation_history",
    """WITH v AS (SELECT * FROM compensation_history WHERE effective_date <= DATE '1999-06-30')
       SELECT employee_id, arg_max(base_salary, (effective_date, compensation_id)) AS current_value,
       COALESCE(arg_max(base_salary, (effective_date, compensation_id)) FILTER (WHERE effective_date <= DATE '1998-06-30'),
                arg_min(base_salary, (effective_date, compensation_id))) AS lagged_value,
       COUNT(*) FILTER (WHERE effective_date <= DATE '1998-06-30') = 0 AS used_first_value FROM v GROUP BY employee_id""",
)
def _(t: Tables):
    return asof.lagged_value(
        t["compensation_history"], "employee_id", "effective_date", "1999-06-30", ["compensation_id"], "base_salary"
    )


EXPANDED = f"""SELECT employee_id, snapshot_sequence, dataset_type, snapshot_date, prediction_end_date, hire_date,
       termination_date, location_id FROM employees, {snapshot_values()}
       WHERE hire_date <= snapshot_date AND (termination_date IS NULL OR termination_date > snapshot_date)"""


@query("j6_snapshot_expansion", "employees", EXPANDED)
def _(t: Tables):
    people = t["employees"].select("employee_id", "hire_date", "termination_date", "location_id")
    return asof.expand_snapshots(people, "hire_date", "termination_date", SNAPSHOTS)


@query(
    "j7_attribute_at_snapshot",
    "employees employee_events",
    f"""WITH es AS ({EXPANDED}) SELECT es.employee_id, es.snapshot_date, COALESCE(
       (SELECT CAST(new_value AS INT) FROM employee_events ee WHERE ee.employee_id = es.employee_id AND event_type = 'Transfer'
        AND event_date <= es.snapshot_date ORDER BY event_date DESC, event_id DESC LIMIT 1),
       (SELECT CAST(regexp_extract(notes, 'location_id=([0-9]+)', 1) AS INT) FROM employee_events ee
        WHERE ee.employee_id = es.employee_id AND event_type = 'Hire' ORDER BY event_date, event_id LIMIT 1),
       es.location_id) AS snapshot_location_id FROM es""",
)
def _(t: Tables):
    people = asof.expand_snapshots(
        t["employees"].select("employee_id", "hire_date", "termination_date", "location_id"), "hire_date", "termination_date", SNAPSHOTS
    )
    out = asof.attribute_at(
        people, t["employee_events"], "employee_id", "snapshot_date", "location_id", "Transfer", "snapshot_location_id",
        initial_pattern=r"location_id=([0-9]+)",
    )
    return out.select("employee_id", "snapshot_date", "snapshot_location_id")


@query(
    "j7_attribute_before_record",
    "employees employee_events compensation_history",
    """SELECT c.compensation_id, e.location_id AS current_location, COALESCE(CAST(x.new_value AS INT),
         CAST(f.old_value AS INT), e.location_id) AS historical_location
       FROM compensation_history c JOIN employees e ON c.employee_id = e.employee_id
       ASOF LEFT JOIN (SELECT employee_id, event_date, arg_max(new_value, event_id) AS new_value FROM employee_events
                       WHERE event_type = 'Transfer' GROUP BY ALL) x
         ON c.employee_id = x.employee_id AND c.effective_date >= x.event_date
       LEFT JOIN (SELECT employee_id, arg_min(old_value, (event_date, event_id)) AS old_value FROM employee_events
                  WHERE event_type = 'Transfer' GROUP BY employee_id) f ON f.employee_id = c.employee_id""",
)
def _(t: Tables):
    return located(t, "compensation_history", "effective_date").select(
        "compensation_id", "current_location", "historical_location"
    )


def located(t: Tables, records: str, date: str):
    """Records of a table with their location at record time and today."""
    moves = t["employee_events"].where(F.col("event_type") == "Transfer")
    known = asof.asof_join(t[records], moves, "employee_id", date, "event_date", ["event_id"], ["new_value"])
    first = moves.groupBy("employee_id").agg(F.min_by("old_value", F.struct("event_date", "event_id")).alias("_old"))
    people = t["employees"].select("employee_id", F.col("location_id").alias("current_location"))
    return (
        known.join(people, "employee_id")
        .join(first, "employee_id", "left")
        .withColumn(
            "historical_location",
            F.coalesce(F.col("new_value").try_cast("int"), F.col("_old").try_cast("int"), F.col("current_location")),
        )
        .drop("_old", "new_value")
    )


SCORED_IDS = "SELECT employee_id FROM employees WHERE account_balance >= 0"
ACTIVE_IDS = f"SELECT employee_id FROM employees WHERE hire_date <= DATE '{AS_OF}' AND (termination_date IS NULL OR termination_date > DATE '{AS_OF}')"
ELIGIBLE_IDS = f"{ACTIVE_IDS} AND organizational_level IN ('Individual Contributor', 'Manager')"


@query(
    "j8_id_reconciliation",
    "employees",
    f"""WITH s AS ({SCORED_IDS}), a AS ({ACTIVE_IDS}), e AS ({ELIGIBLE_IDS}) SELECT
       (SELECT COUNT(*) FROM s WHERE employee_id NOT IN (SELECT employee_id FROM a)) AS scored_not_active,
       (SELECT COUNT(*) FROM e WHERE employee_id NOT IN (SELECT employee_id FROM s)) AS eligible_not_scored,
       (SELECT COUNT(*) FROM s WHERE employee_id NOT IN (SELECT employee_id FROM e)) AS scored_not_eligible,
       (SELECT COUNT(*) FROM s WHERE employee_id NOT IN (SELECT employee_id FROM a)
          AND employee_id NOT IN (SELECT employee_id FROM e)) AS scored_unknown,
       (SELECT COUNT(*) FROM s JOIN a USING (employee_id) JOIN e USING (employee_id)) AS agreed""",
)
def _(t: Tables):
    people = t["employees"]
    active = people.where(x.active_on("hire_date", "termination_date", today()))
    eligible = active.where(F.col("organizational_level").isin(*ELIGIBLE))
    return asof.reconcile_ids(people.where(F.col("account_balance") >= 0), active, eligible, "employee_id")


@query(
    "j8_anti_ids",
    "employees",
    f"SELECT employee_id FROM ({ELIGIBLE_IDS}) EXCEPT SELECT employee_id FROM ({SCORED_IDS})",
)
def _(t: Tables):
    people = t["employees"]
    eligible = people.where(x.active_on("hire_date", "termination_date", today()) & F.col("organizational_level").isin(*ELIGIBLE))
    return asof.anti_ids(eligible, people.where(F.col("account_balance") >= 0), "employee_id")


@query(
    "j9_aligned_outer_join",
    "job_requisitions applications",
    """WITH a AS (SELECT department_id, requisition_status, SUM(target_headcount)::BIGINT AS planned FROM job_requisitions
         WHERE requisition_status <> 'Open' GROUP BY ALL),
       b AS (SELECT department_id, requisition_status, COUNT(*) AS hired FROM job_requisitions r JOIN applications p
         ON p.requisition_id = r.requisition_id WHERE requisition_status <> 'Cancelled' AND application_status = 'Hired' GROUP BY ALL)
       SELECT department_id, requisition_status, planned, hired, CASE WHEN planned IS NULL THEN 'right_only'
         WHEN hired IS NULL THEN 'left_only' ELSE 'both' END AS presence
       FROM a FULL JOIN b USING (department_id, requisition_status)""",
)
def _(t: Tables):
    keys = ["department_id", "requisition_status"]
    jobs = t["job_requisitions"]
    planned = jobs.where(F.col("requisition_status") != "Open").groupBy(*keys).agg(F.sum("target_headcount").alias("planned"))
    hired = (
        t["applications"]
        .where(F.col("application_status") == "Hired")
        .select("requisition_id")
        .join(jobs.where(F.col("requisition_status") != "Cancelled"), "requisition_id")
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("hired"))
    )
    return asof.outer_with_indicator(planned, hired, keys)


@query(
    "j10_manager_lookup",
    "employees",
    """SELECT e.employee_id, e.manager_id, m.department_id AS manager_department_id,
       m.employment_status AS manager_employment_status, m.organizational_level AS manager_organizational_level
       FROM employees e LEFT JOIN employees m ON e.manager_id = m.employee_id""",
)
def _(t: Tables):
    people = t["employees"].select("employee_id", "manager_id", "department_id", "employment_status", "organizational_level")
    out = asof.with_parent(people, "employee_id", "manager_id", ["department_id", "employment_status", "organizational_level"])
    return out.drop("department_id", "employment_status", "organizational_level")


HIRED_SQL = """SELECT a.employee_id, application_source, years_experience AS years_experience_at_hire,
       department_name AS hire_department_name, l.region AS hire_region, job_family AS hire_job_family,
       job_level AS hire_job_level FROM applications a
       JOIN candidates c ON a.candidate_id = c.candidate_id
       JOIN job_requisitions q ON a.requisition_id = q.requisition_id
       JOIN departments d ON q.department_id = d.department_id JOIN locations l ON q.location_id = l.location_id
       JOIN job_roles r ON q.job_role_id = r.job_role_id
       WHERE application_status = 'Hired' AND a.employee_id IS NOT NULL AND decision_date <= DATE '2000-06-30'
       QUALIFY ROW_NUMBER() OVER (PARTITION BY a.employee_id ORDER BY decision_date, application_id, application_source,
         years_experience, department_name, l.region, job_family, job_level) = 1"""


@query("j11_hire_context_chain", "applications candidates job_requisitions departments locations job_roles", HIRED_SQL)
def _(t: Tables):
    names = ["applications", "candidates", "job_requisitions", "departments", "locations", "job_roles"]
    return panel.hire_context(*[t[n] for n in names], "2000-06-30")


@query(
    "j12_block_assembly",
    "employees compensation_history training_records",
    """SELECT e.employee_id, COALESCE(pay_records, 0) AS pay_records, top_salary,
       COALESCE(completed_training_programs, 0) AS completed_training_programs,
       COALESCE(completed_training_hours, 0) AS completed_training_hours FROM employees e
       LEFT JOIN (SELECT employee_id, COUNT(*) AS pay_records, MAX(base_salary) AS top_salary FROM compensation_history
         WHERE change_reason = 'Promotion' GROUP BY employee_id) p ON p.employee_id = e.employee_id
       LEFT JOIN (SELECT employee_id, COUNT(*) FILTER (WHERE completion_status = 'Completed') AS completed_training_programs,
         COALESCE(SUM(training_hours) FILTER (WHERE completion_status = 'Completed'), 0) AS completed_training_hours
         FROM training_records GROUP BY employee_id) r ON r.employee_id = e.employee_id""",
)
def _(t: Tables):
    pay = (
        t["compensation_history"]
        .where(F.col("change_reason") == "Promotion")
        .groupBy("employee_id")
        .agg(F.count(F.lit(1)).alias("pay_records"), F.max("base_salary").alias("top_salary"))
    )
    training = reports.training_per_employee(t["training_records"])
    return asof.assemble(
        t["employees"].select("employee_id"),
        ["employee_id"],
        [(pay, {"pay_records": 0}), (training, {"completed_training_programs": 0, "completed_training_hours": 0.0})],
    )


