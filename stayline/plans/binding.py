"""The people-analytics data model expressed over the test tables.

Amounts get a square root and scores an uneven divisor, so that averages do not end
in a 5 at the rounding place, where the two engines round differently.

Every relation is one statement in the SQL that Spark and ANSI engines share,
so an operator and the statement it is checked against start from equal rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from stayline.session import tune

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

AS_OF = "2001-08-01"
# (sequence, kind, snapshot, horizon end)
SNAPSHOTS = [
    (1, "historical", "1998-06-30", "1999-06-30"),
    (2, "historical", "1999-06-30", "2000-06-30"),
    (3, "historical", "2000-06-30", "2001-06-30"),
    (4, "current_scoring", "2001-06-30", None),
]

SCANS = re.compile(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b")
RELATIONS: dict[str, tuple[tuple[str, ...], str]] = {}


def relation(name: str, sql: str, *needs: str) -> None:
    RELATIONS[name] = (needs, " ".join(sql.split()))


relation(
    "order_span",
    """SELECT o_custkey, CAST(MIN(o_orderdate) AS DATE) AS first_date, CAST(MAX(o_orderdate) AS DATE) AS last_date
       FROM orders GROUP BY o_custkey""",
)
relation(
    "departments",
    """SELECT n_nationkey AS department_id, n_name AS department_name, r_name AS department_group
       FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
relation(
    "locations",
    """SELECT n_nationkey AS location_id, n_name AS city, r_name AS region,
              CASE n_nationkey % 3 WHEN 0 THEN 'Headquarters' WHEN 1 THEN 'Office' ELSE 'Plant' END AS location_type
       FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
ROLE_ID = """CAST(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3
             WHEN 'HOUSEHOLD' THEN 4 ELSE 5 END * 10 + c_custkey % 5 + 1 AS INT)"""
relation(
    "job_roles",
    f"""SELECT DISTINCT {ROLE_ID} AS job_role_id,
               c_mktsegment || ' L' || CAST(c_custkey % 5 + 1 AS STRING) AS job_title,
               c_mktsegment AS job_family, CAST(c_custkey % 5 + 1 AS INT) AS job_level,
               CAST(2.0E4 * (c_custkey % 5 + 1) AS DOUBLE) AS salary_band_min,
               CAST(3.0E5 + 2.0E4 * (c_custkey % 5 + 1) AS DOUBLE) AS salary_band_max
        FROM customer""",
)
relation(
    "employees",
    f"""SELECT c_custkey AS employee_id, first_date AS hire_date,
               CASE WHEN last_date < DATE '2001-02-02' THEN last_date END AS termination_date,
               CASE WHEN last_date < DATE '2001-02-02' THEN 'Terminated' ELSE 'Active' END AS employment_status,
               CASE WHEN last_date < DATE '2001-02-02' AND c_acctbal >= 3000 THEN 'Voluntary'
                    WHEN last_date < DATE '2001-02-02' THEN 'Involuntary' END AS termination_type,
               CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_nationkey END AS department_id,
               CAST((c_nationkey + c_custkey) % 25 AS INT) AS location_id, {ROLE_ID} AS job_role_id,
               CASE WHEN c_custkey % 200 = 0 THEN NULL WHEN c_custkey % 40 = 0 THEN c_custkey - c_custkey % 200
                    WHEN c_custkey % 8 = 0 THEN c_custkey - c_custkey % 40 ELSE c_custkey - c_custkey % 8
               END AS manager_id,
               CASE WHEN c_custkey % 10 = 3 THEN 'Hourly' ELSE 'Salaried' END AS employment_type,
               CAST(1950 + c_custkey % 45 AS INT) AS birth_year,
               CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN 'High School'
                    WHEN c_custkey % 4 = 1 THEN 'Bachelor' WHEN c_custkey % 4 = 2 THEN 'Master' ELSE 'Doctorate'
               END AS education_level,
               CASE WHEN c_custkey % 200 = 0 THEN 'Department Head' WHEN c_custkey % 40 = 0 THEN 'Senior Manager'
                    WHEN c_custkey % 8 = 0 THEN 'Manager' ELSE 'Individual Contributor' END AS organizational_level,
               c_acctbal AS account_balance
        FROM customer JOIN order_span ON c_custkey = o_custkey""",
    "order_span",
)
relation(
    "compensation_history",
    """SELECT o_orderkey AS compensation_id, o_custkey AS employee_id, CAST(o_orderdate AS DATE) AS effective_date,
              o_totalprice + SQRT(1E0 + o_orderkey % 97) AS base_salary, o_totalprice * 1.0E-1 AS bonus_target,
              o_totalprice * 5.0E-2 AS equity_value,
              CASE o_orderpriority WHEN '1-URGENT' THEN 'Promotion' WHEN '5-LOW' THEN 'Market Adjustment'
                   ELSE 'Annual Review' END AS change_reason
       FROM orders""",
)
relation(
    "performance_reviews",
    """SELECT l_orderkey AS review_id, l_linenumber AS review_line, o_custkey AS employee_id,
              CAST(o_orderdate AS DATE) AS review_date, l_quantity AS performance_rating,
              ROUND(l_discount * 1.0E3, 2) AS goal_completion, l_tax > 5.0E-2 AS promotion_recommended,
              l_extendedprice AS review_weight
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
relation(
    "training_records",
    """SELECT l_orderkey AS training_record_id, o_custkey AS employee_id, CAST(l_partkey % 50 AS INT) AS program_id,
              CAST(o_orderdate AS DATE) AS start_date,
              CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN NULL ELSE CAST(l_shipdate AS DATE) END
                AS completion_date,
              CASE WHEN l_returnflag = 'A' THEN 'Completed' WHEN l_returnflag = 'R' THEN 'Failed'
                   WHEN l_linestatus = 'F' THEN 'Completed' ELSE 'In Progress' END AS completion_status,
              l_quantity AS training_hours,
              CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN NULL ELSE ROUND(l_discount * 1.0E3, 2) END
                AS score
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
relation(
    "employee_events",
    """SELECT o_orderkey AS event_id, o_custkey AS employee_id, CAST(o_orderdate AS DATE) AS event_date,
              CASE o_orderpriority WHEN '1-URGENT' THEN 'Promotion' WHEN '2-HIGH' THEN 'Transfer'
                   WHEN '3-MEDIUM' THEN 'Manager Change' WHEN '4-NOT SPECIFIED' THEN 'Leave'
                   ELSE 'Return From Leave' END AS event_type,
              CASE WHEN o_orderpriority = '2-HIGH' THEN CAST((o_orderkey + 11) % 25 AS STRING)
                   WHEN o_orderpriority = '3-MEDIUM' THEN CAST((o_orderkey % 97) * 8 AS STRING) END AS old_value,
              CASE WHEN o_orderpriority = '2-HIGH' THEN CAST(o_orderkey % 25 AS STRING)
                   WHEN o_orderpriority = '3-MEDIUM' THEN CAST((o_orderkey % 89) * 8 AS STRING) END AS new_value,
              CAST(NULL AS STRING) AS notes
       FROM orders
       UNION ALL
       SELECT -1 - o_custkey, o_custkey, first_date, 'Hire', CAST(NULL AS STRING), CAST(NULL AS STRING),
              'Hired with location_id=' || CAST(o_custkey * 7 % 25 AS STRING) || ' and job_role_id='
                || CAST(o_custkey % 5 + 11 AS STRING)
       FROM order_span""",
    "order_span",
)
relation(
    "candidates",
    """SELECT p_partkey AS candidate_id, p_type AS application_source,
              CASE WHEN p_size > 40 THEN 'Doctorate' WHEN p_size > 25 THEN 'Master' ELSE 'Bachelor' END
                AS education_level,
              CAST(p_size AS DOUBLE) / 2E0 AS years_experience, p_brand || ', ' || p_type AS candidate_location
       FROM part""",
)
relation(
    "job_requisitions",
    """SELECT o_orderkey AS requisition_id, CAST(o_custkey % 25 AS INT) AS department_id,
              CAST((o_custkey + o_orderkey) % 25 AS INT) AS location_id,
              CAST((1 + o_custkey % 5) * 10 + 1 + o_orderkey % 5 AS INT) AS job_role_id,
              CAST(o_orderdate AS DATE) AS open_date,
              CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS DATE) + CAST(10 + o_orderkey % 120 AS INT) END
                AS close_date,
              CAST(1 + o_orderkey % 5 AS INT) AS target_headcount,
              CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Filled' ELSE 'Cancelled' END
                AS requisition_status
       FROM orders""",
)
relation(
    "applications",
    """SELECT l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS application_id, l_partkey AS candidate_id,
              l_orderkey AS requisition_id, CAST(o_orderdate AS DATE) AS application_date,
              CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'Hired' WHEN 'AO' THEN 'Offer Declined'
                   WHEN 'NF' THEN 'Interviewed' WHEN 'NO' THEN 'Applied' WHEN 'RF' THEN 'Rejected'
                   ELSE 'Withdrawn' END AS application_status,
              CASE WHEN l_returnflag || l_linestatus IN ('AF', 'AO', 'NF') THEN l_quantity * 2E0 END
                AS interview_score,
              CASE WHEN l_returnflag = 'A' THEN CAST(l_shipdate AS DATE) END AS offer_date,
              CASE WHEN l_returnflag = 'A' THEN CAST(l_shipdate AS DATE) + CAST(l_linenumber AS INT) END
                AS decision_date,
              CASE WHEN l_returnflag || l_linestatus = 'AF' THEN o_custkey END AS employee_id
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
relation(
    "scored",
    """SELECT event_id AS employee_id, user_id, CAST(ts AS DATE) AS event_date,
              CASE WHEN ts < TIMESTAMP '2024-01-11 00:00:00' THEN 'train'
                   WHEN ts < TIMESTAMP '2024-01-21 00:00:00' THEN 'validation' ELSE 'test' END AS period,
              2E-2 + ((event_id * 37 + user_id * 11) % 400) / 7.97E2
                + CASE WHEN event_type IN ('error', 'click') THEN 5E-2 ELSE 0E0 END AS attrition_probability,
              CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS actual_attrition,
              value * 1E3 + 2E4 + SQRT(1E0 + event_id % 89) AS base_salary,
              'D' || CAST(user_id % 7 AS STRING) AS department_name,
              CASE WHEN event_id % 3 = 0 THEN 'Hot' ELSE 'R' || CAST(user_id % 6 AS STRING) END AS region,
              CASE WHEN user_id % 5 = 0 THEN 'Hourly' ELSE 'Salaried' END AS employment_type,
              'L' || CAST(event_id % 4 + 1 AS STRING) AS job_level,
              CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(1960 + user_id % 40 AS INT) END AS birth_year
       FROM events""",
)
relation(
    "labeled",
    """SELECT l.doc_id, l.quality, l.toxic, d.lang, d.source, d.n_chars,
              1E-1 + ((l.doc_id * 13 + d.n_chars) % 100) / 1.97E2 + 2E-1 * l.quality AS quality_score,
              5E-2 + ((l.doc_id * 29 + d.n_chars) % 80) / 1.93E2 + 1E-1 * l.toxic AS toxic_score
       FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
)


def _ordered(names: tuple[str, ...], seen: list[str]) -> list[str]:
    for name in names:
        _ordered(RELATIONS[name][0], seen)
        if name not in seen:
            seen.append(name)
    return seen


def with_relations(*names: str, body: str) -> str:
    """ANSI statement with the named relations as common table expressions in front."""
    parts = [f"{n} AS ({RELATIONS[n][1]})" for n in _ordered(names, [])]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def base(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rel(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Spark frame of a relation of the data model."""
    tune(spark)
    sql = with_relations(name, body=f"SELECT * FROM {name}")
    # the tables are passed in by name, so no temporary view of the caller is touched
    used = sorted({table for _, table in SCANS.findall(sql)})
    return spark.sql(SCANS.sub(r"\1 {\2}", sql), **{table: base(spark, sf_dir, table) for table in used})


def snapshot_values() -> str:
    """The snapshot calendar as a VALUES list for ANSI statements."""
    rows = ", ".join(
        f"({s}, '{k}', DATE '{d}', {f"DATE '{h}'" if h else 'CAST(NULL AS DATE)'})" for s, k, d, h in SNAPSHOTS
    )
    return f"(VALUES {rows}) AS s(snapshot_sequence, dataset_type, snapshot_date, prediction_end_date)"
