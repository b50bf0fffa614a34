"""Table contracts: names, keys and types of the source tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Contract:
    """A source table: file or relation name, primary key and declared columns in order."""

    name: str
    key: tuple[str, ...]
    ddl: str
    private: tuple[str, ...] = ()

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.ddl)

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()

    @property
    def public_columns(self) -> list[str]:
        return [c for c in self.columns if c not in self.private]


def _contracts(*items: Contract) -> dict[str, Contract]:
    return {c.name: c for c in items}


# Column names and types of the twelve source tables.
CONTRACTS = _contracts(
    Contract(
        "departments",
        ("department_id",),
        "department_id int, department_name string, department_group string, cost_center string",
    ),
    Contract(
        "locations",
        ("location_id",),
        "location_id int, city string, state string, region string, location_type string",
    ),
    Contract(
        "job_roles",
        ("job_role_id",),
        "job_role_id int, job_title string, job_family string, job_level string, "
        "salary_band_min decimal(12,2), salary_band_max decimal(12,2)",
    ),
    Contract(
        "training_programs",
        ("program_id",),
        "program_id int, program_name string, program_category string, required_hours decimal(8,2), mandatory boolean",
    ),
    Contract(
        "employees",
        ("employee_id",),
        "employee_id int, first_name string, last_name string, hire_date date, termination_date date, "
        "employment_status string, termination_type string, department_id int, location_id int, job_role_id int, "
        "manager_id int, employment_type string, birth_year int, education_level string, "
        "organizational_level string",
        ("first_name", "last_name", "manager_id"),
    ),
    Contract(
        "candidates",
        ("candidate_id",),
        "candidate_id int, application_source string, education_level string, years_experience decimal(5,1), "
        "candidate_location string",
    ),
    Contract(
        "job_requisitions",
        ("requisition_id",),
        "requisition_id int, job_role_id int, department_id int, location_id int, open_date date, close_date date, "
        "target_headcount int, recruiter_id int, requisition_status string",
    ),
    Contract(
        "applications",
        ("application_id",),
        "application_id int, candidate_id int, requisition_id int, application_date date, application_status string, "
        "interview_score decimal(5,2), offer_date date, decision_date date, employee_id int",
    ),
    Contract(
        "compensation_history",
        ("compensation_id",),
        "compensation_id int, employee_id int, effective_date date, base_salary decimal(12,2), "
        "bonus_target decimal(6,2), equity_value decimal(12,2), change_reason string",
    ),
    Contract(
        "performance_reviews",
        ("review_id",),
        "review_id int, employee_id int, review_date date, review_period string, performance_rating decimal(3,2), "
        "goal_completion decimal(6,2), promotion_recommended boolean, reviewer_id int",
        ("reviewer_id",),
    ),
    Contract(
        "training_records",
        ("training_record_id",),
        "training_record_id int, employee_id int, program_id int, start_date date, "
        "completion_date date, completion_status string, training_hours decimal(8,2), score decimal(5,2)",
    ),
    Contract(
        "employee_events",
        ("event_id",),
        "event_id int, employee_id int, event_date date, event_type string, old_value string, new_value string, "
        "notes string",
    ),
)

# Tables that get a least-privilege view.
VIEW_TABLES = (
    "departments",
    "locations",
    "job_roles",
    "employees",
    "compensation_history",
    "performance_reviews",
    "training_records",
    "employee_events",
)
