"""What is published: one entry per gold table.

Grain columns must identify a row, open columns may be read by anyone, restricted
columns name the role that unlocks them.  The registry drives governed views,
grain checks, freshness and the guard; it holds no logic.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: roles, sources and shared keys ------------------------------
ROLES = ["Admin_IT", "Finance", "HR_Manager", "default"]
SUPERUSERS = {"admin", "Admin"}
JOIN_KEYS = {"opms_employee_id", "bms_project_id", "bms_client_id"}
WORKFORCE, LISTS, ACCOUNTS, LAKE = "workforce", "lists", "accounts", "lake"
# -------------------------------------------------------------------------------


@dataclass(frozen=True)
class TableSpec:
    name: str
    grain: tuple[str, ...]
    columns: tuple[str, ...]
    restricted: dict[str, str] = field(default_factory=dict)
    source: str = LISTS
    critical: bool = False
    caveat: str | None = None

    def visible(self, role: str) -> list[str]:
        """Columns of this table that ``role`` may see."""
        unlocked = [c for c, need in self.restricted.items() if role == need or role in SUPERUSERS]
        return list(self.columns) + unlocked


# --- fixed values: the published tables ------------------------------------------
GOLD: dict[str, TableSpec] = {t.name: t for t in [
    TableSpec(
        name="employee_profile",
        grain=("opms_employee_id",),
        columns=(
            "opms_employee_id", "person_id", "first_name", "last_name", "preferred_name", "is_active", "position_name",
            "company_name", "ops_section_name", "supplier_name", "arrangement_type", "email_work", "phone_work",
            "home_airport_code", "bms_position_id", "ops_section_id", "bms_supplier_id"),
        restricted={
            "date_of_birth": "HR_Manager", "gender_name": "HR_Manager", "nationality_name": "HR_Manager",
            "middle_name": "HR_Manager"},
        source=WORKFORCE,
        critical=True,
        caveat="Position, supplier and section are filled only for workers known to both systems."),
    TableSpec(
        name="training_compliance",
        grain=("training_record_id",),
        columns=(
            "training_record_id", "opms_employee_id", "first_name", "last_name", "competency_name", "group_name", "status",
            "issue_date", "expiry_date", "validity_years", "days_to_expiry", "is_expired", "is_expiring_soon",
            "has_document", "document_number", "arrangement_type", "is_active"),
        restricted={"classified": "HR_Manager"},
        source=WORKFORCE,
        caveat="Compliance is derived from the expiry date."),
    TableSpec(
        name="roster_summary",
        grain=("opms_employee_id", "roster_date"),
        columns=(
            "opms_employee_id", "first_name", "last_name", "roster_date", "position_name", "work_type_name",
            "project_name", "client_name", "hours", "source"),
        source=WORKFORCE,
        critical=True,
        caveat="Two roster feeds are combined."),
    TableSpec(
        name="weekly_timesheet",
        grain=("opms_employee_id", "work_date"),
        columns=(
            "opms_employee_id", "first_name", "last_name", "position_name", "project_name", "client_name", "site_name",
            "supplier_name", "work_date", "shift_type", "roster_hours", "gap_hours", "actual_hours", "hours_source"),
        source=WORKFORCE,
        critical=True),
    TableSpec(
        name="timesheet_summary",
        grain=("opms_employee_id", "site_id", "month"),
        columns=("opms_employee_id", "first_name", "last_name", "site_id", "site_name", "month", "total_hours", "entry_count"),
        source=WORKFORCE,
        critical=True,
        caveat="Hours are kept per site, not per project."),
    TableSpec(
        name="project_bridge",
        grain=("job_code", "source"),
        columns=("job_code", "job_title", "bms_project_id", "project_name", "client_code", "client_name", "opms_project_name", "source"),
        critical=True),
    TableSpec(
        name="project_job_summary",
        grain=("bms_project_id",),
        columns=(
            "bms_project_id", "project_name", "project_code", "status", "is_active", "bms_client_id", "client_name",
            "ops_section_id", "project_start_date", "job_count", "active_job_count"),
        critical=True),
    TableSpec(
        name="job_detail",
        grain=("bms_job_id",),
        columns=(
            "bms_job_id", "job_title", "job_code", "job_status", "is_active", "project_name", "client_name",
            "lead_first_name", "lead_last_name", "work_location_name", "ops_section_name", "is_overhead", "modified_at"),
        critical=True),
    TableSpec(
        name="asset_register",
        grain=("bms_asset_id",),
        columns=(
            "bms_asset_id", "asset_name", "asset_id", "status", "model", "serial_number", "manufacturer_name",
            "location_name", "asset_group_name", "is_active")),
    TableSpec(
        name="hardware_register",
        grain=("bms_hardware_id",),
        columns=("bms_hardware_id", "hardware_name", "code", "status", "in_stock", "category_name", "is_active"),
        restricted={"hire_price": "Finance"}),
    TableSpec(
        name="inventory_summary",
        grain=("bms_store_id",),
        columns=("bms_store_id", "item_name", "stock", "is_active", "location_name", "category_name", "effective_date")),
    TableSpec(
        name="ppe_transactions",
        grain=("bms_txn_id",),
        columns=(
            "bms_txn_id", "txn_date", "txn_month", "txn_kind", "title", "item_name", "item_code", "units", "from_location",
            "to_location", "person_name", "job_code", "job_title", "project_name")),
    TableSpec(
        name="hseq_register",
        grain=("bms_issue_id",),
        columns=(
            "bms_issue_id", "issue_title", "issue_type", "issue_status", "action_priority", "action_due_date",
            "action_completed_date", "is_open", "is_overdue"),
        restricted={"IssueDetail": "HR_Manager", "ActionPlan": "HR_Manager", "CompletionNotes": "HR_Manager"}),
    TableSpec(
        name="supplier_summary",
        grain=("bms_supplier_id",),
        columns=("bms_supplier_id", "supplier_name", "is_active", "phone", "email", "website", "address", "worker_count"),
        restricted={"abn": "Finance"},
        source=WORKFORCE),
    TableSpec(
        name="executive_snapshot",
        grain=("date",),
        columns=(
            "date", "workforce_risk", "expiring_7d", "expiring_30d", "expired_total", "deployable", "idle_pool",
            "active_projects", "hours_last", "hours_prev"),
        restricted={"ar_total": "Finance", "rev_last_month": "Finance"},
        source=ACCOUNTS),
    TableSpec(
        name="invoice_register",
        grain=("invoice_id",),
        columns=(
            "invoice_id", "invoice_number", "invoice_type", "status", "contact_name", "reference", "job_code",
            "bridge_client", "invoice_date", "month", "due_date"),
        restricted={"subtotal": "Finance", "total": "Finance", "amount_paid": "Finance", "amount_due": "Finance"},
        source=ACCOUNTS),
    TableSpec(
        name="revenue_summary",
        grain=("contact_name", "month"),
        columns=("contact_name", "month", "invoices"),
        restricted={"invoiced": "Finance", "paid": "Finance", "outstanding": "Finance"},
        source=ACCOUNTS),
    TableSpec(
        name="purchase_summary",
        grain=("purchase_id",),
        columns=("purchase_id", "supplier_name", "invoice_date", "line_count"),
        restricted={"inv_amount": "Finance", "computed_total": "Finance", "inv_number": "Finance"},
        source=ACCOUNTS,
        caveat="Invoice amounts need the Finance role."),
    TableSpec(
        name="rate_card",
        grain=("bms_rate_id",),
        columns=("bms_rate_id", "rate_title", "bms_project_id", "project_name", "project_code", "bms_position_id"),
        restricted={"day_shift_rate": "Finance", "night_shift_rate": "Finance"},
        caveat="Rates need the Finance role."),
    TableSpec(
        name="site_assignment",
        grain=("opms_employee_id", "opms_site_id"),
        columns=(
            "opms_employee_id", "first_name", "last_name", "opms_position_id", "position_name", "opms_site_id",
            "site_name", "team_name"),
        source=WORKFORCE,
        caveat="Assignments are current, not historical."),
    TableSpec(
        name="licence_register",
        grain=("bms_licence_id",),
        columns=(
            "bms_licence_id", "first_name", "last_name", "opms_employee_id", "licence", "licence_items", "email_work",
            "bms_position_id"),
        restricted={"mobile": "HR_Manager"},
        source=WORKFORCE),
    TableSpec(
        name="worker_ranking",
        grain=("bms_ranking_id",),
        columns=("bms_ranking_id", "first_name", "last_name", "opms_employee_id"),
        restricted={
            "site_score": "HR_Manager", "mob_score": "HR_Manager", "mob_score_raw": "HR_Manager",
            "mob_test": "HR_Manager"},
        source=WORKFORCE),
    TableSpec(
        name="audit_activity",
        grain=("change_log_id",),
        columns=("change_log_id", "created_at", "event_type", "opms_employee_id", "first_name", "last_name"),
        restricted={"value_before": "Admin_IT", "value_after": "Admin_IT"},
        source=WORKFORCE,
        caveat="History is limited to the change log's retention."),
    TableSpec(
        name="file_index",
        grain=("web_url",),
        columns=("site", "library", "file_name", "ext", "folder_path", "size_kb", "web_url", "modified_at", "modified_by")),
]}

#: Tables that may legitimately be empty while their source is not connected.
EXPECTED_EMPTY = {"gold:invoice_register", "gold:revenue_summary"}
CRITICAL = [t.name for t in GOLD.values() if t.critical]
# -------------------------------------------------------------------------------


def check_join_key(key: str) -> str:
    """Only registered identity keys may connect gold tables."""
    if key not in JOIN_KEYS:
        raise ValueError(f"'{key}' is not a registered join key; use one of {sorted(JOIN_KEYS)}")
    return key
