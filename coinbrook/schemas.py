"""Table schemas and the fixed values of the ledger."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "double": T.DoubleType(),
    "int": T.IntegerType(),
}


def _struct(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns.items()])


# Columns and types of the four tables.
EXPENSES_LINE = _struct(
    id="string",
    date="date",
    description="string",
    category="string",
    amount="double",
    from_account="string",
    towards="string",
)

FCT_EXPENSE = _struct(
    id="string",
    expense_date="date",
    booked_date="date",
    last_modified_at="timestamp",
    description="string",
    parent_category="string",
    sub_category="string",
    category_tag="string",
    expend_amount="double",
    currency="string",
    from_account_marker="string",
    towards_category="string",
    towards_sub_category="string",
    towards_category_tag="string",
    day_of_month="int",
    month="int",
    year="int",
    month_year="int",
    month_year_marker="string",
    num_day_of_week="int",
    day_of_week="string",
    season="string",
)

DIM_ACCOUNT = _struct(
    id="string",
    name="string",
    tag="string",
    marker="string",
    type="string",
    minimum_balance_per_bank="double",
    minimum_balance_per_self="double",
    current_balance="double",
    currency="string",
)

INTEGRITY_FILE_IMPORTED = _struct(
    id="string",
    ts="timestamp",
    filename="string",
    date_imported="string",
    no_of_rows_imported="int",
)

# The four tables a user sees, by name.
TABLES = {
    "expenses_line": EXPENSES_LINE,
    "fct_expense": FCT_EXPENSE,
    "dim_account": DIM_ACCOUNT,
    "integrity_file_imported": INTEGRITY_FILE_IMPORTED,
}

# The accounts every ledger starts with.
SEED_ACCOUNTS = [
    # name, tag, marker, type, minimum per bank, minimum per self, balance, currency
    ("N26", "atul,cc,prepaid", "n26", "general expense", 0.0, 10.0, 80.0, "EUR"),
    ("Wise", "atul,cc,prepaid", "wise", "fat expense", 0.0, 100.0, 730.0, "EUR"),
    ("Deutsche Bank", "atul,db,salary", "deutsche_bank", "salary", 100.0, 1000.0, 7300.0, "EUR"),
    ("ICICI", "atul,amazon_card,postpaid", "icici", "eccomerce", 0.0, 0.0, 7300.0, "INR"),
]

# Labels of the entry form and the columns they fill.
FORM_LABELS = {
    "Date": "date",
    "Description": "description",
    "Amount": "amount",
    "Category": "category",
    "From Account": "from_account",
    "To Account": "towards",
}

# Columns every imported file must have, in reporting order.
REQUIRED_FILE_COLUMNS = ["date", "description", "amount", "from_account", "towards"]

# Form fields that must be filled, in reporting order.
REQUIRED_FORM_FIELDS = ["Description", "Date", "Amount", "From Account", "To Account", "Category"]

# What rows get that bring nothing else.
DEFAULT_CATEGORY = "Uncategorized"
CURRENCY = "EUR"

# Name an in-memory frame is logged under when its caller gives none.
FRAME_NAME = "dataframe_upload"
