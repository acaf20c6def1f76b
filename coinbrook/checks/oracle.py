"""The queries as plain SQL for DuckDB, each over one global form: no splitting, no pre-sums.

The rules of ``adapters.py`` are repeated here as common table expressions.
"""

from __future__ import annotations

MONEY = "DECIMAL(18,6)"

ORDER_LINES = """order_lines AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id,
         CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderdate AS DATE) END AS date,
         o_orderpriority AS description,
         CASE WHEN o_custkey % 7 <> 0 THEN o_orderpriority END AS category,
         CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS amount,
         o_orderstatus AS from_account,
         't' || CAST(o_custkey % 3 AS VARCHAR) AS towards
  FROM orders)"""

ITEM_LINES = """item_lines AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS id,
         CAST(l_shipdate AS DATE) AS date,
         'part ' || CAST(l_partkey AS VARCHAR) AS description,
         l_returnflag AS category,
         l_extendedprice AS amount,
         l_linestatus AS from_account,
         's' || CAST(l_suppkey % 10 AS VARCHAR) AS towards
  FROM lineitem)"""

EVENT_LINES = """event_lines AS (
  SELECT 'e' || CAST(event_id AS VARCHAR) AS id,
         CAST(ts AS DATE) AS date,
         upper(event_type[1]) || lower(event_type[2:]) AS description,
         'online' AS category,
         value AS amount,
         event_type AS from_account,
         CASE WHEN event_id % 2 = 0 THEN 'home' ELSE 'office' END AS towards
  FROM events)"""

SUBMISSIONS = r"""submissions AS (
  SELECT event_id AS entry,
         CASE WHEN event_id % 17 = 0 THEN ' ' || chr(9)
              WHEN event_id % 17 = 1 THEN 'a-b'
              WHEN event_id % 17 = 2 THEN 'it''s x_y'
              ELSE upper(event_type) END AS description,
         CASE WHEN event_id % 19 = 0 THEN 'hello'
              WHEN event_id % 19 = 1 THEN '2024-02-30'
              WHEN event_id % 19 = 2 THEN '01/15/2024'
              ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS date,
         CASE WHEN event_id % 23 = 0 THEN 'abc'
              WHEN event_id % 23 = 1 THEN '-5'
              WHEN event_id % 23 = 2 THEN 'nan'
              WHEN event_id % 23 = 3 THEN 'inf'
              WHEN event_id % 23 = 4 THEN '1d'
              WHEN event_id % 23 = 5 THEN ' 1e3 '
              WHEN event_id % 23 = 6 THEN '1,000'
              WHEN event_id % 23 = 7 THEN '0'
              ELSE CAST(value AS VARCHAR) END AS amount,
         CASE WHEN event_id % 29 <> 0 THEN 'online' END AS category,
         event_type AS from_account,
         CASE WHEN event_id % 31 = 0 THEN '' ELSE 'home' END AS towards
  FROM events),
typed AS (
  SELECT *,
         CAST(coalesce(try_strptime(date, '%Y-%m-%d'), try_strptime(date, '%m/%d/%Y')) AS DATE)
           AS day,
         CASE WHEN isnan(try_cast(amount AS DOUBLE)) THEN NULL
              ELSE try_cast(amount AS DOUBLE) END AS number
  FROM submissions),
missing AS (
  SELECT *,
         list_filter([
           CASE WHEN description IS NULL OR regexp_full_match(description, '\s*')
                THEN 'Description' END,
           CASE WHEN date IS NULL OR regexp_full_match(date, '\s*') THEN 'Date' END,
           CASE WHEN amount IS NULL OR regexp_full_match(amount, '\s*') THEN 'Amount' END,
           CASE WHEN from_account IS NULL OR regexp_full_match(from_account, '\s*')
                THEN 'From Account' END,
           CASE WHEN towards IS NULL OR regexp_full_match(towards, '\s*')
                THEN 'To Account' END,
           CASE WHEN category IS NULL OR regexp_full_match(category, '\s*')
                THEN 'Category' END], lambda f: f IS NOT NULL) AS missing
  FROM typed),
checked AS (
  SELECT *,
         CASE WHEN len(missing) > 0 THEN 'Missing required fields'
              WHEN regexp_matches(description, '[!@#$%^&*()\-=+<>?,./]')
                THEN 'Contains prohibited symbols (!@#$%^&*()-=+<>?,./)'
              WHEN number IS NULL OR isinf(number) THEN 'Amount must be a valid number'
              WHEN number <= 0 THEN 'Amount must be positive (> 0)'
              WHEN day IS NULL THEN 'Invalid date format' END AS reason
  FROM missing),
verdicts AS (
  SELECT *,
         CASE WHEN reason LIKE 'Contains%' THEN 'Description'
              WHEN reason LIKE 'Amount%' THEN 'Amount'
              WHEN reason LIKE 'Invalid%' THEN 'Date' END AS field
  FROM checked)"""

FILE_ROWS = """file_rows AS (
  SELECT 'u_' || CAST(user_id AS VARCHAR) || '.csv' AS file,
         user_id,
         CASE WHEN user_id % 10 = 3 AND event_id % 5 = 0 THEN 'hello'
              ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS date,
         CASE WHEN user_id % 10 <> 4 OR event_id % 7 <> 0 THEN event_type END AS description,
         CASE WHEN user_id % 10 = 5 AND event_id % 3 = 0 THEN 'abc'
              WHEN user_id % 3 = 0
                THEN CAST(CAST(floor(value / 10) AS BIGINT) * 10 AS VARCHAR)
              ELSE CAST(value AS VARCHAR) END AS amount,
         event_type AS from_account,
         'home' AS towards
  FROM events)"""

IMPORT_LOG = """import_log AS (
  SELECT 'log' || CAST(c_custkey AS VARCHAR) AS id,
         'menu_' || CAST(c_custkey * 7 AS VARCHAR) || '.csv' AS filename
  FROM customer)"""

DATED_ROWS = """dated_rows AS (
  SELECT 'u_' || CAST(user_id AS VARCHAR) || '.csv' AS file, event_id AS entry,
         CASE WHEN event_id % 37 = 0 THEN NULL WHEN event_id % 41 = 0 THEN 'soon'
              WHEN user_id % 5 = 0 THEN CAST(CAST(ts AS DATE) AS VARCHAR)
              WHEN user_id % 5 = 1 OR user_id % 5 = 3 AND event_id % 2 = 0 THEN strftime(ts, '%-m/%-d/%Y')
              WHEN user_id % 5 IN (2, 3) OR day(ts) <= 12 THEN strftime(ts, '%d/%m/%Y') END AS date
  FROM events),
readings AS (
  SELECT *, CAST(try_strptime(date, '%m/%d/%Y') AS DATE) AS month_first,
         CAST(try_strptime(date, '%d/%m/%Y') AS DATE) AS day_first
  FROM dated_rows),
orders AS (
  SELECT file, count(*) FILTER (month_first IS NOT NULL OR day_first IS NOT NULL) AS slash_dates,
         count(*) FILTER (month_first <> day_first) AS open_dates,
         count(*) FILTER (month_first IS NOT NULL AND day_first IS NULL) AS only_month,
         count(*) FILTER (day_first IS NOT NULL AND month_first IS NULL) AS only_day
  FROM readings GROUP BY file),
named AS (
  SELECT *, CASE WHEN slash_dates = 0 THEN NULL WHEN only_month > 0 AND only_day > 0 THEN 'mixed'
                 WHEN only_day > 0 THEN 'day first' WHEN only_month > 0 OR open_dates = 0 THEN 'month first'
                 ELSE 'ambiguous' END AS date_order
  FROM orders)"""

# ``accounts_to_add`` also gets the fixed seed accounts of ``schemas.py``; see seed_accounts below.
ACCOUNTS = """accounts AS (
  SELECT 'c' || CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CAST(NULL AS VARCHAR) AS tag,
         CAST(c_custkey AS VARCHAR) AS marker, c_mktsegment AS type,
         CAST(0 AS DOUBLE) AS minimum_balance_per_bank,
         CAST(0 AS DOUBLE) AS minimum_balance_per_self,
         c_acctbal AS current_balance, 'EUR' AS currency
  FROM customer)"""

# The verdicts on the files, step by step.
FILE_GATE = (
    FILE_ROWS
    + ",\n"
    + IMPORT_LOG
    + """,
duplicates AS (
  SELECT file, count(*) AS duplicate_groups
  FROM (SELECT file FROM file_rows
        WHERE date IS NOT NULL AND try_cast(amount AS DOUBLE) IS NOT NULL
          AND from_account IS NOT NULL AND towards IS NOT NULL
        GROUP BY file, date, try_cast(amount AS DOUBLE), from_account, towards
        HAVING count(*) > 1)
  GROUP BY file),
findings AS (
  SELECT file, min(user_id) AS arrival, count(*) AS row_count,
         count(*) FILTER (description IS NULL) AS no_description,
         count(*) FILTER (try_cast(amount AS DOUBLE) IS NULL) AS non_numeric_amounts,
         count(*) FILTER (try_strptime(date, '%Y-%m-%d') IS NULL) AS bad_dates
  FROM file_rows GROUP BY file),
own AS (
  SELECT f.*, coalesce(d.duplicate_groups, 0) AS duplicate_groups,
         (SELECT arg_min(l.filename, l.id) FROM import_log l
          WHERE l.filename LIKE '%' || f.file || '%') AS imported_as,
         concat_ws('; ',
           CASE WHEN no_description > 0 THEN 'Null values found in: description' END,
           CASE WHEN non_numeric_amounts > 0
                THEN non_numeric_amounts || ' rows have non-numeric amounts' END) AS errors
  FROM findings f LEFT JOIN duplicates d USING (file)),
first_status AS (
  SELECT *, CASE WHEN errors <> '' THEN 'structure'
                 WHEN imported_as IS NOT NULL THEN 'already imported'
                 WHEN duplicate_groups > 0 THEN 'duplicate rows'
                 WHEN bad_dates > 0 THEN 'bad dates'
                 ELSE 'accepted' END AS status
  FROM own),
gate AS (
  SELECT s.* EXCLUDE (status),
         CASE WHEN s.status = 'accepted' AND EXISTS (
                SELECT 1 FROM first_status e
                WHERE e.status = 'accepted' AND e.arrival < s.arrival
                  AND e.file LIKE '%' || s.file || '%')
              THEN 'already imported' ELSE s.status END AS status
  FROM first_status s)"""
)


def fact(lines: str, tag: str = "CAST(NULL AS VARCHAR)") -> str:
    """Fact columns over a set of raw lines, without the clock columns."""
    return f"""fact AS (
  SELECT id, date AS expense_date, description, category AS parent_category,
         CAST(NULL AS VARCHAR) AS sub_category, {tag} AS category_tag,
         amount AS expend_amount, 'EUR' AS currency, from_account AS from_account_marker,
         towards AS towards_category, CAST(NULL AS VARCHAR) AS towards_sub_category,
         CAST(NULL AS VARCHAR) AS towards_category_tag,
         CAST(day(date) AS INTEGER) AS day_of_month, CAST(month(date) AS INTEGER) AS month,
         CAST(year(date) AS INTEGER) AS year,
         CAST(year(date) * 100 + month(date) AS INTEGER) AS month_year,
         strftime(date, '%b-%y') AS month_year_marker,
         CAST(dayofweek(date) AS INTEGER) AS num_day_of_week, dayname(date) AS day_of_week,
         CASE WHEN month(date) IN (12, 1, 2) THEN 'Winter'
              WHEN month(date) IN (3, 4, 5) THEN 'Spring'
              WHEN month(date) IN (6, 7, 8) THEN 'Summer'
              ELSE 'Autumn' END AS season
  FROM {lines})"""


ORDERS_FACT = f"WITH {ORDER_LINES},\n{fact('order_lines')}\n"
ITEMS_FACT = f"WITH {ITEM_LINES},\n{fact('item_lines')}\n"
EVENTS_FACT = f"{EVENT_LINES},\n{fact('event_lines')}"
TOTAL = f"CAST(coalesce(sum(CAST(expend_amount AS {MONEY})), 0) AS DOUBLE)"
MEAN = f"CAST(sum(CAST(expend_amount AS {MONEY})) AS DOUBLE) / count(expend_amount)"

# The first fact a submission repeats.
REPEATS = """repeats AS (
  SELECT s.entry, min(f.id) AS duplicate_of
  FROM verdicts s JOIN fact f
    ON f.expense_date = s.day AND lower(f.description) = lower(s.description)
   AND f.expend_amount = s.number AND f.parent_category = s.category
   AND f.from_account_marker = s.from_account AND f.towards_category = s.towards
  GROUP BY s.entry)"""


def _total_by(source: str, *keys: str, where: str = "TRUE") -> str:
    present = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    columns = ", ".join(keys)
    return (
        f"{source}SELECT {columns}, {TOTAL} AS expend_amount FROM fact "
        f"WHERE {present} AND {where} GROUP BY {columns}"
    )


MART_KEYS = {
    "category": ["parent_category"],
    "monthly": ["year", "month", "month_year_marker"],
    "weekday": ["num_day_of_week", "day_of_week"],
    "season": ["season"],
    "account": ["from_account_marker"],
    "tag": ["category_tag"],
    "towards": ["towards_category"],
}


def _mart(fact_rows: str) -> str:
    every = [k for keys in MART_KEYS.values() for k in keys]
    parts = []
    for kpi, keys in MART_KEYS.items():
        columns = ", ".join(k if k in keys else f"NULL AS {k}" for k in every)
        present = " AND ".join(f"{k} IS NOT NULL" for k in keys)
        parts.append(
            f"SELECT '{kpi}' AS kpi, {columns}, {TOTAL} AS total, {MEAN} AS mean, "
            f"count(*) AS transactions FROM fact WHERE {present} GROUP BY {', '.join(keys)}"
        )
    return fact_rows + "\nUNION ALL\n".join(parts)


def _running_total(fact_rows: str) -> str:
    return f"""{fact_rows}
SELECT expense_date, CASE WHEN expend_amount IS NOT NULL THEN CAST(
         sum(CAST(expend_amount AS {MONEY})) OVER (
           ORDER BY expense_date NULLS LAST, md5(id), id, expend_amount
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) END AS cumulative_amount
FROM fact"""


def _other_kpis(fact_rows: str) -> str:
    return f"""{fact_rows},
days AS (SELECT expense_date, sum(CAST(expend_amount AS {MONEY})) AS total, count(*) AS n FROM fact GROUP BY expense_date),
rows AS (
  SELECT 'headline' AS kpi, CAST(NULL AS DATE) AS expense_date, CAST(NULL AS VARCHAR) AS description,
         (SELECT parent_category FROM fact WHERE parent_category IS NOT NULL
          GROUP BY parent_category ORDER BY {TOTAL} DESC, parent_category LIMIT 1) AS parent_category,
         {TOTAL} AS total, count(*) AS transactions FROM fact
  UNION ALL
  (SELECT 'top', expense_date, description, parent_category, expend_amount, NULL
   FROM fact ORDER BY expend_amount DESC NULLS LAST, id LIMIT 10)
  UNION ALL
  SELECT 'daily', expense_date, NULL, NULL,
         CAST(coalesce(sum(total) OVER (ORDER BY expense_date NULLS LAST), 0) AS DOUBLE), n FROM days)
SELECT *, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS type, CAST(NULL AS DOUBLE) AS current_balance
FROM rows
UNION ALL
SELECT 'balances', NULL, NULL, NULL, NULL, NULL, name, type, balance FROM (VALUES
  ('N26', 'general expense', 80), ('Wise', 'fat expense', 730), ('Deutsche Bank', 'salary', 7300),
  ('ICICI', 'eccomerce', 7300)) AS accounts(name, type, balance)"""


# Orders and events as the raw table holds them: a missing amount is zero.
RAW_LINES = f"""{ORDER_LINES},
{EVENT_LINES},
raw_lines AS (
  SELECT id, date, description, category, coalesce(amount, 0) AS amount, from_account, towards
  FROM order_lines
  UNION ALL
  SELECT id, date, description, category, amount, from_account, towards FROM event_lines)"""
RAW_FACT = f"WITH {RAW_LINES},\n{fact('raw_lines')}"


ORACLE_SQL: dict[str, str] = {
    "scan_fact": f"{ITEMS_FACT}SELECT * FROM fact",
    "fct_expense": f"{ORDERS_FACT}SELECT *, DATE '2026-01-01' AS booked_date FROM fact",
    "fct_incremental": (
        f"WITH {EVENTS_FACT}\nSELECT *, DATE '2026-01-01' AS booked_date FROM fact"
    ),
    "append_bronze": f"""WITH {ORDER_LINES},
{EVENT_LINES}
SELECT towards, count(*) AS row_count, count(date) AS dated_rows
FROM (SELECT towards, date FROM order_lines UNION ALL SELECT towards, date FROM event_lines)
GROUP BY towards""",
    "date_parts": f"""{ORDERS_FACT}
SELECT id, day_of_month, month, year, month_year, month_year_marker, num_day_of_week, day_of_week
FROM fact""",
    "season_label": f"{ORDERS_FACT}SELECT id, season FROM fact",
    "normalize_header": f"""WITH {EVENT_LINES}
SELECT id, date, description, category, amount, from_account, towards FROM event_lines""",
    "default_category": f"""WITH {ORDER_LINES},
{EVENT_LINES}
SELECT id, category FROM order_lines
UNION ALL SELECT id, 'Uncategorized' AS category FROM event_lines""",
    "coerce_amount": f"WITH {SUBMISSIONS}\nSELECT entry, coalesce(number, 0) AS amount FROM typed",
    "parse_date": f"WITH {SUBMISSIONS}\nSELECT entry, day AS date FROM typed",
    "validate_rows": f"""WITH {SUBMISSIONS}
SELECT entry, reason IS NULL AS is_valid, array_to_string(missing, ', ') AS missing_fields,
       field AS error_field, reason AS error_reason,
       CASE field WHEN 'Description' THEN description WHEN 'Amount' THEN amount
                  WHEN 'Date' THEN date END AS error_value
FROM verdicts""",
    "validate_file_nulls": f"""WITH {FILE_ROWS}
SELECT file, count(*) AS row_count,
       count(*) FILTER (description IS NULL) AS null_descriptions,
       CASE WHEN count(*) FILTER (description IS NULL) > 0 THEN 'description' ELSE '' END
         AS null_columns
FROM file_rows GROUP BY file""",
    "validate_file_nonnumeric": f"""WITH {FILE_ROWS}
SELECT count(*) FILTER (description IS NULL OR try_cast(amount AS DOUBLE) IS NULL) = 0 AS is_valid,
       count(*) AS row_count,
       count(*) FILTER (try_cast(amount AS DOUBLE) IS NULL) AS non_numeric_amounts
FROM file_rows""",
    "dup_groups": f"""WITH {FILE_ROWS}
SELECT file, date, try_cast(amount AS DOUBLE) AS amount, from_account, towards,
       count(*) AS occurrence_count
FROM file_rows WHERE try_cast(amount AS DOUBLE) IS NOT NULL
GROUP BY file, date, try_cast(amount AS DOUBLE), from_account, towards HAVING count(*) > 1""",
    "dup_vs_fact": f"""WITH {SUBMISSIONS},
{EVENTS_FACT},
{REPEATS}
SELECT entry, duplicate_of FROM submissions LEFT JOIN repeats USING (entry)""",
    "file_already_imported": f"""WITH {FILE_ROWS},
{IMPORT_LOG},
names AS (SELECT DISTINCT file AS filename FROM file_rows)
SELECT n.filename, min(l.id) AS log_id
FROM names n LEFT JOIN import_log l ON l.filename LIKE '%' || n.filename || '%'
GROUP BY n.filename""",
    "pk_violations": f"""WITH {ITEM_LINES}
SELECT id, count(*) AS row_count FROM item_lines GROUP BY id HAVING count(*) > 1""",
    "file_gate": f"""WITH {FILE_GATE}
SELECT file AS filename, status, row_count, duplicate_groups, non_numeric_amounts, bad_dates,
       errors, imported_as FROM gate""",
    "file_quarantine": f"""WITH {FILE_GATE},
held AS (
  SELECT r.* EXCLUDE (user_id), g.status, g.imported_as,
         count(*) OVER (PARTITION BY file, date, try_cast(amount AS DOUBLE), from_account, towards) AS copies
  FROM file_rows r JOIN gate g USING (file) WHERE g.status <> 'accepted'),
judged AS (
  SELECT *, CASE WHEN description IS NULL THEN 1 WHEN try_cast(amount AS DOUBLE) IS NULL THEN 2
                 WHEN copies > 1 THEN 3 WHEN try_strptime(date, '%Y-%m-%d') IS NULL THEN 4 ELSE 5 END AS fault
  FROM held)
SELECT file, date, description, amount, from_account, towards, status,
       [ 'description', 'amount', NULL, 'date', NULL ][fault] AS error_field,
       [ 'Missing value', 'Amount must be a valid number', 'Row occurs more than once in the file',
         'Invalid date format', 'File rejected: ' || status ][fault] AS error_reason,
       [ NULL, amount, CAST(copies AS VARCHAR), date, imported_as ][fault] AS error_value
FROM judged""",
    "date_order": f"WITH {DATED_ROWS}\nSELECT file, date_order, slash_dates, open_dates FROM named",
    "dates_in_order": f"""WITH {DATED_ROWS}
SELECT file, entry, date AS written,
       coalesce(CASE WHEN date_order = 'day first' THEN day_first ELSE month_first END,
                CAST(try_strptime(date, '%Y-%m-%d') AS DATE)) AS date
FROM readings JOIN named USING (file)""",
    "import_log": f"""WITH {FILE_GATE}
SELECT file AS filename, '2026-01-01' AS date_imported,
       CAST(row_count AS INTEGER) AS no_of_rows_imported
FROM gate WHERE status = 'accepted'""",
    "row_gate": f"""WITH {SUBMISSIONS},
{EVENTS_FACT},
{REPEATS},
ranked AS (
  SELECT entry, row_number() OVER (
           PARTITION BY day, lower(description), number, category, from_account, towards
           ORDER BY entry) AS place
  FROM verdicts WHERE reason IS NULL)
SELECT v.entry,
       CASE WHEN reason IS NOT NULL THEN 'invalid'
            WHEN duplicate_of IS NOT NULL OR place > 1 THEN 'duplicate'
            ELSE 'accepted' END AS status,
       field AS error_field,
       CASE WHEN reason IS NULL THEN duplicate_of END AS duplicate_of
FROM verdicts v LEFT JOIN repeats USING (entry) LEFT JOIN ranked USING (entry)""",
    "seed_accounts": f"""WITH {ACCOUNTS},
candidates AS (
  SELECT 's' || CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, CAST(NULL AS VARCHAR) AS tag,
         CAST(s_suppkey * 31 AS VARCHAR) AS marker, 'supplier' AS type,
         CAST(0 AS DOUBLE) AS minimum_balance_per_bank,
         CAST(0 AS DOUBLE) AS minimum_balance_per_self,
         s_acctbal AS current_balance, 'EUR' AS currency FROM supplier
  UNION ALL SELECT * FROM (VALUES
    ('n26', 'N26', 'atul,cc,prepaid', 'n26', 'general expense', 0, 10, 80, 'EUR'),
    ('wise', 'Wise', 'atul,cc,prepaid', 'wise', 'fat expense', 0, 100, 730, 'EUR'),
    ('deutsche_bank', 'Deutsche Bank', 'atul,db,salary', 'deutsche_bank', 'salary',
     100, 1000, 7300, 'EUR'),
    ('icici', 'ICICI', 'atul,amazon_card,postpaid', 'icici', 'eccomerce', 0, 0, 7300, 'INR')))
SELECT * FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM accounts a WHERE a.marker = c.marker)""",
    "accounts_repeated": f"""WITH {ACCOUNTS},
candidates AS (
  SELECT 's' || CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, CAST(NULL AS VARCHAR) AS tag,
         CASE WHEN s_suppkey % 11 <> 0 THEN 'm' || CAST(s_suppkey % 7 AS VARCHAR) END AS marker,
         'supplier' AS type, CAST(0 AS DOUBLE) AS minimum_balance_per_bank,
         CAST(0 AS DOUBLE) AS minimum_balance_per_self, s_acctbal AS current_balance,
         'EUR' AS currency
  FROM supplier)
SELECT * FROM candidates c
WHERE marker IS NULL
   OR (NOT EXISTS (SELECT 1 FROM accounts a WHERE a.marker = c.marker)
       AND id = (SELECT min(d.id) FROM candidates d WHERE d.marker = c.marker))""",
    "form_labels": f"""WITH {SUBMISSIONS}
SELECT entry, description, date, amount, category, from_account, towards FROM submissions""",
    "iso_date": f"""WITH {SUBMISSIONS}
SELECT entry, CASE WHEN regexp_full_match(date, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}')
                   THEN CAST(try_strptime(date, '%Y-%m-%d') AS DATE) END AS date
FROM submissions""",
    "file_logged_exact": f"""WITH {IMPORT_LOG},
names AS (SELECT DISTINCT 'menu_' || CAST(user_id AS VARCHAR) || '.csv' AS filename FROM events)
SELECT n.filename, min(l.id) AS log_id
FROM names n LEFT JOIN import_log l USING (filename) GROUP BY n.filename""",
    "ledger_raw": f"WITH {RAW_LINES}\nSELECT * FROM raw_lines",
    "ledger_fact": f"""WITH {RAW_LINES},
{fact("raw_lines")}
SELECT *, DATE '2026-01-01' AS booked_date FROM fact""",
    "ledger_import": """
SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_orderdate AS DATE) AS date,
       'say "' || o_orderpriority || '", or' || chr(10) || 'not' AS description,
       'Uncategorized' AS category, o_totalprice AS amount, o_orderstatus AS from_account,
       'c' || CAST(o_custkey AS VARCHAR) AS towards
FROM orders""",
    "ledger_submitted": f"""WITH {SUBMISSIONS},
ranked AS (
  SELECT *, row_number() OVER (
           PARTITION BY day, lower(description), number, category, from_account, towards
           ORDER BY entry) AS place
  FROM verdicts WHERE reason IS NULL)
SELECT day AS date, description, category, number AS amount, from_account, towards
FROM ranked WHERE place = 1""",
    "ledger_export": """
SELECT 'export_' || name || '_2026_01_01.' || kind AS export, rows AS row_count, rows AS ids
FROM (SELECT unnest(['csv', 'parquet']) AS kind),
     (SELECT 'expenses_line' AS name, count(*) AS rows FROM orders
      UNION ALL SELECT 'fct_expense', count(*) FROM orders
      UNION ALL SELECT 'dim_account', 4 UNION ALL SELECT 'integrity_file_imported', 0)""",
    "ledger_log": f"""WITH {FILE_GATE}
SELECT file AS filename, '2026-01-01' AS date_imported,
       CAST(row_count AS INTEGER) AS no_of_rows_imported
FROM gate WHERE status = 'accepted'""",
    "kpi_category_wide": f"""{ORDERS_FACT}, wide AS (
  SELECT 'g' || CAST(CAST(id AS BIGINT) % 9 + CAST(id AS BIGINT) % 4 AS VARCHAR) AS parent_category,
         CASE CAST(id AS BIGINT) % 4 WHEN 0 THEN 4e-7::DOUBLE WHEN 1 THEN expend_amount
              WHEN 2 THEN expend_amount / 3 ELSE expend_amount * 1e6::DOUBLE END AS amount
  FROM fact)
SELECT parent_category, printf('%.11e', coalesce(fsum(amount), 0)) AS total
FROM wide GROUP BY parent_category""",
    "kpi_headline": f"""{ORDERS_FACT}
SELECT {TOTAL} AS total_expenses, count(*) AS total_transactions,
       (SELECT parent_category FROM fact WHERE parent_category IS NOT NULL
        GROUP BY parent_category ORDER BY {TOTAL} DESC, parent_category LIMIT 1) AS top_category
FROM fact""",
    "kpi_category": _total_by(ORDERS_FACT, "parent_category"),
    "kpi_category_filtered": _total_by(
        ORDERS_FACT,
        "parent_category",
        where="parent_category IN ('1-URGENT', '5-LOW', 'no such category') "
        "AND expense_date BETWEEN DATE '1996-03-01' AND DATE '1999-11-30'",
    ),
    "kpi_monthly": _total_by(ORDERS_FACT, "year", "month", "month_year_marker"),
    "kpi_weekday_avg": f"""{ORDERS_FACT}
SELECT num_day_of_week, day_of_week, {MEAN} AS expend_amount
FROM fact WHERE num_day_of_week IS NOT NULL GROUP BY num_day_of_week, day_of_week""",
    "kpi_top10": f"""{ORDERS_FACT}
SELECT expense_date, description, parent_category, expend_amount
FROM fact ORDER BY expend_amount DESC NULLS LAST, id LIMIT 10""",
    "kpi_season": _total_by(ITEMS_FACT, "season"),
    "kpi_account": _total_by(ITEMS_FACT, "from_account_marker"),
    "kpi_tag": _total_by(
        f"""WITH {ORDER_LINES},
{fact("order_lines", "CASE WHEN towards <> 't1' THEN from_account END")}
""",
        "category_tag",
    ),
    "kpi_towards": _total_by(ITEMS_FACT, "towards_category"),
    "kpi_balances": f"WITH {ACCOUNTS}\nSELECT name, type, current_balance, currency FROM accounts",
    "kpi_cumulative": _running_total(ORDERS_FACT),
    "kpi_mart": _mart(ITEMS_FACT),
    "mart_incremental": _mart(RAW_FACT + "\n"),
    "mart_kept_others": _other_kpis(RAW_FACT),
    "mart_of_years": f"""{RAW_FACT}
SELECT parent_category, {TOTAL} AS total, count(*) AS transactions
FROM fact WHERE parent_category IS NOT NULL AND year IN (1996, 1999, 2024) GROUP BY parent_category""",
    "kpi_stream": f"""{RAW_FACT}
SELECT 'category' AS kpi, parent_category, NULL AS year, NULL AS month, NULL AS month_year_marker,
       {TOTAL} AS total, count(*) AS transactions
FROM fact WHERE parent_category IS NOT NULL GROUP BY parent_category
UNION ALL
SELECT 'monthly', NULL, year, month, month_year_marker, {TOTAL}, count(*)
FROM fact WHERE year IS NOT NULL GROUP BY year, month, month_year_marker""",
    "cumulative_after_late_batch": _running_total(RAW_FACT),
}

ORACLE_SQL["dup_vs_fact_bucketed"] = ORACLE_SQL["dup_vs_fact"]
ORACLE_SQL["file_imported_indexed"] = ORACLE_SQL["file_already_imported"]
for _name in ("ledger_frame", "ledger_seed", "ledger_stream"):
    ORACLE_SQL[_name] = ORACLE_SQL["ledger_import"]
ORACLE_SQL["ledger_submit"] = ORACLE_SQL["row_gate"]
