"""The test tables seen as ledger tables. Gaps and faults are put into cells by rule; no row is
left out. ``oracle.py`` holds the same rules in SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = dt.datetime(2026, 1, 1)


# Schemas of the test tables in use. Naming them saves a look into the files.
_SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def order_expenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as raw expenses; some have no date, no category or no amount."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        key.cast("string").alias("id"),
        F.when(key % 13 != 0, F.col("o_orderdate").cast("date")).alias("date"),
        F.col("o_orderpriority").alias("description"),
        F.when(customer % 7 != 0, F.col("o_orderpriority")).alias("category"),
        F.when(key % 11 != 0, F.col("o_totalprice")).alias("amount"),
        F.col("o_orderstatus").alias("from_account"),
        F.concat(F.lit("t"), (customer % 3).cast("string")).alias("towards"),
    )


def item_expenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as raw expenses: the largest table, without gaps. Ids repeat."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber")).alias("id"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("description"),
        F.col("l_returnflag").alias("category"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_linestatus").alias("from_account"),
        F.concat(F.lit("s"), (F.col("l_suppkey") % 10).cast("string")).alias("towards"),
    )


def event_expenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw expenses, all in one month; half of them went to the office."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"),
        F.col("ts").cast("date").alias("date"),
        F.initcap("event_type").alias("description"),
        F.lit("online").alias("category"),
        F.col("value").alias("amount"),
        F.col("event_type").alias("from_account"),
        F.when(F.col("event_id") % 2 == 0, "home").otherwise("office").alias("towards"),
    )


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as entries of the form, all text, with every kind of fault among them."""
    n = F.col("event_id")
    date = F.col("ts").cast("date").cast("string")
    return table(spark, sf_dir, "events").select(
        n.alias("entry"),
        F.when(n % 17 == 0, F.lit(" \t"))
        .when(n % 17 == 1, F.lit("a-b"))
        .when(n % 17 == 2, F.lit("it's x_y"))
        .otherwise(F.upper("event_type"))
        .alias("Description"),
        F.when(n % 19 == 0, F.lit("hello"))
        .when(n % 19 == 1, F.lit("2024-02-30"))
        .when(n % 19 == 2, F.lit("01/15/2024"))
        .otherwise(date)
        .alias("Date"),
        F.when(n % 23 == 0, F.lit("abc"))
        .when(n % 23 == 1, F.lit("-5"))
        .when(n % 23 == 2, F.lit("nan"))
        .when(n % 23 == 3, F.lit("inf"))
        .when(n % 23 == 4, F.lit("1d"))
        .when(n % 23 == 5, F.lit(" 1e3 "))
        .when(n % 23 == 6, F.lit("1,000"))
        .when(n % 23 == 7, F.lit("0"))
        .otherwise(F.col("value").cast("string"))
        .alias("Amount"),
        F.when(n % 29 != 0, F.lit("online")).alias("Category"),
        F.col("event_type").alias("From Account"),
        F.when(n % 31 == 0, F.lit("")).otherwise(F.lit("home")).alias("To Account"),
    )


def file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the raw rows of one file per user. Amounts are rounded to tens, so some files
    repeat rows; some files have an empty cell, an odd amount or an odd date."""
    n, user = F.col("event_id"), F.col("user_id")
    date = F.col("ts").cast("date").cast("string")
    return table(spark, sf_dir, "events").select(
        _file_name(user).alias("file"),
        F.when((user % 10 == 3) & (n % 5 == 0), "hello").otherwise(date).alias("date"),
        F.when((user % 10 != 4) | (n % 7 != 0), F.col("event_type")).alias("description"),
        F.when((user % 10 == 5) & (n % 3 == 0), "abc")
        .when(user % 3 == 0, (F.floor(F.col("value") / 10) * 10).cast("string"))
        .otherwise(F.col("value").cast("string"))
        .alias("amount"),
        F.col("event_type").alias("from_account"),
        F.lit("home").alias("towards"),
    )


def dated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows of one file per user, some files with the day first, some with the month first,
    some with both, and some odd cells."""
    n, user = F.col("event_id"), F.col("user_id")
    day = F.col("ts").cast("date")
    month_first, day_first = F.date_format(day, "M/d/yyyy"), F.date_format(day, "dd/MM/yyyy")
    return table(spark, sf_dir, "events").select(
        _file_name(user).alias("file"),
        n.alias("entry"),
        F.when(n % 37 == 0, F.lit(None))
        .when(n % 41 == 0, "soon")
        .when(user % 5 == 0, day.cast("string"))
        .when(user % 5 == 1, month_first)
        .when(user % 5 == 2, day_first)
        .when(user % 5 == 3, F.when(n % 2 == 0, month_first).otherwise(day_first))
        .otherwise(F.when(F.dayofmonth(day) <= 12, day_first))
        .alias("date"),
    )


def batch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files behind ``file_rows``, in order of their user."""
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("_n"))
    name = _file_name(F.col("user_id"))
    return users.select(
        name.alias("file"),
        name.alias("filename"),
        F.col("user_id").alias("arrival"),
        F.array().cast("array<string>").alias("missing_columns"),
    )


def _file_name(user: Column) -> Column:
    return F.concat(F.lit("u_"), user.cast("string"), F.lit(".csv"))


def import_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log row per customer; their file names contain some names of the batch."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("log"), key.cast("string")).alias("id"),
        F.lit(AS_OF).cast("timestamp").alias("ts"),
        F.concat(F.lit("menu_"), (key * 7).cast("string"), F.lit(".csv")).alias("filename"),
        F.lit("2026-01-01").alias("date_imported"),
        F.lit(1).alias("no_of_rows_imported"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as accounts."""
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"),
        F.col("c_name").alias("name"),
        F.lit(None).cast("string").alias("tag"),
        F.col("c_custkey").cast("string").alias("marker"),
        F.col("c_mktsegment").alias("type"),
        F.lit(0.0).alias("minimum_balance_per_bank"),
        F.lit(0.0).alias("minimum_balance_per_self"),
        F.col("c_acctbal").alias("current_balance"),
        F.lit("EUR").alias("currency"),
    )


def account_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as accounts to add; some have the marker of a customer."""
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"),
        F.col("s_name").alias("name"),
        F.lit(None).cast("string").alias("tag"),
        (F.col("s_suppkey") * 31).cast("string").alias("marker"),
        F.lit("supplier").alias("type"),
        F.lit(0.0).alias("minimum_balance_per_bank"),
        F.lit(0.0).alias("minimum_balance_per_self"),
        F.col("s_acctbal").alias("current_balance"),
        F.lit("EUR").alias("currency"),
    )
