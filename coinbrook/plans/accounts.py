"""The account dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from coinbrook.operators.lookup import absent_from
from coinbrook.schemas import DIM_ACCOUNT, SEED_ACCOUNTS
from coinbrook.sources.local import local_frame


def seed_rows(spark: SparkSession) -> DataFrame:
    """The accounts every ledger starts with, without ids."""
    fields = [f for f in DIM_ACCOUNT if f.name != "id"]
    return local_frame(spark, SEED_ACCOUNTS, StructType(fields))


def accounts_to_add(candidates: DataFrame, accounts: DataFrame) -> DataFrame:
    """Candidates whose marker the dimension does not have yet, as rows of the dimension.

    Of several candidates with one marker, the one with the lowest id is added (a missing id comes
    first, then the lowest of the other columns). A missing marker equals no other.
    """
    added = absent_from(candidates, accounts, ["marker"])
    if "id" not in added.columns:
        added = added.withColumn("id", F.lit(None).cast("string"))
    columns = [f.name for f in DIM_ACCOUNT]
    added = added.select(*[F.col(f.name).cast(f.dataType) for f in DIM_ACCOUNT])
    row = F.struct(*columns)
    marked = added.filter("marker is not null").groupBy("marker").agg(F.min(row).alias("row"))
    added = marked.select("row.*").unionByName(added.filter("marker is null"))
    return added.withColumn("id", F.coalesce("id", F.expr("uuid()"))).select(*columns)
