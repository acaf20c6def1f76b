"""One query per operator, on the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coinbrook.llm import (
    decontaminate,
    exact_dedup,
    extraction,
    language_id,
    license_scan,
    line_dedup,
    lm_scoring,
    mixing,
    near_dedup,
    secret_scan,
    token_alignment,
    vector_codes,
    warc,
)
from coinbrook.llm.common import ready, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"), carry=["doc_id"])
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, sf, "documents"))


def op3_secrets(spark: SparkSession, sf: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf, "documents").select("doc_id", "text"))
    kinds = [kind for kind, *_ in secret_scan.FORMS]
    return found.select(
        "row.doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in kinds],
        F.sha2(secret_scan.joined_spans(kinds).cast("binary"), 256).alias("base_sha256"),
        secret_scan.joined_spans([*kinds, "random"]).alias("spans"),
    )


def op4_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    found = mixing.mix(docs)
    return found.select("row.doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "sampled")


def op5_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = line_dedup.mark_lines(table(spark, sf, "documents"))
    return found.withColumn("removed", F.array_join("removed", ","))


def op6_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf, "documents"), shingle_words=4)


def op7_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return language_id.identify(table(spark, sf, "documents"))


def op8_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf, "documents"))


def op9_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.archive_and_read(spark, table(spark, sf, "pages"))


def op10_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.extract(table(spark, sf, "pages"))


def op11_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    coded, codebooks = vector_codes.compress(table(spark, sf, "embeddings"), carry=["vec_id", "label"])
    numbers = ",".join(str(x) for book in codebooks for entry in book for x in entry)
    found = vector_codes.with_label_error(coded, "label")
    return found.select(
        "row.vec_id", "code", "error", "label_error", F.sha2(F.lit(numbers).cast("binary"), 256).alias("codebooks_sha256")
    )


def op12_licenses(spark: SparkSession, sf: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf, "documents"), carry=["doc_id"])
    places = license_scan.base_places()
    return found.select(
        "row.doc_id",
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        license_scan.labels(base=True).alias("base_labels"),
        license_scan.labels().alias("labels"),
        license_scan.score().alias("score"),
    )


def op13_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    found = token_alignment.align(table(spark, sf, "documents"), carry=["doc_id"], digest=True)
    return found.select("row.doc_id", *found.columns[1:]).withColumnRenamed("groups", "groups_sha256")


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_secrets": op3_secrets,
    "op4_mixing": op4_mixing,
    "op5_line_dedup": op5_line_dedup,
    "op6_near_dedup": op6_near_dedup,
    "op7_language_id": op7_language_id,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_warc": op9_warc,
    "op10_extraction": op10_extraction,
    "op11_vector_codes": op11_vector_codes,
    "op12_licenses": op12_licenses,
    "op13_token_alignment": op13_token_alignment,
}


def registered() -> dict[str, Query]:
    """The queries, each on a session with the settings that the operators rely on."""

    def prepared(query: Query) -> Query:
        return lambda spark, sf: query(ready(spark), sf)

    return {name: prepared(query) for name, query in QUERIES.items()}
