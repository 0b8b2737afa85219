"""Model-response tables: parsing with error codes, validation, and the first valid attempt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INNER = "struct<spec:string,changelog:string,commitMessage:string>"
ENVELOPE = f"struct<is_error:boolean,result:string,structured_output:{INNER},total_cost_usd:double,cost_usd:double,session_id:string>"


def parse_responses(raw: DataFrame) -> DataFrame:
    """Adds spec, changelog, commit_message, cost, session_id and error (bad-json, is-error, missing, bad-inner)."""
    kept = raw.columns
    v = raw.withColumn("v", F.try_parse_json("raw")).withColumn("e", F.from_json("raw", ENVELOPE))
    is_text = F.schema_of_variant(F.try_variant_get("v", "$.result", "variant")) == "STRING"
    structured = F.col("e.structured_output").isNotNull()
    inner = F.when(structured, F.col("e.structured_output")).otherwise(F.from_json("e.result", INNER))
    v = v.withColumn("inner", inner).withColumn("inner_ok", structured | F.try_parse_json("e.result").isNotNull())
    error = F.when(F.col("v").isNull(), "bad-json").when(F.col("e.is_error"), "is-error").when(~structured & ~F.coalesce(is_text, F.lit(False)), "missing").when(~F.col("inner_ok"), "bad-inner")
    v = v.withColumn("error", error)
    value = lambda c: F.when(F.col("error").isNull(), F.col(c))
    return v.select(*kept, value("inner.spec").alias("spec"), value("inner.changelog").alias("changelog"), value("inner.commitMessage").alias("commit_message"), F.when(F.col("error").isNull(), F.coalesce("e.total_cost_usd", "e.cost_usd", F.lit(0.0))).alias("cost"), value("e.session_id").alias("session_id"), "error")


def validate_responses(parsed: DataFrame) -> DataFrame:
    """Adds errors: every required field that is missing or empty."""
    empty = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"{c} must not be empty"))
    return parsed.withColumn("errors", F.array_compact(F.array(empty("spec"), empty("changelog"), empty("commit_message"))))


def first_valid_attempt(validated: DataFrame, keys: list[str], max_retries: int) -> DataFrame:
    """(keys, attempt, ok, last_error): the first success among max_retries + 1 attempts, else the last error."""
    code = F.coalesce("error", F.when(F.size("errors") > 0, F.array_join("errors", "; ")))
    rows = validated.withColumn("code", code).where(F.col("attempt") <= max_retries)
    good = F.when(F.col("code").isNull(), F.col("attempt"))
    out = rows.groupBy(*keys).agg(F.min(good).alias("first"), F.max("attempt").alias("last"), F.max_by("code", "attempt").alias("code"))
    return out.select(*keys, F.coalesce("first", "last").alias("attempt"), F.col("first").isNotNull().alias("ok"), F.when(F.col("first").isNull(), F.col("code")).alias("last_error"))
