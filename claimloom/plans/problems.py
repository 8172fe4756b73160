"""Queries of the general data-preparation operators (problems 1 and 2) over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimloom.operators.timestamps import normalize_fields
from claimloom.operators.units import read_quantities
from claimloom.session import spread, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every victims row and field that states a real calendar day or moment, in one form."""
    return normalize_fields(spread(table(spark, sf_dir, "victims").select("id", "source_id", "reported_date", "first_seen_at")), table(spark, sf_dir, "source_conventions"), ("reported_date", "first_seen_at"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every quantity that a victims row states, in bytes, files or seconds."""
    return read_quantities(spread(table(spark, sf_dir, "victims").select("id", "source_id", "claim_details")), table(spark, sf_dir, "source_conventions"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found}
ORACLES: dict[str, str] = {}
