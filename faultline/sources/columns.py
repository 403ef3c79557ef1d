"""Open-schema helpers: missing columns become typed nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.signals import SIGNAL_INPUTS

# Everything the scoring path reads; an incoming record may carry any subset.
SCORING_COLUMNS = {
    "report_id": "string", "heading": "string", "answer": "string", "priority": "string",
    "superior_unit": "string", "fault_type": "string", **SIGNAL_INPUTS,
}


def ensure_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    have = set(df.columns)
    missing = {name: F.lit(None).cast(kind) for name, kind in columns.items() if name not in have}
    return df.withColumns(missing) if missing else df


def report_record(spark: SparkSession, heading: str = "", observation: str = "", priority: str = "",
                  metadata: dict | None = None) -> DataFrame:
    """A one-row scoring frame for an ad-hoc report; the answer is blank and metadata overrides."""
    row = {"heading": heading, "observation": observation, "priority": priority, "answer": "", **(metadata or {})}
    known = {k: SCORING_COLUMNS.get(k, "string") for k in row}
    schema = ", ".join(f"`{k}` {t}" for k, t in known.items())
    return ensure_columns(spark.createDataFrame([tuple(row.values())], schema), SCORING_COLUMNS)
