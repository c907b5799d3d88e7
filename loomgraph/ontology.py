"""The closed vocabulary of entities and relationships."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Entity types with their declared properties, and relationship types.
ENTITY_TYPES: dict[str, list[str]] = {
    "Company": ["name", "ticker", "sector", "country", "exchange", "fiscal_year_end"],
    "Segment": ["name", "description", "status", "start_date", "end_date"],
    "Metric": ["name", "unit", "category"],
    "MetricValue": ["amount", "currency", "unit"],
    "Period": ["name", "start_date", "end_date", "fiscal_year", "quarter"],
    "Risk": ["name", "category", "severity", "description"],
    "Policy": ["name", "description", "effective_date"],
    "Person": ["name", "role", "title"],
    "Geography": ["name", "region", "country"],
    "Product": ["name", "category", "description"],
    "Event": ["name", "date", "type", "impact"],
    "LegalEntity": ["name", "jurisdiction", "type"],
}
RELATIONSHIP_TYPES: list[str] = [
    "HAS_SEGMENT",
    "REPORTS",
    "HAS_VALUE",
    "IN_PERIOD",
    "COMPARED_TO",
    "INCREASED_BY",
    "DECREASED_BY",
    "RELATED_TO",
    "IMPACTS",
    "MITIGATES",
    "OPERATES_IN",
    "EMPLOYED_BY",
    "OVERSEES",
    "HAS_RISK",
    "HAS_POLICY",
    "SUBSIDIARY_OF",
    "DISCLOSED_IN",
    "MERGED_INTO",
    "DIVESTED",
    "ACQUIRED",
    "SUCCEEDED_BY",
    "COMPONENT_OF",
    "ROLL_UP_TO",
]


def valid(rows: DataFrame, kind: str = "entity", column: str = "type") -> DataFrame:
    """Rows whose type belongs to the vocabulary; a missing type does not."""
    return rows.filter(F.col(column).isin(list(ENTITY_TYPES) if kind == "entity" else RELATIONSHIP_TYPES))


def invalid(rows: DataFrame, kind: str = "entity", column: str = "type") -> DataFrame:
    """Rows whose type is missing or unknown, for the log of skipped ones."""
    return rows.filter(F.coalesce(~F.col(column).isin(list(ENTITY_TYPES) if kind == "entity" else RELATIONSHIP_TYPES), F.lit(True)))


def table(spark: SparkSession) -> DataFrame:
    """(entity_type, property), one row for each declared property."""
    return spark.createDataFrame([(t, p) for t, ps in ENTITY_TYPES.items() for p in ps], "entity_type string, property string")
