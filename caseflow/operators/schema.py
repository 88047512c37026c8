"""Unified fact schema, conforming, validation and integrity checks (K2-K4, Q23)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns, their order (sinks write positionally) and which of them may be null.
FACT_COLUMNS = [
    "report_period_start", "report_period_end", "date_type", "time_unit",
    "disease_name", "disease_slug", "disease_subtype", "disease_subtype_slug",
    "reporting_jurisdiction", "reporting_jurisdiction_slug", "state", "state_slug",
    "geo_name", "geo_name_slug", "geo_unit", "geo_unit_slug",
    "age_group", "age_group_slug", "confirmation_status", "outcome",
    "count", "data_source", "original_disease_name",
]

NULLABLE_COLUMNS = frozenset({
    "disease_subtype", "disease_subtype_slug", "age_group", "age_group_slug",
    "confirmation_status", "count",
})

REQUIRED_NON_NULL = [c for c in FACT_COLUMNS if c not in NULLABLE_COLUMNS]

_TYPES = {"report_period_start": T.TimestampNTZType(), "report_period_end": T.TimestampNTZType(),
          "count": T.LongType()}

FACT_SCHEMA = T.StructType([
    T.StructField(c, _TYPES.get(c, T.StringType()), True) for c in FACT_COLUMNS
])


def tag_source(df: DataFrame, name: str) -> DataFrame:
    """K2: add the literal ``data_source`` column."""
    return df.withColumn("data_source", F.lit(name))


def conform(df: DataFrame) -> DataFrame:
    """K3: keep the schema columns in schema order with schema types.

    Extra columns are dropped; an absent column becomes a typed null (the
    validator reports it as missing first).
    """
    present = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in FACT_SCHEMA.fields
    ])


def validate(df: DataFrame) -> DataFrame:
    """K4: one aggregate pass -> rows ``(check, column, n_bad)``; only failing checks are returned.

    Missing columns are known from the schema alone and come back as
    ``('missing_column', name, -1)`` rows without touching the data.
    """
    spark = df.sparkSession
    missing = [c for c in FACT_COLUMNS if c not in df.columns]
    present = [c for c in REQUIRED_NON_NULL if c in df.columns]
    rows = [("missing_column", c, -1) for c in sorted(missing)]
    missing_df = spark.createDataFrame(rows, "check string, column string, n_bad long")
    if not present:
        return missing_df
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in present])
    stacked = counts.select(F.explode(F.array(*[
        F.struct(F.lit("null_in_required").alias("check"), F.lit(c).alias("column"),
                 F.col(c).cast("long").alias("n_bad"))
        for c in present
    ])).alias("r")).select("r.*").where(F.col("n_bad") > 0)
    return missing_df.unionByName(stacked)


def assert_valid(df: DataFrame, source: str = "source") -> None:
    """Raise ``ValueError`` listing every failing check (one Spark job)."""
    bad = validate(df).collect()  # at most one row per schema column
    if bad:
        detail = ", ".join(f"{r['column']} {r['check']} in {r['n_bad']} rows" for r in bad)
        raise ValueError(f"{source} does not fit the fact schema: {detail}")


def integrity_report(facts: DataFrame) -> DataFrame:
    """Q23: data-integrity counts over the fact table, one row per check."""
    checks = {
        "null_required": F.greatest(*[F.col(c).isNull() for c in REQUIRED_NON_NULL]),
        "end_before_start": F.col("report_period_end") < F.col("report_period_start"),
        "negative_count": F.col("count") < 0,
        "uppercase_slug": F.greatest(*[
            F.col(c) != F.lower(F.col(c))
            for c in FACT_COLUMNS if c.endswith("_slug")
        ]),
        "slug_with_space": F.greatest(*[
            F.col(c).contains(" ") for c in FACT_COLUMNS if c.endswith("_slug")
        ]),
    }
    agg = facts.agg(*[F.count_if(F.coalesce(e, F.lit(False))).cast("long").alias(k) for k, e in checks.items()])
    return agg.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("check"), F.col(k).alias("n_bad")) for k in checks
    ])).alias("r")).select("r.*")
