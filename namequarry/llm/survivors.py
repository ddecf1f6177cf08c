"""The best representative of each group of duplicates, built field by field through skylines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRADES = {"high": 3, "medium": 2, "low": 1}  # trust; anything else is 0
FIELDS = ("confidence", "eventAt", "identityKind", "provenance")


def trust(confidence: Column) -> Column:
    plain = F.lower(F.regexp_replace(confidence, r"[\s ]+", ""))
    out = F.lit(0)
    for grade, rank in GRADES.items():
        out = F.when(plain == grade, rank).otherwise(out)
    return out


def filled(record: Column, fields: list[str]) -> Column:
    """How many fields of a struct are neither null nor blank; 0 for a null struct."""
    one = [F.when(F.regexp_replace(record[f].cast("string"), r"[\s ]+", "") != "", 1).otherwise(0) for f in fields]
    return F.coalesce(sum(one[1:], one[0]), F.lit(0))


def _usable() -> dict[str, Column]:
    """For each field whether a row can give it: a grade; a time that has an instant; not null or blank; not null."""
    return {
        "confidence": F.col("trust") > 0,
        "eventAt": F.col("event_ms").isNotNull(),
        "identityKind": F.coalesce(F.regexp_replace("identityKind", r"[\s\u00a0]+", "") != "", F.lit(False)),
        "provenance": F.col("provenance").isNotNull(),
    }


def survivors(rows: DataFrame, provenance_fields: list[str]) -> DataFrame:
    """For each id with two or more rows: event_id, and per field the row_id of the row it is taken from.

    rows: row_id, event_id (already normalised; null is no id), confidence, identityKind, provenance, eventAt,
    event_ms, observed_ms. A row is a point in trust, completeness of provenance and recency (observed_ms, none last).
    For a field, let S be the rows of the group that can fill it. Its skyline is the part of S that no other row of S
    dominates, and the policy takes the skyline's first by (trust, completeness, recency, smaller row_id). That is the
    maximum of S itself: were the lexicographic maximum m of S dominated by d, d would be at least as good in all
    three and better in one, so d would come before m. So no layer need be built, and a maximum has partial sums: one row of
    four small structs for each id and task is shuffled, however large a group, and no value is. (Layers of whole rows, filled
    one after the other, give another result: a row with higher trust that another row dominates lies in a later layer
    than a row with lower trust, but has to be preferred to it.) Fields that no row fills are null.
    """
    point = ("trust", "complete", "recent", "first")
    graded = rows.where(F.col("event_id").isNotNull()).withColumn("trust", trust(F.col("confidence")))
    graded = graded.select("event_id", "trust", filled(F.col("provenance"), provenance_fields).alias("complete"), F.coalesce("observed_ms", F.lit(-(2**62))).alias("recent"), (-F.col("row_id")).alias("first"), *(u.alias(f"can_{f}") for f, u in _usable().items()))
    tops = [F.max(F.when(F.col(f"can_{f}"), F.struct(*point))).alias(f) for f in FIELDS]
    groups = graded.groupBy("event_id").agg(F.count("*").alias("n"), *tops).where("n > 1")
    return groups.select("event_id", *((-F.col(f)["first"]).alias(f) for f in FIELDS))


def survivor_rows(groups: DataFrame) -> DataFrame:
    """(event_id, field_name, row_id): where each field of a survivor comes from; fields no row fills are left out."""
    found = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("row_id")) for f in FIELDS))
    return groups.select("event_id", F.inline(found)).where("row_id is not null")


def survivor_values(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """(event_id, and the value of each field): the surviving records. ``rows`` holds row_id and the fields; only rows that give a field are joined."""
    wanted = survivor_rows(groups).groupBy("row_id").agg(F.first("event_id").alias("event_id"), F.collect_list("field_name").alias("gives"))  # four names at most
    given = rows.select("row_id", *FIELDS).join(wanted, "row_id")
    parts = given.groupBy("event_id").agg(*(F.max_by(f, F.when(F.array_contains("gives", f), 1)).alias(f) for f in FIELDS))
    return groups.select("event_id").join(parts, "event_id", "left")
