"""Keyed merges of repeated evidence, with conflicts kept in sight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRADES = ("low", "medium", "high")


def grade_rank(grade: Column) -> Column:
    """3 for high, 2 for medium, 1 for low, else 0; case and surrounding blanks don't matter."""
    plain = F.lower(F.trim(grade))
    return F.when(plain == "high", 3).when(plain == "medium", 2).when(plain == "low", 1).otherwise(0)


def same_number(a: Column, b: Column) -> Column:
    """Equal up to 1e-12 of the larger magnitude, at least of 1."""
    return F.abs(a - b) <= F.greatest(F.lit(1.0), F.abs(a), F.abs(b)) * 1e-12


def merged_events(events: DataFrame, key: str, numbers: list[str], texts: list[str], grade: str) -> DataFrame:
    """One row per key: rows n, each field's agreed value (null if it conflicts), the highest grade and the fields in conflict.

    Fields of null say nothing. Numbers agree within 1e-12 relative; texts agree if equal. Only minimum and maximum of a
    field are needed, so a key with any number of copies is merged map-side. Null keys are left out.
    """
    low_high = [x for c in [*numbers, *texts] for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]
    folded = events.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.max(grade_rank(F.col(grade))).alias("grade_rank"), *low_high)
    differ = {c: ~same_number(F.col(f"lo_{c}"), F.col(f"hi_{c}")) for c in numbers} | {c: F.col(f"lo_{c}") != F.col(f"hi_{c}") for c in texts}
    fields = [F.when(~differ[c], F.col(f"lo_{c}")).alias(c) for c in differ]
    conflicts = F.concat_ws(",", *(F.when(d, F.lit(c)) for c, d in differ.items()))
    return folded.select(key, "n", "grade_rank", *fields, conflicts.alias("conflicts"))


def without_conflicts(rows: DataFrame, key: str, evidence: list[str]) -> DataFrame:
    """Rows once per key, keys whose evidence differs dropped entirely; rows without key once per evidence."""
    counted = rows.where(F.col(key).isNotNull()).groupBy(key, *evidence).agg(F.count("*").alias("copies"))
    agreed = counted.groupBy(key).agg(F.count("*").alias("__kinds"), *(F.min(F.struct(*evidence)).alias("__e"),), F.sum("copies").alias("copies")).where("__kinds = 1")
    keyed = agreed.select(key, *(F.col("__e")[c].alias(c) for c in evidence), "copies")
    free = rows.where(F.col(key).isNull()).groupBy(*evidence).agg(F.count("*").alias("copies")).withColumn(key, F.lit(None).cast("string"))
    return keyed.unionByName(free)


def best_per_key(rows: DataFrame, keys: list[str], order: list[Column], carry: list[str]) -> DataFrame:
    """The first row of each key in the given order (ascending columns), as an aggregation: no group is sorted."""
    return rows.groupBy(*keys).agg(F.min(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.struct(*carry).alias("row"))).alias("__m")).select(*keys, *(F.col("__m")["row"][c].alias(c) for c in carry))


def reconciled(requested: DataFrame, answered: DataFrame, key: str) -> DataFrame:
    """(key, state, answers): matched, missing, foreign or duplicate, by full outer join of the counted sides."""
    r = requested.where(F.col(key).isNotNull()).select(key).distinct().withColumn("asked", F.lit(1))
    a = answered.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("answers"))
    both = r.join(a, key, "full_outer").fillna(0, ["answers"])
    state = F.when(F.col("asked").isNull(), "foreign").when(F.col("answers") == 0, "missing").when(F.col("answers") == 1, "matched").otherwise("duplicate")
    return both.select(key, state.alias("state"), "answers")


def sole_alias(links: DataFrame, name: str, asset: str) -> DataFrame:
    """(name, asset) for names that ever had exactly one asset."""
    agg = links.where(F.col(name).isNotNull() & F.col(asset).isNotNull()).groupBy(name).agg(F.min(asset).alias("__lo"), F.max(asset).alias("__hi"))
    return agg.where("__lo = __hi").select(name, F.col("__lo").alias(asset))


def tolerant_match(left: DataFrame, right: DataFrame, key: str, number: str) -> DataFrame:
    """Rows of ``left`` whose key and number (within 1e-12 of the larger magnitude, at least of 1) are in ``right``.

    A semi join on cells, then the exact test: below a magnitude of 1 a cell is 1e-12 wide, above it is 1e-6 of the
    logarithm; a number looks into its cell and both neighbours, and one near 1 into those of either kind.
    """
    one = 1 + 1e-9
    small = lambda n: F.when(F.abs(n) <= one, F.floor(F.col(n) / 1e-12))
    large = lambda n: F.when(F.abs(n) >= 1 / one, F.floor(F.ln(F.greatest(F.abs(n), F.lit(0.5))) * 1e6))
    cells = lambda n, steps: F.array_compact(F.array(*(F.when(c.isNotNull(), F.concat(F.lit(k), (c + d).cast("string"))) for k, c in (("s", small(n)), ("l", large(n))) for d in steps)))
    r = right.where(F.col(number).isNotNull()).select(F.col(key).alias("__k"), F.col(number).alias("__n")).distinct()
    r = r.withColumn("__c", F.explode(cells("__n", (-1, 0, 1))))
    l = left.where(F.col(number).isNotNull()).select(F.col(key), F.col(number)).distinct().withColumn("__c", F.explode(cells(number, (0,))))
    near = (F.col(key) == F.col("__k")) & (l["__c"] == r["__c"]) & same_number(F.col(number), F.col("__n"))
    found = l.join(r, near, "left_semi").select(key, number).distinct()
    return left.join(found, [key, number], "left_semi")


def upserted(held: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Changes merged into ``held`` by key: fields a change leaves null keep their value, new keys are added.

    ``changes`` must have each key once; both have the same columns.
    """
    rest = [c for c in held.columns if c not in keys]
    joined = held.alias("h").join(changes.alias("c"), keys, "full_outer")
    return joined.select(*keys, *(F.coalesce(F.col(f"c.{c}"), F.col(f"h.{c}")).alias(c) for c in rest))


def interleaved(first: DataFrame, second: DataFrame, column: str, order: str, n: int) -> DataFrame:
    """The two lists in turn, each value where it first comes, the first n: a top-n, so only n rows meet in one task."""

    def placed(df: DataFrame, side: int) -> DataFrame:
        top = df.groupBy(column).agg(F.min(order).alias(order)).orderBy(order, column).limit(n)
        return top.withColumn("place", F.row_number().over(Window.orderBy(order, column)) * 2 + side).select(column, "place")

    return placed(first, 0).unionByName(placed(second, 1)).groupBy(column).agg(F.min("place").alias("place")).orderBy("place").limit(n)




def first_by_source(rows: DataFrame, key: str, source: str, sources: list[str], order: str, fields: list[str]) -> DataFrame:
    """One row per key: for each source, and ``direct`` for any other or none, the first value of each field that isn't null; and the first of all.

    Columns are <source>_<field>, direct_<field> and <field>. ``order`` must be unique. One aggregation, no pivot of unknown width.
    """
    s = F.col(source)
    of = {name: s.eqNullSafe(F.lit(name)) for name in sources} | {"direct": ~F.coalesce(s.isin(sources), F.lit(False)), "": F.lit(True)}
    first = lambda f, here: F.min_by(f, F.when(here & F.col(f).isNotNull(), F.col(order)))
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(*(first(f, here).alias(f"{name}_{f}" if name else f) for name, here in of.items() for f in fields))
