"""Distinct counts per day, store, level and any combination, from membership patterns.

Each identifier is reduced to the set of base groups that contain it (its pattern), and
identical patterns are counted. A pattern's total is a number of identifiers, so the count of any
union, intersection or difference of groups is the sum of the totals of the patterns that satisfy
it: exact, the error bound is zero. Totals of disjoint identifier shards add up, so partial
results can be merged.

Defined results: rows with a null key or a null or zero timestamp count nowhere; rows with a null
store or level count with that null as a group of its own. Repeated rows change nothing. An empty
text is an identifier like any other. No rows give no counts. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL_LEVELS = -1
PARTS = ("day", "store_id", "level")


def memberships(records: DataFrame) -> DataFrame:
    """(key, day, store_id, level) once each; combined before the shuffle, so hot keys are small."""
    at = F.when(F.col("timestamp") != 0, F.col("timestamp"))
    # UTC whatever the session's time zone
    day = F.date_add(F.to_date(F.lit("1970-01-01")), F.floor(at / 86_400_000).cast("int")).cast("string")
    return records.select("key", day.alias("day"), "store_id", "level").where(F.col("key").isNotNull() & F.col("day").isNotNull()).distinct()


def patterns(members: DataFrame) -> DataFrame:
    """(pattern, n): each distinct set of base groups and the number of identifiers with it.

    A set has at most as many entries as there are base groups (days x stores x levels).
    """
    sets = members.groupBy("key").agg(F.sort_array(F.collect_set(F.struct(*PARTS))).alias("pattern"))
    return sets.groupBy("pattern").agg(F.count("*").alias("n"))


def merge(*totals: DataFrame) -> DataFrame:
    """Add up pattern totals of shards that share no identifier."""
    out = totals[0]
    for t in totals[1:]:
        out = out.unionByName(t)
    return out.groupBy("pattern").agg(F.sum("n").alias("n"))


def count_where(totals: DataFrame, condition: Column) -> DataFrame:
    """One row, ``n``: identifiers whose pattern meets a condition on the array ``pattern``.

    Any combination of groups can be asked, e.g. in one group and not in another:
    ``F.exists("pattern", a) & ~F.exists("pattern", b)``.
    """
    return totals.where(condition).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def count_by(totals: DataFrame, *groupings: tuple[str, ...]) -> DataFrame:
    """Distinct identifiers of every group of each grouping: day, store_id, level (null where not grouped), grouping, n.

    Within a pattern the groups of a grouping are made distinct, so an identifier counts once in each. They are
    compared as short texts, which a hash set tells apart in linear time; the groups of the full grouping
    are distinct already.
    """
    kinds = {"day": "string", "store_id": "int", "level": "int"}

    def groups_of(s: tuple[str, ...]) -> Column:
        def code(g: Column) -> Column:
            # a part that is null is no text at all, and parts hold no blank
            return F.concat_ws(" ", F.lit("+".join(s)), *(F.coalesce(g[p].cast("string"), F.lit("-")) if p in s else F.lit("*") for p in PARTS))

        codes = F.transform("pattern", code)
        return codes if set(s) == set(PARTS) else F.array_distinct(codes)

    each = totals.select("n", F.explode(F.concat(*map(groups_of, groupings))).alias("code"))
    part = F.split("code", " ")
    named = [F.when(~part[i].isin("-", "*"), part[i]).cast(kinds[p]).alias(p) for i, p in enumerate(PARTS, 1)]
    return each.groupBy("code").agg(F.sum("n").alias("n")).select(part[0].alias("grouping"), *named, "n")


def jumps(totals: DataFrame, ratio: float = 1.6, least: int = 8) -> DataFrame:
    """Groups (day, store, level) and (day, store, all levels) with at least ``ratio`` times the
    distinct identifiers of the calendar day before, which has at least ``least``. A group
    without a store or level is compared with no other."""
    counts = count_by(totals, ("day", "store_id"), PARTS)
    c = counts.select("day", "store_id", F.when(F.col("grouping") == "day+store_id", ALL_LEVELS).otherwise(F.col("level")).alias("level"), "n")
    before = c.select(F.date_format(F.date_add(F.to_date("day"), 1), "yyyy-MM-dd").alias("day"), "store_id", "level", F.col("n").alias("n_before"))
    both = c.join(before, ["day", "store_id", "level"])
    # a ratio with one decimal is compared in whole numbers
    tenth = round(ratio * 10)
    return both.where((F.col("n_before") >= least) & (F.col("n") * 10 >= F.col("n_before") * tenth)).select("day", "store_id", "level")
