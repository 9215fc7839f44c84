"""Joins and ranks that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(rows: DataFrame, stats: DataFrame, key: str, count: str, most: int = 10_000) -> DataFrame:
    """Inner join of ``rows`` with ``stats`` (one row a key) where a few keys hold very many of the rows.

    ``count`` is the column of ``stats`` that says how many rows of ``rows`` have
    the key. Keys with more than one in ``most`` of all rows are heavy: there are
    fewer than ``most`` of them whatever the size of the data, which bounds what
    is broadcast. Every other key has at most one in ``most`` of the rows, so that
    no task of the shuffled join gets a large part of them. Null keys don't join.
    """
    total = stats.agg(F.coalesce(F.sum(count), F.lit(0)).alias("t")).first()["t"]
    limit = total / most
    heavy = stats.where(F.col(count) > limit)
    light = stats.where(F.col(count) <= limit)
    marked = rows.join(F.broadcast(heavy), key, "left").withColumn("_h", F.col(count).isNotNull())
    columns = [*rows.columns, *[c for c in stats.columns if c != key]]
    out_heavy = marked.where("_h").select(*columns)
    out_light = marked.where(~F.col("_h") & F.col(key).isNotNull()).select(*rows.columns).join(light.hint("merge"), key).select(*columns)
    return out_heavy.unionByName(out_light)


def rank_in_group(rows: DataFrame, group: list[str], order: list[str], salts: int, name: str = "rank_in_group") -> DataFrame:
    """Number the rows of each group from 0, in parallel within a group.

    The rows of a group are dealt to ``salts`` parts by a hash of ``order``; each
    part is numbered by itself and starts where the parts before it end. The
    numbers are dense and a pure function of the rows, but don't follow ``order``
    across parts. With one salt it is a plain ``row_number``.
    """
    if salts <= 1:
        w = Window.partitionBy(*group).orderBy(*order)
        return rows.withColumn(name, F.row_number().over(w) - 1)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    sizes = salted.groupBy(*group, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    w = Window.partitionBy(*group, "_salt").orderBy(*order)
    local = salted.withColumn("_local", F.row_number().over(w) - 1)
    keys = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*group, "_salt"]]
    return local.alias("a").join(starts.alias("b"), keys).select("a.*", (F.col("b._start") + F.col("a._local")).alias(name)).drop("_salt", "_local")


def any_null(*columns: str) -> Column:
    out = F.col(columns[0]).isNull()
    for c in columns[1:]:
        out = out | F.col(c).isNull()
    return out


def _at_least(array: str, value: str) -> Column:
    """How many elements of the array are at least the value."""
    return F.size(F.filter(array, lambda c: c >= F.col(value)))


def split_ranks(rows: DataFrame, group: str, values: list[str], most: int = 200_000, splits: int = 512) -> DataFrame:
    """Add ``n`` (rows of the group) and, for each of ``values``, ``above_<value>`` and ``ties_<value>``: how many rows of the group have a greater value, and the same.

    Values are numbers without nulls. Groups of at most ``most`` rows are ranked
    by windows after one shuffle. Larger ones are cut into ranges of the value
    first, so that no task holds a whole group: ranks inside a range start at what
    the ranges above hold.
    """
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") > most).select(group, "n")
    small = rows
    hot = None
    if not large.isEmpty():
        hot = rows.join(large, group)
        small = rows.join(large.select(group), group, "left_anti")
    whole = Window.partitionBy(group)
    out = small.withColumn("n", F.count(F.lit(1)).over(whole))
    for v in values:
        out = out.withColumn(f"above_{v}", F.rank().over(whole.orderBy(F.desc(v))) - 1).withColumn(f"ties_{v}", F.count(F.lit(1)).over(Window.partitionBy(group, v)))
    if hot is None:
        return out
    at = [k / splits for k in range(1, splits)]
    for v in values:
        cuts = hot.groupBy(group).agg(F.percentile_approx(v, F.array(*map(F.lit, at)), F.lit(20 * splits)).alias("_cuts"))
        counted = hot.groupBy(group, v).agg(F.count(F.lit(1)).alias("_ties")).join(cuts, group)
        counted = counted.withColumn("_range", _at_least("_cuts", v)).drop("_cuts")
        ranges = counted.groupBy(group, "_range").agg(F.sum("_ties").alias("_in"))
        before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        ranges = ranges.select(group, "_range", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_base"))
        inside = Window.partitionBy(group, "_range").orderBy(F.desc(v)).rowsBetween(Window.unboundedPreceding, -1)
        ranked = counted.withColumn("_inside", F.coalesce(F.sum("_ties").over(inside), F.lit(0))).join(ranges, [group, "_range"])
        ranked = ranked.select(group, v, (F.col("_base") + F.col("_inside")).alias(f"above_{v}"), F.col("_ties").alias(f"ties_{v}"))
        hot = hot.join(ranked, [group, v])
    return out.unionByName(hot.select(*out.columns))


def running(rows: DataFrame, group: list[str], order: list[str], sums: dict[str, str], most: int = 1_000_000, parts: int = 256) -> DataFrame:
    """Add ``rn`` (from 1 on), ``n`` and running sums (new name: column) in the given order, without a task that holds a whole large group.

    ``order`` must be a total order of the rows of a group. Up to ``most`` rows in
    all, plain windows do. Beyond, rows are dealt to ranges of (group, order), each
    range is summed by itself and starts with what the ranges before it hold.
    """
    whole = Window.partitionBy(*group)
    if rows.count() <= most:
        upto = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        out = rows.withColumn("rn", F.row_number().over(whole.orderBy(*order))).withColumn("n", F.count(F.lit(1)).over(whole))
        for name, c in sums.items():
            out = out.withColumn(name, F.sum(c).over(upto))
        return out
    from quillspan.session import materialize

    ranged = materialize(rows.repartitionByRange(parts, *group, *order).withColumn("_r", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy(*group, "_r").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_t_{name}") for name, c in sums.items()])
    before = whole.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*group, "_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rn"), F.sum("_n").over(whole).alias("n"), *[F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_b_{name}") for name in sums])
    inside = Window.partitionBy(*group, "_r").orderBy(*order)
    out = ranged.withColumn("_i", F.row_number().over(inside))
    for name, c in sums.items():
        out = out.withColumn(f"_s_{name}", F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.join(starts, [*group, "_r"])
    return out.select(*rows.columns, (F.col("_rn") + F.col("_i")).cast("int").alias("rn"), "n", *[(F.col(f"_b_{name}") + F.col(f"_s_{name}")).alias(name) for name in sums])
