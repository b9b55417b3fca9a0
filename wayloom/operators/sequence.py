"""Ordered-sequence analytics: windows over lists of waypoints, intervals and trapezoids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def path_length(points: DataFrame, keys: Sequence[str], order: Sequence[str], place: str, x: str = "x", y: str = "y") -> DataFrame:
    """Length of each list: steps between neighbours on the same map only."""
    w = _by(keys, order)
    dx, dy = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
    step = F.when(F.col(place) == F.lag(place).over(w), F.sqrt(dx * dx + dy * dy))
    return points.select(*keys, step.alias("step")).groupBy(*keys).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"))


def legs(points: DataFrame, keys: Sequence[str], order: Sequence[str], here: Column) -> DataFrame:
    """Rows that are, like the next row of their list, on the loaded map: the starts of its legs, with their index."""
    w = _by(keys, order)
    rows = points.withColumns({"leg": F.row_number().over(w) - 1, "__here": here})
    return rows.withColumn("__next", F.lead("__here").over(w)).where("__here and __next").drop("__here", "__next")


def runs(points: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Maximal runs of equal neighbours: ``run`` (from 0), value, number of rows, first order value."""
    w = _by(keys, order)
    new = (~F.lag(value).over(w).eqNullSafe(F.col(value))).cast("int")
    marked = points.withColumn("__new", F.when(F.row_number().over(w) == 1, 0).otherwise(new)).withColumn("run", F.sum("__new").over(w))
    return marked.groupBy(*keys, "run").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("start"))


def starts(rows: DataFrame, keys: Sequence[str], order: Sequence[str], count: str, name: str = "start") -> DataFrame:
    """Exclusive prefix sums: where each row's share of a flat list starts."""
    w = _by(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(count).over(w), F.lit(0)).cast("bigint"))


def positional(owners: DataFrame, items: DataFrame, keys: Sequence[str], order: Sequence[str], count: str, pos: str) -> DataFrame:
    """Each owner with the items of its slice; a place beyond the list gives an owner row without item."""
    wide = starts(owners, keys, order, count)
    dealt = wide.where(F.col(count) > 0).withColumn("k", F.explode(F.sequence(F.lit(0), F.col(count).cast("int") - 1)))
    return dealt.withColumn(pos, F.col("start") + F.col("k")).join(items, [*keys, pos], "left")


def slices(items: Column, lengths: Column) -> Column:
    """Consecutive slices of ``items`` of the given lengths, held to what there is."""
    to = F.transform(lengths, lambda n, i: F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0).cast("bigint"), lambda a, b: a + b))
    return F.zip_with(to, lengths, lambda s, n: F.slice(items, (s + 1).cast("int"), n.cast("int")))


def decumulated(rows: DataFrame, keys: Sequence[str], order: Sequence[str], cumulated: str, name: str = "p") -> DataFrame:
    return rows.withColumn(name, F.col(cumulated) - F.coalesce(F.lag(cumulated).over(_by(keys, order)), F.lit(0)))


def insert_after(points: DataFrame, new: DataFrame, keys: Sequence[str], pos: str, place: str) -> DataFrame:
    """Each new row goes after the last row of its map in its list, else to the end; places are counted again from 0."""
    last = points.groupBy(*keys, place).agg(F.max(pos).alias("last"))
    end = points.groupBy(*keys).agg(F.max(pos).alias("end"))
    at = new.join(last, [*keys, place], "left").join(end, list(keys), "left").withColumn("__at", F.coalesce("last", "end", F.lit(-1)) + 0.5).drop("last", "end")
    every = points.withColumn("__at", F.col(pos).cast("double")).unionByName(at.withColumn(pos, F.lit(None).cast("bigint")), allowMissingColumns=True)
    w = _by(keys, ["__at"])
    return every.withColumn(pos, F.row_number().over(w).cast("bigint") - 1).drop("__at")


def splice(points: DataFrame, bends: DataFrame, keys: Sequence[str], pos: str, part: str = "part") -> DataFrame:
    """Bends (by their leg's place and part) go between that place and the next; places are counted again from 0."""
    every = points.withColumn(part, F.lit(-1)).unionByName(bends, allowMissingColumns=True)
    return every.withColumn("__n", F.row_number().over(_by(keys, [pos, part]))).withColumn(pos, F.col("__n").cast("bigint") - 1).drop("__n", part)


def uncovered(ranges: DataFrame, covers: DataFrame, key: Sequence[str]) -> DataFrame:
    """The parts of each range ``lo..hi`` that no cover ``c0..c1`` of its key covers: ``a, b``.

    A degenerate range without covers is one point. One window: before a cover that starts after all ends so far lies a
    gap; after the last one lies the rest.
    """
    w = _by(key, ["c0", "c1"])
    met = ranges.join(covers, list(key), "left")
    reach = F.greatest(F.col("lo"), F.coalesce(F.max("c1").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("lo")))
    gaps = met.where("c0 is not null").withColumn("a", reach).where("c0 > a").select(*key, "a", F.least("c0", "hi").alias("b"))
    end = met.groupBy(*key).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.max("c1").alias("c1"))
    rest = end.withColumn("a", F.greatest("lo", F.coalesce("c1", "lo"))).where("a < hi or c1 is null").select(*key, "a", F.col("hi").alias("b"))
    return gaps.unionByName(rest)


def merged_ranges(ranges: DataFrame, key: Sequence[str], lo: str, hi: str) -> DataFrame:
    """Unions of ranges that touch or overlap."""
    w = _by(key, [lo, hi])
    marked = ranges.withColumn("__new", F.coalesce(F.col(lo) > F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int"))
    marked = marked.withColumn("__run", F.sum("__new").over(w))
    return marked.groupBy(*key, "__run").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("__run")


def contiguous(rows: DataFrame, keys: Sequence[str], order: Sequence[str], lo: str, hi: str, most: float = 0.01) -> DataFrame:
    """The rows of each key up to the first gap of more than ``most`` between one's end and the next one's start."""
    w = _by(keys, order)
    gap = F.coalesce(F.abs(F.col(lo) - F.lag(hi).over(w)) > most, F.lit(False)).cast("int")
    return rows.withColumn("__gap", gap).withColumn("__gaps", F.sum("__gap").over(w)).where("__gaps = 0").drop("__gap", "__gaps")


def pairs(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Each row with the next one of its list (``next_`` columns); the last has none and goes."""
    w = _by(keys, order)
    out = rows.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns} | {"__last": F.lead(F.lit(1)).over(w).isNull()})
    return out.where("not __last").drop("__last")


def drop_repeats(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows that differ in some column from the one before."""
    w = _by(keys, order)
    same = F.struct(*columns).eqNullSafe(F.lag(F.struct(*columns)).over(w))
    return rows.withColumn("__same", same & (F.row_number().over(w) > 1)).where("not __same").drop("__same")


def straightened(points: DataFrame, keys: Sequence[str], pos: str, tolerance: float = 1e-9) -> DataFrame:
    """Lists without inner points on the line between the last kept point and the next: an ordered fold over each list."""
    pts = points.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(pos, "x", "y"))).alias("p"))
    two = lambda a: F.size(a) >= 2

    def step(kept, q):
        a, b = F.element_at(kept, -2), F.element_at(kept, -1)
        turn = F.abs((b["x"] - a["x"]) * (q["y"] - a["y"]) - (b["y"] - a["y"]) * (q["x"] - a["x"]))
        return F.when(~two(kept), F.concat(kept, F.array(q))).when(turn <= tolerance, F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(q))).otherwise(F.concat(kept, F.array(q)))

    empty = F.slice(F.col("p"), 1, 0)
    return pts.withColumn("p", F.aggregate("p", empty, step)).select(*keys, F.posexplode("p").alias("n", "q")).select(*keys, F.col("n").cast("bigint").alias(pos), "q.x", "q.y")
