"""Sequence operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayloom.operators import sequence as S
from wayloom.registry import query

ORDER = ["ts", "event_id"]


def _points(table):
    """Waypoints: a user's events in order; the map is the event's type, x and y are whole numbers."""
    e = table("events")
    return e.select("user_id", "ts", "event_id", F.col("event_type").alias("mapid"), F.floor("value").cast("double").alias("x"), (F.col("event_id") % 97).cast("double").alias("y"))


P = "p AS (SELECT user_id, ts, event_id, event_type AS mapid, floor(value) AS x, CAST(event_id % 97 AS DOUBLE) AS y FROM events)"
W = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"


@query("path_length", f"WITH {P}, s AS (SELECT user_id, CASE WHEN mapid = lag(mapid) {W} THEN sqrt((x - lag(x) {W}) * (x - lag(x) {W}) + (y - lag(y) {W}) * (y - lag(y) {W})) END AS step FROM p) SELECT user_id, round(coalesce(sum(step), 0), 4) AS length FROM s GROUP BY user_id")
def path_length(table):
    return S.path_length(_points(table), ["user_id"], ORDER, "mapid").withColumn("length", F.round("length", 4))


@query("legs", f"WITH {P}, s AS (SELECT user_id, event_id, CAST(row_number() {W} - 1 AS INT) AS leg, mapid = 'click' AS here, lead(mapid = 'click') {W} AS nxt FROM p) SELECT user_id, event_id, leg FROM s WHERE here AND nxt")
def legs(table):
    return S.legs(_points(table), ["user_id"], ORDER, F.col("mapid") == "click").select("user_id", "event_id", "leg")


@query("runs_by_map", f"WITH {P}, a AS (SELECT *, CASE WHEN row_number() {W} = 1 THEN 0 ELSE CAST(mapid IS DISTINCT FROM lag(mapid) {W} AS INT) END AS new FROM p), b AS (SELECT *, sum(new) {W} AS run FROM a) SELECT user_id, CAST(run AS BIGINT) AS run, first(mapid) AS mapid, count(*) AS n, arg_min(event_id, (ts, event_id)) AS first_event FROM b GROUP BY user_id, run")
def runs_by_map(table):
    return S.runs(_points(table), ["user_id"], ORDER, "mapid").select("user_id", "run", "mapid", "n", F.col("start.event_id").alias("first_event"))


LINES = "c AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, count(*) AS n FROM lineitem GROUP BY 1, 2)"


def _lines(table):
    return table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.count(F.lit(1)).alias("n"))


@query("prefix_starts", f"WITH {LINES} SELECT l_orderkey, l_linenumber, n, CAST(coalesce(sum(n) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM c")
def prefix_starts(table):
    return S.starts(_lines(table).drop("part"), ["l_orderkey"], ["l_linenumber"], "n")


@query("positional_join", f"WITH {LINES}, o AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM c), d AS (SELECT *, unnest(range(n)) AS k FROM o), i AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY part) - 1 AS pos, part AS item FROM c) SELECT d.l_orderkey, d.l_linenumber, d.start + d.k AS pos, i.item FROM d LEFT JOIN i ON i.l_orderkey = d.l_orderkey AND i.pos = d.start + d.k")
def positional_join(table):
    from pyspark.sql import Window

    lines = _lines(table)
    items = lines.select("l_orderkey", (F.row_number().over(Window.partitionBy("l_orderkey").orderBy("part")) - 1).cast("bigint").alias("pos"), F.col("part").alias("item"))
    return S.positional(lines.drop("part"), items, ["l_orderkey"], ["l_linenumber"], "n", "pos").select("l_orderkey", "l_linenumber", "pos", "item")


@query("decumulate", "WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice ROWS UNBOUNDED PRECEDING) AS cum FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, cum, cum - coalesce(lag(cum) OVER (PARTITION BY l_orderkey ORDER BY cum), 0) AS p FROM c")
def decumulate(table):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    rows = table("lineitem").withColumn("cum", F.sum("l_quantity").over(w)).select("l_orderkey", "l_linenumber", "l_partkey", "cum")
    return S.decumulated(rows, ["l_orderkey"], ["cum"], "cum")


COVERS = "r AS (SELECT o_orderkey AS k, 0.0::DOUBLE AS lo, 200.0::DOUBLE AS hi FROM orders), c AS (SELECT l_orderkey AS k, CAST(l_partkey % 150 AS DOUBLE) AS c0, CAST(l_partkey % 150 AS DOUBLE) + l_quantity AS c1 FROM lineitem)"


@query(
    "interval_gaps",
    f"""WITH {COVERS}, m AS (SELECT r.k, lo, hi, c0, c1, greatest(lo, coalesce(max(c1) OVER (PARTITION BY r.k ORDER BY c0, c1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo)) AS a FROM r LEFT JOIN c ON c.k = r.k)
SELECT k, a, least(c0, hi) AS b FROM m WHERE c0 > a UNION ALL SELECT k, greatest(lo, coalesce(max(c1), lo)), hi FROM m GROUP BY k, lo, hi HAVING greatest(lo, coalesce(max(c1), lo)) < hi OR max(c1) IS NULL""",
)
def interval_gaps(table):
    ranges = table("orders").select(F.col("o_orderkey").alias("k"), F.lit(0.0).alias("lo"), F.lit(200.0).alias("hi"))
    start = (F.col("l_partkey") % 150).cast("double")
    covers = table("lineitem").select(F.col("l_orderkey").alias("k"), start.alias("c0"), (start + F.col("l_quantity")).alias("c1"))
    return S.uncovered(ranges, covers, ["k"])


@query("merged_ranges", f"WITH {COVERS}, m AS (SELECT *, CASE WHEN c0 <= max(c1) OVER (PARTITION BY k ORDER BY c0, c1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM c), g AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY c0, c1) AS run FROM m) SELECT k, min(c0) AS c0, max(c1) AS c1 FROM g GROUP BY k, run")
def merged_ranges(table):
    start = (F.col("l_partkey") % 150).cast("double")
    return S.merged_ranges(table("lineitem").select(F.col("l_orderkey").alias("k"), start.alias("c0"), (start + F.col("l_quantity")).alias("c1")), ["k"], "c0", "c1")


@query("contiguous_run", "WITH t AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS DOUBLE) AS lo, l_quantity + CASE WHEN l_partkey % 5 = 0 THEN 3 ELSE 0 END AS hi, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity, l_orderkey, l_linenumber, l_partkey) AS pos FROM lineitem), g AS (SELECT *, CASE WHEN abs(lo - lag(hi) OVER (PARTITION BY l_suppkey ORDER BY pos)) > 0.01 THEN 1 ELSE 0 END AS gap FROM t), s AS (SELECT *, sum(gap) OVER (PARTITION BY l_suppkey ORDER BY pos ROWS UNBOUNDED PRECEDING) AS gaps FROM g) SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, lo, hi FROM s WHERE gaps = 0")
def contiguous_run(table):
    rows = table("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("lo"), (F.col("l_quantity") + F.when(F.col("l_partkey") % 5 == 0, 3).otherwise(0)).alias("hi"))
    return S.contiguous(rows, ["l_suppkey"], ["lo", "l_orderkey", "l_linenumber", "l_partkey"], "lo", "hi")


@query("drop_repeats", f"WITH {P}, s AS (SELECT *, lag(mapid) {W} AS before, row_number() {W} AS r FROM p) SELECT user_id, event_id, mapid FROM s WHERE r = 1 OR mapid IS DISTINCT FROM before")
def drop_repeats(table):
    return S.drop_repeats(_points(table), ["user_id"], ORDER, ["mapid"]).select("user_id", "event_id", "mapid")


@query("edge_pairs", f"WITH {P}, s AS (SELECT user_id, event_id, x, y, lead(event_id) {W} AS next_event_id, lead(x) {W} AS next_x FROM p) SELECT user_id, event_id, x, next_event_id, next_x FROM s WHERE next_event_id IS NOT NULL")
def edge_pairs(table):
    return S.pairs(_points(table), ["user_id"], ORDER, ["event_id", "x"]).select("user_id", "event_id", "x", "next_event_id", "next_x")


@query("insert_after", f"WITH {P}, a AS (SELECT user_id, row_number() {W} - 1 AS pos, mapid, event_id FROM p), n AS (SELECT DISTINCT user_id, 'click' AS mapid, CAST(-1 AS BIGINT) AS event_id FROM p), w AS (SELECT user_id, CAST(pos AS DOUBLE) AS spot, mapid, event_id FROM a UNION ALL SELECT n.user_id, coalesce((SELECT max(pos) FROM a WHERE a.user_id = n.user_id AND a.mapid = n.mapid), (SELECT max(pos) FROM a WHERE a.user_id = n.user_id)) + 0.5, mapid, event_id FROM n) SELECT user_id, mapid, event_id, row_number() OVER (PARTITION BY user_id ORDER BY spot) - 1 AS pos FROM w")
def insert_after(table):
    from pyspark.sql import Window

    rows = _points(table).select("user_id", "mapid", "event_id", (F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER)).cast("bigint") - 1).alias("pos"))
    new = rows.select("user_id").distinct().withColumns({"mapid": F.lit("click"), "event_id": F.lit(-1).cast("bigint")})
    return S.insert_after(rows, new, ["user_id"], "pos", "mapid")


@query(
    "folder_summary",
    """WITH u AS (SELECT page_id, replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/', '\\') AS path FROM pages), f AS (SELECT page_id, split_part(path, '\\', 1) AS host, regexp_replace(path, '\\\\[^\\\\]*$', '') AS folder FROM u),
g AS (SELECT host, folder, count(*) AS n, min(page_id) AS first FROM f GROUP BY 1, 2), b AS (SELECT host, arg_max(folder, (n, -first)) AS top, count(*) - 1 AS others FROM g GROUP BY host)
SELECT host, CASE WHEN others > 0 THEN top || ' +' || others ELSE top END AS summary FROM b""",
)
def folder_summary(table):
    from wayloom.operators.zones import folder_summary as summary

    path = F.translate(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), r"[?#].*$", ""), "/", "\\")
    pages = table("pages").select("page_id", path.alias("path")).withColumn("host", F.substring_index("path", "\\", 1))
    return summary(pages, ["host"], "path", "page_id")
