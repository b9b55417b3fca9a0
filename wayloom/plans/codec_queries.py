"""Sources and codecs over bytes made of the driver's tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from wayloom.functions import geometry as G
from wayloom.functions import text as T
from wayloom.registry import query

MARK = "{ x = %.5f, y = %.5f, plane = %d, mapid = %d },"


@query("waypoint_format", "SELECT user_id, string_agg(format('{{ x = {:.5f}, y = {:.5f}, plane = {}, mapid = {} }},', value, CAST(event_id AS DOUBLE) / 4, event_id % 3, user_id), chr(10) ORDER BY ts, event_id) AS text FROM events GROUP BY user_id")
def waypoint_format(table):
    e = table("events").select("user_id", F.struct("ts", "event_id", T.waypoint_text(F.col("value"), F.col("event_id") / 4, F.col("event_id") % 3, F.col("user_id")).alias("line")).alias("w"))
    return e.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("w")), lambda w: w["line"]), "\n").alias("text"))


@query("waypoint_parse", "SELECT user_id, event_id, CAST(round(value * 4) / 4 AS DOUBLE) AS x, CAST(event_id AS DOUBLE) / 4 AS y, event_id % 3 AS plane, CASE WHEN event_type = 'error' THEN NULL ELSE user_id END AS mapid, CASE WHEN event_type = 'error' THEN 'waypoint 1: bad mapid' END AS error FROM events")
def waypoint_parse(table):
    x, y, plane, m = F.round(F.col("value") * 4) / 4, F.col("event_id") / 4, F.col("event_id") % 3, F.col("user_id")
    ok, bad = T.waypoint_text(x, y, plane, m), F.format_string("{ y = %.5f, note = 1, x = %.5f, plane = %d, mapid = none },", y, x, plane)
    rows = table("events").select("user_id", "event_id", F.explode(T.parse_waypoints(F.when(F.col("event_type") == "error", bad).otherwise(ok))).alias("w"))
    return rows.select("user_id", "event_id", "w.x", "w.y", "w.plane", "w.mapid", "w.error")


@query("json_roundtrip", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'none' AS missing FROM events")
def json_roundtrip(table):
    """Documents read with defaults for what they lack, written and read again."""
    shape = "k bigint, missing string"
    once = table("events").select("event_id", F.from_json("props", shape).alias("j")).select("event_id", F.to_json(F.struct(F.col("j.k").alias("k"), F.coalesce("j.missing", F.lit("none")).alias("missing"))).alias("text"))
    return once.select("event_id", F.from_json("text", shape).alias("j")).select("event_id", "j.k", "j.missing")


@query("request_routes", "SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN page_id END AS id, CASE WHEN page_id % 3 <> 0 THEN page_id % 2 = 0 END AS refresh FROM pages")
def request_routes(table):
    k = F.col("page_id")
    url = F.when(k % 3 != 0, T.request_url("pathing", k, k % 2 == 0)).otherwise(F.concat(F.lit("/api/maps/"), k.cast("string")))
    return table("pages").select("page_id", T.request(url, "pathing").alias("r")).select("page_id", "r.id", "r.refresh")


@query("node_refs", "SELECT l_orderkey, l_linenumber, l_partkey, CAST((l_partkey * 1073741 % 4294967296) >> 30 AS INT) AS kind, (l_partkey * 1073741 % 4294967296) & 1073741823 AS idx, (l_partkey % 65536 - 16711935) + (l_suppkey % 65536) * 65280 AS base_id FROM lineitem")
def node_refs(table):
    raw = F.col("l_partkey") * 1073741 % 4294967296
    return table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", G.node_ref(raw).alias("n"), G.file_ref(F.col("l_partkey") % 65536, F.col("l_suppkey") % 65536).alias("base_id")).select("l_orderkey", "l_linenumber", "l_partkey", "n.kind", "n.idx", "base_id")


@query("random_sequence", "WITH RECURSIVE r AS (SELECT n_nationkey AS k, CAST(n_nationkey + 1 AS BIGINT) AS v, 0 AS i FROM nation UNION ALL SELECT k, (v * 48271) % 2147483647, i + 1 FROM r WHERE i < 8) SELECT k, i, v FROM r WHERE i > 0")
def random_sequence(table):
    first = F.array((F.col("n_nationkey") + 1).cast("bigint"))
    chain = F.aggregate(F.sequence(F.lit(1), F.lit(8)), first, lambda a, _: F.concat(a, F.array(G.park_miller(F.element_at(a, -1)))))
    return table("nation").select(F.col("n_nationkey").alias("k"), F.posexplode(chain).alias("i", "v")).where("i > 0")


@query("crc32_text")
def crc32_text(table):
    return table("documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"))


@query("chunk_scan", "SELECT doc_id, 0::BIGINT AS ord, 268435464::BIGINT AS chunk_id, 'Path' AS kind, octet_length(encode(text)) AS length FROM documents UNION ALL SELECT doc_id, 1::BIGINT, 553648132::BIGINT, 'Props refs', octet_length(encode(lang)) FROM documents")
def chunk_scan(table):
    """Containers written from chunk rows, scanned again and listed."""
    from wayloom.functions.mapfile import container
    from wayloom.sources import files as S

    docs = table("documents").select("doc_id", "text", "lang")

    def pack(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "content": [container(3, [(0x10000008, a.encode()), (0x21000004, b.encode())]) for a, b in zip(pdf["text"], pdf["lang"], strict=True)]})

    rows = S.chunks(docs.mapInPandas(pack, "doc_id bigint, content binary"), ["doc_id"])
    return S.chunk_list(rows).select("doc_id", "ord", "chunk_id", "kind", F.col("length").cast("bigint").alias("length"))


@query("lz_decode", "SELECT doc_id, sha256(text) AS sha, sha256(text || '!') AS sha_new FROM documents")
def lz_decode(table):
    """Texts packed by the block codec, whole and as changes to an older version, and unpacked."""
    from wayloom.functions import lz

    def run(batches):
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                old, new = text.encode(), (text + "!").encode()
                a, b = lz.compress(old), lz.compress(new, old)
                out.append((lz.decompress(a, len(old)) if len(a) < len(old) else old, lz.decompress(b, len(new), old) if len(b) < len(new) else new))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "old": [o[0] for o in out], "new": [o[1] for o in out]})

    got = table("documents").select("doc_id", "text").mapInPandas(run, "doc_id bigint, old binary, new binary")
    return got.select("doc_id", F.sha2("old", 256).alias("sha"), F.sha2("new", 256).alias("sha_new"))


@query("huffman_decode", "SELECT doc_id, sha256(text) AS sha FROM documents")
def huffman_decode(table):
    from collections import Counter

    from wayloom.functions.binary import BitBuilder, Bits, PrefixCode

    def run(batches):
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                data, bits = text.encode(), BitBuilder()
                if not data:
                    out.append(b"")
                    continue
                code = PrefixCode.fit(dict(Counter(data)), 15)
                code.write(bits, 256)
                for b in data:
                    code.encode(bits, b)
                stream = Bits(bits.bytes())
                table_ = PrefixCode.read(stream, 256, 15)
                out.append(bytes(table_.decode(stream) for _ in data))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "data": out})

    return table("documents").select("doc_id", "text").mapInPandas(run, "doc_id bigint, data binary").select("doc_id", F.sha2("data", 256).alias("sha"))


@query("obstacle_codec", "SELECT s_suppkey AS id, CAST(s_suppkey * 613 % 250 AS DOUBLE) AS x, CAST(s_suppkey * 271 % 200 AS DOUBLE) AS y, CAST(s_suppkey % 5 AS DOUBLE) AS radius FROM supplier")
def obstacle_codec(table):
    """One grid per supplier: written, read, and its obstacle told."""
    from wayloom.functions.mapfile import obstacles, write_obstacles

    k = F.col("s_suppkey")
    rows = table("supplier").select(k.alias("id"), ((k * 613) % 250).cast("double").alias("x"), ((k * 271) % 200).cast("double").alias("y"), (k % 5).cast("double").alias("radius"))

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                wide, high, cells = obstacles(write_obstacles(3, 2, {(1, 2): [(r.x, r.y, r.radius)]}))
                assert (wide, high) == (3, 2)
                out.append((r.id, *cells[5][0]))
            yield pd.DataFrame(out, columns=["id", "x", "y", "radius"])

    return rows.mapInPandas(run, "id bigint, x double, y double, radius double")


@query("sqlite_scan", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3)")
def sqlite_scan(table):
    """A foreign database made of nations (25 rows), read by the source with its filter pushed down."""
    import os
    import tempfile

    from pyspark.sql import SparkSession

    from wayloom.sources import sqlite

    spark = SparkSession.active()
    path = os.path.join(tempfile.mkdtemp(), "nations.db")
    sqlite.write(path, "nation", [("n_nationkey", "INTEGER"), ("n_name", "TEXT"), ("n_regionkey", "INTEGER")], (tuple(r) for r in table("nation").select("n_nationkey", "n_name", "n_regionkey").collect()))
    spark.dataSource.register(sqlite.SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    where = path if spark.sparkContext.master.startswith("local[") else sqlite.spread(spark, path)
    return spark.read.format("sqlite").options(path=where, table="nation").load().where("n_regionkey in (1, 3)").select("n_nationkey", "n_name")
