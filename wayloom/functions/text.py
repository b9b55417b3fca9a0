"""Text functions as columns: paths of definitions, waypoints, requests, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayloom.schemas import INSTANCES


def folder(path: Column) -> Column:
    r"""Up to the last backslash, less a last part ``\Zones``."""
    return F.regexp_replace(F.regexp_replace(path, r"\\[^\\]*$", ""), r"\\Zones$", "")


def whole_folder(path: Column) -> Column:
    return F.regexp_replace(path, r"\\[^\\]*$", "")


def stem(path: Column) -> Column:
    """The file name without ``.ini`` or ``.INI``."""
    return F.regexp_replace(F.substring_index(path, "\\", -1), r"\.(ini|INI)$", "")


def short_folder(path: Column) -> Column:
    r"""What follows ``Missions\`` at the start, else what follows the first ``\Missions\``."""
    at = F.locate("\\Missions\\", path)
    return F.when(F.startswith(path, F.lit("Missions\\")), F.substring(path, 10, 1 << 30)).when(at > 0, F.substring(path, at + 10, F.lit(1 << 30))).otherwise(path)


def instance(text: Column) -> Column:
    """The instance that a text names, ignoring ASCII case and outer space, else null."""
    name = F.lower(F.trim(text))
    return F.when(name.isin(*INSTANCES), name)


def map_id(tag: Column) -> Column:
    """The map id of a tag of exactly four digits."""
    return F.when(tag.rlike("^[0-9]{4}$"), tag.cast("int"))


def waypoint_text(x: Column, y: Column, plane: Column, mapid: Column) -> Column:
    return F.format_string("{ x = %.5f, y = %.5f, plane = %d, mapid = %d },", x, y, plane, mapid)


def groups(text: Column) -> Column:
    """The innermost ``{...}`` groups of a text."""
    return F.regexp_extract_all(text, F.lit(r"\{([^{}]*)\}"), 1)


def values(groups: Column, keys: tuple[str, ...]) -> Column:
    """Of each comma-separated group of ``key = value``, a struct of the trimmed values of ``keys``; the last of several.

    Steps are transforms of their own, since what a lambda binds is worked out once.
    """
    part = lambda p, k: F.trim(F.split_part(p, F.lit("="), F.lit(k)))
    pairs = F.transform(groups, lambda g: F.transform(F.split(g, ","), lambda p: F.struct(part(p, 1).alias("k"), part(p, 2).alias("v"))))
    last = lambda ps, key: F.get(F.reverse(F.filter(ps, lambda p: p["k"] == key)), F.lit(0))["v"]
    return F.transform(pairs, lambda ps: F.struct(*[last(ps, k).alias(k) for k in keys]))


def finite(text: Column, kind: str = "double") -> Column:
    number = text.try_cast(kind)
    return F.when(F.isnan(number) | (F.abs(number) == float("inf")), None).otherwise(number)


_KEYS = ("x", "y", "plane", "mapid")


def parse_waypoints(text: Column, default_map: Column | None = None) -> Column:
    """``array<struct<n, mapid, x, y, plane, error>>`` of a text; errors name the group, counted from 1."""
    default_map = F.lit(None).cast("bigint") if default_map is None else default_map

    def numbers(g):
        plane = F.when(g["plane"].isNull(), F.lit(0).cast("bigint")).otherwise(g["plane"].try_cast("bigint"))
        mapid = F.when(g["mapid"].isNull(), default_map).otherwise(g["mapid"].try_cast("bigint"))
        return F.struct(finite(g["x"]).alias("x"), finite(g["y"]).alias("y"), plane.alias("plane"), mapid.alias("mapid"))

    def one(v, i):
        missing = F.array_compact(F.array(*[F.when(v[n].isNull(), F.lit(n)) for n in _KEYS]))
        error = F.when(F.exists(F.array(*[v[n].isNull() for n in _KEYS]), lambda b: b), F.concat(F.lit("waypoint "), (i + 1).cast("string"), F.lit(": bad "), F.array_join(missing, ", ")))
        return F.struct((i + 1).alias("n"), v["mapid"].alias("mapid"), v["x"].alias("x"), v["y"].alias("y"), v["plane"].alias("plane"), error.alias("error"))

    return F.transform(F.transform(values(groups(text), _KEYS), numbers), one)


def static_path(url: Column) -> Column:
    """The path below the served folder that a request's path names, a folder's index for a folder; null if it leaves it."""
    path = F.regexp_extract(url, r"^[^?#]*", 0)
    path = F.ltrim(F.when(F.endswith(path, F.lit("/")), F.concat(path, F.lit("index.html"))).otherwise(path), F.lit("/"))
    outside = path.rlike(r"(^|/)\.\.(/|$)|^\.(/|$)")
    return F.when(~outside, F.array_join(F.filter(F.split(path, "/"), lambda p: ~p.isin("", ".")), "/"))


def zone_label(zone: Column, definition: Column, layers: Column) -> Column:
    """The text that lists and tooltips show of a zone."""
    return F.format_string("zone %d: %s (%d layers)", zone, F.coalesce(definition, F.lit("no definition")), layers)


def request(url: Column, what: str) -> Column:
    """``struct<id, refresh>`` of ``/api/<what>/<id>[?refresh=1]``, else null."""
    path, args = F.split_part(url, F.lit("?"), F.lit(1)), F.split_part(url, F.lit("?"), F.lit(2))
    number = F.when(path.rlike(rf"^/api/{what}/[0-9]+$"), F.regexp_extract(path, r"([0-9]+)$", 1).try_cast("bigint"))
    refresh = F.exists(F.split(args, "&"), lambda a: a.isin("refresh=1", "refresh=true"))
    return F.when(number.isNotNull(), F.struct(number.alias("id"), refresh.alias("refresh")))


def request_url(what: str, number: Column, refresh: Column) -> Column:
    return F.concat(F.lit(f"/api/{what}/"), number.cast("string"), F.when(refresh, "?refresh=1").otherwise(""))


def content_type(path: Column) -> Column:
    kinds = {"html": "text/html", "js": "text/javascript", "wasm": "application/wasm", "css": "text/css", "json": "application/json", "png": "image/png", "svg": "image/svg+xml", "ico": "image/x-icon"}
    out = None
    for end, kind in kinds.items():
        out = (F if out is None else out).when(F.endswith(path, F.lit(f".{end}")), kind)
    return out.otherwise("application/octet-stream")
