"""Decoders and encoders of map-file chunks: kernels for UDTFs and ``mapInPandas``. All return plain dicts and lists."""

from __future__ import annotations

import zlib

from wayloom.functions.binary import BadData, BitBuilder, Bits, Builder, Cursor, PrefixCode

# fixed values: signatures, versions and tags of the file format
MAGIC = b"ffna"
FILE_REFS, PARAMS, PATH, MISSION, PROPS, TERRAIN, ZONES, ENVIRONMENT = 0x29939830, 0x5943EEEF, 0xEEFE704C, 0x40010020, 0x39583392, 0x87821134, 0x59220320, 0x92991030
PATH_VERSION, SPACING = 12, 96
KINDS = "Header EditorOld Terrain Zones Props Obsolete1 Water Mission Path Environment Locations Obsolete2 MapParameters Editor Collision Light Shore Sight Sound CubeMap VisData Occluders PathEngine".split()
STAGES = {0x10: ("strip", False), 0x11: ("strip", True), 0x20: ("bloated", False), 0x21: ("bloated", True)}
END = 0xFF
NONE = 0xFFFFFFFF
COUNTS, TRAPS, ROOT, X_NODES, Y_NODES, SINKS, VECTORS, PORTALS, PORTAL_TRAPS, STARTS = 0, 2, 3, 4, 5, 6, 1, 9, 10, 11


def chunks(data: bytes) -> tuple[int, list[dict]]:
    """File type and chunks (``ord, chunk_id, data``) of a container."""
    c = Cursor(data)
    if len(data) < 5 or c.raw(4) != MAGIC:
        raise BadData("not a container")
    kind, out = c.take("B"), []
    while c:
        chunk_id, n = c.take("II")
        out.append({"ord": len(out), "chunk_id": chunk_id, "data": c.raw(n)})
    return kind, out


def container(kind: int, parts: list[tuple[int, bytes]]) -> bytes:
    out = Builder().raw(MAGIC).put("B", kind)
    for chunk_id, data in parts:
        out.put("II", chunk_id, len(data)).raw(data)
    return out.bytes()


def chunk_name(chunk_id: int) -> dict | None:
    stage = STAGES.get(chunk_id >> 24)
    if stage is None or chunk_id & 0xFFFF00 or (chunk_id & 0xFF) >= len(KINDS):
        return None
    return {"stage": stage[0], "file_refs": stage[1], "kind": KINDS[chunk_id & 0xFF]}


def chunk_id(stage: str, kind: str, file_refs: bool = False) -> int:
    top = next(k for k, v in STAGES.items() if v == (stage, file_refs))
    return top << 24 | KINDS.index(kind)


def file_refs(data: bytes) -> list[int]:
    c = Cursor(data)
    c.expect("I", FILE_REFS)
    c.take("B")
    return [(w0 - 0xFF00FF + w1 * 0xFF00) & NONE for w0, w1, _ in c.many(len(c.rest()) // 6 + bool(len(c.rest()) % 6), "HHH")]


def params(data: bytes) -> dict:
    """Bounds, flags, map type (0 counts as 1) and whether there is water."""
    c = Cursor(data)
    c.expect("I", PARAMS)
    c.expect("B", 2, what="version")
    x0, y0, x1, y1, flags = c.take("ffffI")
    c.raw(16)
    return {"min_x": x0, "min_y": y0, "max_x": x1, "max_y": y1, "flags": flags, "map_type": max(flags >> 24, 1), "has_water": bool(flags & 1)}


def _path_head(c: Cursor, version: str) -> int:
    c.expect("I", PATH)
    c.expect(version, PATH_VERSION, what="version")
    return c.take("I")


def path_strip(data: bytes) -> dict:
    c = Cursor(data)
    sequence = _path_head(c, "B")
    c.mark(7)
    points = c.many(c.take("H"), "ff")
    c.mark(14)
    checksum = c.take("I")
    c.take("B")
    c.mark(END)
    return {"sequence": sequence, "start_points": points, "checksum": checksum}


def path_bloated(data: bytes) -> dict:
    c = Cursor(data)
    sequence = _path_head(c, "I")
    s = c.section(7)[1]
    points = s.many(s.take("H"), "ff")
    body = c.section(8)[1].rest()
    s = c.section(12)[1]
    indices = s.many(s.take("H"), "H")
    grid = c.section(13)[1].rest()
    checksum, mismatch = c.section(14)[1].take("IB")
    c.section(END)
    return {"sequence": sequence, "start_points": points, "planes": body, "plane_indices": indices, "obstacles": grid, "checksum": checksum, "mismatch": bool(mismatch)}


def write_path(strip: dict, planes: bytes, indices: list[int], obstacles: bytes) -> bytes:
    out = Builder().put("III", PATH, PATH_VERSION, strip["sequence"])
    points = Builder().put("H", len(strip["start_points"]))
    for p in strip["start_points"]:
        points.put("ff", *p)
    out.section(7, points).section(8, planes)
    out.section(12, Builder().put(f"H{len(indices)}H", len(indices), *indices)).section(13, obstacles)
    made = zlib.crc32(planes) ^ zlib.crc32(obstacles)
    return out.section(14, Builder().put("IB", strip["checksum"], made != strip["checksum"])).section(END, b"").bytes()


def node(raw: int) -> tuple[str, int] | None:
    kind = raw >> 30
    return None if raw == NONE or kind == 3 else (("x", "y", "sink")[kind], raw & 0x3FFFFFFF)


def raw_node(ref) -> int:
    return NONE if ref is None else ("x", "y", "sink").index(ref[0]) << 30 | ref[1]


def _sized(c: Cursor, tag: int, n: int, size: int) -> Cursor:
    s = c.section(tag)[1]
    if len(s.data) != n * size:
        raise BadData("path plane section size")
    return s


def planes(data: bytes) -> list[dict]:
    c = Cursor(data)
    out = []
    for _ in range(c.take("I")):
        starts, vectors, traps, xs, ys, sinks, portals, portal_traps = _sized(c, COUNTS, 8, 4).take("8I")
        c.mark(STARTS)
        if c.take("I") != starts * 16:  # the length says 16 a point; 8 follow
            raise BadData("path plane start point count")
        plane = {"start_points": c.many(starts, "ff"), "vectors": _sized(c, VECTORS, vectors, 8).many(vectors, "ff")}
        rows = _sized(c, TRAPS, traps, 44).many(traps, "4I2H6f")
        names = ("y_top", "y_bottom", "x_top_left", "x_top_right", "x_bottom_left", "x_bottom_right")
        plane["trapezoids"] = [{"nb": [None if n == NONE else n for n in r[:4]], "portal_left": None if r[4] == 0xFFFF else r[4], "portal_right": None if r[5] == 0xFFFF else r[5], **dict(zip(names, r[6:], strict=True))} for r in rows]
        root = _sized(c, ROOT, 1, 1).take("B")
        if root > 2:
            raise BadData("path plane root type")
        plane["root"] = (("x", "y", "sink")[root], 0)
        plane["x_nodes"] = [(a, b, node(left), node(right)) for a, b, left, right in _sized(c, X_NODES, xs, 16).many(xs, "4I")]
        plane["y_nodes"] = [(v, node(above), node(below)) for v, above, below in _sized(c, Y_NODES, ys, 12).many(ys, "3I")]
        plane["sinks"] = _sized(c, SINKS, sinks, 4).many(sinks, "I")
        plane["portal_traps"] = _sized(c, PORTAL_TRAPS, portal_traps, 4).many(portal_traps, "I")
        plane["portals"] = [dict(zip(("count", "start", "neighbor_plane", "pair", "flags"), r, strict=True)) for r in _sized(c, PORTALS, portals, 9).many(portals, "4HB")]
        out.append(plane)
    c.end("path planes")
    return out


def write_planes(rows: list[dict]) -> bytes:
    out = Builder().put("I", len(rows))
    order = ("start_points", "vectors", "trapezoids", "x_nodes", "y_nodes", "sinks", "portals", "portal_traps")
    flat = lambda items, layout, of=lambda r: r: _packed(items, layout, of)
    for p in rows:
        out.section(COUNTS, Builder().put("8I", *(len(p[k]) for k in order)))
        out.put("BI", STARTS, 16 * len(p["start_points"])).raw(flat(p["start_points"], "ff"))
        out.section(VECTORS, flat(p["vectors"], "ff"))
        out.section(TRAPS, flat(p["trapezoids"], "4I2H6f", lambda t: (*(NONE if n is None else n for n in t["nb"]), *(0xFFFF if t[k] is None else t[k] for k in ("portal_left", "portal_right")), *(t[k] for k in ("y_top", "y_bottom", "x_top_left", "x_top_right", "x_bottom_left", "x_bottom_right")))))
        out.section(ROOT, bytes([("x", "y", "sink").index(p["root"][0])]))
        out.section(X_NODES, flat(p["x_nodes"], "4I", lambda x: (x[0], x[1], raw_node(x[2]), raw_node(x[3]))))
        out.section(Y_NODES, flat(p["y_nodes"], "3I", lambda y: (y[0], raw_node(y[1]), raw_node(y[2]))))
        out.section(SINKS, flat([(s,) for s in p["sinks"]], "I")).section(PORTAL_TRAPS, flat([(s,) for s in p["portal_traps"]], "I"))
        out.section(PORTALS, flat(p["portals"], "4HB", lambda q: tuple(q[k] for k in ("count", "start", "neighbor_plane", "pair", "flags"))))
    return out.bytes()


def _packed(items, layout, of) -> bytes:
    out = Builder()
    for i in items:
        out.put(layout, *of(i))
    return out.bytes()


def mission(data: bytes) -> list[dict]:
    """Points of two lists; a tag's bytes are stored backwards."""
    c = Cursor(data)
    c.expect("I", MISSION)
    c.raw(25)
    out = []
    for which in (0, 1):
        for x, y, facing, tag in c.many(c.take("H"), "iiB4s"):
            text = "".join(chr(b) if 33 <= b < 127 else "?" for b in reversed(tag) if b)
            out.append({"list": which, "x": float(x), "y": float(y), "facing": facing, "tag": text})
    return out


def props(data: bytes) -> list[dict]:
    c = Cursor(data)
    c.expect("I", PROPS)
    c.expect("B", 0x11, 0x12, what="version")
    c.mark(0)
    out = []
    for k in range(c.take("H")):
        model, x, y, z, *rot, scale, flags, n = c.take("HfffBBBBBB")
        out.append({"ord": k, "model": model, "x": x, "y": y, "z": z, "rot": rot, "scale": scale * 1.9921875 / 256 + 0.0078125, "flags": flags, "points": c.many(n, "hh")})
    return out


def prop_collision(data: bytes) -> dict:
    c = Cursor(data)
    c.expect("I", PROPS)
    c.expect("B", 0x11, what="version")
    c.section(0)
    got = {}
    for tag, name, layout, size in ((1, "points", "fffIIHH", 24), (2, "plane_props", "H", 2), (3, "portal_points", "ff", 8)):
        s = c.section(tag)[1]
        n = s.take("I")
        if len(s.rest()) != n * size:
            raise BadData("props section size")
        got[name] = s.many(n, layout)
    return got


def zone_chunk(data: bytes) -> dict:
    """Definitions with their layers (stored a field at a time), prop models, polygons and unknown sections."""
    c = Cursor(data)
    c.expect("I", ZONES)
    out = {"version": c.take("B"), "sections": [], "defs": [], "prop_models": None, "atlas": None, "zones": [], "unknown": []}
    while True:
        at = c.at
        tag, s = c.section()
        out["sections"].append({"tag": tag, "offset": at, "length": len(s.data)})
        if tag == END:
            return out
        if tag == 1:
            for k in range(s.take("I")):
                def_id, name = s.take("I"), bytearray()
                while (unit := s.raw(2)) != b"\0\0":
                    name += unit
                layers, models = s.take("II")
                fields = [s.many(layers, f) for f in ("I", "f", "f", "f", "f", "B", "I")]
                names = ("kind", "spacing", "collision_radius", "density", "scale_variance", "pattern", "model_count")
                p, flags = s.many(models, "f"), s.many(models, "I")
                out["defs"].append({"ord": k, "def_id": def_id, "ini_path": name.decode("utf-16-le", "replace"), "layers": [dict(zip(names, row, strict=True)) for row in zip(*fields, strict=True)], "models": [{"cum_p": a, "flags": b} for a, b in zip(p, flags, strict=True)]})
            s.end("zone definitions")
        elif tag == 2:
            out["prop_models"] = s.many(s.take("B"), "I")
            out["atlas"] = list(s.rest())
        elif tag == 3:
            for k in range(s.take("I")):
                def_id, flags, raw = s.take("IBH")
                out["zones"].append({"ord": k, "def_id": def_id, "flags": flags, "height_raw": raw, "vertices": s.many(s.take("I"), "ff")})
            s.end("zones")
        else:
            out["unknown"].append((tag, s.data))


def environment(data: bytes) -> dict:
    """Lighting and water records; colours are stored blue first."""
    c = Cursor(data)
    c.expect("I", ENVIRONMENT)
    c.take("H")
    variant = c.take("H")

    def records(size):
        c.take("B")
        n = c.take("H")
        return [Cursor(c.raw(size)) for _ in range(n)]

    for size in (10, 6, 19):
        records(size)
    light = [r.take("8B") for r in records(8)]
    records(2)
    records(16 if variant > 0 else 15)
    water = []
    for r in records(57):
        mode, flags = r.take("BB")
        r.raw(3)
        z = r.take("f")
        r.raw(36)
        a, p, (color, distortion) = r.take("4B"), r.take("4B"), r.take("HH")
        water.append({"mode": mode, "flags": flags, "surface_z": z, "absorption": [a[2], a[1], a[0], a[3]], "pattern": [p[2], p[1], p[0], p[3]], "color_texture": color, "distortion_texture": distortion})
    return {"lighting": [{"ambient": [v[2], v[1], v[0]], "ambient_intensity": v[3], "sun": [v[6], v[5], v[4]], "sun_intensity": v[7]} for v in light], "water": water}


def write_obstacles(wide: int, high: int, cells: dict[tuple[int, int], list[tuple[float, float, float]]]) -> bytes:
    """A grid of obstacle lists, by (row, column)."""
    rows = [cells.get((r, c), []) for r in range(high) for c in range(wide)]
    out, first = Builder().put("HHH", wide, high, sum(map(len, rows))), 0
    for row in rows:
        out.put("BH", len(row), first)
        first += len(row)
    for o in (o for row in rows for o in row):
        out.put("fff", *o)
    return out.bytes()


def obstacles(data: bytes) -> tuple[int, int, list[list[tuple]]]:
    c = Cursor(data)
    wide, high, n = c.take("HHH")
    ranges, every = c.many(wide * high, "BH"), c.many(n, "fff")
    if any(first + count > n for count, first in ranges):
        raise BadData("obstacle cell range")
    return wide, high, [every[first : first + count] for count, first in ranges]


def manifest(data: bytes) -> list[dict]:
    """``base_id, current_id, deps`` of records between zeros; of records of one base the last counts."""
    if len(data) % 4:
        raise BadData(f"bad length {len(data)}")
    words = Cursor(data).many(len(data) // 4, "I")
    if not words or words[0]:
        raise BadData("bad header")
    if words[-1]:
        raise BadData("unterminated")
    out, record, at = {}, [], 1
    for k, w in enumerate(words[1:], 1):
        if w:
            record.append(w)
            continue
        if len(record) < 2:
            raise BadData(f"short record at {at}")
        out[record[1]] = {"base_id": record[1], "current_id": record[0], "deps": record[2:]}
        record, at = [], k + 1
    return list(out.values())


# heights: 32 x 32 chunks of 4 x 4 blocks
CHUNK, ESCAPE, ALPHABET, LONGEST = 32, 0x3FF, 0x400, 18


def _inverse(c: list[int]) -> list[int]:
    """Columns, then rows of a 4 x 4 block: sums and differences in pairs."""
    def four(a, b, p, q):
        return a - b - p, a - b + p, a + b - q, a + b + q

    columns = [four(*c[j::4]) for j in range(4)]
    rows = [four(*(columns[j][i] for j in range(4))) for i in range(4)]
    return [v for row in rows for v in row]


def heights(wide: int, high: int, data: bytes) -> tuple[list[int], int]:
    """Heights of ``wide x high`` samples, chunk by chunk, each row by row; and the bytes used."""
    bits, out = Bits(data), []
    for _ in range(wide // CHUNK * (high // CHUNK)):
        ranges = []
        for _ in range(2):
            base = bits.read(16)
            ranges.append((base - (base >> 15 << 16), bits.read(4) + 1))
        bits.align()
        code, grid = PrefixCode.read(bits, ALPHABET, LONGEST), [0] * (CHUNK * CHUNK)
        for by in range(8):
            for bx in range(8):
                if not bits.left:
                    raise BadData("height block")
                c = [ranges[0][0] + bits.read(ranges[0][1])]
                for _ in range(15):
                    s = code.decode(bits)
                    c.append(ranges[1][0] + bits.read(ranges[1][1]) if s == ESCAPE else s - 0x200)
                for k, v in enumerate(_inverse(c)):
                    grid[(by * 4 + k // 4) * CHUNK + bx * 4 + k % 4] = v
        bits.align()
        out += grid
    return out, bits.used


def write_heights(blocks: list[list[int]]) -> bytes:
    """The inverse for coefficients: 64 blocks of 16 a chunk."""
    out = BitBuilder()
    for k in range(0, len(blocks), 64):
        part = blocks[k : k + 64]
        lows = [min(b[0] for b in part), min([v for b in part for v in b[1:] if not -0x200 <= v < 0x1FF] or [0])]
        spans = [max(b[0] for b in part) - lows[0], max([v for b in part for v in b[1:] if not -0x200 <= v < 0x1FF] or [0]) - lows[1]]
        widths = [max(1, s.bit_length()) for s in spans]
        for low, width in zip(lows, widths, strict=True):
            out.put(low, 16).put(width - 1, 4)
        out.align()
        symbols = [v + 0x200 if -0x200 <= v < 0x1FF else ESCAPE for b in part for v in b[1:]]
        weights: dict[int, int] = {}
        for s in symbols:
            weights[s] = weights.get(s, 0) + 1
        code = PrefixCode.fit(weights, LONGEST)
        code.write(out, ALPHABET)
        at = iter(symbols)
        for b in part:
            out.put(b[0] - lows[0], widths[0])
            for v in b[1:]:
                s = next(at)
                code.encode(out, s)
                if s == ESCAPE:
                    out.put(v - lows[1], widths[1])
        out.align()
    return out.bytes()


def packed_bytes(data: bytes) -> tuple[list[int], int]:
    """An array of small numbers: count, width, values; and the bytes used."""
    bits = Bits(data)
    n = bits.read(8)
    if not n:
        return [], 1
    width = bits.read(3)
    if not width or width * n + 11 > bits.size:
        raise BadData("packed array")
    values = [bits.read(width) for _ in range(n)]
    bits.align()
    return values, bits.used


def terrain(data: bytes, surface: bool = False) -> dict:
    """Header and heights of a terrain chunk; with ``surface`` also textures, packed arrays, water mask and chunk grid."""
    c = Cursor(data)
    c.expect("I", TERRAIN)
    c.expect("B", 0x11, what="version")
    c.mark(0)
    packed, angle, _, _, _ = c.take("IBHBB")
    if packed & 0xC0 != 0x80 or packed >> 8 & 0xFF != SPACING:
        raise BadData("terrain header")
    wide, high = ((packed >> 24) + 1) * CHUNK, ((packed >> 16) + 1 & 0xFF) * CHUNK
    c.mark(1)
    z, used = heights(wide, high, c.rest())
    c.raw(used)
    out = {"wide": wide, "high": high, "angle": angle, "heights": z}
    if surface:
        c.mark(2)
        out["textures"] = list(c.raw(wide * high))
        for tag, name in ((4, "indices"), (5, "data")):
            c.mark(tag)
            out[name], used = packed_bytes(c.rest())
            c.raw(used)
        c.mark(3)
        out["water"] = c.raw(wide * high // 4)
        c.mark(7)
        out["grid"] = []
        for _ in range(wide // CHUNK * (high // CHUNK)):
            body = c.raw(c.take("I"))
            out["grid"].append({"data": body, "shadow": c.raw(0x80)})
        out["shiny"] = None
        if c.rest()[:1] == b"\x03":
            c.mark(3)
            out["shiny"] = c.take("Bffff")
        c.mark(END)
    return out


def write_terrain(wide: int, high: int, blocks: list[list[int]]) -> bytes:
    """A terrain chunk's header and heights."""
    packed = 0x80 | SPACING << 8 | high // CHUNK - 1 << 16 | wide // CHUNK - 1 << 24
    return Builder().put("IBBIBHBBB", TERRAIN, 0x11, 0, packed, 0, 0, 0, 0, 1).raw(write_heights(blocks)).bytes()


def model_outline(data: bytes) -> list[dict]:
    """The collision outline of a model file; files that are no models have none."""
    if data[:4] != MAGIC or len(data) < 5 or data[4] != 2:
        return []
    found = {}
    for part in chunks(data)[1]:
        found.setdefault(part["chunk_id"], part["data"])
    body = found.get(0xBBA, found.get(0xFA4))
    if body is None or len(body) < 8:
        return []
    c = Cursor(body)
    if c.take("I") != 2:
        return []
    names = ("plane", "flags", "portal", "portal_plane", "x", "y", "z")
    return [dict(zip(names, p, strict=True)) for p in c.many(c.take("I"), "BBBBfff")]
