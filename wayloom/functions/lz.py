"""A block codec of literals, back-references and copies from an older version, under prefix codes.

Stored data has its own length. Otherwise four bits give the format: 0 full, 1 with copies from the old version. Blocks
follow: prefix codes of commands and of distances (or offsets), a number of commands, the commands. Lengths and distances
are a bucket of a power of two and its extra bits. The old version's cursor moves with the output; a copy near the last
one sets it to the copied range's end.
"""

from __future__ import annotations

from wayloom.functions.binary import BadData, BitBuilder, Bits, PrefixCode

LEAST, BUCKETS, LONGEST, NEAR = 3, 32, 15, 256


def _bucket(v: int) -> tuple[int, int, int]:
    """Bucket, extra bits, and how many."""
    n = (v + 1).bit_length() - 1
    return n, v + 1 - (1 << n), n


def _value(bits: Bits, bucket: int) -> int:
    if bucket >= BUCKETS:
        raise BadData("bad bucket")
    return (1 << bucket) + bits.read(bucket) - 1


def compress(data: bytes, old: bytes | None = None) -> bytes:
    commands, at, seen, cursor, last = [], 0, {}, 0, 0
    index = {old[i : i + 8]: i for i in range(len(old or b"") - 7, -1, -1)} if old else {}
    while at < len(data):
        best = (0, None)
        back = seen.get(data[at : at + LEAST])
        if back is not None:
            n = 0
            while at + n < len(data) and data[back + n] == data[at + n] and n < 1 << 16:
                n += 1
            best = (n, ("back", n, at - back))
        place = index.get(data[at : at + 8])
        if place is not None:
            n = 0
            while at + n < len(data) and place + n < len(old) and old[place + n] == data[at + n]:
                n += 1
            if n > best[0]:
                best = (n, ("old", n, place - cursor))
        n = best[0] if best[0] >= LEAST and at + LEAST <= len(data) else 1
        if n == 1:
            commands.append(("byte", data[at], 0))
            cursor += 1
        else:
            commands.append(best[1])
            if best[1][0] == "old":
                cursor, last = _moved(cursor, last, best[1][2] + cursor, n)
            else:
                cursor += n
        for k in range(at, min(at + n, len(data) - LEAST + 1)):
            seen[data[k : k + LEAST]] = k
        at += n
    out = BitBuilder().put(1 if old is not None else 0, 4)
    for k in range(0, len(commands), 4096):
        _write(out, commands[k : k + 4096])
    return out.bytes()


def _moved(cursor: int, last: int, place: int, n: int) -> tuple[int, int]:
    return (place + n if abs(place - last) <= NEAR else cursor + n), place


def _write(out: BitBuilder, commands: list):
    rows = []
    for kind, a, b in commands:
        if kind == "byte":
            rows.append((a, None))
        elif kind == "back":
            rows.append((256 + _bucket(a - LEAST)[0], _bucket(b - 1)[0]))
        else:
            rows.append((256 + BUCKETS + _bucket(a - LEAST)[0], 2 * _bucket(abs(b))[0] + (b < 0) + BUCKETS))
    codes = []
    for k in (0, 1):
        weights: dict[int, int] = {}
        for r in rows:
            if r[k] is not None:
                weights[r[k]] = weights.get(r[k], 0) + 1
        code = PrefixCode.fit(weights or {0: 1}, LONGEST)
        code.write(out, 512)
        codes.append(code)
    out.put(len(commands), 16)
    for (kind, a, b), (symbol, far) in zip(commands, rows, strict=True):
        codes[0].encode(out, symbol)
        if kind != "byte":
            out.put(_bucket(a - LEAST)[1], _bucket(a - LEAST)[2])
            codes[1].encode(out, far)
            v = _bucket(b - 1) if kind == "back" else _bucket(abs(b))
            out.put(v[1], v[2])


def decompress(data: bytes, size: int, old: bytes | None = None) -> bytes:
    if len(data) > size:
        raise BadData(f"{len(data)} compressed bytes are more than {size}")
    if len(data) == size:
        return data
    bits, out, cursor, last = Bits(data), bytearray(), 0, 0
    kind = bits.read(4)
    if kind > 1:
        raise BadData(f"unknown format {kind}")
    if kind == 1 and old is None:
        raise BadData("needs the old version")
    while len(out) < size:
        if not bits.left:
            raise BadData("data end early")
        commands, places = PrefixCode.read(bits, 512, LONGEST), PrefixCode.read(bits, 512, LONGEST)
        for _ in range(bits.read(16)):
            if len(out) >= size:
                break
            s = commands.decode(bits)
            if s < 256:
                out.append(s)
                cursor += 1
                continue
            n = LEAST + _value(bits, (s - 256) % BUCKETS)
            far = places.decode(bits)
            if s < 256 + BUCKETS:
                back = _value(bits, far) + 1
                if back > len(out) or len(out) + n > size:
                    raise BadData("back-reference out of range")
                for _ in range(n):
                    out.append(out[-back])
                cursor += n
            else:
                v = _value(bits, (far - BUCKETS) // 2)
                place = cursor + (-v if far & 1 else v)
                if place < 0 or place + n > len(old or b"") or len(out) + n > size:
                    raise BadData("copy from the old version out of range")
                out += old[place : place + n]
                cursor, last = _moved(cursor, last, place, n)
    return bytes(out)
