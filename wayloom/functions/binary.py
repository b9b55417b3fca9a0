"""Cursors over little-endian bytes and most-significant-first bits, and a writer with sections of later length."""

from __future__ import annotations

import struct


class BadData(ValueError):
    """Bytes that don't follow their format; the text says what and where."""


class Cursor:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = bytes(data), at

    def __bool__(self) -> bool:
        return self.at < len(self.data)

    def raw(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise BadData(f"truncated at {self.at}")
        self.at += n
        return self.data[self.at - n : self.at]

    def rest(self) -> bytes:
        return self.data[self.at :]

    def take(self, layout: str):
        """Values by a ``struct`` layout without its byte order; one value comes bare."""
        got = struct.unpack("<" + layout, self.raw(struct.calcsize("<" + layout)))
        return got[0] if len(got) == 1 else got

    def many(self, n: int, layout: str) -> list:
        size = struct.calcsize("<" + layout)
        got = list(struct.iter_unpack("<" + layout, self.raw(n * size)))
        return [g[0] for g in got] if got and len(got[0]) == 1 else got

    def expect(self, layout: str, *wanted, what: str = "signature"):
        at, got = self.at, self.take(layout)
        if got not in wanted:
            raise BadData(f"bad {what} at {at}: {got:#x}")
        return got

    def mark(self, tag: int):
        """A bare tag byte."""
        self.expect("B", tag, what="tag")

    def section(self, tag: int | None = None) -> tuple[int, Cursor]:
        """A tag byte, a length and as many bytes."""
        got = self.take("B") if tag is None else self.expect("B", tag, what="tag")
        return got, Cursor(self.raw(self.take("I")))

    def end(self, what: str):
        if self:
            raise BadData(f"trailing bytes after {what}")


class Builder:
    def __init__(self):
        self.out = bytearray()

    def put(self, layout: str, *values) -> Builder:
        self.out += struct.pack("<" + layout, *values)
        return self

    def section(self, tag: int, body: bytes | Builder) -> Builder:
        body = bytes(body.out) if isinstance(body, Builder) else bytes(body)
        return self.put("BI", tag, len(body)).raw(body)

    def raw(self, data: bytes) -> Builder:
        self.out += data
        return self

    def bytes(self) -> bytes:
        return bytes(self.out)


class Bits:
    """Bits, the most significant of each byte first; zeros follow the end."""

    def __init__(self, data: bytes):
        self.value, self.size, self.at = int.from_bytes(data, "big"), 8 * len(data), 0

    @property
    def left(self) -> int:
        return max(0, self.size - self.at)

    def peek(self, n: int) -> int:
        shift = self.size - self.at - n
        v = self.value >> shift if shift >= 0 else self.value << -shift
        return v & ((1 << n) - 1)

    def read(self, n: int) -> int:
        v = self.peek(n)
        self.at += n
        return v

    def align(self):
        self.at = -(-self.at // 8) * 8

    @property
    def used(self) -> int:
        return min(-(-self.at // 8), self.size // 8)


class BitBuilder:
    def __init__(self):
        self.bits: list[str] = []

    def put(self, v: int, n: int) -> BitBuilder:
        if n:
            self.bits.append(format(v & ((1 << n) - 1), f"0{n}b"))
        return self

    def align(self) -> BitBuilder:
        n = sum(map(len, self.bits))
        return self.put(0, -n % 8)

    def bytes(self) -> bytes:
        self.align()
        s = "".join(self.bits)
        return int(s or "0", 2).to_bytes(len(s) // 8, "big")


class PrefixCode:
    """A canonical prefix code: counts of codes by length, symbols in code order."""

    def __init__(self, counts: list[int], symbols: list[int]):
        self.codes: dict[tuple[int, int], int] = {}
        code = at = 0
        for n, count in enumerate(counts):
            code <<= 1
            for _ in range(count):
                self.codes[n + 1, code] = symbols[at]
                code, at = code + 1, at + 1
        self.longest = len(counts)
        self.of = {s: k for k, s in self.codes.items()}

    @classmethod
    def read(cls, bits: Bits, alphabet: int, longest: int) -> PrefixCode:
        width = bits.read(8) + 1
        counts = [bits.read(width) for _ in range(longest)]
        if not bits.left:
            raise BadData("truncated code table")
        if sum(counts) > alphabet or any(sum(c << (longest - k - 1) for k, c in enumerate(counts[: n + 1])) > 1 << longest for n in range(longest)):
            raise BadData("bad code table")
        size = (alphabet - 1).bit_length()
        return cls(counts, [bits.read(size) for _ in range(sum(counts))])

    def decode(self, bits: Bits) -> int:
        """The next symbol; 0 after the longest length if no code matches."""
        code = 0
        for n in range(1, self.longest + 1):
            code = code << 1 | bits.read(1)
            found = self.codes.get((n, code))
            if found is not None:
                return found
        return 0

    def write(self, out: BitBuilder, alphabet: int):
        counts = [sum(1 for n, _ in self.codes if n == k) for k in range(1, self.longest + 1)]
        width = max(c.bit_length() for c in counts) or 1
        out.put(width - 1, 8)
        for c in counts:
            out.put(c, width)
        for key in sorted(self.codes):
            out.put(self.codes[key], (alphabet - 1).bit_length())

    def encode(self, out: BitBuilder, symbol: int):
        n, code = self.of[symbol]
        out.put(code, n)

    @classmethod
    def fit(cls, weights: dict[int, int], longest: int) -> PrefixCode:
        """A code for symbols of these weights, no longer than ``longest`` bits (package-merge)."""
        if len(weights) == 1:
            return cls([1] + [0] * (longest - 1), list(weights))
        coins = sorted((w, (s,)) for s, w in weights.items())
        level = list(coins)
        for _ in range(longest - 1):
            paired = [(level[i][0] + level[i + 1][0], level[i][1] + level[i + 1][1]) for i in range(0, len(level) - 1, 2)]
            level = sorted(coins + paired)
        size: dict[int, int] = {}
        for _, symbols in level[: 2 * len(weights) - 2]:
            for s in symbols:
                size[s] = size.get(s, 0) + 1
        order = sorted(size, key=lambda s: (size[s], s))
        return cls([sum(1 for s in size if size[s] == n) for n in range(1, longest + 1)], order)
