"""Packing by concatenate and cut.

Pass 1 encodes each text once, on the partitions as they lie, and writes the ids with each text's start inside its
partition (a running sum). The totals of the partitions, one number each, give the partitions' global starts by a
prefix sum. Pass 2 reads the table, adds the two starts, and cuts the one long stream of ids into windows of ``window``;
a text that crosses a window's edge leaves a piece on either side. No row is shuffled; only the last window is padded.

Defined cases: null text is empty and holds the end id alone; repeated rows are packed each; a very long text is encoded
whole and cut into as many pieces as windows it meets; null ids are returned as they are; an empty table gives no piece;
other columns are ignored. The order of the stream is that of the partitions and rows of the written table.
"""

from __future__ import annotations

import functools
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm import hashing
from wayloom.llm.common import keeps, slices, small_batches, starts, whole_text, written
from wayloom.llm.token_count import tokenizer

WINDOW = 4096
_IDS: dict = {}
_ENDS: dict[str, np.ndarray] = {}
MOST_WORDS = 2_000_000
keeps("packing", _IDS.clear)
#: Kinds of bytes: white space, word (letters, digits and bytes beyond ASCII), sign.
KIND = np.array([0 if c in (9, 10, 11, 12, 13, 32) else 1 if c >= 128 or chr(c).isalnum() else 2 for c in range(256)], np.uint8)
#: Bytes that keep a text from being cut by bytes: apostrophe, underscore, all beyond the Latin letters of Latin-1.
_JOINS = np.array([c in (0x27, 0x5F, 0xC2) or c >= 0xC4 for c in range(256)])


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _encoded(path: str, parts: list[str]) -> list[bytes]:
    """The ids of each part. Words of Latin-1 letters are one pre-token each, whose last id alone ends a word: many are
    encoded as one text and cut at those ids."""
    tok = tokenizer(path)
    if path not in _ENDS:
        vocab = tok.get_vocab()
        _ENDS[path] = np.zeros(max(vocab.values(), default=0) + 1, bool)
        _ENDS[path][[i for w, i in vocab.items() if w.endswith("</w>")]] = True
    fast = getattr(tok, "encode_batch_fast", tok.encode_batch)
    plain = list(dict.fromkeys(w for w in parts if w.isalpha() and (w.isascii() or _latin(w))))
    ids = np.array(fast([" ".join(plain)], add_special_tokens=False)[0].ids if plain else [], "<u4")
    cuts = ((np.flatnonzero(_ENDS[path][ids]) + 1) * 4).tolist()
    out = dict.fromkeys(parts)
    if len(cuts) == len(plain):
        data, at = ids.tobytes(), 0
        for w, cut in zip(plain, cuts, strict=True):
            out[w], at = data[at:cut], cut
    rest = [w for w, v in out.items() if v is None]
    for w, e in zip(rest, fast(rest, add_special_tokens=False), strict=True):
        out[w] = struct.pack(f"<{len(e.ids)}I", *e.ids)
    return [out[w] for w in parts]


class Kept:
    """Ids of words by the words' 64-bit hashes: sorted arrays, new words in a small one that is merged now and then.

    A word's length and CRC-32 are kept beside its hash; a hit that differs in them is no hit.
    """

    def __init__(self):
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.tiers = [self._tier(), self._tier()]

    @staticmethod
    def _tier(key=(), start=(), size=(), mark=()):
        return np.array(key, np.uint64), np.array(start, np.int64), np.array(size, np.int32), np.array(mark, np.uint64)

    def find(self, keys: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of ids of each key; a start of -1 is unknown."""
        start, size = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        for known, starts_, sizes, marks_ in self.tiers:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = (known[at] == keys) & (marks_[at] == marks)
                start[hit], size[hit] = starts_[at[hit]], sizes[at[hit]]
        return start, size

    def add(self, keys: np.ndarray, marks: np.ndarray, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Keep the ids of new keys, which are sorted."""
        size = np.array([len(i) // 4 for i in ids], np.int64)
        start = self.used + np.cumsum(size) - size
        self.used += int(size.sum())
        if self.used > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used - int(size.sum())], np.zeros(max(self.used, len(self.flat)), np.uint32)])
        self.flat[self.used - int(size.sum()) : self.used] = np.frombuffer(b"".join(ids), "<u4")
        self.tiers[1] = self._merged(self.tiers[1], (keys, start, size.astype(np.int32), marks))
        if len(self.tiers[1][0]) > 1 << 16:
            self.tiers = [self._merged(*self.tiers), self._tier()]
        return start, size

    @staticmethod
    def _merged(a, b):
        order = np.argsort(key := np.concatenate([a[0], b[0]]), kind="stable")
        return key[order], *(np.concatenate([x, y])[order] for x, y in zip(a[1:], b[1:], strict=True))


def plain(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts can be cut by their bytes: ASCII and Latin letters (lead byte C3), without what might join two parts."""
    before = np.concatenate([[0], data[:-1]]) if len(data) else data
    odd = _JOINS[data] | ((before == 0xC3) & ((data == 0x97) | (data == 0xB7))) | ((before == 0x3C) & (data == 0x7C))
    bad = np.concatenate([[0], np.cumsum(odd)])
    return bad[offsets[1:]] == bad[offsets[:-1]]


def word_ids(path: str, texts: pa.Array) -> list[bytes]:
    """The ids of each text, as little-endian unsigned 32-bit; each distinct word is encoded once and kept.

    Words are told apart by 64-bit hashes of their lower-case bytes.
    """
    data, offsets = hashing.utf8(texts)
    fast = plain(data, offsets)
    data = hashing.lower(data)
    word, at, starts_, ends = hashing.segments(data, offsets, KIND)
    here = np.repeat(fast, np.diff(at))  # other texts are encoded by themselves
    word, starts_, ends, at = word[here], starts_[here], ends[here], np.concatenate([[0], np.cumsum(np.diff(at) * fast)])
    keys, first, inverse = np.unique(word, return_index=True, return_inverse=True)
    if path not in _IDS or len(_IDS[path].tiers[0][0]) > MOST_WORDS:
        _IDS[path] = Kept()
    kept = _IDS[path]
    view = memoryview(data)
    bounds = list(zip(starts_[first].tolist(), ends[first].tolist(), strict=True))
    marks = np.array([(b - a) << 32 | zlib.crc32(view[a:b]) for a, b in bounds], np.uint64)
    start, size = kept.find(keys, marks)
    new = np.flatnonzero(start < 0)
    for k in range(0, len(new), 4096):
        some = new[k : k + 4096]
        raw = [str(view[bounds[i][0] : bounds[i][1]], "utf-8") for i in some]
        start[some], size[some] = kept.add(keys[some], marks[some], _encoded(path, raw))
    per = size[inverse]
    to = np.concatenate([[0], np.cumsum(per)])
    ids = kept.flat[np.repeat(start[inverse] - to[:-1], per) + np.arange(to[-1])].astype("<u4").tobytes()
    bounds = (4 * to[at]).tolist()
    out = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    for i in np.flatnonzero(~fast):
        out[i] = b"".join(_encoded(path, _parts(texts[int(i)].as_py() or "")))
    return out


def _parts(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


# fixed values: the pre-token pattern, normalizers and word end of the public CLIP vocabulary
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]
_WORD_END = "</w>"


@functools.cache
def by_words(path: str) -> bool:
    """Whether ``word_ids`` may stand in for a tokenizer file: it lower-cases, drops white space, splits words from signs
    by that very pattern and marks word ends. Any other file goes to the library whole."""
    said = json.loads(tokenizer(path).to_str())
    normal, pre, model = said.get("normalizer") or {}, said.get("pre_tokenizer") or {}, said["model"]
    steps = [(x["type"], (x.get("pattern") or {}).get("Regex")) for x in normal.get("normalizers", [])]
    split = (pre.get("pretokenizers") or [{}])[0]
    kinds = [x["type"] for x in pre.get("pretokenizers", [])]
    removes = split.get("behavior") == "Removed" and split.get("invert") is True and split.get("pattern") == {"Regex": _PATTERN}
    plain_model = model["type"] == "BPE" and model.get("end_of_word_suffix") == _WORD_END and not model.get("dropout") and not model.get("unk_token")
    bare = all(t.get("special") and not t.get("lstrip") and not t.get("rstrip") and "<|" in t["content"] for t in said.get("added_tokens", []))
    return steps == _NORMALIZERS and kinds == ["Split", "ByteLevel"] and removes and plain_model and bare


def encode(path: str, texts: pa.Array) -> list[bytes]:
    """Ids of each text. Where ``by_words`` holds, pre-tokens hold no white space, so the ids of a text are those of its
    parts between white space, and, where signs can't join them, between words and signs."""
    if by_words(path):
        return word_ids(path, texts)
    return [np.array(e.ids, "<u4").tobytes() for e in tokenizer(path).encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]


def pack(docs: DataFrame, path: str, end_id: int = 2, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``."""
    spark = docs.sparkSession
    small_batches(spark)
    end = np.array([end_id], "<u4").tobytes()

    def first(batches):
        starts("packing")
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in slices(batch, "text", 1 << 19):
                ids = [x + end for x in encode(path, some.column(1))]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                local = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(local), pa.array(n), pa.array(ids, pa.binary())], ["doc_id", "part", "local", "n", "ids"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), whole_text(text).alias("text"))
    held = written(rows.mapInArrow(first, "doc_id bigint, part int, local bigint, n bigint, ids binary"), "packing-ids")
    # one number per partition of pass 1
    totals = sorted((r["part"], r["n"]) for r in held.groupBy("part").agg(F.sum("n").alias("n")).collect())
    bases, base = [], 0
    for part, n in totals:
        bases.append((part, base))
        base += n
    first_of = F.broadcast(spark.createDataFrame(bases, "part int, base bigint"))

    def second(batches):
        for batch in batches:
            for some in slices(batch, "ids", 1 << 21):
                out: list[tuple] = []
                for i, at, n, ids in zip(*(c.to_pylist() for c in some.columns), strict=True):
                    start = 0
                    while start < n:
                        seq, offset = divmod(at + start, window)
                        length = min(n - start, window - offset)
                        piece = ids[4 * start : 4 * (start + length)]
                        out.append((i, start, length, zlib.crc32(piece), n, seq, offset, piece))
                        start += length
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(7)] + [pa.array([o[7] for o in out], pa.binary())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    placed = held.join(first_of, "part").select("doc_id", (F.col("base") + F.col("local")).alias("at"), "n", "ids")
    return placed.mapInArrow(second, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")


def sequences(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, ids, length``, at most ``window`` ids each."""
    joined = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("length"))
    return joined.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), "length")


def op4_packing(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), path or public_tokenizers.path("word_bpe_49k.json")).drop("ids")
