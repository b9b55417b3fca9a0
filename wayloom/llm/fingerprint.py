"""Document fingerprints: a homomorphic hash of the multiset of a text's paragraphs.

A paragraph is a line that has a word. Its vector has two parts, each added lane by lane modulo a power of two:

* ``LANES`` lanes of 32 bits, pseudo-random in all bits, expanded from the paragraph's hash. Texts with equal sums hold
  the same paragraphs equally often, in any order;
* ``SKETCH`` lanes of 32 bits that are sparse: each run of ``WORDS`` words of the paragraph adds +1 or -1 to one lane.
  Inner products of these parts estimate how many runs two texts share.

The sum of a text is the sum of its paragraphs, so inserting (deleting) a paragraph adds (subtracts) its vector:
``combine``. Likeness is 2<a,b> / (<a,a> + <b,b>) of the sketch parts, held to 0..1; it is 1 for equal fingerprints and for
no others.

Defined cases: null text is empty; a text without words has the zero vector; very long texts are read whole, one at a
time; rows that share an id follow each other in an order set by the texts; null ids come first; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.llm import hashing
from wayloom.llm.common import slices, small_batches, whole_text

LANES, SKETCH, WORDS = 16, 1024, 5
#: Rows that are made into vectors together, at most.
ROWS = 512
_SEEDS = hashing.mix(np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The two parts of each text's vector: (n, LANES) of uint32 and (n, SKETCH) of uint32."""
    n = len(texts)
    lanes, sketch = np.zeros((n, LANES), np.uint32), np.zeros((n, SKETCH), np.uint32)
    lines = [x.split("\n") for x in texts]
    owner = np.repeat(np.arange(n), [len(x) for x in lines])
    data, offsets = hashing.utf8(pa.array([y for x in lines for y in x], pa.large_string()))
    word, at = hashing.words(data, offsets)
    has = np.flatnonzero(np.diff(at))
    if not len(has):
        return lanes, sketch
    # of a paragraph: its words in order
    size = np.diff(at)[has]
    with np.errstate(over="ignore"):
        place = (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)).astype(np.uint64)
        mixed = hashing.mix(word[at[has[0]] : at[has[-1] + 1]] * hashing.WORD_BASE + place)
        whole = hashing.mix(np.add.reduceat(mixed, np.cumsum(size) - size) + size.astype(np.uint64))
        wide = hashing.mix(whole[:, None] * np.uint64(3) + _SEEDS[None, :]).astype(np.uint32)
    of = owner[has]
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    lanes[of[first]] = np.add.reduceat(wide, first, axis=0, dtype=np.uint32)
    runs, to = hashing.shingles(word, at, WORDS)
    doc = np.repeat(owner, np.diff(to))
    lane = (runs % np.uint64(SKETCH)).astype(np.int64)
    sign = np.where(runs >> np.uint64(63), 1.0, -1.0)
    total = np.bincount(doc * SKETCH + lane, weights=sign, minlength=n * SKETCH).reshape(n, SKETCH)
    sketch[:] = (total.astype(np.int64) & 0xFFFFFFFF).astype(np.uint32)
    return lanes, sketch


def encode(lanes: np.ndarray, sketch: np.ndarray) -> list[str]:
    """Fingerprints as text: the lanes in hex, a dot, the sketch compressed in base 64."""
    lanes, sketch = lanes.astype("<u4"), sketch.astype("<u4")
    return [f"{a.tobytes().hex()}.{base64.b64encode(zlib.compress(b.tobytes(), 1)).decode()}" for a, b in zip(lanes, sketch, strict=True)]


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    a, _, b = fingerprint.partition(".")
    return np.frombuffer(bytes.fromhex(a), "<u4"), np.frombuffer(zlib.decompress(base64.b64decode(b)), "<u4")


def combine(fingerprint: str, added: tuple[str, ...] = (), deleted: tuple[str, ...] = ()) -> str:
    """The fingerprint after whole paragraphs are inserted or deleted."""
    lanes, sketch = (x.copy() for x in decode(fingerprint))
    for sign, texts in ((1, added), (-1, deleted)):
        for a, b in zip(*vectors(list(texts)), strict=True):
            lanes, sketch = (lanes + a, sketch + b) if sign > 0 else (lanes - a, sketch - b)
    return encode(lanes[None], sketch[None])[0]


def likeness(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Row by row, of vectors' two parts."""
    same = (x[0] == y[0]).all(1) & (x[1] == y[1]).all(1)
    a, b = x[1], y[1]
    a, b = a.astype(np.int32).astype(np.float64), b.astype(np.int32).astype(np.float64)
    norm = (a * a).sum(1) + (b * b).sum(1)
    near = np.clip(2 * (a * b).sum(1) / np.where(norm > 0, norm, 1), 0, 1)
    return np.where(same, 1.0, np.minimum(near, 1 - 2.0**-20))


def edited(text: str, following: str) -> str:
    """The last quarter of ``text`` replaced by as many first code points (or all) of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _bucket(cuts: list[int]) -> Column:
    """How many cuts an id is above: counted among every so many cuts, then among those between two of them."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) or 1
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    longs = lambda xs: f"array({','.join(f'{c}L' for c in xs)})"
    above = lambda xs: f"aggregate({xs}, 0, (n, c) -> n + int(coalesce(doc_id > c, false)))"
    coarse = F.expr(above(longs([g[-1] for g in groups[:-1]]) if len(groups) > 1 else "cast(array() as array<bigint>)"))
    fine = F.expr(above(f"element_at(array({','.join(map(longs, groups))}), 1 + {above(longs([g[-1] for g in groups[:-1]])) if len(groups) > 1 else 0})"))
    return coarse * step + fine


def _ordered(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows in buckets that hold ranges of ids, each followed by a copy of the next bucket's first row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), whole_text(text).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.select("doc_id")
    cuts = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], max(10_000, 10 * parts)).alias("q")).head()["q"] or []
    bucket = _bucket(sorted(set(cuts)))
    # one row per bucket: which bucket comes before it, and its first id
    heads = sorted(ids.withColumn("bucket", bucket).groupBy("bucket").agg(F.min("doc_id").alias("first")).collect(), key=lambda r: r["bucket"])
    if not heads:
        return rows.withColumn("bucket", F.lit(0)).withColumn("ahead", F.lit(False))
    # within one bucket per head, the copies go to the bucket before; the first bucket's go to the last
    before = {r["bucket"]: heads[i - 1]["bucket"] for i, r in enumerate(heads)}
    firsts = spark.createDataFrame([(r["first"], before[r["bucket"]]) for r in heads], "first bigint, before int")
    placed = rows.withColumn("bucket", bucket)
    copies = placed.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "text", F.col("before").alias("bucket"), F.lit(True).alias("ahead"))
    both = placed.withColumn("ahead", F.lit(False)).unionByName(copies)
    # a number a bucket that hashes to a partition of its own
    n = len(heads)
    found = spark.range(20 * n + 100).select(F.col("id").cast("int").alias("x"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p")).groupBy("p").agg(F.min("x").alias("x")).collect()
    own = {r["p"]: r["x"] for r in found}
    spare = iter(range(20 * n + 100, 21 * n + 100))
    to = {r["bucket"]: own.get(i, None) for i, r in enumerate(heads)}
    to = spark.createDataFrame([(b, next(spare) if x is None else x) for b, x in to.items()], "bucket int, own int")
    dealt = both.join(F.broadcast(to), "bucket")
    return dealt.repartition(n, "own").sortWithinPartitions("bucket", "ahead", "doc_id", F.xxhash64("text"))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of every row: its fingerprint, that of its edited text, and their likeness; the edit takes from the next row."""
    small_batches(docs.sparkSession)

    def rows(batches):
        """(id, text, next text), a few MB at a time; a bucket's last row is followed by the first copied one."""
        held, waiting, size = [], None, 0
        done = False
        bucket = None
        for batch in batches:
            for part in slices(batch, "text"):
                for i, t, b, ahead in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if b != bucket:
                        bucket, waiting, done = b, None, False
                    if done:
                        continue
                    if waiting is not None:
                        held.append((*waiting, t))
                        size += len(t)
                    waiting, done = (i, t), ahead
                    if size > 1 << 20 or len(held) >= ROWS:
                        yield held
                        held, size = [], 0
        if held:
            yield held

    def run(batches):
        for group in rows(batches):
            texts, following = [r[1] for r in group], [r[2] for r in group]
            changed = [edited(t, n) for t, n in zip(texts, following, strict=True)]
            own, edit, ahead = vectors(texts), vectors(changed), vectors(following)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in group], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                    pa.array(encode(*own)), pa.array(encode(*edit)), pa.array(likeness(own, edit)), pa.array(likeness(own, ahead)),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return _ordered(docs, doc_id, text).select("doc_id", "text", "bucket", "ahead").mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op10_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
