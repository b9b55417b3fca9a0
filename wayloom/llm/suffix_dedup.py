"""Removal of long byte strings that start at more than one place of a corpus, by a prefix-free parse.

A position is a *trigger* if the rolling hash of its ``K`` bytes is 0 modulo ``EVERY``. Triggers depend on those bytes
alone, so equal strings have equal triggers, and the text between neighbouring triggers (with the trigger's bytes) is a
phrase. Texts are replaced by their parses, and equality of ``LENGTH``-byte strings is decided on the parse:

1. *Dictionary.* A trigger is kept if its first ``KEY`` bytes occur at more than one trigger of the corpus. In text that
   is said once, none is; everything after works on the repetitive part alone. Where triggers are farther apart than
   ``REACH``, ``FINE`` times as many positions count as triggers.
2. *Hulls.* All strings of ``LENGTH`` bytes whose first trigger is one and the same, at like distances (in steps of
   ``STEP``), lie in one hull. Equal hulls are one entry with a count; a hull that occurs twice settles its strings.
3. *Suffix arrays.* A string is a suffix of a dictionary phrase, up to its first trigger, and a suffix of the parse from
   there on. Of hulls that occur once but share the core that all of their strings hold with another hull, and of one copy
   of each such other hull, both are put in order (``suffix_order``): the phrases read backwards from the trigger, the
   parses forwards. Neighbours in these orders, compared byte by byte, give classes of equal suffixes at every depth, and
   the strings at one distance whose two classes agree are equal, which is corpus order cut off at ``LENGTH`` bytes.
4. Strings without a trigger of either kind in their first ``REACH`` bytes are in periodic text alone; they are hashed.

Whole equal texts are one class from the start, by SHA-256. Hulls and the strings of step 4 are told by two 64-bit
polynomials together (128 bits), all others by their bytes; the hashes of steps 1 and 3 that pick candidates can only let
too much through.

Beside the bytes, ``n_passages`` counts the maximal runs of over 50 words (``passages.WINDOW`` at least) of a document that
another document holds too: such a run may have fewer than ``LENGTH`` bytes, and is then reported and not removed.

Defined cases: null text is empty; shorter texts keep all; repeated
rows and equal texts repeat each other wholly; null ids are returned as they are; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm import hashing, passages, suffix_order
from wayloom.llm.common import HEAVY, heavy_join, slices, small_batches, whole_text, written

LENGTH, KEY, REACH, K, EVERY, FINE, STEP = 400, 80, 320, 16, 64, 8, 32
#: Lists of up to this many rows are broadcast; longer ones are shuffled.
MOST_BROADCAST = 1_000_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_OVER = 2 * LENGTH + REACH


class Text:
    """A text's bytes with the prefix sums of its polynomial hash, a piece at a time."""

    def __init__(self, data: np.ndarray, second: bool = False, piece: int = hashing.PIECE - _OVER):
        self.data, self.piece = data, piece
        self.powers, self.inverse = (hashing._POW2, hashing._INV2) if second else (hashing._POW, hashing._INV)

    def pieces(self):
        n = len(self.data)
        for a in range(0, n, self.piece):
            part = self.data[a : min(n, a + self.piece + _OVER)]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * self.powers[: len(part)], dtype=np.uint64, out=sums[1:])
            yield a, min(n, a + self.piece), sums

    def _hash(self, sums, s, e):
        return hashing.mix((sums[e] - sums[s]) * self.inverse[s] + (e - s).astype(np.uint64))

    def triggers(self, key: int, every: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of triggers that have ``key`` bytes, and the hashes of those bytes."""
        n, at, keys = len(self.data), [], []
        for a, b, sums in self.pieces():
            s = np.arange(max(0, min(b, n - key + 1) - a))
            if len(s):
                roll = hashing.mix((sums[s + K] - sums[s]) * self.inverse[s])
                s = s[roll % np.uint64(every) == 0]
                at.append(s + a)
                keys.append(self._hash(sums, s, s + key))
        return (np.concatenate(at), np.concatenate(keys)) if at else (np.zeros(0, np.int64), np.zeros(0, np.uint64))

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the strings [start, end), which are sorted by start and at most ``_OVER`` long."""
        out = np.zeros(len(starts), np.uint64)
        for a, b, sums in self.pieces() if len(starts) else ():
            i, j = np.searchsorted(starts, (a, b))
            if i < j:
                out[i:j] = self._hash(sums, starts[i:j] - a, ends[i:j] - a)
        return out


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All integers of the ranges lo..hi, both inclusive, one range after the other."""
    n = np.maximum(hi - lo + 1, 0)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def bare(at: np.ndarray, n: int, length: int, reach: int) -> np.ndarray:
    """Starts of strings that have no trigger at a distance up to ``reach``."""
    last = np.concatenate([[-1], at])
    to = np.concatenate([at - reach - 1, [n - length]])
    return _ranges(last + 1, np.minimum(to, n - length))


def parse(own: Text, length: int, key: int, reach: int, every: int) -> tuple[np.ndarray, ...]:
    """A text's triggers: position, key, nearest and farthest start before it that it leads, next trigger; and bare starts.

    Where triggers are too far apart, ``FINE`` times as many positions count; those have no next trigger (-1).
    """
    n = len(own.data)
    at, keys = own.triggers(key, every)
    near = np.maximum(0, at + length - n)
    far = np.minimum(np.diff(np.concatenate([[-1], at])) - 1, reach)
    after = np.concatenate([at[1:], [n - key + 1]])[: len(at)]
    left = bare(at, n, length, reach)
    if len(left) and every > FINE:
        fine, fine_keys = own.triggers(key, every // FINE)
        to = np.searchsorted(fine, left)
        lead = fine[np.minimum(to, len(fine) - 1)] if len(fine) else np.zeros(len(left), np.int64)
        led = (to < len(fine)) & (lead - left <= reach)
        p, first = np.unique(lead[led], return_index=True)
        last = np.concatenate([first[1:], [led.sum()]])[: len(first)] - 1
        s = left[led]
        at, near, far = np.concatenate([at, p]), np.concatenate([near, p - s[last]]), np.concatenate([far, p - s[first]])
        keys = np.concatenate([keys, hashing.mix(fine_keys[np.searchsorted(fine, p)])])
        after = np.concatenate([after, np.full(len(p), -1)])
        left = left[~led]
    return at, keys, near, far, after, left


def leads(j: np.ndarray, at: np.ndarray, near: np.ndarray, far: np.ndarray, after: np.ndarray, length: int, key: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the kept triggers of a text (``j`` rising): position, nearest and farthest start, in steps of distance.

    No repeated string holds the key of a trigger that isn't kept, so strings end before the first such key does.
    """
    off = np.concatenate([j[1:] != j[:-1] + 1, [True]])[: len(j)] | (after < 0)
    off |= np.concatenate([after[1:] < 0, [True]])[: len(j)]
    stops = np.flatnonzero(off)
    end = after[stops[np.searchsorted(stops, np.arange(len(j)))]] + key - 1
    near = np.where(after < 0, near, np.maximum(near, at + length - end))
    on = near <= far
    at, near, far = at[on], near[on], far[on]
    count = far // step - near // step + 1
    who = np.repeat(np.arange(len(at)), count)
    q = _ranges(near // step, far // step)
    return at[who], np.maximum(near[who], q * step), np.minimum(far[who], q * step + step - 1)


def covered(starts: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal byte runs [a, b) under strings that start in the given ranges."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(starts):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], hi + length)
        else:
            out.append((lo, hi + length))
    return out


def _some(count: int, df: DataFrame) -> DataFrame:
    return F.broadcast(df) if count <= MOST_BROADCAST else df


def _lists(xs: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    flat = np.concatenate(xs) if xs else np.zeros(0)
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in xs])]).astype(np.int32), pa.array(flat).cast(kind))


def suffix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, key: int = KEY, reach: int = REACH, every: int = EVERY, step: int = STEP, window: int = passages.WINDOW) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages``."""
    if not K <= key <= length - reach:
        raise ValueError("a string with a trigger within reach must hold that trigger's key")
    small_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), whole_text(text).alias("text"), F.sha2(whole_text(text), 256).alias("sha"))
    source = source.withColumn("digest", F.unhex("sha"))
    base = written(source.select("doc_id", "digest", F.octet_length("text").cast("bigint").alias("n_bytes")), "ledger")
    classes = written(base.groupBy("digest").agg(F.min("doc_id").alias("one"), F.count(F.lit(1)).alias("copies"), F.first("n_bytes").alias("n_bytes")), "classes")
    heavy = classes.where(F.col("copies") > HEAVY * base.count()).select("digest")
    spare = heavy_join(base.select("doc_id", "digest"), classes.where("copies > 1").select("digest", "one"), "digest", heavy).where("not (doc_id <=> one)")
    spare = written(spare.select(F.col("doc_id").alias("i"), F.col("digest").alias("d")).distinct(), "spare")
    texts = source.select("doc_id", "digest", "text")
    same = lambda i, d: F.col("digest").eqNullSafe(F.col(d)) & F.col("doc_id").eqNullSafe(F.col(i))
    single_texts = texts.join(_some(spare.count(), spare), same("i", "d"), "left_anti")

    def tell_parse(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = hashing.utf8(part.column(2))
                out = []
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    own = Text(data[a:b])
                    *found, left = parse(own, length, key, reach, every)
                    out.append((*found, left, own.hashes(left, left + length), Text(own.data, True).hashes(left, left + length)))
                at, keys, near, far, after, left, hashes, seconds = zip(*out, strict=True)
                word, words_at = hashing.words(data, offsets)
                who, anchor, p_lo, p_hi = passages.anchors(word, words_at, window, min(window, passages.ANCHOR))
                cut = np.searchsorted(who, np.arange(1, part.num_rows))
                led = [_lists(np.split(x, cut), kind) for x, kind in ((anchor.view(np.int64), pa.int64()), (p_lo, pa.int32()), (p_hi, pa.int32()))]
                lists = [_lists(at, pa.int32()), _lists([k.view(np.int64) for k in keys], pa.int64()), _lists(near, pa.int16()), _lists(far, pa.int16()), _lists(after, pa.int32()), _lists(left, pa.int32()), *(_lists([h.view(np.int64) for h in hs], pa.int64()) for hs in (hashes, seconds))]
                lists += [*led, pa.array(np.diff(words_at), pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], ["one", "digest", "at", "key", "near", "far", "after", "bare_at", "bare_hash", "bare_second", "anchor", "p_lo", "p_hi", "n_words"])

    shape = "one bigint, digest binary, at array<int>, key array<bigint>, near array<smallint>, far array<smallint>, after array<int>, bare_at array<int>, bare_hash array<bigint>, bare_second array<bigint>, anchor array<bigint>, p_lo array<int>, p_hi array<int>, n_words bigint"
    parsed = written(single_texts.mapInArrow(tell_parse, shape).withColumn("c", F.monotonically_increasing_id()), "parse")
    if parsed.groupBy("digest").count().where("count > 1").head(1):  # repeated rows
        parsed = written(parsed.dropDuplicates(["digest"]), "parse")
    named = parsed.select("c", "one", "digest")

    # 1. the dictionary: keys that occur twice; the kept triggers of each text
    twice = written(parsed.select(F.explode("key").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "dictionary")
    dealt = parsed.select("c", F.posexplode(F.arrays_zip("key", "at", "near", "far", "after")).alias("j", "x")).select("c", "x.key", F.struct("j", "x.at", "x.near", "x.far", "x.after").alias("t"))
    kept = dealt.join(_some(twice.count(), twice), "key").groupBy("c").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def tell_leads(batches):
        for batch in batches:
            out = []
            for ts in batch.column(1):
                t = ts.values
                out.append(leads(*(t.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)), length, key, step))
            lists = [_lists([o[k] for o in out], pa.int32()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["c", "at", "near", "far"])

    # runs of words whose anchor two texts have
    shared = parsed.select("c", F.explode("anchor").alias("anchor")).groupBy("anchor").agg(F.min("c").alias("one"), F.max("c").alias("two")).where("one < two").select("anchor")
    shared = written(shared, "anchors")
    runs = parsed.select("c", F.explode(F.arrays_zip("anchor", "p_lo", "p_hi")).alias("x")).select("c", "x.anchor", "x.p_lo", "x.p_hi").join(_some(shared.count(), shared), "anchor")
    runs = runs.groupBy("c").agg(F.collect_list(F.struct("anchor", "p_lo", "p_hi")).alias("runs"))

    led = kept.mapInArrow(tell_leads, "c bigint, at array<int>, near array<int>, far array<int>").where("size(at) > 0").join(runs, "c", "full_outer")
    none = F.array().cast("array<int>")
    led = led.select("c", *[F.coalesce(k, none).alias(k) for k in ("at", "near", "far")], F.coalesce("runs", F.array().cast("array<struct<anchor:bigint,p_lo:int,p_hi:int>>")).alias("runs"))
    led = written(led.join(named, "c"), "leads")
    n_led = led.count()
    wanted = led.select(F.col("one").alias("i"), F.col("digest").alias("d"))
    part = texts.join(_some(n_led, wanted), same("i", "d"), "left_semi").select("digest", "text").hint("merge").join(led, "digest").select("c", "text", "at", "near", "far", "runs")
    part = written(part.dropDuplicates(["c"]) if spare.head(1) and part.groupBy("c").count().where("count > 1").head(1) else part, "repetitive")

    def cores(near):
        return np.maximum(key, length - step * (near // step + 1) + 1)

    def tell_hulls(batches):
        for batch in batches:
            for some in slices(batch, "text"):
                data, offsets = hashing.utf8(some.column(1))
                out = []
                for i in range(some.num_rows):
                    own = Text(data[offsets[i] : offsets[i + 1]])
                    at, near, far = (some.column(k)[i].values.to_numpy().astype(np.int64) for k in (2, 3, 4))
                    hull, second, core = (np.zeros(len(at), np.uint64) for _ in range(3))
                    o = np.argsort(at - far, kind="stable")
                    hull[o] = own.hashes((at - far)[o], (at - near + length)[o])
                    second[o] = Text(own.data, True).hashes((at - far)[o], (at - near + length)[o])
                    o = np.argsort(at, kind="stable")
                    core[o] = own.hashes(at[o], (at + cores(near))[o])
                    core = hashing.mix(core + (near // step).astype(np.uint64))
                    out.append((np.full(len(at), some.column(0)[i].as_py()), np.arange(len(at)), at - far, at - near, hull.view(np.int64), second.view(np.int64), core.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], ["c", "j", "lo", "hi", "hull", "second", "core"])

    # 2. parse suffixes: each distinct hull with its count
    lists = part.select("c", "text", "at", "near", "far").where("size(at) > 0")
    hulls = written(lists.mapInArrow(tell_hulls, "c bigint, j bigint, lo bigint, hi bigint, hull bigint, second bigint, core bigint"), "hulls")
    distinct = written(hulls.groupBy("hull", "second").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("c", "j")).alias("at"), F.min("core").alias("core")), "suffixes")
    settled = hulls.join(distinct.where("n > 1").select("hull", "second"), ["hull", "second"]).select("c", "lo", "hi")

    # 3. ends of repeats: hulls that occur once beside others of the same core
    mixed = distinct.groupBy("core").agg(F.count(F.lit(1)).alias("hulls"), F.min("n").alias("least")).where("hulls > 1 and least = 1").select("core")
    open_ = distinct.join(mixed, "core").select(F.col("at.c").alias("c"), F.struct(F.col("at.j").alias("j"), (F.col("n") == 1).alias("alone")).alias("h"))
    open_ = written(open_.groupBy("c").agg(F.collect_list("h").alias("hs")), "open")

    def tell_contexts(batches):
        for batch in batches:
            for some in slices(batch, "text"):
                data, offsets = hashing.utf8(some.column(1))
                out = []
                for i in range(some.num_rows):
                    own = data[offsets[i] : offsets[i + 1]].tobytes()
                    at, near, far = (some.column(k)[i].values.to_numpy().astype(np.int64) for k in (2, 3, 4))
                    hs = some.column(5)[i].values
                    j, alone = hs.field(0).to_numpy(), hs.field(1).to_numpy(zero_copy_only=False)
                    c = some.column(0)[i].as_py()
                    out += [(c, h, t, n, f, x, own[t - f : t][::-1], own[t : t - n + length]) for h, t, n, f, x in zip(j.tolist(), at[j].tolist(), near[j].tolist(), far[j].tolist(), alone.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()))], ["c", "j", "at", "near", "far", "alone", "left", "right"])

    contexts = lists.join(open_, "c").select("c", "text", "at", "near", "far", "hs").mapInArrow(tell_contexts, "c bigint, j bigint, at bigint, near int, far int, alone boolean, left binary, right binary")
    contexts = written(contexts, "contexts")
    # the suffixes of dictionary phrases, told by what lies before their trigger, and those of the parse, by what follows it
    phrases = suffix_order.classes(contexts.select("c", "j", F.col("left").alias("body"), F.col("near").alias("lo"), F.col("far").alias("hi")), length)
    parses = suffix_order.classes(contexts.select("c", "j", F.col("right").alias("body"), (length - F.col("far")).alias("lo"), (length - F.col("near")).alias("hi")), length)
    both = contexts.select("c", "j", "at", "near", "alone").join(phrases.withColumnRenamed("classes", "phrase"), ["c", "j"]).join(parses.select("c", "j", F.reverse("classes").alias("parse")), ["c", "j"])
    ends = both.select("c", "at", "near", "alone", F.posexplode(F.arrays_zip("phrase", "parse")).alias("k", "x"))
    ends = ends.select("c", (F.col("at") - F.col("near") - F.col("k")).cast("int").alias("s"), "alone", (F.col("near") + F.col("k")).alias("d"), "x.phrase", "x.parse")
    # 4. strings without a trigger near
    bare_ = parsed.select("c", F.explode(F.arrays_zip("bare_at", "bare_hash", "bare_second")).alias("x"))
    bare_ = bare_.select("c", F.col("x.bare_at").alias("s"), F.lit(True).alias("alone"), F.lit(-1).alias("d"), F.col("x.bare_hash").alias("phrase"), F.col("x.bare_second").alias("parse"))
    strings = written(ends.unionByName(bare_), "strings")
    string = ["d", "phrase", "parse"]
    again = written(strings.groupBy(*string).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*string), "strings-twice")
    # this list grows as the strings do: the same sorted join at every size
    single = strings.where("alone").hint("merge").join(again, string).select("c", F.col("s").cast("bigint").alias("lo"), F.col("s").cast("bigint").alias("hi"))

    starts = settled.unionByName(single).groupBy("c").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("starts"))

    def remove(batches):
        for batch in batches:
            for some in slices(batch, "text"):
                out = []
                for text_, found in zip(some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True):
                    data = text_.encode()
                    runs = covered([(r["lo"], r["hi"]) for r in found], length)
                    left, sha = 0, hashlib.sha256()
                    for a, b in runs:
                        sha.update(data[left:a])
                        left = b
                    sha.update(data[left:])
                    out.append((sum(b - a for a, b in runs), len(runs), sha.hexdigest()))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.string())], ["digest", "n_removed", "n_spans", "kept_sha256"])

    starts = written(starts.join(named, "c").join(classes.where("copies = 1").select("digest"), "digest", "left_semi"), "starts")
    # texts whose repeats are bare strings only are fetched too
    late = written(starts.join(part.select("c"), "c", "left_anti").select(F.col("digest").alias("d"), F.col("one").alias("i"), "starts"), "late")
    missing = texts.join(_some(late.count(), late.select("i", "d")), same("i", "d"), "left_semi").hint("merge").join(late, F.col("digest") == F.col("d")).select("digest", "text", "starts")
    here = part.select("c", "text").join(starts.select("c", "digest", "starts"), "c").select("digest", "text", "starts")
    done = here.unionByName(missing).mapInArrow(remove, "digest binary, n_removed bigint, n_spans bigint, kept_sha256 string")
    full = classes.where(f"copies > 1 and n_bytes >= {length}").select("digest", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("bigint").alias("n_spans"), F.lit(EMPTY_SHA).alias("kept_sha256"))
    result = written(done.unionByName(full), "removed")

    # whole copies are one passage each
    told = _passages(part, named, window).join(classes.where("copies = 1").select("digest"), "digest", "left_semi")
    copies = parsed.where(F.col("n_words") >= window).select("digest", F.lit(1).cast("bigint").alias("n_passages")).join(classes.where("copies > 1").select("digest"), "digest", "left_semi")
    result = written(result.join(told.unionByName(copies), "digest", "full_outer"), "reported")
    out = heavy_join(base, result, "digest", heavy, "left")
    count = lambda x: F.coalesce(x, F.lit(0).cast("bigint")).alias(x)
    return out.select("doc_id", "n_bytes", count("n_removed"), count("n_spans"), F.coalesce("kept_sha256", F.lower(F.hex("digest"))).alias("kept_sha256"), count("n_passages"))


def _passages(part: DataFrame, named: DataFrame, window: int) -> DataFrame:
    """``digest, n_passages`` of the texts that share a run of ``window`` words with another text.

    Runs of one anchor that lie together are a hull. Equal hulls are one entry; one that two texts have settles its runs.
    The runs of hulls that one text has are held against those of one copy of each other hull of the same anchor.
    """

    def words_of(some):
        data, offsets = hashing.utf8(some.column(1))
        word, at = hashing.words(data, offsets)
        return [passages.Words(word[at[i] : at[i + 1]]) for i in range(some.num_rows)]

    def tell_hulls(batches):
        for batch in batches:
            for some in slices(batch, "text"):
                out = []
                for i, own in enumerate(words_of(some)):
                    rs = some.column(2)[i].values
                    anchor, lo, hi = (rs.field(k).to_numpy().astype(np.int64) for k in range(3))
                    out.append((np.full(len(lo), some.column(0)[i].as_py()), anchor, own.hashes(lo, hi + window).view(np.int64), lo, hi))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], ["c", "anchor", "hull", "lo", "hi"])

    held = part.where("size(runs) > 0")
    hulls = written(held.select("c", "text", "runs").mapInArrow(tell_hulls, "c bigint, anchor bigint, hull bigint, lo bigint, hi bigint"), "word-hulls")
    distinct = hulls.groupBy("anchor", "hull").agg(F.min(F.struct("c", "lo", "hi")).alias("at"), F.max("c").alias("last"))
    distinct = written(distinct.withColumn("alone", F.col("at.c") == F.col("last")), "word-hulls-distinct")
    settled = hulls.join(distinct.where("not alone").select("anchor", "hull"), ["anchor", "hull"]).select("c", "lo", "hi")
    mixed = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("hulls"), F.max("alone").alias("some")).where("hulls > 1 and some").select("anchor")
    open_ = distinct.join(mixed, "anchor").select(F.col("at.c").alias("c"), F.struct("at.lo", "at.hi", "anchor", "last").alias("h")).groupBy("c").agg(F.collect_list("h").alias("hs"))

    def tell_runs(batches):
        for batch in batches:
            for some in slices(batch, "text"):
                out = []
                for i, own in enumerate(words_of(some)):
                    hs = some.column(2)[i].values
                    lo, hi, anchor, last = (hs.field(k).to_numpy().astype(np.int64) for k in range(4))
                    s = _ranges(lo, hi)
                    n = hi - lo + 1
                    out.append((np.full(len(s), some.column(0)[i].as_py()), s, np.repeat(last, n), np.repeat(anchor, n), own.hashes(s, s + window).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], ["c", "s", "last", "anchor", "run"])

    strings = written(held.join(open_, "c").select("c", "text", "hs").mapInArrow(tell_runs, "c bigint, s bigint, last bigint, anchor bigint, run bigint"), "word-runs")
    again = strings.groupBy("anchor", "run").agg(F.min("c").alias("first"), F.max("last").alias("final")).where("first < final").select("anchor", "run")
    single = strings.where("c = last").hint("merge").join(again, ["anchor", "run"]).select("c", F.col("s").alias("lo"), F.col("s").alias("hi"))

    def count(batches):
        for batch in batches:
            n = [passages.runs([(r["lo"], r["hi"]) for r in rs], window) for rs in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["digest", "n_passages"])

    starts = settled.unionByName(single).groupBy("c").agg(F.collect_list(F.struct("lo", "hi")).alias("rs")).join(named, "c")
    return starts.select("digest", "rs").mapInArrow(count, "digest binary, n_passages bigint")


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
