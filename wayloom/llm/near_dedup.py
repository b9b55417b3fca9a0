"""Near-duplicate detection by ProbMinHash, banding and verification.

A text is the weighted set of its runs of ``WORDS`` words, weighed by how often they occur. ProbMinHash: each element
sends a Poisson process of arrivals, at a rate that is its weight, to random registers; a register keeps the element
that arrives first; a text is done once no element's next arrival can beat its latest register. Two signatures agree in
a register with the probability Jaccard similarity of the texts.

``BANDS`` bands of ``ROWS`` registers make buckets (a pair at 0.8 is missed by all bands with a chance of 8e-6). Texts
with the same words are one class, represented by one of its rows. Classes that share a bucket are candidates; a link is
a candidate pair whose exact probability Jaccard similarity is ``LEAST`` or more. Groups are the connected components:

1. each class is compared with the smallest of the hubs (smallest member) of its buckets;
2. where hub and member of a bucket are still in different groups, with each of the hubs;
3. buckets that still hold more than one group are open. The members of those over ``BLOCK`` are compared with ``GUIDES``
   of their members, which links most of what belongs together;
4. in what is then open every member is compared with every member of another group. A larger bucket is dealt into tiles
   of about ``BLOCK`` members, and each pair of tiles is a unit of work; two tiles of one group aren't compared. Of each two
   groups the likest pair is verified first, then all near pairs of groups that are still apart.

Comparisons in steps 3 and 4 are of signatures first, ``SEEN`` registers of them: a pair at 0.8 falls under ``NEAR`` with a chance
of 1e-5. Rows are told and fetched by their locators.

Defined cases: null text is empty; texts without a word are copies of each other; a text of fewer words than a run has
one run; very long texts are read whole; rows with a null id are compared like others and lead a group only where all ids
are null; of each group one row stays, told by its locator; repeated rows are copies; an empty table gives an empty
result; other columns are ignored (``deduplicated`` returns them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayloom.llm import hashing
from wayloom.llm.common import HEAVY, heavy_join, located, rows_of_files, slices, small_batches, starts, whole_text, without, written

WORDS, LEAST, BANDS, ROWS = 5, 0.8, 64, 8
REGISTERS, SEEN, NEAR, BLOCK, GUIDES = 1024, 1024, 0.745, 512, 16
#: Lists of locators and labels up to this many rows (24 bytes each) are broadcast; longer ones are shuffled.
MOST_BROADCAST = 500_000
#: Rows of ids, and pairs of texts, that are worth a task of their own: short tables are not dealt over every partition.
TASK_ROWS, TASK_PAIRS = 1 << 15, 64


def weighted(runs: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements of each text with their weights: (text, element, weight), by text and element."""
    owner = np.repeat(np.arange(len(to) - 1), np.diff(to))
    order = np.lexsort((runs, owner))
    owner, runs = owner[order], runs[order]
    first = np.flatnonzero(np.concatenate([[True], (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])])) if len(runs) else np.zeros(0, np.int64)
    weights = np.diff(np.concatenate([first, [len(runs)]]))
    return owner[first], runs[first], weights.astype(np.float64)


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """The element that each register of each text keeps: (texts, registers) of uint64; 0 for a text without elements.

    ``registers`` is a power of two, at most 2048.
    """
    times = np.full(texts * registers, np.inf)
    kept = np.zeros(texts * registers, np.uint64)
    now = np.zeros(len(element))
    step, block = 0, 1
    golden = np.uint64(0x9E3779B97F4A7C15)
    latest = np.full(texts, np.inf)
    while len(element):
        wide = max(1, min(block, (1 << 19) // len(element)))
        with np.errstate(over="ignore"):
            ticks = np.arange(step + 1, step + wide + 1, dtype=np.uint64) * golden
            bits = hashing.mix(element[:, None] + ticks[None, :])
        gaps = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / weight[:, None]
        arrive = now[:, None] + np.cumsum(gaps, axis=1)
        now = arrive[:, -1]
        soon = arrive < latest[owner][:, None]
        at = np.nonzero(soon)
        when, who = arrive[at], at[0]
        slot = owner[who] * registers + (bits[at] & np.uint64(registers - 1)).astype(np.int64)
        np.minimum.at(times, slot, when)
        won = when == times[slot]
        kept[slot[won]] = element[who[won]]
        latest = times.reshape(texts, registers).max(1)
        on = now < latest[owner]
        owner, element, weight, now = owner[on], element[on], weight[on], now[on]
        step += wide
        block *= 2
    return kept.reshape(texts, registers)


def band_keys(signature: np.ndarray, bands: int = BANDS, width: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each text: (texts, bands) of int64."""
    rows = signature[:, : bands * width].reshape(len(signature), bands, width)
    key = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :], len(signature), 0)
    with np.errstate(over="ignore"):
        for k in range(rows.shape[2]):
            key = hashing.mix(key * hashing.WORD_BASE + rows[:, :, k])
    return key.view(np.int64)


def probability_jaccard(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact similarity of two weighted sets, each as sorted distinct elements and weights."""
    if not len(x[0]) or not len(y[0]):
        return float(len(x[0]) == len(y[0]))
    every = np.union1d(x[0], y[0])
    a, b = np.zeros(len(every)), np.zeros(len(every))
    a[np.searchsorted(every, x[0])] = x[1]
    b[np.searchsorted(every, y[0])] = y[1]
    # sum over e of max(a_e, r b_e) for each r = a_d / b_d: sorted by a/b, those from r on give a, those before r b
    ratio = np.where(b > 0, a / np.where(b > 0, b, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    low = np.concatenate([[0], np.cumsum(b[order])])
    high = a.sum() - np.concatenate([[0], np.cumsum(a[order])])
    both = (a > 0) & (b > 0)
    at = np.searchsorted(ratio[order], ratio[both], "left")
    return float((a[both] / (high[at] + low[at] * ratio[both])).sum())


def _elements(texts: pa.Array):
    data, offsets = hashing.utf8(texts)
    word, at = hashing.words(data, offsets)
    return word, at, *weighted(*hashing.shingles(word, at, WORDS))


def sketch(docs: DataFrame) -> DataFrame:
    """``f, row, words_digest, bands`` of ``text, f, row, doc_id`` rows, and the id."""

    def run(batches):
        starts("near")
        for batch in batches:
            for part in slices(batch, "text"):
                word, at, owner, element, weight = _elements(part.column(0))
                n = part.num_rows
                keys = band_keys(signatures(owner, element, weight, n))
                digests = [hashlib.blake2b(word[at[i] : at[i + 1]].tobytes(), digest_size=16).digest() for i in range(n)]
                has = np.diff(at) > 0
                bands = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(has * BANDS)]).astype(np.int32), pa.array(keys[has].ravel()))
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), part.column(3), pa.array(digests, pa.binary()), bands], ["f", "row", "doc_id", "words_digest", "bands"])

    return docs.select("text", "f", "row", "doc_id").mapInArrow(run, "f bigint, row bigint, doc_id bigint, words_digest binary, bands array<bigint>")


def signature_bytes(held: DataFrame, bands: int = BANDS, width: int = ROWS) -> DataFrame:
    """``id, bytes, keys`` of ``id, text`` rows: a byte of each of ``SEEN`` registers, for estimates, and the bands' keys."""

    def run(batches):
        starts("near")
        for batch in batches:
            for part in slices(batch, "text"):
                signature = signatures(*_elements(part.column(1))[2:], part.num_rows)
                keys = band_keys(signature, bands, width)
                lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), pa.array(keys.ravel()))
                seen = pa.array([x.tobytes() for x in hashing.mix(signature[:, -SEEN:]).astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), seen, lists], ["id", "bytes", "keys"])

    return held.select("id", "text").mapInArrow(run, "id bigint, bytes binary, keys array<bigint>")


def _heavy(rows: DataFrame, column: str) -> DataFrame:
    """The values of ``column`` that more than the share ``HEAVY`` of the rows have."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HEAVY * rows.count()).select(column)


def verified(pairs: DataFrame, held: DataFrame, least: float = LEAST) -> DataFrame:
    """The pairs ``a, b`` of ids whose texts are alike, with their similarity."""
    pairs = written(pairs.select("a", "b"), "near-pairs")
    if not pairs.head(1):
        return pairs.withColumn("similarity", F.lit(None).cast("double"))

    def run(batches):
        starts("near")
        for batch in batches:
            for part in slices(batch, "text_a"):
                both = [_elements(part.column(k)) for k in (2, 3)]
                bounds = [np.searchsorted(x[2], np.arange(part.num_rows + 1)) for x in both]
                alike = np.array([probability_jaccard(*((x[3][at[i] : at[i + 1]], x[4][at[i] : at[i + 1]]) for x, at in zip(both, bounds, strict=True))) for i in range(part.num_rows)])
                on = np.flatnonzero(alike >= least - 1e-12)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(on)), part.column(1).take(pa.array(on)), pa.array(alike[on])], ["a", "b", "similarity"])

    one = heavy_join(pairs, held.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a", _heavy(pairs, "a"))
    two = heavy_join(one, held.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b", _heavy(pairs, "b"))
    return two.select("a", "b", "text_a", "text_b").coalesce(1 + pairs.count() // TASK_PAIRS).mapInArrow(run, "a bigint, b bigint, similarity double")


def _looked_up(many: DataFrame, one: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """``many`` joined with the written table ``one``, which has one row a key: broadcast if it is counted to be short."""
    if one.count() <= MOST_BROADCAST:
        return many.join(F.broadcast(one), on, how)
    return heavy_join(many, one, on, _heavy(many, on), how)


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node that each node of the edges ``a, b`` is connected with.

    Nodes are edges to themselves, so that one sum gives both a node's label and the least of its neighbours'.
    """
    ends = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    tasks = 1 + edges.count() // TASK_ROWS
    both = written(ends.unionByName(ends.select("a", F.col("a").alias("b"))).distinct().coalesce(tasks), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).coalesce(tasks), "labels")
    while True:
        near = _looked_up(both, labels.select(F.col("node").alias("b"), F.col("label").alias("other")), "b")
        own = F.max(F.when(F.col("a") == F.col("b"), F.col("other")))
        step = written(near.groupBy(F.col("a").alias("node")).agg(F.min("other").alias("at"), own.alias("old")).coalesce(tasks), "step")
        jump = _looked_up(step, step.select(F.col("node").alias("at"), F.col("at").alias("label")), "at")
        new = written(jump.select("node", "old", "label"), "labels")
        labels = new.select("node", "label")
        if not new.where("old <> label").head(1):
            return labels


def linked(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The groups ``node, label`` when ``edges`` connect them further: components of the groups, not of all nodes anew."""
    bridges = _labelled(_labelled(edges.select("a", "b"), labels, "a", "own"), labels, "b", "theirs").where("own <> theirs")
    bridges = written(bridges.select(F.col("own").alias("a"), F.col("theirs").alias("b")).distinct().coalesce(1 + edges.count() // TASK_ROWS), "near-bridges")
    if not bridges.head(1):
        return labels
    groups = components(bridges)
    moved = _looked_up(labels, groups.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
    moved = moved.select("node", F.coalesce("to", "label").alias("label"))
    return written(moved.unionByName(groups.join(labels.select("node"), "node", "left_anti")), "labels")


def _near(seen: np.ndarray, own: np.ndarray) -> np.ndarray:
    """How alike signatures are to one, from bytes that agree by chance once in 256."""
    return ((seen == own).mean(-1) - 1 / 256) / (255 / 256)


def _units(rows: DataFrame) -> DataFrame:
    """``key, unit, side, id`` of the rows ``key, id, own, n`` of open buckets: which members are compared with which.

    Members of side 0 are compared with each other, those of side 1 with those of side 2. A bucket of up to ``BLOCK``
    members is one unit. A larger one is dealt into tiles, those of a large group apart from the others, and two tiles
    are a unit; so each two members of different groups meet in one unit of a bucket.
    """
    parts = rows.where(F.col("n") <= BLOCK).select("key", F.lit("").alias("unit"), F.lit(0).alias("side"), "id")
    large = rows.where(F.col("n") > BLOCK).select(F.struct("key", "own").alias("group"), "id")
    if not large.head(1):
        return parts
    tiles = lambda n: F.ceil(F.col(n) / BLOCK).cast("bigint")
    groups = large.groupBy("group").agg(F.count(F.lit(1)).alias("c")).withColumn("alone", F.col("c") > BLOCK // 2)
    groups = written(groups, "near-groups-of-buckets")
    rest = groups.where("not alone").groupBy("group.key").agg(F.sum("c").alias("c"))
    names = groups.where("alone").select("group.key", F.col("group.own").alias("of"), "c").unionByName(rest.select("key", F.lit(None).cast("bigint").alias("of"), "c"))
    names = written(names.withColumn("tiles", tiles("c")), "near-tiles")
    every = names.select("key", "of", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)).alias("sub"))
    every = every.select("key", F.struct(F.col("of").isNull().alias("mixed"), "of", "sub").alias("tile"))
    two = every.join(every.select("key", F.col("tile").alias("other")), "key").where("tile <= other and (tile.mixed or other.mixed or tile.of <> other.of)")
    name = F.concat_ws("/", *[F.coalesce(c.cast("string"), F.lit("-")) for c in (F.col("tile.of"), F.col("tile.sub"), F.col("other.of"), F.col("other.sub"))])
    two = two.withColumn("unit", name)
    sides = two.select("key", "tile", "unit", F.when(F.col("tile") == F.col("other"), 0).otherwise(1).alias("side"))
    sides = sides.unionByName(two.where("tile <> other").select("key", F.col("other").alias("tile"), "unit", F.lit(2).alias("side")))
    sides = written(sides.groupBy(F.struct("key", "tile").alias("at")).agg(F.collect_list(F.struct("unit", "side")).alias("units")), "near-units")
    mixed = written(names.where("of is null").select("key", F.col("tiles").alias("m")), "near-mixed")
    placed = _looked_up(large, groups, "group").select(F.col("group.key").alias("key"), F.col("group.own").alias("own"), "id", "alone", tiles("c").alias("c"))
    placed = _looked_up(placed, mixed, "key", "left")
    sub = F.when(F.col("alone"), F.pmod(F.xxhash64("id"), F.col("c"))).otherwise(F.pmod(F.xxhash64("own"), F.col("m")))
    tile = F.struct((~F.col("alone")).alias("mixed"), F.when(F.col("alone"), F.col("own")).alias("of"), sub.alias("sub"))
    placed = written(placed.select("id", F.struct("key", tile.alias("tile")).alias("at")), "near-placed")
    dealt = _looked_up(placed, sides, "at").select("at.key", "id", F.explode("units").alias("u"))
    return parts.unionByName(dealt.select("key", "u.unit", "u.side", "id"))


def block_pairs(rows: DataFrame, near: float = NEAR, likest: bool = False) -> DataFrame:
    """Pairs ``a, b`` of different groups that share a bucket and whose signatures are near.

    ``rows``: ``id, own, bytes, units``, a unit being ``key, unit, side``. A pair is told in the least of the buckets that
    it shares. ``likest``: of each two groups only the pair whose signatures agree most.
    """

    def compare(group):
        ids, own = (np.array([r[k] for r in group]) for k in (3, 4))
        seen = np.frombuffer(b"".join(r[5] for r in group), np.uint8).reshape(len(group), -1)
        keys, here = [set(r[6]) for r in group], group[0][0]
        side = np.array([r[2] for r in group])
        ones, twos = (np.arange(len(group)),) * 2 if side[0] == 0 else (np.flatnonzero(side == s) for s in (1, 2))
        out, best = [], {}
        for i in ones:
            rest = twos[twos > i] if side[0] == 0 else twos
            rest = rest[own[rest] != own[i]]
            if len(rest):
                alike = _near(seen[rest], seen[i])
                on = np.flatnonzero(alike >= near)
                if likest:
                    for j, much in zip(rest[on].tolist(), alike[on].tolist(), strict=True):
                        of = (min(own[i], own[j]), max(own[i], own[j]))
                        if much > best.get(of, (0.0,))[0]:
                            best[of] = (much, i, j)
                else:
                    out += [(i, j) for j in rest[on] if min(keys[i] & keys[j]) == here]
        if likest:
            return [(min(ids[i], ids[j]), max(ids[i], ids[j]), *of, much) for of, (much, i, j) in best.items()]
        return [(min(ids[i], ids[j]), max(ids[i], ids[j]), min(own[i], own[j]), max(own[i], own[j]), 0.0) for i, j in out]

    def run(batches):
        starts("near")
        names, kinds = ["a", "b", "one", "two", "alike"], [pa.int64()] * 4 + [pa.float64()]
        told = lambda found: pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], names)
        group, at = [], None
        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != at:
                    found += compare(group) if len(group) > 1 else []
                    group, at = [], row[:2]
                group.append(row)
            yield told(found)
        yield told(compare(group) if len(group) > 1 else [])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("id", "own", "bytes", F.array_distinct("units.key").alias("keys"), F.explode("units").alias("u")).select("u.*", "id", "own", "bytes", "keys")
    found = rows.repartition(parts, "key", "unit").sortWithinPartitions("key", "unit").mapInArrow(run, "a bigint, b bigint, one bigint, two bigint, alike double")
    if likest:
        return found.groupBy("one", "two").agg(F.max(F.struct("alike", "a", "b")).alias("p")).select("p.a", "p.b")
    return found.select("a", "b")


def guide_pairs(rows: DataFrame, near: float = NEAR) -> DataFrame:
    """Pairs of each row with those of ``GUIDES`` rows of its bucket, taken by a hash, that are of other groups and near."""
    order = Window.partitionBy("key").orderBy(F.xxhash64("key", "id"), "id")
    guides = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= GUIDES)
    guides = guides.groupBy("key").agg(F.collect_list(F.struct("id", "own", "bytes")).alias("guides"))

    def run(batches):
        starts("near")
        for batch in batches:
            found = []
            for i, own, seen, guides_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                others = [g for g in guides_ if g["own"] != own]
                if others:
                    held = np.frombuffer(b"".join(g["bytes"] for g in others), np.uint8).reshape(len(others), -1)
                    found += [(min(i, others[k]["id"]), max(i, others[k]["id"])) for k in np.flatnonzero(_near(held, np.frombuffer(seen, np.uint8)) >= near)]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return heavy_join(rows, guides, "key", _heavy(rows, "key")).select("id", "own", "bytes", "guides").mapInArrow(run, "a bigint, b bigint")


def open_pairs(rows: DataFrame, held: DataFrame, link: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Candidate pairs across the groups of open buckets: ``rows`` are ``key, id, own, n``, ``n`` the bucket's size.

    ``link`` takes the pairs of a step and returns the groups that they leave; buckets that all but the guides' close go
    no further (large ones that the guides close have no units).
    The last step leaves out nothing: it tells every near pair of groups that are still apart. Without ``link`` it is all.
    """
    # signatures of the few texts in such buckets are made again, which is less than to keep all
    ids = written(rows.select("id").distinct().coalesce(1 + rows.count() // TASK_ROWS), "near-open-ids")
    seen = written(signature_bytes(held.join(F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids, "id", "left_semi")).select("id", "bytes"), "near-open-bytes")
    out = None
    for step in ("guides", "likest", "all") if link else ("all",):
        if step == "guides":
            large = rows.where(F.col("n") > BLOCK)
            if not large.head(1):
                continue
            pairs = guide_pairs(written(large.join(seen, "id").select("key", "id", "own", "bytes"), "near-large"))
        else:
            units = _units(rows).groupBy("id").agg(F.collect_list(F.struct("key", "unit", "side")).alias("units"))
            own = rows.groupBy("id").agg(F.first("own").alias("own"))
            pairs = block_pairs(units.join(own, "id").join(seen, "id"), likest=step == "likest")
        pairs = pairs.distinct()
        pairs = written(pairs if out is None else pairs.join(out, ["a", "b"], "left_anti"), "near-found")
        out = pairs if out is None else out.unionByName(pairs)
        if link:
            labels = link(pairs)
            rows = written(_labelled(rows.drop("own"), labels, "id", "own").select("key", "id", "own", "n"), "near-open") if step == "guides" else rows
            rows = _open(_labelled(rows.drop("own"), labels, "id", "own")) if step == "likest" else rows
            if not rows.head(1):
                break
    return out


def _open(rows: DataFrame) -> DataFrame:
    """The rows ``key, id, own, n`` of buckets that hold more than one group."""
    mixed = rows.groupBy("key").agg(F.min("own").alias("one"), F.max("own").alias("two")).where("one <> two").select("key")
    return written(rows.join(mixed, "key", "left_semi").select("key", "id", "own", "n").coalesce(1 + rows.count() // TASK_ROWS), "near-open")


def _labelled(rows: DataFrame, labels: DataFrame, column: str, to: str) -> DataFrame:
    named = labels.select(F.col("node").alias(column), F.col("label").alias(to))
    return _looked_up(rows, named, column, "left").withColumn(to, F.coalesce(to, column))


def _verdict(docs: DataFrame, doc_id: str, text: str, least: float) -> DataFrame:
    """``doc_id, f, row, class_id, group_id, group_size, kept`` of every row."""
    small_batches(docs.sparkSession)
    texts = located(docs, F.col(doc_id).cast("bigint").alias("doc_id"), whole_text(text).alias("text"))
    rows = written(sketch(texts).withColumn("place", F.monotonically_increasing_id()), "near-sketch")
    total = rows.count()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "f", "row"))
    classes = rows.groupBy("words_digest").agg(F.min("place").alias("node"), F.count(F.lit(1)).alias("copies"), first["doc_id"].alias("class_id"))
    classes = written(classes, "near-classes")
    many = classes.where(F.col("copies") > HEAVY * total)
    members = heavy_join(rows.select("doc_id", "f", "row", "words_digest"), classes, "words_digest", many.select("words_digest")).drop("words_digest", "copies")
    members = written(members, "near-members")

    leaders = rows.join(classes.select(F.col("node").alias("place")), "place", "left_semi")
    dealt = leaders.select(F.col("place").alias("id"), F.explode("bands").alias("key"))
    hubs = dealt.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = written(dealt.join(hubs, "key"), "near-buckets")

    ids = buckets.select(F.col("id").alias("place")).distinct()
    ids = written(rows.select("place", "f", "row").join(ids, "place").withColumnRenamed("place", "id"), "near-ids")
    held = written(texts.select("f", "row", "text").join(F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids, ["f", "row"]).select("id", "text"), "near-texts")

    pairs = buckets.where("hub < id").groupBy("id").agg(F.min("hub").alias("hub")).select(F.col("hub").alias("a"), F.col("id").alias("b"))
    labels = components(written(verified(pairs, held, least), "near-edges"))

    led = written(buckets.where("hub < id").select("id", "hub").distinct(), "near-led")
    placed = written(_labelled(_labelled(led, labels, "id", "own"), labels, "hub", "theirs"), "near-hubs")
    pairs = placed.where("own <> theirs").select(F.col("hub").alias("a"), F.col("id").alias("b")).join(pairs, ["a", "b"], "left_anti")
    more = written(verified(pairs, held, least), "near-edges")
    labels = linked(labels, more)

    # what is left: buckets of more than one group
    known = placed.select(F.col("hub").alias("a"), F.col("id").alias("b"))

    def link(pairs: DataFrame) -> DataFrame:
        nonlocal labels
        labels = linked(labels, written(verified(pairs.join(known, ["a", "b"], "left_anti"), held, least), "near-edges"))
        return labels

    open_pairs(_open(_labelled(buckets, labels, "id", "own")), held, link)

    grouped = written(_labelled(members, labels, "node", "label"), "near-grouped")
    groups = written(grouped.groupBy("label").agg(F.count(F.lit(1)).alias("group_size"), first.alias("best")), "near-groups")
    out = heavy_join(grouped, groups, "label", groups.where(F.col("group_size") > HEAVY * total).select("label"))
    own = (F.col("f") == F.col("best.f")) & (F.col("row") == F.col("best.row"))
    return out.select("doc_id", "f", "row", "class_id", F.col("best.doc_id").alias("group_id"), "group_size", own.alias("kept"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """One row per input row: ``doc_id, class_id, group_id, group_size, kept``."""
    return _verdict(docs, doc_id, text, least).drop("f", "row")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns."""
    if not rows_of_files(docs):
        docs = written(docs, "source")
    gone = _verdict(docs, doc_id, text, least).where("not kept").select(F.col("f").alias("__f"), F.col("row").alias("__row"))
    return without(docs, written(gone, "gone"))


def op5_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
