"""Language identification by rank-order profiles of character n-grams.

A text's letters are lower-cased and split into words; each word, with a mark at either end, gives its n-grams of 1 to
``LONGEST`` characters. A profile is the ``PROFILE`` most frequent n-grams in order. A text is as far from a language as
the sum, over the n-grams of its own profile, of how far each is out of its place in the language's; an n-gram that the
language's profile lacks counts as ``PROFILE`` places.

Profiles are learned from at most about ``per_lang`` labelled texts a language (a documented bound; which ones is set by
a hash of the id), by sums of counts on the executors; the driver gets only the profiles.

Letters are characters of Unicode category L alone. Defined cases: a null text or one without a letter is ``und`` with
score 0; rows without a label or id are never learned from; with nothing to learn from all are ``und``; ties go to the
n-gram (in a text's profile, to its CRC-32) or language that sorts first; repeated rows get a row each; very long texts are
read whole; an empty table gives an empty result; other columns are ignored (``identified`` returns them).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.llm.common import keeps, slices, small_batches, starts

LONGEST, PROFILE, PER_LANG = 3, 400, 3000
#: Softmax width of normalised distances in the score, and the distance beyond which a text is like no learned language.
WIDTH, UNLIKE = 0.02, 0.95
WORD = re.compile(r"[^\W\d_]+")
_GRAMS: dict[str, np.ndarray] = {}
_MOST_CACHED = 100_000


keeps("language", _GRAMS.clear)


def grams(word: str) -> list[str]:
    w = f"_{word}_"
    return [w[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(w) - n + 1) if n > 1 or 0 < i < len(w) - 1]


def _ids(word: str) -> np.ndarray:
    found = _GRAMS.get(word)
    if found is None:
        if len(_GRAMS) >= _MOST_CACHED:
            _GRAMS.clear()
        if word.isascii():  # the n-grams are slices of the bytes, in any order
            w, crc, n = f"_{word}_".encode(), zlib.crc32, len(word) + 2
            found = [crc(w[i : i + k]) for k in range(2, LONGEST + 1) for i in range(n - k + 1)] + [crc(w[i : i + 1]) for i in range(1, n - 1)]
        else:
            found = [zlib.crc32(g.encode()) for g in grams(word)]
        found = _GRAMS[word] = np.array(found, np.uint64)
    return found


def words_of(text: str) -> Counter[str]:
    """The runs of letters of a text in lower case, with how often they occur."""
    seen = Counter(WORD.findall(text.lower()))
    for w in [w for w in seen if not w.isalpha()]:  # numbers that are no digits, such as fractions
        n = seen.pop(w)
        for part in "".join(c if c.isalpha() else " " for c in w).split():
            seen[part] += n
    return seen


def profile(text: str, most: int = PROFILE) -> np.ndarray:
    """Hashes of the most frequent n-grams of a text, in rank order."""
    seen = words_of(text)
    if not seen:
        return np.zeros(0, np.uint64)
    parts = [_ids(w) for w in seen]
    times = np.repeat(np.fromiter(seen.values(), np.uint64, len(seen)), [len(p) for p in parts])
    keys = (np.concatenate(parts) << np.uint64(32)) | times
    keys.sort()
    ids = keys >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    total = np.add.reduceat(keys & np.uint64(0xFFFFFFFF), first)
    order = ((np.uint64(0xFFFFFFFF) - np.minimum(total, np.uint64(0xFFFFFFFF))) << np.uint64(32)) | ids[first]
    order.sort()
    return order[:most] & np.uint64(0xFFFFFFFF)


class Profiles:
    """Learned profiles, arranged so that one lookup serves all languages."""

    def __init__(self, by_lang: dict[str, list[str]]):
        self.langs = sorted(by_lang)
        ranks = {lang: {zlib.crc32(g.encode()): r for r, g in enumerate(by_lang[lang])} for lang in self.langs}
        self.grams = np.array(sorted({g for r in ranks.values() for g in r}) or [0], np.uint64)
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -10 * PROFILE, np.int64)
        for k, lang in enumerate(self.langs):
            for g, r in ranks[lang].items():
                self.ranks[np.searchsorted(self.grams, np.uint64(g)), k] = r

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score from 0 to 1, and normalised out-of-place distance (1: nothing in its place)."""
        own = profile(text) if text else np.zeros(0, np.uint64)
        if not len(own) or not self.langs:
            return "und", 0.0, 1.0
        at = np.searchsorted(self.grams, own)
        at = np.where(self.grams[np.minimum(at, len(self.grams) - 1)] == own, at, len(self.grams))
        out = np.abs(self.ranks[at] - np.arange(len(own))[:, None])
        far = np.minimum(out, PROFILE).sum(0) / (len(own) * PROFILE)
        k = int(far.argmin())
        return self.langs[k], float(1 / np.exp(-(far - far[k]) / WIDTH).sum()), float(far[k])


def learn(rows: DataFrame, per_lang: int = PER_LANG) -> Profiles:
    """Profiles from ``doc_id, text, lang`` rows; rows with a null are left out."""
    known = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Profiles({})
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, per_lang / n)))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0
    sample = known.where(draw < share[F.col("lang")]).select("lang", "text")

    def count(batches):
        starts("language")
        for batch in batches:
            for part in slices(batch, "text"):
                by: dict[str, Counter] = defaultdict(Counter)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    by[lang].update(words_of(text or ""))
                total: Counter = Counter()
                for lang, words in by.items():
                    for w, n in words.items():
                        for g in grams(w):
                            total[lang, g] += n
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total]), pa.array([k[1] for k in total]), pa.array(list(total.values()), pa.int64())], ["lang", "gram", "n"])

    total = sample.mapInArrow(count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = total.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= PROFILE)
    by_lang: dict[str, list[str]] = {lang: [] for lang in sizes}
    for r in sorted(best.collect(), key=lambda r: r["r"]):
        by_lang[r["lang"]].append(r["gram"])
    return Profiles(by_lang)


def identify(rows: DataFrame, learned: Profiles) -> DataFrame:
    """``doc_id, lang_pred, score, distance`` of every row, from its text alone."""
    small_batches(rows.sparkSession)

    def run(batches):
        starts("language")
        for batch in batches:
            for part in slices(batch, "text"):
                out = [learned.predict(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([o[0] for o in out]), pa.array([o[1] for o in out]), pa.array([o[2] for o in out])], ["doc_id", "lang_pred", "score", "distance"])

    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double, distance double")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identified(docs: DataFrame, learned: Profiles, unlike: float = UNLIKE) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is in a learned language."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        starts("language")
        for batch in batches:
            for part in slices(batch, "text"):
                seen = [learned.predict(t) for t in part.column(at).to_pylist()]
                yield part.filter(pa.array([lang != "und" and far <= unlike for lang, _, far in seen], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    learned = learn(docs.where(~held_out()))
    return identify(docs, learned).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "distance")
