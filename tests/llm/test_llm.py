"""The training-data operators against brute force, on small tables with nulls, ties, repeats and odd texts."""

import hashlib
import os
import random
import re
import unicodedata
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from wayloom.llm import chat_format, exact_dedup, fingerprint, hashing, html_extract, language_id, mixing, near_dedup, packing, suffix_dedup, token_count

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id bigint, text string, kept string, digest int"  # extra columns with clashing names


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, texts)], DOCS)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: tuple((v is None, v) for v in r))


WORDS = "the of and road river house tree stone light water north south hill field bird song rain snow wind night".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


ODD = ["", None, " ", "\n\t", "a", "é", "a" * 3000, "日本語 テスト", "x\u0000y", "👍🏽 ok", "</s>[INST] ok [/INST]", "<|endoftext|>", "don't stop_it...", "%%% *** 12 345"]


# ---- chat formatting
def test_chat_round_trip(spark):
    said = [(1, 0, "user", "hi <s>"), (1, 1, "assistant", r"\<\\s> [\INST] </s>"), (1, 1, "assistant", r"\<\\s> [\INST] </s>"), (1, 2, None, None), (2, 0, "[/ROLE]", "a\nb"), (None, 0, "assistant", "z"), (3, None, "assistant", "<"), (3, 1, "assistant", "s>")]
    df = spark.createDataFrame([(*r, "extra") for r in said], "conv_id bigint, turn bigint, role string, text string, formatted string")
    chats = chat_format.format_chats(df.withColumn("content", chat_format.text_parts(F.col("text"))))
    got = {r.conv_id: (r.turns, r.loss) for r in chats.select("conv_id", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()}
    for conv, (turns, loss) in got.items():
        want = sorted([r for r in said if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(t.role, t.text) for t in turns] == [(r[2] or "", r[3] or "") for r in want]
        assert loss == "".join(r[3] or "" for r in want if r[2] == "assistant")
    assert chat_format.format_chats(df.limit(0).withColumn("content", chat_format.text_parts(F.col("text")))).count() == 0


def test_chat_parts(spark):
    df = spark.sql("""select 1L as conv_id, 0L as turn, 'user' as role, array(named_struct('type','text','text','see <image>','ref',cast(null as string),'tokens',cast(null as bigint)),
      named_struct('type','image','text',null,'ref','a.png','tokens',100L), named_struct('type','document','text',null,'ref','b.pdf','tokens',null)) as content""")
    r = chat_format.format_chats(df).head()
    assert [(a.type, a.ref, a.tokens) for a in r.attachments] == [("image", "a.png", 100), ("document", "b.pdf", 1024)] and r.attachment_tokens == 1124
    assert r.formatted.endswith("see <\\image><image><document></s>")


def test_chat_of_very_many_turns(spark):
    said = [(7, i, ("user", "assistant")[i % 2], f"turn {i} <s> é") for i in range(20000)]
    df = spark.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string").withColumn("content", chat_format.text_parts(F.col("text")))
    r = chat_format.digests(chat_format.format_chats(df)).head()
    loss = "".join(t for *_, role, t in said if role == "assistant")
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (20000, len(loss), hashlib.sha256(loss.encode()).hexdigest())


# ---- exact dedup
@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    texts = [*ODD, "a b", "ab", "a  b", "ab ", None, "b"]
    digest = (lambda c: F.unhex(F.lpad(F.hex(F.char_length(c) % 2), 2, "0"))) if weak else exact_dedup.sha256
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs(spark, texts), digest=digest).collect()}
    norm = [(t or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"}) for t in texts]
    for i, t in enumerate(texts):
        same = [k for k in range(len(texts)) if norm[k] == norm[i]]
        keep = min(same, key=lambda k: (-len(texts[k] or ""), k))
        assert got[i] == (keep, len(same), keep == i), (i, t)
    assert exact_dedup.exact_dedup(docs(spark, texts).limit(0)).count() == 0


def test_exact_dedup_null_ids(spark):
    got = exact_dedup.exact_dedup(docs(spark, ["a", "a", "b", "b ", "c" * 100_000, "c" * 100_000], [None, 5, None, None, 8, 8])).collect()
    assert sorted((r.keep_id or -1, r.group_size, r.kept) for r in got) == [(-1, 2, False), (-1, 2, True), (5, 2, False), (5, 2, True), (8, 2, False), (8, 2, True)]
    assert {r.doc_id for r in got if r.keep_id == 5 and r.kept} == {5}


def test_exact_dedup_adds_to_a_kept_state(spark, tmp_path):
    rng = random.Random(31)
    texts = [rng.choice(["a", "b c", "bc", "d ", "", "e f g"]) + str(rng.randint(0, 9)) for _ in range(120)]
    whole = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs(spark, texts)).collect()}
    state = str(tmp_path / "state")
    first = {r.doc_id: r.group_size for r in exact_dedup.exact_dedup(docs(spark, texts[:70]), state_dir=state).collect()}
    assert first == {i: r.group_size for i, r in enumerate(sorted(exact_dedup.exact_dedup(docs(spark, texts[:70])).collect(), key=lambda r: r.doc_id))}
    docs(spark, texts[70:], range(70, 120)).write.parquet(str(tmp_path / "later"))
    later = exact_dedup.exact_dedup(spark.read.parquet(str(tmp_path / "later")), state_dir=state).collect()
    assert len(later) == 50 and {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in later} == {i: whole[i] for i in range(70, 120)}


def test_exact_dedup_keeps_rows_whole(spark):
    df = docs(spark, ["a", "a ", "b", "b", None], [None, 1, None, None, 3]).withColumn("f", F.lit("x")).withColumn("row", F.lit(1))
    out = exact_dedup.deduplicated(df)
    assert out.columns == df.columns and rows(out, "doc_id", "text", "f") == [(1, "a ", "x"), (3, None, "x"), (None, "b", "x")]
    assert exact_dedup.deduplicated(df.limit(0)).count() == 0


# ---- suffix dedup
@pytest.mark.parametrize("seed, length, key, reach, every", [(5, 100, 20, 60, 8), (6, 60, 16, 44, 32), (7, 100, 40, 60, 4)])
def test_suffix_dedup(spark, seed, length, key, reach, every):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(10, 300))) for _ in range(12)]
    texts = [*ODD, "a" * 90 + "b", "ab" * 100, *("".join(rng.choice(parts)[rng.randint(0, 5) :] for _ in range(rng.randint(1, 8))) for _ in range(60))]
    texts += texts[20:26]
    data = [(t or "").encode() for t in texts]
    seen = {}
    for b in data:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    want = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])[: len(gone)]).sum())
        want.append((len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    window, where = 2 + seed, {}
    spoken = [b.split() for b in data]
    for k, w in enumerate(spoken):
        for i in range(len(w) - window + 1):
            where.setdefault(tuple(w[i : i + window]), set()).add(k)
    for k, w in enumerate(spoken):
        ends = -1
        count = 0
        for i in range(len(w) - window + 1):
            if len(where[tuple(w[i : i + window])]) > 1:
                count += i > ends
                ends = i + window
        want[k] += (count,)
    assert sum(w[4] > 1 for w in want) > 3 and sum(w[4] == 0 for w in want) > 3
    got = suffix_dedup.suffix_dedup(docs(spark, texts), length=length, key=key, reach=reach, every=every, window=window)
    assert [tuple(r)[1:] for r in sorted(got.collect())] == want


def test_suffix_dedup_repeated_rows(spark):
    df = docs(spark, ["q" * 450 + "end"] * 2 + ["w" * 10], [1, 1, None])
    got = rows(suffix_dedup.suffix_dedup(df), "doc_id", "n_removed")
    assert got == [(1, 453), (1, 453), (None, 0)]
    assert suffix_dedup.suffix_dedup(df.limit(0)).count() == 0


# ---- packing and token counts
def test_packing(spark):
    rng = random.Random(1)
    texts = [*ODD, *(prose(rng, rng.randint(1, 400)) for _ in range(60)), "it's " * 3000]
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = token_count.tokenizer(path)
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    got = packing.pack(docs(spark, texts).repartition(5), path, window=256).collect()
    for i, ids in want.items():
        pieces = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert b"".join(r.ids for r in pieces) == np.array(ids, "<u4").tobytes() and all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(r.ids) and r.length == len(r.ids) // 4 for r in pieces)
        assert [r.start for r in pieces] == [sum(p.length for p in pieces[:k]) for k in range(len(pieces))]
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    last = max(by)
    for s, spans in by.items():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at == 256 or s == last
    assert packing.sequences(packing.pack(docs(spark, ["a b", "c"]), path, window=2)).count() == 3
    assert packing.pack(docs(spark, texts).limit(0), path).count() == 0


def test_word_cache_is_the_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = token_count.tokenizer(path)
    rng = random.Random(9)
    signs = ["a", "B", "é", "ß", "'s", "'", "_", ".", "...", "!", "12", "½", " ", "\n", " ", "\u0085", "\x1c", "<|endoftext|>", "日", "́", "don't", "<|"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    texts += ["don't Über", "über don", "ÀÉÞ × ÷ ß", None, "x" * 700_000 + " y"]
    assert packing.encode(path, pa.array(texts)) == [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_other_tokenizers_go_to_the_library(tmp_path):
    """A cased tokenizer that splits at white space: no words are lower-cased or put together."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    made = Tokenizer(models.BPE(vocab={"a": 0, "b": 1, "A": 2, "B": 3, "ab": 4}, merges=[("a", "b")]))
    made.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    path = str(tmp_path / "small.json")
    made.save(path)
    assert not packing.by_words(path) and packing.by_words(public_tokenizers.path("word_bpe_49k.json")) and not packing.by_words(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.encode(path, pa.array(["AB ab", None])) == [np.array([2, 3, 4], "<u4").tobytes(), b""]


def test_packing_of_long_texts_and_repeats(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["road of trees " * 40000, "a b", "a b", None]
    got = packing.pack(docs(spark, texts, [1, 2, 2, None]), path).collect()
    assert sum(r.length for r in got if r.doc_id == 1) == 120001 and sorted(r.length for r in got if r.doc_id == 2) == [3, 3] and [r.length for r in got if r.doc_id is None] == [1]


def test_token_counts(spark):
    rng = random.Random(2)
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [*ODD, prose(rng, 3000), "word " * 2000, "a  b\n\n " * 900, "nospace" * 900, "<|endoftext|> x " * 300]
    tok = token_count.tokenizer(path)
    got = {r.doc_id: r.n_tokens for r in token_count.token_counts(docs(spark, texts), path, chunk=400, overlap=8).collect()}
    assert got == {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    ids = [i for part in token_count.spans(lambda x: tok.encode(x, add_special_tokens=False), texts[-5], 300, 4) for i in part]
    assert ids == tok.encode(texts[-5], add_special_tokens=False).ids


# ---- near duplicates
def jp(a, b):
    """Probability Jaccard by its definition."""
    def weights(t):
        w = t.split()
        runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])
        return {r: runs.count(r) for r in runs}

    x, y = weights(a), weights(b)
    if not x or not y:
        return float(not x and not y)
    keys = x.keys() | y.keys()
    return sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in keys) for d in x.keys() & y.keys())


def test_near_duplicates(spark):
    rng = random.Random(11)
    texts = ["", None, " ", "one two", "one two", "one two three"]
    for _ in range(12):
        base = prose(rng, rng.randint(20, 120)).split()
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(WORDS) + "x"
            texts.append(" ".join(w) + rng.choice(["", "  "]))
    texts += ["again " * 40, "again " * 41, "again " * 90]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if jp(texts[i] or "", texts[j] or "") >= 0.8 - 1e-12:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = {r.doc_id: (r.group_id, r.group_size, r.kept) for r in near_dedup.near_duplicates(docs(spark, texts)).collect()}
    want = {i: (find(i), sum(find(k) == find(i) for k in range(len(texts))), find(i) == i) for i in range(len(texts))}
    assert got == want
    assert near_dedup.near_duplicates(docs(spark, texts).limit(0)).count() == 0


def test_near_duplicates_null_and_repeated_ids(spark):
    rng = random.Random(12)
    t = prose(rng, 60)
    table = docs(spark, [t, t, t + " more", t], [None, 7, 9, 7])
    got = rows(near_dedup.near_duplicates(table), "doc_id", "group_id", "group_size")
    assert got == [(7, 7, 4), (7, 7, 4), (9, 7, 4), (None, 7, 4)]
    assert near_dedup.deduplicated(table).count() == 1
    u = prose(rng, 50)
    table = docs(spark, [t, t + " more", u, u + " x", prose(rng, 5000), ""], [None, None, 3, 3, 4, None])
    out = near_dedup.deduplicated(table)
    assert out.columns == table.columns and out.count() == 4 and sorted(r.doc_id or 0 for r in out.collect()) == [0, 0, 3, 4]
    assert near_dedup.deduplicated(table.limit(0)).count() == 0


@pytest.mark.parametrize("most", [500_000, 0])
def test_components_linked(spark, monkeypatch, most):
    """Groups of edges that come in three parts, by broadcast and by shuffle, equal those of all edges at once."""
    monkeypatch.setattr(near_dedup, "MOST_BROADCAST", most)
    rng = random.Random(17)
    parts = [[(i, i + 1) for i in range(100, 130)] + [(0, k) for k in range(1, 40)], [(rng.randrange(200), rng.randrange(200)) for _ in range(30)], [(500, 90), (500, 130), (39, 38)]]
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    tables = [spark.createDataFrame(p, "a bigint, b bigint") for p in parts]
    labels = near_dedup.components(tables[0])
    for part, table in zip(parts, tables, strict=True):
        for x, y in part:
            low, high = sorted((find(x), find(y)))
            parent[high] = low
        labels = labels if table is tables[0] else near_dedup.linked(labels, table)
        got = rows(labels, "node", "label")
        assert dict(got) == {i: find(i) for i in parent if find(i) != i or (i, i) in got or any(find(k) == i and k != i for k in parent)}
        assert len(got) == len(dict(got))


@pytest.mark.parametrize("block", [512, 12])
def test_open_buckets(spark, monkeypatch, block):
    """Pairs across groups in buckets under and over the bound: as good as all near pairs are found, at either size."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "GUIDES", 4)
    rng = random.Random(13)
    texts = []
    for _ in range(4):
        base = prose(rng, 150).split()
        for _ in range(40):
            other = list(base)
            for _ in range(rng.randint(0, 2)):
                other[rng.randrange(len(other))] += "x"
            texts.append(" ".join(other))
    texts = list(dict.fromkeys(texts))
    held = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    ids = held.withColumn("own", F.col("id"))
    dealt = near_dedup.signature_bytes(held).select("id", F.explode("keys").alias("key")).join(ids.select("id", "own"), "id").cache()
    opened = dealt.join(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key")
    got = {tuple(r) for r in near_dedup.open_pairs(opened.select("key", "id", "own", "n"), held).collect()}
    runs = [runs_of(t) for t in texts]
    assert all(max(r.values()) == 1 for r in runs)  # then the similarity is that of sets
    sets = [r.keys() for r in runs]
    want = {(i, j) for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert len(want) > 500 and len(want & got) >= (0.999 if block > 100 else 0.9) * len(want)


def test_large_buckets_are_compared_whole(spark, monkeypatch):
    """Every two members of different groups meet in one unit of their bucket, and the one near pair among many is told."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "GUIDES", 1)
    own = [0] * 30 + [100] * 9 + [200 + k // 3 for k in range(14)] + list(range(300, 317))
    members = spark.createDataFrame([(k, i, g, n) for k, n, take in ((1, 70, 1), (2, 35, 2), (3, 7, 10)) for i, g in enumerate(own) if i % take == 0], "key bigint, id bigint, own bigint, n bigint")
    units = {}
    for r in near_dedup._units(members).collect():
        units.setdefault((r.key, r.unit), []).append((r.side, r.id))
    met = [(u[0], *sorted((i, j))) for u, rows_ in units.items() for s, i in rows_ for t, j in rows_ if own[i] != own[j] and ((s == t == 0 and i < j) or (s, t) == (1, 2))]
    want = {(k, i, j) for k, take in ((1, 1), (2, 2), (3, 10)) for j in range(0, 70, take) for i in range(0, j, take) if own[i] != own[j]}
    assert len(met) == len(set(met)) and set(met) == want

    rng = random.Random(19)
    texts = [prose(rng, 150) for _ in range(60)]
    texts[59] = texts[31] + " more"
    held = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    rows_ = held.selectExpr("5L as key", "id", "id as own", "60L as n")
    told = []

    def link(pairs):
        told.extend(map(tuple, pairs.collect()))
        return spark.createDataFrame([(31, 31), (59, 31)] if told else [], "node bigint, label bigint")

    near_dedup.open_pairs(rows_, held, link)
    assert told == [(31, 59)]


def test_probability_minhash_estimates():
    rng = np.random.default_rng(5)
    e = hashing.mix(np.arange(1, 400, dtype=np.uint64))
    x, y = (e[:300], rng.integers(1, 5, 300).astype(float)), (e[60:360], rng.integers(1, 5, 300).astype(float))
    owner = np.repeat([0, 1], 300)
    sig = near_dedup.signatures(owner, np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]]), 2)
    order = lambda s: (s[0][np.argsort(s[0])], s[1][np.argsort(s[0])])
    assert abs((sig[0] == sig[1]).mean() - near_dedup.probability_jaccard(order(x), order(y))) < 0.06
    one = near_dedup.signatures(np.array([0, 2]), e[:2], np.array([1.0, 3.0]), 3)
    assert (one[0] == e[0]).all() and (one[1] == 0).all() and (one[2] == e[1]).all()


# ---- HTML
PAGE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header><a href=/>Home</a></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
<article><h1>Title &amp; more</h1><p>First  <b>bold</b>ly said&nbsp;here.<br>next<p>Short.</p><div class="ad">Buy</div><ul><li>A point</li></ul><aside>side</aside><section id="comments"><p>Nice post!</p></section></article>
<form>name <input></form><footer>(c)</footer><!-- <p>gone</p> --></body>"""


def test_html():
    assert html_extract.main_text(PAGE) == "Title & more\n\nFirst boldly said here. next\n\nShort.\n\nA point"
    assert html_extract.main_text(None) == html_extract.main_text("") == ""
    long = "The road of the town and the river is there for the people of the land, and it was as it is to be in the house on the hill with the tree. " * 2
    page = f"<div class=menu><a href=x>Home</a></div><div><h2>Head</h2><p>{long}</p><p>Brief.</p><p>{long}</p></div><div><a href=1>x one</a> <a href=2>y two</a></div><div class='cookie-notice'>We use cookies</div>"
    assert html_extract.main_text(page) == f"Head\n\n{long.strip()}\n\nBrief.\n\n{long.strip()}"
    for broken in ("<", "<p", "<!--", "<script>", "</p></div>", "<p a='", "&#xZZ; &", "<div>" * 3000 + "x"):
        html_extract.main_text(broken)


class Tree(HTMLParser):
    """The main text of a page with an article by an independent reading: its paragraphs, headings and list items."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.on = self.off = 0
        self.out = []

    def handle_starttag(self, tag, attrs):
        if self.off or dict(attrs).get("class") in ("ad", "share", "comments", "related", "cookie", "newsletter") or tag in ("nav", "aside", "footer", "form", "script", "style", "header", "noscript", "button"):
            self.off += tag not in ("br", "img", "input", "meta", "link", "hr")
            return
        self.on += tag in ("article", "main")
        if tag == "br":
            self.out[-1:] = [self.out[-1] + " "] if self.out else []
        elif tag not in ("b", "i", "em", "strong", "span", "a", "u", "code"):
            self.out.append("")

    def handle_endtag(self, tag):
        if self.off:
            self.off -= 1
        elif tag in ("article", "main"):
            self.on -= 1
        elif tag not in ("b", "i", "em", "strong", "span", "a", "u", "code"):
            self.out.append("")

    def handle_data(self, data):
        if self.on and not self.off:
            self.out[-1] += data


def pages_of(folder):
    path = f"/root/testdata/{folder}/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables here")
    return pq.read_table(path)["html"].to_pylist()


def test_html_against_a_tree_of_each_page():
    same = []
    for page in pages_of("sf0.01"):
        tree = Tree()
        tree.feed(page)
        want = [" ".join(x.split()) for x in tree.out]
        same.append(html_extract.main_text(page) == "\n\n".join(x for x in want if x))
    assert np.mean(same) > 0.97


def test_html_without_its_marks():
    """With article and main renamed, the rules alone find the same blocks, and nothing of menus, adverts or footers."""
    found = missed = 0
    for page in pages_of("sf0.01"):
        whole = Counter(html_extract.main_text(page).split("\n\n"))
        bare = Counter(html_extract.main_text(re.sub(r"(?i)(</?)(article|main)\b", r"\1div", page)).split("\n\n"))
        found += sum(whole.values())
        missed += sum((whole - bare).values())
        assert not bare - whole
    assert found > 2000 and missed < 0.05 * found


def test_html_nested_deeply():
    long = "The road of the town and the river is there for the people of the land, and it was as it is to be in the house on the hill. " * 3
    page = lambda n: "<div>" * n + f"<nav><ul><li><a href=x>Menu of the site</a></ul></nav><p>{long}</p><h2><b><i><u>Head</u></i></b></h2><p>{long}</p>" + "</div>" * n
    assert html_extract.main_text(page(5000)) == html_extract.main_text(page(1)) == f"{long.strip()}\n\nHead\n\n{long.strip()}"
    assert html_extract.main_text(f"<p>{long}</p>" * 3000).count("\n\n") == 2999


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "plain words", "x")], "page_id bigint, url string, html string, text string")
    assert html_extract.extract(df).count() == 4
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(df).collect()}
    assert got[2] == ("", 0) and got[None] == ("plain words", 11) and got[1][1] == len(got[1][0])
    assert html_extract.extract(df.limit(0)).count() == 0


# ---- language
TONGUES = {"aa": "the of and that with from have this".split(), "bb": "der die und das nicht mit ein auf".split(), "cc": "que les dans pour une est sur avec".split()}


def test_language(spark):
    rng = random.Random(3)
    made = [(i, " ".join(rng.choice(TONGUES[lang]) for _ in range(rng.randint(5, 60))), lang) for i in range(300) for lang in [rng.choice(list(TONGUES))]]
    made += [(1000, None, "aa"), (1001, "123 %%", "bb"), (1002, "der die und", None), (None, "que les", "cc")]
    df = spark.createDataFrame(made, "doc_id bigint, text string, lang string")
    learned = language_id.learn(df.where(~language_id.held_out()))
    got = {r.doc_id: r for r in language_id.identify(df, learned).collect()}
    assert len(got) == len(made) and got[1000].lang_pred == got[1001].lang_pred == "und" and got[1001].score == 0 and got[1002].lang_pred == "bb"
    held = [(i, lang) for i, _, lang in made[:300] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 40 and np.mean([got[i].lang_pred == lang for i, lang in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    none = language_id.learn(df.limit(0))
    assert {r.lang_pred for r in language_id.identify(df, none).collect()} == {"und"}
    # the distance by its definition
    text = made[0][1]
    own = list(language_id.profile(text))
    far = []
    for k in range(len(learned.langs)):
        ranks = {int(g): int(learned.ranks[j, k]) for j, g in enumerate(learned.grams)}
        far.append(sum(min(language_id.PROFILE, abs(ranks.get(int(g), -10**6) - r)) for r, g in enumerate(own)) / (len(own) * language_id.PROFILE))
    assert learned.predict(text)[2] == pytest.approx(min(far))


def test_language_by_its_definition(spark):
    """Profiles, distances and predictions by counting n-grams one by one."""
    rng = random.Random(21)
    made = [(i, " ".join(rng.choice(TONGUES[lang]).title() for _ in range(rng.randint(1, 40))) + rng.choice(["", " ½ x²y Ⅻ 12é"]), lang) for i in range(120) for lang in [rng.choice(list(TONGUES))]]
    made += made[:5] + [(500, "½ ² Ⅻ 7 _", "aa"), (501, "the of " * 50000, "aa")]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in made], "doc_id bigint, text string, lang string, lang_pred string, score double")

    def counted(text):
        word, out = "", Counter()
        for c in text.lower() + " ":
            if unicodedata.category(c)[0] == "L":
                word += c
            elif word:
                w = f"_{word}_"
                out.update(w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1) if w[i : i + n] != "_")
                word = ""
        return out

    by = {}
    for _, text, lang in made:
        by.setdefault(lang, Counter()).update(counted(text))
    ranks = {lang: {g: r for r, g in enumerate(sorted(c, key=lambda g: (-c[g], g))[:400])} for lang, c in by.items()}
    got = {r.doc_id: (r.lang_pred, r.distance) for r in language_id.identify(df, language_id.learn(df)).collect()}
    for i, text, _ in made:
        c = counted(text)
        own = sorted(c, key=lambda g: (-c[g], zlib.crc32(g.encode())))[:400]
        if not own:
            assert got[i] == ("und", 1.0)
            continue
        far = {lang: sum(min(400, abs(rs.get(g, 10**6) - r)) for r, g in enumerate(own)) / (len(own) * 400) for lang, rs in ranks.items()}
        best = min(sorted(far), key=far.get)
        assert got[i][0] == best and got[i][1] == pytest.approx(far[best]), (i, text[:60])
    assert language_id.identified(df, language_id.learn(df)).columns == df.columns
    assert language_id.identify(df.limit(0), language_id.learn(df)).count() == 0


# ---- mixing
def test_mixing(spark):
    rng = random.Random(4)
    kinds = [rng.choices(["clean", "poor", "toxic"], [8, 2, 1])[0] for _ in range(400)]
    text = {"clean": lambda: prose(rng, 40), "poor": lambda: " | ".join(rng.choice(WORDS) for _ in range(40)), "toxic": lambda: prose(rng, 20) + " idiot " + prose(rng, 20)}
    df = spark.createDataFrame([(i, text[k]()) for i, k in enumerate(kinds)] + [(900, None), (None, "the of"), (901, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(k != "poor"), int(k == "toxic")) for i, k in enumerate(kinds) if i % 2] + [(None, 1, 0), (3, None, None), (5555, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = mixing.mix(df, mixing.label_domains(df, labels), targets=(0.7, 0.3, 0.0)).collect()
    assert len(got) == 403
    p, t, r = np.array([x.p for x in got]), np.array([x.n_tokens for x in got]), np.array([x.rate for x in got])
    assert (r >= 0).all() and np.allclose(p.sum(1), 1) and {x.n_tokens for x in got if x.doc_id in (900, 901)} == {0}
    mixed = (t * r) @ p
    assert np.abs(mixed / mixed.sum() - [0.7, 0.3, 0]).max() < 0.03
    held = [(x.p.index(max(x.p)), kinds[x.doc_id]) for x in got if x.doc_id is not None and x.doc_id < 400 and x.doc_id % 2 == 0]
    assert np.mean([mixing.DOMAINS[a] == b for a, b in held]) > 0.95
    assert mixing.mix(df.limit(0), mixing.label_domains(df.limit(0), labels)).count() == 0
    assert mixing.mix(df, mixing.label_domains(df, labels.limit(0))).count() == 403


@pytest.mark.parametrize("seed, goal", [(1, (0.6, 0.3, 0.1)), (2, (0.97, 0.03, 0.0)), (3, (0.05, 0.05, 0.9))])
def test_rates_are_nonnegative_least_squares(spark, seed, goal):
    """Against coordinate descent on the whole problem, one rate after the other."""
    rng = np.random.default_rng(seed)
    p, t = rng.dirichlet([0.3, 0.3, 0.3], 150), rng.integers(1, 100, 150).astype(float)
    ridge, w = 1e-2, t / t.sum()
    share = w @ p
    k = int(np.argmax(goal))
    want = np.array(goal) * share[k] / goal[k]
    r, m = np.ones(150), share.copy()
    for _ in range(3000):
        for d in range(150):
            slope = w[d] * ((m - want) / share) @ p[d] + ridge * w[d] * (r[d] - 1)
            new = max(0.0, r[d] - slope / (w[d] ** 2 * (p[d] ** 2 / share).sum() + ridge * w[d]))
            m += (new - r[d]) * w[d] * p[d]
            r[d] = new
    df = spark.createDataFrame([(i, int(t[i]), [float(x) for x in p[i]]) for i in range(150)], "doc_id bigint, n_tokens bigint, p array<double>").repartition(3)
    fitted = mixing.fit(df, goal, ridge=ridge)
    assert np.abs(fitted.rates(p) - r).max() < 1e-6 and fitted.miss < 1e-8 and (r == 0).any()
    assert np.abs(fitted.weights - m / m.sum()).max() < 1e-8


def test_mixing_draws_by_the_rate(spark):
    got = spark.range(20000).select(mixing.drawn(F.lit(0.3), F.col("id")).alias("a"), mixing.drawn(F.lit(1.0), F.col("id")).alias("b"), mixing.drawn(F.lit(0.0), F.col("id")).alias("c")).agg(*[F.avg(F.col(x).cast("int")) for x in "abc"]).head()
    assert abs(got[0] - 0.3) < 0.02 and got[1] == 1 and got[2] == 0


def test_mixing_of_repeats_and_clashing_columns(spark):
    rng = random.Random(14)
    kinds = [rng.choice(["clean", "poor"]) for _ in range(120)]
    rows = [(i, prose(rng, 30) if k == "clean" else " | ".join(rng.choice(WORDS) for _ in range(30)), "x", 1.5, "y") for i, k in enumerate(kinds)]
    df = spark.createDataFrame(rows + rows[:10] * 3 + [(7, "the of " * 60000, "x", 1.0, "y")], "doc_id bigint, text string, p string, rate double, domain string")
    labels = spark.createDataFrame([(i, int(k == "clean"), 0) for i, k in enumerate(kinds)] * 2 + [(None, None, None)], "doc_id bigint, quality int, toxic int")
    assert mixing.label_domains(df, labels).count() == 120
    got = mixing.mix(df, mixing.label_domains(df, labels), targets=(0.5, 0.5, 0)).collect()
    assert len(got) == 151 and max(r.n_tokens for r in got) == 120000
    out = mixing.mixed(df, labels)
    assert out.columns == df.columns and 0 < out.count() <= 151
    assert mixing.mixed(df.limit(0), labels).count() == 0


# ---- fingerprints
def test_fingerprints(spark):
    rng = random.Random(6)
    texts = [*ODD, *("\n".join(prose(rng, rng.randint(4, 30)) for _ in range(rng.randint(1, 6))) for _ in range(50)), "tail"]
    ids = rng.sample(range(1000), len(texts))
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs(spark, texts, ids).repartition(3)).collect()}
    order = sorted(zip(ids, texts))
    long = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 4
        changed = t[: len(t) - n] + after[:n]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert r.fingerprint == fingerprint.encode(*fingerprint.vectors([t]))[0] and r.edited_fingerprint == fingerprint.encode(*fingerprint.vectors([changed]))[0]
        if len(t) > 300:
            long.append((r.near_edited, r.near_next))
    assert np.mean([a > b + 0.2 for a, b in long]) > 0.95
    assert fingerprint.fingerprints(docs(spark, ODD).limit(0)).count() == 0
    assert len(fingerprint.fingerprints(docs(spark, ["b", "a", "c"], [1, 1, None])).collect()) == 3


def runs_of(text):
    """Runs of five words of each paragraph, with how often they occur; a shorter paragraph is one run."""
    out = Counter()
    for line in text.split("\n"):
        w = line.split()
        out.update([tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else []))
    return out


def test_fingerprints_against_multisets():
    """Equal where the paragraphs are equal as multisets, alike as far as their runs of words are."""
    rng = random.Random(16)
    parts = [prose(rng, rng.randint(1, 30)) for _ in range(12)]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randint(0, 6))) for _ in range(300)] + [*WORDS, "", " \n\t"]
    v = fingerprint.vectors(texts)
    prints = fingerprint.encode(*v)
    exact = [tuple(sorted(tuple(y.split()) for y in t.split("\n") if y.split())) for t in texts]
    assert len(set(zip(prints, exact))) == len(set(prints)) == len(set(exact))
    miss = []
    for _ in range(2000):
        i, j = rng.randrange(len(texts)), rng.randrange(len(texts))
        a, b = runs_of(texts[i]), runs_of(texts[j])
        both = sum(x * x for x in a.values()) + sum(x * x for x in b.values())
        want = 2 * sum(n * b[r] for r, n in a.items()) / both if both else 1.0
        got = float(fingerprint.likeness((v[0][[i]], v[1][[i]]), (v[0][[j]], v[1][[j]]))[0])
        assert (got == 1) == (exact[i] == exact[j])
        miss.append(abs(got - want))
    assert np.mean(miss) < 0.03 and np.quantile(miss, 0.95) < 0.12


def test_fingerprints_of_long_texts_and_clashing_columns(spark):
    long = "\n".join(f"line {i} of a very long text" for i in range(60000))
    df = spark.createDataFrame([(1, long, "x", 2), (2, None, "y", 3), (None, "a b", "z", 4)], "doc_id bigint, text string, bucket string, ahead int")
    got = {r.doc_id: r for r in fingerprint.fingerprints(df).collect()}
    assert len(got) == 3 and got[1].n_chars == len(long) and got[1].edited_sha256 == hashlib.sha256(long[: len(long) - len(long) // 4].encode()).hexdigest() and got[1].near_edited > 0.7


def test_fingerprint_is_homomorphic():
    a, b, c = "one two three four five six", "seven eight", "nine ten eleven"
    f = lambda *lines: fingerprint.encode(*fingerprint.vectors(["\n".join(lines)]))[0]
    assert f(a, b, c) == f(c, a, b) != f(a, b, c, c)
    assert fingerprint.combine(f(a, b), (c,)) == f(a, b, c) and fingerprint.combine(f(a, b, c), (), (b,)) == f(a, c)
    assert f() == f("") == f(" ", "\t")


def test_fingerprint_of_a_line_repeated_very_often():
    line = "one two three four five"
    x, y = (fingerprint.vectors(["\n".join([line] * n)]) for n in (40_000, 32_000))
    assert abs(fingerprint.likeness(x, y)[0] - 2 * 40 * 32 / (40**2 + 32**2)) < 1e-9


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    rng = random.Random(8)
    texts = [prose(rng, rng.randint(0, 60)) for _ in range(40)] + ["", None, "x" * 90]
    data, offsets = hashing.utf8(pa.array(texts))
    whole = hashing.words(data, offsets)
    monkeypatch.setattr(hashing, "PIECE", 64)
    cut = hashing.words(data, offsets)
    assert (whole[1] == cut[1]).all() and (whole[0][:-1] == cut[0][:-1]).all()
