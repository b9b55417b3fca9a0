"""Exact token counts of texts of any length, by overlapping chunks.

A text up to ``chunk`` code points is encoded as one piece. A longer one is encoded in chunks that overlap; two
neighbours are spliced at a *proven stable* place inside the overlap: a letter or digit followed by a space or newline.
A byte-level pre-token holds white space only at its front and its look-ahead only sees white space that follows, so no
pre-token or merge crosses such a place in any context. Both chunks must also show a token boundary there. If an
overlap has no such place, it is widened (doubled) until one is found or the text ends, when the chunk takes the rest.

Memory is bounded by the chunk and the overlap, except for a text with no stable place at all, which is one piece.
Defined cases: null text is empty and has no tokens; repeated rows are counted each; null ids are returned as they are; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.common import slices, small_batches, whole_text

_LOADED: dict = {}
CHUNK, OVERLAP = 1 << 16, 1 << 9


def tokenizer(path: str):
    """The tokenizer of a file, once a process, on one thread: Spark's tasks are the parallelism."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _LOADED:
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def stable_places(text: str, start: int, end: int) -> Iterator[int]:
    """Places p in [start, end), the last first, where a letter or digit is followed by a space or newline."""
    for p in range(min(end, len(text) - 1), max(start, 1) - 1, -1):
        if text[p] in " \n" and text[p - 1].isalnum():
            yield p


def spans(encode, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[list[int]]:
    """The ids of ``text``, chunk by chunk."""
    start, first = 0, 0  # where the chunk starts, and where it starts to count
    while True:
        wide = overlap
        while True:
            end = start + max(chunk, 2 * wide)
            enc = encode(text[start:end])
            at = [a + start for a, _ in enc.offsets]
            if end >= len(text):
                yield [i for i, a in zip(enc.ids, at, strict=True) if a >= first]
                return
            bounds = set(at)
            following = encode(text[end - wide : end + wide])
            others = {a + end - wide for a, _ in following.offsets}
            # a margin at either end of the overlap, so that both chunks have seen some context
            cut = next((p for p in stable_places(text, end - wide + 1, end - 1) if p in bounds and p in others and p > first), None)
            if cut is not None:
                break
            wide *= 2
        yield [i for i, a in zip(enc.ids, at, strict=True) if first <= a < cut]
        start = max(start + 1, end - wide)
        first = cut


def counts(tok, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP, most: int = 1 << 18) -> list[int]:
    """The number of tokens of each text; short texts are encoded together, ``most`` code points at a time."""
    out, group, held = [0] * len(texts), [], 0

    def flush():
        fast = getattr(tok, "encode_batch_fast", tok.encode_batch)
        for i, e in zip(group, fast([texts[i] for i in group], add_special_tokens=False), strict=True):
            out[i] = len(e)
        group.clear()

    for i, text in enumerate(texts):
        if len(text) > chunk:
            out[i] = sum(map(len, spans(lambda x: tok.encode(x, add_special_tokens=False), text, chunk, overlap)))
        else:
            group.append(i)
            held += len(text)
            if held > most:
                flush()
                held = 0
    if group:
        flush()
    return out


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row, by the tokenizer in ``path``."""
    small_batches(docs.sparkSession)

    def run(batches):
        tok = tokenizer(path)
        for batch in batches:
            for part in slices(batch, "text"):
                n = counts(tok, part.column(1).to_pylist(), chunk, overlap)
                yield pa.RecordBatch.from_arrays([part.column(0), pc.cast(pc.binary_length(part.column(1)), pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), whole_text(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), path or public_tokenizers.path("byte_bpe_50k.json"))
