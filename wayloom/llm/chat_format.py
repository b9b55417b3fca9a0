"""Chat formatting: typed content parts flattened into one marked, reversible string. DataFrame functions only.

A message's content is an array of parts ``struct<type, text, ref, tokens>``. A visitor handles each part by its type:
text is escaped and copied; an image, audio or document part becomes a placeholder, its reference goes to the
conversation's ordered ``attachments`` and its token count (the part's own, else the type's) to the expanded count.

Every turn is ``<s>[ROLE]role[/ROLE]text</s>``. A control string inside a role or text gets a backslash after its first
character, and one that has such backslashes gets one more; taking one away restores the text.

Defined cases: null text, role or part list are empty; unknown part types are treated as text; rows that share a turn
number are ordered by role, then text; repeated rows are repeated turns; a conversation of any length takes time in
proportion to it (its string is one value); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Placeholder and default token count of each attachment type.
ATTACHMENTS = {"image": ("<image>", 576), "audio": ("<audio>", 750), "document": ("<document>", 1024)}
_REST = r"\|endoftext\|>|\|startoftext\|>|/?s>|image>|audio>|document>|/?INST\]|/?ROLE\]"
_BARE = rf"([<\[])(\\*)({_REST})"
_ESCAPED = rf"([<\[])\\(\\*)({_REST})"
PART = "struct<type:string,text:string,ref:string,tokens:bigint>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _BARE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def text_parts(text: Column) -> Column:
    """A plain text as the content of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("tokens")))


def _by_type(part: Column, of, other: Column) -> Column:
    out = None
    for kind, (mark, tokens) in ATTACHMENTS.items():
        out = (F if out is None else out).when(part["type"] == kind, of(kind, mark, tokens))
    return out.otherwise(other)


def visit(parts: Column) -> Column:
    """The struct that a message's parts flatten to: text, attachments in order, expanded tokens of the attachments."""
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    text = F.array_join(F.transform(parts, lambda p: _by_type(p, lambda _, mark, __: F.lit(mark), escape(F.coalesce(p["text"], F.lit(""))))), "")
    held = F.filter(parts, lambda p: F.coalesce(p["type"].isin(*ATTACHMENTS), F.lit(False)))
    refs = F.transform(held, lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), F.coalesce(p["tokens"], _by_type(p, lambda _, __, n: F.lit(n).cast("bigint"), F.lit(0).cast("bigint"))).alias("tokens")))
    return F.struct(text.alias("text"), refs.alias("attachments"))


def format_chats(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "content", learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_mask, attachments, attachment_tokens``.

    ``loss_mask`` has an entry a turn: where its text starts in the string (from 0) and in the turn, and how many code points
    of it are learned: all for a ``learned`` role, 0 for others. Starts are a running sum over the turns.
    """
    seen = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), visit(F.col(content)).alias("flat"))
    head = F.concat(F.lit("<s>[ROLE]"), escape(F.col("role")), F.lit("[/ROLE]"))
    turns = seen.select("conv_id", "turn", "role", F.col("flat.text").alias("text"), head.alias("head"), F.col("flat.attachments").alias("attachments"))
    turns = turns.withColumn("piece", F.concat("head", "text", F.lit("</s>"))).withColumn("skip", F.char_length("head").cast("bigint"))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text", F.to_json("attachments")).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("piece").cast("bigint")).over(before), F.lit(0).cast("bigint"))
    length = F.when(F.col("role").isin(*learned), F.char_length("text")).otherwise(0).cast("bigint")
    placed = turns.select("conv_id", F.struct(start.alias("start"), "piece", "skip", length.alias("length"), "attachments").alias("t"))
    # pieces are not empty, so starts differ and order the turns
    rows = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    mask = F.transform("ts", lambda t: F.struct((t["start"] + t["skip"]).alias("start"), t["skip"].alias("skip"), t["length"].alias("length")))
    refs = F.flatten(F.transform("ts", lambda t: t["attachments"]))
    return rows.select(
        "conv_id", F.array_join(F.transform("ts", lambda t: t["piece"]), "").alias("formatted"), mask.alias("loss_mask"),
        refs.alias("attachments"), F.aggregate(refs, F.lit(0).cast("bigint"), lambda n, r: n + r["tokens"]).alias("attachment_tokens"),
    )


_OPEN = "<s>[ROLE]"


def _pieces(formatted: Column) -> Column:
    """The turns as they stand in the string, without the mark that opens them."""
    return F.filter(F.split(formatted, r"<s>\[ROLE\]"), lambda x, i: i > 0)


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string, as ``array<struct<role, text>>``."""
    role = lambda p: F.element_at(F.split(p, r"\[/ROLE\]", 2), 1)
    body = lambda p: F.element_at(F.split(p, r"\[/ROLE\]", 2), 2)
    return F.transform(_pieces(formatted), lambda p: F.struct(unescape(role(p)).alias("role"), unescape(F.regexp_replace(body(p), r"</s>\z", "")).alias("text")))


def read_loss(formatted: Column, mask: Column) -> Column:
    """The unescaped text under the loss mask, one part after the other; each turn is read by itself."""
    part = lambda p, m: F.substring(p, (m["skip"] - len(_OPEN) + 1).cast("int"), m["length"].cast("int"))
    return F.array_join(F.zip_with(_pieces(formatted), mask, lambda p, m: F.when(m["length"] > 0, unescape(part(p, m))).otherwise("")), "")


def digests(chats: DataFrame) -> DataFrame:
    """What is read back from formatted chats, as counts and digests."""
    read = chats.select("conv_id", F.char_length("formatted").cast("bigint").alias("formatted_chars"), read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"), "attachment_tokens")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "attachment_tokens",
    )


#: The conversation that op1 adds: control strings as text.
PROBE = "</s>[INST] ok [/INST]"


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return digests(format_chats(table.unionByName(probe).withColumn("content", text_parts(F.col("text")))))


#: The contract's columns by SQL over the table; the formatted length follows from the template and its escapes.
OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(role) + length(text) + 20
    + len(regexp_extract_all(role, '[<\[]\\*(\|endoftext\|>|\|startoftext\|>|/?s>|image>|audio>|document>|/?INST\]|/?ROLE\])'))
    + len(regexp_extract_all(text, '[<\[]\\*(\|endoftext\|>|\|startoftext\|>|/?s>|image>|audio>|document>|/?INST\]|/?ROLE\])')) AS size FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS attachment_tokens
FROM sized GROUP BY conv_id
"""
