"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Each turn is ``[role]text</s>``; a text's own brackets, angles and backslashes are escaped, so the marks occur nowhere
else and a formatted conversation reads back exactly. Every assistant turn is an example: all turns before it (and its own
opening mark) are context, its text alone is under the loss mask.

Contexts are written out whole, so the output grows with the square of a conversation's turns. They exist in one row at a time:
a conversation's text goes to its examples once for every STEP code points of context, as an array of pieces that a context is
joined from, and neither contexts nor texts are shuffled. A long conversation's examples are thus many tasks' work; its text is
assembled in one row.

Defined cases: null text or role is empty; turns go by (turn, role, text), null turn first; repeated rows are turns each; a
null conv_id is a conversation of its own; a conversation without assistant turns has no example but reads back; empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CLOSE = "</s>"
PIECE = 4096
#: Code points of context after which a conversation's examples go to another task; a multiple of PIECE.
STEP = 256 * PIECE
# Character and escape, in the order in which they are escaped (unescaped in reverse).
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), ("]", "\\d"))
CONTROL_CONVERSATION = -7
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def formatted_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, n, role, segment, context_chars, target): a row per turn, n from 1; context_chars code points of formatted
    text come before its target."""
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).repartition("conv_id")
    opening = F.concat(F.lit("["), escape(F.col("role")), F.lit("]"))
    marked = turns.withColumns({"opening": opening, "target": escape(F.col("text"))}).withColumn("segment", F.concat("opening", "target", F.lit(CLOSE)))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = F.sum(F.length("segment").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return marked.select("conv_id", F.row_number().over(order).alias("n"), "role", "segment", (F.coalesce(before, F.lit(0)) + F.length("opening")).alias("context_chars"), "target")


def conversations_text(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted): each conversation's text, of which every context is a prefix."""
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "segment"))).alias("t")).select("conv_id", F.array_join(F.transform("t", lambda x: x["segment"]), "").alias("formatted"))


def examples(turns: DataFrame) -> DataFrame:
    """(conv_id, n, context_chars, context, target, closing, mark_chars, mark_bytes): one per assistant turn of formatted_turns.
    context is the whole text of all turns before it and of its own opening mark; only target is trained. Contexts are joined from
    pieces of PIECE code points, as a walk through the text to each context's end takes several times as long; the first mark_chars
    code points of a context, its whole pieces, are mark_bytes bytes."""
    steps = lambda n: F.floor(n / STEP).cast("int")
    replies = turns.where(F.col("role") == "assistant").withColumn("step", steps(F.col("context_chars"))).alias("e")
    cut = conversations_text(turns).select("conv_id", F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"))
    dealt = cut.select("conv_id", "pieces", F.explode(F.sequence(F.lit(0), steps((F.size("pieces") - 1) * PIECE))).alias("step"))
    prefixes = dealt.select("conv_id", "step", F.slice("pieces", 1, (F.col("step") + 1) * (STEP // PIECE)).alias("pieces")).alias("c")
    both = replies.join(prefixes, F.col("e.conv_id").eqNullSafe(F.col("c.conv_id")) & (F.col("e.step") == F.col("c.step")))
    full, rest = F.floor(F.col("e.context_chars") / PIECE).cast("int"), (F.col("e.context_chars") % PIECE).cast("int")
    head, tail = F.array_join(F.slice("c.pieces", F.lit(1), full), ""), F.substr(F.get("c.pieces", full), F.lit(1), rest)
    both = both.select("e.conv_id", "e.n", "e.context_chars", head.alias("head"), tail.alias("tail"), "e.target", (full * PIECE).alias("mark_chars"))
    return both.select("conv_id", "n", "context_chars", F.concat("head", "tail").alias("context"), "target", F.lit(CLOSE).alias("closing"), "mark_chars", F.octet_length("head").alias("mark_bytes"))


def masked(turns: DataFrame) -> DataFrame:
    """(conv_id, n, context, target, closing, text, mask_start, mask_chars, mark_chars, mark_bytes): the examples' texts, and in code
    points what of them is trained."""
    text = F.concat("context", "target", "closing").alias("text")
    return examples(turns).select("conv_id", "n", "context", "target", "closing", text, F.col("context_chars").alias("mask_start"), F.length("target").alias("mask_chars"), "mark_chars", "mark_bytes")


def expanded(conversations: DataFrame) -> DataFrame:
    """The examples of conversations, as of masked."""
    return masked(formatted_turns(conversations)).drop("mark_chars", "mark_bytes")


def read_back(turns: DataFrame) -> DataFrame:
    """Digests of what the formatted output says: turns parsed from the conversation's text, replies cut out of each example's
    whole text from under its mask. Code points are counted from the text's mark on."""
    none = F.lit(None).cast("string")
    skipped = (F.col("mask_start") - F.col("mark_chars")).cast("int")
    near = F.substr(F.col("text").cast("binary"), F.col("mark_bytes") + 1).cast("string")
    under = unescape(F.substr(near, skipped + 1, F.col("mask_chars")))
    rows = turns.select("conv_id", "n", "segment", none.alias("loss")).union(masked(turns).select("conv_id", "n", none.alias("segment"), under.alias("loss")))
    rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "segment", "loss"))).alias("t"))
    joined = lambda name: F.array_join(F.transform("t", lambda x: x[name]), "").alias(name)  # noqa: E731  without the nulls
    whole = rows.select("conv_id", joined("segment").alias("formatted"), joined("loss"))
    pieces = F.split("formatted", CLOSE)
    said = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda s: F.concat(unescape(F.substring_index(F.substr(s, F.lit(2)), "]", 1)), F.lit("\n"), unescape(F.substr(s, F.instr(s, "]") + 1)), F.lit("\n")))
    return whole.select("conv_id", said.alias("said"), "loss", F.length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id", F.size("said").cast("long").alias("n_turns"), F.sha2(F.array_join("said", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    control = spark.range(2).select(F.lit(CONTROL_CONVERSATION).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return read_back(formatted_turns(rows.unionByName(control)))


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (SELECT *, length(replace(replace(replace(replace(role || text, '\', '\e'), '<', '\l'), '[', '\b'), ']', '\d')) + 6 AS chars FROM turns),
conv AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '') AS loss,
  sum(chars) AS formatted_chars FROM marked GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars FROM conv
"""
