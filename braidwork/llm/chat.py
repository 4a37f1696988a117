"""Chat formatting with a grammar round trip, in DataFrame functions only.

Template, for each turn: <|im_start|>ROLE newline TEXT <|im_end|> newline. A control string in a text is escaped by one
backslash after its first character, after any that stand there, so no escaped text holds a control string and taking one
backslash away gives the text back: <|im_end|> is written <\\|im_end|>, and <\\|im_end|> is written <\\\\|im_end|>.

A conversation is rendered as it is and parsed again. The grammar has no unescaped control string inside a turn and only
doubled backslashes and backslash n inside a role, so the parser gives no text for a turn that breaks it. Turns that don't
come back as they were are escaped, and the whole is rendered and parsed again; if anything still differs all turns are
escaped; a conversation that then doesn't come back is an error. The parser is one regular expression and the same for all
turns. Rows are shuffled once, by conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidwork.llm.common import let, table

START, END = "<|im_start|>", "<|im_end|>\n"
#: Fixed control strings: those of the template, and those of other common templates.
CONTROL = ["<|im_start|>", "<|im_end|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"]
HEADS = "(<|\\[)"
TAILS = "(\\|im_start\\|>|\\|im_end\\|>|s>|/s>|<SYS>>|</SYS>>|INST\\]|/INST\\])"
#: A control string's first character, backslashes, its rest.
ESCAPABLE = f"{HEADS}(\\\\*){TAILS}"
ESCAPED = f"{HEADS}\\\\(\\\\*){TAILS}"
#: What no turn of the output may hold: a control string as it is.
BARE = f"{HEADS}{TAILS}"
#: One turn of the output: role, text.
TURN = "(?s)<\\|im_start\\|>([^\\n]*)\\n(.*?)<\\|im_end\\|>\\n"
SAYS = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPABLE, "$1$2\\\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def escape_role(role: Column) -> Column:
    """A role stands on one line: backslashes are doubled and line ends written as backslash n, and then it is escaped as a text."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    parts = F.split(unescape(role), "\\\\\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END))


def parse(rendered: Column) -> Column:
    """The turns of rendered text: array<struct<role, text>>, unescaped; null where a turn breaks the grammar."""
    roles, bodies = F.regexp_extract_all(rendered, F.lit(TURN), F.lit(1)), F.regexp_extract_all(rendered, F.lit(TURN), F.lit(2))
    lone = lambda r: F.contains(F.replace(F.replace(unescape(r), F.lit("\\\\"), F.lit("")), F.lit("\\n"), F.lit("")), F.lit("\\"))
    role = lambda r: F.when(~r.rlike(BARE) & ~lone(r), unescape_role(r))
    return F.zip_with(roles, bodies, lambda r, b: F.struct(role(r).alias("role"), F.when(~b.rlike(BARE), unescape(b)).alias("text")))


def piece(turn: Column, escaped: Column) -> Column:
    return F.when(escaped, render(escape_role(turn["role"]), escape(turn["text"]))).otherwise(render(turn["role"], turn["text"]))


def differing(turns: Column, rendered: Column) -> Column:
    """For each of turns, whether it doesn't come back from the rendered whole; all differ where their number does not come back."""

    def told(back: Column) -> Column:
        same = lambda t, i: F.get(back, i)["role"].eqNullSafe(t["role"]) & F.get(back, i)["text"].eqNullSafe(t["text"])
        found = F.transform(turns, lambda t, i: ~F.coalesce(same(t, i), F.lit(False)))
        return F.when((F.size(back) == F.size(turns)) | F.exists(found, lambda x: x), found).otherwise(F.transform(turns, lambda _: F.lit(True)))

    return let(parse(rendered), told)


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans, n_escaped, round_trip): one row a conversation.

    Turns go by their number, nulls last; ties by role and text; a null role or text is an empty one. loss_spans:
    array<struct<start, length>> of assistant texts in formatted, in code points from 0. n_escaped: turns that are not
    written as they are. round_trip: the parsed output equals the source; the job fails where it would not. Rows with a
    null conv_id are one conversation. Other columns are not carried. An empty table gives an empty one.
    """
    plain = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = F.struct(F.col("turn").isNull().alias("last"), "turn", "role", "text")
    state = plain.groupBy("conv_id").agg(F.sort_array(F.collect_list(own)).alias("turns"))
    whole = lambda flags: F.array_join(F.zip_with("turns", flags, piece), "")
    nothing = F.transform("turns", lambda _: F.lit(False))
    # each round escapes the turns that don't come back from the round before; the second can only be followed by all
    state = state.withColumn("first", differing(F.col("turns"), whole(nothing)))
    state = state.withColumn("again", F.when(F.exists("first", lambda x: x), differing(F.col("turns"), whole(F.col("first")))).otherwise(F.col("first")))
    state = state.withColumn("flags", F.when(F.exists("again", lambda x: x), F.transform("turns", lambda _: F.lit(True))).otherwise(F.col("first")))
    state = state.withColumn("formatted", whole(F.col("flags")))
    back = F.exists(differing(F.col("turns"), F.col("formatted")), lambda x: x)
    state = state.withColumn("round_trip", F.when(~back, F.lit(True)).otherwise(F.raise_error(F.lit("a conversation does not come back from its text")).cast("boolean")))
    # where each turn stands: sums of lengths along the conversation, whose rows stay where they are
    turn = lambda t, i: F.struct(t["role"].alias("role"), piece(t, F.get("flags", i)).alias("piece"), render(t["role"], t["text"]).alias("raw"), F.when(i == 0, F.col("formatted")).alias("whole"))
    each = state.select("conv_id", "round_trip", F.posexplode(F.transform("turns", turn)).alias("nth", "x"))
    length = F.length("x.piece")
    at = F.sum(length).over(W.partitionBy("conv_id").orderBy("nth").rowsBetween(W.unboundedPreceding, 0)) - length
    body_start = F.col("at") + F.length(F.substring_index("x.piece", "\n", 1)) + 1
    span = F.struct(body_start.alias("start"), (F.col("at") + length - len(END) - body_start).alias("length"))
    return each.withColumn("at", at).groupBy("conv_id").agg(
        F.max("x.whole").alias("formatted"),
        F.sort_array(F.collect_list(F.when(F.col("x.role") == "assistant", span))).alias("loss_spans"),
        F.count_if(F.col("x.piece") != F.col("x.raw")).alias("n_escaped"),
        F.bool_and("round_trip").alias("round_trip"),
    )


def masked_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"])))


def with_probe(turns: DataFrame) -> DataFrame:
    """turns with conversation -1, whose texts are control strings."""
    turn = F.col("id")
    probe = turns.sparkSession.range(2).select(F.lit(-1).cast("long").alias("conv_id"), turn.alias("turn"), F.when(turn == 0, "user").otherwise("assistant").alias("role"), F.lit(SAYS).alias("text"))
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(probe)


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = format_conversations(with_probe(table(spark, sf_dir, "conversations")))
    read = made.withColumn("back", parse(F.col("formatted"))).withColumn("loss", F.array_join(masked_texts(F.col("formatted"), F.col("loss_spans")), ""))
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_escaped",
        "round_trip",
    )


OP8_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), rendered AS (
  SELECT *, regexp_matches(role || chr(10) || text, '(<|\[)\\*(\|im_start\|>|\|im_end\|>|s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])') OR contains(role, chr(10)) OR contains(role, '\') AS escaped,
         regexp_replace(text, '(<|\[)(\\*)(\|im_start\|>|\|im_end\|>|s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])', '\1\2\\\3', 'g') AS body,
         regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '(<|\[)(\\*)(\|im_start\|>|\|im_end\|>|s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])', '\1\2\\\3', 'g') AS head
  FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>') + length(head) + 1 + length(body) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars,
       sum(escaped::INT)::BIGINT AS n_escaped, true AS round_trip
FROM rendered GROUP BY conv_id
"""
