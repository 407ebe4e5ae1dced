"""Chat formatting by prefix-target expansion, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: control strings of the template
OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
_CONTROL = r"(/?s>|/?INST\])"
_TARGET = "assistant"


def escape(text: Column) -> Column:
    r"""One more ``\`` after the first character of each control string, escaped or not."""
    return F.regexp_replace(text, rf"([<\[])(\\*){_CONTROL}", r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)\\{_CONTROL}", "$1$2$3")


def _formatted(turn: Column) -> Column:
    return F.concat(
        F.lit(OPEN), escape(turn["role"]), F.lit(CLOSE), escape(turn["text"]), F.lit(END))


def prefix_targets(conversations: DataFrame) -> DataFrame:
    """One training example per assistant turn, with all turns before it as context.

    Takes conv_id, turn, role, text; other columns are left out. Returns conv_id, example (from
    0), last, formatted, and the mask: loss_start and loss_length in code points of ``formatted``,
    covering the reply alone. Turns after the last reply become one more example whose mask is
    empty (loss_length NULL), so nothing of a conversation is lost. A turn reads
    ``[INST]role[/INST]text</s>``.

    NULL role or text: empty. NULL turn: before the others. Rows with equal turns are ordered by
    role and text; repeated rows stay. NULL conv_id: one conversation. Empty table: no rows.

    An example holds its whole context by definition, so a conversation must fit into one row;
    it is the only thing gathered.
    """
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    ends = F.filter(
        F.sequence(F.lit(1), F.size("turns")),
        lambda i: (F.element_at("turns", i)["role"] == _TARGET) | (i == F.size("turns")))
    examples = turns.select(
        "conv_id", "turns", F.transform("turns", _formatted).alias("pieces"),
        F.posexplode(ends).alias("example", "end"))
    target = F.element_at("turns", F.col("end"))
    reply = target["role"] == _TARGET
    before = F.array_join(F.slice("pieces", F.lit(1), F.col("end") - 1), "")
    return examples.select(
        "conv_id", "example", (F.col("end") == F.size("turns")).alias("last"),
        F.array_join(F.slice("pieces", F.lit(1), F.col("end")), "").alias("formatted"),
        F.when(reply, F.length(before) + len(OPEN + _TARGET + CLOSE)).alias("loss_start"),
        F.when(reply, F.length(escape(target["text"]))).alias("loss_length"))


def read_back(examples: DataFrame) -> DataFrame:
    """Turns and trained text of each conversation, parsed from its formatted examples.

    Returns conv_id, turns (array of role and text), loss_text (all masked text in order) and
    formatted_chars (code points of all examples).
    """
    masked = F.when(
        F.col("loss_length").isNotNull(),
        unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_length"))))
    # only the last example is kept whole
    parts = examples.select(
        "conv_id", "example", masked.alias("masked"),
        F.when(F.col("last"), F.col("formatted")).alias("whole"),
        F.length("formatted").cast("long").alias("chars"))
    gathered = parts.groupBy("conv_id").agg(
        F.max("whole").alias("whole"), F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("example", "masked"))).alias("masked"))
    pieces = F.split("whole", END, -1)

    def turn(piece: Column) -> Column:
        halves = F.split(piece, r"\[/INST\]", 2)
        return F.struct(
            unescape(F.substring(halves[0], len(OPEN) + 1, 2**31 - 1)).alias("role"),
            unescape(halves[1]).alias("text"))

    return gathered.select(
        "conv_id",
        F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn).alias("turns"),
        F.array_join(F.transform("masked", lambda m: m["masked"]), "").alias("loss_text"),
        "formatted_chars")


def digest(conversations: DataFrame) -> DataFrame:
    """Formats conversations and digests what can be read back from the output."""
    lines = F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read_back(prefix_targets(conversations)).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), placed AS (
  SELECT *, row_number() OVER o AS n, count(*) OVER (PARTITION BY conv_id) AS total,
    17 + length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\2\\\3', 'g'))
       + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\2\\\3', 'g')) AS chars
  FROM rows WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), summed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY n) AS upto FROM placed
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR n = total)::BIGINT AS formatted_chars
FROM summed GROUP BY conv_id
"""
