"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and its
reply is the only text that is trained on. An example is one string in which each turn reads
``<s>[role] text</s>``, with a list of character spans that are under the loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed format: characters with a meaning in the template, and what stands for them in texts.
ESCAPES = (("\\", "\\0"), ("<", "\\1"), ("[", "\\2"), ("]", "\\3"))
OPEN, ROLE_END, CLOSE = "<s>[", "] ", "</s>"


def escape(text: Column) -> Column:
    """No control string can occur in an escaped text, since it has no bare ``<``, ``[`` or ``]``."""
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def expand(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss): one example per assistant turn.

    ``loss`` is a list of (start, length) spans in code points. A conversation whose last turn is not
    the assistant's gets a last example without a span, so that no turn is lost. Turns are ordered by
    turn (null first), then role and text, so repeated rows stay. Null texts and roles are
    empty; an empty reply has a span of length 0. A null conv_id is a conversation of its own. Empty
    tables give none; other columns are ignored. An example holds its whole prefix, as the method has
    it, so the output of a conversation grows with the square of its turns.
    """
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                                 F.coalesce("text", F.lit("")).alias("said"))
    said = escape(F.col("said"))
    turns = turns.withColumn("shown", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(ROLE_END), said, F.lit(CLOSE)))
    turns = turns.withColumn("length", F.char_length(said))
    conv = Window.partitionBy("conv_id").orderBy("turn", "role", "said")
    upto = conv.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.select(
        "conv_id", "role", "length", F.array_join(F.collect_list("shown").over(upto), "").alias("text"),
        F.row_number().over(conv).alias("example"), F.lead(F.lit(1)).over(conv).isNull().alias("last"))
    start = F.char_length("text") - len(CLOSE) - F.col("length")
    span = F.struct(start.cast("int").alias("start"), F.col("length").cast("int").alias("length"))
    spans = F.when(F.col("role") == "assistant", F.array(span)).otherwise(F.filter(F.array(span), lambda s: F.lit(False)))
    return (turns.filter((F.col("role") == "assistant") | F.col("last"))
            .select("conv_id", "example", "text", spans.alias("loss")))


def write_examples(conversations: DataFrame, path: str) -> None:
    expand(conversations).write.parquet(path)


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Examples with their turns parsed back: (conv_id, example, text, turns, trained)."""
    examples = spark.read.parquet(path)
    # the split's first part is what stands before the first turn: nothing
    parts = F.slice(F.split("text", "<s>\\["), 2, F.char_length("text") + 1)

    def parsed(part: Column) -> Column:
        role = F.substring_index(part, ROLE_END, 1)
        text = F.substring(part, F.char_length(role) + len(ROLE_END) + 1,
                           F.char_length(part) - F.char_length(role) - len(ROLE_END) - len(CLOSE))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    trained = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["length"])))
    return examples.withColumn("turns", F.transform(parts, parsed)).withColumn("trained", trained)


def digest(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation hold: its turns, and its text under the loss mask."""
    shown = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = examples.select("conv_id", "example", F.size("turns").alias("n"), F.sha2(shown, 256).alias("sha"),
                           F.array_join("trained", "").alias("trained"), F.char_length("text").cast("bigint").alias("chars"))
    rows = rows.groupBy("conv_id").agg(
        F.max("n").cast("bigint").alias("n_turns"), F.max_by("sha", "example").alias("turns_sha256"),
        F.sum("chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("example", "trained"))).alias("replies"))
    loss = F.array_join(F.col("replies.trained"), "")
    return rows.select("conv_id", "n_turns", "turns_sha256", F.char_length(loss).cast("bigint").alias("loss_chars"),
                       F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
