"""Chat formatting by prefix-target expansion, DataFrame operations only.

Each assistant turn becomes an example of its own: all turns before it as context, then that reply,
the only trainable part. The template (fixed strings, see OPEN and CLOSE) marks turns with brackets;
inside texts and role names the characters it uses are escaped, so a text can't forge a turn, and
``read_turns`` gets roles and texts back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed strings of the template; "\" first, as it starts every escape.
ESCAPES = (("\\", "\\0"), ("[", "\\1"), ("]", "\\2"), ("<", "\\3"))
OPEN = {"user": "[INST] ", "assistant": "[ANS] ", "system": "[SYS] "}
CLOSE = {"user": " [/INST]", "assistant": "</s>", "system": " [/SYS]"}
OTHER_CLOSE = " [/TURN]"
_TURN = r"\[(INST|ANS|SYS|TURN [^\]]*)\] ([^\[<]*)(?: \[/(?:INST|SYS|TURN)\]|</s>)"


def escape(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def _by_role(role: Column, known: dict[str, str], other: Column) -> Column:
    out = other
    for name, mark in known.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def format_examples(turns: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """Examples: conv, example (0..), text, loss_start, loss_end (code points of text, end exclusive), last.

    An example for each assistant turn; the reply's escaped text lies under the loss span. Turns after
    the last reply (all, if there is none) follow in one more row of the conversation with an empty
    loss span, so that the output holds every turn. ``last`` marks the row that holds all turns.
    Turns sort by turn, then role, then text; null turns first, so repeated rows are repeated turns.
    Null role or text: empty. Null conv: one conversation of that name. Empty table: no rows.
    Other columns are ignored. A conversation is one row of one task, as one example holds it whole.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    name = F.concat(F.lit("[TURN "), escape(role), F.lit("] "))
    parts = turns.select(
        F.col(conv_col).alias("conv"),
        F.struct(
            F.col(turn_col).alias("turn"),
            role.alias("role"),
            text.alias("text"),
            _by_role(role, OPEN, name).alias("open"),
            escape(text).alias("safe"),
            _by_role(role, CLOSE, F.lit(OTHER_CLOSE)).alias("close"),
        ).alias("t"),
    )
    convs = parts.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    marked = convs.select(
        "conv",
        F.transform("ts", lambda t: F.concat(t["open"], t["safe"], t["close"])).alias("marked"),
        F.transform("ts", lambda t: F.struct(t["role"].alias("role"), F.length(t["open"]).alias("o"), F.length(t["safe"]).alias("n"))).alias("info"),
    )
    n = F.size("marked")
    replies = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.element_at("info", i + 1)["role"] == "assistant")
    tail = F.when(F.element_at("info", -1)["role"] == "assistant", F.expr("array()").cast("array<int>")).otherwise(F.array(n - 1))
    ends = marked.select("conv", "marked", "info", F.posexplode(F.concat(replies, tail)).alias("example", "at"))
    before = F.array_join(F.slice("marked", F.lit(1), F.col("at")), "")
    one = F.element_at("info", F.col("at") + 1)
    texts = ends.select("conv", "example", before.alias("before"), F.element_at("marked", F.col("at") + 1).alias("own"), one.alias("one"), (F.col("at") == F.size("marked") - 1).alias("last"))
    start = F.when(F.col("one.role") == "assistant", F.length("before") + F.col("one.o")).otherwise(0)
    return texts.select(
        "conv", "example", F.concat("before", "own").alias("text"), start.alias("loss_start"),
        F.when(F.col("one.role") == "assistant", start + F.col("one.n")).otherwise(0).alias("loss_end"), "last",
    )


def read_turns(text: Column) -> Column:
    """array<struct<role, text>> of the turns in a formatted text."""
    roles = F.regexp_extract_all(text, F.lit(_TURN), F.lit(1))
    texts = F.regexp_extract_all(text, F.lit(_TURN), F.lit(2))

    def turn(mark: Column, safe: Column) -> Column:
        role = F.when(mark == "INST", "user").when(mark == "ANS", "assistant").when(mark == "SYS", "system")
        return F.struct(role.otherwise(unescape(F.substr(mark, F.lit(6)))).alias("role"), unescape(safe).alias("text"))

    return F.zip_with(roles, texts, turn)


def read_back(examples: DataFrame) -> DataFrame:
    """A row for each conversation, from the examples' texts and spans alone."""
    span = F.substr("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    lines = F.transform(read_turns(F.col("text")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    parts = examples.select(
        "conv", F.length("text").cast("long").alias("chars"),
        F.struct("example", unescape(span).alias("loss")).alias("loss"),
        F.when(F.col("last"), lines).alias("lines"),
    )
    convs = parts.groupBy("conv").agg(
        F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list("loss")).alias("losses"), F.first("lines", ignorenulls=True).alias("lines")
    )
    loss = F.array_join(F.col("losses.loss"), "")
    return convs.select(
        F.col("conv").alias("conv_id"),
        F.size("lines").cast("long").alias("n_turns"),
        F.sha2(F.array_join("lines", ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
