"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context and only its reply is trainable
(``loss_start``/``loss_end``, in code points of the example's text). Turns after the last assistant turn, and
conversations without one, give one more example without a trainable part, so that no turn is lost.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Escapes inside roles and texts are reversible:
``\\`` becomes ``\\e``, ``<|`` becomes ``<\\p`` and, in roles, a line feed becomes ``\\n``; a control string can thus only
come from the template.

Turns are ordered by (turn, role, text), nulls first; null roles and texts count as empty; repeated rows are turns of
their own. A null conversation id is a conversation. An empty table gives no examples. By its definition the expansion
of a conversation of T turns is about T/2 times as long as the conversation; rows are generated one at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column, line_feeds: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\e")), F.lit("<|"), F.lit("<\\p"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if line_feeds else out


def unescaped(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\n"), F.lit("\n")), F.lit("\\p"), F.lit("|"))
    return F.replace(out, F.lit("\\e"), F.lit("\\"))


def examples(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, example (from 0), text, loss_start, loss_end (null without a trainable part), last."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    head = F.concat(F.lit(START), escaped(role, True), F.lit("\n"))
    turn = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), F.length(head).alias("head"),
                    F.concat(head, escaped(text), F.lit(END + "\n")).alias("piece"), (role == "assistant").alias("reply"))
    convs = turns.groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    size = F.size("turns")
    at = F.filter(F.sequence(F.lit(1), size), lambda i: F.get("turns", i - 1)["reply"] | (i == size))
    convs = convs.select("conv_id", "turns", F.posexplode(at).alias("example", "upto"))
    final = F.get("turns", F.col("upto") - 1)
    body = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("upto")), lambda t: t["piece"]), "")
    rows = convs.select("conv_id", "example", body.alias("text"), final["reply"].alias("reply"), final["head"].alias("head"),
                        F.length(final["piece"]).alias("piece"), (F.col("upto") == size).alias("last"))
    begin = F.length("text") - F.col("piece") + F.col("head")
    return rows.select("conv_id", F.col("example").cast("long").alias("example"), "text", F.when(F.col("reply"), begin).cast("long").alias("loss_start"),
                       F.when(F.col("reply"), F.length("text") - len(END) - 1).cast("long").alias("loss_end"), "last")


def parsed(text: Column) -> Column:
    """Turns of a formatted text as array<struct<role, text>>."""
    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        body = F.substr(piece, F.length(role) + 2, F.length(piece) - F.length(role) - 1 - len(END) - 1)
        return F.struct(unescaped(role).alias("role"), unescaped(body).alias("text"))

    return F.transform(F.slice(F.split(text, r"<\|im_start\|>"), 2, 1 << 30), turn)


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted examples hold, by conversation: turns, trainable text and lengths."""
    reply = F.when(F.col("loss_start").isNotNull(), unescaped(F.substr("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))))
    rows = formatted.select("conv_id", "example", reply.alias("reply"), F.length("text").cast("long").alias("chars"),
                            F.when(F.col("last"), F.transform(parsed(F.col("text")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))).alias("turns"))
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(F.col("reply").isNotNull(), F.struct("example", "reply")))).alias("replies"),
                                       F.sum("chars").alias("formatted_chars"), F.max("turns").alias("turns"))
    loss = F.array_join(F.transform("replies", lambda r: r["reply"]), "")
    return rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
