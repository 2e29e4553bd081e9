"""Chat formatting, in Spark expressions only.

The turns of a conversation are collected as structs and sorted. Adjacent turns of one role are gathered in one block, whose
texts are merged by joining them:

    <:role>text<+:role>text</turn>

`<:` opens a block, `<+:` goes on in it with a turn of its own, `</turn>` and a line feed close it. In texts and roles
a backslash is written `\\s`, `<` is written `\\l` and `>` is written `\\g`, so what a text says can't be taken for a
mark, and the text comes back exactly. The loss mask marks the texts of the trained role: run lengths in code points
over the whole formatted string to its end, alternating marks (never trained) and texts.

Cases: null texts and null roles count as empty. Turns are ordered by turn number (null first), then role, then text,
so ties are settled; repeated rows are turns of their own. A null conv_id is a conversation. Other columns are ignored;
empty in, empty out. Every step is linear in the conversation's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import pick

#: What closes a block.
END = "</turn>\n"


def escaped(x: Column) -> Column:
    for a, b in (("\\", "\\s"), ("<", "\\l"), (">", "\\g")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def unescaped(x: Column) -> Column:
    for a, b in (("\\l", "<"), ("\\g", ">"), ("\\s", "\\")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def format_chats(
    rows: DataFrame,
    trained: str = "assistant",
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """conv_id, formatted, loss_runs: array of (chars, loss) that covers `formatted` to its end: for each turn its marks and
    its text, and then the last mark."""
    got = pick(rows, **{id_col: "long", turn_col: "long", role_col: "string", text_col: "string"})
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(role_col, F.lit("")).alias("role"),
        F.coalesce(text_col, F.lit("")).alias("text"),
    )
    sorted_turns = got.groupBy(F.col(id_col).alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("t"))

    # where blocks begin: at the first turn and wherever the role changes; a block holds the turns from there to the next
    role_at = lambda i: F.get("t", i)["role"]
    opens = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (role_at(i) != role_at(i - 1)))
    begun = sorted_turns.withColumn("opens", opens)
    until = lambda k: F.coalesce(F.get("opens", k + 1), F.size("t"))

    def block(i: Column, k: Column) -> Column:
        role = role_at(i)
        texts = F.transform(F.slice("t", i + 1, until(k) - i), lambda x: escaped(x["text"]))
        return F.struct(escaped(role).alias("role"), (role == trained).alias("loss"), texts.alias("texts"))

    blocks = begun.select("conv_id", F.transform("opens", block).alias("blocks"))

    def merged(b: Column) -> Column:
        between = F.concat(F.lit("<+:"), b["role"], F.lit(">"))
        return F.concat(F.lit("<:"), b["role"], F.lit(">"), F.call_function("array_join", b["texts"], between), F.lit(END))

    def runs(b: Column, k: Column) -> Column:
        first = F.when(k > 0, len(END)).otherwise(0) + len("<:>")  # what closes a block runs on into the next mark
        return F.flatten(
            F.transform(
                b["texts"],
                lambda x, j: F.array(
                    F.struct((F.when(j == 0, first).otherwise(len("<+:>")) + F.length(b["role"])).alias("chars"), F.lit(False).alias("loss")),
                    F.struct(F.length(x).alias("chars"), b["loss"].alias("loss")),
                ),
            )
        )

    last = F.array(F.struct(F.lit(len(END)).alias("chars"), F.lit(False).alias("loss")))
    return blocks.select(
        "conv_id",
        F.array_join(F.transform("blocks", merged), "").alias("formatted"),
        F.concat(F.flatten(F.transform("blocks", runs)), last).alias("loss_runs"),
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns: array of (role, text, loss_text), read back from the string and its loss runs.

    loss_text is what of the turn's text lies under the loss mask (null if nothing does). The mask is read by position:
    the runs must cover the string to its end, and each must begin and end where a text or what lies between texts does;
    a mask that is shifted, too short or too long is an error. Where every run is as long as its stretch of the string, all
    runs lie where they should, so positions need not be added up.
    """
    pieces = F.filter(F.split("formatted", "<", -1), lambda x: (x != "") & ~x.startswith("/"))
    cut = formatted.select("conv_id", "formatted", "loss_runs", pieces.alias("pieces"))

    def fits(x: Column, i: Column) -> Column:
        mark = F.instr(x, ">")
        closed = F.when((i > 0) & x.startswith(":"), len(END)).otherwise(0)  # a new block closes the one before
        between, text = F.get("loss_runs", 2 * i), F.get("loss_runs", 2 * i + 1)
        return (between["chars"] == closed + mark + 1) & ~between["loss"] & (text["chars"] == F.length(x) - mark)

    last = F.element_at("loss_runs", -1)
    whole = (F.size("loss_runs") == 2 * F.size("pieces") + 1) & (last["chars"] == len(END)) & ~last["loss"]
    fitting = whole & F.forall(F.transform("pieces", fits), lambda ok: F.coalesce(ok, F.lit(False)))

    def turn(x: Column, i: Column) -> Column:
        mark = F.instr(x, ">")
        text = unescaped(F.substr(x, mark + 1))
        role = F.substr(x, F.locate(":", x) + 1, mark - F.locate(":", x) - 1)
        return F.struct(unescaped(role).alias("role"), text.alias("text"), F.when(F.get("loss_runs", 2 * i + 1)["loss"], text).alias("loss_text"))

    turns = F.when(F.coalesce(fitting, F.lit(False)), F.transform("pieces", turn)).otherwise(F.raise_error(F.lit("the loss mask does not fit the text")))
    return cut.select("conv_id", "formatted", turns.alias("turns"))
