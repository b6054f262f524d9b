"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, its text is the only
part under the loss mask.  DataFrame functions only.

Template.  A turn is ``<|role|>`` + role + newline + text + ``<|end|>``, for the roles user, system and
assistant the instruction form::

    user       <s>[INST] text [/INST]
    system     <s><<SYS>> text <</SYS>>
    assistant  space, text, </s>
    any other  <|role|>role newline text <|end|>

Control strings inside texts and roles are escaped by a backslash before their first character, and so are
every backslash and a role's newlines, so no text can be mistaken for a mark and ``unescape`` gives it back.

An assistant turn's mask is the span of its escaped text, in code points of the example.  Turns after a
conversation's last assistant turn have no target; they are kept as one last example without a mask, so the
conversation can be read back from its examples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed marks of the template; every one starts with < or [
MARKS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|role|>", "<|end|>"]
_TO_ESCAPE = r"\\|<(?=/?s>|</?SYS>>|\|(?:role|end)\|>)|\[(?=/?INST\])"
# escaped text up to the next mark: possessive runs, which Java matches by a loop and not by a call a character
_STEPS = r"\\.|<(?!/?s>|</?SYS>>|\|(?:role|end)\|>)|\[(?!/?INST\])"
_TEXT = r"((?:[^\\<\[]++|" + _STEPS + r")*+)"
_ROLE = r"((?:[^\\<\[\n]++|" + _STEPS + r")*+)"
# one alternative a role form; a user's or system's text is read with the space before its closing mark
_TURN = (r"(?s)\G(?:<s>\[INST\] " + _TEXT + r"(?<= )\[/INST\]|<s><<SYS>> " + _TEXT + r"(?<= )<</SYS>>| " + _TEXT + r"</s>|<\|role\|>"
         + _ROLE + r"\n" + _TEXT + r"<\|end\|>)")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _TO_ESCAPE, r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _head(role: Column) -> Column:
    return (F.when(role == "user", F.lit("<s>[INST] ")).when(role == "system", F.lit("<s><<SYS>> "))
            .when(role == "assistant", F.lit(" "))
            .otherwise(F.concat(F.lit("<|role|>"), F.regexp_replace(escape(role), "\n", r"\\$0"), F.lit("\n"))))


def _tail(role: Column) -> Column:
    return (F.when(role == "user", F.lit(" [/INST]")).when(role == "system", F.lit(" <</SYS>>"))
            .when(role == "assistant", F.lit("</s>")).otherwise(F.lit("<|end|>")))


def conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """(conv_id, parts): a conversation's formatted turns in order; null roles and texts count as empty.

    Turns are ordered by turn (null first), then role, then text; repeated rows are turns of their own.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                        role.alias("role"), text.alias("text"))
    rows = rows.select("conv_id", "turn", "role", "text", _head(F.col("role")).alias("head"), escape(F.col("text")).alias("body"),
                       _tail(F.col("role")).alias("tail"))
    # a conversation is one document, so its turns meet in one row
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "head", "body", "tail"))).alias("parts"))


def examples(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text") -> DataFrame:
    """(conv_id, example, n_turns, formatted, loss_start, loss_end): one row per assistant turn.

    ``n_turns`` counts the turns in the example; the mask [loss_start, loss_end) is in code points and null
    for the trailing turns after the last assistant turn.  A null conversation id is a conversation; an empty
    table gives no rows; other columns are ignored.
    """
    conv = conversations(turns, conv_col, turn_col, role_col, text_col)
    parts = F.col("parts")
    last = F.size(parts) - 1
    ends = F.filter(F.sequence(F.lit(0), last), lambda i: (F.get(parts, i)["role"] == "assistant") | (i == last))
    rows = conv.select("conv_id", "parts", F.posexplode(ends).alias("example", "at"))
    before = F.when(F.col("at") > 0, F.slice(parts, F.lit(1), F.greatest(F.col("at"), F.lit(1)))).otherwise(F.slice(parts, 1, 0))
    own = F.get(parts, F.col("at"))
    rows = rows.select("conv_id", "example", (F.col("at") + 1).cast("long").alias("n_turns"), own.alias("own"),
                       F.array_join(F.transform(before, lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("context"))
    start = F.length("context") + F.length("own.head")
    target = F.col("own.role") == "assistant"
    return rows.select("conv_id", "example", "n_turns", F.concat("context", "own.head", "own.body", "own.tail").alias("formatted"),
                       F.when(target, start).cast("long").alias("loss_start"),
                       F.when(target, start + F.length("own.body")).cast("long").alias("loss_end"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns in an example's text."""
    def group(i: int) -> Column:
        return F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(i))
    whole = F.arrays_zip(group(0).alias("w"), group(1).alias("u"), group(2).alias("s"), group(3).alias("a"), group(4).alias("r"),
                         group(5).alias("t"))
    body = lambda t: F.substring(t, F.lit(1), F.length(t) - 1)
    w = lambda x, mark: F.startswith(x["w"], F.lit(mark))
    return F.transform(whole, lambda x: F.when(w(x, "<s>[INST]"), F.struct(F.lit("user").alias("role"), unescape(body(x["u"])).alias("text")))
                       .when(w(x, "<s><<SYS>>"), F.struct(F.lit("system").alias("role"), unescape(body(x["s"])).alias("text")))
                       .when(w(x, " "), F.struct(F.lit("assistant").alias("role"), unescape(x["a"]).alias("text")))
                       .otherwise(F.struct(unescape(x["r"]).alias("role"), unescape(x["t"]).alias("text"))))


def digest(ex: DataFrame) -> DataFrame:
    """Per conversation, from the examples alone: its turns, the text under the masks, and its length."""
    masked = unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    rows = ex.select("conv_id", "example", "n_turns", "formatted", F.coalesce(masked, F.lit("")).alias("masked"))
    per = rows.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"), F.max_by("formatted", "example").alias("whole"),
        F.array_join(F.array_sort(F.collect_list(F.struct("example", "masked")))["masked"], "").alias("loss"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"))
    turns = F.array_join(F.transform(read_back(F.col("whole")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return per.select("conv_id", F.size(read_back(F.col("whole"))).cast("long").alias("n_turns"),
                      F.sha2(turns.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
                      F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
