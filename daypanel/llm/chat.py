"""Chat formatting: conversations to marked text and back, in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daypanel.functions.series import let
from daypanel.llm.text import named

# The marks of the template.
START = "<|im_start|>"
NEXT = "<|im_sep|>"
END = "<|im_end|>"
TRAINED_ROLE = "assistant"

#: Characters of the blocks that a text is read by, so that a span costs its own length and not that of what stands before it.
BLOCK = 4096
#: Pieces whose places are added up at once.
PIECES = 256


def escape(text: Column) -> Column:
    """Text without any mark in it; `unescape` undoes it exactly."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    """Every `&` of an escaped text opens `&lt;|` or `&amp;`, so the two steps can't meet."""
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def _cut(blocks: Column, start: Column, length: Column) -> Column:
    """The `length` characters from `start` on of a text in blocks of `BLOCK` characters, of which only those it lies in are read."""
    first = F.floor(start / BLOCK).cast("int")
    last = F.floor((start + length) / BLOCK).cast("int")
    near = F.array_join(F.transform(F.sequence(first, last), lambda i: F.coalesce(F.get(blocks, i), F.lit(""))), "")
    return near.substr(start - first * BLOCK + 1, length)


def _spans(pieces: Column) -> Column:
    """Where the trained pieces lie, (start, length) each.

    An array grows by being copied, so places are added up in blocks of pieces,
    after the blocks' own lengths were.
    """
    none = F.filter(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("length"))), lambda _: F.lit(False))
    whole = lambda p: p["before"] + p["own"] + p["after"]
    last = F.floor((F.size(pieces) - 1) / PIECES).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(pieces, b * PIECES + 1, PIECES))

    def begins(cut: Column) -> Column:
        lengths = F.transform(cut, lambda block: F.aggregate(block, F.lit(0), lambda n, p: n + whole(p)))
        start = F.struct(F.lit(0).alias("at"), F.filter(F.array(F.lit(0)), lambda _: F.lit(False)).alias("out"))
        return F.aggregate(
            lengths,
            start,
            lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
            lambda acc: acc["out"],
        )

    def inside(block: Column, begin: Column) -> Column:
        def step(acc: Column, p: Column) -> Column:
            span = F.struct((acc["at"] + p["before"]).alias("start"), p["own"].alias("length"))
            spans = F.when(p["trained"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
            return F.struct((acc["at"] + whole(p)).alias("at"), spans.alias("spans"))

        return F.aggregate(block, F.struct(begin.alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])

    return let(
        blocks, lambda cut: let(begins(cut), lambda at: F.flatten(F.transform(cut, lambda block, i: inside(block, F.get(at, i)))))
    )


def format_conversations(
    rows: DataFrame, conversation: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: its formatted text and the spans that training scores.

    The turns are collected as structs and sorted; adjacent turns of one role
    become one message, `<|im_start|>role\\n...<|im_end|>\\n`, whose texts stand
    apart by `<|im_sep|>`. `loss_spans` holds, in code points from 0, where each
    assistant turn's text lies in `formatted`: neither marks nor separators.

    A null role or text counts as empty, rows of a null conversation form one
    conversation of their own, equal turn numbers are ordered by role and text
    (a null number comes first), repeated rows are all kept, an empty table
    gives no rows, and columns other than the four named are left out. One
    conversation is one text, hence one row of one task, which holds it a few
    times over; its turns are limited by the two gigabytes of a string.
    """
    turns = rows.select(
        named(conversation).alias("conv_id"),
        F.struct(
            named(order).alias("turn"),
            F.coalesce(named(role), F.lit("")).alias("role"),
            F.coalesce(named(text), F.lit("")).alias("text"),
        ).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # A message starts where the role changes.
    starts = F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]),
    )
    starting = whole.withColumn("starts", starts)
    merged = starting.withColumn(
        "messages",
        F.transform(
            "starts",
            lambda s, k: F.struct(
                F.get("turns", s)["role"].alias("role"),
                F.transform(
                    F.slice("turns", s + 1, F.coalesce(F.get("starts", k + 1), F.size("turns")) - s),
                    lambda t: escape(t["text"]),
                ).alias("texts"),
            ),
        ),
    )
    head = lambda m: F.concat(F.lit(START), _escape_role(m["role"]), F.lit("\n"))
    tail = f"{END}\n"
    formatted = F.array_join(
        F.transform("messages", lambda m: F.concat(head(m), F.array_join(m["texts"], NEXT), F.lit(tail))), ""
    )

    def pieces(m: Column) -> Column:
        """Each text of a message: characters before it, its own, those that follow, and whether it is trained."""
        last = F.size(m["texts"]) - 1
        return F.transform(
            m["texts"],
            lambda t, k: F.struct(
                F.when(k == 0, F.length(head(m))).otherwise(F.lit(len(NEXT))).alias("before"),
                F.length(t).alias("own"),
                F.when(k == last, F.lit(len(tail))).otherwise(F.lit(0)).alias("after"),
                (m["role"] == TRAINED_ROLE).alias("trained"),
            ),
        )

    spans = let(F.flatten(F.transform("messages", pieces)), _spans)
    return merged.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"))


def read_conversations(formatted: DataFrame) -> DataFrame:
    """The turns in the order in which they were formatted, read from `formatted` alone, and the scored texts.

    Adds `turns`, an array of (role, text) unescaped, and `loss_texts`, the text
    under each span of `loss_spans`. A null or empty `formatted` has no turns.
    """
    messages = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda p: F.instr(p, END) > 0)

    def turns(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        body = F.substring_index(p.substr(F.length(head) + 2, F.length(p)), END, 1)
        return F.transform(
            F.split(body, r"<\|im_sep\|>"),
            lambda t: F.struct(_unescape_role(head).alias("role"), unescape(t).alias("text")),
        )

    return formatted.withColumn(
        "turns", F.coalesce(F.flatten(F.transform(messages, turns)), F.array().cast("array<struct<role:string,text:string>>"))
    ).withColumn(
        "loss_texts",
        let(
            F.regexp_extract_all("formatted", F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0)),
            lambda blocks: F.transform("loss_spans", lambda s: unescape(_cut(blocks, s["start"], s["length"]))),
        ),
    )
