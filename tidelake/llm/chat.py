"""Chat formatting of conversations whose turns hold typed content parts.

A visitor turns each part into text: text parts are escaped, an image, audio or document
becomes a placeholder, and its reference, caption and expanded token count are recorded
in the order of the placeholders. Turns are then marked by control strings and joined:

    [INST] user\\ntext [/INST]<s> reply </s>

A control string inside a text gets a backslash after its first character, one more than
it has there already, so no text can hold a control string and escaping is undone exactly.
All of it is built-in SQL functions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REPLY_ROLE = "assistant"
TURN_OPEN, TURN_CLOSE = "[INST] ", " [/INST]"
REPLY_OPEN, REPLY_CLOSE = "<s> ", " </s>"
PLACEHOLDERS = {"image": "[IMG]", "audio": "[AUDIO]", "document": "[DOC]"}
CONTROL = (*(s.strip() for s in (TURN_OPEN, TURN_CLOSE, REPLY_OPEN, REPLY_CLOSE)), *PLACEHOLDERS.values())

PART = "struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
PARTS = f"array<{PART}>"
_ATTACHMENTS = "array<struct<kind:string,uri:string,caption:string,tokens:bigint>>"

_FIRST = "([<\\[])"
_REST = "(?:" + "|".join(re.escape(c[1:]) for c in CONTROL) + ")"
#: A control string with any number of backslashes after its first character; the same in Java and RE2.
PLAIN_PATTERN = f"{_FIRST}(\\\\*{_REST})"
_MARKED = f"{_FIRST}\\\\(\\\\*{_REST})"
_TURN = f"(?s){re.escape(TURN_OPEN.strip())} [^\\n]*\\n.*?{' ' + re.escape(TURN_CLOSE.strip())}|<s> .*? </s>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, PLAIN_PATTERN, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _MARKED, "$1$2")


def escaped_role(role: Column) -> Column:
    """A role on one line: beside control strings, backslashes and line feeds are spelt out."""
    return F.replace(F.replace(escaped(role), F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\")))


class PartVisitor:
    """What each type of part becomes: its text in the output and the tokens it stands for.

    A part without a known type is visited as text. Unknown sizes count as one unit.
    """

    def __init__(self, patch: int = 28, audio_tokens_per_second: float = 12.5, page_tokens: int = 1024):
        self.patch, self.per_second, self.per_page = patch, audio_tokens_per_second, page_tokens

    def text(self, part: Column) -> Column:
        return escaped(F.coalesce(part["text"], F.lit("")))

    def image(self, part: Column) -> Column:
        """One token a patch."""
        wide, high = (F.ceil(F.greatest(F.coalesce(part[n], F.lit(1)), F.lit(1)) / self.patch) for n in ("width", "height"))
        return wide * high

    def audio(self, part: Column) -> Column:
        seconds = F.greatest(F.coalesce(F.nanvl(part["seconds"], F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
        return F.greatest(F.ceil(F.least(seconds, F.lit(1e12)) * self.per_second), F.lit(1))

    def document(self, part: Column) -> Column:
        return F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)).cast("long") * self.per_page

    def visit(self, part: Column) -> Column:
        """(text, attachment) of one part; the attachment of a text part is null."""
        text, attachment = self.text(part), F.lit(None)
        for kind, mark in PLACEHOLDERS.items():
            record = F.struct(
                F.lit(kind).alias("kind"), part["uri"].alias("uri"), part["text"].alias("caption"),
                getattr(self, kind)(part).cast("long").alias("tokens"),
            )
            is_kind = F.equal_null(part["type"], F.lit(kind))
            text = F.when(is_kind, mark).otherwise(text)
            attachment = F.when(is_kind, record).otherwise(attachment)
        return F.struct(text.alias("text"), attachment.alias("attachment"))


def text_part(text: Column) -> Column:
    """A column of texts as one text part each."""
    fields = [F.lit("text").alias("type"), text.alias("text"), *(F.lit(None).alias(n) for n in ("uri", "width", "height", "seconds", "pages"))]
    return F.array(F.struct(*fields)).cast(PARTS)


def format_chats(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    parts: Column | None = None,
    visitor: PartVisitor | None = None,
) -> DataFrame:
    """conv_id, n_turns, formatted, loss and attachments of every conversation.

    ``parts`` is a column of typed parts (``PARTS``); by default the rows' ``text`` is one text
    part. ``loss`` lists the code points (start, end exclusive) of each reply's text,
    ``attachments`` (kind, uri, caption, tokens) goes with the placeholders in order. Rows go
    by turn, null first, equal turns by role and text; a repeated row is a turn of its own.
    A null role or text is empty, null or no parts an empty text, rows without a
    conversation id are one conversation. A conversation is one string, so its turns meet
    in one task, already formatted. An empty table gives an empty result.
    """
    visitor = visitor or PartVisitor()
    role = F.coalesce(F.col(role_col), F.lit(""))
    given = F.coalesce(text_part(F.col("text")) if parts is None else parts.cast(PARTS), F.array().cast(PARTS))
    known = F.filter(given, lambda p: p.isNotNull())
    visited = rows.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"),
        F.transform(known, visitor.visit).alias("visited"),
    )
    reply = F.col("role") == REPLY_ROLE
    body = F.array_join(F.transform("visited", lambda v: v["text"]), "")
    turns = visited.select(
        "conv_id", "turn", "role", body.alias("body"),
        F.filter(F.transform("visited", lambda v: v["attachment"]), lambda a: a.isNotNull()).cast(_ATTACHMENTS).alias("attachments"),
    ).select(
        "conv_id", "turn", "role", "attachments",
        F.when(reply, F.concat(F.lit(REPLY_OPEN), "body", F.lit(REPLY_CLOSE)))
        .otherwise(F.concat(F.lit(TURN_OPEN), escaped_role(F.col("role")), F.lit("\n"), "body", F.lit(TURN_CLOSE)))
        .alias("piece"),
        F.when(reply, F.length("body")).alias("loss"),
    )
    order = ["turn", "role", "piece", "attachments"]
    so_far = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = turns.withColumn("at", F.sum(F.length("piece")).over(so_far) - F.length("piece"))
    listed = placed.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("at", "piece", "loss", "attachments"))).alias("turns"),
    )
    opened = len(REPLY_OPEN)
    return listed.select(
        "conv_id",
        "n_turns",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(
            F.filter("turns", lambda t: t["loss"].isNotNull()),
            lambda t: F.struct((t["at"] + opened).alias("start"), (t["at"] + opened + t["loss"]).alias("end")),
        ).alias("loss"),
        F.flatten(F.transform("turns", lambda t: t["attachments"])).alias("attachments"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: role and the unescaped texts between its placeholders."""
    marks = "|".join(re.escape(p) for p in PLACEHOLDERS.values())

    def read(turn: Column) -> Column:
        reply = turn.startswith(REPLY_OPEN)
        header = F.regexp_extract(turn, r"^\[INST\] ([^\n]*)\n", 1)
        start = F.when(reply, len(REPLY_OPEN)).otherwise(len(TURN_OPEN) + F.length(header) + 1)
        close = F.when(reply, len(REPLY_CLOSE)).otherwise(len(TURN_CLOSE))
        body = F.substr(turn, start + 1, F.length(turn) - start - close)
        return F.struct(
            F.when(reply, REPLY_ROLE).otherwise(unescaped_role(header)).alias("role"),
            F.transform(F.split(body, marks, -1), unescaped).alias("texts"),
        )

    return F.transform(_cut_turns(formatted), read)


def _cut_turns(formatted: Column) -> Column:
    return F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The unescaped texts under a loss mask, one per span; each span lies in one reply.

    A span is read from its own turn, so long conversations are not searched from their
    beginning for every span.
    """
    turns = _cut_turns(formatted)
    begin = F.aggregate(
        turns,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("found")),
        lambda seen, t: F.struct((seen["at"] + F.length(t)).alias("at"), F.concat(seen["found"], F.array(seen["at"])).alias("found")),
        lambda seen: seen["found"],
    )
    replies = F.filter(
        F.arrays_zip(turns.alias("turn"), begin.alias("at")), lambda t: t["turn"].startswith(REPLY_OPEN)
    )
    both = F.zip_with(
        replies, loss,
        lambda r, s: F.substr(r["turn"], (s["start"] - r["at"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")),
    )
    return F.transform(both, unescaped)


def digests(rows: DataFrame, **columns) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, read back from the output."""
    back = format_chats(rows, **columns).select(
        "conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"),
        F.array_join(read_loss(F.col("formatted"), F.col("loss")), "").alias("learnt"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), F.array_join(t["texts"], ""), F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def with_rows(rows: DataFrame, conv_id: int, turns: Iterable[tuple[str, str]]) -> DataFrame:
    """The columns conv_id, turn, role and text of the rows, and one more conversation."""
    one = rows.sparkSession.range(1)
    for place, (role, text) in enumerate(turns):
        values = [F.lit(v).alias(n) for n, v in zip(("conv_id", "turn", "role", "text"), (conv_id, place, role, text))]
        rows = rows.select("conv_id", "turn", "role", "text").unionByName(one.select(*values))
    return rows
