"""Chat formatting against plain strings, and exact round trips."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F
from tests.llm.helpers import SF

from tidelake.llm import chat

ROWS = "conv_id long, turn long, role string, text string"
PARTED = f"conv_id long, turn long, role string, parts {chat.PARTS}, formatted string, at long, body string"
NASTY = ["<s>", "</s>", "[INST]", "[/INST]", "[IMG]", "[\\INST]", "<\\\\/s>", "\\", "[", "<", " ", "\n", "é", "\U0001f600", " [/INST]", "<s> ", "a", ""]


def plain_escape(text):
    return re.sub(r"([<\[])(\\*(?:/?s>|/?INST\]|IMG\]|AUDIO\]|DOC\]))", r"\1\\\2", text)


def plain_role(role):
    return plain_escape(role).replace("\\", "\\s").replace("\n", "\\n")


def plain(rows):
    """conversation: (formatted, turns, loss spans), by hand."""
    out = {}
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for conv, turns in groups.items():
        formatted, spans = "", []
        for _, _, role, text in sorted(turns):
            if role == "assistant":
                start = len(formatted) + 4
                formatted += f"<s> {plain_escape(text)} </s>"
                spans.append((start, len(formatted) - 5))
            else:
                formatted += f"[INST] {plain_role(role)}\n{plain_escape(text)} [/INST]"
        out[conv] = formatted, [(r, t) for _, _, r, t in sorted(turns)], spans
    return out


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def wanted(rows):
    out = {}
    for conv, (formatted, turns, _) in plain(rows).items():
        learnt = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), digest(learnt), len(formatted))
    return out


def test_digests_of_the_whole_table(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    probe = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = {r[0]: tuple(r[1:]) for r in chat.digests(chat.with_rows(table, -1, probe)).collect()}
    assert got == wanted([*rows, *((-1, i, *t) for i, t in enumerate(probe))])
    assert got[-1][0] == 2 and got[-1][3] == digest(probe[1][1])


def test_round_trip_of_nasty_texts(spark):
    rng = random.Random(12)
    roles = ["user", "assistant", "system", None, "", "a\nb", "[INST] x\\", "assistant ", "\\n", "\\s\n"]
    rows = [
        (rng.randrange(60), rng.choice([None, 0, 1, 2, 3]), rng.choice(roles), "".join(rng.choice(NASTY) for _ in range(rng.randrange(9))) or None)
        for _ in range(600)
    ]
    rows += [(None, 1, "user", "no id"), (None, 2, "assistant", "none"), *[(7, 9, "assistant", "twice")] * 3]
    rows += [(99, 0, "user", "long [INST] " * 30_000), (99, 1, "assistant", "<s>" * 50_000)]
    frame = spark.createDataFrame(rows, ROWS).withColumn("formatted", F.lit("clash")).withColumn("at", F.lit("clash"))
    assert {r[0]: tuple(r[1:]) for r in chat.digests(frame).collect()} == wanted(rows)
    found = {r.conv_id: r for r in chat.format_chats(frame).collect()}
    for conv, (formatted, _, spans) in plain(rows).items():
        assert found[conv].formatted == formatted
        assert [tuple(s) for s in found[conv].loss] == spans
        assert found[conv].attachments == []


def test_a_conversation_of_many_turns(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i} </s>") for i in range(8000)]
    frame = spark.createDataFrame(rows, ROWS).repartition(4)
    assert {r[0]: tuple(r[1:]) for r in chat.digests(frame).collect()} == wanted(rows)


def test_parts_become_placeholders_with_records(spark):
    def part(kind, text=None, uri=None, width=None, height=None, seconds=None, pages=None):
        return kind, text, uri, width, height, seconds, pages

    rows = [
        (1, 0, "user", [part("text", "look [IMG] "), part("image", "a cat", "s3://i/1", 57, 28), part("text", " and "),
                        part("audio", None, "s3://a/2", seconds=1.5), None, part(None, "?")], "x", 0, "y"),
        (1, 1, "assistant", [part("text", "see"), part("document", None, "s3://d/3", pages=3), part("film", "!", "s3://f")], "x", 0, "y"),
        (1, 2, "user", None, "x", 0, "y"),
        (1, 3, "user", [], "x", 0, "y"),
        (2, 0, "user", [part("image"), part("audio", seconds=float("nan")), part("document", pages=-4), part("image", width=0, height=-2),
                        part("audio", seconds=float("inf"))], "x", 0, "y"),
    ]
    frame = spark.createDataFrame(rows, PARTED)
    out = {r.conv_id: r for r in chat.format_chats(frame, parts=F.col("parts")).collect()}
    assert out[1].formatted == (
        "[INST] user\nlook [\\IMG] [IMG] and [AUDIO]? [/INST]<s> see[DOC]! </s>[INST] user\n [/INST][INST] user\n [/INST]"
    )
    assert [tuple(a) for a in out[1].attachments] == [
        ("image", "s3://i/1", "a cat", math.ceil(57 / 28) * 1), ("audio", "s3://a/2", None, math.ceil(1.5 * 12.5)),
        ("document", "s3://d/3", None, 3 * 1024),
    ]
    start = out[1].formatted.index("see")
    assert [tuple(s) for s in out[1].loss] == [(start, start + len("see[DOC]!"))]
    assert [a.tokens for a in out[2].attachments][:4] == [1, 1, 1024, 1]
    back = chat.format_chats(frame, parts=F.col("parts")).select("conv_id", chat.read_turns(F.col("formatted")).alias("t")).collect()
    texts = {r.conv_id: [(t.role, t.texts) for t in r.t] for r in back}
    assert texts[1] == [("user", ["look [IMG] ", " and ", "?"]), ("assistant", ["see", "!"]), ("user", [""]), ("user", [""])]
    assert texts[2] == [("user", [""] * 6)]


def test_other_sizes_of_a_visitor(spark):
    rows = [(1, 0, "user", [("image", None, None, 100, 100, None, None), ("document", None, None, None, None, None, 2)], "x", 0, "y")]
    visitor = chat.PartVisitor(patch=50, page_tokens=10)
    found = chat.format_chats(spark.createDataFrame(rows, PARTED), parts=F.col("parts"), visitor=visitor).first()
    assert [a.tokens for a in found.attachments] == [4, 20]


def test_empty_table_and_no_python(spark, capsys):
    none = spark.createDataFrame([], ROWS)
    assert chat.digests(none).count() == 0
    chat.digests(none).explain("extended")
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)
