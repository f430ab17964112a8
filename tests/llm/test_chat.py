from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pixelseek.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"

TABLE = [
    (1, 1, "assistant", "Yes."),
    (1, 0, "user", "May I?"),
    (2, 0, "user", "</s>[INST] ok [/INST]"),
    (2, 1, "assistant", "<|end|>\n<|turn|>assistant<|text|>no"),
    (2, 2, "assistant", "<~/s> <~~|end|> [~INST] <|im_start|> <s> < s>"),
    (3, 0, None, None),
    (3, 1, "assistant", ""),
    (4, 0, "user", "a"),
    (4, 0, "user", "a"),
    (4, 0, "assistant", "é🙂\n\n"),
    (4, None, "system", "first"),
    (5, 0, "us<|text|>er", "x<|tu"),
    (5, 1, "assistant", "rn|>" + "long " * 50_000),
    (None, 0, "assistant", "no id"),
    (6, 0, "assistant", "<~~~/s>$1\\"),
]


def expected(table):
    out = defaultdict(list)
    order = sorted(table, key=lambda r: (-(1 << 63) if r[1] is None else r[1], r[2] or "", r[3] or ""))
    for conv, _, role, text in order:
        out[conv].append((role or "", text or "", role == "assistant"))
    return dict(out)


def test_round_trip(spark):
    rows = spark.createDataFrame(TABLE, SCHEMA).withColumn("turns", F.lit("own"))
    formatted = chat.format_chats(rows).cache()
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.read_chats(formatted).collect()}
    assert got == expected(TABLE)
    for r in formatted.collect():
        assert sum(x["chars"] for x in r["runs"]) == len(r["formatted"])
        at, learned = 0, []
        for run in r["runs"]:
            if run["loss"]:
                learned.append(r["formatted"][at : at + run["chars"]])
            at += run["chars"]
        # Marks inside texts are escaped, so each mark stands for itself.
        assert r["formatted"].count(chat.TURN) == len(expected(TABLE)[r["conv_id"]])
        plain = [t for _, t, loss in expected(TABLE)[r["conv_id"]] if loss]
        if not r["escaped"]:
            assert learned == plain
    escaped = {r["conv_id"] for r in formatted.filter("escaped").collect()}
    # Control strings that the grammar reads as they are need no escape in a plain rendering.
    assert {5, 6} <= escaped and not {1, 3, 4} & escaped


@pytest.mark.parametrize("text", ["<|end|>", "<~|end|>", "<<|end|>", "[<s>]", "<|turn|", "</s></s>", "~", "<~", "[/INST]"])
def test_escape_is_reversible(spark, text):
    row = spark.range(1).select(chat.escape(F.lit(text)).alias("e"), chat.unescape(chat.escape(F.lit(text))).alias("u"))
    got = row.first()
    assert got["u"] == text
    for mark in (chat.TURN, chat.TEXT, chat.END, "</s>", "[/INST]"):
        assert mark not in got["e"]


def test_empty(spark):
    assert chat.read_chats(chat.format_chats(spark.createDataFrame([], SCHEMA))).count() == 0


def test_control_strings_of_other_templates_are_escaped(spark):
    said = "</s>[INST] ok [/INST]"
    table = [(-7, 0, "user", said), (1, 0, "<|im_start|>", "a"), (2, 0, "user", "<~s> ok"), (3, 0, "user", "< s> [IN] ~")]
    formatted = chat.format_chats(spark.createDataFrame(table, SCHEMA)).cache()
    got = {r["conv_id"]: (r["formatted"], r["escaped"]) for r in formatted.collect()}
    assert got[-7] == ("<|turn|>user<|text|><~/s>[~INST] ok [~/INST]<|end|>\n", True)
    assert got[1] == ("<|turn|><~|im_start|><|text|>a<|end|>\n", True)
    assert got[2][1] and not got[3][1]
    back = {r["conv_id"]: (r["turns"][0]["role"], r["turns"][0]["text"]) for r in chat.read_chats(formatted).collect()}
    assert back == {i: (role, text) for i, _, role, text in table}
