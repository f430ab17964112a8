"""Chat formatting that is proved by a grammar round trip.

Grammar of a formatted conversation: ``{<|turn|> role <|text|> text <|end|> newline}``. It is rendered plainly, parsed
by the same deterministic grammar, and the recovered turns are compared with the source. Conversations that don't come
back identical, or hold any control string, are rendered again with their conflicting content escaped, parsed and
compared once more; a conversation that still differed would stop the job.

Escape: a control string has one opening bracket, its first character. One ``~`` is inserted after the bracket, also
where others stand there already; reading takes one away. An escaped text holds no control string, and a text without
control strings is its own escaped form. As control strings hold no second bracket, none can arise where texts meet
marks.

Defined cases: null role or text is empty; turns of equal number are ordered by role and text; repeated rows are
repeated turns; a null turn comes first; rows of a null conv_id form one conversation; an empty table gives an empty
table; other columns are ignored. A conversation is one text, so it must fit into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelseek.llm.common import bound

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
LEARNED_ROLE = "assistant"

# Control strings, without their opening bracket: the marks above and those of common chat templates.
_REST = (
    r"\|(?:turn|text|end|im_start|im_end|im_sep|endoftext|startoftext|system|user|assistant|begin_of_text"
    r"|end_of_text|start_header_id|end_header_id|eot_id)\|>|/?s>|unk>|pad>|bos>|eos>|/?INST\]|start_of_turn>"
    r"|end_of_turn>"
)
_PLAIN = rf"([<\[])(~*)({_REST})"
_ESCAPED = rf"([<\[])~(~*)({_REST})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_PLAIN), F.lit("$1~$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPED), F.lit("$1$2$3"))


def _piece(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN), role, F.lit(TEXT), text, F.lit(END + "\n"))


def _render(turns: Column, how) -> Column:
    return F.array_join(F.transform(turns, lambda t: _piece(how(t["role"]), how(t["text"]))), "")


def parse(formatted: Column) -> Column:
    """array<struct<role, text, body_chars, head_chars>> of the turns; ill-formed pieces give null fields."""
    pieces = F.split(formatted, TURN.replace("|", r"\|"), -1)
    tail = END + "\n"

    def turn(piece: Column) -> Column:
        at = F.instr(piece, TEXT)
        body = F.when(
            (at > 0) & F.endswith(piece, F.lit(tail)),
            F.substr(piece, at + len(TEXT), F.length(piece) - at - len(TEXT) - len(tail) + 1),
        )
        role = F.when(at > 0, F.substr(piece, F.lit(1), at - 1))
        return F.struct(
            unescape(role).alias("role"),
            unescape(body).alias("text"),
            F.length(body).alias("body_chars"),
            (F.length(role) + len(TURN) + len(TEXT)).alias("head_chars"),
        )

    # The first piece is what stands before the first turn: nothing.
    return bound(pieces, lambda p: F.transform(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), turn))


def _same(parsed: Column, turns: Column) -> Column:
    bare = F.transform(parsed, lambda p: F.struct(p["role"].alias("role"), p["text"].alias("text")))
    return bare.eqNullSafe(turns)


def format_chats(rows: DataFrame, learned_role: str = LEARNED_ROLE) -> DataFrame:
    """(conv_id, formatted, escaped, runs) per conversation.

    ``runs`` is the loss mask over the code points of ``formatted``: array<struct<chars, loss>> in order, three per
    turn (marks before the text, the text, marks after it)."""
    turns = F.transform(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))).alias("turn"),
                    F.coalesce(F.col("role"), F.lit("")).alias("role"),
                    F.coalesce(F.col("text"), F.lit("")).alias("text"),
                )
            )
        ),
        lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")),
    )
    source = rows.groupBy("conv_id").agg(turns.alias("turns"))
    plain = source.withColumn("plain", _render(F.col("turns"), lambda c: c))
    # Control strings of other templates come back by themselves, so the round trip alone doesn't show them.
    control = F.exists("turns", lambda t: (escape(t["role"]) != t["role"]) | (escape(t["text"]) != t["text"]))
    tried = plain.withColumn("escaped", control | ~_same(parse(F.col("plain")), F.col("turns")))
    done = tried.withColumn(
        "formatted", F.when(F.col("escaped"), _render(F.col("turns"), escape)).otherwise(F.col("plain"))
    ).withColumn("parsed", parse(F.col("formatted")))
    proved = done.withColumn(
        "parsed",
        F.when(~F.col("escaped") | _same(F.col("parsed"), F.col("turns")), F.col("parsed")).otherwise(
            F.raise_error(F.concat(F.lit("no round trip: conversation "), F.col("conv_id").cast("string")))
        ),
    )

    def run(chars: Column, loss: Column) -> Column:
        return F.struct(chars.cast("long").alias("chars"), loss.alias("loss"))

    runs = F.flatten(
        F.transform(
            F.col("parsed"),
            lambda p: F.array(
                run(p["head_chars"], F.lit(False)),
                run(p["body_chars"], p["role"] == learned_role),
                run(F.lit(len(END) + 1), F.lit(False)),
            ),
        )
    )
    return proved.select("conv_id", "formatted", "escaped", runs.alias("runs"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text, loss>>, formatted_chars) read back from text and mask."""
    parsed = parse(F.col("formatted"))
    mask = F.filter(F.col("runs"), lambda _, i: i % 3 == 1)
    turns = F.zip_with(
        parsed, mask, lambda p, m: F.struct(p["role"].alias("role"), p["text"].alias("text"), m["loss"].alias("loss"))
    )
    return formatted.select("conv_id", turns.alias("turns"), F.length("formatted").cast("long").alias("formatted_chars"))
