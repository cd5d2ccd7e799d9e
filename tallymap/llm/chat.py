r"""Chat formatting with a grammar round trip (operator 9), in DataFrame functions only.

A conversation is written as turns ``<s>[INST] role [/INST]text</s>``.  The reader is
deterministic: turns end at ``</s>``, the role stands between the first pair of marks,
and in roles and texts the escapes ``\\``, ``\l`` and ``\b`` mean ``\``, ``<`` and ``[``.
Every rendered turn is read again and compared with its source; a turn that does not
come back is escaped, and a whole conversation that does not come back has all its
turns escaped, after which no control string is left in it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import text_or_empty

OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST]", "</s>"
ANSWERS = "assistant"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def unescape(text: Column) -> Column:
    """Double backslashes are cut out first, so that what is left of them cannot start an escape."""
    part = lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("["))
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text, start, body>> of a formatted conversation; ``body`` is the text as written.

    ``start`` is the piece's number; a piece outside the grammar has a null role.
    """
    pieces = F.filter(F.split(formatted, CLOSE, -1), lambda p: p != "")
    lead = len(OPEN)

    def one(piece: Column, at: Column) -> Column:
        cut = F.instr(piece, MIDDLE)
        good = F.startswith(piece, F.lit(OPEN)) & (cut > 0)
        role = F.when(good, F.substring(piece, F.lit(lead + 1), cut - F.lit(lead + 1)))
        body = F.substring(piece, cut + F.lit(len(MIDDLE)), F.length(piece))
        return F.struct(
            unescape(role).alias("role"), unescape(body).alias("text"), at.alias("start"), body.alias("body")
        )

    return F.transform(pieces, one)


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans, n_turns, source_sha256, verified) per conversation.

    ``turns`` has conv_id, turn, role, text; a null role or text is an empty one, a null
    conv_id is a conversation of its own, equal turn numbers are ordered by role and text,
    null turn numbers come first.  ``loss_spans`` are (start, length) code point ranges of
    the assistant's texts in ``formatted``; ``verified`` says that reading back gave the source.
    """
    rows = turns.select(
        "conv_id", "turn", text_or_empty("role").alias("role"), text_or_empty("text").alias("text")
    )
    plain = render(F.col("role"), F.col("text"))
    back = read_turns(plain)
    same = (F.size(back) == 1) & (back[0]["role"] == F.col("role")) & (back[0]["text"] == F.col("text"))
    rows = rows.withColumn("fits", F.coalesce(same, F.lit(False)))
    chats = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text", "fits"))).alias("turns")
    )
    written = lambda keep: F.transform(
        "turns",
        lambda t: F.struct(
            t["role"].alias("source_role"),
            t["text"].alias("source"),
            F.when(keep(t), t["role"]).otherwise(escape(t["role"])).alias("role"),
            F.when(keep(t), t["text"]).otherwise(escape(t["text"])).alias("text"),
        ),
    )
    joined = lambda w: F.array_join(F.transform(w, lambda t: render(t["role"], t["text"])), "")
    pairs = lambda a, role: F.transform(a, lambda t: F.struct(t[role].alias("r"), t["text"].alias("t")))
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("r"), t["text"].alias("t")))
    first = chats.select("conv_id", "turns", written(lambda t: t["fits"]).alias("some"))
    first = first.withColumn("formatted", joined(F.col("some")))
    first = first.withColumn("good", pairs(read_turns(F.col("formatted")), "role") == source)
    safe = first.withColumn("written", F.when(F.col("good"), F.col("some")).otherwise(written(lambda t: F.lit(False))))
    safe = safe.withColumn("formatted", F.when(F.col("good"), F.col("formatted")).otherwise(joined(F.col("written"))))
    ends = F.transform(
        "written", lambda t: F.length(render(t["role"], t["text"])).cast("long")
    )
    safe = safe.withColumn("sizes", ends).withColumn("verified", pairs(read_turns(F.col("formatted")), "role") == source)
    return safe.select(
        "conv_id",
        "formatted",
        _spans().alias("loss_spans"),
        F.size("turns").cast("long").alias("n_turns"),
        turns_digest(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))).alias(
            "source_sha256"
        ),
        "verified",
    )


#: Turns whose sizes are added up together, so that starts of many turns are not each counted from the first.
RUN = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: a lambda variable holds it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _starts(sizes: Column) -> Column:
    """Sum of the sizes before each one, by sums of whole runs and of what is before in the own run."""
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    first = lambda run: run * RUN + 1
    every = lambda n, body: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), body)).otherwise(
        F.array().cast("array<bigint>")
    )
    runs = lambda s: every(F.ceil(F.size(s) / RUN).cast("int"), lambda r: add(F.slice(s, first(r), RUN)))
    before = lambda sums: every(F.size(sums), lambda r: add(F.slice(sums, 1, r)))

    def start(s: Column, offsets: Column, i: Column) -> Column:
        run = F.floor(i / RUN).cast("int")
        return F.get(offsets, run) + add(F.slice(s, first(run), i - run * RUN))

    return _let(sizes, lambda s: _let(_let(runs(s), before), lambda o: every(F.size(s), lambda i: start(s, o, i))))


def _spans() -> Column:
    """Where the assistant's texts stand, counted along the turns as they were written."""

    def span(turn: Column, size: Column, start: Column) -> Column:
        length = F.length(turn["text"]).cast("long")
        return F.struct((start + size - length - F.lit(len(CLOSE))).alias("start"), length.alias("length"))

    def spans(starts: Column) -> Column:
        placed = F.transform(F.arrays_zip(F.col("written"), F.col("sizes"), starts.alias("starts")), lambda x: F.struct(
            x["written"]["source_role"].alias("role"), span(x["written"], x["sizes"], x["starts"]).alias("span")
        ))
        return F.transform(F.filter(placed, lambda x: x["role"] == ANSWERS), lambda x: x["span"])

    return spans(_starts(F.col("sizes")))


def turns_digest(turns: Column) -> Column:
    line = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return F.sha2(F.array_join(line, "").cast("binary"), 256)


def chat_report(turns: DataFrame) -> DataFrame:
    """Digests of what can be read back from the formatted conversations: all turns, and what the loss spans cover.

    Cases as in ``format_chats``; an empty table gives an empty one, other columns are not read.
    """
    chats = format_chats(turns)
    # What the mask covers is the written text of the assistant's turns, taken from the turns that are read back:
    # cutting each span out of the whole string would count its characters from the start every time.
    answers = F.filter("read", lambda t: t["role"] == ANSWERS)
    read = chats.withColumn("read", read_turns(F.col("formatted"))).withColumn(
        "loss", F.array_join(F.transform(answers, lambda t: unescape(t["body"])), "")
    )
    return read.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        turns_digest(F.col("read")).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "verified",
    )
