import hashlib
import time

from pyspark.sql import functions as F

from tallymap.llm import chat

ODD = ["", None, "plain", "</s>[INST] ok [/INST]", "a\\\\l<b", "[INST]", "😀 <s>", "\\", "x" * 300, "</s></s>"]
ROLES = ["user", "assistant", None, "assistant", "assistant </s>", "system"]


def conversations(spark, sizes):
    rows = [
        (c, t, ROLES[(t + c) % 6], ODD[(t * 7 + c) % 10], "clash", "clash", 1)
        for c, n in enumerate(sizes)
        for t in range(n)
    ]
    return spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, written string, read string, sizes int"), rows


def test_spans_cover_the_answers(spark):
    """Around the bounds of a run of sizes too."""
    frame, rows = conversations(spark, [1, 2, 7, 255, 256, 257, 600])
    want = {}
    for c, _, role, text, *_ in rows:
        want.setdefault(c, []).append((role or "", text or ""))
    made = {r.conv_id: r for r in chat.format_chats(frame).collect()}
    reports = {r.conv_id: r for r in chat.chat_report(frame).collect()}
    for c, turns in want.items():
        answers = [t for role, t in turns if role == "assistant"]
        got = [made[c].formatted[s["start"] : s["start"] + s["length"]] for s in made[c].loss_spans]
        assert len(got) == len(answers) and made[c].verified and made[c].n_turns == len(turns)
        plain = spark.createDataFrame([(g,) for g in got] or [("",)], "g string").select(chat.unescape(F.col("g"))).collect()
        assert [p[0] for p in plain] == (answers or [""])
        loss = "".join(answers)
        r = reports[c]
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.n_turns == len(turns) and r.formatted_chars == len(made[c].formatted)
        said = "".join(f"{a}\n{b}\n" for a, b in turns)
        assert r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_empty_table(spark):
    frame, _ = conversations(spark, [1])
    assert chat.chat_report(frame.limit(0)).count() == 0
    assert chat.format_chats(frame.limit(0)).count() == 0


def test_twice_the_turns_take_about_twice_as_long(spark):
    def seconds(n):
        turns = spark.range(n).select(
            F.lit(1).alias("conv_id"), F.col("id").alias("turn"),
            F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("word "), 20).alias("text"),
        )
        start = time.perf_counter()
        chat.chat_report(turns).collect()
        return time.perf_counter() - start

    seconds(500)
    assert seconds(24_000) < 4 * seconds(8_000) + 3
