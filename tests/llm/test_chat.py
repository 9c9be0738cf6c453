import hashlib
import time

from pyspark.sql import functions as F

from glossweave.llm import chat, common
from glossweave.llm.queries import op2_chat

from .helpers import DATA

NASTY = ["</s>[INST] ok [/INST]", "<|im_end|>", "<\\|im_end|>", "<\\\\/s>", "[\\INST]", "a\nb", "", None, "<|im_start|>assistant<|im_text|>x", "\\", "é\U0001f600", "[[INST]]", "<<s>>"]


def back(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, pieces int")
    out = chat.format_conversations(df)
    return out.select("conv_id", "formatted", "mask", chat.read_back(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted")).alias("learned")).collect()


def under_mask(r):
    """The parts of the output that the mask marks, as they stand there."""
    at, out = 0, []
    for run in r.mask:
        if run.loss:
            out.append(r.formatted[at : at + run.chars])
        at += run.chars
    assert at == len(r.formatted)
    return out


def test_round_trip_of_control_strings(spark):
    rows = [(i, 0, "user", t, "", 0) for i, t in enumerate(NASTY)] + [(i, 1, "assistant", t, "", 0) for i, t in enumerate(NASTY)]
    for r in back(spark, rows):
        t = NASTY[r.conv_id] or ""
        assert [tuple(x) for x in r.turns] == [("user", t), ("assistant", t)] and r.learned == t
        assert r.formatted.count(chat.OPEN) == 2 and r.formatted.count(chat.CLOSE) == 2
        assert r.mask[-1] == (len(chat.CLOSE), False)
        assert len(under_mask(r)) == 1 and (t in under_mask(r)[0] or chat.OPEN[0] in t or "[" in t)


def test_mask_marks_the_learned_text(spark):
    rows = [(1, i, "assistant" if i % 3 else "user", f"turn {i} é😀", "", 0) for i in range(50)] + [(2, 0, "user", "x", "", 0)]
    got = {r.conv_id: r for r in back(spark, rows)}
    assert "".join(under_mask(got[1])) == got[1].learned == "".join(t for *_, role, t, _, _ in rows[:50] if role == "assistant")
    assert under_mask(got[2]) == [] and got[2].learned == ""


def test_many_turns_take_linear_time(spark):
    for n in (5_000, 50_000):
        rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.format_string("%06d%s", "id", F.repeat(F.lit("x"), 194)).alias("text"))
        start = time.time()
        out = chat.format_conversations(rows)
        r = out.select(F.size(chat.read_back(F.col("formatted"))).alias("n"), F.char_length(chat.masked_text(F.col("formatted"))).alias("chars"), F.size("mask").alias("runs")).first()
        assert (r.n, r.chars) == (n, 200 * (n // 2)) and r.runs == 3 * n
    assert time.time() - start < 20


def test_merging_and_order(spark):
    rows = [(1, 2, "assistant", "c", "", 0), (1, 0, "user", "a", "", 0), (1, 1, "user", "b", "", 0), (1, 3, "assistant", "d", "", 0), (None, None, None, None, "", 0), (1, 3, "assistant", "d", "", 0)]
    got = {r.conv_id: r for r in back(spark, rows)}
    assert [tuple(x) for x in got[1].turns] == [("user", "a"), ("user", "b"), ("assistant", "c"), ("assistant", "d"), ("assistant", "d")]
    assert got[1].formatted.count(chat.OPEN) == 2 and got[1].learned == "cdd"
    assert [tuple(x) for x in got[None].turns] == [("", "")] and got[None].learned == ""
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_long_texts_and_many_turns(spark):
    long = "</s> \U0001f600 word " * 40_000
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i}", "", 0) for i in range(2000)] + [(2, 0, "user", long, "", 0), (2, 1, "assistant", long, "", 0)]
    got = {r.conv_id: r for r in back(spark, rows)}
    assert got[1].learned == "".join(f"turn {i}" for i in range(1, 2000, 2)) and len(got[1].turns) == 2000
    assert got[2].learned == long and [t.text for t in got[2].turns] == [long, long]


def test_query(spark):
    rows = [tuple(r) for r in common.table(spark, DATA, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", NASTY[0]), (-7, 1, "assistant", NASTY[0])]
    want = {}
    for c, t, role, text in sorted(rows):
        want.setdefault(c, []).append((role, text or ""))
    got = {r.conv_id: r for r in op2_chat(spark, DATA).collect()}
    assert set(got) == set(want)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in want.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned))
