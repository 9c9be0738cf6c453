"""Resumable translation rounds: what is sent, what is kept, and what a stopped run sends again."""

import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from glossweave.operators import mining, rounds
from glossweave.operators.batch import Profile

SCHEMA = "plugin string, text string"


class Logged:
    """Writes every call to a folder; ``rule`` decides the answers."""

    def __init__(self, folder, rule="all"):
        self.folder, self.rule = folder, rule

    def translate(self, texts, hints, timeout):
        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            json.dump([texts, hints], f)
        if self.rule == "down":
            raise OSError
        if self.rule == "first":
            return {texts[0]: "訳" + texts[0]}
        return {t: "訳" + t for t in texts if self.rule == "all" or len(t) % 2}


def calls(folder):
    return [json.load(open(f"{folder}/{n}")) for n in sorted(os.listdir(folder))]


def run(spark, rows, folder, rule="all", **more):
    folder, options = str(folder), rounds.Options(**{k: v for k, v in more.items() if k not in ("state", "baseline")})
    out = rounds.translate(spark.createDataFrame(rows, SCHEMA), "plugin", "text", lambda: Logged(folder, rule), options, more.get("state"), more.get("baseline"))
    return {(r.plugin, r.text): r.japanese for r in out.collect()}


def test_all_texts_once(spark, tmp_path):
    rows = [("a", f"text {i}") for i in range(30)] + [("b", "text 1"), (None, "odd"), ("a", "text 1"), ("a", None), ("a", "  "), ("a", "x" * 300)]
    got = run(spark, rows, tmp_path, chars=60, hint_share=0.0)
    assert got == {(p, t): "訳" + t for p, t in rows if t and t.strip()}
    sent = [t for texts, _ in calls(tmp_path) for t in texts]
    assert len(sent) == len(got) and all(len(t) == 1 or sum(map(len, t)) <= 60 for t, _ in calls(tmp_path))
    assert run(spark, [], tmp_path) == {}


def test_a_stopped_run_goes_on_without_repeating_answers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rounds, "LANE_TEXTS", 20)
    rows = [("a", f"text {i:02d}") for i in range(60)] + [("b", f"name {i:02d}") for i in range(5)]
    log, state = tmp_path / "log", str(tmp_path / "state")
    log.mkdir()
    first = run(spark, rows, log, chars=40, max_rounds=2, state=state)
    assert 0 < len(first) < 65 and rounds.finished_rounds(spark, state) == 2
    os.makedirs(f"{state}/round-2")  # a round that broke off: rows without the mark that they are all there
    with open(f"{state}/round-2/part-0.parquet", "w") as f:
        f.write("torn")
    got = run(spark, rows, log, chars=40, state=state)
    sent = [t for texts, _ in calls(log) for t in texts]
    assert got == {k: "訳" + k[1] for k in rows} and len(sent) == 65 and set(first.items()) <= set(got.items())
    assert run(spark, rows, log, chars=40, state=state) == got and len(calls(log)) == len({tuple(t) for t, _ in calls(log)})


def test_passes_go_on_while_they_bring_answers(spark, tmp_path):
    rows = [("a", f"t{i}") for i in range(4)]
    assert len(run(spark, rows, tmp_path, rule="first", chars=100)) == 4
    assert [len(t) for t, _ in sorted(calls(tmp_path), key=lambda c: -len(c[0]))] == [4, 3, 2, 1]
    odd = tmp_path / "odd"
    odd.mkdir()
    assert run(spark, [("a", "xx"), ("a", "yyy")], odd, rule="odd", chars=100) == {("a", "yyy"): "訳yyy"}
    assert len(calls(odd)) == 2  # the second pass brings nothing


def test_a_translator_that_is_down_ends_the_run(spark, tmp_path):
    state = str(tmp_path / "state")
    log = tmp_path / "log"
    log.mkdir()
    rows = [("a", f"text {i}") for i in range(10)]
    assert run(spark, rows, log, rule="down", chars=20, state=state) == {}
    assert rounds.finished_rounds(spark, state) == 1 and {r.error for r in rounds.read_state(spark, state).collect()} == {"call failed"}
    assert len(run(spark, rows, log, chars=20, state=state)) == 10


def test_hints_fit_and_come_from_earlier_rounds(spark, tmp_path):
    base = spark.createDataFrame([("a", "Iron Sword", "鉄の剣"), ("b", "Iron Bow", "鉄の弓"), ("a", "Old Hat", "帽子")], "plugin string, text string, japanese string")
    run(spark, [("a", "Iron Boots"), ("a", "Iron Cap"), ("a", "Glass Axe")], tmp_path, chars=40, hint_share=0.5, baseline=base)
    seen = {tuple(t): h for t, h in calls(tmp_path)}
    assert all(sum(map(len, t)) + sum(map(len, h)) <= 40 or len(t) == 1 for t, h in seen.items())
    assert sum(h == ["Iron Sword = 鉄の剣"] for h in seen.values()) >= 1 and not any("Bow" in x or "Hat" in x for h in seen.values() for x in h)


def test_flag_file_stops_between_rounds(spark, tmp_path):
    flag = tmp_path / "stop"
    flag.write_text("")
    log = tmp_path / "log"
    log.mkdir()
    assert run(spark, [("a", "x")], log, cancel_file=str(flag)) == {} and calls(log) == []


@pytest.mark.parametrize("least, dice", [(1, 0.0), (2, 0.45), (3, 0.8)])
def test_support_pruning_is_exact(spark, least, dice):
    rows = [(i, [f"w{k}" for k in range(12) if (i * (k + 3)) % 7 < 3], [f"r{k}" for k in range(9) if (i * (k + 2)) % 5 < 2]) for i in range(80)]
    pairs = spark.createDataFrame([r for r in rows if r[1] and r[2]], "row_id long, ws array<string>, rs array<string>")
    got = {(r.word, r.run): (r.together, r.word_n, r.run_n) for r in mining.co_occurrence(pairs, least, dice).collect()}
    both, wn, rn = {}, {}, {}
    for _, ws, rs in (r for r in rows if r[1] and r[2]):
        for w in ws:
            wn[w] = wn.get(w, 0) + 1
            for r in rs:
                both[w, r] = both.get((w, r), 0) + 1
        for r in rs:
            rn[r] = rn.get(r, 0) + 1
    assert got == {(w, r): (n, wn[w], rn[r]) for (w, r), n in both.items() if n >= least and 2 * n / (wn[w] + rn[r]) >= dice}


def test_profiles(spark):
    assert (Profile().dice, Profile().rounds, Profile.fast().dice, Profile.fast().longest) == (0.45, 100, 0.8, 300)
    rows = [(i, e, j) for i, (e, j) in enumerate([("Frost bites", "フロスト 噛む"), ("The frost", "フロスト"), ("A frost giant", "フロスト"), ("x" * 400 + " frost", "フロスト")])]
    corpus = spark.createDataFrame(rows, "row_id long, english string, japanese string")
    assert {r.word for r in mining.align(corpus).collect()} == {"frost"} and {r.word for r in mining.align(corpus, Profile.fast()).collect()} == {"frost"}
    assert mining.align(corpus.where(F.col("row_id") < 2), Profile.fast()).count() == 0
