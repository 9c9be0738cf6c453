"""The pipeline's mixing stage: words of each source after it against the targets."""

from collections import Counter

from glossweave.llm import mixing


def test_source_words_meet_targets(spark):
    import corpus_pipeline as p

    sizes = {f"s{k:02d}": [60 + (i * 7 + k) % 9 * 20 for i in range(180 if k == 1 else 24)] for k in range(20)}
    rows = [(f"{s}-{i}", " ".join(f"w{k}" for k in range(n)), s) for s, each in sizes.items() for i, n in enumerate(each)]
    rows += [("same", "alike " * 100, "s00")] * 5
    sizes["s00"] += [100] * 5
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string")
    names = sorted(sizes)
    goal = dict(zip(names, mixing.targets([sum(sizes[s]) for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))])))
    assert goal["s01"] < 0.5 * sum(sizes["s01"])
    words = Counter()
    for r in p.mix(spark, docs, "").collect():
        words[r.source] += len(r.text.split())
    assert all(abs(words[s] - t) <= 0.05 * t + 300 for s, t in goal.items()), (words, goal)


def test_ratio_under_a_half(spark):
    """A source of which the plan takes 0.375 of every document keeps about 0.375 of its words."""
    import corpus_pipeline as p

    plan = [(i, i, "hot", 200 + i % 11 * 20, (200 + i % 11 * 20) * 3 // 8) for i in range(800)]
    got = {r.id: r.copies for r in p.whole_copies(spark.createDataFrame(plan, "row long, id long, source string, size long, taken long")).collect()}
    kept, want = sum(s * got[i] for i, _, _, s, _ in plan), sum(t for *_, t in plan)
    assert len(got) == 800 and set(got.values()) == {0, 1} and abs(kept - want) < 0.02 * want


def test_small_sources_meet_targets(spark):
    """A tail of one-document sources, with blocks as long as those of a large table."""
    words = [300, 1000, 2500, 5000, 7, 1, 64, 2049]
    rows = [(i, "w " * n, f"t{i}") for i, n in enumerate(words)] + [(100 + i, "w " * 4000, "big") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    documents, schedule = mixing.mix(docs, block=2048)
    taken, size = Counter(), {}
    for r in mixing.taken(documents, schedule).collect():
        taken[r.source] += r.taken
        size[r.source] = (r.source_size, r.target)
        assert r.taken <= 2 * r["size"]
    assert all(abs(taken[s] - t) <= n / 100 + 1 for s, (n, t) in size.items()), (taken, size)
