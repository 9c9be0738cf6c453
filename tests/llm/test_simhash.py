import numpy as np
import pytest
from pyspark.sql import functions as F
import xxhash

from glossweave.llm import common, simhash
from glossweave.llm.queries import op1_simhash

from .helpers import DATA, odd_documents


def plain_fingerprint(text):
    """The contract, word for word."""
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps: dict, radius=2):
    """Brute force: smallest id reachable over links."""
    ids, parent = list(fps), {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in common.table(spark, DATA, "documents").select("doc_id", "text").collect()}
    fps = {i: plain_fingerprint(t) for i, t in docs.items()}
    want = groups(fps)
    got = op1_simhash(spark, DATA).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in docs}


def test_links_meet_within_radius(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(1 << 63), (1 << 63) - 1, 6)
    fps = []
    for b in base.tolist():
        fps.append(b)
        for flips in ((1,), (1, 63), (5, 9), (1, 2, 3)):
            x = b & (1 << 64) - 1
            for f in flips:
                x ^= 1 << f
            fps.append(x - (1 << 64) if x >> 63 else x)
    df = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "id long, fp long")
    roots = common.components(simhash.links(df))
    got = {i: r for i, r in enumerate(r.component_id for r in simhash.named(df, roots, "id").orderBy("id").collect())}
    assert got == groups({i: f & (1 << 64) - 1 for i, f in enumerate(fps)})


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}}


def test_odd_rows(spark):
    got = simhash.near_duplicates(odd_documents(spark)).collect()
    assert len(got) == 12
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r)
    assert by[1].fp == by[2].fp == by[3].fp == 0 and by[3].component_id == 1
    assert by[4].component_id == by[9].component_id == 4
    assert simhash.near_duplicates(odd_documents(spark, empty=True)).count() == 0
    assert simhash.near_copies(odd_documents(spark, empty=True)).count() == 0


def test_near_copies_finds_edits(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    rows = []
    for g in range(12):
        words = [word() for _ in range(200)]
        for k in range(3):
            w = list(words)
            for at in rng.integers(0, 200, 2 * k):
                w[at] = word()
            rows.append((g * 10 + k, " ".join(w)))
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] == i // 10 * 10 for i in got) >= 34 and all(c // 10 == i // 10 for i, c in got.items())


def test_radius_must_be_even():
    with pytest.raises(ValueError):
        simhash.links(None, 3)


def crowd(n: int = 500, shared: int = 205, seed: int = 4):
    """Documents of 250 words that share a long passage, and an edited copy of every fourth."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    passage, rows = [word() for _ in range(shared)], []
    for i in range(n):
        words = passage + [word() for _ in range(250 - shared)]
        rows.append((i, " ".join(words)))
        if i % 4 == 0:
            words[shared + 5 + i % 20] = word()
            words[20 + i % 150] = word()
            rows.append((n + i, " ".join(words)))
    return rows


def similarity(x: str, y: str) -> float:
    x, y = ({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (x.split(), y.split()))
    return len(x & y) / len(x | y)


def pair_roots(rows, keep):
    """Components over all pairs that ``keep`` (index, indices after it -> chosen ones) names and whose texts are alike."""
    ids, text = [i for i, _ in rows], dict(rows)
    parent = {i: i for i in ids}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for k in range(len(rows)):
        for j in keep(k):
            if similarity(text[ids[k]], text[ids[j]]) >= 0.8:
                x, y = sorted((find(ids[k]), find(ids[j])))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_all_pairs_that_meet_are_compared(spark):
    """The groups of a crowd equal those over all pairs of fingerprints that meet in some band and are alike."""
    rows = crowd(300, 222)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    coarse = np.stack([simhash.fingerprint(t, simhash.WIDTH, simhash.BANDS // 2).view("<u4") for _, t in rows])

    def meeting(k):
        return (k + 1 + np.flatnonzero(np.bitwise_count(coarse[k + 1 :] ^ coarse[k]).min(1) <= 2)).tolist()

    assert got == pair_roots(rows, meeting)


def test_recall_of_pairs_by_similarity(spark):
    """Pairs of one original and one copy, with scattered edits or one replaced block: of those alike by 0.8 or more at least
    0.9 are linked in every band of similarity, and none below 0.8."""
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    rows, alike = [], {}
    for g in range(900):
        n = int(rng.integers(80, 400))
        w = [word() for _ in range(n)]
        v = list(w)
        if g % 2:
            at, size = int(rng.integers(0, n * 4 // 5)), max(1, int(n * rng.uniform(0.01, 0.11)))
            v[at : at + size] = [word() for _ in range(size)]
        else:
            for at in rng.integers(0, n, max(1, int(n * rng.uniform(0.003, 0.024)))):
                v[at] = word()
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(v))]
        alike[2 * g + 1] = similarity(rows[-2][1], rows[-1][1])
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == i for i, s in alike.items() if s < 0.8)
    for kind in (0, 1):
        for low in (0.8, 0.85, 0.9):
            band = [i for i, s in alike.items() if low <= s < low + 0.05 and i // 2 % 2 == kind]
            found = np.mean([got[i] == i - 1 for i in band])
            assert len(band) >= 30 and found >= 0.9, (kind, low, len(band), found)


def test_near_copies_of_odd_rows(spark):
    got = simhash.near_copies(odd_documents(spark)).collect()
    assert len(got) == 12
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r.component_id)
    assert by[1] == by[2] == 1 and by[3] in (1, 3) and by[4] == by[9] == 4 and by[5] == 5


def test_only_similar_texts_are_linked(spark):
    """A crowd of mutual similarity 0.68 stays apart, and each edited copy is with its original alone."""
    rows = crowd(300, 205)
    assert 0.6 < similarity(rows[0][1], rows[2][1]) < 0.75 and similarity(rows[0][1], rows[1][1]) >= 0.8
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(c == i % 300 for i, c in got.items())


def test_bounds_of_a_crowd_lose_no_pair(spark):
    """Edited copies of one text, about half of them under 0.8 to everyone: the bounds rule out most pairs, and no pair that is alike."""
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    base, rows = [word() for _ in range(150)], []
    for i in range(90):
        w = list(base)
        for at in rng.integers(0, 150, int(rng.integers(1, 9))):
            w[at : at + int(rng.integers(0, 3))] = [word() for _ in range(int(rng.integers(1, 3)))]
        rows.append((i, " ".join(w)))
    nodes, texts = spark.range(90).withColumnRenamed("id", "fp"), spark.createDataFrame(rows, "fp long, text string")
    got = simhash.reach(nodes, texts)
    side = lambda x: got.select(*[F.col(c).alias(x + c) for c in got.columns])
    kept = {(r.afp, r.bfp) for r in side("a").join(side("b"), F.col("afp") < F.col("bfp")).where(simhash.alike("a", "b")).collect()}
    near = {(i, j): similarity(rows[i][1], rows[j][1]) for i in range(90) for j in range(i + 1, 90)}
    assert {p for p, s in near.items() if s >= 0.8} <= kept
    unlike = [p for p, s in near.items() if s < 0.7]
    assert len(unlike) > 1000 and sum(p in kept for p in unlike) < 0.1 * len(unlike)
