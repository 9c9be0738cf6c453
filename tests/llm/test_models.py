"""HTML extraction, language ID, toxicity: trained models against held-out cases."""

import time

import numpy as np
from pyspark.sql import functions as F

from glossweave.llm import common, html, langid, toxicity
from glossweave.llm.queries import op5_html, op6_langid, op9_toxicity

from .helpers import DATA, crc, odd_documents


def test_html_held_out_layouts():
    model, exact = html.trained(), 0
    for page, main in html.labelled_pages(100, 99):
        exact += html.main_text(page, model) == "\n\n".join(main)
    assert exact >= 90


def test_html_blocks():
    page = "<body><nav><a href=x>Menu</a></nav><article><h1>A &amp; B</h1><p>one\n <b>two</b><br>three<p>four<script>var x='<p>no</p>'</script></article><!-- c --><footer>&copy; me"
    assert [b.text for b in html.blocks(page)] == ["Menu", "A & B", "one two three", "four", "© me"]
    assert html.blocks(None) == [] and html.blocks("<p") == [] or html.blocks("<p")[0].text == "<p"
    assert [b.text for b in html.blocks("a < b")] == ["a < b"]


def test_viterbi_is_the_best_sequence():
    crf, rng = html.Crf(), np.random.default_rng(1)
    crf.emit[:] = rng.normal(size=crf.emit.shape)
    crf.move[:], crf.start[:] = rng.normal(size=(2, 2)), rng.normal(size=2)
    page = [html.Block((("p", ""),), t, 0, 0) for t in ("One two.", "x", "Three four five six.", "y z", "© 2020", "Seven")]
    e, _ = crf.emissions(page)
    best = max(range(64), key=lambda m: sum(e[i][m >> i & 1] for i in range(6)) + crf.start[m & 1] + sum(crf.move[m >> i & 1][m >> i + 1 & 1] for i in range(5)))
    assert crf.decode(page) == [best >> i & 1 for i in range(6)]


def test_html_query(spark):
    got = {r.page_id: r for r in op5_html(spark, DATA).collect()}
    pages = common.table(spark, DATA, "pages").collect()
    assert len(got) == len(pages)
    for p in pages:
        inner = p.html[p.html.index("<article>") : p.html.index("</article>")]
        assert got[p.page_id].text == "\n\n".join(b.text for b in html.blocks(inner)) and got[p.page_id].n_chars == len(got[p.page_id].text)


def test_html_odd_rows(spark):
    rows = [(1, None, None), (2, "u", ""), (3, None, "<p>" * 5000), (4, "u", "plain"), (4, "u", "plain"), (5, "u", "<nav>menu</nav>")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 6 and all(r.text is not None for r in got) and got[0].text == got[1].text == ""
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_langid_query(spark):
    want = {r.doc_id: r.lang for r in common.table(spark, DATA, "documents").select("doc_id", "lang").collect()}
    got = op6_langid(spark, DATA).collect()
    assert len(got) == len(want) and all(r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == want[r.doc_id] for r in held) >= 0.95 * len(held)


def test_langid_odd_rows(spark):
    model = langid.fit(common.table(spark, DATA, "documents"), F.lit(True))
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.identify(odd_documents(spark), model).collect()]
    assert len(got) == 12 and {i: p for i, p, s in got if p == "und"}.keys() == {1, 2, 3, 7}
    assert all((s == 0) == (p == "und") for _, p, s in got)
    assert langid.identify(odd_documents(spark, empty=True), model).count() == 0
    nothing = langid.fit(odd_documents(spark, empty=True), F.lit(True))
    assert {r.lang_pred for r in langid.identify(odd_documents(spark), nothing).collect()} == {"und"}
    assert langid.fit(odd_documents(spark), F.lit(True)).languages == ["de", "en", "fr", "xx"]


def test_temperature_recovers_scale():
    rng = np.random.default_rng(2)
    z = rng.normal(size=(4000, 3)) * 2
    y = np.array([rng.choice(3, p=p) for p in langid.softmax(z)])
    assert abs(langid.temperature(z * 3, y) - 3) < 0.3


def test_isotonic():
    m = np.array([0.0, 1, 2, 3, 4, 5])
    x, p = toxicity.isotonic(m, np.array([0, 1, 0, 1, 1, 1]))
    assert (np.diff(p) > 0).all() and np.interp(1.5, x, p) == 0.5 and p[0] == 0 and p[-1] == 1


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(4)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    t = toxicity.Trees().fit(x[:1500], y[:1500])
    assert ((t.margin(x[1500:]) > 0) == y[1500:]).mean() > 0.95


def test_features_see_hidden_insults():
    lex = toxicity.Lexicon({})
    f = dict(zip(toxicity.FEATURES, toxicity.features(["YOU are an 1d1ot, an i*diot, YOU moron!!"], lex)[0]))
    assert f["obfuscated_hits"] > 0 and f["strong_hits"] > 0 and f["near_second"] > 0 and f["capital_words"] > 0 and f["exclamations"] > 0


def test_features_of_a_batch_equal_those_of_each_text():
    lex = toxicity.Lexicon({"idio": 2.5, "foo$": 1.2})
    texts = ["You IDIOT!! an id1ot st*pid aaaa İ? ÀÉ AB_C", "", None, "x" * 9 + " 1@2 a1b2c d@@e_f@g", "\U0001d400 ok", " \n", "foo " * 400]
    each = np.stack([toxicity.features([t], lex)[0] for t in texts])
    assert np.allclose(toxicity.features(texts, lex), each)
    f = dict(zip(toxicity.FEATURES, each[3]))
    assert f["obfuscated"] == 100 * 3 / 8 and f["stretched"] == 100 * 3 / 8


def test_features_take_time_in_proportion():
    """Words of a million letters, with and without marks between them."""
    lex = toxicity.Lexicon({})
    began = time.process_time()
    toxicity.features(["a" * 1_000_000, "a1" * 500_000, "1" * 1_000_000, "a@" * 500_000 + "b", "a" + "1" * 1_000_000], lex)
    assert time.process_time() - began < 20


def test_toxicity_query(spark):
    labels = {r.doc_id: r.toxic for r in common.table(spark, DATA, "labels").collect()}
    got = op9_toxicity(spark, DATA).collect()
    assert len(got) == common.table(spark, DATA, "documents").count()
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    known = [(r.score, labels[r.doc_id]) for r in got if r.doc_id in labels and r.held_out]
    pos, neg = [s for s, y in known if y == 1], [s for s, y in known if y == 0]
    assert np.mean([p > n for p in pos for n in neg]) > 0.85


def test_toxicity_odd_rows(spark):
    model = toxicity.fit(common.table(spark, DATA, "documents"), common.table(spark, DATA, "labels"), F.lit(True))
    got = toxicity.score(odd_documents(spark), model).collect()
    assert len(got) == 12 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(odd_documents(spark, empty=True), model).count() == 0
    none = toxicity.fit(odd_documents(spark), spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert {r.score for r in toxicity.score(odd_documents(spark), none).collect()} == {0.0}
    same = toxicity.fit(odd_documents(spark), spark.createDataFrame([(4, 1), (8, 1), (None, 0), (9, None)], "doc_id long, toxic int"), F.lit(True))
    assert {r.score for r in toxicity.score(odd_documents(spark), same).collect()} == {1.0}
