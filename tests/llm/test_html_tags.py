"""Tags of any length, raw elements and features over whole blocks."""

import time

from glossweave.llm import html


def texts(page):
    return [b.text for b in html.blocks(page)]


def test_long_attributes_are_attributes():
    long = "x" * 50_000
    assert texts(f'<p>one <img src="data:{long}"> two</p>') == ["one two"]
    assert texts(f'<p>a</p><script data-x="{long}">code</script><p>b</p>') == ["a", "b"]
    assert html.blocks(f"<article data-x='{long}'><p>a</p></article>")[0].path[0][0] == "article"


def test_raw_elements_end():
    assert texts("<p>a</p><svg-icon></svg-icon><p>b</p>") == ["a", "b"]
    assert texts('<p>a</p><svg width="1"/><p>b</p><svg><text>no</text></svg><p>c</p>') == ["a", "b", "c"]
    assert texts("<p>a</p><iframe src='x'/><p>b</p>") == ["a", "b"]
    assert texts("<p>a</p><script src='x'/>code</script><p>b</p>") == ["a", "b"]


def test_whole_block_counts():
    words = "word " * 100
    plain, notice = html.Block((), words + "end", 0, 0), html.Block((), words + "copyright", 0, 0)
    assert html._id("sign=copyright") in html.features(notice, 0.5) and html._id("sign=copyright") not in html.features(plain, 0.5)
    assert html._id("digits=4") in html.features(html.Block((), "a" * 400 + "7" * 400, 0, 0), 0.5)


def test_many_tags_take_linear_time():
    start = time.time()
    assert len(texts('<p class="a" title=\'b\'>t</p>' * 50_000)) == 50_000
    assert time.time() - start < 20


def test_broken_markup_takes_linear_time():
    start = time.process_time()
    for page in ("<a " * 100_000, "<a '" * 100_001, "<a \"x'" * 100_000 + ">", "<p>x" + "<script/>" * 100_000, "<div>t" * 100_000, "</script " * 100_000, "<p>" + "<" * 300_000, "<!--" * 100_000, "<p class=" * 100_000 + ">"):
        html.blocks(page)
    assert time.process_time() - start < 60


def test_unclosed_quote_does_not_hide_the_page():
    assert texts('<p>a</p><a href="x>b</a><p>c</p>') == ["a", "b", "c"]
    assert texts("<p>a</p><p>b < c</p> <") == ["a", "b < c", "<"]


def test_quotes_open_values_only_after_an_equals_sign():
    assert texts("<p title=it's>first one</p><p>it's the second</p>") == ["first one", "it's the second"]
    assert texts("<p title='it's'>a</p><p>b's</p>") == ["a", "b's"]
    assert texts("<p don't>a</p><p>won't</p>") == ["a", "won't"]
    assert texts("""<a href=x?q="y>a</a><p>b "c"</p>""") == ["a", 'b "c"']
    assert texts("""<p data-x = "a > b" title='c > d'>a</p>""") == ["a"]


def test_unclosed_elements_do_not_take_the_rest():
    for name in ("svg", "object", "canvas", "select", "template", "noscript"):
        assert texts(f"<article><div><{name}></div><h1>Head</h1><p>one</p><p>two</p></article>") == ["Head", "one", "two"], name
        assert texts(f"<article><{name}><h1>Head</h1><p>one</p></article>") == ["Head", "one"], name
        assert texts(f"<article><div><{name}>no</div><h1>Head</h1></{name}><p>one</p></article>") == ["Head", "one"], name
        assert texts(f"<p>a <{name}>no <b>no</b> <{name}>no</{name}></{name}>b</p>") == ["a b"], name
        assert texts(f"<{name}><p>a</p><p>b <{name}>no</{name}>c</p>") == ["a", "b c"], name


def test_end_tags_with_attributes_end_raw_elements():
    for end in ("</script foo>", "</script/>", "</SCRIPT >", "</script\n x='1'>"):
        assert texts(f"<p>a</p><script>if (a < b) '</scripts>'{end}<p>b</p>") == ["a", "b"]
    start = time.process_time()
    assert texts("<p>a</p><script>" + "</script " * 200_000) == ["a"]
    assert len(texts("<p>x</p>" + "<svg>" * 100_000 + "<select><p>y</p>" * 50_000)) == 50_001
    assert time.process_time() - start < 20


def test_long_pages_and_clashing_columns(spark):
    article = "<article>" + "".join(f"<p>Sentence number {i} of a very long article, with words.</p>" for i in range(4_000)) + "</article>"
    rows = [(1, "u", article, "t", "x"), (2, None, None, None, None), (None, "v", "", "t", "x"), (1, "u", article, "t", "x")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, _html string"), keep=("page_id", "url", "_html")).collect()
    assert len(got) == 4 and sorted(r.text.count("\n\n") for r in got) == [0, 0, 3999, 3999] and {r._html for r in got} == {"x", None}
