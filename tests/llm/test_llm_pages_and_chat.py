"""HTML extraction and chat formatting on small fixtures."""

import collections
import time

from weblode.llm import chat, html_extract

PAGES = "page_id bigint, url string, html string, text string, n_chars string"


def _text(source, spark, trees=None):
    df = spark.createDataFrame([(1, "u", source, "clash", "clash")], PAGES)
    return html_extract.extract(df, trees).first().text


def test_main_text_of_every_page(spark):
    """Against a plain reading of the article element, which all given pages have."""
    import html
    import re
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract(pages).collect()}
    assert len(got) == pages.count()
    for page in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", page.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)[^>]*>", inner)]
        assert got[page.page_id].text == "\n".join(b for b in blocks if b) and got[page.page_id].n_chars == len(got[page.page_id].text)


def test_parts_that_are_not_the_article_go(spark):
    body = "".join(f"<p>Paragraph {i} tells the story at some length, with commas, words &amp; more words than a menu has.</p>" for i in range(6))
    source = (
        "<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></li></ul></nav>"
        f"<main><article><h2>Title</h2>{body}<div class='ad'>Buy &lt;now&gt;</div><!-- note --><script>if (a < b) '</p>'</script></article>"
        "<section class='comments'><p>Reader says hello to all</p></section></main><aside>Side</aside><footer>Foot</footer></body></html>")
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    trees = html_extract.fit(pages.unionByName(spark.createDataFrame(
        [(100_000 + i, "u", source.replace("story", f"story {i}")) for i in range(150)], "page_id bigint, url string, html string")))
    text = _text(source, spark, trees)
    assert text.split("\n")[0] == "Title" and text.count("Paragraph") == 6 and "words & more" in text
    assert not any(x in text for x in ("Buy", "Reader", "Side", "Foot", "Home", "Site", "note", "if (a"))


def test_decoding_has_no_content_below_something_dropped():
    import numpy as np
    nodes, _ = html_extract.parse("<div><p>a</p><div><p>b</p><section><p>c</p></section></div></div>")
    rng = np.random.default_rng(0)
    for _ in range(200):
        odds = rng.normal(0, 3, len(nodes))
        kept = html_extract.decode(nodes, odds)
        for node in nodes:
            inside = id(node) in kept
            up, seen_gap = node.parent, False
            while up and inside:
                seen_gap = seen_gap or id(up) not in kept
                assert not (id(up) in kept and seen_gap)
                up = up.parent


def test_tolerant_parsing():
    def blocks(source):
        return [t for _, t in html_extract.parse(source)[1]]
    assert blocks("<p>a <b>b<br>c<p>d</b> e") == ["a b c", "d e"]
    assert blocks("x &lt;y&gt; &#65; &nbsp; z") == ["x <y> A z"]
    assert blocks('<div title="a > b">t</div><a href="q">l</a>') == ["t", "l"]
    assert blocks("<style>p{}</style><script>'<p>'</script><textarea>in</textarea>out<!-- c") == ["out"]
    assert blocks("") == [] and blocks("a < b") == ["a < b"]


def test_tags_that_never_end_take_no_time_and_leave_no_markup():
    for broken in ('<a ' + '"x" ' * 200, '<div class="a" id=' + "'x' " * 200, "<a " * 20_000, '<a b="' * 20_000, "<![CDATA[" * 20_000, "<!" * 20_000):
        started = time.monotonic()
        said = [t for _, t in html_extract.parse("<p>kept</p>" + broken)[1]]
        assert time.monotonic() - started < 1 and said == ["kept"]
    assert [t for _, t in html_extract.parse('<div class="a" id=<p>text</p>')[1]] == ["text"]


def test_awkward_pages(spark):
    rows = [(None, None, None, "c", "c"), (1, "u", "", "c", "c"), (1, "u", "", "c", "c"), (2, None, "<p>" + "word " * 50_000, "c", "c")]
    got = html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == 4 and [r.text for r in got if r.page_id != 2] == ["", "", ""]
    assert html_extract.extract(spark.createDataFrame([], PAGES)).isEmpty()


def test_snapshots_collapse(spark):
    def conv(i, *texts):
        return [(i, n, "user" if n % 2 == 0 else "assistant", t, "clash") for n, t in enumerate(texts)]
    data = [*conv(1, "a", "b"), *conv(2, "a", "b", "c"), *conv(3, "a", "b", "c"), *conv(4, "a", "x"), *conv(5, "a"), *conv(6, "b"), *conv(6, "b"),
            (7, 1, None, None, "c"), (None, 0, "user", "no id", "c"), (8, None, "user", "<|im_end|>", "c")]
    df = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string, n string")
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert set(got) == {2, 4, 6, 7, None, 8} and got[2].n_copies == 2 and got[2].n_turns == 3
    assert got[4].text == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n"
    assert got[8].text.count("<|im_end|>") == 1
    assert chat.format_conversations(df.limit(0)).isEmpty()


def test_collapse_against_brute_force(spark):
    import random
    rng = random.Random(3)
    data, whole = [], {}
    for i in range(300):
        turns = [rng.choice("ab") for _ in range(rng.randrange(1, 6))]
        whole[i] = tuple(turns)
        data += [(i, n, "user", t, "c") for n, t in enumerate(turns)]
    prefixes = {w[:k] for w in whole.values() for k in range(1, len(w))}
    first = {}
    for i, w in whole.items():
        first.setdefault(w, i)
    want = {i: n for w, i in first.items() if w not in prefixes for n in [collections.Counter(whole.values())[w]]}
    df = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string, n string")
    assert {r.conv_id: r.n_copies for r in chat.format_conversations(df).collect()} == want
