import pytest

from inkwell.functions import html


def titles(source):
    found, strategy = html.chapters(source)
    return strategy, [(c.title, c.anchor, c.html_content) for c in found]


def test_page_breaks():
    source = "<h1>One</h1>a<mbp:pagebreak/> <p>b</p><hr class='pagebreak'><p class='title'>Two</p>"
    assert titles(source) == ("pagebreak", [("One", "", "<h1>One</h1>a"), ("第 2 节", "", "<p>b</p>"), ("Two", "", "<p class='title'>Two</p>")])


def test_single_chunk_falls_through():
    assert titles("<mbp:pagebreak/><h2>A &amp; B</h2>")[0] == "headings"


@pytest.mark.parametrize("head", ["<nav epub:type='toc'>", "<nav class='my-toc'>", "<ol id='toc'>", "<div class='toc'>"])
def test_contents(head):
    tag = head[1:].split()[0]
    source = f"<a href='x#no'>No</a>{head}<a href='f.html#c1'>One<b>!</b></a><a href='f.html'>Two</a><a> </a><a href='#l'>{'x' * 101}</a></{tag}>"
    assert titles(source) == ("contents", [("One!", "#c1", ""), ("Two", "", "")])


def test_headings_and_ids():
    source = f"<h2 id='own'>A</h2><h1> </h1><H1 class=x>B &eacute;</H1><h4>no</h4><h3>{'y' * 101}</h3><h3>C</h3>"
    found, strategy = html.chapters(source)
    assert strategy == "headings"
    assert [(c.idx, c.title, c.anchor) for c in found] == [(0, "A", "#own"), (1, "B é", "#__ch1"), (2, "C", "#__ch2")]
    marked = html.with_anchor_ids(source, found)
    assert '<H1 id="__ch1" class=x>' in marked and '<h3 id="__ch2">C' in marked and "<h2 id='own'>" in marked
    assert html.with_anchor_ids(marked, html.chapters(marked)[0]) == marked


def test_references_without_semicolon_stay():
    for text, wanted in (("A &amp B", "A &amp B"), ("der&am", "der&am"), ("a&", "a&"), ("&amp;&amp", "&&amp"), ("&#65; &#65", "A &#65"), ("&ampx; &nope;", "&ampx; &nope;"), ("&#", "&#"), ("&#x", "&#x"), ("&amp;lt;", "&lt;")):
        assert titles(f"<script>'&'</script><h1>{text}</h1>&#; <h2>Next &copy;</h2>")[1] == [(wanted, "#__ch0", ""), ("Next ©", "#__ch1", "")]


def test_whole_and_blank():
    assert titles("<html><body> <p>x</p></body></html>") == ("whole", [("全文", "", "<p>x</p>")])
    assert titles("  ") == ("blank", [("全文", "", "  ")])


def test_title_limits():
    assert html.title_of(f"<h1>{'x' * 100}</h1><h2>short</h2>") == "short"
    assert html.title_of("<h1>first</h1><h1>second</h1>") == "first"
    assert html.title_of("<div id='chapter'>t</div>") == "t"
    assert html.title_of("<p>none</p>") is None


def test_images():
    images = {2: ("image/png", "QUJD")}
    assert html.with_images("<img filepos='2'>", images) == "<img src='data:image/png;base64,QUJD' style='max-width:100%;' />"
    assert html.with_images("<img class=a filepos = \"#2\" />", images).startswith("<img src='data:")
    for same in ("<img filepos='3'>", "<IMG filepos='2'>", "<img filepos=2>"):
        assert html.with_images(same, images) == same


def test_deep_nesting_does_not_overflow():
    source = "<div>" * 5000 + "<h1>deep</h1>"
    assert titles(source)[1] == [("deep", "#__ch0", "")]
