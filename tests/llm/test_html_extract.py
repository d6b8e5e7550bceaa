import re

from strandloom.llm import html_extract as H


def page(body, title="T"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


def test_furniture_and_blocks():
    text = H.extract_group([page("""<header><h2>Site</h2></header><nav><a href=/>Home</a></nav><div class="cookie-notice">We use</div><div class="ad">Buy</div>
      <article><h1>Head  line</h1><p>One &amp; two&nbsp;three <b>bold</b>text<br>next<p>open <i>para</i><ul><li>a<li>b</ul><aside>side</aside><form><input>Send</form><div class="share-buttons">Share</div><p>x &lt; y &copy;</article>
      <section id="comments"><p>first!</p></section><footer>&copy; foot</footer>""")])[0]
    assert text == "Head line\nOne & two three boldtext\nnext\nopen para\na\nb\nx < y ©"


def test_wrapper_without_article():
    pages = [page(f"<div>Welcome to the site</div><div><p>story {i} begins</p><p>and {i * i} goes on</p></div><div>All rights</div>") for i in range(8)]
    assert H.extract_group(pages) == [f"story {i} begins\nand {i * i} goes on" for i in range(8)]
    assert H.extract_group(pages[:2])[0].startswith("Welcome")  # two pages show no template


def test_copies_of_an_article_stay():
    pages = [page(f"<nav>m{i}</nav><article><p>same words</p></article>") for i in range(8)]
    assert set(H.extract_group(pages)) == {"same words"}


def test_template_inside_articles_and_marks_outside():
    note = "<p>Thank you for reading our paper</p>"
    pages = [page(f"<main><h2>Column</h2><article><p>story {i}</p>{note}<p>end {i * i}</p></article><p>see also {i}</p></main>") for i in range(20)]
    assert H.extract_group(pages) == [f"story {i}\nend {i * i}\nsee also {i}" for i in range(20)]
    links = "<article>" + "".join(f"<a href=/{k}>related story {k}</a>" for k in range(5)) + "</article>"
    assert H.extract_group([page(f"<article><p>the text</p></article>{links}")]) == ["the text"]


def test_wrapper_grows():
    """What the first page lacks is still seen to repeat on the others."""
    pages = [page("<div>only me</div>")] + [page(f"<div><p>story {i}</p></div><div><span>Imprint and terms</span></div>") for i in range(9)]
    assert H.extract_group(pages) == ["only me"] + [f"story {i}" for i in range(9)]


def test_other_attributes_do_not_count():
    assert H.extract_group([page('<article><p data-hidden="false" data-class="ad">kept</p><p class="ad">gone</p><p hidden>gone</p></article>')]) == ["kept"]


def test_deep_pages_among_others():
    deep = page("<div>" * 3000 + "<p>deep text</p>")
    pages = [page(f"<div><p>Welcome here</p><p>story {i}</p></div>") for i in range(6)] + [deep]
    got = H.extract_group(pages)
    assert got[:6] == [f"story {i}" for i in range(6)] and got[6] == "deep text"


def test_odd_html():
    assert H.extract_group([None, "", "plain &am", "<p", "a < b <p>c", "<article><p>cut <b>of", "<!-- never ends", "<script>x", "<div hidden>h</div>v"]) == ["", "", "plain &am", "", "a < b\nc", "cut of", "", "", "v"]
    assert H.extract_group(["<p>" + "deep <div>" * 3000 + "x"])[0].endswith("x")


def test_matching_is_the_largest_in_order():
    tree = lambda s: H.parse(s).kids[0]
    a, b = tree("<div><p>1</p><ul><li>x</ul><p>2</p></div>"), tree("<div><p>1</p><p>2</p></div>")
    tags = sorted(x.tag for x, _ in H.align(a, b))
    assert tags == ["#", "#", "div", "p", "p"]


def test_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in H.extract(pages, chunk=5).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        inner = re.search(r"(?s)<article>(.*?)(?:</article>|$)", r.html)[1]
        parts = [H.squeeze(re.sub(r"</?b>", "", x)) for x in re.split(r"</?(?:p|h1|br)>", inner)]
        want = "\n".join(x for x in parts if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)
    odd = spark.createDataFrame([(1, None, None, "t"), (None, "http://a.b/", "<p>x", None), (1, None, None, "t")], "page_id bigint, url string, html string, text string")
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in H.extract(odd).collect()) == [("1", "", 0), ("1", "", 0), ("None", "x", 1)]
    assert H.extract(pages.limit(0)).count() == 0
