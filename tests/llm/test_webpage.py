import random
import time

from choicemeter.llm import webpage

from tests.frames import frame

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style><script>var x="</p><p>no</p>";</script></head>
<body class="has-sidebar"><header id="site-header"><h1>My Site</h1><p>Slogan of the site that is long enough to be a block of its own and more.</p></header>
<nav><ul><li><a href="/a">A</a></li></ul></nav><!-- <p>hidden</p> --><div class="cookie-notice">We use cookies.</div>
<article><h1>Title &amp; more</h1><p><b>First   line<br>goes on&nbsp;here.<p>Second &lt;one&gt; with <a href=x>a link</a>.</p>
<div class="ad">Buy now</div><form><p>Your mail</p><input name=q></form><ul><li>Ein<li>Zwei</ul><p></p></article>
<aside>Related</aside><section id="comments"><p>Great post, I liked it a lot, and so did all the others.</p></section><footer>&copy; me</footer></body></html>"""


def test_article():
    assert webpage.main_text(PAGE) == "Title & more\nFirst line goes on here.\nSecond <one> with a link.\nEin\nZwei"


def test_without_article_wording_and_neighbours_decide():
    good = "It is the case that this text has a lot of the words that are in any text, and it is long enough to be text, too. " * 2
    page = f"<div><a href=a>One</a> <a href=b>Two</a></div><h2>Heading</h2><p>{good}</p><p>Short.</p><p>{good}</p><div><a href=c>More links here</a></div><p>Imprint</p>"
    assert webpage.main_text(page).split("\n") == ["Heading", good.strip(), "Short.", good.strip()]


GOOD = "It is the case that this text has a lot of the words that are in any text, and it is long enough to be text, too. " * 2


def test_a_teaser_in_an_article_does_not_replace_the_text():
    main = f"<h1>Heading</h1><p>{GOOD}</p><p>Short.</p><p>{GOOD}</p>"
    page = f"<div>{main}</div><div><a href=a>More</a></div><article><p>Read this as well.</p></article><div>Imprint</div>"
    assert webpage.main_text(page).split("\n") == ["Heading", GOOD.strip(), "Short.", GOOD.strip(), "Read this as well."]
    # an article with most of the text: one long block outside stays, short ones do not
    page = f"<article><p>{GOOD * 3}</p></article><div>Imprint</div><a href=a>Menu</a><div><p>{GOOD}</p></div>"
    assert webpage.main_text(f"<div>Slogan</div><article><p>{GOOD}</p></article><div>Imprint</div>") == GOOD.strip()
    assert GOOD.strip() in webpage.main_text(page).split("\n")


def test_a_wrapper_with_the_name_of_a_box():
    for name in ("layout has-sidebar", "no-comments", "social-sciences"):
        inner = f"<article><p>{GOOD}</p><p>End.</p></article><div class=sidebar><p>{GOOD[:90]}</p></div>"
        assert webpage.main_text(f"<div class='{name}'>{inner}</div>").split("\n") == [GOOD.strip(), "End."], name
        plain = f"<p>{GOOD}</p><p>{GOOD}</p><div id=comments><p>{GOOD[:100]}</p></div>"
        assert webpage.main_text(f"<div class='{name}'><div class='{name}'>{plain}</div></div>").split("\n") == [GOOD.strip()] * 2, name
    talk = f"<article><p>{GOOD}</p></article><section id=comments><p>{GOOD * 4}</p></section>"
    assert webpage.main_text(talk) == GOOD.strip()


def test_other_languages_go_by_length_and_links():
    russian = "Сегодня утром жители города собрались на площади, чтобы обсудить новый план развития набережной и старых кварталов. " * 2
    polish = "Wczoraj wieczorem mieszkańcy miasta zebrali się przed ratuszem, aby porozmawiać o planach budowy nowego mostu przez rzekę. " * 2
    chinese = "今天早上城市居民聚集在广场上讨论新的河岸发展计划以及旧城区的改造问题。" * 3
    for text in (russian, polish, chinese):
        page = f"<ul><li><a href=a>{text[:80]}</a></li></ul><p>{text}</p><p>{text[:20]}</p><p>{text}</p><div><a href=b>{text}</a></div><p>Imprint of the site</p>"
        assert webpage.main_text(page).split("\n") == [text.strip(), text[:20].strip(), text.strip()]
        assert webpage.main_text(f"<div>{text}</div><article><p>{text * 2}</p></article>") == (text * 2).strip()


def test_broken_markup_and_long_pages():
    assert webpage.main_text(None) == "" and webpage.main_text("  ") == "" and webpage.main_text("<nav>x") == ""
    assert webpage.main_text("<article><p>a <b>b<!-- open <p>c") == "a b"
    assert webpage.main_text("<article><p>1 < 2 and 3 > 2 <i title=\"a>b\">x</i> <u title='>y") == "1 < 2 and 3 > 2 x y"
    assert webpage.main_text("<script>while(1<2)") == ""
    long = "<article>" + "<p>the word &amp; a</p>" * 20000 + "</article>"
    assert len(webpage.main_text(long).split("\n")) == 20000
    webpage.main_text("<p " + "a='" * 50000)
    webpage.main_text("<div>" * 20000 + "x")


def test_rows(spark):
    df = frame(spark, [(1, "u", PAGE, "k", 3), (1, "u", PAGE, "k", 3), (None, None, None, None, None)], "page_id long, url string, html string, text string, n_chars int")
    rows = webpage.extract(df).collect()
    assert [(r.page_id, r.n_chars) for r in rows if r.page_id] == [(1, len(webpage.main_text(PAGE)))] * 2
    assert [(r.text, r.n_chars) for r in rows if r.page_id is None] == [("", 0)]
    assert webpage.extract(df.where("false")).count() == 0


def test_article_of_the_sample(spark):
    """The pages of the test data: every paragraph between the article's tags, and nothing else."""
    import re
    from html import unescape

    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        body = re.search("<article>(.*)</article>", r.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", body)
        want = [" ".join(unescape(re.sub("<br>", " ", re.sub("</?b>", "", p))).split()) for p in parts]
        assert webpage.main_text(r.html) == "\n".join(p for p in want if p)


def test_deep_and_broken_nesting_takes_linear_time():
    """A megabyte of tags that open without end, end without start, or stop each other's search."""
    good = f"<p>{GOOD}</p>"
    for piece in ("<div>", "</section>", "<blockquote>", "<li><fieldset>", "<ul><fieldset><li>", "<td></p>", "</div><p>", "<x-y>", "<div class=a>", "<!-- ", "<a ", "<div '", '<div ">'):
        page = good + piece * (1_000_000 // len(piece))
        began = time.monotonic()
        webpage.main_text(page)
        assert time.monotonic() - began < 20, piece
    page = "<div>" * 20_000 + "</section>" * 20_000 + good
    assert webpage.main_text(page) == GOOD.strip()


def test_passes_over_random_blocks():
    """The two passes against neighbours looked up one by one, on pages without article markup."""
    rng = random.Random(2)
    link = "<div><a href=x>one link</a> <a href=y>and another</a></div>"
    kinds = {"good": f"<p>{GOOD}</p>", "short": "<p>A short line.</p>", "bad": link, "head": "<h2>A heading</h2>"}
    for _ in range(150):
        picks = [rng.choice(list(kinds)) for _ in range(rng.randint(1, 12))]
        want = []
        for i, kind in enumerate(picks):
            before = next((k for k in reversed(picks[:i]) if k in ("good", "bad")), None)
            after = next((k for k in picks[i + 1 :] if k in ("good", "bad")), None)
            around = [k == "good" for k in (before, after) if k]
            if kind == "good":
                want.append(GOOD.strip())
            elif kind == "short" and around and all(around):
                want.append("A short line.")
            elif kind == "head" and after == "good":
                want.append("A heading")
        assert webpage.main_text("".join(kinds[k] for k in picks)).split("\n") == (want or [""]), picks
