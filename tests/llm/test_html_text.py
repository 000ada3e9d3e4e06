import html
import re
import time

from tidewater.llm.html_text import extract_text, main_text, trained
from tidewater.llm.queries import op4_html_text
from tidewater.session import table


def article(page):
    inner = re.search(r"(?s)<article>(.*?)</article>", page)[1]
    parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(p for p in parts if p)


def test_query_against_the_article_element(spark):
    d = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in op4_html_text(spark, d).collect()}
    pages = table(spark, d, "pages").collect()
    assert len(got) == len(pages)
    for p in pages:
        assert got[p.page_id].text == article(p.html) and got[p.page_id].n_chars == len(article(p.html))


def test_other_layouts():
    tree = trained()
    body = "Some long plain sentence with many words in it, " * 6
    page = f"""<body><header><a href=/>Home</a></header><div class="cookie-notice">We use cookies on this site</div><div id=content><h1>A title of it</h1><p>{body}<p>{body}&eacute;&#33;
    <aside>See also this</aside><form><p>Name</p></form></div><div class="comments"><p>{body}</p></div><div class=sidebar><p>{body}</p></div></body>"""
    got = main_text(page, tree)
    assert got == f"A title of it\n\n{body.strip()}\n\n{body.strip()} é!".replace(", é", ", é")
    assert main_text("<article><p>one<script>x</script> two<!-- c --><div class=comment>bad</div></article>", tree) == "one two"


def test_edges(spark):
    pages = [(1, "u", None, 5), (2, "u", "", 5), (3, "u", "<p", 5), (4, None, "<article>" + "<p>a &amp; b" * 20_000, 5), (4, None, "<article><p>x", 5)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, text int")
    rows = extract_text(frame).collect()
    assert len(rows) == 5 and sorted(r.n_chars for r in rows)[:4][0] == 0
    assert max(r.n_chars for r in rows) == 20_000 * 7 - 2
    assert extract_text(frame.limit(0)).count() == 0


def test_text_before_linked_blocks_stays_and_link_lists_go():
    tree = trained()
    body = ("Some long plain sentence with many words in it, " * 6).strip()
    links = "".join(f"<li><a href=/{i}>Another page {i}</a></li>" for i in range(4))
    for after in ("<footer><a href=/>Imprint</a></footer>", "<nav><a href=/>Home</a></nav>", f"<div><ul>{links}</ul></div>"):
        assert main_text(f"<body><article><h1>A title of it</h1><p>{body}</p><p>The end.</p></article>{after}</body>", tree) == f"A title of it\n\n{body}\n\nThe end."
        assert main_text(f"<body><div><p>{body}</p><p>{body}</p></div>{after}</body>", tree) == f"{body}\n\n{body}"
    assert main_text(f"<article><p>{body}</p><p><a href=/x>All of these parts</a></p><ul>{links}</ul><p>{body}</p></article>", tree) == f"{body}\n\n{body}"
    assert main_text(f"<body><ul>{links}</ul><p>{body}</p><p>No.</p><p>{body}</p></body>", tree) == f"{body}\n\nNo.\n\n{body}"


def test_hostile_pages_are_read_in_one_pass():
    tree = trained()
    began = time.perf_counter()
    for page in ("<a " * 20_000, "<!--" * 20_000, "<![CDATA[" * 20_000 + ">", "<?" * 20_000, "</" * 20_000, "<title>" * 20_000, "<p>kept</p>" + "<a " * 50_000, "<a b='" * 20_000 + ">"):
        assert main_text(page, tree) in ("", ">", "kept")
    assert time.perf_counter() - began < 8
