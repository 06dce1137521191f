"""HTML extraction: wrappers decide, odd and hostile pages pass, alignment resolves mismatches."""

import json
import random
import re
import time

from pyspark.sql import functions as F

from kinfold.llm import html_extraction as H

PAGE = """<html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body><div class="nav-bar"><a href=x>Home %s</a></div>
<div id="cookie">We use cookies</div><div class="wrap"><h1>Title %s</h1><p>First %s&amp;<b>bold</b> text<p>Second   &eacute; %s<br>line</p><!-- no <p>x</p> --><div class="share">Share</div></div>
<aside><p>Other %s</p></aside><section class="comments"><p>Reader %s says a lot of things here and there and on</p></section><form><input><p>Mail</p></form><p>Same on all pages</p></body></html>"""


def wrapper(pages):
    forest = H.Forest()
    for h in pages:
        forest.add("", H.page_wrapper(H.tree(H.tokens(h)), H.page_hash(h)))
    return next(forest.take())[1]


def rule(pages):
    return H.Rule(json.loads(json.dumps(H.rules(wrapper(pages)))))


def test_extract(spark):
    r = random.Random(3)
    pages = [(i, f"http://h.example/{i}", PAGE % tuple(f"w{r.randrange(10**6)} q{i}" for _ in range(6))) for i in range(6)]
    art = "<body><nav>menu</nav><article><h1>H</h1><p>one<p>two &lt;3</article><footer>f</footer>"
    pages += [(20, "https://art.example/x", art), (21, "https://ART.example/y", art.replace("one", "uno")), (22, None, None), (23, "http://h.example/z", ""), (24, None, "<p>lone text</p>"), (20, "https://art.example/x", art), (25, "http://art.example/long", art.replace("two", "two " * 50000))]
    got = [(x["page_id"], x["text"], x["n_chars"]) for x in H.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("rules", F.lit(1))).collect()]
    text = {}
    for i, t, n in got:
        assert n == len(t) and text.setdefault(i, t) == t
    assert len(got) == len(pages)
    for i, _, h in pages[:6]:
        m = re.search(r"<h1>(.*?)</h1><p>(.*?)&amp;<b>bold</b> text<p>Second   &eacute; (.*?)<br>", h)
        assert text[i] == f"{m[1]} {m[2]}&bold text Second é {m[3]} line"
    assert text[20] == "H one two <3" and text[21] == "H uno two <3" and text[22] == "" and text[23] == "" and text[24] == "lone text" and text[25].count("two") == 50000
    assert H.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).isEmpty()


def words(r, n):
    return " ".join(f"w{r.randrange(10**5)}" for _ in range(n))


def test_names_mean_nothing():
    """Class names without sense: what differs between the pages of the host, not in links, and most of it, is the article, though on some pages it
    is shorter than the advert."""
    r, pages, want = random.Random(1), [], []
    for i in range(40):
        title, paras = words(r, 2), [words(r, r.choice([1, 2, 30, 60])) for _ in range(r.choice([1, 1, 4]))]
        menu = "".join(f"<li><a href=/{k}>{words(r, 1)}</a></li>" for k in range(r.choice([3, 5])))
        pages.append(f'<div class="qq"><ul>{menu}</ul></div><div class="kx">{words(r, 9)}</div><div class="zz"><h1>{title}</h1>{"".join(f"<p>{p}</p>" for p in paras)}</div><div class="vv">&copy; all {words(r, 3)}</div><div class="rr"><p>Subscribe to us</p></div>')
        want.append(" ".join([title, *paras]))
    ready = rule(pages)
    assert [H.main_text(p, ready) for p in pages] == want
    # without the rules there is nothing, and a page alone doesn't tell
    assert H.main_text(pages[0], H.Rule(["", 0, 0, []])) == "" and H.main_text(pages[0], None) == ""
    assert [H.main_text(p, rule([p])) for p in pages] != want


def test_templates_optional_and_repeated_parts():
    r = random.Random(2)
    news = lambda: f"<main><article><h1>{words(r, 4)}</h1><p>{words(r, 20)}</p></article><section class=comments><article><p>{words(r, 40)}</p></article></section></main><aside>{words(r, 5)}</aside>"
    faq = lambda: f"<table><tr><td>{words(r, 12)}</td></tr></table><footer>{words(r, 4)}</footer>"
    pages = [news() for _ in range(9)] + [faq()]
    ready = rule(pages)
    for p in pages[:9]:
        assert H.main_text(p, ready) == " ".join(re.search("<h1>(.*?)</h1><p>(.*?)</p>", p).groups())
    assert H.main_text(pages[9], ready) == re.search("<td>(.*?)</td>", pages[9])[1]  # a wrapper of its own
    # texts in the body without any box; fixed ones and copies of one page
    bare = [f"<h2>News</h2><p>{words(r, 9)}</p><h3>Mail us</h3>" for _ in range(4)]
    assert H.main_text(bare[0], rule(bare)) == re.search("<p>(.*?)</p>", bare[0])[1]
    assert H.main_text(bare[0], rule([bare[0]] * 5)) == " ".join(re.findall(r">([^<]+)<", bare[0]))


def test_expressions():
    e = lambda *pages: H.expression(wrapper(pages))
    assert e("<ul><li>a</li></ul>x", "<ul><li>a</li><li>b</li></ul><p>y</p>") == "<ul>(<li>#PCDATA</>)+</>('8cdc1683')?(<p>'fbdb2615'</>)?"
    assert e("<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>", "<dl><dt>a<dd>z</dl>") == "<dl>(<dt>#PCDATA</><dd>#PCDATA</>)+</>"
    assert e("<p>a</p><h2>b</h2>", "<h2>b</h2>") == "(<p>'e8b7be43'</>)?<h2>'71beeff9'</>"
    assert e("<div class=ab><p>a</p></div>", "<div class=cd><p>b</p></div>") == "<div><p>#PCDATA</></>"
    many = [f"<p>x</p><h3 class={a}{b}>t</h3>" for a in "abcdefghij" for b in "klmnopqrst"]
    w = wrapper(many * 2)
    assert len(H.expression(H.bounded(w, 20))) < 300 and "<p>" in H.expression(H.bounded(w, 20))


def test_hostile_pages():
    began = time.time()
    for page, want in [
        ("<div>" * 50_000 + "x" + "</div>" * 50_000 + "<p>y", "x y"), ("<div>" * 900 + "t" + "</div>" * 900, "t"), ('<a "' * 200_000, ""), ("<a " * 300_000, ""), ('<a x="' * 100_000, ""), ("<!--" * 200_000, ""),
        ("<script>" * 100_000, ""), ("<p>a" + "&" * 300_000, "a" + "&" * 300_000), ("x<" * 100_000, None), ("</p>" * 100_000 + "z", "z"), ("<p a='>'>q</p><p b=\">\">r", "q r"), ("1 < 2 &amp; 3 > 2", "1 < 2 & 3 > 2"),
        ("".join(f"<p class=c{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}>t" for i in range(30_000)), " ".join(["t"] * 30_000)),
    ]:
        got = H.main_text(page, rule([page, page, "<p>other</p>"]))
        assert want is None or got == want, page[:30]
    assert time.time() - began < 60


def test_wrappers_of_many_partitions_meet(spark, monkeypatch):
    monkeypatch.setattr(H, "FAN", 2)
    r = random.Random(9)
    rows = [(i, "http://h.example/", f"<div class=a>{words(r, 2)}</div><div class=b><p>{words(r, 9)}</p></div><div class=c>Fixed</div>") for i in range(40)]
    got = {x["page_id"]: x["text"] for x in H.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(9)).collect()}
    assert all(got[i] == re.search("<p>(.*?)</p>", h)[1] for i, _, h in rows)
