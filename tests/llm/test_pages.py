import re
from collections import defaultdict

import pytest

from skirmish.llm import html_text, url_rules
from skirmish.llm.queries import QUERIES, URL_RULES
from tests.llm.conftest import SF

TREE = html_text.trained()
LONG = "This is a paragraph of the article with enough words in it to be told from furniture, and it ends here."

PAGES = [
    (f"<nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{LONG}</p><p>Short.</p></article><footer>(c) us</footer>", f"Title\n\n{LONG}\n\nShort."),
    (f"<body><div class='cookie-banner'>We use cookies to serve you better on this site.</div><main><p>{LONG} <a href=x>link</a></p></main><aside>Related things</aside>", f"{LONG} link"),
    (f"<article><p>a &lt;b&gt; &amp; &eacute;&#233;\n\t c&nbsp;d {LONG}</p><script>var x='<p>no</p>';</script><style>p{{}}</style></article>", f"a <b> & éé c d {LONG}"),
    (f"<article><p>{LONG}</p><section class=\"comments\"><p>{LONG} says a reader</p></section><form>Your name <input></form></article>", LONG),
    (f"<div class='article-body'><p>{LONG}<p>{LONG}</div><div class=ad>Buy this.</div>", f"{LONG}\n\n{LONG}"),
    (f"<!-- <p>gone</p> --><article><p>one<br>two {LONG}</p></article>", f"one two {LONG}"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_main_text(page, text):
    assert html_text.main_text(page, TREE) == text


def test_query_keeps_the_article_and_nothing_else(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op3_html_text"](spark, SF).collect()
    assert {r.page_id for r in got} == set(pages) and len(got) == len(pages)
    for r in got:
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url
        html = pages[r.page_id].html or ""
        if m := re.search(r"<article>(.*?)</article>", html, re.S):
            inside = re.sub(r"<[^>]+>", " ", m[1])
            assert sorted(r.text.split()) == sorted(__import__("html").unescape(inside).split())


def test_odd_pages(spark):
    rows = [(1, None, None, 5), (2, "nonsense", "<p", 5), (None, "http://a.com/x", "<p>" * 5000 + LONG, 5), (3, "http://A.COM/x?y", "<div>" * 3000 + "x" * 200_000, 5), (3, "http://A.COM/x?y", "<div>" * 3000 + "x" * 200_000, 5)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text int").withColumnRenamed("text", "host")
    assert html_text.extract(frame).count() == 5
    judged = url_rules.judge(frame, URL_RULES).collect()
    assert len(judged) == 5
    assert {(r.host, r.path, r.rule, r.verdict) for r in judged if r.page_id in (1, 2)} == {("", "", None, "allow")}
    assert {(r.host, r.path, r.rule, r.verdict) for r in judged if r.page_id == 3} == {("a.com", "/x", "com/", "allow")}
    assert html_text.extract(frame.limit(0)).count() == url_rules.judge(frame.limit(0), URL_RULES).count() == 0


def ranks(seeds, edges, rounds=200):
    total = sum(seeds.values()) or 1
    seeds = {h: s / total for h, s in seeds.items()}
    out, rank = defaultdict(set), dict(seeds)
    for a, b in edges:
        out[a].add(b)
    for _ in range(rounds):
        new = defaultdict(float, {h: 0.15 * s for h, s in seeds.items()})
        for a, r in rank.items():
            for b in out[a]:
                new[b] += 0.85 * r / len(out[a])
        rank = new
    return rank


def test_query_equals_a_plain_version(spark):
    def parts(url):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        return ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")

    def rule(host, path):
        best = None
        for verdict, name in URL_RULES:
            at, _, rest = name.partition("/")
            if (host == at or host.endswith("." + at)) and path.startswith("/" + rest) and (best is None or len(name) > len(best[0])):
                best = (name, verdict)
        return best or (None, None)

    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    pages = {r.page_id: (*parts(r.url), *rule(*parts(r.url))) for r in rows}
    edges = {(parts(r.url)[0], parts(link if "://" in link else "http:" + link)[0]) for r in rows for link in re.findall(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?\s*((?:https?:)?//[^\"'\s>]+)", r.html or "")}
    edges = {(a, b) for a, b in edges if a and b and a != b}
    of = defaultdict(list)
    for host, _, _, verdict in pages.values():
        if host:
            of[host].append(verdict)
    trust = ranks({h: v.count("allow") / len(v) for h, v in of.items() if "allow" in v}, edges)
    distrust = ranks({h: v.count("block") / len(v) for h, v in of.items() if "block" in v}, {(b, a) for a, b in edges})
    got = QUERIES["op6_url_rules"](spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, name, verdict = pages[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, name)
        t, d = trust.get(host, 0), distrust.get(host, 0)
        if verdict or abs(t - d) > 1e-4:
            assert r.verdict == (verdict or ("block" if d > t else "allow")), host


def test_trust_and_distrust_spread(spark):
    link = lambda *hosts: "".join(f"<a href='http://{h}/'>x</a>" for h in hosts)
    rows = [(1, "http://good.com/", link("friend.org")), (2, "http://bad.net/es/1", ""), (3, "http://shill.org/", link("bad.net")), (4, "http://friend.org/a", ""), (5, "http://alone.org/", "")]
    got = {r.page_id: r for r in url_rules.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), URL_RULES).collect()}
    assert [got[i].verdict for i in range(1, 6)] == ["allow", "block", "block", "allow", "allow"]
    assert got[4].trust > 0 and got[3].distrust > 0 and got[5].trust == got[5].distrust == 0


def test_small_ranks_and_long_walks_count(spark):
    seeds = spark.createDataFrame([("distrust", "h0", 1.0)], "kind string, host string, seed double")
    edges = spark.createDataFrame([("distrust", "h0", "h1", 1.0), ("distrust", "h1", "h0", 1.0)], "kind string, src string, dst string, weight double")
    with pytest.raises(RuntimeError):
        url_rules.propagate(seeds, edges, 0.85, 3, 1e-6)
    # one link of many to a host among many: a distrust of far less than 1e-9, and no trust
    many = [(i, f"http://a{i}.net/es/", "") for i in range(2000)]
    to = lambda n: [(10**6 + i, f"http://s{i}.org/", "<a href='http://a0.net/'>x</a>") for i in range(n)]
    far = [(2 * 10**6 + i, f"http://t{i}.org/", "<a href='http://s0.org/'>x</a>") for i in range(600)] + [(3 * 10**6, "http://u.org/", "<a href='http://t0.org/'>x</a>")]
    rows = many + to(600) + far
    got = {r.page_id: r for r in url_rules.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), URL_RULES).collect()}
    assert got[3 * 10**6].trust == 0 and 0 < got[3 * 10**6].distrust < 1e-9
    assert got[3 * 10**6].verdict == "block"


def test_state_classes_and_overflow_keep_the_article():
    from skirmish.llm.html_text import main_text, trained

    tree = trained()
    text = " ".join(["This is a long sentence of the article body, with many words in it."] * 6)
    kept = ('<div style="overflow:hidden">', '<div class="layout has-sidebar"><article>', '<div data-x="hidden">', '<section class="no-sidebar">')
    gone = ("<div hidden>", '<div hidden="">', '<div style="display: none">', '<div aria-hidden="true">', '<div class="sidebar">')
    for open_tags in kept:
        assert main_text(f"<html><body>{open_tags}<p>{text}</p>", tree) == text, open_tags
    for open_tags in gone:
        assert main_text(f"<html><body>{open_tags}<p>{text}</p></div>", tree) == "", open_tags


def test_deep_nesting_is_read_in_proportion():
    import time

    from skirmish.llm.html_text import main_text, trained

    tree, took = trained(), []
    for n in (10_000, 80_000):
        began = time.process_time()
        main_text("<div>word word" * n, tree)
        took.append(time.process_time() - began)
    assert took[1] < 30 * took[0]


def test_names_of_a_wrapper_do_not_hide_the_article():
    tree = html_text.trained()
    body = "<h1>The title of it</h1><p>" + "A sentence of some words that is long enough to be text. " * 3 + "</p>"
    want = html_text.main_text(f"<article>{body}</article>", tree)
    for name in ("wrap promo-layout", "post comments-open", "page-header-fixed", "content share-bar-left"):
        assert html_text.main_text(f'<div class="{name}"><nav><a href="/">Home</a></nav><article>{body}</article></div>', tree) == want
    after = '<div class="related"><article><h3>Another story</h3><p>Its first words stand here as a teaser for readers.</p></article></div>'
    discussed = '<section id="discussion"><h2>Replies</h2><p>I think that this is a fine text, and that more of it should come.</p></section>'
    for more in (after, discussed, f'<div class="comments">{discussed}</div>'):
        assert html_text.main_text(f"<article>{body}</article>{more}", tree) == want
        assert html_text.main_text(f'<div class="wrap promo-layout"><article>{body}</article>{more}</div>', tree) == want
    hidden_part = f'<div class="promo" hidden><article>{body}</article></div>'
    assert html_text.main_text(hidden_part, tree) == ""
