from pyspark.sql import functions as F

from sitegrain.functions import html as H
from sitegrain.functions import urls
from sitegrain.operators.pages import serp_page

c = F.col
PAGE = "https://Site.com:443/shop/a/b.html?x=1#frag"


def visible(**kw):
    return H.strip_hidden(c("h"), **kw)


def test_meta_fallback_and_attribute_order(one):
    og = '<meta content="Og &amp; text" property="og:description">'
    named = "<META content='Plain' name=description >"
    tags = H.void_tags(visible())
    assert one(H.meta_description_or_og(tags), h=og) == "Og & text"
    assert one(H.meta_description(tags), h=og) == ""
    assert one(H.meta_description_or_og(tags), h=og + named) == "Plain"


def test_canonical_robots_images_h1(one):
    page = (
        '<link href="/c" rel="canonical"><meta name="robots" content=" noindex ">'
        '<img src=a alt="x"><img alt="  "><img src=b><h1>a</h1><H1 class=x>b</H1>'
    )
    tags = H.void_tags(visible())
    assert one(H.canonical_link(tags), h=page) == "/c"
    assert one(H.robots_meta(tags), h=page) == "noindex"
    assert one(H.missing_alt_images(tags), h=page) == 2
    assert one(H.h1_count(visible()), h=page) == 2


def test_text_glues_elements_and_decodes(one):
    page = (
        "<head><title>T</title></head><body><script>var a='</p>';</script><!-- no -->"
        "<ul><li>a</li><li>b</li></ul> &lt;&amp;lt;&#233;&#x1F600;&nbsp;&copy; <style>p{}</style>c\u00a0d</body>"
    )
    assert one(H.body_text(visible()), h=page) == "ab <&lt;é😀 © c d"


def test_links(one):
    page = "".join(
        f'<a class=x href="{h}">t</a>'
        for h in (
            "//Site.com/x", "./a", "../b", "?q=1", "#top", "mailto:x@y", "TEL:1", "HTTP://SITE.COM/Up",
            "https://other.com/", "/x#one", "/x#two", " /sp ace ", "c/../d", "ftp://site.com/f", "", "é",
        )
    )
    got = one(H.internal_links(F.lit(PAGE), H.hrefs(visible())), h=page)
    assert got == [
        "https://site.com/x", "https://site.com/shop/a/a", "https://site.com/shop/b",
        "https://site.com/shop/a/b.html?q=1", "https://site.com/shop/a/b.html?x=1",
        "http://site.com/Up", "https://site.com/sp%20ace", "https://site.com/shop/a/d",
        "ftp://site.com/f", "https://site.com/shop/a/%C3%A9",
    ]
    assert one(H.relative_link_count(H.hrefs(visible())), h=page) == 6
    assert one(H.absolute_link_count(H.hrefs(visible())), h=page) == 2


def test_json_ld_types(one):
    def block(body):
        return f'<script type="application/ld+json">{body}</script>'

    page = (
        block('{"@type":"Product"}') + block('[{"@type":["A","B"]},{"x":1},{"@type":"A"}]')
        + block("{bad") + block('{"@graph":[{"@type":"Hidden"}]}') + "<script>{}</script>"
    )
    kept = H.strip_hidden(c("h"), keep_json_ld=True)
    assert one(H.json_ld_types(kept), h=page) == ["Product", "A", "B"]


def test_faq_questions(one):
    q11, q12, q180, q181 = "a" * 10 + "?", "b" * 11 + "?", "c" * 179 + "?", "d" * 180 + "?"
    page = f"<h2>{q11}</h2><p>{q12}<p>{q180}</p><li>{q181}</li><h3>Q: what it is</h3><p>{q12}</p>"
    assert one(H.faq_questions(visible()), h=page) == [q12, q180, "what it is"]
    many = "".join(f"<p>question number {i}?</p>" for i in range(21))
    assert len(one(H.faq_questions(visible()), h=many)) == 20


def test_product_entity(one):
    args = (c("a"), c("b"), c("u"))
    assert one(
        H.product_entity(*args), a="Custom Vinyl Banner", b="Buy Banners Online", u="https://s.com/x/vinyl-banner"
    ) == "Vinyl Banner Banners"


def test_main_content(one):
    assert one(H.main_content(visible()), h="<body>a<main id=x>b</main></body>") == "b"
    assert one(H.main_content(visible()), h='<body>a<div role="main">b</div></body>') == "b"
    assert one(H.main_content(visible()), h="<body>a</body>").startswith("a")
    nested = {
        "<div role='main'><div>inner</div> tail</div><div>x</div>": "<div>inner</div> tail",
        "<DIV class=a role=main id=b>t<Div><DIV>u</div></Div>v</DIV> w": "t<Div><DIV>u</div></Div>v",
        "<section><section role='main'><p>a</p><section/>b</section>c</section>d</section>": "<p>a</p><section/>b</section>c",
        "<main><main>a</main>b</main>c": "<main>a</main>b", "<main>open <b>end": "open <b>end", "<main></main><div role=main>d</div>": "d",
        "<div role=mainly>a</div>": "<div role=mainly>a</div>", "<main><mainly>a</mainly></main>b": "<mainly>a</mainly>", "<div role=\"main\"></p>q</div>r": "</p>q",
    }
    for markup, inner in nested.items():
        assert one(H.main_content(visible()), h=f"<body>{markup}</body>").removesuffix("</body>") == inner


def test_safety(one):
    expected = {
        "http://10.0.0.1/": "Blocked private IP target: 10.0.0.1",
        "http://172.15.0.1/": None,
        "http://172.16.0.1/": "Blocked private IP target: 172.16.0.1",
        "http://192.168.1.1:8080/x": "Blocked private IP target: 192.168.1.1",
        "http://LOCALHOST/": "Blocked local hostname: localhost",
        "http://a.localhost/": "Blocked local hostname: a.localhost",
        "ftp://x.com/": "Blocked URL protocol: ftp:",
        "http://[::1]/": None,
        "not a url": "Invalid URL: not a url",
        "https://ok.com/": None,
    }
    for url, reason in expected.items():
        assert one(urls.block_reason(c("u")), u=url) == reason, url
    assert one(urls.block_reason(c("u"), ("a.com",)), u="https://b.com/") == "Blocked host outside allowlist: b.com"
    for ip, private in (("", True), ("::1", True), ("fe80::2", True), ("8.8.8.8", False), ("127.0.0.1", True)):
        assert one(urls.is_private_ip(c("u")), u=ip) is private


def test_anchors_and_slugs(one):
    u = "https://s.com/Foo-Bar/My__Page-/"
    assert one(urls.planner_anchor(c("u")), u=u) == "my page "
    assert one(urls.suggestion_anchor(c("u")), u=u) == "My Page"
    assert one(urls.planner_anchor(c("u")), u="nope") == "home"
    assert one(urls.suggestion_anchor(c("u")), u="nope") == "related page"
    assert one(urls.section_root(c("u")), u="https://s.com/") == "root"
    assert one(urls.base_url(c("u")), u="S.com/x") == "https://s.com"
    assert one(urls.page_file_slug(c("u")), u="https://s.com/a/b.c/") == "a--b-c"
    assert one(urls.audit_page_slug(c("u")), u="https://s.com/") == "home"


def test_safe_href(one):
    for raw, out in {
        "": "#", " /a?b&c ": "/a?b&amp;c", "javascript:x": "#", "https://x/<": "https://x/&lt;",
        "mailto:a@b": "mailto:a@b", "data:x": "#", "#t": "#t", "plain": "#",
    }.items():
        assert one(urls.safe_href(c("u")), u=raw) == out, raw


def test_dom_text(spark):
    df = spark.createDataFrame([("<title>t</title><body><p>a <b>b<p>c<script>x</script>",)], "h STRING")
    assert df.select(H.dom_text("h").alias("v")).first()["v"] == "ta bc"


def test_result_pages_keep_their_whole_text(spark):
    text = "word " * 4000 + "end"
    page = spark.createDataFrame([("s", 0, "https://s/", f"<body><p>{text}</p></body>")], "site STRING, idx INT, url STRING, html STRING")
    assert serp_page(page).first()["paragraph_text"] == text
    assert serp_page(page, max_chars=100).first()["paragraph_text"] == text[:100]


def test_normal_form_needs_no_second_look(spark, one):
    same = ["https://a.com/", "http://a.b-c.com/x/y.html?a=b&c=/../d?e", "https://a.com/..x/.../a@b:80/%20", "https://a.com//x/"]
    made = {
        "https://A.com/": "https://a.com/", "HTTP://a.com/x": "http://a.com/x", "https://a.com": "https://a.com/", "https://a.com:443/x": "https://a.com/x",
        "https://u@a.com/": "https://a.com/", "https://a.com/a/../b": "https://a.com/b", "https://a.com/a/.?x": "https://a.com/a/?x", "https://a.com/..": "https://a.com/",
        "https://a.com/x?": "https://a.com/x", "https://a.com/x#y": "https://a.com/x", "https://a.com/x?y#z": "https://a.com/x?y", " https://a.com/x\n": "https://a.com/x",
        "https://a.com/a b": "https://a.com/a%20b", "https://a.com/x\n": "https://a.com/x", "a.com/x": None, "https://a.com/?q=\u00e9": "https://a.com/?q=%C3%A9",
    }
    for url, want in [*((u, u) for u in same), *made.items()]:
        assert one(urls.canonical(F.col("u")), u=url) == want
    # The pattern alone settles addresses that are in normal form.
    settled = spark.createDataFrame([(u,) for u in [*same, *made]], "u string").filter(F.col("u").rlike(urls._NORMAL))
    assert [r["u"] for r in settled.collect()] == same
