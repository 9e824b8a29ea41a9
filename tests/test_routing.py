from pyspark.sql import functions as F

from sitegrain.operators import routing

c = F.col


def kind(one, url, title="", text=""):
    return one(routing.page_type(c("u"), c("t"), F.array(c("t")), c("x")), u=url, t=title, x=text)


def test_page_types(one):
    assert kind(one, "https://site.com/") == "homepage"
    assert kind(one, "https://site.com") == "homepage"
    assert kind(one, "https://site.com/blog/how-to-order") == "blog"
    assert kind(one, "https://site.com/custom-banners") == "pdp"
    assert kind(one, "https://site.com/custom-decals", "Custom Decals") == "pdp"
    assert kind(one, "https://site.com/category/banners") == "pdp"
    assert kind(one, "https://site.com/category/other") == "category"
    assert kind(one, "https://site.com/x", text="a particle") == "blog"
    assert kind(one, "https://site.com/x", text="this article") == "blog"
    assert kind(one, "https://site.com/x", text="Low PRICES") == "pdp"
    assert kind(one, "https://site.com/x") == "generic"


def test_product_signals(spark):
    rows = [
        (1, "https://s.com/product/x", '<h1>Big Sign</h1>'),
        (2, "https://s.com/x", '{"@type" : ["Product"]}'),
        (3, "https://s.com/x", "costs $ 5"),
        (4, "https://s.com/x", "the price. Add to  cart"),
        (5, "https://s.com/signage", "nothing"),
    ]
    df = spark.createDataFrame(rows, "idx BIGINT, url STRING, html STRING")
    got = {r["idx"]: r["is_product"] for r in routing.product_signals(df).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: False}


def test_filters(spark):
    df = spark.createDataFrame([(1, "pdp"), (2, "blog")], "idx BIGINT, page_type STRING")
    got = [tuple(r) for r in routing.apply_type_filter(df, "pdp", force_pdp=True).orderBy("idx").collect()]
    assert got == [(1, "pdp", None, True), (2, "blog", "filtered_blog", True)]


def test_retryable(one):
    assert one(routing.is_retryable(c("m")), m="Request failed with status code 503")
    assert one(routing.is_retryable(c("m")), m="read ECONNRESET")
    assert not one(routing.is_retryable(c("m"), network=False), m="read ECONNRESET")
    assert not one(routing.is_retryable(c("m")), m="status code 404")
