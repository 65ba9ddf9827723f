from pyspark.sql import functions as F

from colorway.functions import display as D


def _one(spark, expr, schema, rows):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_js_falsy_defaults(spark):
    s = "a string, b string"
    assert _one(spark, D.cart_key(F.col("a"), F.lit("slug"), F.col("b")), s,
                [("v1", "M"), ("", "M"), (None, None)]) == ["v1", "slug-M", "slug"]
    assert _one(spark, D.reviewer_name(F.col("a")), s, [("", None), (None, None), ("Ann", None)]) == [
        "Verified Buyer", "Verified Buyer", "Ann"]
    assert _one(spark, D.welcome_name(F.col("a"), F.col("b")), s, [("", "e@x"), ("Ann", "e@x")]) == ["e@x", "Ann"]
    assert _one(spark, D.or_not_provided(F.col("a")), s, [("", None), (None, None), ("98", None)]) == [
        "Not provided", "Not provided", "98"]


def test_links_labels_subtitles(spark):
    s = "a string, b string"
    assert _one(spark, D.product_link(F.col("a"), F.col("b")), s, [("p-1", "a"), ("p-1", ""), ("p-1", None)]) == [
        "/product/p-1?color=a", "/product/p-1", "/product/p-1"]
    assert _one(spark, D.display_subtitle(F.col("a"), F.col("b")), s,
                [("Brand", "Ash"), ("", "Ash"), (None, "Ash"), ("Brand", None), ("", None)]) == [
        "Brand · Ash", "Ash", "Ash", "Brand", ""]
    got = _one(spark, D.order_label(F.col("a"), F.col("b")), s, [("ORD-1", "123456789012"), ("", "123456789012"),
                                                                  (None, "42")])
    assert got == ["ORD-1", "12345678", "42"]


def test_images(spark):
    s = "own array<string>, col array<string>"
    rows = [([], ["c1", "c2"]), (["o1"], ["c1", "c2"]), (None, None), ([], [])]
    assert _one(spark, D.card_image(F.col("own"), F.col("col"), 0), s, rows) == ["c1", "o1", None, None]
    assert _one(spark, D.card_image(F.col("own"), F.col("col"), 1), s, rows) == ["c2", "c2", None, None]
    assert _one(spark, D.thumbnail(F.col("col")), s, rows) == ["c1", "c1", None, None]


def test_size_rank(spark):
    got = _one(spark, D.size_rank(F.col("a")), "a string",
               [("XS",), ("S",), ("M",), ("L",), ("XL",), ("XXL",), ("ONE",), (None,), ("xs",)])
    assert got == [1, 2, 3, 4, 5, 6, 99, 99, 99]


def test_exact_div_beyond_double_precision(spark):
    from colorway.functions.display import exact_div
    big = [(2**62 + 7, 3), (10**18 + 1, 10**9), (9007199254740993, 2), (0, 5)]
    got = _one(spark, exact_div(F.col("a"), F.col("b")), "a long, b long", big)
    assert got == [a // b for a, b in big]


def test_empty_image_text_counts_as_no_image(spark):
    df = spark.createDataFrame([(["", "b"], ["c"]), ([], ["", "d"]), (None, None)], "own array<string>, other array<string>")
    got = df.select(D.card_image(F.col("own"), F.col("other"), 0).alias("a"), D.card_image(F.col("own"), F.col("other"), 1).alias("b"),
                    D.detail_image(F.col("other"), F.col("own")).alias("c")).collect()
    assert [tuple(r) for r in got] == [("c", "b", "c"), (None, "d", None), (None, None, None)]


def test_percentages_may_have_a_fraction(spark):
    from colorway.functions import money as M
    df = spark.createDataFrame([("percentage", 12.5, 1000), ("fixed", 250.0, 1000), ("percentage", 29.0, 100), ("percentage", None, 9)],
                               "t string, v double, s long")
    got = [r[0] for r in df.select(M.discount_amount(F.col("t"), F.col("v"), F.col("s"))).collect()]
    assert got == [125, 250, 28, 0]
