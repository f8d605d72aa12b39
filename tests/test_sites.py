import pytest
from pyspark.sql import functions as F

from gleanery.functions.markdown import _html_target
from gleanery.operators.sites import default_suffixes, same_site_links


@pytest.mark.parametrize(
    ("page", "link", "same"),
    [
        ("https://a.foo.com/", "https://b.foo.com/x", True),
        ("https://a.foo.com/", "http://b.foo.com/", False),
        ("https://a.foo.de/", "https://b.foo.de/", True),  # no rule: the last label is the suffix
        ("https://foo.de/", "https://bar.de/", False),
        ("https://a.foo.co.uk/", "https://b.foo.co.uk/", True),
        ("https://foo.co.uk/", "https://bar.co.uk/", False),
        ("https://a.x.foo.ck/", "https://b.x.foo.ck/", True),  # wildcard rule
        ("https://x.foo.ck/", "https://y.foo.ck/", False),
        ("https://a.www.ck/", "https://www.ck/", True),  # exception to it
        ("https://me.github.io/", "https://you.github.io/", False),
        ("https://127.0.0.1/", "https://127.0.0.1/a", True),
        ("https://localhost/", "https://localhost/a", True),
        ("https://de/", "https://x.de/", False),
    ],
)
def test_same_site(spark, page, link, same):
    df = spark.createDataFrame([(1, page, link)], "page_id long, page_url string, url string")
    assert same_site_links(df, default_suffixes(spark)).first().same_site is same


def test_html_target_is_decoded_once(spark):
    raw = ['"a&amp;b&#33;&#x21;c"', "'x&nbsp;y'", '"&amp;#33;"', '"&amp;lt;"', '"&quot;"']
    df = spark.createDataFrame([(r,) for r in raw], "r string").select(_html_target(F.col("r")).alias("t"))
    assert [r.t for r in df.collect()] == ["a&b!!c", "x y", "&#33;", "&lt;", '"']
