import pytest
from pyspark.sql import functions as F

from gleanery.functions import urls as U
from gleanery.functions.platforms import status_of, stream_of
from gleanery.functions.text import decode_entities, format_bytes, format_seconds, yaml_string


def apply(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


CANONICAL = {
    "HTTPS://Example.COM:443/A/b?utm_source=x&b=2&a=1#frag": "https://example.com/A/b?b=2&a=1",
    "http://example.com": "http://example.com/",
    "http://example.com:8080/?fbclid=1": "http://example.com:8080/",
    " https://e.com/p?UTM%5Fx=1&q=%2F&&x= ": "https://e.com/p?q=%2F&x=",
    "https://mp.weixin.qq.com/s?__biz=M&mid=1&idx=2&sn=3&scene=4#wechat": "https://mp.weixin.qq.com/s?__biz=M&mid=1&idx=2&sn=3",
    "https://mp.weixin.qq.com/s/abc?scene=4": "https://mp.weixin.qq.com/s/abc?scene=4",
    "https://e.com/a/../b/./c": "https://e.com/b/c",
    "https://e.com/é?q=é x": "https://e.com/%C3%A9?q=%C3%A9%20x",
    "  not a url ": "not a url",
    "https://u:p@e.com/x?si=1": "https://u:p@e.com/x",
    "ftp://HOST/a?utm_source=x#f": "ftp://host/a",
    "ftp://h:21/": "ftp://h/",
    "file:///a#b": "file:///a",
    "file:\\\\Srv\\x\\..\\y": "file://srv/y",
    "mailto:a@B?si=1#x": "mailto:a@B",
    "data:text/plain,a b#c": "data:text/plain,a b",
    "foo://Ho.ST:1/a/./b?utm_a=1&c=2#d": "foo://Ho.ST:1/a/b?c=2",
    "foo://h o/": "foo://h o/",
    "http://h o/": "http://h o/",
}


def test_canonical(spark):
    assert apply(spark, list(CANONICAL), U.canonical) == list(CANONICAL.values())


RESOLVE = {
    "/x": "https://h.com/x",
    "x?y": "https://h.com/a/x?y",
    "../x": "https://h.com/x",
    "//o.com": "https://o.com/",
    "?q": "https://h.com/a/b?q",
    "#f": "https://h.com/a/b?c#f",
    "mailto:a@b": "mailto:a@b",
    "http://[bad": None,
}


def test_resolve(spark):
    assert apply(spark, list(RESOLVE), lambda c: U.resolve(F.lit("https://h.com/a/b?c"), c)) == list(RESOLVE.values())


STREAMS = {
    "https://youtu.be/abcdefghijk": ("youtube", "abcdefghijk", "https://www.youtube.com/watch?v=abcdefghijk"),
    "https://youtube.com/live/abcdefghijk?x": ("youtube", "abcdefghijk", "https://www.youtube.com/watch?v=abcdefghijk"),
    "https://youtube.com/watch/x?v=abcdefghijk": None,
    "https://notyoutube.com/watch?v=abcdefghijk": None,
    "https://www.bilibili.com/video/AV12?p=02": ("bilibili", "av12", "https://www.bilibili.com/video/av12?p=2"),
    "https://www.bilibili.com/video/BV1234567890?p=1": ("bilibili", "BV1234567890", "https://www.bilibili.com/video/BV1234567890"),
    "https://b23.tv/": None,
    "https://x.com/a/status/1": None,
    "https://x.com/a/status/1/video/2": ("x", "1", "https://x.com/a/status/1/video/2"),
    "https://yun.baidu.com/s/1ab-c?pwd=a b": ("baidupan", "ab-c", "https://pan.baidu.com/s/1ab-c?pwd=a%20b"),
    "https://115.com/s/x/y": None,
    "ftp://youtu.be/abcdefghijk": None,
}


def test_streams(spark):
    got = apply(spark, list(STREAMS), stream_of)
    assert [g and (g.platform, g.video_id, g.canonical) for g in got] == list(STREAMS.values())


def test_posts(spark):
    got = apply(spark, ["https://twitter.com/Abc/status/12/photo/1?s=1", "https://x.com/i/status/12", "https://y.com/a/status/1"], status_of)
    assert [g and (g.handle, g.id) for g in got] == [("Abc", "12"), None, None]


@pytest.mark.parametrize(
    "fn,cases",
    [
        (decode_entities, {"&amp;lt; &#39;&#x41;&quot; &nbsp; &#x110000;": "&lt; 'A\" &nbsp; &#x110000;", "a & b": "a & b"}),
        (yaml_string, {'a"b\n': '"a\\"b\\n"', "x\u2028y\x7f": '"x\\u2028y\\u007f"'}),
    ],
)
def test_text(spark, fn, cases):
    assert apply(spark, list(cases), fn) == list(cases.values())


def test_formats(spark):
    df = spark.createDataFrame([(47.9, 1000), (213.0, 1572864), (3723.0, 3221225472)], "s double, b bigint")
    got = [tuple(r) for r in df.select(format_seconds(F.col("s")), format_bytes(F.col("b"))).collect()]
    assert got == [("0:47", "1 KB"), ("3:33", "1.5 MB"), ("1:02:03", "3 GB")]
