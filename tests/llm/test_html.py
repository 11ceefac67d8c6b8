from pyspark.sql import types as T

from keelson.llm.html import extract, main_text

LONG = "It was the best of the times for all of us and it was the first that we had in the house by the lake, as they say to this day."


def page(body):
    return f"<html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{body}</body></html>"


def test_article_without_its_surroundings():
    body = (f"<header><h1>Site</h1></header><nav><ul><li><a href=/a>A</a></li></ul></nav><div class='ad'>{LONG}</div><article><h1>Title &amp; more</h1>"
            f"<p>{LONG}</p><p>Short\n\t one.</p><div class=\"social share\">{LONG}</div><p>caf&eacute;&nbsp;&#33;</p></article>"
            f"<aside>{LONG}</aside><section id=comments><p>{LONG}</p></section><form>{LONG}<input value='>'></form><footer>&copy; {LONG}</footer>")
    assert main_text(page(body)) == f"Title & more\n\n{LONG}\n\nShort one.\n\ncafé !"


def test_blocks_inherit_from_the_nearest():
    assert main_text(page(f"<p>{LONG}</p><p>Between.</p><p>{LONG}</p><p><a href=x>{LONG}</a></p><p>After.</p>")) == f"{LONG}\n\nBetween.\n\n{LONG}"
    assert main_text(page(f"<p>{LONG}<br><br>{LONG} <b>bold</b></p>")) == f"{LONG}\n\n{LONG} bold"


def test_broken_markup():
    assert main_text(None) == main_text("") == main_text("<p>") == ""
    assert main_text(f"<article><p>{LONG}</p><p>cut of") == f"{LONG}\n\ncut of"
    assert main_text(f"<article><p>{LONG}</p><p>end <a hre") == f"{LONG}\n\nend"
    assert main_text(f"<article><p>{LONG}<!-- <p>gone --></p><script>x") == LONG
    assert main_text(f"<article><p>a &lt;b&gt; &am</p><p>{LONG}") == f"a <b> &am\n\n{LONG}"


def test_rows(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", "x"), (1, "u", f"<article><p>{LONG}</p></article>", "x"), (None, None, None, None), (3, "v", "", "text")]
    kind = T.StructType([T.StructField("page_id", T.LongType())] + [T.StructField(c, T.StringType()) for c in ("url", "html", "text")])
    table = spark.createDataFrame(rows, kind)
    assert [tuple(r) for r in extract(table).collect()] == [(1, "u", LONG, len(LONG)), (1, "u", LONG, len(LONG)), (None, None, "", 0), (3, "v", "", 0)]
    assert extract(table.limit(0)).collect() == []
