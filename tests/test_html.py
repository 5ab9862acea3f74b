from pyspark.sql import functions as F

from textloom.functions.html import body_slice, html_to_text
from textloom.operators.web import clean_threads, slice_bodies

CASES = [
    ("", ""),
    ("plain text", "plain text"),
    ("<body><p>a</p><p> b </p></body>", "a b"),
    ("<html><head><title>t</title></head><body>x</body></html>", "x"),
    ("<BODY><P>a</P></BODY>", "a"),
    ("<body>a<b>b</b>c</body>", "a b c"),
    ("<body><script>var x = '<p>no</p>';</script><style>p{}</style>yes<!-- <p>no</p> --></body>", "yes"),
    ("<body>a<!-- c -->b</body>", "a b"),
    ('<body><a title="x > y">link</a></body>', "link"),
    ("<body><a title='x > y' b=c>link</a></body>", "link"),
    ("<body>&#65;&#x42; &amp;lt;p&amp;gt;</body>", "AB &lt;p&gt;"),
    ("<body>&lt;p&gt; 1 < 2</body>", "<p> 1 < 2"),
    ("<body>end <a href=", "end"),
    ("<body>&nbsp; <i> </i> x</body>", "x"),
    ("<body><script>never closed", ""),
    ("<body>it's <i class=x>don't</i></body>", "it's don't"),
]


def test_html_to_text(values):
    assert values([h for h, _ in CASES], html_to_text) == [t for _, t in CASES]


def test_long_tags_do_not_recurse(values):
    tag = "<a " + " ".join(f'k{i}="v>{i}"' for i in range(20000)) + ">"
    junk = "<a " + "=" * 200000
    assert values([f"<body>{tag}x</a></body>", f"<body>x{junk}"], html_to_text) == ["x", "x"]


def test_body_slice(values):
    pages = [
        "<html><body>a</body></html>", "<body>a", "no body", "<BODY>a</BODY>", "</body><body>a", "x<body a='1'>é😀</body>y</body>",
    ]
    assert values(pages, body_slice) == ["<body>a", "<body>", "", "", "", "<body a='1'>é😀"]
    assert values(["<body>a"], lambda h: body_slice(h, strict=False)) == ["<body>a"]


def test_failed_fetch_keeps_the_text(spark):
    df = spark.createDataFrame([("none", "old"), ("<body>x</body>", "old")], "html string, text string")
    assert [r["text"] for r in slice_bodies(df).collect()] == ["old", "<body>x"]


def test_threads_are_cleaned_twice(spark):
    rows = [('{"html":"<p>a &amp;lt;b&amp;gt; c</p>"}',), ('{"other":1}',)]
    df = spark.createDataFrame(rows, "payload string")
    assert [r["text"] for r in clean_threads(df).collect()] == ["a <b> c", None]
    assert clean_threads(df, twice=False).first()["text"] == "a &lt;b&gt; c"
    again = spark.createDataFrame([('{"html":"&lt;b&gt;x&lt;/b&gt;"}',)], "payload string")
    assert clean_threads(again).select(F.col("text")).first()["text"] == "x"
