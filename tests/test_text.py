import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankmill.functions import text as tx
from rankmill.functions.html_text import clean_html, html_to_text

TERMS = {
    "np.array": ["np", "array", "np.array"], "read_csv": ["read", "csv", "read_csv"], "DataFrame": ["data", "frame", "dataframe"], "HTMLParser": ["html", "parser", "htmlparser"],
    "42 1.5": [], "x2 v1.0": ["x", "x2", "v", "v1.0"], "café": ["caf"], "": [], None: [],
}


def test_tokenize(spark):
    df = spark.createDataFrame([(k,) for k in TERMS], "t string").select("t", tx.tokenize("t").alias("x"), tx.term_bag("t").alias("b"))
    assert {r["t"]: r["x"] for r in df.collect()} == TERMS
    assert {r["t"]: sorted(r["b"]) for r in df.collect()} == {k: sorted(v) for k, v in TERMS.items()}


def test_bag_is_the_tokens(spark):
    import random

    rng = random.Random(4)
    texts = ["".join(rng.choice("aBc_.1 -éX") for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.sort_array(tx.tokenize("t")).alias("x"), F.sort_array(tx.term_bag("t")).alias("b"))
    assert df.filter("x <> b").take(3) == []


def test_tokenize_basic(spark):
    assert spark.createDataFrame([("A b_c 1.5",)], "t string").select(tx.tokenize("t", "basic").alias("x")).first()["x"] == ["a", "b", "c", "1", "5"]
    with pytest.raises(ValueError):
        tx.tokenize("t", "other")


HTML = {
    "<p>a<br>b</p>": "a\nb", "<p>Use <code>x</code></p><pre>y</pre>": "Use x\ny", '<a href="u">t</a><img src="i">': "t", "&#46backends": "&#46backends", None: "", "": "",
    "a<script>x</script>b": "ab", "<ul><li>1<li>2</ul>z": "12\n\nz", "x\n\n\n\ny": "x\n\ny", "&lt;b&gt; &amp; c": "<b> & c", "a\\x0Ab": "a\nb", "<b>open": "open", "</p>a": "a",
    "a<![odd[x]]>b": "ab", "a & b &c; d": "a & b &c; d", "x  \t\n y": "x\n y", "caf\\xC3\\xA9 &copy; &notin &#x41;": "café © &notin A",
}


def test_html(spark):
    df = spark.createDataFrame([(k,) for k in HTML], "raw string").select("raw", clean_html("raw").alias("text"))
    assert {r["raw"]: r["text"] for r in df.collect()} == HTML


@given(st.text(alphabet="<>/abp &;#x\n", max_size=60))
@settings(max_examples=200, deadline=None)
def test_html_never_fails(raw):
    out = html_to_text(raw)
    assert out == out.strip() and "\n\n\n" not in out


def test_unescape(spark):
    cases = {"a\\x0Ab": "a\nb", "caf\\xC3\\xA9": "café", "\\xFF": "�", "plain": "plain", None: None, "\\xe2\\x82\\xac 5 €": "€ 5 ", "é\\x41": "�A", "\\xZZ \\x4": "\\xZZ \\x4", "ключ": "ключ", "\\\\x41\\x": "\\A\\x"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r[0]: r[1] for r in df.select("t", tx.unescape_bytes("t")).collect()} == cases
    assert spark.createDataFrame([("a &amp; b",)], "t string").select(tx.unescape_entities("t")).first()[0] == "a & b"


def test_labels(spark):
    df = spark.createDataFrame([("x" * 41, "a/b\\c.bin", 1536), ("x" * 40, "c", 10)], "t string, p string, n long")
    rows = df.select(tx.short_title(F.col("t")), tx.basename(F.col("p")), tx.human_bytes(F.col("n"))).collect()
    assert [tuple(r) for r in rows] == [("x" * 40 + "...", "c.bin", "1.5 KB"), ("x" * 40, "c", "10 B")]
    assert df.select(tx.preview(F.col("t"), 10)).first()[0] == "x" * 10 + " [31 more chars]"
    assert spark.range(1).select(tx.answer_url(F.lit(5), "u/")).first()[0] == "u/5"
    assert spark.createDataFrame([("a & b &amp; &#x27; &#46x",)], "t string").select(tx.escape_stray_ampersands(F.col("t"))).first()[0] == "a &amp; b &amp; &#x27; &amp;#46x"
