"""Formulas without an end cost linear time; rows repeated under one id are cleaned once."""

import time

import pytest

from rankmill.llm import markup


@pytest.mark.parametrize("text, want", [
    (r"a $$x$$ b \[y\] c \(z^2\) d $q$", ["x", "y", "z^2", "q"]), (r"\[ open \( x \) and $5 or $6", [" x "]), ("$$ $$ a $$b", [" a "]), (r"\[ a \( b \) c \]", [r" a \( b \) c "]), ("", []), ("cost: $5", []),
])
def test_formulas(text, want):
    assert [inner for *_, inner in markup.formulas(text)] == want


@pytest.mark.parametrize("sign", ["\\[ a ", "\\( x^2 ", "$$ ", "{{", "[[", "'' a", "f( ", "<b ", "```", "\\begin{verbatim} "])
def test_linear(sign):
    def cost(n):
        began = time.perf_counter()
        markup.kinds(sign * n)
        markup.clean(sign * n + "\\emph{a}")
        return time.perf_counter() - began

    cost(100)
    assert cost(8000) < 0.5 + 16 * cost(2000)


def test_clean_repeats(spark):
    rows = [("q", 1, "<p>a</p>"), ("q", 1, "<p>a</p>"), ("q", 1, "<p>b</p>"), ("a", 1, "**c** d"), ("q", 2, ""), ("q", 3, "plain")]
    df = spark.createDataFrame(rows, "table_name string, record_id long, body string")
    assert sorted(map(tuple, markup.clean_bodies(df).collect())) == [("a", 1, "c d"), ("q", 1, "a"), ("q", 1, "b"), ("q", 2, ""), ("q", 3, "plain")]
    assert markup.clean_bodies(df.filter("false")).count() == 0
