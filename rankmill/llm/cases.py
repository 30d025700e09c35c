"""Small literal cases of the operators whose results SQL cannot state: what goes in and what must come out.

They run the operators themselves; the queries over the whole tables are in the
modules of the problems.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.llm import encodings, markup, pairs, sentences


def _text(s: str | None) -> str:
    if s is None:
        return "null"
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in s.split("\n"))


def _values(rows: list[tuple], columns: str) -> str:
    cell = lambda v: _text(v) if isinstance(v, str) or v is None else str(v)
    return "select * from (values " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") t({columns})"


_MARKUP = [
    (1, "<p>a &amp; <b>b</b></p>", "html"), (2, "see [[page|this]] and ''x''", "wiki"), (3, "- a\n- b\n\nend", "markdown"), (4, "runs in $O(n \\log n)$ time", "latex"), (5, "a list<int> and **kwargs of f_x", None),
    (6, "It costs $5 with a and $9 with b", None), (7, "see *" + "long " * 100 + "passage*", "markdown"), (8, "so \\[ x^2 \\] holds", "latex"), (9, "x = '<b>%s</b>' % y", None), (10, "## Head\n\ntext", "markdown"),
]
_CLEAN = [
    (1, "<h2>T</h2><p>a <b>b</b></p><ul><li>x</li><li>y</li></ul>", "## T\n\na b\n\n- x\n- y"), (2, "== T ==\n\n'''b''' [[p|q]] goes on here\n\n{{stub}}", "## T\n\nb q goes on here"),
    (3, "\\section{T}\n\n\\emph{a} and \\(x^2\\) here.", "# T\n\na and $x^2$ here."), (4, "text **b** and [l](http://u)\n\n```py\nc\n```", "text b and l\n\n```\nc\n```"),
]


def markup_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of markup of small bodies, and the clean text of others."""
    frame = lambda rows, what: spark.createDataFrame([(what, i, b) for i, b, _ in rows], "table_name string, record_id long, body string")
    kinds = markup.find_markup(frame(_MARKUP, "kinds")).select("table_name", "record_id", F.col("markup").alias("result"))
    return kinds.unionByName(markup.clean_bodies(frame(_CLEAN, "clean")).select("table_name", "record_id", F.col("clean_text").alias("result")))


_SOUND = ["Größe und Maß für die Straße", "déjà vu à la façade naïve", "¿Está seguro? Señor Núñez", "Функция читает файл только один раз", "Размер ответа составляет около", "“x” isn’t — y…"]


def _garbled() -> list[tuple[int, str, str]]:
    twice = lambda s: s.encode().decode("latin-1").encode().decode("latin-1")
    return [
        (1, "see " + "Größe".encode().decode("latin-1") + " here", "see Größe here"), (2, "see " + "Señor".encode().decode("mac_roman") + " here", "see Señor here"), (3, "see " + twice("façade") + " here", "see façade here"),
        (4, "see " + "читает файл".encode("cp1251").decode("latin-1") + " here", "see читает файл here"), (5, "see " + "читает файл".encode().decode("cp1251") + " here", "see читает файл here"), (6, "lost � here", "lost � here"),
    ]


def encoding_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Garbled texts among sound ones, restored."""
    rows = [("t", i, "body", b) for i, b, _ in _garbled()] + [("t", 100 + 10 * k + i, "body", f"text {k} {s} end") for k in range(20) for i, s in enumerate(_SOUND)]
    return encodings.find_garbled(spark.createDataFrame(rows, "table_name string, record_id long, field_name string, text string")).select("record_id", "restored", "is_whole")


_CLAIMS = '[{"text": "Call f_x before the loop ends and drop the rest.", "citations": [1]}]'
_ANSWER, _ASK = "Call f_x before the loop ends and drop the rest. [1]", "How do I end the loop before g_y is called from the queue?"
_PAIRS = [
    (1, _ASK, _CLAIMS, _ANSWER, None), (2, _ASK, _CLAIMS, " [1] ", "empty"), (3, _ASK, None, _ANSWER, "empty"), (4, _ASK, _CLAIMS[:40], _ANSWER, "truncated"), (5, _ASK, _CLAIMS, "Call f_x before the loop", "truncated"),
    (6, _ASK, '[{"text": "How do I end the loop before g_y is called out of the queue?", "citations": []}]', "How do I end the loop before g_y is called out of the queue?", "copy"), (7, _ASK, '[{"text": "I\'m sorry, but I can\'t help with that request.", "citations": []}]', "I'm sorry, but I can't help with that request.", "refusal"),
    (8, _ASK, '[{"text": "Сначала исправьте файл, потом запустите проверку.", "citations": []}]', "Сначала исправьте файл, потом запустите проверку.", "language"), (9, _ASK, '[{"text": "Yes, f_x.", "citations": [2]}]', "Yes, f_x. [2]", None),
]


def pair_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Defects of small pairs."""
    df = spark.createDataFrame([p[:4] for p in _PAIRS], "query_id long, query_text string, claims_json string, answer string")
    return pairs.find_defects(df, spark.createDataFrame([("en", "the file is read once and then the loop ends before the queue is called"), ("de", "die Datei wird einmal gelesen und dann endet die Schleife")], "lang string, text string"))


_LEARN = ["The list has approx. %d rows in the file. It is read by Dr. Quill and then closed. Then the queue ends.", "Then the loop ends, e.g. by hand. The rest is left in file %d of the list.", "It was sent to dr. %d of the town and it went on."]
_SPLIT = [
    (1, "The list has approx. 30 rows. It is closed.", [(0, 29), (30, 43)]), (2, "It was Dr." + " " * 300 + "Quill who read it.", [(0, 328)]), (3, 'He wrote: “Use x. It is fast.” Then it ended.', [(0, 30), (31, 45)]),
    (4, "- a\n- b\n\nThe end", [(0, 3), (4, 7), (9, 16)]), (5, "如果为空，则返回。请先检查！", [(0, 9), (9, 14)]), (6, " \n ", []),
]


def sentence_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Units of small texts, by what a small collection teaches."""
    learned = sentences.learn(spark.createDataFrame([(t % i, "en") for t in _LEARN for i in range(80)], "text string, lang string"))
    return sentences.split_sentences(spark.createDataFrame([(i, t) for i, t, _ in _SPLIT], "id long, text string"), learned)


QUERIES = {f.__name__: f for f in (markup_cases, encoding_cases, pair_cases, sentence_cases)}
SQL = {
    "markup_cases": _values([("kinds", i, k) for i, _, k in _MARKUP if k] + [("clean", i, t) for i, _, t in _CLEAN], "table_name, record_id, result"),
    "encoding_cases": _values([(i, t, i != 6) for i, _, t in _garbled()], "record_id, restored, is_whole"),
    "pair_cases": _values([(i, d) for i, _, _, _, d in _PAIRS if d], "query_id, defect"),
    "sentence_cases": _values([(i, a, b) for i, _, u in _SPLIT for a, b in u], "id, start_char, end_char"),
}
