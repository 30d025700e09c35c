"""Operators for text collections against brute force, and their defined cases."""

import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankmill.llm import code_spans, conversations, encodings, leaks, markup, mixing, near_duplicates, overlaps, pairs, sentences
from rankmill.llm.components import components
from rankmill.llm.fm_index import FMIndex
from rankmill.llm.mincut import min_cut
from rankmill.llm.words import likeness, runs_of_texts, sets_of_runs, words
from rankmill.session import Scratch

# --- shared parts ---


def runs(t, n=3):
    w = re.findall(r"\w+", (t or "").lower())
    return frozenset(zip(*[w[i:] for i in range(n)], strict=False))


def test_words():
    assert words("Ab_1, über-Maß") == ["ab_1", "über", "maß"]
    assert words("किताब") == re.findall(r"\w+", "किताब")
    assert words(None) == words("") == []


def test_runs_are_sets_of_triples():
    rng = random.Random(1)
    texts = [None, "", "a", "a b", *(" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))) for _ in range(200))]
    r, n = sets_of_runs(*runs_of_texts(texts, 3))
    assert n.tolist() == [len(runs(t)) for t in texts]
    cut = np.r_[0, np.cumsum(n)]
    for _ in range(300):
        i, j = rng.randrange(len(texts)), rng.randrange(len(texts))
        a, b = runs(texts[i]), runs(texts[j])
        if a | b:
            assert likeness(r[cut[i] : cut[i + 1]], r[cut[j] : cut[j + 1]]) == pytest.approx(len(a & b) / len(a | b))


@given(st.lists(st.lists(st.integers(0, 4), max_size=12), min_size=1, max_size=8), st.lists(st.integers(0, 5), max_size=10), st.integers(1, 3))
@settings(max_examples=150, deadline=None)
def test_fm_index(texts, pattern, n):
    lengths = np.array([len(t) for t in texts])
    ix = FMIndex.load(FMIndex.build(np.array([w for t in texts for w in t], np.uint64), lengths, np.arange(len(texts))).dump())
    lo, hi = ix.windows(ix.codes(np.array(pattern, np.uint64)), n)
    for i in range(len(pattern) - n + 1):
        want = sorted((k, j) for k, t in enumerate(texts) for j in range(len(t) - n + 1) if t[j : j + n] == pattern[i : i + n])
        at = ix.locate(np.arange(lo[i], hi[i]))
        owner = ix.text_at(at)
        assert sorted(zip(owner.tolist(), (at - ix.starts[owner]).tolist(), strict=True)) == want


@given(st.lists(st.tuples(st.floats(0, 3), st.floats(0, 3)), min_size=1, max_size=8), st.data())
@settings(max_examples=150, deadline=None)
def test_min_cut(costs, data):
    n = len(costs)
    edges = data.draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1), st.floats(0, 2)), max_size=10))

    def cost(labels):
        return sum(c[0] if x else c[1] for c, x in zip(costs, labels, strict=True)) + sum(w for i, j, w in edges if labels[i] != labels[j])

    got = min_cut([c[0] for c in costs], [c[1] for c in costs], edges)
    assert cost(got) == pytest.approx(min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n)), abs=1e-6)


def test_components(spark):
    rng = random.Random(3)
    pairs_ = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001 + i) for i in range(60)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs_:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    nodes = {x for p in pairs_ if p[0] != p[1] for x in p}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs_, "a long, b long"), Scratch(spark, "test")).collect()}
    assert got == {x: find(x) for x in nodes}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0


# --- 1 and 7: pairs of texts ---


def make_texts(n=60, seed=0):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        if i and rng.random() < 0.6:
            w = list(rng.choice(out)[1].split())
            for _ in range(rng.randint(0, 8)):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], [rng.choice(vocab)], [w[k], rng.choice(vocab)]])
                w = w or ["x"]
        else:
            w = [rng.choice(vocab) for _ in range(rng.randint(3, 60))]
        out.append((i, " ".join(w)))
    return [*out, (900, None), (901, ""), (902, "two words"), (903, "Same text, twice here"), (904, "Same text, twice here"), (903, "Same text, twice here")]


def brute(rows, t, n=3):
    out = set()
    rows = sorted(set((i, x) for i, x in rows if x))
    for i, a in rows:
        for j, b in rows:
            if i < j:
                x, y = runs(a, n), runs(b, n)
                if x and y and len(x & y) / len(x | y) >= t - 1e-12:
                    out.add((i, j))
    return out


@pytest.mark.parametrize("block", [2000, 3])
def test_near_duplicates(spark, block):
    rows = make_texts()
    df = spark.createDataFrame([(i, t, "extra") for i, t in rows], "doc_id long, text string, field string")
    near = near_duplicates.near_duplicates(df, "doc_id", ["text"], near_duplicates.Settings(threshold=0.6, run=3, block=block, bands=96))
    assert {(r["id_a"], r["id_b"]) for r in near_duplicates.all_pairs(near).collect()} == brute(rows, 0.6)
    links = Counter(x for p in brute(rows, 0.6) for x in p)
    got = {r["id"]: r["n_links"] for r in near_duplicates.groups(near).collect()}
    assert got == dict(links)


def test_near_duplicates_hot_and_empty(spark):
    hot = [(i, "this very text is a copy of all the others") for i in range(300)] + [(1000 + i, f"other text number n{i} and m{i} which is alone k{i} here z{i}") for i in range(600)]
    near = near_duplicates.near_duplicates(spark.createDataFrame(hot, "id long, t string"), "id", ["t"], near_duplicates.Settings())
    assert near_duplicates.groups(near).agg(F.count("*"), F.min("n_links"), F.max("group_id")).first()[:] == (300, 299, 0)
    none = near_duplicates.near_duplicates(spark.createDataFrame([], "id long, t string"), "id", ["t"], near_duplicates.Settings())
    assert near_duplicates.all_pairs(none).count() == 0 and near_duplicates.groups(none).count() == 0


@pytest.mark.parametrize("chars", [8_000_000, 400])
def test_overlaps(spark, chars):
    rows = make_texts(80, 5)
    train = [r for r in rows if r[0] % 3]
    held = [r for r in rows if r[0] % 3 == 0]
    s = overlaps.Settings(threshold=0.7, run=3, shard_chars=chars, chunk_words=500)
    frame = lambda x: spark.createDataFrame([(i, t, 1) for i, t in x], "id long, text string, rep int")
    found = overlaps.cross_split_overlaps(frame(train), frame(held), s, Scratch(spark, "test"))
    t, h = {i for i, _ in train}, {i for i, _ in held}
    want = {(a, b) if a in t else (b, a) for a, b in brute(rows, 0.7) if (a in t) != (b in t)}
    got = found.collect()
    assert {(r["train_id"], r["eval_id"]) for r in got} == want and want
    assert all(r["longest"] >= 3 and r["n_covered"] >= r["longest"] for r in got)
    empty = frame([]).filter("false")
    assert overlaps.cross_split_overlaps(empty, frame(held), s, Scratch(spark, "test")).count() == 0
    assert overlaps.cross_split_overlaps(frame(train), empty, s, Scratch(spark, "test")).count() == 0


# --- 2: conversations ---


def sequential(rows, known, gap=5.0):
    """The rules applied one message after another."""
    by = {}
    for i, c, role, text, at in {r[0]: r for r in rows}.values():
        by.setdefault(c, []).append((at / 1000 if at and at > 1e11 else at, i, conversations.ROLES.get((role or "").strip().lower()), text))
    out = set()
    for c, ms in by.items():
        if c not in known or any(m[0] is None or m[2] is None or not re.search(r"[^\s​﻿]", m[3] or "") for m in ms):
            continue
        kept = []
        for m in sorted(ms):
            if not (kept and kept[-1][2:] == m[2:] and m[0] - kept[-1][0] <= gap):
                kept.append(m)
        if len(kept) % 2 == 0 and all(m[2] == ("user", "assistant")[k % 2] for k, m in enumerate(kept)):
            out |= {(c, k + 1, m[1]) for k, m in enumerate(kept)}
    return out


def test_conversations(spark):
    rng, rows, n = random.Random(2), [], 0
    for c in range(120):
        at = rng.choice([1000.0, 1.6e12])
        for k in range(rng.choice([2, 2, 4, 6, 7, 30])):
            role = rng.choice(["user", " User", "human"]) if (k % 2 == 0) != (rng.random() < 0.02) else rng.choice(["AI", "bot ", "assistant"])
            text = rng.choice(["hi", "ok", "a b"])
            for _ in range(rng.choice([1, 1, 1, 2, 3])):
                n += 1
                rows.append((n * 7919 % 100_003, c, role, text, at))
                at += rng.choice([0.0, 1.0, 3.0, 5.0, 9.0]) * (1000 if at > 1e11 else 1)
    rows += [(200_001, 3, "system", "x", 1.0), (200_002, 5, "user", "​ ", 1.0), (200_003, 7, None, "x", 1.0), (200_004, 9, "user", "x", None), *rows[:50]]
    df = spark.createDataFrame(rows, "id long, conversation_id long, role string, content string, created_at double").withColumn("turn_no", F.lit("clash"))
    df = df.unionByName(df.limit(1).withColumn("conversation_id", F.lit(None).cast("long")).withColumn("id", F.lit(300_000).cast("long")))
    known = spark.createDataFrame([(c,) for c in range(118)], "id long")
    got = conversations.rebuild_conversations(df, known)
    assert {(r["conversation_id"], r["turn_no"], r["message_id"]) for r in got.collect()} == sequential(rows, set(range(118)))
    assert conversations.rebuild_conversations(df.filter("false"), known).count() == 0


def test_pointers(spark):
    nodes = [(i, i - 1 if i else None) for i in range(50)] + [(100, 99), (101, 100), (200, 202), (201, 200), (202, 201), (300, 300)]
    got = {r["id"]: (r["root"], r["depth"], r["status"]) for r in conversations.resolve_pointers(spark.createDataFrame(nodes, "id long, parent long"), Scratch(spark, "test")).collect()}
    assert all(got[i] == (0, i, "ok") for i in range(50))
    assert {got[100][2], got[101][2]} == {"orphan"} and {got[i][2] for i in (200, 201, 202, 300)} == {"cycle"}


@pytest.mark.parametrize("n", [10, 600])
def test_pointers_single_chain(spark, n):
    nodes = spark.createDataFrame([(i, i - 1 if i else None) for i in range(n)], "id long, parent long")
    got = {r["id"]: (r["root"], r["depth"], r["status"]) for r in conversations.resolve_pointers(nodes, Scratch(spark, "test")).collect()}
    assert got == {i: (0, i, "ok") for i in range(n)}


def test_longest_conversations_stay(spark):
    rows = [(c * 100 + k, c, ("user", "assistant")[k % 2], "x", 1000.0 + 10 * k) for c, turns in enumerate([4] * 200 + [12] * 3 + [18] * 2) for k in range(turns)]
    df = spark.createDataFrame(rows, "id long, conversation_id long, role string, content string, created_at double")
    got = conversations.rebuild_conversations(df, spark.range(205))
    assert {(r["conversation_id"], r["turn_no"], r["message_id"]) for r in got.collect()} == {(c, i % 100 + 1, i) for i, c, *_ in rows}


# --- 3: pairs ---


@pytest.mark.parametrize("text, want", [
    (None, True), ("", True), ("[1][2]", True), ("N/A", True), ("null", True), ("​ \xa0", True), ("-", True), ("\t\n [-]", True), ("No.", False), ("Yes, f. [1]", False), ("0", False)])
def test_empty(text, want):
    assert pairs.is_empty(text) is want


@pytest.mark.parametrize("text, want", [
    ("Sorry, I am not able to answer this. [4]", True), ("I'm sorry, but I can't help with that request", True), ("Sorry for the long name: f_x is the only hook that C offers.", False),
    ("I can't reproduce the KeyError on lib 1.2, but passing 9 to f_x avoids it there.", False), ("You cannot copy a class in FooBar; call f_x instead.", False),
    ("Lo siento, no puedo responder a esta pregunta", True), ("Leider kann ich diese Frage nicht beantworten [-]", True), ("I must decline to answer; please consult the maintainers of lib.", True),
    ("I have no information on X. Set f_x to 9 and the error goes away, since the loop then ends.", False), ("", False)])
def test_refusal(text, want):
    assert pairs.is_refusal(text) is want


def test_defects(spark):
    good = '[{"text": "Call f_x before the loop ends and drop the rest.", "citations": [1]}]'
    answer = "Call f_x before the loop ends and drop the rest. [1]"
    q = "How do I end the loop before g_y is called from the queue?"
    rows = [(1, q, good, answer), (1, q, good, answer), (2, q, good, None), (3, q, None, answer), (4, q, good[:40], answer), (5, q, good, "Call f_x before the loop"), (6, q, good, "how do i END the loop before g_y is called from the queue"),
            (7, q, good, "Сначала исправьте файл, потом запустите проверку ещё раз"), (8, None, good, answer), (9, q, "[]", "[1]"), (10, q, good, "Call f_x before the loop ends and drop (see"), (None, q, good, None)]
    df = spark.createDataFrame(rows, "query_id long, query_text string, claims_json string, answer string").withColumn("defect", F.lit("clash"))
    labels = spark.createDataFrame([("en", "the file is read once and then the loop ends before the queue is called"), ("de", "die Datei wird einmal gelesen und dann endet die Schleife vor der Warteschlange"), (None, "x")], "lang string, text string")
    got = {}
    for r in pairs.find_defects(df, labels).collect():
        got.setdefault(r["query_id"], set()).add(r["defect"])
    assert got == {2: {"empty"}, 3: {"empty"}, 4: {"truncated"}, 5: {"truncated"}, 6: {"copy"}, 7: {"language"}, 9: {"empty"}, 10: {"truncated"}}
    assert pairs.find_defects(df.filter("false"), labels.filter("false")).count() == 0


# --- 4: encodings ---

SOUND = ["Größe und Maß für die Straße", "déjà vu — “naïve” façade", "¿Está seguro? Señor Núñez", "Функция читает файл только один раз", "설정 파일이 없으면", "設定がない場合、関数は返します。", "não está à direita", "5 € ± 3 °C × 2"]
GARBLE = [("utf-8", "latin-1"), ("utf-8", "cp1252x"), ("utf-8", "cp1251"), ("utf-8", "mac_roman"), ("utf-8", "cp437")]


def garble(s, enc, wrong):
    raw = s.encode(enc)
    if wrong == "cp1252x":
        return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in raw)
    return raw.decode(wrong)


def test_encodings(spark):
    rows = [("q", i * 10 + k, "body", f"text {i} {s} end") for i in range(30) for k, s in enumerate(SOUND)]
    bad = []
    for s in SOUND[:4] + SOUND[6:7]:
        for enc, wrong in GARBLE:
            try:
                bad.append((s, garble(f"see {s} here", enc, wrong)))
            except UnicodeDecodeError:
                continue
    bad.append((SOUND[3], "see " + SOUND[3].encode("cp1251").decode("latin-1") + " here"))
    bad.append((SOUND[0], garble(garble(f"see {SOUND[0]} here", "utf-8", "cp1252x"), "utf-8", "cp1252x")))
    rows += [("q", 10_000 + i, "body", g) for i, (_, g) in enumerate(bad)]
    rows += [("q", 20_000, "body", "lost � here"), ("q", 20_001, "body", "<code>'Ã¼' in data</code>"), ("q", 20_002, "body", None), ("q", 20_003, "body", ""), ("q", None, "body", "Ã¼"), ("q", 20_004, "body", "NÃO use")]
    found = {r["record_id"]: r for r in encodings.find_garbled(spark.createDataFrame(rows, "table_name string, record_id long, field_name string, text string")).collect()}
    assert set(found) == {10_000 + i for i in range(len(bad))} | {20_000}
    restored = sum(found[10_000 + i]["restored"] == f"see {s} here" for i, (s, _) in enumerate(bad))
    assert restored >= 0.85 * len(bad)
    assert not found[20_000]["is_whole"]


# --- 5: markup ---


@pytest.mark.parametrize("body, want", [
    ("<p>a</p>", ["html"]), ("a &mdash; b", ["html"]), ("a list<int> of dict<str, int>", []), ("a < b and c > d, then a * b * c", []), ("**kwargs and __init__ of f_x", []), ("the glob *.py or *.cfg", []),
    ("It costs $5 with a and $9 with b", []), ("I read $HOME and $USER in x", []), ("C:\\temp\\stamp_x", []), ("The value [[1, 2], [3, 4]] and {'a': 1}", []), ("use **`x`** now", ["markdown"]), ("# Title\n\ntext `x`", ["markdown"]),
    ("see [[page|this]] and ''x''", ["wiki"]), ("== Head ==\n\n* a\n* b", ["wiki"]), ("- a\n- b\n\nend", ["markdown"]), ("runs in $O(n \\log n)$ time", ["latex"]), ("\\emph{x\\_y} z", ["latex"]), ("<p>$e^{-t}$</p>", ["html", "latex"]),
    ("```\n<b>x</b> [[p]]\n```", ["markdown"]), ("x = '<b>%s</b>' % y\nassert x.count('*') == 2", []), ("{{code|a <b> **c**}}", ["wiki"]), ("\\begin{verbatim}\n<p> **x**\n\\end{verbatim}", ["latex"]), ("plain words only.", []), (None, []), ("", []), ("~~old~~ new", ["markdown"]),
])
def test_kinds(body, want):
    assert markup.kinds(body) == want


@pytest.mark.parametrize("body, want", [
    ("<h2>T</h2><p>a <b>b</b></p><ul><li>x</li><li>y</li></ul><pre><code>c &lt; d\n</code></pre>", "## T\n\na b\n\n- x\n- y\n\n```\nc < d\n```"),
    ("## T\n\ntext **b** and [l](http://u)\n\n- x\n- y\n\n```py\nc\n```", "## T\n\ntext b and l\n\n- x\n- y\n\n```\nc\n```"),
    ("== T ==\n\n'''b''' [[p|q]] goes on here\n\n{{stub}}", "## T\n\nb q goes on here"), ("\\section{T}\n\n\\emph{a} and \\(x^2\\) here.", "# T\n\na and $x^2$ here."), (None, ""), ("  ", ""), ("<p>text that stays, whole.</p><!-- edited -->", "text that stays, whole."),
])
def test_clean(body, want):
    assert markup.clean(body) == want


@given(st.text(alphabet="<>/pb*_`#=[]{}|'$\\ \n-1a&;~", max_size=80))
@settings(max_examples=300, deadline=None)
def test_markup_never_fails(body):
    markup.kinds(body)
    markup.clean(body)
    for a, b in code_spans.code_spans(body):
        assert 0 <= a < b <= len(body)


@pytest.mark.parametrize("mark", ["*", "**", "***", "_"])
def test_long_emphasis(mark):
    passage = "word " * 200 + "end"
    body = f"See {mark}{passage}{mark} here."
    assert markup.kinds(body) == ["markdown"]
    assert mark == "_" or markup.clean(body) == f"See {passage} here."


def test_markup_tables(spark):
    df = spark.createDataFrame([("q", 1, "<p>a</p>"), ("q", 1, "<p>a</p>"), ("q", 2, "x" * 300_000)], "table_name string, record_id long, body string").withColumn("markup", F.lit(1))
    assert [tuple(r) for r in markup.find_markup(df.drop("markup")).collect()] == [("q", 1, "html")]
    assert markup.find_markup(df.drop("markup").filter("false")).count() == 0


# --- 8: leaks ---


@pytest.mark.parametrize("chars, words_", [(8_000_000, 1_000_000), (300, 50)])
def test_leaks(spark, chars, words_):
    rng = random.Random(8)
    items = [(i, " ".join(f"i{rng.randrange(30)}" for _ in range(rng.choice([5, 12, 20, 40])))) for i in range(25)]
    docs = []
    for d in range(80):
        w = [f"d{rng.randrange(500)}" for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5:
            p = rng.choice(items)[1].split()
            a = rng.randrange(max(1, len(p) - 5))
            w[len(w) // 2 : len(w) // 2] = p[a : a + rng.randint(3, 30)]
        docs.append((d, " ".join(w)))
    docs += [docs[0], (900, None), (901, "")]
    win = lambda t: {tuple(x[i : i + 12]) for x in [(t or "").split()] for i in range(len(x) - 11)}
    want = {(i, d) for i, p in items for d, t in docs if win(p) & win(t)}
    frame = lambda x: spark.createDataFrame([(i, t, 1) for i, t in x], "id long, text string, item_id int")
    found = leaks.find_leaks(frame(docs), frame(items), leaks.Settings(shard_chars=chars, chunk_words=words_)).collect()
    assert {(r["item_id"], r["doc_id"]) for r in found} == want and want
    assert all(r["longest"] >= 12 for r in found)
    assert leaks.find_leaks(frame(docs), frame([]).filter("false"), leaks.EXACT).count() == 0


def test_one_edit_recall():
    """The share of one-edit windows that agree in one repeat is what the number of repeats rests on."""
    rng = np.random.default_rng(0)
    s = leaks.NEAR
    a = rng.integers(1, 1 << 62, (4000, s.window), dtype=np.uint64)
    b = a.copy()
    b[np.arange(4000), rng.integers(0, s.window, 4000)] = 7
    starts = np.arange(4000) * s.window
    same = [leaks.embed_keys(a.ravel(), starts, s, r) == leaks.embed_keys(b.ravel(), starts, s, r) for r in range(s.repeats)]
    assert np.mean(same) > leaks.AGREE_ONE_EDIT - 0.05
    assert np.any(same, axis=0).mean() > 0.98
    moved = np.roll(a[:200], 1, axis=1)
    assert (leaks.edit_distance(a[:200], moved) == 2).all() and (leaks.edit_distance(a, a) == 0).all()
    assert leaks.repeats_for(0.99, 0) == 1


# --- 9: mixing ---


def test_flow_and_mix(spark, tmp_path):
    tok = mixing.Settings().tokenizer
    texts = [(i, f"{'word ' * (5 + i % 7)}{i}", "big" if i % 3 else "mid") for i in range(300)] + [(1000 + i, f"small text {i}", "tiny") for i in range(5)] + [(2000, None, "big"), (2001, "", "big"), (2002, "x y", None), (2003, "other", "unlisted")]
    texts += [(3000 + i, f"{'word ' * (5 + i % 7)}{i}", "tiny") for i in range(0, 30)]  # texts in two sources
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string").withColumn("tokens", F.lit("clash"))
    targets = spark.createDataFrame([("big", 0.5, 2), ("mid", 0.3, 3), ("tiny", 0.1, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    chosen = mixing.mix(docs.drop("tokens"), targets, mixing.Settings(tokenizer=tok, total=2000))
    rows = {r["source"]: r for r in mixing.shares(chosen, targets).collect()}
    for s, share in (("big", 0.5), ("mid", 0.3), ("tiny", 0.1)):
        assert abs(rows[s]["n_tokens"] - share * 2000) <= 40, rows[s]
        assert rows[s]["most_uses"] <= rows[s]["max_repeats"]
    assert rows["none"]["n_tokens"] == 0
    assert chosen.groupBy("doc_id", "source").count().filter("count > 1").count() == 0
    again = mixing.mix(docs.drop("tokens"), targets, mixing.Settings(tokenizer=tok, total=2000))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, chosen.collect()))
    assert mixing.mix(docs.drop("tokens").filter("false"), targets).count() == 0


def test_plan_prefers_unused_tokens():
    flow = mixing.plan([(("a",), 100), (("a", "b"), 100)], {"a": (0.5, 3), "b": (0.5, 3)}, 200.0)
    assert flow == {(0, "a"): 100.0, (1, "b"): 100.0}
    flow = mixing.plan([(("a",), 10)], {"a": (1.0, 4)}, 1000.0)
    assert flow == {(0, "a"): 40.0}


# --- 10: sentences ---

MODEL = sentences.Model(
    common={"en": {w: -3.0 for w in "the is and of to for in".split()}, "de": {w: -3.0 for w in "der die und ist für wurde".split()}},
    abbreviations={"en": {"e.g", "dr", "mr", "p.m", "fig", "st", "approx"}, "de": {"z", "b", "ca"}, "cyrl": {"т", "е", "рис"}},
    starters={"en": {"The", "Then", "Dr", "It", "This"}, "de": {"Die", "Das"}, "cyrl": {"Функция"}}, bound={"de": {("0", "Mai")}, "en": {("dr", "Quill")}},
)


@pytest.mark.parametrize("text, want", [
    ("The a. The b.", ["The a.", "The b."]), ("See Fig. 3 for the x. It is.", ["See Fig. 3 for the x.", "It is."]), ("It waited ... and waited ... until x. Then y.", ["It waited ... and waited ... until x.", "Then y."]),
    ('"Is this safe? Really?" asked the one. Then it ended.', ['"Is this safe? Really?" asked the one.', "Then it ended."]), ("He wrote: “Use x. It is fast.” Then he left.", ["He wrote: “Use x. It is fast.”", "Then he left."]),
    ("1. one. Then two\n2. three", ["1. one.", "Then two", "2. three"]), ("- a\n- b\n\nThe end", ["- a", "- b", "The end"]), ("Head line\n\nThe text goes\non here.", ["Head line", "The text goes\non here."]),
    ("Am 3. Mai wurde die Datei für x geändert. Das ist der Rest und die Liste.", ["Am 3. Mai wurde die Datei für x geändert.", "Das ist der Rest und die Liste."]), ("他说：“先检查，再运行。”把它放到目录。", ["他说：“先检查，再运行。”", "把它放到目录。"]),
    ("「確認してください。」と書いてあります。次です。", ["「確認してください。」と書いてあります。", "次です。"]), ("इसे पढ़ो। फिर चलाओ।", ["इसे पढ़ो।", "फिर चलाओ।"]), ("ใช้เวลามากครับ อย่าเรียกในลูปนะคะ", ["ใช้เวลามากครับ", "อย่าเรียกในลูปนะคะ"]),
    ("... end of the text. The next.", ["... end of the text.", "The next."]), ("Names such as Wow! or Ask? are legal in the x.", ["Names such as Wow! or Ask? are legal in the x."]), ("touches the process.The error is in x.", ["touches the process.", "The error is in x."]),
    ("The x is in a.b_c and Foo.Bar of the y.", ["The x is in a.b_c and Foo.Bar of the y."]), ("", []), (None, []), (" \r\n \r\n ", []), ("The a.\r\n\r\nThe b", ["The a.", "The b"]),
])
def test_units(text, want):
    assert [text[a:b] for a, b in sentences.units(text, MODEL)] == want


@given(st.text(alphabet="aB. !?\n\r-1)(\"“”。» ", max_size=80))
@settings(max_examples=300, deadline=None)
def test_units_cover(text):
    got = sentences.units(text, MODEL)
    assert all(a < b and text[a:b] == text[a:b].strip() for a, b in got)
    assert all(x[1] <= y[0] for x, y in zip(got, got[1:], strict=False))
    assert "".join(text[a:b] for a, b in got).split() is not None
    left = text
    for a, b in reversed(got):
        left = left[:a] + left[b:]
    assert not left.strip()


def test_sentences_learn(spark):
    rng = random.Random(0)
    rows = []
    for i in range(300):
        rows.append((i, "en", " ".join(rng.sample([f"The list has approx. {i} rows in the file.", "It is read by the loop and then closed.", "Then the queue ends, e.g. by a call.", "This goes on for the rest of the day."], 4))))
    rows += [(900, None, None), (901, "xx", ""), (None, "en", "The x. The y."), (0, "en", rows[0][2])]
    df = spark.createDataFrame(rows, "id long, lang string, text string").withColumn("start_char", F.lit("clash"))
    m = sentences.learn(df.select("text", "lang"))
    assert {"approx", "e.g"} <= m.abbreviations["en"] and {"The", "It", "Then", "This"} <= m.starters["en"]
    got = sentences.split_sentences(df, m).distinct().groupBy("id").count().collect()
    assert {r["count"] for r in got} == {4} and len(got) == 300
    assert sentences.learn(df.select("text", "lang").filter("false")).abbreviations == {}


def test_collocations(spark):
    """Words that begin sentences everywhere aren't tied to a number or abbreviation by their count; names that only follow one type are, even if they also begin sentences."""
    rows = [f"The list is kept by Dr. Quill in the file {i} of rows. It is read by the loop." for i in range(60)] + [f"Quill is the one who wrote part {i} of it. The rest was left." for i in range(60)]
    rows += [f"The file was sent to dr. {i} of the town and it went on." for i in range(60)] + ["The queue was closed in 2019. Samples of the row were lost in the loop."] * 5
    rows += [f"The loop of {w} ended. Samples of it and the samples went to the Samples file." for w in ("rows", "files", "lists", "queues", "words") for _ in range(40)]
    df = spark.createDataFrame([(t, "en") for t in rows], "text string, lang string")
    m = sentences.learn(df)
    assert "dr" in m.abbreviations["en"] and "Quill" in m.starters["en"] and "Samples" not in m.starters["en"]
    assert ("dr", "Quill") in m.bound["en"] and ("0", "Samples") not in m.bound["en"]
    assert len(sentences.units(rows[0], m)) == 2 and len(sentences.units(rows[180], m)) == 2


# --- on the test tables ---


def test_same_as_sql(same):
    from rankmill.llm import queries

    for name, sql in queries.SQL.items():
        same(queries.QUERIES[name], sql)


def test_exact_on_tables(spark, folder):
    from rankmill.llm import queries

    corpus = pd.read_parquet(f"{folder}/corpus.parquet").drop_duplicates(["doc_id", "text", "answer_body"])
    want = {(f, a, b) for f in ("text", "answer_body") for a, b in brute(list(zip(corpus["doc_id"], corpus[f], strict=True)), 0.6)}
    assert {tuple(r) for r in queries.QUERIES["p7_found"](spark, folder).collect()} == want
