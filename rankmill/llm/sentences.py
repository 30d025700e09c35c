"""Sentence units of texts in many languages and scripts.

What marks an abbreviation, and which words begin sentences, is learned from
the collection itself, per language, without supervision, by log-likelihood
ratios.  Abbreviations: how often a type stands before a period against how
often any type does, discounted by length; and sentences must go on after its
periods more often than after others.  Starters: how often a word stands at an
undoubted start (of a paragraph, or after a mark that belongs to no candidate)
against how often any word does.  Collocations: how often a capitalised word
follows one type's periods against all others', corrected for the number of
words tried.  No decision compares a count with a fixed number.  Every period
is then classified by these statistics.

All counts are taken over all texts, combined in the map tasks before the
shuffle; ratios are computed in Spark and only types above the thresholds reach
the driver.  They are words of natural languages (names with digits, underscores
or inner capitals are left out), so their number is bounded by the vocabulary.

The language of a paragraph is that of its script, or for Latin script the one
whose most frequent words, counted over all texts by their label, make the
paragraph most likely; labels need not be right or present.

Units: a blank line ends one, a single line break doesn't, except before a list
item.  Terminal marks and closing quotes or brackets belong to the unit; marks
inside a quotation or bracket don't end one.

Defined cases: NULL and blank texts give no units; offsets count code points;
rows repeated under one id give their units once; NULL ids are skipped; empty
tables give no rows; very long texts are cut whole, paragraph by paragraph.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankmill.session import Scratch
from rankmill.sources.tables import load

MARKS = ".!?…。！？｡।॥؟۔"
WIDE = "。！？｡"
CLOSERS = "”\"»)]}』」’›）】》“"
OPENERS = "“\"«([{『「‘‹（【《„¿¡'"
PAIRS = {"“": "”", "«": "»", "(": ")", "[": "]", "{": "}", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》", "„": "“”", "‹": "›"}
#: Thai ends a polite sentence with one of these particles and a blank.
THAI_ENDS = ("ครับ", "ค่ะ", "คะ", "นะ", "จ้ะ", "จ้า")
#: What joins a quotation to the rest of a Japanese sentence.
QUOTATIVE = "とっをはがにのもで、，,"

_QUOTE = re.compile("[" + re.escape('"' + "".join(PAIRS) + "".join(PAIRS.values())) + "]")
_BLANK = re.compile(r"\r?\n[^\S\n]*(?:\r?\n[^\S\n]*)+|\r[^\S\n\r]*\r")
#: Marks that may end a sentence; those right before a small letter or digit, as inside names and numbers, never do.
_CAND = re.compile(r"(?![.!?…]+[a-z0-9_])[" + re.escape(MARKS) + r"]+(?:[\s ]?[»]|[" + re.escape(CLOSERS) + r"])*")
_ITEM = re.compile(r"[^\S\n]*(?:([-*•–+·▪◦])|\(?(\d{1,3}|[a-z])[.)])[^\S\n]+")
_TOKEN = re.compile(r"[^\s]+")
_IDENT = re.compile(r"[_\d]|[a-zа-я][A-ZА-Я]|[A-Z][a-z]+[A-Z]")
_ALPHA = re.compile(r"[^\W\d_]+(?:[.'’][^\W\d_]+)*")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ_]\w*")
_VISIBLE = re.compile(r"\S")
_WORDY = re.compile(r"\w")
_CORE = re.compile(r"[\w.]*\w")
_FILE = re.compile(r"\w+\.\w{2,4}\b")
_NUMBER = re.compile(r"[\d.,:]+")
_ITEM_HEAD = re.compile(r"\s*\(?\d{1,3}\s*")
_SCRIPTS = ((0x0400, 0x052F, "cyrl"), (0x0600, 0x06FF, "arab"), (0x0900, 0x097F, "deva"), (0x0E00, 0x0E7F, "thai"), (0x3040, 0x30FF, "jpan"), (0x4E00, 0x9FFF, "hani"), (0xAC00, 0xD7AF, "hang"))
_NOT_LATIN = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b, _ in _SCRIPTS) + "]")


@dataclass
class Model:
    common: dict[str, dict[str, float]] = field(default_factory=dict)  # language -> word -> log probability
    abbreviations: dict[str, set[str]] = field(default_factory=dict)  # language -> types without the last period
    starters: dict[str, set[str]] = field(default_factory=dict)  # language -> capitalised words
    bound: dict[str, set[tuple[str, str]]] = field(default_factory=dict)  # language -> (type, next word) that go together across a period
    _votes: tuple | None = None
    _known: frozenset[str] | None = None

    def votes(self) -> tuple[list[str], dict[str, list[tuple[int, float]]]]:
        """The languages, and per frequent word how much it speaks for each of them beyond a word unknown to all."""
        if self._votes is None:
            names, words = list(self.common), {}
            for i, lang in enumerate(names):
                for w, p in self.common[lang].items():
                    words.setdefault(w, []).append((i, p + 12.0))
            self._votes = names, words
        return self._votes

    def known(self) -> frozenset[str]:
        if self._known is None:
            self._known = frozenset(self.votes()[1])
        return self._known


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """Offsets of the stretches between blank lines."""
    at = 0
    for m in _BLANK.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def language(text: str, model: Model) -> str:
    """A paragraph's language, or its script where that isn't Latin."""
    if not text.isascii():
        other = _NOT_LATIN.findall(text)
        if other and len(other) > 3 * sum(not _IDENT.search(w) for w in _LATIN.findall(text)):
            seen: Counter = Counter()
            for ch, n in Counter(other).items():
                seen[next((name for a, b, name in _SCRIPTS if a <= ord(ch) <= b), "hani")] += n
            return "jpan" if seen["jpan"] else seen.most_common(1)[0][0]
    names, votes = model.votes()
    if not names:
        return "latn"
    total = [0.0] * len(names)
    for w in model.known().intersection(text.lower().split()):  # every frequent word votes once
        for i, x in votes[w]:
            total[i] += x
    return names[total.index(max(total))]


@lru_cache(100_000)
def _kind(token: str) -> str:
    """How a token after a mark begins: lower, upper, number, name (an identifier), caseless or none."""
    t = token.lstrip(OPENERS + "-–—")
    if not t:
        return "none"
    core = _CORE.match(t)
    w = core.group(0) if core else t
    if t[0].isdigit():
        return "number"
    if _IDENT.search(w) or _FILE.match(t):
        return "name"
    if not (t[0].isalnum()):
        return "none"
    return "lower" if t[0].islower() else "upper" if t[0].isupper() else "caseless"


@lru_cache(100_000)
def _word(token: str) -> str:
    m = _ALPHA.search(token.lstrip(OPENERS))
    return m.group(0) if m else ""


def _before(text: str, start: int, at: int) -> str:
    """The token that ends at ``at``, without opening marks."""
    if at <= start or text[at - 1].isspace():
        return ""
    return text[max(start, text.rfind(" ", start, at) + 1) : at].split()[-1].lstrip(OPENERS + "-–—")


def _enclosed(p: str) -> list[tuple[int, int]]:
    """Spans of quotations and brackets (the opener's offset, the closer's), outermost only."""
    spans, stack, straight = [], [], None
    for m in _QUOTE.finditer(p):
        i, c = m.start(), m.group(0)
        if c == '"':
            if straight is None:
                straight = i
            else:
                spans.append((straight, i))
                straight = None
        elif stack and c in stack[-1][1]:
            spans.append((stack.pop()[0], i))
        elif c in PAIRS:
            stack.append((i, PAIRS[c]))
    spans.sort()
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if not out or a > out[-1][1]:
            out.append((a, b))
    return out


def _items(p: str) -> list[int]:
    """Offsets of the lines of a paragraph that begin a list item."""
    starts = [0]
    at = p.find("\n")
    while at >= 0:
        starts.append(at + 1)
        at = p.find("\n", at + 1)
    found, last, bullets = [], None, 0
    for k, a in enumerate(starts):
        m = _ITEM.match(p, a)
        if not m:
            continue
        if m.group(1):
            found.append((a, k, "-"))
            bullets += 1
        else:
            n = m.group(2)
            value = int(n) if n.isdigit() else ord(n) - 96
            if (last is None and (k == 0 or value == 1)) or (last is not None and value == last + 1):
                found.append((a, k, "1"))
                last = value
    first_is = bool(found) and found[0][1] == 0
    return [a for a, k, kind in found if first_is or kind == "1" or bullets > 1]


def _is_end(p: str, m: re.Match, lang: str, model: Model, unit: int) -> bool:
    marks = m.group(0)
    end = m.end()
    mark = marks.rstrip(CLOSERS + "  ")
    closed = len(mark) < len(marks)
    nxt = _TOKEN.search(p, end)
    if not nxt:
        return True
    spaced = p[end].isspace()
    token = nxt.group(0)
    if mark[-1] in WIDE:
        if not closed:
            return True
        opened_first = p[unit : unit + 1] in "“「『\"（("
        return not (token[0] in QUOTATIVE or (opened_first and token[0] not in "“「『\"" and not spaced))
    if mark[-1] in "।॥":
        return True
    kind = _kind(token)
    if token[0] in "—–-" and len(token.strip("—–-")) == 0:
        return False
    if token[0] in ",;:、，":
        return False
    starters = model.starters.get(lang, ())
    if not spaced:
        w = _word(token)
        known = w in starters and token.startswith(w) and len(w) > 1 and not (token[len(w) : len(w) + 1] in (".", "(", "_") or token[len(w) : len(w) + 1].isalnum())
        if closed or mark in (".", "...", "…") and len(mark) != 1:
            return False
        if mark == ".":
            prior = _before(p, unit, m.start())
            return bool(known and len(prior) > 1 and prior.lower() not in model.abbreviations.get(lang, ()))
        return kind == "upper" and known
    if kind == "lower":  # goes on, but for text in lower case throughout
        prior = _before(p, unit, m.start())
        if mark != "." or closed or (not prior or _NUMBER.fullmatch(prior)) or prior.lower() in model.abbreviations.get(lang, ()):
            return False
        first = _TOKEN.search(p, unit)
        return _word(token).capitalize() in starters or bool(first) and _kind(first.group(0)) == "lower"
    dots = len(mark) > 1 and set(mark) <= {".", "…"} or mark == "…"
    if dots:
        return kind in ("upper", "caseless") or (kind in ("number", "none") and mark == "…")
    if mark != ".":
        return True
    prior = _before(p, unit, m.start())
    if closed:
        return True
    kind_before = "number" if _NUMBER.fullmatch(prior) else "word"
    low = prior.lower()
    if kind_before == "number":
        w = _word(token)
        return kind != "upper" or w in starters or ("0", w) not in model.bound.get(lang, ())
    abbreviation = low in model.abbreviations.get(lang, ()) or (len(prior) == 1 and prior.isalpha() and prior.isupper() and ord(prior) < 0x3000)
    if not abbreviation:
        return True
    return kind == "upper" and _word(token) in starters and (low, _word(token)) not in model.bound.get(lang, ())


def units(text: str | None, model: Model) -> list[tuple[int, int]]:
    """Sentence units as offsets, without outer white space."""
    out: list[tuple[int, int]] = []
    text = text or ""
    for a, b in paragraphs(text):
        p = text[a:b]
        if not p.strip():
            continue
        lang = language(p, model)
        inside = _enclosed(p)
        cuts, items = [], _items(p)
        cand = list(_CAND.finditer(p))
        if lang == "thai":
            cand += [m for m in re.finditer(r"(?<=[฀-๿])(?=\s)", p) if p.endswith(THAI_ENDS, 0, m.start())]
            cand.sort(key=lambda m: m.start())
        solid = len(p.rstrip(" \t\r\n.… "))  # nothing but blanks and dots beyond
        unit, k, heads = 0, 0, {i: _ITEM.match(p, i).end() for i in items}
        breaks = iter(items + [len(p) + 1])
        item = next(breaks)
        visible = _VISIBLE.search(p).start()
        for m in cand:
            at, end, marks = m.start(), m.end(), m.group(0)
            while item <= at:
                if item > unit:
                    cuts.append(item)
                    unit, visible = item, _VISIBLE.search(p, item).start()
                item = next(breaks)
            while k < len(inside) and inside[k][1] < at:
                k += 1
            if k < len(inside) and inside[k][0] < at and inside[k][1] >= end:
                continue
            if heads and at < heads.get(unit, 0):  # the mark of an item's number
                continue
            if marks and not _WORDY.search(p, unit, at):
                continue
            if unit == 0 and marks == "." and _ITEM_HEAD.fullmatch(p, 0, at):  # a heading's number
                continue
            if not marks or _is_end(p, m, lang, model, visible):
                if solid <= end < len(p):
                    continue
                cuts.append(end)
                unit = end
                v = _VISIBLE.search(p, unit)
                visible = v.start() if v else len(p)
        cuts += [i for i in [item, *breaks] if unit < i < len(p)]
        at = 0
        for c in [*cuts, len(p)]:
            s = p[at:c]
            left = len(s) - len(s.lstrip())
            right = len(s.rstrip())
            if right > left:
                out.append((a + at + left, a + at + right))
            at = c
    return out


# --- learning ---


_COUNTS = "lang string, kind string, type string, next string, n long"


def _counted(texts: DataFrame, count, digest, scratch: Scratch, most: int = 300_000) -> DataFrame:
    """Sums of what ``digest`` makes of the counts that ``count`` adds up row by row, now and then and at the end of a task; written once.

    Counts are kept as one counter per (language, kind), whose keys are tokens as they stand.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def flush() -> pd.DataFrame:
            rows = [(*k, n) for k, n in digest(c).items()]
            c.clear()
            return pd.DataFrame(rows, columns=["lang", "kind", "type", "next", "n"])

        for pdf in batches:
            for text, lang in zip(pdf["text"], pdf["lang"], strict=True):
                if text:
                    count(c, text, lang)
            if sum(map(len, c.values())) > most:
                yield flush()
        yield flush()

    return scratch.write(texts.select("text", "lang").mapInPandas(run, _COUNTS).groupBy("lang", "kind", "type", "next").agg(F.sum("n").alias("n")))


def _common_words(texts: DataFrame, top: int, scratch: Scratch) -> dict[str, dict[str, float]]:
    def count(c: dict, text: str, label: str | None) -> None:
        lang = (label or "").strip().lower()
        if len(lang) == 2 and lang.isalpha():
            latin = text.isascii() or len(_LATIN.findall(text)) > len(_NOT_LATIN.findall(text)) / 3
            c[lang, "text"]["latin" if latin else "other"] += 1
            if latin:
                c[lang, "w"].update(text.lower().split())

    def digest(c: dict) -> Counter:
        out: Counter = Counter()
        for (lang, kind), tokens in c.items():
            for t, n in tokens.items():
                for w in _ALPHA.findall(t) if kind == "w" else (t,):
                    out[lang, kind, w, ""] += n
        return out

    counted = _counted(texts, count, digest, scratch)
    # a label counts as a language of Latin script if most of its texts are
    mostly = counted.filter("kind = 'text'").groupBy("lang").agg(F.sum(F.when(F.col("type") == "latin", F.col("n")).otherwise(-F.col("n"))).alias("more")).filter("more > 0")
    counts = counted.filter("kind = 'w'").join(mostly.select("lang"), "lang", "left_semi")
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "type"))).filter(F.col("r") <= top).join(F.broadcast(total), "lang")  # a row per language
    out: dict[str, dict[str, float]] = {}
    for r in ranked.select("lang", "type", "n", "total").orderBy("lang", "r").collect():  # at most ``top`` words of each two-letter language
        out.setdefault(r["lang"], {})[r["type"]] = math.log(r["n"] / r["total"])
    return out


def learn(texts: DataFrame, top: int = 300, abbreviation: float = 0.3, starter: float = 30.0, evidence: float = 0.3, collocation: float = 7.88) -> Model:
    """A model from ``texts(text, lang)``; thresholds are those of the published method.

    All decisions rest on ratios: none compares a count with a fixed number, so
    they are the same for a collection and for many copies of it but for the
    certainty that more evidence gives.
    """
    scratch = Scratch(texts.sparkSession, "sentences")
    model = Model(common=_common_words(texts, top, scratch))

    def count(c: dict, text: str, label: str | None) -> None:
        for a, b in paragraphs(text):
            tokens = text[a:b].split()
            if not tokens:
                continue
            lang = language(text[a:b], model)
            if lang in ("thai", "jpan", "hani"):
                continue
            c[lang, "token"].update(tokens)
            c[lang, "head"][tokens[0]] += 1
            c[lang, "follow"].update((t, tokens[i + 1]) for i, t in enumerate(tokens[:-1]) if t.endswith((".", "!", "?")))

    def digest(c: dict) -> Counter:
        """Types out of tokens: each different token is looked at once."""
        out: Counter = Counter()
        for lang, kind, t, nxt, n in ((lang, kind, *(key if kind == "follow" else (key, "")), n) for (lang, kind), keys in c.items() for key, n in keys.items()):
            named = _IDENT.search(t) is not None
            if named and kind == "token":  # most different tokens are names
                out[lang, "name", "", ""] += n
                continue
            core = t.strip(OPENERS + CLOSERS + ",;:")
            word = core.rstrip(".!?…")
            after = t[t.find(core) + len(word) :] if core else ""
            if kind == "head":
                if core[:1].isupper() and not named:
                    out[lang, "start", _word(core), ""] += n
                continue
            if kind == "follow" and (after != "." or not word or named) and not _NUMBER.fullmatch(word) and _kind(nxt) == "upper":  # an undoubted end
                if "." not in after or after == ".":
                    out[lang, "start", _word(nxt), ""] += n
                continue
            if kind == "token" and core[:1].isupper():
                out[lang, "any", _word(core), ""] += n
            if kind == "token" and not _ALPHA.fullmatch(word):
                out[lang, "name", "", ""] += n
            if kind == "follow" and after == "." and word and word[-1].isdigit() and _NUMBER.fullmatch(word) and _kind(nxt) == "upper":
                out[lang, "pair", "0", _word(nxt)] += n
            if named or not word or not _ALPHA.fullmatch(word):
                continue
            low = word.lower()
            if low == word.upper():  # scripts without case abbreviate otherwise
                continue
            period = core.endswith(".") and not core.endswith("..") and after[:1] == "."
            if kind == "token":
                out[lang, "with" if period else "without", low, ""] += n
                if period and after[1:2] in (",", ";"):
                    out[lang, "goes", low, ""] += n
            elif period and after == ".":
                following = _kind(nxt)
                if following in ("lower", "number", "name"):
                    out[lang, "goes", low, ""] += n
                elif following == "upper":
                    out[lang, "pair", low, _word(nxt)] += n
        return out

    counts = _counted(texts, count, digest, scratch)
    def per(kind: str):
        return F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0)).cast("double")

    total = counts.groupBy("lang").agg((per("with") + per("without")).alias("tokens"), per("with").alias("periods"), per("goes").alias("going"), (per("with") + per("without") + per("name")).alias("words"))

    def part(k, n, p):
        return k * F.log(p) + (n - k) * F.log(1 - p)

    clamp = lambda x: F.least(F.greatest(x, F.lit(1e-9)), F.lit(1 - 1e-9))

    def contrast(k, n, K, N):
        """Dunning's ratio of k out of n against the rest, K - k out of N - n; and the two shares."""
        p0, p1, p2 = clamp(K / N), clamp(k / n), clamp((K - k) / F.greatest(N - n, F.lit(1.0)))
        return -2 * (part(k, n, p0) + part(K - k, N - n, p0) - part(k, n, p1) - part(K - k, N - n, p2)), p1, p2

    c = F.col
    # abbreviations: bond between type and period, discounted by length and by uses without a period
    a = counts.filter("kind in ('with', 'without', 'goes')").groupBy("lang", "type").agg(per("with").alias("k"), per("without").alias("o"), per("goes").alias("goes")).filter("k > 0").join(F.broadcast(total), "lang")
    letters = F.length(F.regexp_replace("type", r"\.", "")).cast("double")
    dots = F.length("type") - letters + 1
    n = c("k") + c("o")
    bond = -2 * (part(c("k"), n, clamp(c("periods") / c("tokens"))) - part(c("k"), n, F.lit(0.99)))
    scored = a.withColumn("score", bond * F.exp(-letters) * dots * F.pow(letters, -c("o") / F.greatest(c("k") * 0.1, F.lit(1.0)))).filter(c("score") >= abbreviation)
    # starters: the share of undoubted starts (paragraphs, after marks that no abbreviation has) among a word's uses, against that among all other words
    pairs = counts.filter("kind = 'pair'").select("lang", "type", "next", "n")
    starts = counts.filter("kind = 'start'").select("lang", "type", "n").unionByName(pairs.filter("length(type) > 1").join(scored.select("lang", "type"), ["lang", "type"], "left_anti").select("lang", F.col("next").alias("type"), "n"))
    starts = starts.groupBy("lang", "type").agg(F.sum("n").alias("k"))
    s = starts.join(counts.filter("kind = 'any'").select("lang", "type", F.col("n").alias("m")), ["lang", "type"]).join(F.broadcast(starts.groupBy("lang").agg(F.sum("k").alias("all_starts"))), "lang").join(F.broadcast(total), "lang")
    g, p1, p2 = contrast(F.least("k", "m"), c("m"), c("all_starts"), c("words"))
    for r in s.filter((g >= starter) & (p1 > p2)).select("lang", "type").collect():
        model.starters.setdefault(r["lang"], set()).add(r["type"])
    # collocations: a capitalised word's share after one type's periods against its share after all others'; the surplus must also be the larger part, or starters would be bound by sheer size
    by_type = pairs.groupBy("lang", "type").agg(F.sum("n").alias("a"), F.count("*").alias("tried"))
    by_next, by_lang = (pairs.groupBy(*keys).agg(F.sum("n").alias(name)) for keys, name in ((("lang", "next"), "b"), (("lang",), "both")))
    wanted = by_type.filter("length(type) = 1").select("lang", "type").union(scored.select("lang", "type")).distinct()  # numbers, initials, likely abbreviations
    t = pairs.join(by_type.join(wanted, ["lang", "type"], "left_semi"), ["lang", "type"]).join(by_next, ["lang", "next"]).join(F.broadcast(by_lang), "lang")
    g, _, q2 = contrast(c("n"), c("a"), c("b"), c("both"))
    tested = F.lit(collocation) + 2 * F.log(c("tried"))  # as many words are tried as follow the type
    kept = scored.select("lang", "type", "k", "goes", "periods", "going").collect()
    mostly = s.select("lang", c("type").alias("next"), (2 * c("k") >= c("m")).alias("starts"))
    pair_rows = t.filter((g >= tested) & (c("n") > 2 * c("a") * q2)).join(mostly, ["lang", "next"], "left").select("lang", "type", "next", "n", "b", F.coalesce("starts", F.lit(False)).alias("starts")).collect()
    on: Counter = Counter()
    for r in pair_rows:
        if not r["starts"] and r["next"] not in model.starters.get(r["lang"], ()):
            on[r["lang"], r["type"]] += r["n"]
        elif 2 * r["n"] <= r["b"]:  # a word of sentence starts that follows other periods more often begins a sentence here too
            continue
        model.bound.setdefault(r["lang"], set()).add((r["type"], r["next"]))
    # a type must be followed by a sentence that goes on more often than periods are, beyond chance
    for r in kept:
        k = min(r["k"], r["goes"] + on[r["lang"], r["type"]])
        p, usual = k / r["k"], r["going"] / r["periods"]
        if p >= evidence and p > usual and 2 * (_log_share(k, r["k"], p) - _log_share(k, r["k"], usual)) >= collocation:
            model.abbreviations.setdefault(r["lang"], set()).add(r["type"])
    return model


def _log_share(k: float, n: float, p: float) -> float:
    """Log-likelihood of k out of n at a share of p."""
    p = min(max(p, 1e-9), 1 - 1e-9)
    return k * math.log(p) + (n - k) * math.log(1 - p)


def split_sentences(texts: DataFrame, model: Model) -> DataFrame:
    """``(id, start_char, end_char)`` of ``texts(id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [units(t, model) for t in batch.column("text").to_pylist()]
            flat = np.fromiter((x for u in found for ab in u for x in ab), np.int32).reshape(-1, 2)
            ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), [len(u) for u in found])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["id", "start_char", "end_char"])

    rows = texts.filter("id is not null and text is not null").select(F.col("id").cast("long").alias("id"), "text")
    return rows.mapInArrow(run, "id long, start_char int, end_char int")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text", "lang")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's sentence units as offsets."""
    docs = _documents(spark, folder)
    return split_sentences(docs, learn(docs.select("text", "lang"))).withColumnRenamed("id", "doc_id").distinct()


def p10_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Number and lengths of sentence units per source."""
    docs = _documents(spark, folder)
    found = split_sentences(docs, learn(docs.select("text", "lang"))).distinct()
    source = load(spark, folder, "documents").select(F.col("doc_id").alias("id"), "source")
    size = F.col("end_char") - F.col("start_char")
    return found.join(source, "id").groupBy("source").agg(F.count("*").alias("n_units"), F.sum(size).alias("n_chars"), F.max(size).alias("longest"))


QUERIES = {"p10_found": p10_found, "p10_lengths": p10_lengths}
SQL: dict[str, str] = {}
