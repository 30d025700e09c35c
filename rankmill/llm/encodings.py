"""Text that was decoded with the wrong character encoding.

Adjacent characters are counted over all texts, and their mutual information
tells how well two of them go together.  Stretches that some inverse mapping
would turn into valid text are left out of the counts, so garbled pairs gain no
support from each other, while the same characters in sound words do.  A field
is scored pair by pair; maximum-scoring segments isolate its improbable runs.
Only there are inverse mappings tested, all of them: each reading is scored by
the likelihood of its pairs in the counts, without the field's own, and must be
made of characters and pairs known from elsewhere.  The likeliest that beats
the text as it stands is taken, again and again for text that was garbled more
than once, until nothing changes.  What no reading holds up for is reported as
it is and not as whole, like replacement characters, which mark lost text by
themselves.

Characters are counted one by one up to U+25FF and by blocks of 256 beyond, so
the table of counts is bounded by the alphabet and not by the rows.

Defined cases: NULL, empty and pure ASCII fields are sound; sequences inside
code count as shown on purpose; rows repeated under one id are reported once if
any of them is garbled; NULL ids are skipped; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.llm.code_spans import code_spans, without
from rankmill.sources.tables import load

#: Single-byte encodings in which UTF-8 may have been read.
WRONG = ("cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "cp850", "cp1250", "koi8_r", "iso8859_15")
#: Encodings of scripts without Latin letters, and those they may have been read in.
SINGLE = tuple((o, i) for o in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r") for i in ("cp1251", "koi8_r", "cp866", "iso8859_5", "cp1253", "cp1255", "cp1256") if o != i)
PAIRED = {o: [i for x, i in SINGLE if x == o] for o, _ in SINGLE}
USUAL = ("cp1252", "latin-1")
LOST = "�"


def _byte_of(codec: str) -> dict[str, int]:
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b  # an undefined byte was kept as a control character
    if codec == "cp1252":
        for b in range(128, 160):
            out.setdefault(chr(b), b)
    return out


BYTES = {c: _byte_of(c) for c in {*WRONG, *(o for o, _ in SINGLE)}}
_TO_LATIN = {c: {ord(k): chr(v) for k, v in m.items()} | {i: "\0" for i in range(128, 256) if chr(i) not in m} for c, m in BYTES.items()}
_MULTI = re.compile(r"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")
_ALIEN = re.compile(r"[^\W\d_\x00-\x7f]{2,}")
_NON_ASCII = re.compile(r"[^\x00-\x7f]+")


def _as_bytes(s: str, codec: str) -> str:
    """The text's bytes in ``codec`` as characters U+0000..U+00FF; NUL where it has none."""
    t = s.translate(_TO_LATIN[codec])
    return t if max(t, default="") < "Ā" else "".join(c if c < "Ā" else "\0" for c in t)


def _sequences(raw: str, codec: str) -> list[tuple[int, int]]:
    """Spans of valid multi-byte UTF-8.  Outside the usual encodings of Latin text a lone pair of
    bytes is common by chance (a dash and an accented letter), so it must begin as Latin letters do."""
    found = [m.span() for m in _MULTI.finditer(raw)]
    if codec in ("cp1252", "latin-1"):
        return found
    ends, starts = {b for _, b in found}, {a for a, _ in found}
    return [(a, b) for a, b in found if b - a > 2 or raw[a] in "\xc2\xc3" or a in ends or b in starts]


def _decodable(s: str) -> list[tuple[int, int]]:
    """Spans that are valid multi-byte UTF-8 in some wrong encoding."""
    return [x for c in WRONG for x in _sequences(_as_bytes(s, c), c)]


def _class(cp: np.ndarray) -> np.ndarray:
    """Small classes: letters and digits of ASCII by kind, other characters one by one, those beyond U+25FF by block."""
    out = np.where(cp >= 0x2600, 0x10000 + (cp >> 8), cp)
    lower, upper, digit = (cp >= 97) & (cp <= 122), (cp >= 65) & (cp <= 90), (cp >= 48) & (cp <= 57)
    return np.where(lower, 97, np.where(upper, 65, np.where(digit, 48, out)))


def _points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


@lru_cache(100_000)
def _class_of(ch: str) -> int:
    return int(_class(_points(ch))[0])


def _excluded(text: str) -> str:
    """The text without code and without stretches that an inverse mapping may apply to."""
    spans = []
    for m in _NON_ASCII.finditer(text):
        spans += [(m.start() + a, m.start() + b) for a, b in _decodable(m.group(0))]
    spans += [m.span() for m in re.finditer(r"(?<![A-Za-z])[À-ÿ¨¸]{3,}(?![A-Za-z])", text)]
    if not spans:
        return text
    mask = list(text)
    for a, b in spans:
        mask[a:b] = "\n" * (b - a)
    return "".join(mask)


def pair_counts(texts: DataFrame) -> DataFrame:
    """``(a, b, n)``: adjacent classes of characters, at least one of them not ASCII, over all texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for pdf in batches:
            parts = []
            for t in pdf["text"]:
                c = _class(_points(_excluded(without(t, code_spans(t), "\n"))))
                keep = (c[:-1] > 127) | (c[1:] > 127)
                parts.append((c[:-1][keep] << 20) | c[1:][keep])
            keys, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int64), return_counts=True)
            total.update(dict(zip(keys.tolist(), n.tolist(), strict=True)))
        yield pd.DataFrame([(k >> 20, k & 0xFFFFF, n) for k, n in total.items()], columns=["a", "b", "n"])

    return texts.mapInPandas(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


#: Weight of the prior, in pairs, when a conditional probability is estimated.
PRIOR = 1.0
NO_PAIRS: dict[tuple[int, int], int] = {}


@dataclass
class Model:
    pair: dict[tuple[int, int], int]
    left: dict[int, int]
    right: dict[int, int]
    total: int
    _given: dict[tuple[int, int], tuple[float, float]] = field(default_factory=dict)  # bounded like the pairs of classes
    _bad: dict[tuple[int, int], float] = field(default_factory=dict)

    @classmethod
    def of(cls, rows) -> Model:
        pair, left, right = {}, Counter(), Counter()
        for a, b, n in rows:
            pair[a, b] = n
            left[a] += n
            right[b] += n
        return cls(pair, dict(left), dict(right), sum(pair.values()))

    def given(self, a: int, b: int, own: dict[tuple[int, int], int] = NO_PAIRS) -> tuple[float, float]:
        """Log of the probability that b follows a, and of that of b alone; ``own`` pairs are taken out of the counts."""
        k = own.get((a, b), 0) if own else 0
        if not k:
            known = self._given.get((a, b))
            if known is None:
                known = self._given[a, b] = self._estimate(a, b, 0)
            return known
        return self._estimate(a, b, k)

    def _estimate(self, a: int, b: int, k: int) -> tuple[float, float]:
        alone = (max(self.right.get(b, 0) - k, 0) + 0.5) / (self.total + 0.5 * (len(self.right) + 1))
        return math.log((max(self.pair.get((a, b), 0) - k, 0) + PRIOR * alone) / (max(self.left.get(a, 0) - k, 0) + PRIOR)), math.log(alone)

    def improbable(self, a: int, b: int) -> float:
        """Positive for two characters that don't go together: their mutual information turned round.

        It is the logarithm of a ratio of probabilities, so its sign does not hang on
        the size of the collection.  A character never seen in sound text tells
        nothing about its neighbours and is improbable by itself.
        """
        if a < 128 and b < 128:
            return -0.5
        known = self._bad.get((a, b))
        if known is None:
            known = self._bad[a, b] = self._score(a, b)
        return known

    def _score(self, a: int, b: int) -> float:
        if (a > 127 and a not in self.left and a not in self.right) or (b > 127 and b not in self.right and b not in self.left):
            return 1.0
        both, alone = self.given(a, b)
        return min(3.0, max(-3.0, alone - both - 0.3))

    def pairs_of(self, s: str) -> list[tuple[int, int]]:
        c = _class(_points(s)).tolist()
        return [(x, y) for x, y in zip(c, c[1:], strict=False) if x > 127 or y > 127]

    def support(self, s: str, own: dict[tuple[int, int], int] = NO_PAIRS) -> float:
        """Share of the text's pairs with non-ASCII that the corpus has elsewhere."""
        pairs = self.pairs_of(s)
        return sum(self.pair.get(p, 0) > own.get(p, 0) for p in pairs) / len(pairs) if pairs else 0.0

    def likelihood(self, s: str, own: dict[tuple[int, int], int] = NO_PAIRS) -> float:
        """Mean log-probability of the text's pairs with non-ASCII."""
        pairs = self.pairs_of(s)
        return sum(self.given(a, b, own)[0] for a, b in pairs) / len(pairs) if pairs else -30.0


def improbable_runs(text: str, model: Model) -> list[tuple[int, int]]:
    """Maximum-scoring segments of the pair scores, as spans of characters."""
    c = _class(_points(text)).tolist()
    out, cur, start, best, end = [], 0.0, 0, 0.0, 0
    hot = sorted({j for m in _NON_ASCII.finditer(text) for j in range(max(0, m.start() - 1), min(len(c) - 1, m.end()))})
    last = -1
    for i in hot:
        if last >= 0 and i > last + 1:
            cur -= 0.5 * (i - last - 1)  # ASCII pairs in between
        if cur <= 0:
            if best > 0:
                out.append((start, end))
            cur, best, start = 0.0, 0.0, i
        cur += model.improbable(c[i], c[i + 1])
        if cur > best:
            best, end = cur, i + 2
        last = i
    if best > 0:
        out.append((start, end))
    return out


#: A reading must be at least this much likelier per pair than the text as it stands.
GAIN = 1.0
#: Mean log-probability of a pair below which a run may be of another script altogether.
DOUBT = -4.0


def _readings(run: str, doubtful: bool) -> Iterator[tuple[str, list[str], float]]:
    """What inverse mappings make of a run: the new text, the characters that are new, and the share of the run they came from."""
    foreign = sum(ch > "\x7f" for ch in run)
    for codec in WRONG:
        raw = _as_bytes(run, codec)
        found = _sequences(raw, codec)
        if not found:
            continue
        share = sum(b - a for a, b in found) / foreign
        if share < (0.34 if codec in USUAL else 0.6):
            continue
        fixed = [raw[a:b].encode("latin-1").decode("utf-8") for a, b in found]
        out, at = [], 0
        for (x, y), ch in zip(found, fixed, strict=True):
            out += [run[at:x], ch]
            at = y
        yield "".join([*out, run[at:]]), fixed, share
    if foreign < 3 or not doubtful:
        return
    stretches = list(_NON_ASCII.finditer(run))
    for outer, inners in PAIRED.items():
        raw = [_as_bytes(m.group(0), outer) for m in stretches]
        raw = [None if "\0" in r else r.encode("latin-1") for r in raw]
        if not any(raw):
            continue
        for inner in inners:
            parts, at = [], 0
            for m, r in zip(stretches, raw, strict=True):
                parts += [run[at : m.start()], m.group(0) if r is None else r.decode(inner, "replace")]
                at = m.end()
            made = "".join([*parts, run[at:]])
            new = _ALIEN.findall(made)
            if made == run or LOST in made or not new or not all(w.isalpha() and (w[1:] == w[1:].lower() or w == w.upper()) for w in new):
                continue
            yield made, [c for w in new for c in w], 1.0


def _is_text(ch: str) -> bool:
    return unicodedata.category(ch)[0] in "LNPSM" and unicodedata.category(ch) not in ("Co", "Cn")


def _restore_once(text: str, model: Model, outside: str, own: dict) -> tuple[str, bool]:
    """One round of inverse mappings inside improbable runs, and whether a run is garbled that none of them restores; ``outside`` is the text with code blanked."""
    broken = False
    for lo, hi in reversed(improbable_runs(outside, model)):
        while lo > 0 and outside[lo - 1] > "\x7f":
            lo -= 1
        while hi < len(outside) and outside[hi] > "\x7f":
            hi += 1
        a, b = max(lo - 1, 0), min(hi + 1, len(text))  # with a neighbour on each side
        run, before, after = text[lo:hi], text[a:lo], text[hi:b]
        best, value, seen, sure, todo = None, 0.0, {run}, False, [run]
        now = model.likelihood(before + run + after, own)
        while todo:
            old = todo.pop()
            for made, fresh, share in _readings(old, now < DOUBT):
                if made in seen:
                    continue
                seen.add(made)
                if len(made) < len(old):  # it may have been garbled more than once
                    todo.append(made)
                known = sum((c := _class_of(ch)) in model.left or c in model.right for ch in fresh) / len(fresh)
                gain = model.likelihood(before + made + after, own) - now
                if known >= 0.8 and gain >= GAIN and model.support(before + made + after, own) >= 0.6:
                    if gain + 0.5 * share > value:
                        best, value = made, gain + 0.5 * share
                elif old is run and share >= 0.5 and all(map(_is_text, fresh)) and _is_sure(run):
                    sure = True
        if best is not None:
            text = text[:lo] + best + text[hi:]
        elif sure:
            broken = True
    return text, broken


def _is_sure(run: str) -> bool:
    """UTF-8 read as one of the usual encodings shows by itself: a lead byte's letter is followed by a sign that no word has there."""
    return any(not ch.isalpha() for c in USUAL for a, b in _sequences(_as_bytes(run, c), c) for ch in run[a + 1 : b])


def restore(text: str | None, model: Model) -> tuple[bool, str | None, bool]:
    """Whether the text is garbled, what could be regained of it, and whether that is all of it.

    Rounds go on until nothing changes or a state comes back.
    """
    if not text or text.isascii():
        return False, text, True
    outside = without(text, code_spans(text), "\n")
    lost = LOST in outside
    own = Counter(model.pairs_of(_excluded(outside)))
    now, states, broken = text, {text}, False
    while True:
        new, broken = _restore_once(now, model, outside, own)
        if new in states:
            break
        states.add(new)
        now = new
        outside = without(now, code_spans(now), "\n")
    return lost or broken or now != text, now, not (lost or broken)


def find_garbled(fields: DataFrame) -> DataFrame:
    """``(table_name, record_id, field_name, restored, is_whole)`` of the garbled among ``fields(table_name, record_id, field_name, text)``."""
    foreign = fields.filter("record_id is not null and text is not null").filter(F.col("text").rlike(r"[^\x00-\x7F]"))
    model = Model.of(pair_counts(foreign.select("text")).collect())  # bounded by the alphabet

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [restore(t, model) for t in pdf["text"]]
            out = pdf[["table_name", "record_id", "field_name"]].assign(restored=[r for _, r, _ in got], is_whole=[w for *_, w in got])
            yield out[[g for g, *_ in got]]

    return foreign.mapInPandas(run, "table_name string, record_id long, field_name string, restored string, is_whole boolean")


def _fields(spark: SparkSession, folder: str) -> DataFrame:
    def one(table: str, column: str) -> DataFrame:
        return load(spark, folder, table).select(F.lit(table).alias("table_name"), F.col("id").cast("long").alias("record_id"), F.lit(column).alias("field_name"), F.col(column).alias("text"))

    return reduce(DataFrame.unionByName, [one("questions", "title"), one("questions", "body"), one("answers", "body")])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of which at least a part was decoded wrongly."""
    return find_garbled(_fields(spark, folder)).select("table_name", "record_id", "field_name").distinct()


def p4_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Garbled fields with their restored text; ``is_whole`` is false where characters are lost for good."""
    return find_garbled(_fields(spark, folder)).distinct()


QUERIES = {"p4_found": p4_found, "p4_restored": p4_restored}
SQL: dict[str, str] = {}
