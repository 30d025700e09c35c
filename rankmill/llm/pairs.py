"""Broken prompt and response pairs, each with its defect.

language   Character n-gram naive Bayes over all scripts, fitted on labelled
           texts (at most ``label_rows`` of each language), gives the language
           posteriors of question and answer; the pair is defective if the
           answer's own language beats the question's by a margin, and the
           other way round.  An answer in an unlabelled language of the same
           script shows by letters that the question's language doesn't have.
truncated  The claims are no complete JSON, or one of answer and claims stops
           inside what the other goes on to say, or the text's last words, as
           n-grams counted over all claims, go on nearly always, or its last
           word is but the beginning of words seen far more often.
copy       Question and answer have nearly the same words.
refusal    All sentences of the answer decline.  Known ways of declining are
           given as patterns; others are learned: a sentence that denies and
           whose form, names left out, only ever stands alone as an answer,
           beyond chance by a likelihood ratio, while sentences that tell
           something are met among others too.
empty      Nothing is left without citation marks, placeholders and blanks.

Counts of n-grams and sentence forms are taken over all rows, combined before
the shuffle, and met by joins: no table of counts is gathered anywhere.

Defined cases: a NULL answer or claims column is empty; a NULL question has no
copy or language defect; rows repeated under one id count once, rows that differ
under one id give all their defects; NULL ids are skipped; empty tables give no
rows; names with digits, underscores or inner capitals have no language; without
labelled texts only scripts are told apart.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankmill.session import Scratch, parallelism, spread
from rankmill.sources.tables import load

_CITATION = re.compile(r"\[\s*(?:\d+(?:\s*,\s*\d+)*|-)\s*\]")
_HIDDEN = re.compile(r"[\s​-‏⁠-⁤﻿­᠎]+")
_PLACEHOLDER = re.compile(r"^\W*(?:n/?a|null|none|nil|nan|undefined|tbd|todo|empty|no answer|\.\.\.|…)?\W*$", re.I)
_NAME = re.compile(r"\b\w*(?:[_\d]|(?<=[a-z])(?=[A-Z]))\w*(?:\.\w+)*\b|\b\w+\.(?:py|json|txt|csv|cfg|toml|yaml|yml|log|md|ini|xml|html?)\b|\b\w*[a-z][A-Z]\w*\b")
_WORDS = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?。！？।؟;])\s+|\n+")

#: How a speaker declines, by language. Matched within one sentence, lower-cased.
DECLINES = re.compile(
    "|".join((
        r"\bsorry\b(?=.{0,60}(?:\bnot\b|can'?t|cannot|unable|n't\b|\bno\b))|^\W*(?:i'?m |i am )?(?:very |so )?sorry\W*$", r"\bmy apologies\b|\bi apologi[sz]e\b(?=.{0,60}(?:\bnot\b|cannot|unable|n't\b))", r"\b(?:can(?:no|')?t|cannot|unable to|not able to|won't|will not)\b.{0,40}\b(?:answer|help|assist|comply|say|respond|provide|tell|determine|be (?:resolved|answered|determined))",
        r"\b(?:i have|there is|contains?|found|gives?) no (?:information|answer|data|details)", r"\bno (?:information|answer)\b(?::| (?:is|was|can|could|about|on))", r"\bnot (?:possible|enough information|sufficient information)\b", r"\bdecline to\b", r"\bas an? (?:ai|language model)\b",
        r"\bi (?:do not|don't) (?:know|have)\b", r"\b(?:outside|beyond) (?:of )?what i can\b", r"\b(?:do|does) not (?:contain|mention|cover|say|provide)\b.{0,30}\b(?:information|answer|anything|this|question)", r"\binsufficient (?:information|context)", r"\bno answer\b", r"\brefuse\b",
        r"désolé", r"\bne (?:peux|puis|pouvons|peut)\b.{0,25}\b(?:pas|rien)\b", r"\bne perme(?:t|ttent)\b.{0,12}répondre", r"\baucune (?:information|réponse|des sources)", r"\bpas (?:assez|suffisamment) d", r"\bimpossible de (?:répondre|dire)",
        r"\blo siento\b", r"\bno puedo\b", r"\bno (?:tengo|hay|dispongo|contienen?)\b.{0,30}\binformaci", r"\bno es posible\b", r"\bning[uú]n[ao]?\b.{0,20}\b(?:informaci|fuente)", r"\bno sé\b",
        r"\bleider\b.{0,30}\b(?:nicht|keine?)\b", r"\btut mir leid\b", r"\bkann ich\b.{0,40}\b(?:nicht|nichts|keine)\b", r"\bkeine (?:information|angaben|antwort|auskunft)", r"\bich (?:kann|weiß|darf)\b.{0,40}\b(?:nicht|nichts|keine)\b", r"\bnicht möglich\b", r"\benthalten keine\b",
        r"\b(?:sinto muito|desculpe|lamento)\b", r"\bnão (?:posso|consigo|sei|é possível|há|tenho)\b", r"\bnenhuma (?:informação|das fontes)",
        r"извин", r"к сожалению", r"прости", r"не мог[ул]", r"не удалось", r"невозможно", r"нет (?:информации|данных|сведений|ответа)", r"не содерж", r"не знаю",
        r"抱歉|对不起|對不起|无法|無法|不能回答|没有(?:相关)?信息|沒有資訊|不知道", r"申し訳|すみません|お答えできません|回答できません|答えられません|情報(?:が|は)(?:ありません|含まれ)|わかりません", r"죄송|답변(?:할|드릴) 수 없|알 수 없|정보가 없",
        r"क्षमा|माफ़|उत्तर नहीं|जानकारी नहीं|असमर्थ", r"عذرا|آسف|لا (?:أستطيع|يمكنني|يمكن|توجد|أملك)", r"ขออภัย|ขอโทษ|ไม่สามารถ|ไม่มีข้อมูล|ไม่ทราบ",
    )))
#: Words that deny, in the languages of the tables; a learned refusal has one.
DENIES = re.compile(
    r"\b(?:not|no|nothing|none|never|neither|nor|cannot|without|unable|insufficient|lacks?|nicht|nichts|kein\w*|ohne|ne|pas|rien|aucune?s?|sans|nada|nunca|ning[uú]n\w*|sin|não|nenhum\w*|sem|niets?|geen|non|niente|nessun\w*)\b|n['’]t\b"
    r"|\bне\w*|нет|ни\w*|[不没沒无無]|ない|ませ|못|없|안 |नहीं|لا |ليس|لم |ไม่", re.I)
#: What shows that a declining sentence goes on to give something.
GIVES = re.compile(r"\b(?:but|however|instead|though|yet|aber|jedoch|sondern|mais|cependant|pero|sin embargo|mas|porém)\b|但是?|しかし|но\b|однако")


@dataclass
class Settings:
    label_rows: int = 150  # labelled texts of each language
    sure: float = 0.96  # posterior probability that the languages differ
    copy: float = 0.75
    ends: float = 0.12
    alone: float = 6.6  # likelihood ratio from which a sentence's form only stands alone


def core(text: str | None) -> str:
    """What a text says, without citation marks and blanks of any kind."""
    return _HIDDEN.sub(" ", _CITATION.sub(" ", text or "")).strip()


def is_empty(text: str | None) -> bool:
    return bool(_PLACEHOLDER.match(core(text)))


def parse_claims(claims: str | None) -> list[str] | None:
    """The claims' texts; None if they are no complete JSON."""
    try:
        value = json.loads(claims)
    except (TypeError, ValueError):
        return None
    if isinstance(value, dict):
        value = value.get("claims", [value])
    if not isinstance(value, list):
        return [] if value is None else [str(value)]
    return [str(x.get("text") or "") if isinstance(x, dict) else str(x or "") for x in value]


def is_refusal(answer: str) -> bool:
    """Every sentence declines, refers elsewhere or is an address; none gives anything."""
    parts = [p for p in _SENTENCE.split(core(answer)) if _WORDS.search(p)]
    hits = [bool(DECLINES.search(p.lower().replace("’", "'"))) for p in parts]
    if not parts or not any(hits):
        return False
    for i, (p, hit) in enumerate(zip(parts, hits, strict=True)):
        low = p.lower()
        m = GIVES.search(low)
        if hit and m and not DECLINES.search(low[m.end() :].replace("’", "'")) and len(_WORDS.findall(low[m.end() :])) > 3:
            return False
        if not hit and not (i and hits[i - 1] and re.search(r"\b(?:please|consult|ask|refer|contact|bitte|veuillez|consulte|por favor)\b|пожалуйста|请|ください|하세요", low)) and len(_WORDS.findall(low)) > 4:
            return False
    return True


def is_copy(question: str, answer: str, least: float) -> bool:
    """Nearly the same words, or the whole question with a few words of introduction."""
    q, a = set(_WORDS.findall(question.lower())), set(_WORDS.findall(core(answer).lower()))
    shared = len(q & a)
    return shared > 0 and (shared / len(q | a) >= least or (shared >= 0.9 * len(q) and len(a - q) <= 4 and 2 * shared >= len(a)))


def sentences_of(answer: str | None) -> list[str]:
    return [p for p in _SENTENCE.split(core(answer)) if _WORDS.search(p)]


def form(sentence: str) -> str:
    """A sentence with its names and numbers made alike."""
    return " ".join("\x01" if w[0].isdigit() else w for w in tokens(sentence))


def denies(sentence: str) -> bool:
    """Whether a sentence denies and gives nothing after it; a plain No with what follows is an answer."""
    low = re.sub(r"^\W*(?:no|nein|non|não|нет)\s*,", "", sentence.lower())
    m = GIVES.search(low)
    return bool(DENIES.search(low)) and not (m and len(_WORDS.findall(low[m.end() :])) > 3)


def is_open(text: str) -> bool:
    """Whether the last sentence opens a bracket, quotation or code that it doesn't close."""
    last = _SENTENCE.split(core(text))[-1]
    pairs = (("(", ")"), ("[", "]"), ("“", "”"), ("«", "»"), ("「", "」"), ("（", "）"))
    if any(last.count(a) > last.count(b) for a, b in pairs if not (a == "“" and "„" in last)):
        return True
    return last.count('"') % 2 == 1 or last.count("`") % 2 == 1 or last.count("„") > last.count("“") + last.count("”")


def stops_inside(a: list[str], parts: list[list[str]]) -> bool:
    """Whether the words ``a`` follow the joined ``parts`` but break off inside one of them."""
    whole = [w for p in parts for w in p]
    p = 0
    while p < min(len(a), len(whole)) and a[p] == whole[p]:
        p += 1
    if p == len(whole) or p < max(2, len(a) - 3):
        return False
    borders, n = set(), 0
    for part in parts:
        n += len(part)
        borders.add(n)
    return p < len(a) or p not in borders


# --- language ---


_LETTERS = re.compile(r"[^\W\d_]+")
_SYLLABIC = re.compile(r"[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")


def _grams(word: str) -> list[str]:
    """Up to three letters in a row, borders included; single characters where a script has thousands or writes no blanks."""
    if _SYLLABIC.search(word):
        return list(word)
    s = f" {word} "
    return [s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1) if s[i : i + n] != " "]


class Languages:
    """Naive Bayes over character n-grams."""

    def __init__(self, counts: dict[str, dict[str, float]]):
        """Relative frequencies mixed with their mean over the languages, so that one with few texts has no smaller penalty for what it lacks."""
        self.names = sorted(counts)
        keys = {g: i for i, g in enumerate(sorted({g for c in counts.values() for g in c}))}
        share = np.zeros((len(keys), len(self.names)))
        for j, lang in enumerate(self.names):
            for g, n in counts[lang].items():
                share[keys[g], j] = n
        share /= np.maximum(share.sum(axis=0), 1e-9)
        self.keys, self.table = keys, np.log(np.maximum(0.9 * share + 0.1 * share.mean(axis=1, keepdims=True), 1e-12)) if keys else share
        # single letters that make up all but a ten thousandth of a language's
        self.letters: dict[str, set[str]] = {}
        for lang in self.names:
            own = {g: n for g, n in counts[lang].items() if len(g) == 1}
            total = sum(own.values())
            self.letters[lang] = {g for g, n in own.items() if n >= 2e-4 * total}
        self._words: dict[str, np.ndarray] = {}

    @classmethod
    def fit(cls, rows: list[tuple[str, str]]) -> Languages:
        counts: dict[str, Counter] = {}
        for lang, text in rows:
            counts.setdefault(lang, Counter()).update(cls.features(text))
        return cls(counts)

    @staticmethod
    def words(text: str) -> list[str]:
        return _LETTERS.findall(_NAME.sub(" ", text).lower())

    @classmethod
    def features(cls, text: str) -> list[str]:
        return [g for w in cls.words(text) for g in _grams(w)]

    def _of(self, word: str) -> np.ndarray:
        v = self._words.get(word)
        if v is None:
            if len(self._words) > 100_000:
                self._words.clear()
            at = [self.keys[g] for g in _grams(word) if g in self.keys]
            v = self._words[word] = self.table[at].sum(axis=0) / 3 if at else np.zeros(len(self.names))
        return v

    def posteriors(self, words: list[str]) -> np.ndarray:
        """Posterior of each language, all being as likely beforehand."""
        total = np.zeros(len(self.names))
        for w in words:
            total += self._of(w)
        p = np.exp(total - total.max())
        return p / p.sum()

    def foreign(self, words: list[str], lang: str) -> float:
        """Likelihood ratio of the letters that the language doesn't have being more than the odd name or loan."""
        own, n, k = self.letters.get(lang, set()), 0, 0
        for w in words:
            if not _SYLLABIC.search(w):
                n += len(w)
                k += sum(c not in own for c in w)
        usual = 0.005
        if not n or k <= usual * n:
            return 0.0
        p = min(k / n, 1 - 1e-9)
        return k * math.log(p / usual) + (n - k) * math.log((1 - p) / (1 - usual))


_SCRIPTS = {"cyrillic": "Ѐ-ԯ", "arabic": "؀-ۿ", "devanagari": "ऀ-ॿ", "thai": "฀-๿", "kana": "぀-ヿ", "han": "一-鿿", "hangul": "가-힯", "greek": "Ͱ-Ͽ", "hebrew": "֐-׿"}
_SCRIPT = {k: re.compile(f"[{v}]") for k, v in _SCRIPTS.items()}
_QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|「[^」\n]*」|`[^`\n]*`")


def script(text: str) -> str:
    """The script of a text's words, names left out; kana makes a text with Han characters Japanese."""
    t = _NAME.sub(" ", text)
    seen = {k: len(p.findall(t)) for k, p in _SCRIPT.items()}
    best = max(seen, key=seen.get)
    latin = len(re.findall(r"[A-Za-zÀ-ɏ]+", t))
    if seen[best] <= 2 * latin or not seen[best]:
        return "latin"
    return "kana" if best == "han" and seen["kana"] > 0.1 * seen["han"] else best


#: Likelihood ratio from which letters show another language.
FOREIGN = 7.88


def differs(model: Languages, question: str, answer: str, sure: float) -> bool:
    """Whether the answer is in another language than the question, quotations in either left out."""

    def own_part(text: str) -> tuple[str, list[str]]:
        bare = core(_QUOTED.sub(" ", text))
        words = model.words(bare)
        return (bare, words) if sum(map(len, words)) >= 8 else (core(text), model.words(core(text)))

    (question, q), (answer, a) = own_part(question), own_part(answer)
    if not a or not q:
        return False
    one, two = script(question), script(answer)
    if one != two:
        return True
    if len(model.names) < 2:
        return False
    pq, pa = model.posteriors(q), model.posteriors(a)
    if 1.0 - float(pq @ pa) >= sure:
        return True
    asked = model.names[int(pq.argmax())]
    return model.foreign(a, asked) >= FOREIGN and model.foreign(q, asked) == 0.0


# --- ends of texts ---


#: Characters of scripts without blanks between words are tokens by themselves.
_TOKENS = re.compile(r"\x01|[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff]|[^\W\d_\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff]+(?:['’][^\W\d_]+)?|\d+(?:[.,]\d+)*|[,;:(「『“«„\"`]")


def tokens(text: str) -> list[str]:
    """Words with names and numbers made alike."""
    t = _NAME.sub(" \x01 ", core(text))
    return _TOKENS.findall(t.lower())


def tail_keys(text: str) -> list[str]:
    t = ["^", "^", *("\x01" if w[0].isdigit() else w for w in tokens(text))]
    return [" ".join(t[-n:]) for n in (1, 2, 3)]


def _end_counts(rows: DataFrame, most: int = 300_000) -> DataFrame:
    """``(key, ends, n)``: how often an n-gram of words closes a claim's sentence, and how often it occurs, over all rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends: Counter = Counter()
        seen: Counter = Counter()

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([(k, ends[k], n) for k, n in seen.items()], columns=["key", "ends", "n"])
            ends.clear()
            seen.clear()
            return out

        for pdf in batches:
            for claims in pdf["claims_json"]:
                for text in parse_claims(claims) or ():
                    if is_empty(text):
                        continue
                    for s in _SENTENCE.split(text):
                        t = ["^", "^", *("\x01" if w[0].isdigit() else w for w in tokens(s))]
                        if len(t) == 2:
                            continue
                        seen.update(t[2:])
                        seen.update(map(" ".join, zip(t[1:], t[2:], strict=False)))
                        seen.update(map(" ".join, zip(t, t[1:], t[2:], strict=False)))
                        ends.update((t[-1], " ".join(t[-2:]), " ".join(t[-3:])))
            if len(seen) > most:
                yield flush()
        yield flush()

    return rows.mapInPandas(run, "key string, ends long, n long").groupBy("key").agg(F.sum("ends").alias("ends"), F.sum("n").alias("n"))


_STOP = re.compile(r"[.!?。！？।؟…][\"”»』」)’]*$")


def fit_languages(labelled: DataFrame, per_language: int) -> Languages:
    """The model of ``labelled(lang, text)``, from at most so many texts of each two-letter label, chosen by a hash; n-grams are counted in tasks."""
    rows = labelled.select(F.lower(F.trim("lang")).alias("lang"), "text").filter("text is not null and lang rlike '^[a-z]{2}$'")
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text"))).filter(F.col("nth") <= per_language).select("lang", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts: dict[str, Counter] = {}
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                counts.setdefault(lang, Counter()).update(Languages.features(text))
            yield pd.DataFrame([(lang, g, n) for lang, c in counts.items() for g, n in c.items()], columns=["lang", "gram", "n"])

    counts: dict[str, dict[str, float]] = {}
    counted = spread(rows).mapInPandas(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # of a bounded number of texts
        counts.setdefault(r["lang"], {})[r["gram"]] = r["n"]
    return Languages(counts)


def find_defects(generations: DataFrame, labelled: DataFrame, s: Settings | None = None) -> DataFrame:
    """``(query_id, defect)`` of ``generations(query_id, query_text, claims_json, answer)``; ``labelled(lang, text)`` fits the languages."""
    s = s or Settings()
    scratch = Scratch(generations.sparkSession, "pairs")
    model = fit_languages(labelled, s.label_rows)
    rows = generations.filter("query_id is not null").select(F.col("query_id").cast("long").alias("query_id"), "query_text", "claims_json", "answer").distinct().withColumn("row_id", F.xxhash64("query_id", "query_text", "claims_json", "answer"))
    rows = scratch.write(rows.repartition(parallelism(generations.sparkSession)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                answer, claims, question = (x if isinstance(x, str) else None for x in (r.answer, r.claims_json, r.query_text))

                def add(defect: str, tail: list[str] = (), own: int = 0, r=r, out=out) -> None:
                    out.append((r.row_id, r.query_id, defect, list(tail), own))

                parts = parse_claims(claims)
                no_answer = is_empty(answer)
                no_claims = claims is None or is_empty(claims) or (parts is not None and all(map(is_empty, parts)))
                if no_answer or no_claims:
                    add("empty")
                broken = parts is None and not no_claims
                copies = not no_answer and question and is_copy(question, answer, s.copy)
                refuses = not no_answer and not copies and is_refusal(answer)
                if refuses:
                    add("refusal")
                if copies:
                    add("copy")
                if not no_answer and not copies:
                    said = sentences_of(answer)
                    for p in said:
                        if denies(p) or len(said) > 1 and DENIES.search(p):
                            add("form", [form(p)], int(len(said) == 1) + 2 * refuses)
                    if len(said) > 1 and all(map(denies, said)) and not refuses:
                        add("form", [" ".join(map(form, said))], 1)
                if not no_answer and question and not copies and differs(model, question, answer, s.sure):
                    add("language")
                if not broken and not no_answer and not no_claims:
                    a, c = _WORDS.findall(core(answer).lower()), [_WORDS.findall(core(t).lower()) for t in parts]
                    broken = stops_inside(a, c) or stops_inside([w for p in c for w in p], [a])
                    broken = broken or (not copies and (is_open(answer) or any(is_open(t) for t in parts[-1:])))
                if broken:
                    add("truncated")
                elif not copies and not refuses:
                    last = [t for t in (parts or ()) if not is_empty(t)]
                    if not no_answer and not _STOP.search(core(answer)):
                        add("?", tail_keys(_SENTENCE.split(core(answer))[-1]), int(bool(last) and tail_keys(last[-1]) == tail_keys(core(answer))))
                    if last and not _STOP.search(core(last[-1])):
                        add("?", tail_keys(_SENTENCE.split(last[-1])[-1]), 1)
            yield pd.DataFrame(out, columns=["row_id", "query_id", "defect", "tail", "own"])

    found = scratch.write(rows.mapInPandas(run, "row_id long, query_id long, defect string, tail array<string>, own int"))
    counts = scratch.write(_end_counts(rows.select("claims_json")))
    asked = found.filter("defect = '?'").select("row_id", "query_id", "own", F.posexplode("tail").alias("order", "key"))
    # a last word that is only ever last, while many more words begin with it, is the beginning of one
    words = counts.filter(F.col("key").rlike(r"^[^ ^\x01]{2,}$")).select("key", "n")
    lasts = asked.filter("order = 0").select("key").distinct()
    begun = words.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("key") - 1), lambda n: F.substring(F.col("key"), F.lit(1), n))).alias("key")).join(lasts, "key", "left_semi").groupBy("key").agg(F.sum("n").alias("begun"))
    known = asked.join(counts, "key", "left").join(begun, "key", "left")
    # a text's own occurrence is taken out of the counts
    n, e = F.greatest(F.coalesce("n", F.lit(0)) - F.col("own"), F.lit(0)), F.greatest(F.coalesce("ends", F.lit(0)) - F.col("own"), F.lit(0))
    wide = known.groupBy("row_id", "query_id", "own").agg(*[F.max(F.when(F.col("order") == k, v)).alias(f"{c}{k + 1}") for k in range(3) for c, v in (("n", n), ("e", e))], F.max(F.when(F.col("order") == 0, F.coalesce("begun", F.lit(0)))).alias("begun"))
    p1 = (F.col("e1") + 0.02) / (F.col("n1") + 1.0)
    p2 = (F.col("e2") + 2 * p1) / (F.col("n2") + 2.0)
    p3 = (F.col("e3") + 2 * p2) / (F.col("n3") + 2.0)
    piece = (F.col("e1") == F.col("n1")) & (F.col("begun") >= 10 * F.greatest(F.col("n1") + F.col("own"), F.lit(1)))
    cut = wide.filter(((p3 < s.ends) & ((F.col("n1") > 0) | (F.col("begun") > 0))) | piece).select("query_id", F.lit("truncated").alias("defect"))
    # forms that deny and only ever stand alone
    forms = found.filter("defect = 'form'").select("query_id", F.col("tail")[0].alias("form"), (F.col("own") % 2).alias("alone"), (F.col("own") >= 2).alias("known"))
    share = forms.agg((F.sum("alone") / F.count("*")).alias("usual"))
    lone = forms.groupBy("form").agg(F.count("*").alias("n"), F.sum("alone").alias("k")).filter("n = k").crossJoin(F.broadcast(share))  # one row
    lone = lone.filter(-2 * F.col("n") * F.log(F.greatest(F.least(F.col("usual"), F.lit(0.5)), F.lit(0.01))) >= s.alone).select("form")
    learned = forms.filter("alone = 1 and not known").join(lone, "form", "left_semi").select("query_id", F.lit("refusal").alias("defect"))
    plain = found.filter("defect not in ('?', 'form')").select("query_id", "defect")
    return plain.unionByName(cut).unionByName(learned).distinct()


def _found(spark: SparkSession, folder: str) -> DataFrame:
    generations = load(spark, folder, "rag_generations").select("query_id", "query_text", "claims_json", "answer")
    labelled = load(spark, folder, "eval_passages").select("lang", F.col("passage").alias("text")).unionByName(load(spark, folder, "documents").select("lang", "text"))
    return find_defects(generations, labelled)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every defective pair with its defects."""
    return _found(spark, folder)


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Defective pairs per context bucket and defect."""
    bucket = load(spark, folder, "rag_generations").groupBy("query_id").agg(F.min("bucket").alias("bucket"))
    return _found(spark, folder).join(bucket, "query_id").groupBy("bucket", "defect").agg(F.count("*").alias("n_pairs"))


QUERIES = {"p3_found": p3_found, "p3_counts": p3_counts}
SQL: dict[str, str] = {}
