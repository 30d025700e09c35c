r"""Markup residue: which kinds a body holds, and its clean text.

Kinds.  Every candidate sign (a tag, an entity, emphasis, a link, a template, a
command, a formula, a list bullet) is a node of a graph.  A classifier of the
sign's own form gives the costs of calling it markup or a literal character;
neighbouring signs of one kind are tied by smoothness edges, and the minimum cut
labels all of them at once.  So a lone asterisk bullet is a plain list, while
between wiki links it is wiki markup.  Signs inside code are not candidates; the
delimiters of the code are.

Clean text.  A body is cut into blocks.  Text length, link density, comments,
templates and stock phrases give each block its costs of being content or
boilerplate; blocks next to each other and blocks under one parent are tied, and
the minimum cut separates the two.  Content is written out with headings as
``#`` lines, list items as ``- `` or ``1. ``, code in fences, formulas between
dollar signs.

Defined cases: NULL and blank bodies hold nothing and become the empty text;
unclosed tags, fences and environments end with the body; rows repeated under
one id are reported once per kind; NULL ids are skipped; empty tables give no
rows; bodies of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.llm.code_spans import bare_code, marked_code, without
from rankmill.llm.mincut import min_cut
from rankmill.session import Scratch
from rankmill.sources.tables import load

TAGS = (
    "a abbr acronym address area article aside audio b base big blockquote body br button canvas caption center cite code col colgroup dd del details dfn div dl dt em embed "
    "fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark meta nav noscript object ol "
    "option p param picture pre q s samp script section select small source span strike strong style sub summary sup svg table tbody td textarea tfoot th thead time title tr tt u ul var video"
).split()
#: LaTeX commands that take no argument.
BARE = "item LaTeX TeX ldots dots par noindent newline newpage clearpage maketitle tableofcontents hline quad qquad bigskip medskip smallskip centering hfill vfill appendix alpha beta gamma delta lambda mu pi sigma theta sum int prod leq geq neq infty times cdot to in".split()

_HTML = re.compile(r"</?(?:%s)(?=[\s/>])[^<>]*>|<!--.*?(?:-->|\Z)|<!DOCTYPE[^>]*>|(&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});)" % "|".join(TAGS), re.S | re.I)
_WIKI = re.compile(
    r"(?<![\w'])'{2,3}(?=[^\s'])[^'\n]+(?:'(?!')[^'\n]+)*'{2,3}(?!')|\[\[[A-Za-z_:#][^\[\]\n]*\]\]|\{\{\s*[A-Za-z][\w \-]*(?:\|[^{}]*(?:\{[^{}]*\}[^{}]*)*)?\}\}"
    r"|^(={2,6})[^=\n].*?\1[ \t]*\r?$|\[https?://\S+ [^\]\n]+\]|</?(?:ref|nowiki|references|gallery|syntaxhighlight)\b[^<>]*>|^\{\|.*$|^\|-[ \t]*\r?$|__(?:TOC|NOTOC|NOEDITSECTION)__|(?<!~)~{4}(?!~)", re.M)
#: Markdown signs, each with what a body must have for it to be worth looking for.
_MD = tuple((guard, re.compile(p, re.M)) for guard, p in (
    (("#",), r"^#{2,6}[ \t]+\S"),
    (("---", "===", "***", "___"), r"^[^\s\-=][^\n]*\r?\n(?:={3,}|-{3,})[ \t]*\r?$|^(?:-{3}|\*{3,}|_{3,})[ \t]*\r?$|^\|?[ \t]*:?-{3,}:?[ \t]*\|[-:| \t]*\r?$"),
    (("*",), r"(?<![\w*\\])(\*{1,3})(?=[^\s*])[^*\n]+?(?<=[^\s*])\1(?![\w*])"),
    (("__",), r"(?<!\w)__(?=[^\s_])[^_\n]+ [^_\n]+(?<=\S)__(?!\w)"),
    (("_ ", "_.", "_,", "_\n", "_)", "_?", "_!"), r"(?<!\w)_(?=[A-Za-z])[^_\n]+[A-Za-z.!?]_(?!\w)"),
    (("](",), r"!\[[^\]\n]*\]\([^()\s]+[^()\n]*\)|(?<!\w)\[[^\[\]\n]+\]\([^()\s]+(?:[ \t]+\"[^\"\n]*\")?\)"),
    (("]:",), r"^\[[^\]\n]+\]:[ \t]*\S+"),
    (("<http",), r"<https?://[^<>\s]+>"),
    ((">",), r"^>(?!>)[ \t]?\S"),
    (("~~",), r"~~(?=\S)[^~\n]+(?<=\S)~~"),
))
_INLINE = re.compile(r"(?<![\\$\w])\$(?![\s$])([^$\n]+?)(?<![\s\\])\$(?![\d$])")
_DELIMITERS = (("$$", "$$"), ("\\[", "\\]"), ("\\(", "\\)"))
_MATH = re.compile(r"\\[A-Za-z]+|[\^=<>|]|_[A-Za-z0-9{]|[A-Za-z0-9)]\s*[-+*/]\s*[A-Za-z0-9(]|^[A-Za-z]$|\([A-Za-z0-9]+\)")
_COMMAND = re.compile(r"\\(?:[A-Za-z]+\*?(?=[\[{])|(?:%s)(?![A-Za-z\\]))" % "|".join(BARE))
_WEAK = {
    "wiki": re.compile(r"^(?:[*#:;]+)[ \t]+\S", re.M),
    "markdown": re.compile(r"^[ \t]{0,3}(?:([-+])|(\*)|\d{1,3}[.)])[ \t]+\S|^(#)[ \t]+\S", re.M),
    "escapes": re.compile(r"(?<![\w:\\])\\[_%&#${}]"),
}
#: Costs (as markup, as a literal) of signs that are clear by form, and of those that plain text has too.
CLEAR, FAINT, HALF = (0.1, 3.0), (1.2, 0.9), (0.8, 1.0)
#: Ids with repeated rows up to which they are broadcast.
REPEATED = 1_000_000
#: What ties a sign to the next of its kind.
TIE = 0.7


def code_marks(body: str, spans: list[tuple[int, int]]) -> Iterator[tuple[int, str, tuple[float, float]]]:
    """The kind that each span of marked code is delimited by."""
    for a, b in spans:
        s = body[a : a + 24].lower()
        if s.startswith("<"):
            yield a, "wiki" if re.match(r"<(?:syntaxhighlight|source|nowiki|math)", s) else "html", CLEAR
            if s.startswith("<math"):
                yield a, "latex", CLEAR
        elif s.startswith("\\"):
            yield a, "latex", CLEAR
        elif s.startswith("{{"):
            yield a, "wiki", CLEAR
        elif s.startswith(("`", "~")):
            yield a, "markdown", CLEAR
        else:  # indented
            yield a, "markdown", HALF


def formulas(text: str) -> list[tuple[int, int, str]]:
    """Delimited formulas as (start, end, inner text), ascending and apart; one pass per kind of delimiter, whatever is left open."""
    found = []
    for opener, closer in _DELIMITERS:
        at = text.find(opener)
        while at >= 0:
            end = text.find(closer, at + 2)
            if end < 0:
                break
            inner = text[at + 2 : end]
            if inner.strip():
                found.append((at, end + 2, inner))
                at = text.find(opener, end + 2)
            else:  # the second sign may open
                at = text.find(opener, at + 2)
    if "$" in text:
        found += [(m.start(), m.end(), m.group(1)) for m in _INLINE.finditer(text)]
    found.sort()
    out: list[tuple[int, int, str]] = []
    for a, b, inner in found:
        if not out or a >= out[-1][1]:
            out.append((a, b, inner))
    return out


def candidates(body: str) -> list[tuple[int, str, tuple[float, float]]]:
    """``(offset, kind, costs)`` of every sign outside code that may be markup."""
    spans = marked_code(body)
    out = list(code_marks(body, spans))
    text = without(body, spans)
    text = without(text, bare_code(text))
    if "<" in text or "&" in text:
        for m in _HTML.finditer(text):
            if m.group(1) is None or m.group(1)[1] == "#" or m.group(1)[1:] in html5:
                out.append((m.start(), "html", CLEAR))
    if any(c in text for c in ("''", "[[", "{{", "==", "[http", "<", "{|", "|-", "__", "~~~~")):
        out += [(m.start(), "wiki", CLEAR) for m in _WIKI.finditer(text)]
    for guard, p in _MD:
        if any(g in text for g in guard):
            out += [(m.start(), "markdown", CLEAR) for m in p.finditer(text)]
    if "\\" in text or "$" in text:
        for a, _, inner in formulas(text):
            if "\n\n" not in inner and _MATH.search(inner.strip()):
                out.append((a, "latex", CLEAR))
        out += [(m.start(), "latex", CLEAR) for m in _COMMAND.finditer(text)]
    if not {line[:1] for line in text.split("\n")}.isdisjoint("-+*#:;0123456789 \t"):
        clear = {kind for _, kind, _ in out}
        wiki, own = list(_WEAK["wiki"].finditer(text)), list(_WEAK["markdown"].finditer(text))
        dashes = any(not m.group(2) for m in own)
        stars = sum(bool(m.group(2)) for m in own)
        hashes = bool(re.search(r"^#[ \t]+\S.*\n#[ \t]+\S", text, re.M))  # a numbered list, not two headings
        if "wiki" in clear or (hashes or not dashes and stars > 2) and "markdown" not in clear:  # bullets of both kinds are stars
            out += [(m.start(), "wiki", FAINT if "wiki" in clear else HALF) for m in wiki]
            own = [m for m in own if not m.group(2) and not m.group(3)]
        out += [(m.start(), "markdown", HALF if len(own) > 1 and not m.group(3) else FAINT) for m in own]
    if "\\" in text:
        out += [(m.start(), "latex", FAINT) for m in _WEAK["escapes"].finditer(text)]
    out.sort(key=lambda x: (x[0], x[1]))
    return out


def kinds(body: str | None) -> list[str]:
    """The kinds of markup a body holds."""
    if not body:
        return []
    marks = candidates(body)
    if not marks:
        return []
    last: dict[str, int] = {}
    edges = []
    for i, (_, kind, _) in enumerate(marks):
        if kind in last:
            edges.append((last[kind], i, TIE))
        last[kind] = i
    labels = min_cut([c[0] for *_, c in marks], [c[1] for *_, c in marks], edges)
    return sorted({kind for (_, kind, _), yes in zip(marks, labels, strict=True) if yes})


# --- clean text ---

_BLOCK = {"p", "div", "section", "article", "header", "footer", "nav", "aside", "main", "table", "tr", "figure", "address", "form", "dl", "dt", "dd", "body", "html", "ul", "ol", "blockquote", "center", "details", "summary"}
_SKIP = {"script", "style", "head", "title", "template", "noscript", "svg"}
_STOCK = re.compile(r"^\W*(?:edited|edit|stub|thanks?(?: (?:in advance|& bye|and bye|a lot))?|advertisement|share|reply|back to top|read more|click here|all rights reserved|cookies?)\W*$", re.I)


class _Blocks(HTMLParser):
    """Blocks of an HTML body: (kind, text, path of open block tags, characters inside links)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str, tuple, int]] = []
        self.parts: list[str] = []
        self.path: list[str] = []
        self.lists: list[list] = []
        self.pre = self.skip = self.link = self.linked = 0
        self.kind = "text"

    def flush(self) -> None:
        text = "".join(self.parts)
        text = text.strip("\n") if self.pre or self.kind == "code" else re.sub(r"[ \t\r\f\v]*\n\s*", "\n", re.sub(r"[^\S\n]+", " ", text)).strip()
        if text.strip():
            self.out.append((self.kind, text, tuple(self.path), self.linked))
        self.parts, self.linked, self.kind = [], 0, "text"

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SKIP:
            self.skip += 1
        elif tag == "pre":
            self.flush()
            self.pre += 1
            self.kind = "code"
        elif re.fullmatch(r"h[1-6]", tag):
            self.flush()
            self.kind = "#" * int(tag[1])
        elif tag == "li":
            self.flush()
            if self.lists:
                self.lists[-1][1] += 1
            self.kind = f"{self.lists[-1][1]}." if self.lists and self.lists[-1][0] == "ol" else "-"
        elif tag == "br":
            self.parts.append("\n")
        elif tag == "hr":
            self.flush()
        elif tag == "a":
            self.link += 1
        elif tag in ("code", "kbd", "tt", "samp") and not self.pre:
            self.parts.append("`")
        elif tag in ("td", "th"):
            self.parts.append(" | ")
        elif tag in _BLOCK:
            if not (tag == "p" and self.kind not in ("text", "code") and not self.parts):
                self.flush()
            self.path.append(tag)
            if tag in ("ul", "ol"):
                self.lists.append([tag, 0])

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "pre" and self.pre:
            self.flush()
            self.pre -= 1
        elif tag == "a":
            self.link = max(0, self.link - 1)
        elif tag in ("code", "kbd", "tt", "samp") and not self.pre:
            self.parts.append("`")
        elif tag in _BLOCK or tag == "li" or re.fullmatch(r"h[1-6]", tag):
            self.flush()
            if tag in self.path:
                del self.path[len(self.path) - 1 - self.path[::-1].index(tag) :]
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.parts.append(data)
            if self.link:
                self.linked += len(data.strip())

    def handle_comment(self, data: str) -> None:
        if data.strip():
            self.flush()
            self.out.append(("comment", data.strip(), tuple(self.path), 0))


def _inline(text: str, held: list[str]) -> str:
    text = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([A-Za-z_:#][^\[\]|\n]*)\]\]", r"\1", text) if "wiki" in held else text
    if "wiki" in held:
        text = re.sub(r"\{\{(?:tl|code|quote)\|((?:[^{}]|\{[^{}]*\})*)\}\}", r"\1", text)
        text = re.sub(r"'{2,3}(?=[^\s'])([^'\n]+(?:'(?!')[^'\n]+)*)'{2,3}", r"\1", text)
        text = re.sub(r"\[https?://\S+ ([^\]\n]+)\]", r"\1", text)
    if "markdown" in held:
        text = re.sub(r"!?\[([^\[\]\n]*)\]\([^()\s]+(?:[ \t]+\"[^\"\n]*\")?\)", r"\1", text)
        text = re.sub(r"(?<![\w*\\])(\*{1,3})(?=[^\s*])([^*\n]+?)(?<=[^\s*])\1(?![\w*])", r"\2", text)
        text = re.sub(r"~~(?=\S)([^~\n]+)~~", r"\1", text)
    if "latex" in held:
        text = re.sub(r"\\(?:texttt|textbf|textit|emph|underline|textsc|url|footnote|ref|cite|label)\{((?:[^{}]|\\[{}])*)\}", r"\1", text)
        parts, at = [], 0
        for a, b, inner in formulas(text):
            sign = "$$" if text[a : a + 2] in ("$$", "\\[") else "$"
            parts += [text[at:a], sign, inner, sign]
            at = b
        text = "".join([*parts, text[at:]])
        text = re.sub(r"\\verb\*?([^\w\s*{])(.*?)\1", r"`\2`", text)
        text = re.sub(r"\\([_%&#{}])", r"\1", text)
    return text


def _plain_blocks(text: str, held: list[str]) -> Iterator[tuple[str, str]]:
    """Blocks of a body in markup by lines: headings, items, code, paragraphs."""
    spans = [(a, b) for a, b in marked_code(text) if "\n" in text[a:b] or text[a : a + 2] == "{{"]
    at = 0
    for a, b in [*spans, (len(text), len(text))]:
        for block in re.split(r"\r?\n[ \t]*\r?\n", text[at:a]):
            heading = re.match(r"\s*(?:(#{1,6})[ \t]+(.+)|(={2,6})[ \t]*(.+?)[ \t]*={2,6}\s*$|\\((?:sub)*)section\*?\{(.*)\}\s*$)", block)
            setext = re.match(r"\s*([^\n]+)\n(=|-)\2{2,}\s*$", block)
            if heading and "\n" not in block.strip():
                g = heading.groups()
                level = len(g[0] or "") or len(g[2] or "") or 1 + len(g[4] or "") // 3
                yield "#" * level, _inline(g[1] or g[3] or g[5] or "", held)
            elif setext and "markdown" in held:
                yield "#" if setext.group(2) == "=" else "##", _inline(setext.group(1), held)
            else:
                block = re.sub(r"\\(?:begin|end)\{(?:itemize|enumerate|quote|center|document|equation\*?|align\*?)\}", "", block)
                para: list[str] = []
                for line in block.split("\n"):
                    item = re.match(r"\s*(?:([-+*•]|[*#:;]+)|(\d{1,3})[.)]|(\\item))[ \t]+(.*)", line)
                    if item:
                        if para:
                            yield "text", _inline("\n".join(para), held)
                            para = []
                        yield f"{item.group(2)}." if item.group(2) else "-", _inline(item.group(4), held)
                    elif not re.fullmatch(r"\s*(?:-{3,}|\*{3,}|_{3,})\s*", line):
                        para.append(re.sub(r"^>[ \t]?", "", line) if "markdown" in held else line)
                if "".join(para).strip():
                    yield "text", _inline("\n".join(para).strip(), held)
        if b > a:
            code = text[a:b]
            code = re.sub(r"\A(?:```+|~~~+)[^\n]*\n|\n?(?:```+|~~~+)\s*\Z|\A\\begin\{[^}]*\}(?:\[[^\]]*\])?\n?|\n?\\end\{[^}]*\}\Z|\A\{\{\w+\||\}\}\Z|\A<\w+[^>]*>|</\w+>\Z", "", code)
            yield "code", code
        at = b


def blocks(body: str, held: list[str]) -> list[tuple[str, str, tuple, int]]:
    if "html" in held and re.search(r"<[A-Za-z/!]", body):
        p = _Blocks()
        p.feed(body)
        p.close()
        p.flush()
        rest = [k for k in held if k != "html"]
        if not rest:
            return p.out
        out = []
        for kind, text, path, linked in p.out:
            if kind == "text":
                out += [(k, t, path, linked) for k, t in _plain_blocks(text, rest)]
            else:
                out.append((kind, text if kind == "code" else _inline(text, rest), path, linked))
        return out
    text = unescape(body) if "html" in held else body
    return [(k, t, (), 0) for k, t in _plain_blocks(text, held)]


def is_content(parts: list[tuple[str, str, tuple, int]]) -> list[bool]:
    """Content (true) or boilerplate, by minimum cut over adjacency and DOM proximity.

    Blocks next to each other are tied, the more so the more open tags they share;
    and a block is tied to the last one under the same parent, however much of
    another branch lies in between.
    """
    content, boiler, edges, last = [], [], [], {}
    for i, (kind, text, path, linked) in enumerate(parts):
        n = len(text)
        words = len(text.split())
        c = 0.2
        b = min(3.0, 0.4 + 0.15 * words) + (2.0 if kind in ("code", "#", "##", "###") or "$" in text else 0.0) + (0.5 if re.search(r"[.!?]\s*$", text) else 0.0)
        c += 2.5 * linked / max(n, 1) * (words > 2) + (6.0 if kind == "comment" else 0.0)
        c += 4.0 if _STOCK.match(text) or re.match(r"\W*(?:\[\[)?Category:|\W*\{\{\s*\w+\s*\}\}\W*$", text) else 0.0
        c += 3.0 if not re.search(r"\w", text) else 0.0
        if "nav" in path or "footer" in path or "aside" in path:
            c += 3.0
        content.append(c)
        boiler.append(b)
        if i:
            before = parts[i - 1][2]
            shared = next((k for k, (x, y) in enumerate(zip(before, path, strict=False)) if x != y), min(len(before), len(path)))
            edges.append((i - 1, i, 0.15 + 0.15 * (shared + 1) / (max(len(before), len(path)) + 1)))
            if last.get(path, i - 1) != i - 1:
                edges.append((last[path], i, 0.15))
        last[path] = i
    return min_cut(content, boiler, edges)


def clean(body: str | None) -> str:
    """Clean text that keeps headings, lists, code and formulas."""
    if not body or not body.strip():
        return ""
    held = kinds(body)
    parts = blocks(body, held)
    out = []
    for (kind, text, *_), keep in zip(parts, is_content(parts), strict=True):
        if not keep:
            continue
        item = kind == "-" or kind[:-1].isdigit()
        if kind == "code":
            piece = f"```\n{text.strip(chr(10))}\n```"
        elif kind in ("text", "comment"):
            piece = text
        else:
            piece = f"{kind} {text}"
        out.append((item, piece))
    text = ""
    for i, (item, piece) in enumerate(out):
        text += ("" if i == 0 else "\n" if item and out[i - 1][0] else "\n\n") + piece
    return text


def _bodies(spark: SparkSession, folder: str) -> DataFrame:
    def one(table: str) -> DataFrame:
        return load(spark, folder, table).filter("id is not null and body is not null").select(F.lit(table).alias("table_name"), F.col("id").cast("long").alias("record_id"), "body")

    return reduce(DataFrame.unionByName, map(one, ("questions", "answers")))


def find_markup(bodies: DataFrame) -> DataFrame:
    """``(table_name, record_id, markup)``: one row per body and kind."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(t, i, k) for t, i, b in zip(pdf["table_name"], pdf["record_id"], pdf["body"], strict=True) for k in kinds(b)]
            yield pd.DataFrame(rows, columns=["table_name", "record_id", "markup"])

    return bodies.mapInPandas(run, "table_name string, record_id long, markup string").distinct()


def clean_bodies(bodies: DataFrame) -> DataFrame:
    """``(table_name, record_id, clean_text)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["table_name", "record_id"]].assign(clean_text=[clean(b) for b in pdf["body"]])

    # rows repeated under one id are found by id and hash, and only those are shuffled before they are cleaned
    again = Scratch(bodies.sparkSession, "bodies").write(bodies.groupBy("table_name", "record_id").agg(F.count("*").alias("n")).filter("n > 1").select("table_name", "record_id"))
    few = F.broadcast(again) if again.count() <= REPEATED else again
    keys = ["table_name", "record_id"]
    cleaned = lambda df: df.mapInPandas(run, "table_name string, record_id long, clean_text string")
    return cleaned(bodies.join(few, keys, "left_anti")).unionByName(cleaned(bodies.join(few, keys, "left_semi").distinct()).distinct())


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The kinds of markup that each body holds."""
    return find_markup(_bodies(spark, folder))


def p5_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Every body as clean text with its structure kept."""
    return clean_bodies(_bodies(spark, folder))


QUERIES = {"p5_found": p5_found, "p5_clean": p5_clean}
SQL: dict[str, str] = {}
