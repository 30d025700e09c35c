"""Plain text of HTML bodies, line structure kept.

Rules: character references are decoded; a break gives a newline; a newline
follows every block element where it closes; an end tag closes everything up to
its nearest open namesake and is ignored without one; elements left open close
at the end, innermost first; script, style and template content and comments
are left out; white space alone between tags shrinks to one blank or newline
outside pre; trailing blanks go, and at most one empty line stays.  Sections
that are no HTML are comments.  NULL gives the empty text.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankmill.functions.text import escape_stray_ampersands, unescape_bytes

# Elements that end a line.
BLOCK = frozenset("p div li ul ol pre blockquote table tr h1 h2 h3 h4 h5 h6 hr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template".split())


class _Lines(HTMLParser):
    """Writes a document out line by line: a line is trimmed when it ends, and an empty one is kept only after one that is not."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.line = ""
        self.open: list[str] = []

    def end_line(self) -> None:
        done = self.line.rstrip(" \t")
        if done or (self.lines and self.lines[-1]):
            self.lines.append(done)
        self.line = ""

    def leave(self) -> None:
        if self.open.pop() in BLOCK:
            self.end_line()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in VOID:
            self.open.append(tag)
        elif tag in ("br", "hr"):
            self.end_line()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.leave()

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            depth = len(self.open) - 1 - self.open[::-1].index(tag)
            while len(self.open) > depth:
                self.leave()

    def handle_data(self, data: str) -> None:
        if not HIDDEN.isdisjoint(self.open):
            return
        if data.isspace() and {"pre", "textarea"}.isdisjoint(self.open):
            data = "\n" if "\n" in data else " "
        *whole, rest = data.split("\n")
        for part in whole:
            self.line += part
            self.end_line()
        self.line += rest

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Sections of other kinds than HTML's are read as comments instead of failing."""
        return self.parse_bogus_comment(i, 0)

    def finish(self) -> str:
        self.close()
        while self.open:
            self.leave()
        return "\n".join([*self.lines, self.line]).strip()


def html_to_text(prepared: str | None) -> str:
    """Plain text of HTML in which every ampersand begins a reference."""
    if not prepared:
        return ""
    p = _Lines()
    p.feed(prepared)
    return p.finish()


@F.pandas_udf(T.StringType())
def _text_of(prepared: pd.Series) -> pd.Series:
    return prepared.map(html_to_text)


def clean_html(raw: Column | str) -> Column:
    """Plain text of HTML bodies: escaped bytes and stray ampersands are dealt with in the JVM, the parser runs in Arrow batches."""
    return _text_of(escape_stray_ampersands(unescape_bytes(raw)))
