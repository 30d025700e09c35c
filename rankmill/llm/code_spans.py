"""Where a body shows code, in any of the markups it may be written in."""

from __future__ import annotations

import re

_BLOCKS = re.compile(
    r"<pre\b.*?(?:</pre\s*>|\Z)|<(code|tt|samp|script|style|syntaxhighlight|source|nowiki|math)\b[^<>]*>.*?(?:</\1\s*>|(?=\n\s*\n)|\Z)"
    r"|^(?P<f>```+|~~~+)[^\n`]*\n.*?(?:^(?P=f)[`~]*[ \t]*$|\Z)"
    r"|\\begin\{(?P<e>verbatim\*?|lstlisting|minted|Verbatim|alltt)\}.*?(?:\\end\{(?P=e)\}|\Z)"
    r"|\\(?:verb\*?|lstinline)(?P<d>[^\w\s*{]).*?(?P=d)"
    r"|\{\{(?:code|source|pre|nowiki)\|(?:[^{}]|\{[^{}]*\}|\{\{[^{}]*\}\})*\}\}"
    r"|(?<![`\w])(?P<t>`+)(?!`)[^\n]*?(?<!`)(?P=t)(?!`)",
    re.S | re.M | re.I,
)
_INDENTED = re.compile(r"(?:\A|\n[ \t]*\n)((?:(?: {4}|\t)[^\n]*(?:\n[ \t]*)*(?:\n|\Z))+)")
#: A line of bare code: a prompt, a statement, or a quoted literal that is operated on.
_LINE = re.compile(
    r"^(?:[ \t]+\S.*|>>> .*|\.\.\. .*|(?:def|class|for|while|if|with|elif|except|try|else|return|import|from|assert|print|raise|lambda|async|await)\b.*[:(='].*|from \w+ import .*|import [\w.]+"
    r"|[\w.\[\]']+ (?:[-+*/]?=) .*|['\"][^'\"\n]*['\"] (?:in|==|\+|%) .*|['\"][^'\"\n]*['\"]\.\w+\([^()\n]*\)|\{['\"].*\}|@\w+.*|#[^#\n]*|[\w.]+\([^()\n]*\))$",
    re.M,
)


def marked_code(body: str) -> list[tuple[int, int]]:
    """Spans that markup declares as code, ascending and apart."""
    spans = [m.span() for m in _BLOCKS.finditer(body)] if any(c in body for c in "<`~\\{") else []
    if "    " in body or "\t" in body:
        spans += [m.span(1) for m in _INDENTED.finditer(body)]
    return _union(spans)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    spans.sort()
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        elif b > a:
            out.append((a, b))
    return out


_CALL = re.compile(r"\S\(")
_REMARK = re.compile(r"\)\s+# ")


def _is_line(line: str) -> bool:
    """Whether a line is code by its form, or a call with a remark after it."""
    if _LINE.match(line):
        return True
    call = _CALL.search(line)
    return bool(call) and any(m.start() > call.start() for m in _REMARK.finditer(line, call.end()))


def _is_code(block: str) -> bool:
    if "(" not in block and "=" not in block and "'" not in block and '"' not in block and "#" not in block and "import" not in block:
        return False
    lines = [x for x in block.split("\n") if x.strip()]
    return bool(lines) and _is_line(lines[0]) and not lines[0].startswith((" ", "\t")) and all(_is_line(x) for x in lines)


def bare_code(body: str) -> list[tuple[int, int]]:
    """Spans of paragraphs all of whose lines are code without any markup around."""
    out, at = [], 0
    for p in re.split(r"(\r?\n[ \t]*\r?\n)", body):
        if p.strip() and _is_code(p.replace("\r", "")):
            out.append((at, at + len(p)))
        at += len(p)
    return out


def code_spans(body: str) -> list[tuple[int, int]]:
    return _union(marked_code(body) + bare_code(body))


def without(body: str, spans: list[tuple[int, int]], fill: str = " ") -> str:
    """The body with spans blanked, offsets kept."""
    if not spans:
        return body
    out, at = [], 0
    for a, b in spans:
        out += [body[at:a], fill * (b - a)]
        at = b
    return "".join([*out, body[at:]])
