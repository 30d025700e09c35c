"""Text expressions that stay inside the JVM, and an Arrow function where Catalyst has none."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as a compound term, and how it falls into parts.
CHUNK = r"[A-Za-z0-9]+(?:[._][A-Za-z0-9]+)*"
PARTS = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
BASIC = r"[a-z0-9]+"


def tokenize(col: Column | str, mode: str = "code") -> Column:
    """Terms of a text, with repeats.

    ``code``: parts of identifiers (split at dots, underscores and case changes,
    numbers dropped), followed by the identifier itself if it has several parts.
    ``basic``: lower-case runs of letters and digits.  NULL gives no terms.
    """
    text = F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
    if mode == "basic":
        return F.regexp_extract_all(F.lower(text), F.lit(BASIC), F.lit(0))
    if mode != "code":
        raise ValueError(f"unknown tokenizer mode {mode!r}")

    def terms(chunk: Column) -> Column:
        parts = F.flatten(F.transform(F.split(chunk, "[._]"), lambda s: F.regexp_extract_all(s, F.lit(PARTS), F.lit(0))))
        kept = F.filter(F.transform(parts, F.lower), lambda t: ~t.rlike("^[0-9]+$"))
        several = chunk.rlike("[._]") | (F.size(parts) > 1)
        whole = F.when(several & chunk.rlike("[A-Za-z]"), F.array(F.lower(chunk))).otherwise(F.array().cast("array<string>"))
        return F.concat(kept, whole)

    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0)), terms))


def term_bag(col: Column | str, mode: str = "code") -> Column:
    """The same terms as ``tokenize``, as a bag: parts first, compounds after.

    The parts of all identifiers come from one match over the whole text, since
    no part spans a separator, so nothing is done per identifier.
    """
    if mode != "code":
        return tokenize(col, mode)
    text = F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
    parts = F.filter(F.regexp_extract_all(text, F.lit(PARTS), F.lit(0)), lambda t: t > ":")  # digits sort before, letters after
    whole = F.filter(F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0)), lambda c: ~c.rlike("^(?:[A-Z]?[a-z]+|[A-Z]+|[0-9._]+)$"))
    return F.transform(F.concat(parts, whole), F.lower)


def has_tag(tags: Column | str, *any_of: str) -> Column:
    """Whether a list of the form ``|a|b|`` holds one of the tags, whatever its case."""
    low = F.lower(F.col(tags) if isinstance(tags, str) else tags)
    out = low.contains(f"|{any_of[0].lower()}|")
    for t in any_of[1:]:
        out = out | low.contains(f"|{t.lower()}|")
    return out


def preview(col: Column, limit: int = 700) -> Column:
    """The first characters and how many more there are."""
    more = F.length(col) - limit
    return F.when(more > 0, F.concat(F.substring(col, 1, limit), F.lit(" ["), more.cast("string"), F.lit(" more chars]"))).otherwise(col)


def snippet(col: Column, limit: int = 180) -> Column:
    """White space collapsed, cut to ``limit`` characters."""
    return F.substring(F.trim(F.regexp_replace(col, r"\s+", " ")), 1, limit)


def short_title(col: Column, limit: int = 40) -> Column:
    return F.when(F.length(col) > limit, F.concat(F.substring(col, 1, limit), F.lit("..."))).otherwise(col)


def basename(col: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.regexp_extract(col, r"([^/\\]*)$", 1)


def human_bytes(col: Column) -> Column:
    """Sizes as ``12.3 MB``, in powers of 1024."""
    out = F.format_string("%.0f B", col.cast("double"))
    for k, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        out = F.when(col >= 1024**k, F.format_string(f"%.1f {unit}", col / float(1024**k))).otherwise(out)
    return out


def short_count(col: Column) -> Column:
    """Token counts in units of 1024 from there on, as ``8K``; NULL stays NULL."""
    return F.when(col >= 1024, F.concat(F.floor(col / 1024.0 + 0.5).cast("string"), F.lit("K"))).otherwise(col.cast("string"))


def fill_ratio(used: Column, total: Column) -> Column:
    """Used over total, between 0 and 1; NULL without a total."""
    return F.when(total > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), used / total)))


def clamp(col: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def answer_url(doc_id: Column, base: str) -> Column:
    """A document's address below ``base``."""
    return F.concat(F.lit(base), doc_id.cast("string"))


def escape_stray_ampersands(col: Column | str) -> Column:
    """Ampersands that begin no character reference with a final semicolon become references themselves.

    The text is taken apart at its ampersands; each piece shows by its beginning
    whether the sign before it was meant.
    """
    pieces = F.split(F.col(col) if isinstance(col, str) else col, "&", -1)
    sign = lambda p: F.when(p.rlike("^(#[0-9]+|#x[0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);"), "&").otherwise("&amp;")
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(sign(p), p))), "")


def unescape_bytes(col: Column | str) -> Column:
    r"""Literal ``\xHH`` sequences as the UTF-8 bytes they stand for, inside the JVM.

    A text with such a sequence is one of bytes: its other characters count as
    Latin-1, those beyond U+00FF are left out, and what is no UTF-8 in the end
    becomes replacement characters.  Other texts stay as they are.
    """
    text = F.col(col) if isinstance(col, str) else col
    narrow = F.regexp_replace(text, r"[^\x{00}-\x{FF}]", "")
    pieces = F.split(narrow, r"\\x(?=[0-9A-Fa-f]{2})", -1)
    latin = lambda s: F.encode(s, "ISO-8859-1")
    raw = F.transform(pieces, lambda p, i: F.when(i == 0, latin(p)).otherwise(F.concat(F.unhex(F.substring(p, 1, 2)), latin(F.substr(p, F.lit(3))))))
    whole = F.make_valid_utf8(F.aggregate(raw, F.lit("").cast("binary"), lambda a, p: F.concat(a, p)).cast("string"))
    return F.when(text.contains("\\x"), whole).otherwise(text)


@F.pandas_udf(T.StringType())
def unescape_entities(s: pd.Series) -> pd.Series:
    """Character references decoded."""
    return s.map(html.unescape, na_action="ignore")
