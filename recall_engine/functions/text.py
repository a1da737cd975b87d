"""Scalar text functions, as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F



def _folded(c: str) -> str:
    """A lower-case letter without its accent: Latin letters with one mark lose it, and letters that differ only in their
    form are one."""
    low = c.casefold() if len(c.casefold()) == 1 else c
    parts = unicodedata.normalize("NFD", low)
    return parts[0] if len(parts) == 2 and parts[0].isascii() and parts[0].isalpha() and unicodedata.combining(parts[1]) else low


def _foldings() -> tuple[str, str]:
    """Letters that fold to another, then the marks that fold to nothing; and what the letters fold to."""
    letters = [c for c in map(chr, range(0x80, 0x2000)) if c.lower() == c and _folded(c) != c]
    marks = sorted({d[1] for d in (unicodedata.normalize("NFD", c) for c in letters) if len(d) == 2 and d[0].isascii()})
    return "".join([*letters, *marks]), "".join(map(_folded, letters))


ACCENTED, FOLDED = _foldings()
WORD = r"[\p{L}\p{N}\p{Co}_\-#@]+"


def fold(c: Column) -> Column:
    """Lower case without accents, whether they are part of a letter or stand after it; texts of ASCII alone have none."""
    low = F.lower(c)
    return F.when(F.octet_length(c) == F.char_length(c), low).otherwise(F.translate(low, ACCENTED, FOLDED))


def words(c: Column) -> Column:
    """Letters, digits and ``_ - # @`` in runs, folded."""
    return F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))


def budget_chars(c: Column) -> Column:
    """Code points."""
    return F.char_length(F.coalesce(c, F.lit("")))


def snippet(c: Column, most: int = 200) -> Column:
    """The first code points, without line feeds at the end."""
    return F.regexp_replace(F.left(F.coalesce(c, F.lit("")), F.lit(most)), r"\n+\z", "")


def quote_lines(c: Column, prefix: str = "> ") -> Column:
    """Each line with a prefix and a line feed; nothing for an empty text."""
    lines = F.transform(F.split(c, "\n", -1), lambda x: F.concat(F.lit(prefix), x, F.lit("\n")))
    return F.when(c == "", F.lit("")).otherwise(F.array_join(lines, ""))


def first_lines(c: Column, n: int = 3) -> Column:
    return F.array_join(F.slice(F.split(c, "\n", -1), 1, n), "\n")


def sanitize(c: Column) -> Column:
    """Anything but a-z, 0-9, / _ - becomes _; an empty text becomes -."""
    out = F.regexp_replace(c, "[^a-z0-9/_-]", "_")
    return F.when(out == "", F.lit("-")).otherwise(out)


def topic_name_ok(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\A[a-z0-9][a-z0-9/_-]*\z"), F.lit(False))


def topic_from(c: Column) -> Column:
    """A topic name from any text: lower case, dashes for what may not be in one, no marks at the ends, x before what may
    not begin one."""
    dashed = F.btrim(F.regexp_replace(F.replace(F.lower(c), F.lit(" "), F.lit("-")), "[^a-z0-9/_-]+", "-"), F.lit("/-_"))
    return F.when(dashed.rlike(r"\A[a-z0-9]"), dashed).otherwise(F.concat(F.lit("x"), dashed))


def ancestors(path: Column) -> Column:
    """The topics of a file's folders, outermost first: a/b/c.md gives a and a/b."""
    parts = F.split(path, "/", -1)
    depth = F.size(parts) - 1
    each = F.transform(F.sequence(F.lit(1), depth), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.when(depth < 1, F.array().cast("array<string>")).otherwise(F.array_distinct(each))


def proposed_topics(label: Column, path: Column) -> Column:
    """The topics of a file: the label of its tree, and the label with each of its folders."""
    return F.array_distinct(F.concat(F.array(topic_from(label)), F.transform(ancestors(path), lambda a: topic_from(F.concat(label, F.lit("/"), a)))))


def wiki_name(c: Column) -> Column:
    """What a link and a file's name are compared by: trimmed, dashes for spaces, lower case."""
    return F.lower(F.replace(F.trim(c), F.lit(" "), F.lit("-")))


def wiki_links(c: Column) -> Column:
    """Targets of [[target]] and [[target|shown]], by name, first occurrences in order."""
    raw = F.regexp_extract_all(c, F.lit(r"\[\[([^\[\]|]+)(?:\|[^\[\]]*)?\]\]"), F.lit(1))
    return F.array_distinct(F.transform(raw, wiki_name))


def normalise_newlines(c: Column) -> Column:
    """No byte-order mark, line feeds only."""
    return F.regexp_replace(F.regexp_replace(c, "\\A\ufeff", ""), "\r\n?", "\n")


def lead(c: Column, most: int) -> Column:
    """An extract from the start: whole if short, else back to the last full stop or line end in its second half; without
    white space at the ends."""
    blanks = F.lit(" \t\n\x0b\f\r")
    body = F.btrim(c, blanks)
    head = F.left(body, F.lit(most))
    cut = F.char_length(F.regexp_extract(head, r"(?s)\A(.*[.\n])", 1))
    return F.when(F.char_length(body) <= most, body).when(cut > most // 2, F.btrim(F.left(head, cut), blanks)).otherwise(F.btrim(head, blanks))


def slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, F.lit(one)).otherwise(F.lit(many)))


def split_terms(c: Column) -> Column:
    """The terms of a query: lower case, cut at anything but letters and digits, of two bytes or more, once each."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{Nd}]+", -1), lambda x: F.octet_length(x) >= 2))


def contains_all(text: Column, terms: Column) -> Column:
    return F.forall(terms, lambda t: F.contains(F.lower(text), t)) & (F.size(terms) > 0)


def contains_any(text: Column, terms: Column) -> Column:
    return F.exists(terms, lambda t: F.contains(F.lower(text), t))
