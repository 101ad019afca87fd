"""Bibliographic and chapter rules, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.text import isbn13

# fixed values
FRONT = (
    r"(?i)^(cover|title( page)?|half[- ]title|copyright|dedication|epigraph|(table of )?contents|also by|other books by|praise( for)?"
    r"|foreword|list of (figures|tables|illustrations)|frontispiece|about the (book|ebook))\b"
)
BACK = (
    r"(?i)^((selected|further|recommended|suggested|additional|general|subject|name)\s+)?(acknowledge?ments?|notes|endnotes|bibliography"
    r"|references|sources|reading|index|about the (authors?|publisher)|appendix|glossary|permissions|credits"
    r"|(photo|illustration|image|art) credits|reading group guide|newsletters?|copyright|resources"
    r"|photo(graph)?s?( insert| section)?|insert|illustrations|plates)\b"
)
NUMBERING = r"^(?:(?i:chapter)\s+(?:[IVXLCivxlc]+|\d+)|\d+[a-z]?|[IVXLC]+(?=[.:)]))[.:)]?\s+"
PART = r"(?i)^(part|section|book)\s*([ivxlc]+|\d+|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)\b"
LIGATURES = ("ffi", "ffl", "ff", "fi", "fl")
EBOOK = r"(?i)e-?book|epub|e-?isbn|digital|kindle|electronic"
SYMBOLS = "@&%+=#<>^~|*$"


def plain(title: Column) -> Column:
    """A chapter title without its number, unless it is nothing else."""
    t = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", " "))
    bare = F.regexp_replace(t, NUMBERING, "")
    return F.regexp_replace(F.when(F.concat(t, F.lit(" ")).rlike(NUMBERING.rstrip("+") + "+$"), t).otherwise(bare), r"^[ .:\-–—]+|[ .:\-–—]+$", "")


def compact(text: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")


def is_matter(title: Column, include: tuple = (), exclude: tuple = ()) -> Column:
    """Front or back matter; the given words overrule the lists."""
    t = F.lower(plain(title))
    listed = t.rlike(FRONT) | t.rlike(BACK)
    for word in exclude:
        listed = listed | t.contains(word.lower())
    for word in include:
        listed = listed & ~t.contains(word.lower())
    return listed


def opens_with(text: Column, title: Column, slack: int = 12) -> Column:
    """The title stands within the first signs of a paragraph."""
    t = compact(plain(title))
    at = F.position(t, compact(text))
    return (F.length(t) >= 3) & (at > 0) & (at <= slack + 1)


def slug(text: Column, limit: int = 60) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.regexp_replace(F.substring(s, 1, limit), "-+$", "")
    return F.when(cut == "", F.lit("untitled")).otherwise(cut)


def pick_isbn(lines: Column) -> Column:
    """ISBN-13 of the copyright lines: one labelled as electronic, else the first
    valid one. ``lines`` is an array of text lines; a label belongs to its entry,
    and entries are parted by bars, semicolons and the next number."""
    entry = r"(?i)((?:e?-?ISBN(?:-1[03])?)\s*[:#]?\s*(?:97[89][-‐\s]?)?(?:\d[-‐\s]?){9}[\dX][^|;]{0,25}?(?=e?-?ISBN|[|;]|$)|(?:e-?book|epub|digital|kindle|electronic)[^|;]{0,30}?ISBN(?:-1[03])?\s*[:#]?\s*(?:97[89][-‐\s]?)?(?:\d[-‐\s]?){9}[\dX])"
    entries = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(entry), F.lit(1))))
    number = r"((?:97[89][-‐\s]?)?(?:\d[-‐\s]?){9}[\dXx])"
    named = F.filter(
        F.transform(entries, lambda e: F.struct(isbn13(F.regexp_extract(e, number, 1)).alias("n"), e.rlike(EBOOK).alias("e"))),
        lambda s: s["n"].isNotNull(),
    )
    return F.coalesce(F.get(F.filter(named, lambda s: s["e"]), F.lit(0))["n"], F.get(named, F.lit(0))["n"])


def copyright_year(lines: Column) -> Column:
    """First year of the first copyright line that has one."""
    marked = F.filter(
        lines, lambda x: F.trim(x).rlike(r"(?i)©|\(c\)|^copyright\s+\d{4}|copyright\s+©") & x.rlike(r"\b(1[89]\d\d|20\d\d)\b")
    )
    return F.regexp_extract(F.get(marked, F.lit(0)), r"\b(1[89]\d\d|20\d\d)\b", 1).try_cast("int")


def split_title(raw: Column) -> Column:
    """Struct of title and subtitle, parted at the first colon; null when empty."""
    t = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\s+", " "))

    def some(c: Column) -> Column:
        return F.nullif(F.trim(c), F.lit(""))

    return F.struct(some(F.regexp_extract(t, "^([^:]*)", 1)).alias("title"), some(F.regexp_extract(t, "^[^:]*:(.*)$", 1)).alias("subtitle"))


def split_authors(raw: Column) -> Column:
    """Names of an author line: "Last, First", or names joined by &, ;, commas and and."""
    t = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\s+", " "))
    turned = r"^(\S+(?: \S+)?), ?(\S+(?: \S+)?)$"
    parts = (
        F.when(t.rlike(r"\s&\s|;"), F.split(t, r"\s*(?:&|;)\s*"))
        .when(t.rlike(turned) & ~t.contains(" and "), F.array(F.regexp_replace(t, turned, "$2 $1")))
        .otherwise(F.split(t, r"\s*,\s*(?:and\s+)?|\s+and\s+"))
    )
    return F.filter(F.transform(parts, F.trim), lambda p: p != "")


def speaker(authors: Column) -> Column:
    """"A", "A and B", "A, B and C"; null without authors."""
    n = F.size(authors)
    return F.when(n == 1, F.element_at(authors, 1)).when(
        n > 1, F.concat(F.array_join(F.slice(authors, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(authors, -1))
    )
