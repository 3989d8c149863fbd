"""Titles of books, sections and first videos."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let
from .publish import one_line

#: What stands between the parts of a title, and its length.
BETWEEN, MOST = " — ", 120


def speakable_book(title: Column) -> Column:
    """A book's title, unless it is a path, a file's name or a word with underscores: then nothing."""
    file = lambda t: t.rlike(r"[\\/]") | t.rlike(r"(?i)\.(epub|pdf|txt|md)$") | (F.contains(t, F.lit("_")) & ~t.rlike(r"\s"))
    return let(one_line(title), lambda t: F.when(file(t), F.lit("")).otherwise(t))


def _without(rest: Column, part: Column) -> Column:
    """What follows a name and its separator; the whole where the name is none or does not begin it."""
    mark = F.when(F.startswith(rest, F.concat(part, F.lit(BETWEEN))), F.lit(BETWEEN)).when(F.startswith(rest, F.concat(part, F.lit(" - "))), F.lit(" - "))
    after = let(mark, lambda m: F.when(m.isNotNull(), F.trim(F.substring(rest, F.length(part) + F.length(m) + 1, F.length(rest)))))
    return F.when((part == "") | (rest == ""), rest).when(rest == part, F.lit("")).otherwise(F.coalesce(after, rest))


def section_name(title: Column, book: Column, author: Column) -> Column:
    """What is left of a title without the book's and the author's names before it; the title itself if nothing is."""

    def cut(whole: Column) -> Column:
        rest = let(speakable_book(book), lambda b: _without(whole, b))
        rest = let(rest, lambda r: let(one_line(author), lambda a: _without(r, a)))
        return F.coalesce(F.nullif(rest, F.lit("")), whole)

    return let(one_line(title), cut)


def opening_title(book: Column, author: Column, section: Column) -> Column:
    """The first video's title: book, author and section, none of them twice."""

    def joined(p: Column) -> Column:
        other = lambda part: F.when((part != "") & (F.lower(part) != F.lower(p["section"])), part)
        whole = F.concat_ws(BETWEEN, other(p["book"]), other(p["author"]), F.nullif(p["section"], F.lit("")))
        return F.substring(F.coalesce(F.nullif(whole, F.lit("")), F.nullif(p["book"], F.lit("")), F.lit("Segment")), 1, MOST)

    return let(F.struct(speakable_book(book).alias("book"), one_line(author).alias("author"), one_line(section).alias("section")), joined)


def rewritten_title(current: Column, book: Column, author: Column, new_book: Column, new_author: Column) -> Column:
    """The title after a book or an author was renamed; null where it was written by hand or stays as it is."""
    both = lambda s: F.struct(opening_title(book, author, s).alias("old"), opening_title(new_book, new_author, s).alias("new"))
    chosen = lambda t: F.when((current == t["old"]) & (t["new"] != current), t["new"])
    return let(let(section_name(current, book, author), both), chosen)
