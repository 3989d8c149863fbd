"""What to search footage with for a segment: titles, then its commonest words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import counted, let
from ..functions.text import trim

#: Words that say nothing about a scene: fixed values, as are the least length of a word and the number of terms.
STOPWORDS = (
    "the a an and or but if then than that this those these of in on at to for from by with without into onto upon "
    "is are was were be been being am do does did done have has had having will would shall should can could may "
    "might must not no nor so as it its it's he she they them his her their our your my me i you we us who whom "
    "which what when where why how all any both each few more most other some such only own same too very just "
    "over under again further once here there because while about against between during before after above below "
    "up down out off then said say says one two three said mr mrs said upon shall"
).split()
LEAST, TERMS = 4, 8


def common_words(text: Column, stop: list[str] = STOPWORDS, least: int = LEAST) -> Column:
    """A text's words by count, then alphabet; short ones and stop words are none."""
    parts = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}']+"), lambda w: F.regexp_replace(w, r"^'+|'+$", ""))
    return F.transform(counted(F.filter(parts, lambda w: (F.length(w) >= least) & ~w.isin(list(dict.fromkeys(stop))))), lambda x: x["word"])


def terms(title: Column, chapter: Column, text: Column, amount: int = TERMS) -> Column:
    """At most ``amount`` terms: the title, the chapter if it has another name, the two commonest words as one, then words that no term so far holds."""
    title, chapter = trim(F.coalesce(title, F.lit(""))), trim(F.coalesce(chapter, F.lit("")))
    other = F.when(F.lower(chapter) != F.lower(title), F.nullif(chapter, F.lit("")))
    named = F.filter(F.array(F.nullif(title, F.lit("")), other), lambda x: x.isNotNull())

    def with_words(words: Column) -> Column:
        pair = F.when(F.size(words) >= 2, F.array(F.concat(F.get(words, F.lit(0)), F.lit(" "), F.get(words, F.lit(1))))).otherwise(F.array().cast("array<string>"))
        full = lambda got: F.size(got) >= amount
        add = lambda got, w: F.when(full(got) | F.exists(got, lambda t: F.contains(F.lower(t), w)), got).otherwise(F.concat(got, F.array(w)))
        return F.slice(F.aggregate(words, F.concat(named, pair), add), 1, amount)

    return let(common_words(text), with_words)
