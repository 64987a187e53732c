"""Column expressions that the native operators share: words, lines, and a name for a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once for a row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def has_word(line: Column) -> Column:
    return F.rlike(line, F.lit(r"[^\x20\x09-\x0D]"))


def lines(text: Column) -> Column:
    """The \\n-split lines that have a word."""
    return F.filter(F.split(text, "\n"), has_word)


def normal_lines(text: Column) -> Column:
    """The \\n-split lines, A-Z lower-cased, white space as single spaces, none at the ends; empty where a line has no word."""
    spaced = F.regexp_replace(F.translate(text, UPPER, LOWER), r"[\x20\x09\x0B-\x0D]+", " ")
    return F.split(F.trim(spaced), " ?\n ?")


def line_table(text: Column) -> Column:
    """array<struct<h, at, w>>: hash of each distinct normalised line with a word, the numbers of the lines where it stands (from 0), and the words it has.

    Lines are sorted by hash and read off in runs, so the work is that of a sort, however many lines a text has.
    """
    words_in = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    each = F.transform(normal_lines(text), lambda x, i: F.when(x != "", F.struct(F.xxhash64(x).alias("h"), i.alias("at"), words_in(x).alias("w"))))
    ordered = F.sort_array(F.filter(each, lambda x: x.isNotNull()))

    def runs(s: Column) -> Column:
        firsts = F.filter(F.transform(s, lambda e, k: F.when((k == 0) | (F.get(s, k - 1)["h"] != e["h"]), k)), lambda k: k.isNotNull())
        return let(firsts, lambda f: F.transform(f, lambda k, j: run(s, k, F.coalesce(F.get(f, j + 1), F.size(s)))))

    def run(s: Column, a: Column, b: Column) -> Column:
        return F.struct(F.get(s, a)["h"].alias("h"), F.transform(F.slice(s, a + 1, b - a), lambda e: e["at"]).alias("at"), F.get(s, a)["w"].alias("w"))

    return let(ordered, runs)


def without_lines(text: Column, numbers: Column) -> Column:
    """text without the lines of these numbers (sorted, from 0)."""

    def kept(lines: Column, gone: Column) -> Column:
        ends = F.concat(gone, F.array(F.size(lines)))
        before = lambda j: F.coalesce(F.get(gone, j - 1), F.lit(-1))
        return F.array_join(F.flatten(F.transform(ends, lambda end, j: F.slice(lines, before(j) + 2, end - before(j) - 1))), "\n")

    return let(F.split(text, "\n"), lambda x: let(numbers, lambda n: kept(x, n)))
