"""Scalar text functions. White space is that of Python's str.split, spelled out so that every engine agrees."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def trim_ws(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def filled(parts: Column) -> Column:
    return F.filter(F.transform(parts, trim_ws), lambda s: s != "")


def sentences(text: Column, longer_than: int = 0) -> Column:
    """Pieces between sentence marks followed by white space, trimmed; blank ones and those not longer than the bound are dropped."""
    parts = filled(F.split(trim_ws(text), f"(?<=[.!?]){SPACE}+"))
    return F.filter(parts, lambda s: F.length(s) > longer_than) if longer_than else parts


def sentence_offsets(text: Column, parts: Column) -> Column:
    """Start and end of each sentence, looked up behind the one before; one that is not found starts at the cursor."""
    def step(acc, s):
        found = F.call_function("locate", s, text, acc["cursor"] + 1)
        start = let(found, lambda f: F.when(f > 0, f - 1).otherwise(acc["cursor"]).cast("int"))
        span = lambda at: F.struct(at.alias("start"), (at + F.length(s)).cast("int").alias("end"))
        return let(start, lambda at: F.struct((at + F.length(s)).cast("int").alias("cursor"), F.concat(acc["spans"], F.array(span(at))).alias("spans")))

    zero = F.struct(F.lit(0).alias("cursor"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))
    return F.aggregate(parts, zero, step, lambda acc: acc["spans"])


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(word_list(text))


def paragraphs(text: Column) -> Column:
    return filled(F.split(text, "\n\n"))


#: Scripts written without spaces, whose terms are pairs of characters.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]"


def terms(text: Column) -> Column:
    """Lower-case runs of letters, marks and digits of any script; runs of scripts without spaces give all their pairs."""
    runs = F.regexp_extract_all(F.regexp_replace(F.lower(text), f"({UNSPACED}+)", " $1 "), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(r) - 1)), lambda i: F.substring(r, i, F.lit(2)))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^{UNSPACED}"), pairs(r)).otherwise(F.array(r))))


def word_tokens(text: Column, most: int = 64) -> Column:
    """The first terms, the stand-in for a model's tokenizer, cut off at the model's length."""
    return F.slice(terms(text), 1, most)


def prefixed(text: Column, prefix: str) -> Column:
    """The text behind the prefix that a model wants, as `query: ` or `passage: `."""
    return F.concat(F.lit(prefix), text)


def first_words(text: Column, n: int = 30, suffix: str = "...") -> Column:
    """The text itself up to n words, else its first n words and the suffix."""
    words = word_list(text)
    return F.when(F.size(words) > n, F.concat(F.array_join(F.slice(words, 1, n), " "), F.lit(suffix))).otherwise(text)


def has_any(text: Column, signals: Sequence[str]) -> Column:
    """Whether the lower-cased text contains one of the signals, as a substring; null texts give false."""
    return F.coalesce(reduce(Column.__or__, [F.contains(F.lower(text), F.lit(s)) for s in signals]), F.lit(False))


def summary(text: Column) -> Column:
    """The summarising tool's text (its wording is a fixed value): the first 30 words, marked where there are more."""
    return F.concat(F.lit("Summary: "), first_words(text, 30, "... [truncated]"))


def has_any_word_of(text: Column, key: Column, between: str = " ") -> Column:
    """Whether the lower-cased text contains any word of the key, words being parted by one of the characters."""
    return F.exists(F.split(key, f"[{between}]"), lambda w: (w != "") & F.contains(F.lower(text), w))


def boundary_flags(text: Column) -> tuple[Column, Column]:
    """Whether a chunk starts like a sentence, and whether it ends like one."""
    bare = trim_ws(text)
    return bare.rlike(r"^[\p{Lu}\"'\-]"), bare.rlike(r"[.!?:,]$")


def overlap_share(a: Column, b: Column) -> Column:
    """Share of the distinct words of a that b has too."""
    two = F.array_distinct(word_list(F.lower(b)))
    return let(F.array_distinct(word_list(F.lower(a))), lambda one: F.size(F.array_intersect(one, two)) / (F.size(one) + F.lit(1e-9)))
