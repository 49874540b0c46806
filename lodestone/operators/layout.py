"""Text and pictures by arithmetic: line breaks, sizes, sampled frames, placeholders, packed batches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import text as tx

# A picture of text: its width and margin, the font's size, and widths of a character by the font's size.
WIDTH, MARGIN, FONT, WORD_WIDTH, SIGN_WIDTH = 600, 40, 24, 0.5, 0.6
#: Lines that fit its height.
LINES = 10
LEAST_SIDE = 28


def wrapped(text: Column) -> Column:
    """Lines of a text in a picture: whole words, or single characters where it has CJK ones.

    A part that is too wide for an empty line ends the text there, as does the last line that fits.
    """
    room = WIDTH - 2 * MARGIN

    def lines(parts: Column, between: str, width: float) -> Column:
        start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("line"), F.lit(True).alias("go"))

        def add(a: Column, x: Column) -> Column:
            longer = F.when(a["line"] == "", x).otherwise(F.concat(a["line"], F.lit(between), x))
            fits, empty = F.length(longer) * width < room, a["line"] == ""
            done = F.when(a["go"] & ~fits & ~empty, F.array_append(a["done"], a["line"])).otherwise(a["done"])
            line = F.when(~a["go"], a["line"]).when(fits, longer).when(empty, a["line"]).otherwise(x)
            return F.struct(done.alias("done"), line.alias("line"), (a["go"] & (fits | ~empty)).alias("go"))

        return F.aggregate(parts, start, add, lambda a: F.when(a["line"] == "", a["done"]).otherwise(F.array_append(a["done"], a["line"])))

    by_sign, by_word = lines(F.split(text, ""), "", SIGN_WIDTH * FONT), lines(tx.words(text), " ", WORD_WIDTH * FONT)
    return F.slice(F.when(tx.has_cjk(text), by_sign).otherwise(by_word), 1, LINES)


def resized(width: Column, height: Column, most: int, least: int) -> Column:
    """(width, height) within ``most`` and ``least`` pixels and with sides of LEAST_SIDE, the ratio kept."""

    def scaled(s: Column, when: Column, factor: Column) -> Column:
        to = lambda x: F.when(when, F.floor(x * factor).cast("long")).otherwise(x)
        return F.struct(to(s["w"]).alias("w"), to(s["h"]).alias("h"))

    s = F.struct(width.cast("long").alias("w"), height.cast("long").alias("h"))
    s = scaled(s, s["w"] * s["h"] > most, F.sqrt(most / (s["w"] * s["h"])))
    s = scaled(s, s["w"] * s["h"] < least, F.sqrt(least / (s["w"] * s["h"])))
    other = lambda a, b: F.floor(b * (LEAST_SIDE / a)).cast("long")
    narrow = (s["w"] < LEAST_SIDE) | (s["h"] < LEAST_SIDE)
    w = F.when(narrow & (s["w"] <= s["h"]), LEAST_SIDE).when(narrow, other(s["h"], s["w"])).otherwise(s["w"])
    h = F.when(narrow & (s["w"] <= s["h"]), other(s["w"], s["h"])).when(narrow, LEAST_SIDE).otherwise(s["h"])
    return F.struct(w.cast("long").alias("w"), h.cast("long").alias("h"))


def frames(total: Column, n: Column) -> Column:
    """The numbers of ``n`` frames (all, if there are fewer) spread evenly from the first to the last."""
    k = F.least(total, n)
    at = lambda i: F.floor(i * (total - 1) / F.greatest(k - 1, F.lit(1))).cast("long")
    return F.when(k > 0, F.transform(F.sequence(F.lit(0).cast("long"), k.cast("long") - 1), at)).otherwise(F.expr("cast(array() as array<bigint>)"))


def placeholders_match(contents: Column, counts: dict[str, Column]) -> Column:
    """Whether messages name each kind of media as often as there are such media."""
    same = F.lit(True)
    for tag, n in counts.items():
        named = F.aggregate(contents, F.lit(0), lambda s, c: s + tx.count_of(c, tag).cast("int"))  # noqa: B023
        same = same & (named == n)
    return same


def packed(texts: Column) -> Column:
    """Texts as one, each after a '#', and a last one."""
    return F.concat(F.lit("#"), F.array_join(texts, "#"), F.lit("#"))


def unpacked(reply: Column, n: Column, give_up: bool = False) -> Column:
    """The parts of a packed reply; null if they are not ``n``. Giving up takes what stands before a '|' as each part."""
    parts = F.filter(F.split(reply, "#"), lambda x: F.trim(x) != "")
    first = F.transform(parts, lambda x: F.trim(F.substring_index(x, "|", 1)))
    return F.when(F.size(parts) == n, first if give_up else parts)
