"""Text expressions: white space, words, joining of lines, character classes, widths, versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's \s has it: Unicode's and U+001C to U+001F.
SPACE = r"(?U)[\s\x1c-\x1f]+"
#: Ideographs, kana, hangul and CJK punctuation: between two of these no space is put when lines are joined.
CJK_WIDE = r"^[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{AC00}-\x{D7AF}\x{3000}-\x{303F}]$"
#: Ideographs of the basic block alone: the script class of recognised characters.
CJK_NARROW = r"^[\x{4E00}-\x{9FFF}]$"

# Advance widths of the characters U+0020 to U+007E in thousandths of the font size.
WIDTHS = [
    312, 278, 500, 556, 556, 889, 500, 500, 333, 333, 389, 584, 278, 333, 278, 278,
    556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 500, 584, 500, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778,
    667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556,
    556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
]
OTHER_WIDTH = 500


def let(value: Column, body) -> Column:
    """body(value) with the value computed once for a row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalise(text: Column) -> Column:
    """The text without any white space (F1)."""
    return F.regexp_replace(text, SPACE, "")


def words(text: Column) -> Column:
    """Words between white space, none empty (F2)."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def strip(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def characters(text: Column) -> Column:
    """Code points as an array."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def is_cjk(char: Column, wide: bool) -> Column:
    return char.rlike(CJK_WIDE if wide else CJK_NARROW)


def join_two(acc: Column, line: Column) -> Column:
    """Lines joined by a space, unless CJK characters meet."""
    tight = is_cjk(F.right(acc, F.lit(1)), True) & is_cjk(F.left(line, F.lit(1)), True)
    return F.when(acc == "", line).otherwise(F.concat(acc, F.when(tight, F.lit("")).otherwise(F.lit(" ")), line))


def join_lines(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(""), join_two)


def utf16_hex(word: Column) -> Column:
    """UTF-16 code units as upper-case hex digits (F8)."""
    return F.hex(F.encode(word, "UTF-16BE"))


def char_width(char: Column) -> Column:
    """Advance width of a character."""
    code = F.ascii(char)
    table = F.array(*[F.lit(w) for w in WIDTHS])
    return F.when((F.length(F.encode(char, "UTF-8")) == 1) & code.between(32, 126), F.element_at(table, code - 31)).otherwise(F.lit(OTHER_WIDTH))


def word_units(word: Column) -> Column:
    """Sum of a word's advance widths, in thousandths."""
    return F.aggregate(characters(word), F.lit(0), lambda acc, c: acc + char_width(c))


def natural_width(word: Column, size: Column) -> Column:
    return word_units(word).cast("double") / 1000.0 * size


def stretch(word: Column, size: Column, width: Column) -> Column:
    """Horizontal scaling that makes a word fill a width; 1 where the word has none."""
    return let(natural_width(word, size), lambda n: F.when(n > 0.01, width / n).otherwise(F.lit(1.0)))


def base_name(path: Column) -> Column:
    """The part after the last / or \\ (F12)."""
    return F.element_at(F.split(path, r"[\\/]"), -1)


def strip_extension(path: Column) -> Column:
    """Without a supported extension."""
    return F.regexp_replace(path, r"(?i)\.(pdf|png|jpe?g)$", "")


SUPPORTED = ("pdf", "png", "jpg", "jpeg")


def is_supported(path: Column) -> Column:
    """Whether a path has a supported extension."""
    return F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1)).isin(*SUPPORTED)


def version_parts(version: Column, n: int = 4) -> Column:
    """Numbers of a dotted version, missing or odd parts as 0, n of them."""
    parts = F.transform(F.split(F.regexp_replace(version, "^[vV]", ""), r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))
    return F.slice(F.concat(parts, F.array_repeat(F.lit(0), n)), 1, n)


def version_newer(a: Column, b: Column) -> Column:
    """Whether version a comes after version b."""
    return version_parts(a) > version_parts(b)


def char_f1(truth: Column, got: Column) -> Column:
    """Order-free character F1 (A1) of two texts of a row, without a shuffle: NaN for an empty truth.

    The count of a character is the length that its removal takes away, so the multiset intersection (J4, E1) is a sum
    over the distinct characters.
    """
    count = lambda t, c: F.length(t) - F.length(F.replace(t, c, F.lit("")))

    def score(p: Column) -> Column:
        t, g = p["t"], p["g"]
        overlap = F.aggregate(F.array_distinct(characters(t)), F.lit(0), lambda acc, c: acc + F.least(count(t, c), count(g, c)))
        f1 = let(overlap, lambda o: F.when(o == 0, F.lit(0.0)).otherwise(2.0 * o / (F.length(t) + F.length(g))))
        return F.when(t == "", F.lit(float("nan"))).otherwise(f1)

    return let(F.struct(truth.alias("t"), got.alias("g")), score)


def upper_median(values: Column) -> Column:
    """sorted[n / 2]: the upper of two middle values (A8); null for none."""
    return let(F.sort_array(values), lambda v: F.try_element_at(v, (F.floor(F.size(v) / 2) + 1).cast("int")))


def low_percentile(values: Column, p: float) -> Column:
    """sorted[round((n - 1) p)], half away from zero."""
    return let(F.sort_array(values), lambda v: F.try_element_at(v, (F.round((F.size(v) - 1) * F.lit(p)) + 1).cast("int")))
