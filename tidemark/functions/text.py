"""Text keys of titles, paths and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_brackets(s: Column) -> Column:
    """Without (…) and […] parts."""
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"\([^)]*\)|\[[^\]]*\]", " "), r"\s+", " "))


def title_norm(s: Column) -> Column:
    """Lower case, blanks collapsed, without feat. and remix tails."""
    low = F.lower(s)
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"\s+(feat\.?|ft\.?|remix|edit)\b.*$", ""), r"\s+", " "))


def compact(s: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(s), "[^a-z0-9]+", "")


def slug(s: Column) -> Column:
    """Words joined by hyphens, lower case."""
    return F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def stem(path: Column) -> Column:
    """Name of a file without its folder and suffix."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def tokens(s: Column) -> Column:
    """Distinct words, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(s), "[^a-z0-9]+"), lambda x: x != "")))


def key_variants(s: Column) -> Column:
    """Keys under which a title is looked up: as it is, normalised, without brackets, compact."""
    return F.array_distinct(F.array(s, title_norm(s), title_norm(strip_brackets(s)), compact(s)))


def split_artist(s: Column) -> tuple[Column, Column]:
    """Artist and title of `artist - title`; no artist without the dash."""
    cut = F.instr(s, " - ")
    return F.when(cut > 0, F.trim(F.substring_index(s, " - ", 1))).otherwise(""), F.when(cut > 0, F.trim(F.regexp_extract(s, r"^.*? - (.*)$", 1))).otherwise(s)


def sha_prefix(s: Column, n: int = 12) -> Column:
    return F.substring(F.sha1(s.cast("binary")), 1, n)


def stable_bucket(s: Column) -> Column:
    """First eight hex digits of SHA-1 over the largest such number: in [0, 1], the same on every engine."""
    return F.conv(F.substring(F.sha1(s.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967295.0


def char_sum_bucket(s: Column, n: int) -> Column:
    """Sum of the characters' codes, modulo n."""
    return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0), lambda t, c: t + F.ascii(c)) % n


def parse_clock(s: Column) -> Column:
    """Seconds of `S`, `M:S` or `H:M:S`; null for anything else or negative."""
    parts = F.split(s, ":")
    at = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("double")
    n = F.size(parts)
    value = F.when(n == 1, at(1)).when(n == 2, at(1) * 60 + at(2)).when(n == 3, at(1) * 3600 + at(2) * 60 + at(3))
    return F.when(value >= 0, value)


def number_text(x: Column) -> Column:
    """Six digits after the point, without zeros at the end."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", x), "0+$", ""), r"\.$", "")


def wrap12(n: Column) -> Column:
    """1 to 12, round the circle."""
    return F.pmod(n - 1, F.lit(12)) + 1


def key_neighbours(number: Column, letter: Column) -> Column:
    """The key, one step up and down round the circle, and its relative of the other letter."""
    text = lambda n, l: F.concat(n.cast("int").cast("string"), l)
    return F.array(text(number, letter), text(wrap12(number + 1), letter), text(wrap12(number - 1), letter), text(number, F.when(letter == "A", "B").otherwise("A")))


#: Steps along the circle of keys, and whether the letter changes, from the nicest on; a mode has them up to its own ones.
KEY_STEPS = {"safe": [(0, False), (0, True), (1, False), (-1, False)], "energy": [(2, False), (-2, False)], "pro": [(1, True), (-1, True), (7, False), (-7, False)], "open": [(6, False)]}


def allowed_keys(number: Column, letter: Column, mode: str = "pro") -> Column:
    """The keys that may follow a key in a mode, from the nicest on."""
    modes = list(KEY_STEPS)
    steps = [x for m in modes[: modes.index(mode) + 1] for x in KEY_STEPS[m]]
    other = F.when(letter == "A", "B").otherwise("A")
    return F.array(*(F.concat(wrap12(number + d + 12).cast("int").cast("string"), other if swap else letter) for d, swap in steps))
