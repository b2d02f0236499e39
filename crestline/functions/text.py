"""Column functions over text and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pattern of a stable version, of a download's progress, and of a remote address.
VERSION = r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)$"
PERCENT = r"\[download\]\s+([\d.]+)%"
REMOTE = r"^https?://"


def clock(seconds: Column, mark: str = ":") -> Column:
    """HH:MM:SS of seconds, cut to whole ones; hours may have more digits."""
    s = seconds.cast("bigint")
    two = lambda x: F.when(x < 10, F.concat(F.lit("0"), x.cast("string"))).otherwise(x.cast("string"))
    return F.concat_ws(mark, two(F.floor(s / 3600)), two(F.floor(s % 3600 / 60)), two(s % 60))


def file_clock(seconds: Column) -> Column:
    """The same for file names, HH-MM-SS."""
    return clock(seconds, "-")


def escape_text(text: Column) -> Column:
    """Text for a drawing filter: without backslashes, quotes and percent signs, colons and commas escaped."""
    return F.replace(F.replace(F.translate(text, "\\'%", ""), F.lit(":"), F.lit("\\:")), F.lit(","), F.lit("\\,"))


def stripped(text: Column) -> Column:
    """Without white space, of any alphabet, at the ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def trimmed(text: Column) -> Column:
    """Without white space, of any alphabet, and then double quotes at the ends."""
    return F.regexp_replace(stripped(text), r'^"+|"+$', "")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_remote(entry: Column) -> Column:
    """Whether an entry is a web address."""
    return F.lower(entry).rlike(REMOTE)


def percent(line: Column) -> Column:
    """A progress line's percentage, null for other lines."""
    return F.regexp_extract(line, PERCENT, 1).try_cast("double")


def is_version(text: Column) -> Column:
    """Whether text is a stable version: three numbers without leading zeros."""
    return text.rlike(VERSION)


def tag_matches(tag: Column, version: Column) -> Column:
    return tag == F.concat(F.lit("v"), version)


def request_status(entry: Column, output: Column, k: Column, duration: Column) -> Column:
    """What RunRequest would say of a request of strings: ok, no_entry, bad_number, no_output or bad_range."""
    number = r"^\s*[+-]?\d+\s*$"
    n, d = (F.trim(x).try_cast("bigint") for x in (k, duration))
    blank = lambda x: F.coalesce(trimmed(x), F.lit("")) == ""
    numbers = F.coalesce(k.rlike(number) & duration.rlike(number), F.lit(False)) & n.isNotNull() & d.isNotNull()
    return F.when(blank(entry), "no_entry").when(~numbers, "bad_number").when(blank(output), "no_output").when((n < 1) | (d < 15) | (d > 120), "bad_range").otherwise("ok")


def one_line(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def joined_lines(parts: Column) -> Column:
    """An array's strings that aren't empty, a line each."""
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n")


def path_of(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def tenths(value: Column) -> Column:
    """A number with its sign and one decimal, rounded as C's %+.1f does: by the exact binary value, halves to even.

    Spark's own %.1f rounds the shortest decimal half up, so that 0.25 gives 0.3 and
    0.35, which in binary is a little less, 0.4. Here ten times the value is split at
    its floor; only exact quarters (x.x5 that binary holds) are ties.
    """
    size = F.abs(value)
    low = F.floor(size * 10).cast("bigint")
    # products and quotients by 10 round, so candidates are compared by the exact difference to their middle
    middle = (low * 2 + 1) / F.lit(20.0)
    exact_middle = (low * 2 + 1) % 5 == 0  # x.25 and x.75 are exact in binary, other middles are not
    error = _middle_error(low)
    above = F.when(size > middle, True).when(size < middle, False).when(exact_middle, low % 2 == 1).otherwise(error > 0)
    n = low + F.when(above, 1).otherwise(0)
    return F.concat(F.when(value < 0, "-").otherwise("+"), F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


def _middle_error(low: Column) -> Column:
    """Positive if the double nearest to the decimal (2 low + 1) / 20 is above it, negative if below."""
    middle = (low * 2 + 1) / F.lit(20.0)
    # 20 x middle - (2 low + 1), exactly: split the double into two halves whose products with 20 are exact
    high = middle * F.lit(134217729.0) - (middle * F.lit(134217729.0) - middle)
    return (high * 20.0 - (low * 2 + 1)) + (middle - high) * 20.0
