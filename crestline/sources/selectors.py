"""Format choices from selector texts, as in ``bv*[height<=720]+ba/b[height<=720]/b``.

A selector lists alternatives between ``/``, of which the first that can be had is
chosen; an alternative names formats to be merged between ``+``, all of which must
be there. A name is

- ``b``, ``bv`` or ``ba``: the best format with both, with video alone, with audio
  alone, and with a star the best with anything, with video at least, with audio at
  least. ``w``, ``wv`` and ``wa`` are the worst ones. Better is higher, then of the
  larger bitrate; the smaller id comes first of equals either way.
- followed by any number of filters in brackets: a column, a comparison (``<``,
  ``<=``, ``>``, ``>=``, ``=``, ``!=``; for texts ``=``, ``!=``, ``^=`` begins with,
  ``$=`` ends with, ``*=`` contains) and a value. Null doesn't pass, but does with a
  ``?`` after the comparison.

A text becomes columns of one aggregation, with partial results in each task, however
many alternatives it has. What isn't a selector, or names a column that isn't there
or can't be compared so, is refused with ValueError when the plan is made.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PART = re.compile(r"([bw])([va]?)(\*?)((?:\[[^\[\]]*\])*)")
_FILTER = re.compile(r"\[\s*(\w+)\s*(<=|>=|!=|\^=|\$=|\*=|<|>|=)\s*(\??)\s*([^\[\]]*?)\s*\]")
_COMPARE = {
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "^=": lambda c, v: c.startswith(v),
    "$=": lambda c, v: c.endswith(v),
    "*=": lambda c, v: c.contains(v),
}
_ORDERED, _WITHIN = ("<", "<=", ">", ">="), ("^=", "$=", "*=")


@dataclass(frozen=True)
class Part:
    """One name of a selector: best or worst, of what, at least or alone, and its filters as (column, comparison, null passes, value)."""

    worst: bool
    kind: str
    at_least: bool
    filters: tuple[tuple[str, str, bool, str], ...]

    def matches(self, formats: DataFrame) -> Column:
        """The rows that the part may choose from."""
        video, audio = F.col("has_video"), F.col("has_audio")
        kinds = {"": (video & audio, video | audio), "v": (video & ~audio, video), "a": (audio & ~video, audio)}
        found = kinds[self.kind][self.at_least]
        for name, compare, nulls, value in self.filters:
            test = _COMPARE[compare](F.col(name), F.lit(_value(formats, name, compare, value)))
            found = found & (F.col(name).isNull() | test if nulls else test)
        return found

    def order(self) -> Column:
        """What is smallest for the row chosen."""
        height, bitrate = F.coalesce("height", F.lit(0)), F.coalesce("bitrate", F.lit(0.0))
        return F.struct(*((height, bitrate) if self.worst else (-height, -bitrate)), F.col("format_id"))


def _value(formats: DataFrame, name: str, compare: str, value: str) -> str | float:
    if name not in formats.columns:
        raise ValueError(f"formats have no column {name}")
    kind = formats.schema[name].dataType
    if isinstance(kind, T.StringType) and compare not in _ORDERED:
        return value
    if isinstance(kind, T.NumericType) and compare not in _WITHIN:
        try:
            return int(value) if re.fullmatch(r"[+-]?\d+", value) else float(value)
        except ValueError:
            raise ValueError(f"{name} is compared with {value!r}, which is no number") from None
    raise ValueError(f"{name} is of type {kind.simpleString()}, for which there is no {compare}")


def read_selector(text: str) -> tuple[tuple[Part, ...], ...]:
    """The alternatives of a selector in order, each the parts that it merges."""
    # brackets hold no brackets, so a separator is one that no closing bracket follows before an opening one
    split = lambda mark, of: re.split(rf"{mark}(?![^\[]*\])", of)
    return tuple(tuple(_part(name.strip(), text) for name in split(r"\+", alternative)) for alternative in split("/", text))


def _part(name: str, text: str) -> Part:
    found = _PART.fullmatch(name)
    if not found:
        raise ValueError(f"{name!r} in the selector {text!r} names no format")
    which, kind, star, brackets = found.groups()
    filters = [_FILTER.fullmatch(f) for f in re.findall(r"\[[^\[\]]*\]", brackets)]
    if None in filters or not all(f[4] for f in filters):
        raise ValueError(f"{name!r} in the selector {text!r} has a filter that isn't column, comparison, value")
    return Part(which == "w", kind, bool(star), tuple((f[1], f[2], bool(f[3]), f[4]) for f in filters))


def select_formats(formats: DataFrame, selector: str) -> DataFrame:
    """(entry, alternative, format_ids): which alternative each entry gets, from 1, and the formats it merges, in order.

    ``formats``: entry, format_id, height, bitrate, has_video, has_audio, and other
    columns that filters name. An entry for which there is no alternative has nulls;
    null is an entry, and a format whose id is null is none.
    """
    alternatives = read_selector(selector)
    parts = list(dict.fromkeys(part for parts in alternatives for part in parts))
    known = F.col("format_id").isNotNull()
    best = [F.min_by("format_id", F.when(known & part.matches(formats), part.order())).alias(f"part_{i}") for i, part in enumerate(parts)]
    found = formats.groupBy("entry").agg(*best)
    choices = [F.array(*(f"part_{parts.index(part)}" for part in merged)) for merged in alternatives]
    whole = [F.forall(ids, lambda x: x.isNotNull()) for ids in choices]
    number = F.coalesce(*(F.when(ok, F.lit(i)) for i, ok in enumerate(whole, 1)))
    ids = F.coalesce(*(F.when(ok, ids) for ok, ids in zip(whole, choices, strict=True)))
    return found.select("entry", number.alias("alternative"), ids.alias("format_ids"))
