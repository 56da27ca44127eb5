"""Text column functions: natural order, categories, tokens and phrases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import col

# The ordered rules of place categories.
CATEGORIES = [
    ("sports", "gym|field|stadium|athletic|courtyard"),
    ("food", "cafeteria|commons|dining|food"),
    ("learning", "library|research|learning|aep|counsel"),
    ("arts", "theater|theatre|auditorium|band|choir|arts|performing"),
    ("office", "admin|office"),
]


def natural_key(label: Column | str) -> Column:
    """An array that sorts labels in natural order: digit runs by value, other runs by lower case."""
    runs = F.regexp_extract_all(F.lower(col(label)), F.lit(r"\d+|\D+"), F.lit(0))
    return F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.lpad(F.regexp_replace(r, "^0+(?=.)", ""), 20, "0")).otherwise(r))


def natural_order(label: Column | str) -> list[Column]:
    """Sort columns for ``orderBy``."""
    return [natural_key(label).asc_nulls_last(), col(label).asc_nulls_last()]


def category(name: Column | str, rules: list[tuple[str, str]] = CATEGORIES, default: str = "other") -> Column:
    """The first rule whose pattern occurs in the name, in any case."""
    out = F
    for kind, pattern in rules:
        out = out.when(F.lower(col(name)).rlike(pattern), kind)
    return out.otherwise(default)


def strip_room(text: Column | str) -> Column:
    """Trimmed lower case without a leading ``room``."""
    return F.regexp_replace(F.lower(F.trim(col(text))), r"^room\s+", "")


def room_tokens(text: Column | str) -> Column:
    """Room numbers said in a text, in order: three digits and an optional letter; O reads as 0."""
    return F.regexp_extract_all(F.translate(F.upper(col(text)), "O", "0"), F.lit(r"\b[0-9]{3}[A-Z]?\b"), F.lit(0))


def room_label(label: Column | str, kind: Column | str) -> Column:
    """``Room N`` for rooms whose label starts with a digit, else the label."""
    return F.when((col(kind) == "room") & col(label).rlike(r"^\d"), F.concat(F.lit("Room "), col(label))).otherwise(col(label))


def room_grammar(text: Column | str) -> Column:
    """A room number: first digit 1 to 4, two digits, an optional letter."""
    return col(text).rlike(r"^[1-4]\d\d[A-Z]?$")


def room_on_floor(text: Column | str, floor: Column | str, digits: dict[str, str]) -> Column:
    """Whether a room number's first digit is one of its floor's ``digits`` (such as {"upper": "34"})."""
    known = F.create_map(*[F.lit(x) for pair in sorted(digits.items()) for x in pair])
    first = F.substring(col(text), 1, 1)
    return F.coalesce(room_grammar(text) & F.contains(F.element_at(known, col(floor)), first), F.lit(False))


def clock(seconds: Column | str) -> Column:
    """Seconds as m:ss."""
    s = F.floor(col(seconds)).cast("long")
    return F.format_string("%d:%02d", F.floor(s / 60).cast("long"), F.pmod(s, F.lit(60)).cast("long"))


def turn_phrase(delta: Column | str) -> Column:
    """Words for a change of bearing in radians (positive: to the right); null if nearly straight."""
    degrees = F.abs(F.degrees(col(delta)))
    side = F.when(col(delta) > 0, "right").otherwise("left")
    return F.when(degrees < 30, F.lit(None)).when(degrees < 60, F.concat(F.lit("Bear "), side)).when(degrees < 135, F.concat(F.lit("Turn "), side)).otherwise(F.concat(F.lit("Turn sharply "), side))


def stair_phrase(from_index: Column | str, to_index: Column | str, to_label: Column | str) -> Column:
    """Words for a change of floor, by the floors' order."""
    many = F.abs(col(to_index) - col(from_index))
    way = F.when(col(to_index) > col(from_index), "up").otherwise("down")
    return F.concat(F.lit("Take the stairs "), F.when(many > 1, F.concat(many.cast("string"), F.lit(" flights "))).otherwise(""), way, F.lit(" to the "), col(to_label))


def trailing_letter(label: Column | str) -> Column:
    """The letter in ``... (X)`` at the end of a label, or the empty text."""
    return F.regexp_extract(col(label), r"\(([A-Za-z])\)\s*$", 1)
