"""Text keys, vocabulary lookups, guarded arithmetic and number formats as column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgrid.domains import OTHER, SHORT, TYPE_OF_CLASS, TYPE_OF_ROLE


#: Hangul syllables: the first and last, the jamo they are made of (openings, vowels, closings), as the Unicode standard numbers them.
_SYLLABLES = ("\uac00", "\ud7a3")
_OPENINGS, _VOWELS, _CLOSINGS = ("".join(map(chr, range(a, b))) for a, b in ((0x1100, 0x1113), (0x1161, 0x1176), (0x11A8, 0x11C3)))
#: Decompositions lie in the first three planes.
_PLANES = 0x30000


@cache
def _decomposed() -> tuple[str, str, str]:
    """Characters that become one character under compatibility decomposition without marks, or none; what they become, those with none last; and the
    others but Hangul as `character, \\x01, text` joined by \\x02. Worked out from the Unicode data at hand."""
    ones, gone, many = [], [], []
    for code in range(0x80, _PLANES):
        c = chr(code)
        if unicodedata.combining(c):
            gone.append(c)
        elif unicodedata.decomposition(c):
            base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            (ones if len(base) == 1 else many).append((c, base))
    return "".join(c for c, _ in ones) + "".join(gone), "".join(base for _, base in ones), "\x02".join(f"{c}\x01{base}" for c, base in many)


def without_marks(text: Column) -> Column:
    """Compatibility decomposition (NFKD) without combining characters: accents go, full-width letters, ligatures and the like become plain ones.

    Most characters become one character or none, by a single `translate`. Only texts with a character from which several can come are taken apart.
    """
    one, plain, many = _decomposed()
    table = F.str_to_map(F.lit(many), F.lit("\x02"), F.lit("\x01"))

    def apart(c: Column) -> Column:
        place = F.ascii(c) - ord(_SYLLABLES[0])
        jamo = lambda letters, at: F.substring(F.lit(letters), (at + 1).cast("int"), F.lit(1))
        closing = F.when(place % 28 > 0, jamo(_CLOSINGS, place % 28 - 1)).otherwise("")
        syllable = F.concat(jamo(_OPENINGS, F.floor(place / 588)), jamo(_VOWELS, F.floor(place % 588 / 28)), closing)
        return F.when(c.between(*_SYLLABLES), syllable).otherwise(F.coalesce(F.try_element_at(table, c), c))

    several = text.rlike(r"[\x{bc}-\x{be}\x{132}-\x{10ffff}]")
    return F.translate(F.when(several, F.array_join(F.transform(F.split(text, ""), apart), "")).otherwise(text), one, plain)


def normal_class(raw: Column) -> Column:
    """A vehicle class as a key: no accents, runs of white space as one blank and none at the ends or before `,` and `.`, upper case.

    A null class gives NAN, which is no class and so residual.
    """
    collapsed = F.trim(F.regexp_replace(without_marks(raw), r"[\s\x1c-\x1f\x85\p{Z}]+", " "))
    return F.coalesce(F.upper(F.regexp_replace(collapsed, r" ([,.])", "$1")), F.lit("NAN"))


def lookup(key: Column, table: dict) -> Column:
    """`table[key]`, null where the key is null or unknown."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def type_of_class(raw: Column) -> Column:
    return F.coalesce(lookup(normal_class(raw), TYPE_OF_CLASS), F.lit(OTHER))


def type_of_role(role: Column) -> Column:
    return F.coalesce(lookup(role, TYPE_OF_ROLE), F.lit(OTHER))


def text_key(value: Column) -> Column:
    """An id as text whatever type it came in: without a trailing `.0`, trimmed."""
    return F.trim(F.regexp_replace(value.cast("string"), r"\.0$", ""))


def share(part: Column, whole: Column) -> Column:
    """part / whole where whole > 0, else null: undefined is not zero."""
    return F.when(whole > 0, part / whole)


def utc_timestamp(value: Column) -> Column:
    """Timestamps from text, null where there is none to read; zoned instants in UTC without the zone."""
    return F.to_timestamp_ntz(F.date_format(F.to_utc_timestamp(F.try_to_timestamp(value), F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def short_pair(label: Column) -> Column:
    sides = F.split(label, "-")
    return F.concat_ws("-", lookup(sides[0], SHORT), lookup(sides[1], SHORT))


#: From these sizes on so many places behind the point are shown; 4 below, and 2 for what is no positive number.
PLACES = ((100.0, 0), (10.0, 1), (1.0, 2), (0.1, 3))


def decimals(value: Column) -> Column:
    """Places behind the point for a value of this size."""
    by_size = F.lit(4)
    for least, places in reversed(PLACES):
        by_size = F.when(value >= least, places).otherwise(by_size)
    return F.when((value > 0) & (value < float("inf")), by_size).otherwise(2)


def shown(value: Column, family: Column) -> Column:
    """A value as text: four decimals for areas, two for points, a dash where it is not finite."""
    usable = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(~usable, "-").when(family == "area", F.format_string("%.4f", value)).otherwise(F.format_string("%.2f", value))
