"""Scalar functions: column in, column out, all built of Spark's own functions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

#: White space as Python's str.strip sees it. Fixed values.
WHITE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
STOP_WORDS = {"en": ["the", "and", "of", "to", "in", "is"], "fr": ["le", "la", "les", "de", "et", "un"], "de": ["der", "die", "das", "und", "in", "ist"], "es": ["el", "la", "los", "de", "y", "en"], "pt": ["o", "a", "os", "de", "e", "em"]}


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(WHITE))


def normalise_key(x: Column) -> Column:
    return strip(F.lower(x))


def blank_default(x: Column, text: str) -> Column:
    return F.coalesce(F.nullif(strip(x), F.lit("")), F.lit(text))


def digest(x: Column) -> Column:
    return F.sha2(x, 256)


def new_id() -> Column:
    """A random version 4 UUID for each row."""
    return F.expr("uuid()")


def object_address(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix + "/"), key.cast("string"))


def has_magic(content: Column, magic: bytes) -> Column:
    return F.substring(content, 1, len(magic)) == F.lit(magic)


def email_like(x: Column) -> Column:
    """A simplified check of the shape of an address, not all of the RFC."""
    return x.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$")


def initials(name: Column, default: str = "US") -> Column:
    return F.coalesce(F.upper(F.left(F.array_join(F.transform(F.split(name, " "), lambda p: F.left(p, F.lit(1))), ""), F.lit(2))), F.lit(default))


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def local_date(ts: Column) -> Column:
    return F.date_format(ts, "dd/MM/yyyy")


def expires(ts: Column, days: int = 0, minutes: int = 0) -> Column:
    return ts + F.make_dt_interval(F.lit(days), F.lit(0), F.lit(minutes), F.lit(0))


def enum_value(name: Column) -> Column:
    """The value of an enum that is stored by its upper-case name."""
    return F.lower(name)


def rounded(x: Column, places: int = 2) -> Column:
    """``x`` to so many decimals; halves of the exact binary value go to the even digit, so 2.675 gives 2.67. Infinite values stay."""
    told = F.call_function("format_number", x, F.lit("0." + "0" * places)).try_cast("double")
    return F.when(F.abs(x) == float("inf"), x).otherwise(F.coalesce(told, x))


def percent(x: Column) -> Column:
    """One decimal, halves to even, without separators between thousands."""
    return F.concat(F.call_function("format_number", x, F.lit("0.0")), F.lit("%"))


def _accents() -> tuple[str, str]:
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
    return "".join(a for a, b in pairs if a != b), "".join(b for a, b in pairs if a != b)


def unaccent(x: Column) -> Column:
    return F.translate(x, *_accents())


def text_tokens(x: Column, lang: Column) -> Column:
    """Distinct words, lower-case and without accents, except the language's stop words."""
    words = F.filter(F.split(unaccent(F.lower(x)), "[^a-z0-9]+"), lambda w: w != "")
    stop = F.coalesce(F.create_map(*(v for k, ws in STOP_WORDS.items() for v in (F.lit(k), F.array(*map(F.lit, ws)))))[lang], F.array().cast("array<string>"))
    return F.array_except(words, stop)


def error_message(body: Column, default: str) -> Column:
    """The text of ``detail``, else the first message in its list, else ``default``."""
    detail = F.get_json_object(body, "$.detail")
    return F.coalesce(F.get_json_object(body, "$.detail[0].msg"), F.when(~detail.startswith("["), detail), F.lit(default))
