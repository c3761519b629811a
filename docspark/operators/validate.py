"""Checks of uploads and of text fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import strip

MAX_BYTES = 10 * 1024 * 1024
SPECIAL = r"""[!@#$%^&*(),.?":{}|<>]"""
#: Bytes that a secret has at least.
LEAST_SECRET = 32


def upload_outcome(name: Column, has_file: Column, content_type: Column, size: Column, magic: Column, wanted_type: str = "application/pdf", most: int = MAX_BYTES) -> Column:
    """The status of an upload: the first rule that fails, in this order, else 201. ``magic``: whether the first bytes are right."""
    return (
        F.when(F.coalesce(strip(name), F.lit("")) == "", "400 name")
        .when(~F.coalesce(has_file, F.lit(False)), "400 file")
        .when(~F.coalesce(content_type == wanted_type, F.lit(False)), "415 type")
        .when(F.coalesce(size, F.lit(0)) == 0, "400 empty")
        .when(size > most, "413")
        .when(~F.coalesce(magic, F.lit(False)), "415 magic")
        .otherwise("201")
    )


def text_violations(x: Column, least: int = 8, most: int = 64) -> Column:
    """All rules that a text breaks, in the order in which they are tried. A null text breaks one: it is missing."""
    rules = {
        "missing": x.isNull(),
        "too_short": F.length(x) < least,
        "too_long": F.length(x) > most,
        "uppercase": ~x.rlike("[A-Z]"),
        "lowercase": ~x.rlike("[a-z]"),
        "digit": ~x.rlike(r"(?U)\d"),
        "special": ~x.rlike(SPECIAL),
    }
    return F.filter(F.array(*(F.when(bad, name) for name, bad in rules.items())), lambda r: r.isNotNull())


def line_violations(docs: DataFrame, least: int = 8, most: int = 64) -> DataFrame:
    """Rows (doc_id, line_no, violations) for each line of each text; null texts have no lines."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", text_violations(F.col("line"), least, most).alias("violations"))


def weak_secret(x: Column, denied: list[str] | None = None) -> Column:
    """Whether a secret is null, too short, or one of ``denied`` whatever its case."""
    return F.coalesce((F.length(x) < LEAST_SECRET) | F.lower(x).isin([d.lower() for d in denied or []]), F.lit(True))


def outside_domain(x: Column, domain: list[str]) -> Column:
    """Whether ``x`` is null or none of ``domain``, case and all. Stored names are mapped to values before, by ``functions.enum_value``."""
    return ~F.coalesce(x.isin(domain), F.lit(False))


def unknown_keys(json: Column, known: list[str]) -> Column:
    return F.array_sort(F.array_except(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")), F.array(*map(F.lit, known))))


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys that should be unique and aren't."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
