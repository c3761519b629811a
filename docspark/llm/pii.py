"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

_MARK, _STAND_IN = "\x01", "\x02"
#: Characters of text before a span in which a context word counts.
NEARBY = 40
#: Parts of a text between matches that are walked through at once; even, so that each block begins outside a match.
BLOCK = 512


@dataclass(frozen=True)
class Kind:
    """A kind of personal data. ``hint``: what any text with a match contains; ``base``: kept whatever its score."""

    name: str
    pattern: str
    hint: str
    words: str
    prior: float
    base: bool


#: Possessive repeats and the look-behinds leave the matches as they are and keep the search linear in the text:
#: a match inside a run of the first class is also one from the run's start, or from where the last match ended.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "mail|contact|courriel|correo", 0.9, True),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", r"[0-9]\.[0-9]", r"\bip\b|host|server|address", 0.6, True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"(?:[0-9][\x20-]?){11}[0-9]", "card|visa|carte|karte|tarjeta", 0.7, True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", r"phone|\btel|call|mobile|fax", 0.7, True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}", "iban|account|konto|compte|cuenta", 0.8, False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "ssn|social|security", 0.3, False),
)
#: Spans of kinds that aren't base are reported from this score on.
REPORTED = 0.5


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def luhn(span: Column) -> Column:
    """Whether the digits of ``span`` pass the Luhn check."""
    backwards = F.split(F.reverse(_digits(span)), "")
    value = lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) - F.when(d.cast("int") > 4, 9).otherwise(0))
    return F.aggregate(F.transform(backwards, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(span: Column) -> Column:
    """Whether ``span`` passes the mod-97 check of an IBAN."""
    plain = F.regexp_replace(span, " ", "")
    turned = F.split(F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4)), "")
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(turned, F.lit(0), step) == 1


def _valid(kind: str, span: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3
        return F.forall(F.split(span, r"\."), lambda p: part(p) & (F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int"), F.lit(999)) <= 255))
    if kind == "card":
        return F.length(_digits(span)).between(12, 19) & luhn(span)
    if kind == "phone":
        return F.length(_digits(span)).between(9, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(span, " ", "")).between(15, 34) & mod97(span)
    if kind == "ssn":
        return ~span.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also where ``use`` names it inside functions of array elements."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _spans(text: Column, kind: Kind, order: int) -> Column:
    """Array of (start, rank, end, score) of the kind's valid matches in ``text``, which has no mark characters.

    Arrays that grow by one are copied at each step, so the parts between marks go in blocks of BLOCK: a block's spans count
    from its own start, and a second pass over the blocks adds where each begins.
    """
    none = F.array().cast("array<struct<start:int,rank:int,end:int,score:double>>")

    def block(parts: Column, b: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            part, inside = F.get(parts, i), i % 2 == 1
            end = a["at"] + F.length(part)
            near = F.lower(F.right(F.get(parts, i - 1), F.lit(NEARBY))).rlike(kind.words)
            score = F.when(near, F.lit(min(1.0, kind.prior + 0.25))).otherwise(F.lit(kind.prior))
            good = inside & _valid(kind.name, part) & (F.lit(True) if kind.base else score >= REPORTED)
            one = F.array(F.struct(a["at"].alias("start"), F.lit(order).alias("rank"), end.alias("end"), score.alias("score")))
            return F.struct(end.alias("at"), F.when(good, F.concat(a["out"], one)).otherwise(a["out"]).alias("out"))

        places = F.sequence(b * BLOCK, F.least(F.size(parts), (b + 1) * BLOCK) - 1)
        return F.aggregate(places, F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    def joined(blocks: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        begin = F.aggregate(blocks, first, lambda a, x: F.struct((a["at"] + x["at"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]
        moved = lambda s, at: F.struct((s["start"] + at).alias("start"), s["rank"].alias("rank"), (s["end"] + at).alias("end"), s["score"].alias("score"))
        return _bound(begin, lambda at: F.flatten(F.transform(blocks, lambda x, k: F.transform(x["out"], lambda s: moved(s, F.get(at, k))))))

    parts = F.split(F.regexp_replace(text, kind.pattern, f"{_MARK}$0{_MARK}"), _MARK)
    blocks = lambda ps: F.transform(F.sequence(F.lit(0), F.floor((F.size(ps) - 1) / BLOCK).cast("int")), lambda b: block(ps, b))
    return F.when(text.rlike(kind.hint), _bound(parts, lambda ps: _bound(blocks(ps), joined))).otherwise(none)


def find_pii(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) as rows (doc_id, found): found is an array of (kind, start, end, score, base), sorted
    by start, then by the order of KINDS. Offsets are code points, the end exclusive.

    Base kinds are reported whenever their validator passes; the context only moves the score. Further kinds need a
    score of REPORTED. Null and empty texts have no spans; rows that repeat a doc_id are handled one by one; an
    empty table gives no rows; further columns are ignored, whatever their names. Matches of one kind never
    overlap; those of different kinds may. Texts of any length are taken whole; the time is linear in a text and its matches.
    """
    text = F.translate(F.coalesce("text", F.lit("")), _MARK, _STAND_IN)
    wide = docs.select("doc_id", text.alias("t")).select("doc_id", *(_spans(F.col("t"), k, i).alias(f"k{i}") for i, k in enumerate(KINDS)))
    every = F.array_sort(F.concat(*(f"k{i}" for i in range(len(KINDS)))))
    name = F.array(*(F.lit(k.name) for k in KINDS))
    base = sum(k.base for k in KINDS)
    told = lambda s: F.struct(name[s["rank"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"), (s["rank"] < base).alias("base"))
    return wide.select("doc_id", F.transform(every, told).alias("found"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """Counts, digest and listing of ``find_pii`` per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = find_pii(docs)
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k.name).alias(f"n_{k.name}") for k in KINDS if k.base),
        F.sha2(_listed(F.filter("found", lambda s: s["base"])), 256).alias("base_sha256"),
        _listed(F.col("found")).alias("spans"),
    )

