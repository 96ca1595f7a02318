"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score.

Everything is a column expression over one row; there is no shuffle and no code
outside the JVM. A pattern is applied twice, once for its matches and once for the
gaps between them, whose lengths give the matches' places in code points.

The patterns are written so that matching takes time in proportion to the text:
quantifiers are possessive wherever giving back characters can't help, and a
match may only start where a run of its characters starts, or where the last
match ended. Neither changes which matches are found, leftmost first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import free

#: Code points before a proposal in which context words count, and the score from which an added span is reported.
NEAR, ACCEPT = 48, 0.6


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    def add(state: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return state + twice

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number leaves 1 on division by 97, its first four characters moved to the end and letters read as 10 to 35."""
    turned = F.concat(F.substring(value, F.lit(5), F.length(value)), F.substring(value, 1, 4))

    def add(state: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code >= 65, (state * 100 + code - 55) % 97).otherwise((state * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _octets(value: Column) -> Column:
    def small(part: Column) -> Column:
        plain = F.regexp_replace(part, "^0+", "")
        return F.when(F.length(plain) <= 3, F.concat(F.lit("0"), plain).cast("int") <= 255).otherwise(False)

    return F.forall(F.split(value, r"\."), small)


@dataclass(frozen=True)
class Kind:
    """``may`` must hold of a text before the pattern is tried; ``check`` confirms a match.

    A base kind's confirmed matches are all reported, with score 1. Another's score
    is ``prior``, and ``checked`` more if confirmed and ``near`` more if ``context``
    is found just before.
    """

    name: str
    pattern: str
    may: Callable[[Column], Column]
    check: Callable[[Column], Column] | None = None
    base: bool = True
    prior: float = 1.0
    checked: float = 0.0
    context: str = ""
    near: float = 0.0


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: t.contains("@")),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"), _octets),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), lambda v: let(_digits(v), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.contains("+"), lambda v: F.length(_digits(v)).between(9, 15)),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
        lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}[ A-Z0-9]{11}"),
        lambda v: let(F.regexp_replace(v, " ", ""), lambda n: F.when(F.length(n).between(15, 34), mod97(n)).otherwise(False)),
        False, 0.2, 0.5, r"(?i)\b(?:iban|account|konto|compte|cuenta)\b", 0.2,
    ),
    Kind("local_phone", r"(?<![0-9+A-Za-z])(?:\(0?[0-9]{2,4}\) ?|0[0-9]{2,4}[ /-])[0-9]{3,4}[ -]?[0-9]{3,5}(?![0-9A-Za-z])", lambda t: t.rlike(r"[0-9][ /)-]{1,2}[0-9]{3}"), lambda v: F.length(_digits(v)).between(9, 15), False, 0.2, 0.1, r"(?i)\b(?:tel|telephone|phone|call|mobile|cell|fax|telefon|teléfono|téléphone|anruf)\b", 0.4),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), lambda v: ~v.rlike(r"^(?:000|666|9)|-00-|-0000$"), False, 0.2, 0.2, r"(?i)\b(?:ssn|social security|id number)\b", 0.3),
    Kind("secret", r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{12,}+(?![A-Za-z0-9_+/-])", lambda t: t.rlike(r"(?i)(?:password|passwd|secret|token|api[_-]?key)[\"' ]{0,2}[=:]"), lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]"), False, 0.1, 0.2, r"(?i)(?:password|passwd|secret|token|api[_-]?key)[\"' ]{0,2}[=:][\"' ]{0,2}$", 0.4),
)

SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though a lambda function within uses it for each of its items."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(values: Column, block: int = 128) -> Column:
    """For an array of ints: the sum of all that stand before each. In blocks, for a fold that appends copies what it has."""
    def inside(part: Column, ahead: Column) -> Column:
        return F.transform(part, lambda _, i: ahead + F.aggregate(F.slice(part, F.lit(1), i), F.lit(0), lambda a, x: a + x))

    def add(state: Column, part: Column) -> Column:
        return F.struct((state["total"] + F.aggregate(part, F.lit(0), lambda a, x: a + x)).alias("total"), F.concat(state["sums"], F.array(inside(part, state["total"]))).alias("sums"))

    parts = let(values, lambda all: F.transform(F.sequence(F.lit(0), F.floor((F.size(all) - 1) / block).cast("int")), lambda i: F.slice(all, i * block + 1, F.lit(block))))
    start = F.struct(F.lit(0).alias("total"), F.array().cast("array<array<int>>").alias("sums"))
    return F.flatten(F.aggregate(parts, start, add, lambda s: s["sums"]))


def spans_of(kind: Kind, text: Column) -> Column:
    """All reported spans of a kind in a text, by place."""
    found = F.zip_with(
        F.split(text, kind.pattern, -1),
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)),
        lambda gap, match: F.struct(F.length(gap).alias("gap"), F.coalesce(F.length(match), F.lit(0)).alias("length"), F.coalesce(match, F.lit("")).alias("value"), F.substring(gap, -NEAR, NEAR).alias("before")),
    )

    def place(x: Column, ahead: Column) -> Column:
        score = F.lit(kind.prior)
        if not kind.base:
            score = score + F.when(kind.check(x["value"]), kind.checked).otherwise(0.0) + F.when(x["before"].rlike(kind.context), kind.near).otherwise(0.0)
        start = ahead + x["gap"]
        return F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + x["length"]).alias("end"), score.alias("score"), x["value"].alias("value"))

    placed = let(found, lambda all: F.zip_with(all, running_sums(F.transform(all, lambda x: x["gap"] + x["length"])), place))
    if kind.base:
        kept = F.filter(placed, lambda s: (s["end"] > s["start"]) & (kind.check(s["value"]) if kind.check else F.lit(True)))
    else:
        kept = F.filter(placed, lambda s: (s["end"] > s["start"]) & (s["score"] >= ACCEPT - 1e-9))
    bare = F.transform(kept, lambda s: F.struct(s["kind"], s["start"], s["end"], s["score"]))
    return F.when(kind.may(text), bare).otherwise(F.array()).cast(SPAN)


def find(df: DataFrame, kinds: tuple[Kind, ...] = KINDS, text: str = "text", out: str = "spans") -> DataFrame:
    """Adds ``out``: the spans found, by kind as listed and then by start; none in a null or empty text.

    Spans of different kinds may overlap. All other columns stay, but for one named ``out``. Only the text counts: rows with a null id, and rows that come again, are
    rows like any other. Context raises the score of added kinds; base kinds are confirmed by their checks alone and have score 1.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    return df.withColumn(out, F.concat(*[spans_of(k, whole) for k in kinds]))


def redact(df: DataFrame, kinds: tuple[Kind, ...] = KINDS, text: str = "text") -> DataFrame:
    """Replaces each span by its kind in brackets; of overlapping ones the first names the whole. Null texts stay null."""
    found = free("__spans", df)
    spans = F.array_sort(F.col(found), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))

    def add(state: Column, s: Column) -> Column:
        new = s["start"] >= state["at"]
        grown = F.concat(state["parts"], F.array(F.substring(F.col(text), state["at"] + 1, s["start"] - state["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(new, grown).otherwise(state["parts"]).alias("parts"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    rebuilt = F.aggregate(spans, start, add, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(F.col(text), s["at"] + 1, F.length(text))))
    return find(df, kinds, text, found).withColumn(text, F.when(F.size(found) > 0, rebuilt).otherwise(F.col(text))).drop(found)


def told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    base = [k.name for k in KINDS if k.base]
    found = find(docs.select("doc_id", "text"), out="found").select("doc_id", "found")

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in base]
    return found.select("doc_id", *counts, F.sha2(told(F.filter("found", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), told(F.col("found")).alias("spans"))
