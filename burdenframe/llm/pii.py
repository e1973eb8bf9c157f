"""Personal data in texts, with SQL expressions only.

Regular expressions propose spans, checks confirm them (Luhn for cards, mod-97 for bank accounts, number ranges), and
words nearby adjust the score. Spans of the base kinds stay whatever their score; spans of the further kinds count from
``MIN_SCORE`` on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burdenframe.llm.common import bind, once

MIN_SCORE = 0.6
#: Characters on either side in which context words count.
WINDOW = 40
SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"
_HIT = "array<struct<start:int,end:int,value:string>>"


@dataclass(frozen=True)
class Kind:
    """A pattern, a cheap test that every text with a match passes, the score without context, and words that raise it."""

    pattern: str
    gate: str
    score: float
    context: str
    base: bool = False


#: Fixed patterns. Starts inside a run that a match could have begun earlier are ruled out (``(?<!...)`` or ``\G``), and
#: repetitions keep what they took (``++``): matches are those of the plain patterns, found in linear time.
KINDS = {
    "email": Kind(r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact", True),
    "ip": Kind(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, r"\bip\b|address|host|server", True),
    "card": Kind(r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){13}", 0.7, "card|credit|debit|visa|master|payment", True),
    "phone": Kind(r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.6, "phone|tel|call|mobile|fax", True),
    "iban": Kind(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", "[A-Z]{2}[0-9]{2}", 0.9, "iban|bank|account|konto|cuenta|compte"),
    "ssn": Kind(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.4, r"\bssn\b|social security"),
    "local_phone": Kind(r"\b[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}\b", r"[0-9]{3}[\x20.-][0-9]{3}[\x20.-]", 0.4, "phone|tel|call|mobile|fax"),
}
BASE = tuple(k for k, v in KINDS.items() if v.base)
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"


def hits(text: Column, pattern: str) -> Column:
    """Leftmost matches that don't overlap, with code point offsets: what lies between matches gives the starts."""

    def place(values: Column, between: Column) -> Column:
        steps = F.zip_with(values, F.slice(between, F.lit(1), F.size(values)), lambda v, g: F.struct(v.alias("v"), g.alias("g")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(_HIT).alias("out"))

        def step(state: Column, s: Column) -> Column:
            begin = state["at"] + F.char_length(s["g"])
            end = begin + F.char_length(s["v"])
            hit = F.struct(begin.alias("start"), end.alias("end"), s["v"].alias("value"))
            return F.struct(end.alias("at"), F.concat(state["out"], F.array(hit)).alias("out"))

        return F.aggregate(steps, start, step, lambda s: s["out"])

    return bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                lambda v: F.when(F.size(v) == 0, F.array().cast(_HIT)).otherwise(bind(F.split(text, pattern, -1), lambda g: place(v, g))))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the Luhn checksum of a string of digits is right."""
    back = F.reverse(digits)
    doubled = lambda i: F.substr(back, i, F.lit(1)).cast("int") * (2 - i % 2)
    total = F.aggregate(F.sequence(F.lit(1), F.char_length(back)), F.lit(0),
                        lambda a, i: a + F.when(doubled(i) > 9, doubled(i) - 9).otherwise(doubled(i)))
    return total % 10 == 0


def mod_97(account: Column) -> Column:
    """Whether an account number without spaces passes the mod-97 check: country and check digits go last, A is 10."""
    moved = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))

    def step(rest: Column, i: Column) -> Column:
        n = F.ascii(F.substr(moved, i, F.lit(1)))
        return F.when(n < 58, (rest * 10 + n - 48) % 97).otherwise((rest * 100 + n - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(moved)), F.lit(0), step) == 1


def _confirmed(kind: str, value: Column) -> Column:
    n = F.char_length(_digits(value))
    return {
        "ip": value.rlike(f"^{_BYTE}(?:\\.{_BYTE}){{3}}$"),
        "card": n.between(14, 19) & luhn(_digits(value)),
        "phone": n.between(10, 15),
        "iban": F.char_length(F.translate(value, " ", "")).between(15, 34) & mod_97(F.translate(value, " ", "")),
        "ssn": ~value.rlike("^(?:000|666|9)|-00-|-0000$"),
    }.get(kind, F.lit(True))


def _spans(text: Column, kind: str, rule: Kind) -> Column:
    def scored(hit: Column) -> Column:
        begin = F.greatest(hit["start"] - WINDOW, F.lit(0))
        near = F.lower(F.concat_ws("\n", F.substr(text, begin + 1, hit["start"] - begin), F.substr(text, hit["end"] + 1, F.lit(WINDOW))))
        score = F.least(F.when(near.rlike(rule.context), F.lit(rule.score + 0.3)).otherwise(F.lit(rule.score)), F.lit(1.0))
        return F.struct(F.lit(kind).alias("kind"), hit["start"].alias("start"), hit["end"].alias("end"), score.alias("score"))

    found = F.transform(F.filter(hits(text, rule.pattern), lambda h: _confirmed(kind, h["value"])), scored)
    if not rule.base:
        found = F.filter(found, lambda s: s["score"] >= MIN_SCORE)
    gate = F.contains(text, F.lit(rule.gate)) if rule.gate == "@" else text.rlike(rule.gate)
    return F.when(gate, found).otherwise(F.array()).cast(SPAN)


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` under ``doc``, with ``spans`` beside it: kind, start, end (code points, end exclusive), score.

    Spans are by start, then in the order of ``KINDS``; those of one kind don't overlap. Null and empty texts have none.
    Every row is judged alone: repeated rows get equal spans. An empty table gives an empty table.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    t = F.col("t")
    rows = rows.select("doc", F.coalesce(F.col(f"doc.`{text}`"), F.lit("")).alias("t"))
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    found = F.concat(*[_spans(t, kind, rule) for kind, rule in KINDS.items()])
    keyed = F.transform(found, lambda s: F.struct(s["start"].alias("at"), order[s["kind"]].alias("o"), s.alias("s")))
    ordered = F.transform(F.array_sort(keyed), lambda x: x["s"])
    return rows.select("doc", once(ordered).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first stays."""

    def step(state: Column, s: Column) -> Column:
        more = F.concat(state["out"], F.substr(text, state["at"] + 1, s["start"] - state["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.when(s["start"] < state["at"], state).otherwise(F.struct(more.alias("out"), s["end"].alias("at")))

    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(spans, begin, step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1, F.char_length(text))))
