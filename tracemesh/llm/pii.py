"""Personal data: patterns propose, checksums confirm, context words adjust the score."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemesh.llm.common import id_and_text, let

BLOCK = 256
THRESHOLD = 0.5
#: Characters to either side of a match in which a context word counts.
NEAR = 40


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    size = F.length(number)
    digit = lambda i: F.substring(number, size - i, F.lit(1)).cast("int") * (1 + i % 2)
    total = F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), lambda s, i: s + F.when(digit(i) > 9, digit(i) - 9).otherwise(digit(i)))
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without blanks leaves 1 modulo 97, with its first four characters moved to the end."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, rest * 100 + (code - 55)).otherwise(rest * 10 + (code - 48)) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _card(low: int, high: int) -> Callable[[Column], Column]:
    return lambda v: let(digits(v), lambda d: F.length(d).between(low, high) & luhn(d))


def _ip(v: Column) -> Column:
    def small(part: Column) -> Column:
        value = F.regexp_replace(part, "^0+", "")
        return F.when(F.length(value) > 3, False).otherwise(F.coalesce(value.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(v, r"\."), small)


def _iban(v: Column) -> Column:
    return let(F.replace(v, F.lit(" "), F.lit("")), lambda d: F.length(d).between(15, 34) & mod97(d))


#: Length of an IBAN without blanks, and the countries that have it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """As many characters as the country has, whatever follows after a blank; of other countries as many as there are."""
    known = [(n, countries.replace(" ", "|")) for n, countries in IBAN_LENGTHS.items()]
    fixed = [rf"(?:{c})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in known]
    other = rf"(?!{'|'.join(c for _, c in known)})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}"
    return rf"(?<![A-Za-z0-9])(?:{'|'.join([*fixed, other])})(?![A-Za-z0-9])"


#: A run of 13 to 15 digits or groups of 4, 6 and 4 or 5, whatever follows after a blank; digits in other groups only alone.
_SHORTCARD = (
    r"(?<![0-9])[0-9]{13,15}(?![0-9])|(?<![0-9][\x20-]?)[0-9]{4}([\x20-])[0-9]{6}\1[0-9]{4,5}(?![0-9])"
    r"|(?<![0-9][\x20-]?)[0-9](?:[\x20-]?[0-9]){12,14}(?![\x20-]?[0-9])"
)


@dataclass(frozen=True)
class Kind:
    """A pattern with the literal that a text must contain, a check, a score and the words that raise it.

    Repeats that cannot give anything back are possessive, and a run of characters is entered at its
    start or where the match before it ended; both keep long runs linear and the matches the same.
    """

    name: str
    hint: str
    pattern: str
    check: Callable[[Column], Column]
    score: float
    context: str


#: Base kinds; what they must match is fixed.
BASE = (
    Kind(
        "email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda v: F.lit(True), 0.8, r"mail|contact|write",
    ),
    Kind("ip", r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _ip, 0.7, r"\bip\b|address|host|server"),
    Kind("card", r"[0-9][ -]?[0-9]", r"[0-9](?:[\x20-]?[0-9])++", _card(16, 19), 0.8, r"card|visa|master|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: F.length(digits(v)).between(8, 15), 0.7, r"phone|call|tel|mobil"),
)

#: Added kinds; they count only with a checksum, a context word, or both.
ADDED = (
    Kind("iban", r"[A-Z]{2}[0-9]{2}", _iban_pattern(), _iban, 0.6, r"iban|account|konto|compte|cuenta"),
    Kind(
        "shortcard", r"[0-9][ -]?[0-9]", _SHORTCARD, _card(13, 15), 0.3,
        r"card|amex|american express|karte|carte|tarjeta",
    ),
    Kind("ssn", r"[0-9]-[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda v: ~v.rlike("^(000|666|9)|-00-|-0000$"), 0.3, r"ssn|social security"),
)


def spans_of(text: Column, kind: Kind) -> Column:
    """The confirmed matches as an array of ``(kind, start, end, score)`` in text order, in code points.

    The pattern gives both the matches and the texts between them; a match starts where the lengths before
    it end.  Those are summed only for confirmed matches, in blocks, so a text that consists of
    matches stays close to linear.
    """
    none = F.expr("array()").cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>")
    pattern = F.lit(kind.pattern)

    def located(found: Column) -> Column:
        def placed(steps: Column) -> Column:
            """``steps``: length of each match with the text before it."""
            blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(steps) / BLOCK).cast("int")), lambda b: _total(F.slice(steps, b * BLOCK + 1, BLOCK)))

            def ends(block_sums: Column) -> Column:
                def span(item: Column) -> Column:
                    i = item["i"] + 1
                    whole = F.floor(i / BLOCK).cast("int")
                    end = _total(F.slice(block_sums, F.lit(1), whole)) + _total(F.slice(steps, whole * BLOCK + 1, i % BLOCK))
                    start = end - F.length(item["value"])
                    before, after = _surroundings(found, i)
                    near = F.lower(before).rlike(kind.context) | F.lower(after).rlike(kind.context)
                    score = F.lit(kind.score) + F.when(near, 0.2).otherwise(0.0)
                    return F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"), score.alias("score"))

                items = F.zip_with(found["values"], F.slice(found["gaps"], F.lit(1), F.size(found["values"])), lambda v, g: F.struct(v.alias("value"), g.alias("gap")))
                numbered = F.transform(items, lambda x, i: F.struct(i.alias("i"), x["value"].alias("value"), x["gap"].alias("gap")))
                return F.transform(F.filter(numbered, lambda x: kind.check(x["value"])), span)

            return let(blocks, ends)

        steps = F.zip_with(found["values"], F.slice(found["gaps"], F.lit(1), F.size(found["values"])), lambda v, g: (F.length(v) + F.length(g)).cast("bigint"))
        return F.when(F.size(found["values"]) > 0, let(steps, placed)).otherwise(none)

    found = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("values"), F.split(text, kind.pattern, -1).alias("gaps"))
    return F.when(text.rlike(kind.hint), let(found, located)).otherwise(none)


def _surroundings(found: Column, i: Column) -> tuple[Column, Column]:
    """The ``NEAR`` characters before and after the ``i``-th match, from 1, without a look at the whole text.

    They are put together from the neighbouring matches and the texts between them, of which each is cut to ``NEAR`` characters; as
    a match has two at least, half as many neighbours are enough.
    """
    reach = NEAR // 2
    first = F.greatest(i - reach, F.lit(1))
    last_of = lambda s: F.right(s, F.lit(NEAR))
    first_of = lambda s: F.left(s, F.lit(NEAR))
    none = F.lit("")
    before = F.zip_with(F.slice(found["gaps"], first, i - first + 1), F.slice(found["values"], first, i - first), lambda g, v: F.concat(last_of(g), F.coalesce(last_of(v), none)))
    after = F.zip_with(F.slice(found["gaps"], i + 1, reach + 1), F.slice(found["values"], i + 1, reach), lambda g, v: F.concat(first_of(g), F.coalesce(first_of(v), none)))
    return last_of(F.array_join(before, "")), first_of(F.array_join(after, ""))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda s, n: s + n)


def personal_data(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, base, added)``: arrays of ``(kind, start, end, score)``, one row per input row.

    ``base`` has every confirmed match of the base kinds, whatever its score; ``added`` has those of
    the further kinds whose score, raised by a context word in the 40 characters before or after, reaches ``threshold``.
    Null and empty texts have no spans.  Null ids and repeated rows are rows like any other; an empty table gives none.  The time
    for a text of matches grows in proportion to its length, so one of a megabyte takes seconds.
    """
    text = F.col("text")
    rows = id_and_text(docs)
    base = F.flatten(F.array(*[spans_of(text, k) for k in BASE]))
    added = F.flatten(F.array(*[spans_of(text, k) for k in ADDED]))
    return rows.select("doc_id", base.alias("base"), F.filter(added, lambda s: s["score"] >= threshold).alias("added"))


def pii_digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, a digest of the base spans, and all spans as text."""
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda name: F.size(F.filter("base", lambda s: s["kind"] == name)).cast("bigint").alias(f"n_{name}")
    return found.select(
        "doc_id",
        *[count(k.name) for k in BASE],
        F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        written(F.concat("base", "added")).alias("spans"),
        F.array_max(F.transform(F.concat("base", "added"), lambda s: s["score"])).alias("top_score"),
    )
