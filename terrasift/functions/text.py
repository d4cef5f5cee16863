"""Text normalisation as Column expressions. Missing is NULL, never a sentinel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of operators, by their lower-case variants.
OPERATOR_ALIASES = {
    "bp australia": "BP",
    "bp pulse": "BP",
    "tesla motors": "Tesla",
    "tesla, inc.": "Tesla",
    "tesla supercharger": "Tesla",
    "non-networked": "Non-networked",
    "evie networks": "Evie",
    "charge hub": "ChargeHub",
    "chargehub": "ChargeHub",
    "nrma electric": "NRMA",
    "jolt": "JOLT",
    "wevolt": "Wevolt",
    "noodoe ev": "Noodoe",
    "ampol ampcharge": "Ampol",
    "ampcharge": "Ampol",
    "viva energy a": "Viva Energy Australia",
    "plus es manag": "PLUS ES",
    "plus es": "PLUS ES",
    "energy austra": "Energy Australia",
    "fast cities a": "Fast Cities Australia",
    "university of": "University of Wollongong",
}
# Spellings of a missing cell in delimited text.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

#: White space as Unicode has it, and the four separators below the space.
WS = r"[\s\x1c-\x1f]"
U = "(?U)"


def or_null(c: Column) -> Column:
    """The empty string as NULL."""
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"{U}^{WS}+|{WS}+\z", "")


def squash(c: Column) -> Column:
    """Runs of white space as one space, none at the ends, NULL if nothing is left."""
    return or_null(strip(F.regexp_replace(c, rf"{U}{WS}+", " ")))


def one_line(c: Column) -> Column:
    """Line breaks, with the space around them, as ", "; other inner space stays."""
    return or_null(F.regexp_replace(strip(c), rf"{U}{WS}*[\r\n]+{WS}*", ", "))


def missing_to_null(c: Column) -> Column:
    return F.when(c.isin(*MISSING), F.lit(None)).otherwise(c)


def canonical_name(c: Column, aliases: dict[str, str] = OPERATOR_ALIASES) -> Column:
    """One spelling per name: squashed, without one trailing parenthesis, known variants by their alias."""
    base = or_null(F.regexp_replace(squash(c), r" ?\([^)]*\)\z", ""))
    table = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair)) if aliases else F.create_map().cast("map<string,string>")
    return F.coalesce(F.element_at(table, F.lower(base)), base)


def number(c: Column) -> Column:
    """A double, NULL for what isn't written as a finite decimal number."""
    plain = F.trim(c)
    return F.when(plain.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), plain.try_cast("double"))


def whole(c: Column) -> Column:
    """A bigint, also where the number is written with decimals that are all 0; NULL for what is no whole number."""
    return F.when(number(c) == F.rint(number(c)), F.coalesce(F.trim(c).try_cast("bigint"), number(c).try_cast("bigint")))


def rating_kw(c: Column) -> Column:
    """The largest number in a rating, counts such as "2x" aside."""
    tight = F.regexp_replace(F.lower(F.regexp_replace(c, rf"{U}{WS}+", "")), "[0-9]+x", "")
    found = F.transform(F.regexp_extract_all(tight, F.lit(r"[0-9][0-9.]*"), F.lit(0)), lambda x: x.try_cast("double"))
    return F.array_max(found)


def postcode(c: Column) -> Column:
    """The first four digits in a row."""
    return or_null(F.regexp_extract(c, "[0-9]{4}", 0))


# How a text says that charging costs nothing, the words for dollars and cents, and the unit.
FREE = ("free", "free to use", "free charging", "no charge")
DOLLAR, CENT, UNIT = ("$", "aud"), ("c", "cent", "cents"), "kwh"

AMOUNT = "[0-9]+(?:[.][0-9]+)?"


def _any(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join("[$]" if w == "$" else w for w in words) + ")"


def _zero(text: Column) -> Column:
    """0, or 0. and more zeros."""
    return (text == "0") | (text.startswith("0.") & (F.length(text) > 2) & (F.translate(text, "0", "") == "."))


def _spans_dash(text: Column) -> Column:
    """Whether an amount stands on either side of a dash."""
    parts = F.split(text, "[-–]", -1)
    before = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, r"\s+\z", ""), r"c\z", "").rlike(r"[0-9]\s*\z"))
    after = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, r"^\s+", ""), r"^[$]", "").rlike("^[0-9]"))
    return F.exists(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.coalesce(F.get(before, i) & F.get(after, i + 1), F.lit(False)))


def price_per_kwh(c: Column) -> Column:
    """Dollars per kWh: 0 for free, the one price that a text states in dollars or cents, NULL for ranges or several.

    The text is cut at each mention of the unit; what stands right before one is a price if it ends in an amount of money.
    """
    text = or_null(strip(c))
    low = F.lower(text)
    stated = F.split(low, rf"\s*(?:/|per)\s*{UNIT}", -1)
    stated = F.slice(stated, F.lit(1), F.size(stated) - 1)

    def money(said: Column) -> Column:
        dollars = F.regexp_extract(said, rf"{_any(DOLLAR)}\s*({AMOUNT})\z", 1).try_cast("double")
        cents = F.regexp_extract(said, rf"({AMOUNT})\s*{_any(CENT)}\z", 1).try_cast("double")
        return F.coalesce(dollars, cents / 100)

    prices = F.array_distinct(F.filter(F.transform(stated, money), lambda p: p.isNotNull()))
    return F.when(low.isin(*FREE) | _zero(low), F.lit(0.0)).when(_spans_dash(text), F.lit(None)).when(F.size(prices) == 1, F.get(prices, F.lit(0)))


def number_range(address: Column) -> Column:
    """struct(low, high) of the street numbers that an address begins with; NULL fields without one. A second number
    counts if it follows a dash or slash at once."""
    begin = F.regexp_replace(address, r"^\s+", "")
    digits = lambda s: F.regexp_extract(s, "^[0-9]+", 0)
    rest = F.regexp_replace(F.substring(begin, F.length(digits(begin)) + 1, F.length(begin)), r"^\s+", "")
    first = digits(begin).try_cast("bigint")
    second = F.when(rest.startswith("-") | rest.startswith("/"), digits(F.substring(rest, F.lit(2), F.length(rest))).try_cast("bigint"))
    return F.struct(F.least(first, second).alias("low"), F.greatest(first, second).alias("high"))


def range_gap(a: Column, b: Column) -> Column:
    """How far two ranges are apart; 0 or less if they meet, NULL if one is missing."""
    return F.when(a["low"].isNotNull() & b["low"].isNotNull(), F.greatest(a["low"] - b["high"], b["low"] - a["high"]))


def address_conflict(a: Column, b: Column, tolerance: int = 10) -> Column:
    return F.coalesce(range_gap(number_range(a), number_range(b)) > tolerance, F.lit(False))


def street_address(line1: Column, line2: Column) -> Column:
    """The line that begins with a number, the second first; else both."""
    digit = r"^\s*[0-9]"
    return F.when(line2.rlike(digit), line2).when(line1.rlike(digit), line1).otherwise(or_null(F.concat_ws(", ", or_null(line1), or_null(line2))))


def first_filled(*columns: Column) -> Column:
    """The first that is neither NULL nor empty."""
    return F.coalesce(*(or_null(c) for c in columns))


def joined(values: Column, dropped: tuple[str, ...] = ("", "Unknown")) -> Column:
    """Distinct values in the order first seen, without those dropped, joined by ", "; NULL if none is left."""
    kept = F.array_distinct(F.filter(values, lambda x: x.isNotNull() & ~x.isin(*dropped)))
    return or_null(F.array_join(kept, ", "))
