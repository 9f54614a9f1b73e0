"""Text functions of the domain as column expressions.

All of them stay in the JVM. Each takes and returns columns; nulls are as stated.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Serbian Cyrillic letters and their Latin forms without marks.
CYRILLIC = "абвгдежзијклмнопрстћуфхцчш"
LATIN = "abvgdezzijklmnoprstcufhccs"
DIGRAPHS = {"ђ": "dj", "љ": "lj", "њ": "nj", "џ": "dz"}


def _bare_letters() -> tuple[str, str]:
    """Letters that decompose into a base letter and marks, and their bases."""
    pairs = {}
    for code in [*range(0x00C0, 0x0250), *range(0x0400, 0x0500), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(code))
        base = [c for c in parts if not unicodedata.category(c).startswith("M")]
        if len(parts) > 1 and len(base) == 1:
            pairs[chr(code)] = base[0]
    return "".join(pairs), "".join(pairs.values())


MARKED, BARE = _bare_letters()


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_space(c: Column) -> Column:
    """Without white space of any kind at the ends (``trim`` knows the space only)."""
    return F.regexp_replace(F.regexp_replace(c, r"^[\s\u001c-\u001f]+", ""), r"[\s\u001c-\u001f]+$", "")


def latin_lower(c: Column) -> Column:
    """Lower case in Latin letters without marks; null becomes empty."""
    out = F.translate(F.lower(F.coalesce(c, F.lit(""))), CYRILLIC, LATIN)
    for letter, pair in DIGRAPHS.items():
        out = F.replace(out, F.lit(letter), F.lit(pair))
    # Marks go after the letters are mapped, so a precomposed Cyrillic letter keeps a Cyrillic base.
    out = F.regexp_replace(F.translate(out, MARKED, BARE), r"\p{M}+", "")
    return F.replace(out, F.lit("đ"), F.lit("dj"))


def normalize_name(c: Column) -> Column:
    """A product name as words of a-z and 0-9, letters and numbers apart."""
    out = F.replace(latin_lower(c), F.lit("×"), F.lit("x"))
    out = F.regexp_replace(out, "(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])", " ")
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def clean_text(c: Column) -> Column:
    """White space runs as one space, none at the ends; empty becomes null."""
    return F.nullif(F.regexp_replace(strip_space(c), r"\s+", " "), F.lit(""))


# How quantities are written on labels.
NUMBER = r"(?:[1-9][0-9]{0,2}(?:\.[0-9]{3})+|[0-9]+(?:[.,][0-9]+)?)"
UNIT = (
    r"(?:kilograma?|kg|grama?|gr|g|mililit(?:ar|ra|ara)?|ml|litar(?:a)?|litr(?:a|e)?|l|kom(?:ad(?:a|i)?)?|pcs)"
)
MULTIPACK = rf"(?<![-a-z0-9])([0-9]+)\s*x\s*({NUMBER})\s*({UNIT})(?![a-z])"
SINGLE = rf"(?<![-a-z0-9])({NUMBER})\s*({UNIT})(?![a-z])"


def parse_quantity(c: Column) -> Column:
    """struct(value decimal(14,4), unit) in g, ml or piece; null where none is written or it is not positive.

    A multipack is looked for first. In an amount of a small unit, dots before
    groups of three digits are thousands separators; else comma and dot are
    decimal points.
    """
    plainer = F.replace(F.replace(latin_lower(c), F.lit("×"), F.lit("x")), F.lit("\u00a0"), F.lit(" "))

    def parts(text: Column) -> Column:
        many = F.regexp_like(text, F.lit(MULTIPACK))
        pick = lambda multi, single: F.when(many, F.regexp_extract(text, MULTIPACK, multi)).otherwise(F.regexp_extract(text, SINGLE, single))
        count = F.when(many, F.regexp_extract(text, MULTIPACK, 1)).otherwise(F.lit("1"))
        return F.struct(pick(2, 1).alias("amount"), pick(3, 2).alias("unit"), count.alias("count"))

    def quantity(p: Column) -> Column:
        amount, unit = p["amount"], p["unit"]
        large = unit.rlike("^(kg|kilogram.*|l|litar.*|litr.*)$")
        grouped = ~large & amount.rlike(r"^[1-9][0-9]{0,2}(\.[0-9]{3})+$")
        plain = F.when(grouped, F.replace(amount, F.lit("."), F.lit(""))).otherwise(F.replace(amount, F.lit(","), F.lit(".")))
        value = plain.try_cast("decimal(14,4)") * F.when(large, F.lit(1000)).otherwise(F.lit(1)) * p["count"].try_cast("decimal(10,0)")
        named = (
            F.when(unit.rlike("^(kg|kilogram.*|g|gr|gram.*)$"), "g").when(unit.rlike("^(ml|mililit.*|l|litar.*|litr.*)$"), "ml").otherwise("piece")
        )
        return F.when((unit != "") & (value > 0), F.struct(value.cast("decimal(14,4)").alias("value"), named.alias("unit")))

    return let(let(F.regexp_replace(plainer, r"\s+", " "), parts), quantity)


def is_ean(c: Column) -> Column:
    """Is the text an EAN-8 or EAN-13 with the right check digit, and not all zeros?"""

    def check(code: Column) -> Column:
        shaped = code.rlike("^([0-9]{8}|[0-9]{13})$") & ~code.rlike("^0+$")
        digits = F.transform(F.split(F.reverse(F.when(shaped, code).otherwise(F.lit("0"))), ""), lambda d: d.cast("int"))
        weighed = F.transform(digits, lambda d, k: F.when(k == 0, F.lit(0)).otherwise(d * F.when(k % 2 == 1, F.lit(3)).otherwise(F.lit(1))))
        total = F.aggregate(weighed, F.lit(0), lambda a, x: a + x)
        return shaped & ((F.lit(10) - total % 10) % 10 == F.get(digits, F.lit(0)))

    return let(strip_space(F.coalesce(c, F.lit(""))), check)


def normalize_barcode(c: Column) -> Column:
    """8 to 14 digits that are not all zero, else null; the check digit is not looked at."""
    code = strip_space(c)
    return F.when(code.rlike("^[0-9]{8,14}$") & ~code.rlike("^0+$"), code)


def source_product_key(barcode: Column, name: Column, brand: Column, unit: Column, category: Column) -> Column:
    """The key of a product at its retailer: its barcode, or a digest of what describes it."""
    parts = [F.coalesce(F.lower(clean_text(c)), F.lit("")) for c in (name, brand, unit, category)]
    return F.when(barcode.isNotNull(), F.concat(F.lit("BARCODE:"), barcode)).otherwise(
        F.concat(F.lit("FINGERPRINT:"), F.sha2(F.concat_ws("|", *parts), 256))
    )


def _absent(c: Column) -> Column:
    return c.isNull() | F.lower(c).isin("-", "null", "n/a")


def clean_decimal(text: Column, kind: str = "decimal(12,2)") -> Column:
    """``parse_decimal`` of what ``clean_text`` gave."""
    scale = int(kind.rstrip(")").split(",")[1])
    only = lambda text, sep: F.regexp_replace(text, rf"[{sep}](?=.*[{sep}])", "")

    def number(x: Column) -> Column:
        comma, dot = F.contains(x, F.lit(",")), F.contains(x, F.lit("."))
        last_is_comma = F.instr(F.reverse(x), ",") < F.instr(F.reverse(x), ".")
        plain = (
            F.when(comma & dot & last_is_comma, F.replace(F.replace(x, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
            .when(comma & dot, F.replace(x, F.lit(","), F.lit("")))
            .when(comma, F.replace(only(x, ","), F.lit(","), F.lit(".")))
            .when(dot, only(x, "."))
            .otherwise(x)
        )
        return F.round(plain.try_cast(f"decimal(24,{scale + 6})"), scale).cast(kind)

    return F.when(~_absent(text), let(F.regexp_replace(text, "[\u00a0 ]", ""), number))


def parse_decimal(c: Column, kind: str = "decimal(12,2)") -> Column:
    """A number as people write it: the last comma or dot is the decimal point. Rounds half up; null if absent or wrong."""
    return let(clean_text(c), lambda text: clean_decimal(text, kind))


def clean_decimal_is_wrong(text: Column, number: Column) -> Column:
    """``decimal_is_wrong`` of what ``clean_text`` and, as decimal(24,6), ``clean_decimal`` gave."""
    return ~_absent(text) & number.isNull()


def decimal_is_wrong(c: Column) -> Column:
    """Something is written, and it is no number."""
    return ~_absent(clean_text(c)) & parse_decimal(c, "decimal(24,6)").isNull()


def clean_date(text: Column) -> Column:
    """``parse_date`` of what ``clean_text`` gave: days have no white space in them."""
    shaped = text.rlike(r"^[0-9]{2}-[0-9]{2}-[0-9]{4}$")
    day, month, year = (F.substring(text, a, n).try_cast("int") for a, n in ((1, 2), (4, 2), (7, 4)))
    fine = shaped & day.between(1, 31) & month.between(1, 12) & (year > 0)
    first = F.make_date(F.when(fine, year), F.when(fine, month), F.lit(1))
    return F.date_add(first, F.least(day, F.day(F.last_day(first))) - 1)


def parse_date(c: Column) -> Column:
    """dd-MM-yyyy; a day beyond the end of its month is its last day, as lenient parsers have it. Null if wrong."""
    return clean_date(strip_space(c))


def parse_active(c: Column) -> Column:
    """Yes and no in Serbian and English; blank is yes, anything else null."""
    text = F.lower(strip_space(F.coalesce(c, F.lit(""))))
    return F.when(text.isin("", "true", "1", "yes", "da"), True).when(text.isin("false", "0", "no", "ne"), False)


def parse_coordinate(c: Column, limit: float) -> Column:
    value = F.replace(clean_text(c), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(value.between(-limit, limit), value)


def format_code(c: Column) -> Column:
    """Upper case with underscores for white space; null unless it is a proper code."""
    code = F.regexp_replace(F.upper(strip_space(c)), r"\s+", "_")
    return F.when(code.rlike("^[A-Z0-9][A-Z0-9_-]{0,99}$"), code)


def token_hash(c: Column) -> Column:
    """SHA-256 of a client token of 1 to 100 characters, else null."""
    token = strip_space(c)
    return F.when(F.length(token).between(1, 100), F.sha2(token, 256))


# How a pasted line gives its quantity, in the order of trial.
_QUANTITY = r"([0-9]+(?:[.,][0-9]+)?)"
_PIECES = r"(?:kom(?:ad(?:a|i)?)?\.?|pcs)"
LINE_FORMS = (
    (rf"(?iu)^{_QUANTITY}\s*[x×]\s*(.+)$", 1, 2),
    (rf"(?iu)^{_QUANTITY}\s*{_PIECES}\s+(.+)$", 1, 2),
    (rf"(?iu)^(.+?)\s+[x×]\s*{_QUANTITY}$", 2, 1),
    (rf"(?iu)^(.+?)\s+(?:[-–—]\s*)?{_QUANTITY}\s+{_PIECES}$", 2, 1),
)


def paste_lines(c: Column) -> Column:
    """The lines of a pasted list: array of struct(line, name, quantity), blank lines with a null name."""

    def one(raw: Column) -> Column:
        line = F.regexp_replace(F.regexp_replace(raw, "^[\\x00-\\x20]+", ""), "[\\x00-\\x20]+$", "")
        name, quantity = line, F.lit("1")
        for pattern, q, n in reversed(LINE_FORMS):
            hit = F.regexp_like(line, F.lit(pattern))
            quantity = F.when(hit, F.regexp_extract(line, pattern, q)).otherwise(quantity)
            name = F.when(hit, F.trim(F.regexp_extract(line, pattern, n))).otherwise(name)
        return F.struct(
            raw.alias("line"),
            F.when(line != "", name).alias("name"),
            F.when(line != "", F.replace(quantity, F.lit(","), F.lit(".")).try_cast("decimal(20,6)")).alias("quantity"),
        )

    return F.transform(F.split(F.coalesce(c, F.lit("")), r"\R", -1), one)
