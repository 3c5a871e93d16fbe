"""Tolerant conversions of loosely typed event fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of a missing id.
NO_ID = ("", "nan", "none")
#: Spellings of a missing string in a table column.
NO_TEXT = ("nan", "none", "<na>", "nat", "null")


def safe_float(value: Column, default: float = 0.0) -> Column:
    """A finite double, or default."""
    number = value.try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != F.lit(float("inf")))
    return F.when(finite, number).otherwise(F.lit(default))


def safe_int(value: Column, default: int = 0) -> Column:
    """The whole part of a number, or default."""
    return F.coalesce(value.try_cast("double").try_cast("long"), F.lit(default).cast("long"))


def blank_to(value: Column, default: str) -> Column:
    """value without outer space, default where nothing is left."""
    text = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    return F.when(text == "", F.lit(default)).otherwise(text)


def address(value: Column) -> Column:
    return blank_to(value, "UNKNOWN")


def protocol(value: Column, default: str = "TCP") -> Column:
    return F.upper(blank_to(value, default))


def event_id(value: Column) -> Column:
    """An event's flow id as a string, null if it is missing under any spelling."""
    text = F.trim(value.cast("string"))
    return F.when(text.isNotNull() & ~F.lower(text).isin(*NO_ID), text)


def label_id(value: Column) -> Column:
    """A label table's flow id: as event_id(), and a number that went through a float loses its ".0"."""
    return F.regexp_replace(event_id(value), r"\.0$", "")


def table_text(value: Column) -> Column:
    """A string that is never null: spellings of missing values become empty."""
    text = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    return F.when(F.lower(text).isin(*NO_TEXT), F.lit("")).otherwise(text)


def plain_address(value: Column) -> Column:
    """Lower case, and an IPv4 address mapped into IPv6 as plain IPv4."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(value.cast("string"), F.lit("")))), "^::ffff:", "")


def prefix24(value: Column) -> Column:
    """The first three parts of a dotted address, empty for other addresses."""
    return F.when(F.size(F.split(value, r"\.")) == 4, F.substring_index(value, ".", 3)).otherwise(F.lit(""))


def port(value: Column) -> Column:
    """A port number, null outside 0 to 65535."""
    number = value.try_cast("double").try_cast("long")
    return F.when(number.between(0, 65535), number)


def truthy(value: Column) -> Column:
    """Whether a JSON value (as text, strings in their quotes) is neither absent, false, zero nor empty."""
    text = F.trim(value.cast("string"))
    number = text.try_cast("double")
    empty = text.isin("", "null", "false", '""', "[]", "{}") | (number == 0)
    return text.isNotNull() & ~F.coalesce(empty, F.lit(False))


#: Spellings of the two labels.
BENIGN_WORDS = ("0", "0.0", "false", "no", "benign", "normal", "negative", "clean", "safe")
ATTACK_WORDS = ("1", "1.0", "true", "yes", "attack", "malicious", "malware", "positive", "bad")


def binary_label(value: Column, strict: bool = True) -> Column:
    """0 or 1 from a label's many spellings; an unknown one raises an error, or is null if not strict."""
    text = F.lower(F.trim(value.cast("string")))
    number = text.try_cast("double").try_cast("long")
    bad = F.raise_error(F.concat(F.lit("unrecognised label: "), F.coalesce(text, F.lit("null")))).cast("int") if strict else F.lit(None).cast("int")
    return F.when(text.isin(*BENIGN_WORDS), 0).when(text.isin(*ATTACK_WORDS), 1).when(number.isNotNull(), (number != 0).cast("int")).otherwise(bad)


#: Labels that stand for benign traffic in different data sets.
BENIGN_LABELS = ("benign", "normal", "background", "0")


def plain_label(value: Column) -> Column:
    """A label in lower case, all words for benign traffic as one."""
    text = F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))
    return F.when(text.isin(*BENIGN_LABELS), F.lit("benign")).otherwise(text)


#: Attack families, in the order in which their marks are looked for.
FAMILIES = (
    ("Bot", ("bot",)),
    ("Backdoor", ("backdoor",)),
    ("DDoS", ("ddos",)),
    ("DoS", ("dos",)),
    ("Bruteforce", ("brute", "ssh", "ftp")),
    ("Recon", ("recon", "scan", "sweep")),
    ("WebAttacks", ("web", "sql", "xss", "injection")),
)


def attack_family(value: Column, custom: dict[str, str] | None = None) -> Column:
    """The family of an attack name, null if none fits; custom maps whole names (any case) first."""
    text = F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))
    out = F.when(text.isin("", "benign", "none", "unknown", "normal"), F.lit(None).cast("string"))
    for family, marks in FAMILIES:
        hit = F.lit(False)
        for mark in marks:
            hit = hit | text.contains(mark)
        out = out.when(hit, F.lit(family))
    if not custom:
        return out
    pairs = [F.lit(x) for k, v in custom.items() for x in (k.strip().lower(), v)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), text), out)
