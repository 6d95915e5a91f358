"""MAC addresses: one key for every spelling, one display form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DOTTED_QUAD = r"^\s*\d{1,3}(\.\d{1,3}){3}\s*$"


def canonical_mac(value: Column) -> Column:
    """Twelve lower-case hex digits, or null for anything else; an IPv4 address is not a MAC."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(value), r"^\s*0x", ""), r"[\s:.\-]", "")
    return F.when(bare.rlike("^[0-9a-f]{12}$") & ~value.rlike(_DOTTED_QUAD), bare)


def canonical_mac_bytes(value: Column) -> Column:
    """The key of a MAC in six raw bytes; other lengths are read as text."""
    return F.when(F.length(value) == 6, F.lower(F.hex(value))).otherwise(canonical_mac(value.cast("string")))


def colon_form(key: Column) -> Column:
    """A key with colons, as it is shown."""
    return F.regexp_replace(key, "(..)(?!$)", "$1:")


def format_mac(value: Column) -> Column:
    return colon_form(canonical_mac(value))


def is_locally_administered(value: Column) -> Column:
    """The second lowest bit of the first octet; true for what is no MAC, so that it is never chosen."""
    octet = F.conv(F.substring(canonical_mac(value), 1, 2), 16, 10).cast("int")
    return F.coalesce(octet.bitwiseAND(2) > 0, F.lit(True))


def collapse_whitespace(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def normalize_chassis_id(value: Column) -> Column:
    """The colon form of a MAC, else the text in lower case without a leading 0x; null if nothing is left."""
    text = collapse_whitespace(F.regexp_replace(F.lower(value), r"^\s*0x", ""))
    return F.coalesce(format_mac(value), F.nullif(text, F.lit("")))
