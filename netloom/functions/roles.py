"""Capability bitmaps and the roles they give."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Capabilities from the highest bit of the first byte down.
CAPABILITIES = ("other", "repeater", "bridge", "wlan-ap", "router", "telephone", "docsis", "station")
INFRASTRUCTURE = ("bridge", "wlan-ap", "router")


def capability_byte(bitmap: Column) -> Column:
    """The first byte of a bitmap in hex, null if it is no even number of hex digits."""
    digits = F.regexp_replace(F.regexp_replace(F.lower(bitmap), r"^\s*0x", ""), r"[\s:]", "")
    return F.when(digits.rlike("^([0-9a-f]{2})+$"), F.conv(F.substring(digits, 1, 2), 16, 10).cast("int"))


def _has(byte: Column, name: str) -> Column:
    return F.coalesce(byte.bitwiseAND(0x80 >> CAPABILITIES.index(name)) > 0, F.lit(False))


def decode_capabilities(bitmap: Column) -> Column:
    """Names of the capabilities, in bit order; [] for what is no bitmap."""
    byte = capability_byte(bitmap)
    return F.array_compact(F.array(*(F.when(_has(byte, n), F.lit(n)) for n in CAPABILITIES)))


def role_of_capabilities(bitmap: Column) -> Column:
    byte = capability_byte(bitmap)
    return (
        F.when(_has(byte, "router") & _has(byte, "bridge"), "l3-switch")
        .when(_has(byte, "bridge"), "l2-switch")
        .when(_has(byte, "router"), "router")
        .when(_has(byte, "wlan-ap"), "access-point")
        .when(_has(byte, "telephone"), "phone")
        .when(_has(byte, "station"), "station")
    )


def derive_role(bitmap: Column, kind: Column | str) -> Column:
    """The role of the capabilities; without one an endpoint is a host and a device is unknown."""
    is_endpoint = (kind if isinstance(kind, Column) else F.lit(kind)) == "endpoint"
    return F.coalesce(role_of_capabilities(bitmap), F.when(is_endpoint, "host").otherwise("Unknown Network Device"))


def is_infrastructure(management_ip: Column, bitmap: Column) -> Column:
    """A neighbour with a management address, or one that forwards."""
    byte = capability_byte(bitmap)
    forwards = _has(byte, "bridge") | _has(byte, "wlan-ap") | _has(byte, "router")
    return F.coalesce(management_ip != "", F.lit(False)) | forwards
