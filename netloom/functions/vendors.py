"""Vendor, model and firmware of a device from its system description and identifier.

A vendor registers as an expression, so that a run dispatches inside one plan:
``VENDORS`` maps the enterprise arc to a name and a function from the columns
sys_descr, sys_object_id and extra (a map of further values by identifier) to a
struct of model, firmware and serial.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from netloom.functions.models import FORTINET_MODELS

FORTINET_VERSION = "1.3.6.1.4.1.12356.101.4.1.1.0"
FORTINET_SERIAL = "1.3.6.1.4.1.12356.100.1.1.1.0"
# Words of a description, in the order in which they are looked for.
DESCRIPTION_WORDS = (("cisco", "Cisco"), ("fortigate", "Fortinet"), ("fortinet", "Fortinet"), ("juniper", "Juniper"), ("arista", "Arista"), ("mikrotik", "MikroTik"))
# What models and versions look like in the texts that devices give.
CISCO_MODEL = r"\b([A-Z0-9][A-Z0-9\-]+)\s+Software\b"
CISCO_VERSION = r"\bVersion\s+([0-9][0-9A-Za-z.()\-]*)"
FORTINET_RELEASE = r"v?(\d+\.\d+(?:\.\d+)?)"


def enterprise_number(object_id: Column) -> Column:
    """The arc after the enterprises' root, or null."""
    return F.nullif(F.regexp_extract(object_id, r"^1\.3\.6\.1\.4\.1\.([^.]*)", 1), F.lit(""))


def vendor_of_description(description: Column) -> Column:
    found = F.lit(None).cast("string")
    for word, name in reversed(DESCRIPTION_WORDS):
        found = F.when(F.contains(F.lower(description), F.lit(word)), name).otherwise(found)
    return found


def cisco_model(description: Column) -> Column:
    """The first word before "Software" other than IOS."""
    words = F.regexp_extract_all(description, F.lit(CISCO_MODEL), F.lit(1))
    return F.get(F.filter(words, lambda w: F.upper(w) != "IOS"), F.lit(0))


def cisco_version(description: Column) -> Column:
    found = F.regexp_extract(description, CISCO_VERSION, 1)
    return F.nullif(F.regexp_replace(found, r"[,.]+$", ""), F.lit(""))


def fortinet_model(object_id: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in FORTINET_MODELS.items() for x in pair))
    last = F.element_at(F.split(F.regexp_replace(object_id, r"\.+$", ""), r"\."), -1)
    return F.try_element_at(known, last)


def fortinet_version(raw: Column) -> Column:
    return F.nullif(F.regexp_extract(raw, FORTINET_RELEASE, 1), F.lit(""))


def _identified(model: Column, firmware: Column, serial: Column) -> Column:
    return F.struct(model.alias("model"), firmware.alias("firmware"), serial.alias("serial"))


Identify = Callable[[Column, Column, Column], Column]
VENDORS: dict[str, tuple[str, Identify]] = {
    "9": ("Cisco", lambda descr, oid, extra: _identified(cisco_model(descr), cisco_version(descr), F.lit(None).cast("string"))),
    "12356": ("Fortinet", lambda descr, oid, extra: _identified(fortinet_model(oid), fortinet_version(F.try_element_at(extra, F.lit(FORTINET_VERSION))), F.try_element_at(extra, F.lit(FORTINET_SERIAL)))),
}


def identify(descr: Column, object_id: Column, extra: Column, vendors: dict[str, tuple[str, Identify]] | None = None) -> Column:
    """Struct of vendor, model, firmware and serial; a vendor that isn't registered is guessed from the description."""
    vendors = VENDORS if vendors is None else vendors
    arc = enterprise_number(object_id)
    name = F.coalesce(vendor_of_description(descr), F.lit("unknown vendor"))
    blank = _identified(*(F.lit(None).cast("string") for _ in range(3)))
    details = blank
    for number, (vendor, known) in vendors.items():
        name = F.when(arc == number, vendor).otherwise(name)
        details = F.when(arc == number, known(descr, object_id, extra)).otherwise(details)
    return F.struct(name.alias("vendor"), details["model"].alias("model"), details["firmware"].alias("firmware"), details["serial"].alias("serial"))
