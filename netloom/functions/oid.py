"""Object identifiers, whose index arcs hold data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bases of the tables that walks read.
DOT1Q_FDB_PORT = "1.3.6.1.2.1.17.7.1.2.2.1.2"
DOT1D_FDB_PORT = "1.3.6.1.2.1.17.4.3.1.2"
BASEPORT_IFINDEX = "1.3.6.1.2.1.17.1.4.1.2"
IFNAME = "1.3.6.1.2.1.31.1.1.1.1"
IFDESCR = "1.3.6.1.2.1.2.2.1.2"
IFOPERSTATUS = "1.3.6.1.2.1.2.2.1.8"
VLAN_STATIC_NAME = "1.3.6.1.2.1.17.7.1.4.3.1.1"
VTP_VLAN_STATE = "1.3.6.1.4.1.9.9.46.1.3.1.1.2"
ARP = "1.3.6.1.2.1.4.22.1.2"
IFPHYS = "1.3.6.1.2.1.2.2.1.6"
LLDP_REM = "1.0.8802.1.1.2.1.4.1.1"
LLDP_MAN_ADDR = "1.0.8802.1.1.2.1.4.2.1"
LLDP_LOC_PORT = "1.0.8802.1.1.2.1.3.7.1"


def index_after(oid: Column, base: Column | str) -> Column:
    """What follows ``base.``, null for an identifier outside."""
    head = F.concat(F.regexp_replace(base if isinstance(base, Column) else F.lit(base), r"\.+$", ""), F.lit("."))
    return F.when(F.startswith(oid, head), F.substr(oid, F.length(head) + 1))


def oid_key(oid: Column) -> Column:
    """A binary key whose byte order is the order of the tree: each arc as the number of its bytes, then these.

    What lies below an identifier begins with its key. Null for anything but dotted numbers of up to 32 bits.
    """

    def coded(arc_: Column) -> Column:
        digits = F.hex(arc_.cast("long"))
        even = F.lpad(digits, F.length(digits) + F.length(digits) % 2, F.lit("0"))
        return F.when(arc_.cast("long") == 0, "00").otherwise(F.concat(F.lit("0"), (F.length(even) / 2).cast("int").cast("string"), even))

    in_range = F.forall(arcs(oid), lambda x: x.try_cast("long") <= 0xFFFFFFFF)
    return F.when(oid.rlike(r"^\d{1,10}(\.\d{1,10})*$"), F.when(in_range, F.unhex(F.array_join(F.transform(arcs(oid), coded), ""))))


def key_of(oid: str) -> bytes:
    """The same key of an identifier that is known beforehand."""
    numbers = [int(x) for x in oid.split(".")]
    widths = [(n.bit_length() + 7) // 8 for n in numbers]
    return b"".join(bytes([w]) + n.to_bytes(w, "big") for n, w in zip(numbers, widths))


def arcs(index: Column) -> Column:
    return F.split(index, r"\.")


def arc(index: Column, k: int) -> Column:
    """The arc with number k from 0, null if there is none."""
    return F.get(arcs(index), F.lit(k))


def arc_int(index: Column, k: int) -> Column:
    return arc(index, k).try_cast("int")


def octets_ok(octets: Column, n: int) -> Column:
    return (F.size(octets) == n) & F.forall(octets, lambda o: F.coalesce(o.try_cast("int").between(0, 255), F.lit(False)))


def mac_of_octets(octets: Column) -> Column:
    """The key of six decimal arcs, null for other numbers of arcs or values beyond a byte."""
    pairs = F.transform(octets, lambda o: F.lpad(F.lower(F.hex(o.try_cast("long"))), 2, "0"))
    return F.when(octets_ok(octets, 6), F.array_join(pairs, ""))


def mac_at(index: Column, first: int) -> Column:
    return mac_of_octets(F.slice(arcs(index), first + 1, 6))


def last_ipv4(index: Column) -> Column:
    """The last four of at least five arcs."""
    parts = arcs(index)
    return F.when(F.size(parts) >= 5, F.array_join(F.slice(parts, -4, 4), "."))
