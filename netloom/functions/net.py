"""Addresses of both families as keys, subnets as the heads of these, interface and gateway predicates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9])"
_IPV4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"

# Names of adapters that are no network cards.
VIRTUAL_NAMES = ("loopback", "npcap", "vmware", "virtualbox", "vbox", "hyper-v", "vethernet", "veth", "docker", "wsl", "tap", "tun", "bluetooth", "vpn", "npf")


def ipv4_number(ip: Column) -> Column:
    """The address as a long, null unless it is a strict dotted quad."""
    octets = [F.regexp_extract(ip, _IPV4, k).cast("long") for k in range(1, 5)]
    whole = sum((o * 256 ** (3 - k) for k, o in enumerate(octets)), F.lit(0))
    return F.when(ip.rlike(_IPV4), whole)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body looks at it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without_dotted_tail(ip: Column) -> Column:
    """An IPv6 address whose last 32 bits are written as a dotted quad, in groups; null if these are none."""

    def told(tail: Column) -> Column:
        number = ipv4_number(tail)
        groups = F.concat_ws(":", F.lower(F.hex(F.shiftright(number, 16))), F.lower(F.hex(number.bitwiseAND(F.lit(0xFFFF)))))
        return F.when(number.isNotNull(), F.concat(F.substr(ip, F.lit(1), F.length(ip) - F.length(tail)), groups))

    return F.when(F.contains(ip, F.lit(".")), let(F.substring_index(ip, ":", -1), told)).otherwise(ip)


def _ipv6_digits(ip: Column) -> Column:
    """The 32 hex digits of an IPv6 address in any of its forms (compressed, with a dotted tail, with a zone),
    null for other text."""

    def groups(text: Column) -> Column:
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":"))

    def spread(halves: Column) -> Column:  # one half for an address without a gap, two for one with
        sides = F.struct(groups(F.get(halves, F.lit(0))).alias("left"), groups(F.coalesce(F.get(halves, F.lit(1)), F.lit(""))).alias("right"))

        def filled(x: Column) -> Column:
            known = F.size(x["left"]) + F.size(x["right"])
            fits = F.when(F.size(halves) == 1, known == 8).otherwise((F.size(halves) == 2) & (known <= 7))
            return F.when(fits, F.concat(x["left"], F.array_repeat(F.lit("0"), F.greatest(8 - known, F.lit(0))), x["right"]))

        return let(sides, filled)

    def digits(whole: Column) -> Column:
        return F.when(F.forall(whole, lambda g: g.rlike("^[0-9a-f]{1,4}$")), F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), ""))

    plain = _without_dotted_tail(F.regexp_replace(F.lower(ip), "%[^%/]+$", ""))
    return F.when(F.contains(ip, F.lit(":")), let(let(F.split(plain, "::"), spread), digits))


def address_key(ip: Column) -> Column:
    """"4" and 8 hex digits, or "6" and 32: equal for all spellings of an address; null for other text."""
    return F.coalesce(F.concat(F.lit("4"), F.lpad(F.lower(F.hex(ipv4_number(ip))), 8, "0")), F.concat(F.lit("6"), _ipv6_digits(ip)))


def subnet_key(ip: Column, prefix: int = 24) -> Column:
    """The first ``prefix`` bits of the address under the mark of its family: equal for addresses of one network, so
    the join key of a subnet match. Null if the family has fewer bits."""
    digits, bits = divmod(prefix, 4)

    def head(key: Column) -> Column:
        whole = F.substring(key, 1, 1 + digits)
        if bits:
            masked = F.conv(F.substring(key, 2 + digits, 1), 16, 10).cast("int").bitwiseAND(F.lit(0xF & (0xF << (4 - bits))))
            whole = F.concat(whole, F.lower(F.hex(masked)))
        return F.when(F.length(key) * 4 - 4 >= prefix, whole)

    return let(address_key(ip), head)


def same_subnet(a: Column, b: Column, prefix: int = 24) -> Column:
    return F.coalesce(subnet_key(a, prefix) == subnet_key(b, prefix), F.lit(False))


def is_routable_gateway(ip: Column) -> Column:
    """A valid address that is not unspecified, loopback or multicast; an IPv4 address mapped into IPv6 is judged as such."""

    def judged(key: Column) -> Column:
        four = F.when(key.startswith("4"), F.substring(key, 2, 8)).when(key.startswith("6" + "0" * 20 + "ffff"), F.substring(key, 26, 8))
        return let(four, lambda x: F.when(x.isNotNull(), (x != "0" * 8) & (F.substring(x, 1, 2) != "7f") & (F.substring(x, 1, 1) != "e")).otherwise(~(key.isin("6" + "0" * 32, "6" + "0" * 31 + "1") | key.startswith("6ff"))))

    return F.coalesce(let(address_key(ip), judged), F.lit(False))


def is_host_address(proto: Column, address: Column) -> Column:
    """IPv4, not empty and not self-assigned."""
    return F.coalesce((F.lower(proto) == "ipv4") & (address != "") & ~address.startswith("169.254."), F.lit(False))


def has_virtual_name(name: Column) -> Column:
    return F.lower(F.coalesce(name, F.lit(""))).rlike("|".join(VIRTUAL_NAMES))
