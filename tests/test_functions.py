import ipaddress

import pytest
from pyspark.sql import functions as F

from netloom.functions import mac, net, oid, risk, roles, vendors

KEY = "e4a7a0000001"


def column(spark, values, make, kind="string"):
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in frame.orderBy("k").select(make(F.col("v"))).collect()]


def test_spellings_of_a_mac_have_one_key(spark):
    spelled = ["e4:a7:a0:00:00:01", "E4-A7-A0-00-00-01", "0xe4a7a0000001", " e4 a7 a0 00 00 01 ", "e4a7.a000.0001", "E4A7A0000001"]
    assert column(spark, spelled, mac.canonical_mac) == [KEY] * 6
    assert column(spark, [None, "", "switch-1", "e4:a7", "192.168.100.254"], mac.canonical_mac) == [None] * 5
    assert column(spark, [bytes.fromhex(KEY), b"e4:a7:a0:00:00:01", b"\xff\xfe"], mac.canonical_mac_bytes, "binary") == [KEY, KEY, None]
    assert column(spark, ["E4A7A0000001", "x"], mac.format_mac) == ["e4:a7:a0:00:00:01", None]


def test_local_macs_and_chassis_ids(spark):
    assert column(spark, ["02:00:4c:4f:4f:50", "04:00:00:00:00:01", "junk", None], mac.is_locally_administered) == [True, False, True, True]
    assert column(spark, ["0xE4A7A0000001", "0xCore  1 ", " ", None], mac.normalize_chassis_id) == ["e4:a7:a0:00:00:01", "core 1", None, None]


def test_addresses(spark):
    assert column(spark, ["10.1.2.3", "10.1.2.256", "10.1.2", "", None, "01.2.3.4"], net.ipv4_number) == [0x0A010203, None, None, None, None, None]
    near = lambda v: net.same_subnet(v, F.lit("10.1.2.200"))
    assert column(spark, ["10.1.2.1", "10.1.3.1", "x", None], near) == [True, False, False, False]
    assert column(spark, ["10.0.0.1", "0.0.0.0", "127.0.0.1", "239.1.1.1", "nope"], net.is_routable_gateway) == [True, False, False, False, False]


def test_object_identifiers(spark):
    assert column(spark, ["1.2.3.4", "1.2.34", "1.2.3", None], lambda v: oid.index_after(v, "1.2.3")) == ["4", None, None, None]
    assert column(spark, ["0.35.172.229.0.255", "0.35.172.229.0", "1.2.3.4.5.300", "a.2.3.4.5.6"], lambda v: oid.mac_at(v, 0)) == ["0023ace500ff", None, None, None]
    assert column(spark, ["7.10.0.0.1", "10.0.0.1"], oid.last_ipv4) == ["10.0.0.1", None]


def test_capabilities_and_roles(spark):
    maps = ["0x28", "0x20", "0x08", "0x10", "0x04", "0x01", "0x2800", "28 00", None, "", "zz", "0x2"]
    assert column(spark, maps, roles.role_of_capabilities) == ["l3-switch", "l2-switch", "router", "access-point", "phone", "station", "l3-switch", "l3-switch", None, None, None, None]
    assert column(spark, ["0xff", "0x00"], roles.decode_capabilities) == [list(roles.CAPABILITIES), []]
    assert column(spark, [None], lambda v: roles.derive_role(v, "endpoint")) == ["host"]
    assert column(spark, [None], lambda v: roles.derive_role(v, "device")) == ["Unknown Network Device"]
    assert column(spark, ["0x28", "0x01", None], lambda v: roles.is_infrastructure(F.lit(None).cast("string"), v)) == [True, False, False]


def test_vendors(spark):
    text = "Cisco IOS Software, C2960S Software (C2960S-UNIVERSALK9-M), Version 12.2(55)SE5, RELEASE"
    assert column(spark, [text, "", None], vendors.cisco_model) == ["C2960S", None, None]
    assert column(spark, [text, "Version x"], vendors.cisco_version) == ["12.2(55)SE5", None]
    assert column(spark, ["1.3.6.1.4.1.9.1", "1.3.6.1.4.1.12356", "1.3.6.2", None], vendors.enterprise_number) == ["9", "12356", None, None]
    assert column(spark, ["v6.0.16,build0505", "none"], vendors.fortinet_version) == ["6.0.16", None]
    assert column(spark, ["1.3.6.1.4.1.12356.101.1.1041.", "1.2.999999"], vendors.fortinet_model) == ["FortiGate 100E", None]


@pytest.mark.parametrize(("score", "name"), [(None, "unknown"), (0.0, "clean"), (3.0, "low"), (7.0, "high"), (9.0, "critical")])
def test_risk(spark, score, name):
    assert column(spark, [score], risk.risk_bucket, "double") == [name]


ADDRESSES = ["10.0.3.7", "10.0.3.250", "10.0.4.7", "0.0.0.0", "127.0.0.1", "224.0.0.5", "239.1.1.1", "240.0.0.1", "223.255.255.255", "300.1.1.1", "1.2.3", "::", "::1", "1::", "fe80::1", "fe80::1%eth0", "FE80:0:0:0:0:0:0:1", "ff02::5", "2001:db8:3::1", "2001:DB8:3:0:1::", "2001:db8:3:ffff::9", "::ffff:10.0.3.7", "::ffff:127.0.0.1", "::ffff:300.1.1.1", "64:ff9b::1.2.3.4", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1:2:3:4::5:6:7:8", "1::2::3", ":1::2", "1:2", "12345::", "g::1", "", None, ":", ":::", "1:2:3:4:5:6:1.2.3.4", "::1.2.3.4.5"]


def _parsed(text):
    try:
        return ipaddress.ip_address(text)
    except ValueError:
        return None


def test_addresses_of_both_families(spark):
    rows = spark.createDataFrame([(a,) for a in ADDRESSES], "ip string").select("ip", net.address_key(F.col("ip")).alias("key"), net.is_routable_gateway(F.col("ip")).alias("routable")).collect()
    for r in rows:
        address = _parsed(r.ip) if r.ip is not None else None
        assert r.key == (f"{address.version}{int(address):0{address.max_prefixlen // 4}x}" if address else None), r
        judged = getattr(address, "ipv4_mapped", None) or address
        assert r.routable == bool(address and not (judged.is_unspecified or judged.is_loopback or judged.is_multicast)), r


def test_subnets_of_both_families(spark):
    known = [a for a in ADDRESSES if a and _parsed(a) and "%" not in a]
    pairs = [(a, b) for a in known for b in known] + [("10.0.3.7", None), (None, "::1"), ("x", "::1")]
    frame = spark.createDataFrame(pairs, "a string, b string")
    for prefix in (0, 3, 24, 46, 64, 128):
        for a, b, same in frame.select("a", "b", net.same_subnet(F.col("a"), F.col("b"), prefix).alias("same")).collect():
            try:
                want = ipaddress.ip_address(b) in ipaddress.ip_network(f"{a}/{prefix}", strict=False)
            except ValueError:
                want = False
            assert same == want, (a, b, prefix)


def test_identifier_keys_sort_like_the_tree(spark):
    oids = ["1.3.6.1", "1.3.6.1.0", "1.3.6.1.2", "1.3.6.1.2.255", "1.3.6.1.2.256", "1.3.6.1.2.256.1", "1.3.6.1.2.65535", "1.3.6.1.2.65536", "1.3.6.1.2.4294967295", "1.3.6.1.10", "1.3.6.2", "1.3.60", "1.30"]
    bad = ["", ".1.3", "1.3.", "1.a", "1.4294967296", "1..3", None]
    rows = spark.createDataFrame([(o,) for o in oids + bad], "oid string").select("oid", oid.oid_key(F.col("oid")).alias("key")).collect()
    key = {r.oid: bytes(r.key) if r.key is not None else None for r in rows}
    assert all(key[b] is None for b in bad) and all(key[o] == oid.key_of(o) for o in oids)
    assert sorted(oids, key=key.get) == sorted(oids, key=lambda o: [int(x) for x in o.split(".")])
    for base in oids:
        assert {o for o in oids if key[base] < key[o] < key[base] + b"\xff"} == {o for o in oids if o.startswith(base + ".")}
