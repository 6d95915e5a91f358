"""The scenario as the rows that collectors would land: walks, inventory answers, search hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import oid as O
from netloom.functions.vendors import FORTINET_SERIAL, FORTINET_VERSION
from netloom.operators.crawl import SYSTEM
from netloom.sources.scenario import Scenario


def _octets(mac: Column) -> Column:
    return F.array_join(F.transform(F.split(mac, ":"), lambda x: F.conv(x, 16, 10)), ".")


def _oid(base: str, *index: Column) -> Column:
    return F.concat_ws(".", F.lit(base), *index)


def spelled(mac: Column, way: Column) -> Column:
    """A MAC in one of five spellings."""
    bare = F.regexp_replace(mac, ":", "")
    dotted = F.concat_ws(".", F.substring(bare, 1, 4), F.substring(bare, 5, 4), F.substring(bare, 9, 4))
    return F.when(way == 0, mac).when(way == 1, F.upper(F.regexp_replace(mac, ":", "-"))).when(way == 2, F.concat(F.lit("0x"), bare)).when(way == 3, F.concat(F.lit(" "), F.regexp_replace(mac, ":", " "), F.lit(" "))).otherwise(dotted)


def _walk(rows: DataFrame, device: Column, seq: Column, oid: Column, value: Column, base: str, context: Column | None = None) -> DataFrame:
    return rows.select(device.alias("device_ip"), (F.lit("") if context is None else context).alias("context"), F.lit(base).alias("base_oid"), seq.cast("long").alias("seq"), oid.alias("oid"), value.cast("string").alias("value"))


def port_number(port: Column) -> Column:
    """Bridge port of a port Gi0/n; 99 for the port of the device itself."""
    return F.when(port.startswith("Gi0/"), F.regexp_extract(port, r"(\d+)$", 1).cast("int") + 1).otherwise(99)


def forwarding_walks(s: Scenario) -> DataFrame:
    """802.1Q rows for devices at even places, flat rows for the others. Every other of those has them in its
    VLANs' contexts, of which 30 isn't operational; every fourth device with 802.1Q rows has both."""
    ip = F.format_string("10.0.%d.254", "pos")
    bridge = port_number(F.col("port"))
    tagged = s.fdb.filter("pos % 2 = 0")
    flat = s.fdb.filter("pos % 2 = 1 OR (pos % 8 = 0 AND vlan <> 1)")
    by_vlan = (F.col("pos") % 4 == 1) | (F.col("pos") % 8 == 0)
    context = F.when(by_vlan, F.col("vlan").cast("string")).otherwise(F.lit(""))
    states = s.devices.filter("pos < 1000").filter(by_vlan).withColumn("vlan", F.explode(F.array(*map(F.lit, (1, 10, 20, 30)))))
    switches = s.devices.filter("pos < 1000").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(10))))
    index = (10000 + F.col("n")).cast("string")
    name = F.concat(F.lit("Gi0/"), F.col("n") - 1)
    named = F.col("pos") % 5 != 0
    contexts = flat.select("pos", context.alias("context")).distinct().unionByName(s.devices.filter("pos < 1000 AND pos % 2 = 0").select("pos", F.lit("").alias("context")))
    base_ports = contexts.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(10))))
    walks = [
        _walk(tagged, ip, F.col("seq"), _oid(O.DOT1Q_FDB_PORT, F.col("vlan"), _octets(F.col("mac"))), bridge, O.DOT1Q_FDB_PORT),
        _walk(flat, ip, F.col("seq"), _oid(O.DOT1D_FDB_PORT, _octets(F.col("mac"))), bridge, O.DOT1D_FDB_PORT, context),
        _walk(base_ports, ip, F.col("n"), _oid(O.BASEPORT_IFINDEX, F.col("n")), 10000 + F.col("n"), O.BASEPORT_IFINDEX, F.col("context")),
        _walk(switches.filter(named), ip, F.col("n"), _oid(O.IFNAME, index), name, O.IFNAME),
        _walk(switches, ip, F.col("n"), _oid(O.IFDESCR, index), F.concat(F.lit("GigabitEthernet0/"), F.col("n") - 1), O.IFDESCR),
        _walk(switches, ip, F.col("n"), _oid(O.IFOPERSTATUS, index), F.when(F.col("n") % 3 == 0, "2").when(F.col("n") % 3 == 1, "1").otherwise("up(1)"), O.IFOPERSTATUS),
        _walk(switches, ip, F.col("n"), _oid(O.IFPHYS, index), F.when(F.col("n") < 3, F.col("own_mac")), O.IFPHYS),
        _walk(switches, ip, F.col("n"), _oid(O.VLAN_STATIC_NAME, F.col("n") * 10), F.when(F.col("n") != 4, F.concat(F.lit("vlan"), F.col("n"))), O.VLAN_STATIC_NAME),
        _walk(switches, ip, F.col("n"), _oid(O.VTP_VLAN_STATE, F.lit(1), F.col("n") * 150), F.when(F.col("n") % 4 == 3, "2").otherwise("1"), O.VTP_VLAN_STATE),
        _walk(states, ip, F.col("vlan"), _oid(O.VTP_VLAN_STATE, F.lit(1), F.col("vlan")), F.when((F.col("vlan") == 30) & (F.col("pos") % 4 == 1), "2").otherwise("1"), O.VTP_VLAN_STATE),
    ]
    arp = s.arp
    walks.append(_walk(arp, F.lit("10.0.0.254"), F.col("seq"), _oid(O.ARP, F.lit(7), F.col("ip")), spelled(F.col("mac"), F.col("seq") % 5), O.ARP))
    out = walks[0]
    for more in walks[1:]:
        out = out.unionByName(more)
    return out


def neighbor_walks(s: Scenario) -> DataFrame:
    """What every device reports of the devices and endpoints at its links, as cells of the remote table."""
    info = s.devices.select(F.col("chassis_id").alias("target"), F.col("ip").alias("target_ip"), F.col("hostname").alias("target_name"), "lldp_cap_enabled")
    down = s.links.select("seq", F.col("source_chassis_id").alias("reporter"), F.col("target_chassis_id").alias("target"), "local_port", "remote_port")
    up = s.links.filter("seq < 1000").select((F.col("seq") + 500).alias("seq"), F.col("target_chassis_id").alias("reporter"), F.col("source_chassis_id").alias("target"), F.col("remote_port").alias("local_port"), F.col("local_port").alias("remote_port"))
    reporters = s.devices.filter("ip IS NOT NULL").select(F.col("chassis_id").alias("reporter"), F.col("ip").alias("reporter_ip"))
    links = down.unionByName(up).join(reporters, "reporter").join(info, "target")
    cells = F.map_from_arrays(F.array(*map(F.lit, ("5", "7", "8", "9", "10", "12"))), F.array(spelled(F.col("target"), F.col("seq") % 5), F.when(F.col("seq") % 3 == 0, F.lit("")).otherwise(F.col("remote_port")), F.concat(F.lit("port "), F.col("remote_port")), F.coalesce("target_name", F.lit("")), F.lit("Cisco IOS  Software, C2960S Software"), F.col("lldp_cap_enabled")))
    exploded = links.select("seq", "reporter_ip", F.explode(cells).alias("col", "value"))
    remote = _walk(exploded, F.col("reporter_ip"), F.col("seq"), _oid(O.LLDP_REM, F.col("col"), F.lit(0), F.col("seq"), F.lit(1)), F.col("value"), O.LLDP_REM)
    addressed = links.filter("target_ip IS NOT NULL")
    management = _walk(addressed, F.col("reporter_ip"), F.col("seq"), _oid(O.LLDP_MAN_ADDR, F.lit(3), F.lit(0), F.col("seq"), F.lit(1), F.lit(1), F.lit(4), F.col("target_ip")), F.lit("1"), O.LLDP_MAN_ADDR)
    six = _walk(addressed, F.col("reporter_ip"), F.col("seq") - 1, _oid(O.LLDP_MAN_ADDR, F.lit(3), F.lit(0), F.col("seq"), F.lit(1), F.lit(2), F.lit(16), F.lit("254.128.0.0.0.0.0.0.0.0.0.0.0.0.0.1")), F.lit("1"), O.LLDP_MAN_ADDR)
    local = _walk(links, F.col("reporter_ip"), F.col("seq"), _oid(O.LLDP_LOC_PORT, F.lit(3), F.col("seq")), F.col("local_port"), O.LLDP_LOC_PORT)
    return remote.unionByName(management).unionByName(six).unionByName(local)


def system_walks(s: Scenario) -> DataFrame:
    """Identity values of the devices that answer: Cisco, Fortinet and one vendor that isn't registered."""
    n = F.col("pos").cast("int")
    way = n % 3
    described = F.when(way == 0, F.format_string("Cisco IOS Software, C%dS Software (C%dS-UNIVERSALK9-M), Version 12.2(%d)SE5, RELEASE", 2000 + n, 2000 + n, n)).when(way == 1, F.lit("")).otherwise(F.lit("MikroTik RouterOS"))
    enterprise = F.when(way == 0, F.lit("1.3.6.1.4.1.9.1.1208")).when(way == 1, F.lit("1.3.6.1.4.1.12356.101.1.1041")).otherwise(F.lit("1.3.6.1.4.1.14988.1"))
    values = {"sys_descr": described, "sys_object_id": enterprise, "sys_name": F.col("hostname"), "loc_chassis": F.upper("chassis_id"), "cap_enabled": F.col("lldp_cap_enabled"), "fortinet_version": F.when(way == 1, F.format_string("v6.0.%d,build0505,221215 (GA)", n)), "fortinet_serial": F.when(way == 1, F.format_string("FG%05d", n))}
    assert SYSTEM["fortinet_version"] == FORTINET_VERSION and SYSTEM["fortinet_serial"] == FORTINET_SERIAL
    pairs = F.array(*(F.struct(F.lit(SYSTEM[k]).alias("oid"), v.alias("value")) for k, v in values.items()))
    rows = s.devices.filter("pos < 1000 AND pollable").select("ip", F.posexplode(pairs).alias("k", "x"))
    return _walk(rows, F.col("ip"), F.col("k"), F.col("x.oid"), F.col("x.value"), "system")


def inventory(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """agents, netiface, netaddr and hardware of the customers; each has three interfaces."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key = F.col("c_custkey")
    agent = F.format_string("%05d", key)
    ip = F.concat_ws(".", F.lit("10"), F.col("c_nationkey"), (key / 250).cast("int") % 250, key % 250)
    agents = customer.select(F.format_string("%03d", key - 1).alias("id"), F.col("c_name").alias("name"), F.when(key % 7 != 0, ip).alias("ip"), F.lit("active").alias("status"), F.when(key % 9 != 0, F.struct(F.col("c_mktsegment").alias("platform"), F.lit("OS").alias("name"), F.format_string("%d.0", key % 4).alias("version"))).alias("os"))
    numbered = customer.select(key.alias("k"), agent.alias("agent_id"), ip.alias("ip"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("pos"))
    k, pos = F.col("k"), F.col("pos")
    name = F.when((pos == 0) & (k % 4 == 0), "vEthernet 0").otherwise(F.concat(F.lit("eth"), pos))
    mac = F.format_string("%s:a7:00:%02x:%02x:%02x", F.when((k + pos) % 6 == 0, "06").otherwise("04"), (k / 256).cast("int") % 256, (k % 256).cast("int"), pos)
    netiface = numbered.select("agent_id", "pos", name.alias("name"), mac.alias("mac"), F.when((k + pos) % 3 == 0, "up").otherwise("down").alias("state"))
    address = F.when((k + pos) % 5 == 0, F.concat(F.lit("169.254.1."), pos)).when(pos == 2, F.col("ip")).otherwise(F.format_string("172.16.%d.%d", (k % 250).cast("int"), pos))
    proto = F.when((k + pos) % 7 == 0, "ipv6").otherwise("IPv4")
    netaddr = numbered.select("agent_id", "pos", name.alias("iface"), proto.alias("proto"), address.alias("address"))
    serial = F.when(k % 5 == 0, "").when(k % 5 == 1, "To be filled by O.E.M.").when(k % 5 == 2, "0").otherwise(F.concat(F.lit("SN"), k))
    hardware = numbered.filter("pos < 2").select("agent_id", "pos", F.when(pos == 0, serial).otherwise("second").alias("board_serial"))
    asked = customer.select(agent.alias("agent_id"), F.when(key % 7 != 0, ip).alias("ip"))
    return {"agents": agents, "netiface": netiface, "netaddr": netaddr, "hardware": hardware, "asked": asked}


def search_hits(s: Scenario) -> DataFrame:
    """Findings as nested search hits."""
    score = F.struct(F.col("cvss").alias("base"), F.lit("3.1").alias("version"))
    severity = F.when(F.col("cvss") >= 7, "High").otherwise("Low")
    v = F.struct(F.col("cve").alias("id"), severity.alias("severity"), F.lit(None).cast("string").alias("description"), score.alias("score"))
    p = F.struct(F.concat(F.lit("pkg-"), F.substring("cve", -1, 1)).alias("name"), F.lit("1.0").alias("version"))
    return s.findings.select("agent_id", F.struct(v.alias("vulnerability"), p.alias("package")).alias("_source"))


def routes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A host's routes (one for each supplier) and its adapters; interface 6 has none."""
    key = F.col("s_suppkey").cast("int")
    hop = F.when(key % 11 == 0, "127.0.0.1").otherwise(F.format_string("10.0.%d.%d", F.col("s_nationkey").cast("int"), key % 250 + 1))
    made = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(key.cast("long").alias("seq"), F.when(key % 3 == 0, "0.0.0.0/0").otherwise("10.0.0.0/8").alias("destination"), hop.alias("next_hop"), (key % 7).alias("if_index"), (key % 5 * 10).alias("metric"))
    n = F.col("n_nationkey").cast("int")
    named = F.when(n % 3 == 0, "Intel Ethernet").when(n % 3 == 1, "VMware Virtual Adapter").otherwise("Hyper-V vEthernet")
    return made, spark.read.parquet(f"{sf_dir}/nation.parquet").filter("n_nationkey < 6").select(n.alias("if_index"), named.alias("description"))


def seed_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines of a routing table and of a report of neighbours, a few for each nation."""
    n = F.col("n_nationkey").cast("int")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    value = F.when(n % 5 == 0, F.format_string("default via 10.0.%d.1 dev eth0", n)).when(n % 5 == 1, F.format_string("default  10.0.%d.1 UGSc en0", n - 1)).when(n % 5 == 2, F.lit("0.0.0.0 127.0.0.1 UH")).when(n % 5 == 3, F.format_string("10.0.%d.0/24 dev eth0 src 10.0.%d.7", n, n)).otherwise(F.lit("default via fe80::1"))
    routing = nation.select(n.cast("long").alias("line"), value.alias("value"))
    said = F.when(n % 2 == 0, F.format_string("lldp.eth0.chassis.mgmt-ip=10.0.%d.1", n)).otherwise(F.format_string("lldp.eth0.chassis.name=10.0.%d.1", n))
    return routing, nation.select(n.cast("long").alias("line"), said.alias("value"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API answers as JSON text: the customers of each nation, and one answer without items."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    item = F.struct("c_custkey", F.struct(F.format_string("%03d", "c_custkey").alias("id"), F.col("c_name").alias("name")).alias("x"))
    listed = customer.groupBy("c_nationkey").agg(F.transform(F.array_sort(F.collect_list(item)), lambda e: e["x"]).alias("affected_items"))
    return listed.select(F.to_json(F.struct(F.struct("affected_items").alias("data"))).alias("value")).unionByName(spark.sql("SELECT '{\"error\": 0}' AS value"))
