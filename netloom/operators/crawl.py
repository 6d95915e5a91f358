"""A crawl over landed walks: which devices a seed reaches, what is known of the rest, and what their tables say."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.mac import collapse_whitespace, format_mac, normalize_chassis_id
from netloom.functions.net import is_routable_gateway
from netloom.functions.vendors import FORTINET_SERIAL, FORTINET_VERSION, identify, vendor_of_description
from netloom.operators.graph import dedupe_links, numbered
from netloom.operators.walks import arp_rows, build_fdb, build_neighbors, own_macs, port_status, split_ports
from netloom.sources.landing import get_many
from netloom.sources.session import checkpoint

MAX_NODES = 5000
# The identifiers that a device's identity is read from.
SYSTEM = {"sys_descr": "1.3.6.1.2.1.1.1.0", "sys_object_id": "1.3.6.1.2.1.1.2.0", "sys_name": "1.3.6.1.2.1.1.5.0", "loc_chassis": "1.0.8802.1.1.2.1.3.2.0", "cap_enabled": "1.0.8802.1.1.2.1.3.6.0", "fortinet_version": FORTINET_VERSION, "fortinet_serial": FORTINET_SERIAL}


def system_info(walks: DataFrame) -> DataFrame:
    """device_ip, hostname, vendor, model, firmware, serial, mac, chassis_id, cap_enabled."""
    cells = get_many(walks, SYSTEM)
    extra = F.create_map(F.lit(FORTINET_VERSION), F.col("fortinet_version"), F.lit(FORTINET_SERIAL), F.col("fortinet_serial"))
    known = cells.withColumn("known", identify(collapse_whitespace(F.col("sys_descr")), F.col("sys_object_id"), extra))
    return known.select("device_ip", F.col("sys_name").alias("hostname"), "known.*", format_mac(F.col("loc_chassis")).alias("mac"), normalize_chassis_id(F.col("loc_chassis")).alias("chassis_id"), "cap_enabled")


def target_id(chassis_id: Column, sys_name: Column, mgmt_ip: Column) -> Column:
    """The neighbour's chassis, else its name, else its address."""
    none = F.lit("")
    return F.coalesce(F.nullif(chassis_id, none), F.concat(F.lit("name:"), F.nullif(sys_name, none)), F.concat(F.lit("ip:"), F.nullif(mgmt_ip, none)), F.lit("unknown"))


def distinct_seeds(seeds: DataFrame) -> DataFrame:
    """Routable addresses once each, at the place of their first mention."""
    return seeds.filter(is_routable_gateway(F.col("ip"))).groupBy("ip").agg(F.min("pos").alias("pos"))


def crawl(seeds: DataFrame, systems: DataFrame, neighbors: DataFrame, *, max_nodes: int = MAX_NODES) -> tuple[DataFrame, DataFrame]:
    """Devices and links from seeds (pos, ip), systems (a row for each device_ip that answers) and the
    neighbours these report.

    Frontiers go level by level, in the order of the reports; addresses, then chassis,
    are visited once. A device that doesn't answer is unreachable; a neighbour that is
    only known from reports, or lies beyond ``max_nodes``, is discovered. A device's own
    capabilities go before the first that a neighbour reports. A chassis expected under
    another id than the device's own keeps its links: ids are mapped to the device's own.
    """
    reports = neighbors.withColumn("target", target_id(F.col("chassis_id"), F.col("sys_name"), F.col("mgmt_ip"))).select("device_ip", "seq", "target", "mgmt_ip", "sys_name", "sys_descr", "chassis_mac", "cap_enabled", "local_port", "remote_port")
    reports = checkpoint(reports)
    frontier = checkpoint(numbered(distinct_seeds(seeds), "at", F.col("pos"), F.col("ip")).filter(F.col("at") < max_nodes).select("ip", F.lit(None).cast("string").alias("expected"), F.lit(0).alias("level"), "at"))
    visited = frontier
    reserved = frontier.count()
    level = 0
    while True:
        level += 1
        seen = frontier.select(F.col("ip").alias("device_ip"), "at").join(systems.select("device_ip"), "device_ip", "left_semi")
        found = reports.join(seen, "device_ip").filter("mgmt_ip <> ''").groupBy(F.col("mgmt_ip").alias("ip")).agg(F.min(F.struct("at", "seq", F.col("target").alias("expected"))).alias("first"))
        own = visited.select("ip").join(systems.select(F.col("device_ip").alias("ip"), F.col("chassis_id").alias("expected")), "ip").select("expected").unionByName(visited.select("expected")).filter("expected IS NOT NULL").distinct()
        fresh = found.select("ip", "first.expected", "first.at", "first.seq").join(visited.select("ip"), "ip", "left_anti").join(own, "expected", "left_anti")
        once = fresh.groupBy("expected").agg(F.min(F.struct("at", "seq", "ip")).alias("f")).select("expected", "f.ip", F.col("f.at").alias("from_at"), "f.seq")
        frontier = checkpoint(numbered(once, "at", F.col("from_at"), F.col("seq"), F.col("ip")).filter(F.col("at") < max_nodes - reserved).select("ip", "expected", F.lit(level).alias("level"), "at"))
        added = frontier.count()
        if not added:
            break
        reserved += added
        visited = checkpoint(visited.unionByName(frontier))
    polled = visited.join(systems.withColumnRenamed("device_ip", "ip"), "ip", "left")
    answered = F.col("vendor").isNotNull()
    chassis = F.when(answered, F.coalesce("chassis_id", "expected", F.concat(F.lit("ip:"), "ip"))).otherwise(F.coalesce("expected", F.concat(F.lit("ip:"), "ip")))
    devices = polled.select(chassis.alias("chassis_id"), "expected", "ip", "hostname", "vendor", "model", "firmware", "serial", "mac", F.when(answered, "online").otherwise("unreachable").alias("status"), answered.alias("pollable"), F.col("cap_enabled").alias("lldp_cap_enabled"), "level", F.col("at").cast("long").alias("at"))
    # two addresses of one device are one device; an answer goes before silence
    devices = checkpoint(devices.groupBy("chassis_id").agg(F.min_by(F.struct(*[c for c in devices.columns if c != "chassis_id"]), F.struct((~F.col("pollable")).alias("silent"), "level", "at")).alias("d")).select("chassis_id", "d.*"))
    renamed = polled.select(F.col("expected").alias("target"), chassis.alias("actual")).filter("target <> actual").groupBy("target").agg(F.min("actual").alias("actual"))
    source = polled.filter(answered).select(F.col("ip").alias("device_ip"), chassis.alias("source_chassis_id"), "level", "at")
    raw = reports.join(source, "device_ip").join(renamed, "target", "left").withColumn("target_chassis_id", F.coalesce("actual", "target"))
    raw = checkpoint(numbered(raw, "link_seq", F.col("level"), F.col("at"), F.col("seq"), F.col("device_ip")))
    links = raw.select(F.col("link_seq").alias("seq"), "source_chassis_id", "target_chassis_id", "local_port", "remote_port")
    by_first = F.col("link_seq")
    advertised = raw.groupBy(F.col("target_chassis_id").alias("chassis_id")).agg(F.min_by("cap_enabled", F.when(F.col("cap_enabled") != "", by_first)).alias("said"), F.min_by(F.struct("mgmt_ip", "sys_name", "sys_descr", "chassis_mac"), by_first).alias("n"), F.min("link_seq").alias("first"))
    known = devices.join(advertised.select("chassis_id", "said"), "chassis_id", "left").withColumn("lldp_cap_enabled", F.coalesce(F.nullif("lldp_cap_enabled", F.lit("")), "said")).drop("said", "expected")
    none = F.lit(None).cast("string")
    only_reported = advertised.join(devices.select("chassis_id"), "chassis_id", "left_anti").select("chassis_id", F.col("n.mgmt_ip").alias("ip"), F.col("n.sys_name").alias("hostname"), vendor_of_description(F.col("n.sys_descr")).alias("vendor"), none.alias("model"), none.alias("firmware"), none.alias("serial"), F.col("n.chassis_mac").alias("mac"), F.lit("discovered").alias("status"), F.lit(False).alias("pollable"), F.col("said").alias("lldp_cap_enabled"), F.lit(level).alias("level"), F.col("first").cast("long").alias("at"))
    return numbered(known.unionByName(only_reported), "pos", F.col("level"), F.col("at"), F.col("chassis_id")).drop("level", "at"), links


def network_document(devices: DataFrame, links: DataFrame, *, pollable_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Devices and undirected links; on request the backbone alone, of devices that answer."""
    edges = dedupe_links(links)
    if pollable_only:
        devices = devices.filter("pollable")
        for end in ("source_chassis_id", "target_chassis_id"):
            edges = edges.join(devices.select(F.col("chassis_id").alias(end)), end, "left_semi")
    return devices, edges


@dataclass
class Network:
    """devices, links, fdb and arp as the MAC table, the ladder and the graph take them."""

    devices: DataFrame
    links: DataFrame
    fdb: DataFrame
    arp: DataFrame


def network_of_walks(seeds: DataFrame, walks: DataFrame, *, max_nodes: int = MAX_NODES, pollable_only: bool = False) -> Network:
    """The network that a crawl of landed walks finds: each polled device with its ports and their states,
    own MACs, and the rows of its forwarding and address tables."""
    neighbors = checkpoint(build_neighbors(walks))
    found, links = crawl(seeds, system_info(walks), neighbors, max_nodes=max_nodes)
    devices, edges = network_document(checkpoint(found), links, pollable_only=pollable_only)
    polled = devices.filter("pollable").select("chassis_id", F.col("ip").alias("device_ip"), "pos")
    states = port_status(walks).groupBy("device_ip").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("port", "status")))).alias("port_status"))
    said = polled.drop("pos")
    for part in (split_ports(neighbors), own_macs(walks), states):
        said = said.join(part, "device_ip", "left")
    whole = devices.join(said.drop("device_ip"), "chassis_id", "left")
    for ports in ("neighbor_ports", "uplink_ports", "own_macs"):
        whole = whole.withColumn(ports, F.coalesce(ports, F.array().cast("array<string>")))
    fdb = build_fdb(walks).join(polled, "device_ip").select("pos", "chassis_id", "seq", "mac", "port", "vlan")
    arp = arp_rows(walks).join(polled.select("device_ip", "pos"), "device_ip").select("pos", "seq", "mac", "ip")
    return Network(checkpoint(whole), checkpoint(edges), checkpoint(fdb), checkpoint(arp))


def crawl_walks(seeds: DataFrame, walks: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """A crawl straight from landed walks."""
    return crawl(seeds, system_info(walks), build_neighbors(walks), **how)
