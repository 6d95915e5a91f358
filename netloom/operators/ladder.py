"""Where every endpoint is attached, by the best evidence there is.

1 a neighbour report of a device whose chassis is the endpoint's MAC, 2a the
endpoint's MAC in the MAC table, 2b without a MAC its address there, 3 a device of
its subnet. MACs of the table that belong to nobody are hosts. A placement always
names a device that stays in the graph.

Inputs: endpoints (pos, agent_id, hostname, ip, mac, status), devices, links, fdb, arp.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.mac import canonical_mac, colon_form
from netloom.functions.net import subnet_key
from netloom.operators.mactable import infra_macs, mac_by_ip, mac_table
from netloom.sources import schema as S
from netloom.sources.session import checkpoint


def known_devices(devices: DataFrame) -> DataFrame:
    """Devices with a chassis id, the last of each id, at the place of the first."""
    named = devices.filter(F.coalesce(F.col("chassis_id"), F.lit("")) != "")
    whole = F.struct(*[c for c in named.columns if c != "pos"])
    return named.groupBy(F.col("chassis_id").alias("id")).agg(F.min("pos").alias("pos"), F.max_by(whole, "pos").alias("row")).select("pos", "row.*")


def first_reports(links: DataFrame) -> DataFrame:
    """For each chassis the other end and its port, from the first link that names the chassis."""
    as_target = links.select(F.col("target_chassis_id").alias("chassis_id"), F.col("source_chassis_id").alias("by"), F.col("local_port").alias("port"), "seq", F.lit(0).alias("side"))
    as_source = links.select(F.col("source_chassis_id").alias("chassis_id"), F.col("target_chassis_id").alias("by"), F.col("remote_port").alias("port"), "seq", F.lit(1).alias("side"))
    first = F.min_by(F.struct("by", "port"), F.struct("seq", "side"))
    return as_target.unionByName(as_source).groupBy("chassis_id").agg(first.alias("r")).select("chassis_id", "r.by", "r.port")


def merged_phantoms(endpoints: DataFrame, devices: DataFrame, links: DataFrame) -> DataFrame:
    """Devices that are endpoints: chassis_id, device_pos, agent_id, by (the reporting device) and port."""
    owners = endpoints.select("agent_id", "pos", canonical_mac(F.col("mac")).alias("key")).filter("key IS NOT NULL").groupBy("key").agg(F.max_by("agent_id", "pos").alias("agent_id"))
    keyed = devices.select("chassis_id", F.col("pos").alias("device_pos"), canonical_mac(F.col("chassis_id")).alias("key"))
    reported = keyed.join(owners, "key").join(first_reports(links), "chassis_id").join(devices.select(F.col("chassis_id").alias("by")), "by", "left_semi")
    # a report by a device that is itself an endpoint would hang on a node that goes away
    return reported.join(reported.select(F.col("chassis_id").alias("by")), "by", "left_anti").select("chassis_id", "device_pos", "agent_id", "by", "port")


def surviving_links(links: DataFrame, devices: DataFrame) -> DataFrame:
    """Links with both ends among the devices."""
    for end in ("source_chassis_id", "target_chassis_id"):
        links = links.join(devices.select(F.col("chassis_id").alias(end)), end, "left_semi")
    return links.select("seq", "source_chassis_id", "target_chassis_id", "local_port", "remote_port")


def subnet_parents(devices: DataFrame, prefix: int = 24) -> DataFrame:
    """net and the device that stands for it: one that answers before others, then by place."""
    nets = devices.select("chassis_id", "pos", "pollable", subnet_key(F.col("ip"), prefix).alias("net")).filter("net IS NOT NULL")
    order = F.struct((~F.coalesce("pollable", F.lit(False))).alias("silent"), "pos")
    return nets.groupBy("net").agg(F.min_by("chassis_id", order).alias("gateway"))


def absence(status: Column, mac: Column) -> Column:
    """Why an endpoint has no place."""
    online = F.lower(F.coalesce(status, F.lit(""))) == "active"
    return F.when(~online, S.OFFLINE).when(F.coalesce(mac, F.lit("")) == "", S.NO_MAC).otherwise(S.ABSENT)


@dataclass
class Placement:
    """devices: those that stay. links: those between them. macs: the MAC table. placed: node_id,
    kind_order (0 merged, 1 endpoint, 2 host), order, agent_id, mac, ip, parent, port, confidence,
    reason, enriched. phantoms: devices that became endpoints."""

    devices: DataFrame
    links: DataFrame
    macs: DataFrame
    placed: DataFrame
    phantoms: DataFrame


def place(endpoints: DataFrame, devices: DataFrame, links: DataFrame, fdb: DataFrame, arp: DataFrame) -> Placement:
    """The whole ladder. Endpoints without an id are left out; of several with one id the last counts."""
    endpoints = endpoints.filter("agent_id IS NOT NULL")
    all_devices = known_devices(devices)
    phantoms = checkpoint(merged_phantoms(endpoints, all_devices, links))
    staying = all_devices.join(phantoms, "chassis_id", "left_anti")
    # what merged devices have learnt is dropped with them
    macs = checkpoint(mac_table(fdb.join(phantoms, "chassis_id", "left_anti"), arp, all_devices))
    merged = phantoms.groupBy("agent_id").agg(F.max_by(F.struct("by", "port"), "device_pos").alias("m"), F.min("device_pos").alias("merged_pos"))
    keyed = endpoints.select("pos", "agent_id", "ip", F.col("mac").alias("raw_mac"), "status", canonical_mac(F.col("mac")).alias("key"), subnet_key(F.col("ip")).alias("net"))
    found = macs.select(F.col("mac").alias("key"), F.struct("chassis_id", "port", "confidence").alias("a"))
    by_ip = mac_by_ip(macs).join(macs.select("mac", "chassis_id", "port", "confidence"), "mac").select("ip", F.col("mac").alias("ip_mac"), F.struct("chassis_id", "port", "confidence").alias("b"))
    all_tiers = keyed.join(merged, "agent_id", "left")
    for known, key in ((found, "key"), (by_ip, "ip"), (subnet_parents(staying), "net")):
        # endpoints without the key get one of their own that nothing has, so they don't meet in one task
        own = F.concat(F.lit("-"), "agent_id")
        all_tiers = all_tiers.withColumn("_on", F.coalesce(key, own)).join(known.withColumnRenamed(key, "_on"), "_on", "left").drop("_on")
    by_address = F.col("key").isNull() & F.col("b").isNotNull()
    tier = F.when(F.col("m").isNotNull(), 1).when(F.col("a").isNotNull(), 2).when(by_address, 3).when(F.col("gateway").isNotNull(), 4).otherwise(5)

    def by_tier(*values) -> Column:
        out = F.lit(None).cast("string")
        for number, value in enumerate(values, 1):
            out = F.when(F.col("tier") == number, value).otherwise(out)
        return out

    ranked = all_tiers.withColumn("tier", tier)
    enriched = F.col("tier") == 3
    mac = F.when(enriched, colon_form(F.col("ip_mac"))).otherwise(F.col("raw_mac"))
    placed = ranked.select(
        S.endpoint_id(F.col("agent_id")).alias("node_id"),
        F.when(F.col("tier") == 1, 0).otherwise(1).alias("kind_order"),
        F.when(F.col("tier") == 1, F.struct(F.col("merged_pos").alias("pos"), F.lit(0).cast("long").alias("seq"))).otherwise(F.struct("pos", F.lit(0).cast("long").alias("seq"))).alias("order"),
        "agent_id",
        mac.alias("mac"),
        "ip",
        by_tier(F.col("m.by"), F.col("a.chassis_id"), F.col("b.chassis_id"), F.col("gateway")).alias("parent"),
        by_tier(F.col("m.port"), F.col("a.port"), F.col("b.port")).alias("port"),
        by_tier(F.lit(S.LLDP), F.col("a.confidence"), F.col("b.confidence"), F.lit(S.SUBNET)).alias("confidence"),
        F.when(F.col("tier") == 5, absence(F.col("status"), F.col("raw_mac"))).alias("reason"),
        enriched.alias("enriched"),
    )
    placed = checkpoint(placed)
    return Placement(staying, surviving_links(links, staying), macs, placed.unionByName(hosts(placed, staying, all_devices, macs)), phantoms)


def hosts(placed: DataFrame, staying: DataFrame, all_devices: DataFrame, macs: DataFrame) -> DataFrame:
    """MACs of the table that no device, endpoint or part of the network has."""
    known = staying.select(canonical_mac(F.col("chassis_id")).alias("mac")).unionByName(placed.select(canonical_mac(F.col("mac")).alias("mac"))).unionByName(infra_macs(all_devices))
    unknown = macs.join(known.filter("mac IS NOT NULL").distinct(), "mac", "left_anti")
    none = F.lit(None).cast("string")
    return unknown.select(S.host_id(colon_form(F.col("mac"))).alias("node_id"), F.lit(2).alias("kind_order"), F.col("order"), none.alias("agent_id"), colon_form(F.col("mac")).alias("mac"), "ip", F.col("chassis_id").alias("parent"), "port", F.lit(S.FDB).alias("confidence"), none.alias("reason"), F.lit(False).alias("enriched"))
