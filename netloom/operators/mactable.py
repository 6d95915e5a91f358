"""Where every MAC was learnt: one table from the forwarding and address tables of all switches.

Inputs: devices (pos, chassis_id, pollable, uplink_ports, own_macs), fdb (pos of
the device, chassis_id, seq, mac, port, vlan) and arp (pos, seq, mac, ip).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions.mac import canonical_mac
from netloom.sources.schema import RESOLVED, TIEBREAK, device_id


def known_rows(fdb: DataFrame) -> DataFrame:
    """Forwarding rows with a MAC, a port and a chassis id (an empty one counts here, other than where devices
    are named), the MAC as key."""
    return fdb.withColumn("mac", canonical_mac(F.col("mac"))).filter("mac IS NOT NULL AND port IS NOT NULL AND chassis_id IS NOT NULL")


def port_mac_count(fdb: DataFrame) -> DataFrame:
    """Distinct MACs of each port of each switch, before anything is left out."""
    return known_rows(fdb).groupBy("chassis_id", "port").agg(F.count_distinct("mac").alias("mac_count"))


def infra_macs(devices: DataFrame) -> DataFrame:
    """MACs of the network itself: own MACs of all devices, chassis and mac of those that answer."""
    own = devices.select(F.explode_outer("own_macs").alias("mac"))
    chassis = devices.filter("pollable").select(F.col("chassis_id").alias("mac"))
    named = devices.filter("pollable").select("mac") if "mac" in devices.columns else chassis
    return own.unionByName(chassis).unionByName(named).select(canonical_mac(F.col("mac")).alias("mac")).filter("mac IS NOT NULL").distinct()


def address_of_mac(arp: DataFrame) -> DataFrame:
    """mac and the last address that any device has for it."""
    rows = arp.withColumn("mac", canonical_mac(F.col("mac"))).filter(F.col("mac").isNotNull() & (F.coalesce(F.col("ip"), F.lit("")) != ""))
    return rows.groupBy("mac").agg(F.max_by("ip", F.struct("pos", "seq")).alias("ip"))


def candidates(fdb: DataFrame, devices: DataFrame) -> DataFrame:
    """Places (chassis_id, mac, port, vlan) at which a MAC may be attached, with the place's order key.

    The MACs of the network and what is learnt on uplinks are left out by anti joins.
    """
    uplinks = devices.select("chassis_id", F.explode("uplink_ports").alias("port")).distinct()
    seen = known_rows(fdb).groupBy("chassis_id", "mac", "port", "vlan").agg(F.min(F.struct("pos", "seq")).alias("order"))
    return seen.join(infra_macs(devices), "mac", "left_anti").join(uplinks, ["chassis_id", "port"], "left_anti")


def mac_table(fdb: DataFrame, arp: DataFrame, devices: DataFrame) -> DataFrame:
    """mac, ip, chassis_id, port, vlan, confidence and order of every MAC that some access port has.

    Of several places the one on the port with the fewest MACs counts.
    """
    places = candidates(fdb, devices).join(port_mac_count(fdb), ["chassis_id", "port"])
    best = F.struct("mac_count", device_id(F.col("chassis_id")).alias("node_id"), "port", F.col("order").alias("first"), F.coalesce("vlan", F.lit(-1)).alias("v"))
    chosen = places.groupBy("mac").agg(F.min_by(F.struct("chassis_id", "port", "vlan"), best).alias("at"), F.count("*").alias("n"), F.min("order").alias("order"))
    evidence = F.when(F.col("n") == 1, RESOLVED).otherwise(TIEBREAK)
    return chosen.join(address_of_mac(arp), "mac", "left").select("mac", "ip", "at.chassis_id", "at.port", "at.vlan", evidence.alias("confidence"), "order")


def mac_by_ip(table: DataFrame) -> DataFrame:
    """ip and the last MAC of the table that has it."""
    return table.filter("ip IS NOT NULL").groupBy("ip").agg(F.max_by("mac", "order").alias("mac"))
