"""A network derived from the driver's tables: nations are devices, customers endpoints, orders
sightings in forwarding tables, suppliers unmanaged hosts, line items findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Scenario:
    endpoints: DataFrame
    devices: DataFrame
    links: DataFrame
    fdb: DataFrame
    arp: DataFrame
    findings: DataFrame


def _mac(head: str, number: Column) -> Column:
    return F.format_string(head + ":%02x:%02x:%02x", (number / 65536).cast("int"), F.floor(number / 256).cast("int") % 256, (number % 256).cast("int"))


def _chassis(number: Column, row: str = "00") -> Column:
    return F.format_string(f"00:23:ac:e5:{row}:%02x", number.cast("int"))


def build_scenario(spark: SparkSession, sf_dir: str) -> Scenario:
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    key, nation = F.col("c_custkey"), F.col("c_nationkey").cast("int")
    place = F.concat_ws(".", nation, key % 250 + 1)
    mac = _mac("e4:a7:a0", key)
    endpoints = read("customer").select(
        key.cast("long").alias("pos"),
        F.format_string("%05d", key).alias("agent_id"),
        nation.alias("nk"),
        F.col("c_name").alias("hostname"),
        F.concat(F.when(key % 17 == 0, "10.99.").otherwise("10.0."), place).alias("ip"),
        mac.alias("true_mac"),
        F.when(key % 11 != 0, mac).alias("mac"),
        F.when(F.col("c_acctbal") < 0, "disconnected").otherwise("active").alias("status"),
    )
    n = F.col("n_nationkey").cast("int")
    bitmap = F.when(n % 5 == 0, "0x28").when(n % 5 == 1, "0x20").when(n % 5 == 2, "0x08").when(n % 5 == 3, "0x10")
    switches = read("nation").select(n.cast("long").alias("pos"), _chassis(n).alias("chassis_id"), F.format_string("10.0.%d.254", n).alias("ip"), F.col("n_name").alias("hostname"), bitmap.alias("lldp_cap_enabled"), (n % 6 != 5).alias("pollable"), _chassis(n, "01").alias("own_mac"))
    speakers = endpoints.filter("pos % 13 = 1")
    none = F.lit(None).cast("string")
    phantoms = speakers.select((F.col("pos") + 1000).alias("pos"), F.col("true_mac").alias("chassis_id"), none.alias("ip"), none.alias("hostname"), F.lit("0x01").alias("lldp_cap_enabled"), F.lit(False).alias("pollable"), none.alias("own_mac"))
    devices = switches.unionByName(phantoms).withColumns({"uplink_ports": F.array(F.lit("Gi0/0")), "own_macs": F.array_compact(F.array("own_mac"))})
    trunks = read("nation").filter(n > 0).select(n.cast("long").alias("seq"), _chassis(F.floor((n - 1) / 2)).alias("source_chassis_id"), _chassis(n).alias("target_chassis_id"), F.format_string("Te1/%d", n).alias("local_port"), F.lit("Gi0/0").alias("remote_port"))
    access = speakers.select((F.col("pos") + 1000).alias("seq"), _chassis(F.col("nk")).alias("source_chassis_id"), F.col("true_mac").alias("target_chassis_id"), F.concat(F.lit("Gi0/"), F.col("pos") % 6 + 1).alias("local_port"), F.concat(F.lit("0x"), F.regexp_replace("true_mac", ":", "")).alias("remote_port"))
    order = F.col("o_orderkey")
    port = F.when(order % 4 == 0, F.lit(0)).when(order % 5 == 0, F.lit(7)).otherwise(F.col("pos") % 5 + 1)
    seen = read("orders").filter(order % 3 == 0).join(endpoints.filter("pos % 13 <> 1"), F.col("o_custkey") == F.col("pos"))
    sightings = seen.select(_chassis(F.col("nk")).alias("chassis_id"), F.col("nk").cast("long").alias("pos"), F.col("true_mac").alias("mac"), F.concat(F.lit("Gi0/"), port).alias("port"), (10 * (F.col("nk") % 3 + 1)).cast("int").alias("vlan"), order.cast("long").alias("seq"))
    supplier = F.col("s_suppkey")
    hosts = read("supplier").select(_chassis(F.col("s_nationkey")).alias("chassis_id"), F.col("s_nationkey").cast("long").alias("pos"), _mac("28:f1:0e", supplier).alias("mac"), F.lit("Gi0/9").alias("port"), F.lit(1).alias("vlan"), (supplier + 10000000).cast("long").alias("seq"))
    own = read("nation").select(_chassis(n).alias("chassis_id"), n.cast("long").alias("pos"), _chassis(n, "01").alias("mac"), F.lit("Vl1").alias("port"), F.lit(1).alias("vlan"), (n.cast("long") + 20000000).alias("seq"))
    findings = read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.format_string("%05d", "o_custkey").alias("agent_id"), F.format_string("CVE-%d-%d", "l_orderkey", "l_linenumber").alias("cve"), F.round(F.col("l_discount") * 100, 1).alias("cvss"))
    return Scenario(
        endpoints=endpoints,
        devices=devices,
        links=trunks.unionByName(access),
        fdb=sightings.unionByName(hosts).unionByName(own),
        arp=endpoints.filter("pos % 22 = 0").select(F.lit(0).cast("long").alias("pos"), F.col("pos").alias("seq"), F.col("true_mac").alias("mac"), "ip"),
        findings=findings,
    )
