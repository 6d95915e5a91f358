"""Decoding of table walks: device_ip, context, seq, oid, value.

Rows that don't parse are dropped; of several rows for one key the last counts,
by seq. Fallbacks between tables hold for whole devices, not for rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from netloom.functions import oid as O
from netloom.functions.mac import canonical_mac, collapse_whitespace, format_mac, normalize_chassis_id
from netloom.functions.roles import is_infrastructure
from netloom.sources.landing import walk_range

MAX_VLANS = 256


def below(walks: DataFrame, base: str) -> DataFrame:
    """The rows of a table with their index."""
    return walk_range(walks, base).withColumn("index", O.index_after(F.col("oid"), base))


def last_by(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(value, "seq").alias(value))


def dot1q_rows(walks: DataFrame) -> DataFrame:
    """device_ip, context, seq, vlan, mac and bridge_port of 802.1Q forwarding rows."""
    rows = below(walks, O.DOT1Q_FDB_PORT).filter("value IS NOT NULL")
    decoded = rows.select("device_ip", "context", "seq", O.arc_int(F.col("index"), 0).alias("vlan"), O.mac_at(F.col("index"), 1).alias("mac"), F.col("value").alias("bridge_port"))
    return decoded.filter("vlan IS NOT NULL AND mac IS NOT NULL")


def dot1d_rows(walks: DataFrame) -> DataFrame:
    """device_ip, context, seq, mac and bridge_port of flat forwarding rows."""
    rows = below(walks, O.DOT1D_FDB_PORT).filter("value IS NOT NULL")
    return rows.select("device_ip", "context", "seq", O.mac_at(F.col("index"), 0).alias("mac"), F.col("value").alias("bridge_port")).filter("mac IS NOT NULL")


def arp_rows(walks: DataFrame) -> DataFrame:
    """device_ip, seq, mac and ip of address rows."""
    rows = below(walks, O.ARP)
    return rows.select("device_ip", "seq", canonical_mac(F.col("value")).alias("mac"), O.last_ipv4(F.col("index")).alias("ip")).filter("mac IS NOT NULL AND ip IS NOT NULL")


def indexed(walks: DataFrame, base: str) -> DataFrame:
    """device_ip, context, index and the last value of a table with one column."""
    return last_by(below(walks, base).filter("value IS NOT NULL"), ["device_ip", "context", "index"])


def interface_names(walks: DataFrame) -> DataFrame:
    """device_ip, ifindex and name: ifName, or ifDescr for a device without any ifName."""
    names = last_by(below(walks, O.IFNAME).filter("value IS NOT NULL"), ["device_ip", "index"])
    descriptions = last_by(below(walks, O.IFDESCR).filter("value IS NOT NULL"), ["device_ip", "index"])
    return names.unionByName(descriptions.join(names.select("device_ip").distinct(), "device_ip", "left_anti")).select("device_ip", F.col("index").alias("ifindex"), F.col("value").alias("name"))


def resolve_ports(rows: DataFrame, base_ports: DataFrame, names: DataFrame, by: list[str]) -> DataFrame:
    """Adds port to rows with bridge_port: the interface's name, else its index, else the bridge port."""
    hops = base_ports.select(*by, F.col("index").alias("bridge_port"), F.col("value").alias("ifindex"))
    return rows.join(hops, [*by, "bridge_port"], "left").join(names, ["device_ip", "ifindex"], "left").withColumn("port", F.coalesce("name", "ifindex", "bridge_port")).drop("ifindex", "name")


def readable_vlans(walks: DataFrame, most: int = MAX_VLANS) -> DataFrame:
    """device_ip and vlan whose contexts are read: the operational ones, or the static ones of a device without any."""
    operational = operational_vlans(walks, most)
    static = first_vlans(vlan_names(walks).select("device_ip", "vlan"), most)
    return operational.unionByName(static.join(operational.select("device_ip").distinct(), "device_ip", "left_anti"))


def build_fdb(walks: DataFrame, most: int = MAX_VLANS) -> DataFrame:
    """device_ip, seq, mac, port and vlan, from the first source that a device has rows of, even ones that don't parse.

    First the flat tables in the contexts of its readable VLANs, with each context's own port
    numbers; then 802.1Q rows, whose context's VLAN goes before the one in the index; then the
    flat table of no context. VLAN 0 is none. Where walks are stored by context, the partitions of contexts
    that no device reads are left out when the query runs.
    """
    names = interface_names(walks)
    base_ports = indexed(walks, O.BASEPORT_IFINDEX)
    default_ports = base_ports.filter("context = ''").drop("context")
    context = F.col("context").try_cast("int")
    vlans = readable_vlans(walks, most).select("device_ip", F.col("vlan").alias("of"))
    read = F.broadcast(vlans.filter("of BETWEEN 1 AND 4094").select("of").distinct())  # a VLAN's number has 12 bits
    in_context = walk_range(walks, O.DOT1D_FDB_PORT).filter("context <> ''").withColumn("of", context).join(read, "of", "left_semi").join(vlans, ["device_ip", "of"], "left_semi").drop("of")
    by_vlan = in_context.select("device_ip").distinct()
    tagged = walk_range(walks, O.DOT1Q_FDB_PORT).select("device_ip").distinct()
    v = resolve_ports(dot1d_rows(in_context), base_ports, names, ["device_ip", "context"]).withColumn("vlan", F.nullif(context, F.lit(0)))
    q = resolve_ports(dot1q_rows(walks).join(by_vlan, "device_ip", "left_anti"), default_ports, names, ["device_ip"]).withColumn("vlan", F.nullif(F.coalesce(F.nullif(context, F.lit(0)), "vlan"), F.lit(0)))
    flat = dot1d_rows(walks.filter("context = ''")).join(by_vlan.unionByName(tagged), "device_ip", "left_anti")
    d = resolve_ports(flat, default_ports, names, ["device_ip"]).withColumn("vlan", F.lit(None).cast("int"))
    columns = ["device_ip", "seq", "mac", "port", "vlan"]
    return v.select(*columns).unionByName(q.select(*columns)).unionByName(d.select(*columns))


def oper_status(value: Column) -> Column:
    text = F.lower(F.trim(value))
    return F.when((text == "1") | text.startswith("up"), "up").otherwise("down")


def port_status(walks: DataFrame) -> DataFrame:
    """device_ip, port and status of every interface; of several with one name the last counts."""
    states = below(walks, O.IFOPERSTATUS).filter("value IS NOT NULL").groupBy("device_ip", F.col("index").alias("ifindex")).agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
    named = states.join(interface_names(walks), ["device_ip", "ifindex"], "left").withColumn("port", F.coalesce("name", "ifindex"))
    return named.groupBy("device_ip", "port").agg(oper_status(F.max_by("value", "seq")).alias("status"))


def first_vlans(vlans: DataFrame, most: int) -> DataFrame:
    """The first ``most`` VLANs of each device."""
    return vlans.withColumn("n", F.row_number().over(W.partitionBy("device_ip").orderBy("vlan"))).filter(F.col("n") <= most).drop("n")


def operational_vlans(walks: DataFrame, most: int = MAX_VLANS) -> DataFrame:
    """device_ip and vlan: ids 1 to 1001 in state 1, the first ``most`` of each device."""
    vlan = F.element_at(O.arcs(F.col("index")), -1).try_cast("int")
    rows = below(walks, O.VTP_VLAN_STATE).filter("value = '1'").select("device_ip", vlan.alias("vlan")).filter("vlan BETWEEN 1 AND 1001").distinct()
    return first_vlans(rows, most)


def vlan_names(walks: DataFrame) -> DataFrame:
    rows = below(walks, O.VLAN_STATIC_NAME).select("device_ip", O.arc_int(F.col("index"), 0).alias("vlan"), "value", "seq").filter("vlan IS NOT NULL")
    return rows.groupBy("device_ip", "vlan").agg(F.coalesce(F.max_by("value", "seq"), F.lit("")).alias("name"))


def own_macs(walks: DataFrame) -> DataFrame:
    """device_ip and the sorted distinct MACs of its interfaces."""
    rows = below(walks, O.IFPHYS).select("device_ip", canonical_mac(F.col("value")).alias("mac")).filter("mac IS NOT NULL")
    return rows.groupBy("device_ip").agg(F.array_sort(F.collect_set("mac")).alias("own_macs"))


# Columns of the remote table.
REMOTE_COLUMNS = {"5": "chassis_id", "7": "port_id", "8": "port_descr", "9": "sys_name", "10": "sys_descr", "11": "cap_supported", "12": "cap_enabled"}


def remote_cells(walks: DataFrame) -> DataFrame:
    """One row for each neighbour (device_ip, local_num, rem_index) with its cells as columns."""
    index = F.col("index")
    cells = below(walks, O.LLDP_REM).select("device_ip", "seq", "value", O.arc(index, 0).alias("col"), O.arc(index, 2).alias("local_num"), O.arc(index, 3).alias("rem_index"))
    wanted = cells.filter(F.col("rem_index").isNotNull() & F.col("col").isin(*REMOTE_COLUMNS))
    last = [F.max_by("value", F.when(F.col("col") == number, F.col("seq"))).alias(name) for number, name in REMOTE_COLUMNS.items()]
    return wanted.groupBy("device_ip", "local_num", "rem_index").agg(F.min("seq").alias("seq"), *last)


def management_addresses(walks: DataFrame) -> DataFrame:
    """device_ip, local_num, rem_index and mgmt_ip: the last IPv4 address, else the first IPv6 one."""
    index = F.col("index")
    rows = below(walks, O.LLDP_MAN_ADDR).select("device_ip", "seq", O.arc(index, 2).alias("local_num"), O.arc(index, 3).alias("rem_index"), O.arc_int(index, 4).alias("family"), O.arc_int(index, 5).alias("n"), F.slice(O.arcs(index), 7, 64).alias("rest"))
    whole = rows.filter("n >= 0 AND size(rest) >= n").withColumn("octets", F.slice("rest", 1, F.col("n")))
    v4 = F.when((F.col("family") == 1) & (F.col("n") == 4), F.array_join("octets", "."))
    pairs = F.transform("octets", lambda o: F.lpad(F.lower(F.hex(o.try_cast("long"))), 2, "0"))
    v6 = F.when((F.col("family") == 2) & O.octets_ok(F.col("octets"), 16), F.array_join(pairs, ":"))
    found = whole.withColumns({"v4": v4, "v6": v6})
    last4 = F.max_by("v4", F.when(F.col("v4").isNotNull(), F.col("seq")))
    first6 = F.min_by("v6", F.when(F.col("v6").isNotNull(), F.col("seq")))
    return found.groupBy("device_ip", "local_num", "rem_index").agg(F.coalesce(last4, first6).alias("mgmt_ip")).filter("mgmt_ip IS NOT NULL")


def local_ports(walks: DataFrame) -> DataFrame:
    index = F.col("index")
    rows = below(walks, O.LLDP_LOC_PORT).filter("value IS NOT NULL").select("device_ip", "seq", "value", O.arc(index, 0).alias("col"), O.arc(index, 1).alias("local_num"))
    return last_by(rows.filter("col = '3' AND local_num IS NOT NULL"), ["device_ip", "local_num"]).withColumnRenamed("value", "local_port")


def build_neighbors(walks: DataFrame) -> DataFrame:
    """The neighbours that each device reports, with ports, address and capabilities; '' is null."""
    empty = F.lit("")
    joined = remote_cells(walks).join(management_addresses(walks), ["device_ip", "local_num", "rem_index"], "left").join(local_ports(walks), ["device_ip", "local_num"], "left")
    cleaned = {c: F.nullif(F.col(c), empty) for c in ("port_id", "port_descr", "sys_name", "cap_supported", "cap_enabled")}
    named = joined.withColumns({"chassis_mac": format_mac(F.col("chassis_id")), "chassis_id": normalize_chassis_id(F.col("chassis_id")), "sys_descr": F.nullif(collapse_whitespace(F.col("sys_descr")), empty), "local_port": F.coalesce("local_port", "local_num"), **cleaned})
    return named.withColumn("remote_port", F.coalesce("port_id", "port_descr"))


def split_ports(neighbors: DataFrame) -> DataFrame:
    """device_ip, neighbor_ports and uplink_ports: all ports with a neighbour, and those that lead on."""
    leads = is_infrastructure(F.col("mgmt_ip"), F.col("cap_enabled"))
    return neighbors.groupBy("device_ip").agg(F.array_sort(F.collect_set("local_port")).alias("neighbor_ports"), F.array_sort(F.collect_set(F.when(leads, F.col("local_port")))).alias("uplink_ports"))
