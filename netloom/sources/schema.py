"""Explicit schemas; inference would read maps of ports as structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Kinds, methods, edge types, evidence and reasons of the graph document.
ENDPOINT, DEVICE = "endpoint", "device"
BY_INVENTORY, BY_LLDP, BY_FDB = "wazuh", "snmp_lldp", "snmp_fdb"
LLDP_EDGE, ENDPOINT_EDGE = "lldp", "endpoint_link"
LLDP, RESOLVED, TIEBREAK, SUBNET, FDB = "lldp", "resolved", "tiebreak", "subnet_fallback", "fdb"
NO_MAC, ABSENT, OFFLINE = "no_endpoint_mac", "mac_absent_from_all_fdb", "host_offline_no_l2_evidence"

def _struct(*fields: tuple[str, T.DataType] | str) -> T.StructType:
    """A struct of strings, or of given types; importing this needs no session."""
    return T.StructType([T.StructField(f, _TEXT) if isinstance(f, str) else T.StructField(*f) for f in fields])


_TEXT, _LONG, _INT, _DOUBLE, _BOOL = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
_TEXTS, _BY_PORT = T.ArrayType(_TEXT), T.MapType(_TEXT, _TEXT)

CVE = _struct("cve", ("cvss", _DOUBLE), "cvss_version", "severity", "package", "version", "description")
_SHARED = ("ip", "hostname", "vendor", "model", "firmware", "serial", "mac")
NODE = _struct(
    "node_id", "kind", *_SHARED, "discovery_method", "status", "role", ("risk_score", _DOUBLE), ("discovery_order", _INT), "parent_id", "agent_id", ("top_cves", T.ArrayType(CVE)),
    "chassis_id", ("pollable", _BOOL), ("neighbor_ports", _TEXTS), ("uplink_ports", _TEXTS), ("port_status", _BY_PORT),
)
EDGE = _struct("source", "source_name", "target", "target_name", "type", "local_port", "remote_port", "confidence")
DEVICE_ROW = _struct(
    *_SHARED, "chassis_id", "discovery_method", "status", ("pollable", _BOOL), ("neighbor_ports", _TEXTS), ("uplink_ports", _TEXTS), ("port_status", _BY_PORT), "lldp_cap_enabled", ("risk_score", _DOUBLE),
    ("fdb", T.ArrayType(_struct("mac", "port", ("vlan", _INT)))), ("arp", _BY_PORT), ("own_macs", _TEXTS),
)
LINK_ROW = _struct("source_chassis_id", "target_chassis_id", "local_port", "remote_port")
NETWORK_DOCUMENT = _struct("scan_time", "seed", ("nodes", T.ArrayType(DEVICE_ROW)), ("edges", T.ArrayType(LINK_ROW)))
GRAPH_DOCUMENT = _struct(("nodes", T.ArrayType(NODE)), ("edges", T.ArrayType(EDGE)))
WALK = _struct("device_ip", "context", "base_oid", ("seq", _LONG), "oid", "value")
AGENT = _struct("id", "name", "ip", "status", ("os", _struct("platform", "name", "version")))
NETIFACE = _struct("agent_id", ("pos", _INT), "name", "mac", "state")
NETADDR = _struct("agent_id", ("pos", _INT), "iface", "proto", "address")
HARDWARE = _struct("agent_id", ("pos", _INT), "board_serial")
_SCORE = _struct(("base", _DOUBLE), "version")
VULNERABILITY = _struct("agent_id", ("_source", _struct(("vulnerability", _struct("id", "severity", "description", ("score", _SCORE))), ("package", _struct("name", "version")))))
SCORED_ENDPOINT = _struct("agent_id", *_SHARED, "status", "discovery_method", ("risk_score", _DOUBLE), ("top_cves", T.ArrayType(CVE)))


def endpoint_id(agent_id: Column) -> Column:
    return F.concat(F.lit("endpoint:"), agent_id)


def device_id(chassis_id: Column) -> Column:
    return F.concat(F.lit("device:"), chassis_id)


def host_id(mac: Column) -> Column:
    return F.concat(F.lit("host:"), mac)
