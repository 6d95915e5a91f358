"""How nodes are shown: risk classes, labels, icons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Icons by role.
ICONS = {"firewall": "shield", "router": "router", "switch": "switch", "l2-switch": "switch", "l3-switch": "switch", "access-point": "wifi", "phone": "phone", "server": "server", "station": "monitor", "host": "monitor"}


def risk_bucket(score: Column) -> Column:
    """unknown (not scored), critical, high, low or clean."""
    return F.when(score.isNull(), "unknown").when(score >= 9, "critical").when(score >= 7, "high").when(score > 0, "low").otherwise("clean")


def is_offline(status: Column) -> Column:
    return F.coalesce(F.lower(status).isin("disconnected", "discovered"), F.lit(False))


def label(hostname: Column, ip: Column, node_id: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(F.nullif(hostname, F.lit("")), F.nullif(ip, F.lit("")), node_id)


def icon(role: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in ICONS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(role)), F.lit("box"))


def or_dash(value: Column) -> Column:
    """What a detail view shows for null and empty text."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit("—"))
