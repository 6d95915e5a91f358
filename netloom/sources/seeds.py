"""Where a crawl begins: addresses that are named, default gateways and the host's own neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.net import is_routable_gateway

# Words that mark an adapter as virtual.
VIRTUAL_ADAPTER = r"(?i)vmware|vmnet|virtualbox|vbox|host-only|hyper-v|vethernet|virtual ethernet|loopback|bluetooth|npcap"
_IPV4 = r"\b(\d{1,3}(?:\.\d{1,3}){3})\b"
DEFAULT_ROUTE = "0.0.0.0/0"


def route_gateways(routes: DataFrame, adapters: DataFrame) -> DataFrame:
    """Next hops of default routes with their order key, the lowest metric first, those through virtual adapters
    left out. Routes: seq, destination, next_hop, if_index, metric; adapters: if_index, description. A route
    whose adapter is not known counts."""
    known = routes.filter(F.col("destination") == DEFAULT_ROUTE).join(adapters.select("if_index", "description"), "if_index", "left")
    real = known.filter(~F.coalesce(F.col("description"), F.lit("")).rlike(VIRTUAL_ADAPTER) & is_routable_gateway(F.col("next_hop")))
    return real.groupBy(F.col("next_hop").alias("ip")).agg(F.min(F.struct("metric", "seq")).alias("order"))


def _routable(ip: Column) -> Column:
    """The address if it may be a seed, evaluated once however often the test looks at it."""
    return F.get(F.filter(F.array(ip), is_routable_gateway), F.lit(0))


def _address(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, _IPV4, 1), F.lit(""))


def text_gateways(lines: DataFrame) -> DataFrame:
    """line and ip of the default routes in lines (line, value) of a routing table: the address after "via",
    or the second column of a line that begins with the default destination."""
    columns = F.split(F.trim(F.col("value")), r"\s+")
    second = F.when(F.get(columns, F.lit(0)).isin("default", "0.0.0.0"), _address(F.get(columns, F.lit(1))))
    ip = F.when(F.contains("value", F.lit("via")), _address(F.split_part("value", F.lit("via"), F.lit(2)))).otherwise(second)
    return lines.select("line", _routable(ip).alias("ip")).filter("ip IS NOT NULL")


def text_neighbors(lines: DataFrame) -> DataFrame:
    """line and ip of the management addresses in a report of the host's own neighbours, one key=value a line."""
    own = lines.filter(F.contains("value", F.lit("chassis.mgmt-ip=")))
    return own.select("line", _routable(_address(F.substring_index("value", "=", -1))).alias("ip")).filter("ip IS NOT NULL")


def merge_seeds(*sources: DataFrame) -> DataFrame:
    """pos and ip: the addresses of all sources (line, ip) once each, at their first mention. A source goes before
    the ones after it; what is named first may be any address."""
    ranked = [s.select(F.struct(F.lit(k).alias("source"), F.col("line").cast("long").alias("line")).alias("at"), "ip").filter("ip <> ''") for k, s in enumerate(sources)]
    whole = ranked[0]
    for more in ranked[1:]:
        whole = whole.unionByName(more)
    return whole.groupBy("ip").agg(F.min("at").alias("at")).select(((F.col("at.source").cast("long") * (1 << 40)) + F.col("at.line")).alias("pos"), "ip")
