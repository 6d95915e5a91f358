"""Inventory records of endpoints, their network card and their findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from netloom.functions.mac import canonical_mac, colon_form, is_locally_administered
from netloom.functions.net import has_virtual_name, is_host_address
from netloom.operators.graph import numbered
from netloom.sources.schema import BY_INVENTORY

# Serials that mean nothing, and the id of the inventory's own manager.
JUNK_SERIALS = ("", "unknown", "0", "To be filled by O.E.M.", "Not Specified")
MANAGER = "000"


def without_manager(agents: DataFrame) -> DataFrame:
    """Agents with an id, the manager excluded."""
    return agents.filter(F.col("id").isNotNull() & (F.col("id") != MANAGER))


def clean_serial(serial: Column) -> Column:
    return F.when(~serial.isin(*JUNK_SERIALS), serial)


def first_serial(hardware: DataFrame) -> DataFrame:
    """agent_id and serial of the first hardware row, null if it is junk."""
    return hardware.groupBy("agent_id").agg(F.min_by("board_serial", "pos").alias("serial")).withColumn("serial", clean_serial(F.col("serial")))


def project_agents(agents: DataFrame) -> DataFrame:
    """Agent records under the names of endpoints."""
    return agents.select(F.col("id").alias("agent_id"), F.col("name").alias("hostname"), "ip", F.col("os.platform").alias("vendor"), F.col("os.name").alias("model"), F.col("os.version").alias("firmware"), "status", F.lit(BY_INVENTORY).alias("discovery_method"))


def interface_addresses(netiface: DataFrame, netaddr: DataFrame) -> DataFrame:
    """Interfaces with their IPv4 addresses; one without any is dropped."""
    addresses = netaddr.filter(is_host_address(F.col("proto"), F.col("address"))).groupBy("agent_id", F.col("iface").alias("name")).agg(F.collect_list("address").alias("addresses"))
    return netiface.join(addresses, ["agent_id", "name"])


def select_mac(netiface: DataFrame, netaddr: DataFrame, agents: DataFrame) -> DataFrame:
    """agent_id and mac of the card that stands for each agent (agent_id, ip).

    Physical cards with an address count: the first that has the agent's address,
    whatever its state, else the first that is up, else the first.
    """
    cards = interface_addresses(netiface, netaddr).filter(~is_locally_administered(F.col("mac")) & ~has_virtual_name(F.col("name")))
    known = cards.join(agents.select("agent_id", "ip"), "agent_id")
    hit = F.coalesce((F.col("ip") != "") & F.array_contains("addresses", F.col("ip")), F.lit(False))
    up = ~hit & F.coalesce(F.lower("state") == "up", F.lit(False))
    order = F.struct((~hit).alias("a"), (~up).alias("b"), "pos")
    return known.groupBy("agent_id").agg(F.min_by("mac", order).alias("mac")).withColumn("mac", colon_form(canonical_mac(F.col("mac"))))


def collect_endpoints(agents: DataFrame, netiface: DataFrame, netaddr: DataFrame, hardware: DataFrame) -> DataFrame:
    """Endpoints with pos (by id) of inventory records: the manager left out, with serial and MAC."""
    known = project_agents(without_manager(agents))
    macs = select_mac(netiface, netaddr, known.select("agent_id", "ip"))
    whole = known.join(first_serial(hardware), "agent_id", "left").join(macs, "agent_id", "left")
    return numbered(whole, "pos", F.col("agent_id"))


def parse_findings(hits: DataFrame) -> DataFrame:
    """Flat findings of nested search hits; whatever is missing is null."""
    v, p = "_source.vulnerability", "_source.package"
    return hits.select("agent_id", F.col(f"{v}.id").alias("cve"), F.col(f"{v}.score.base").alias("cvss"), F.col(f"{v}.score.version").alias("cvss_version"), F.col(f"{v}.severity").alias("severity"), F.col(f"{p}.name").alias("package"), F.col(f"{p}.version").alias("version"), F.col(f"{v}.description").alias("description"))


def top_findings(findings: DataFrame, k: int = 3) -> DataFrame:
    """The k findings with the highest scores of each agent, with rank; ties by id.

    The ranking keeps at most k rows of an agent in each partition before the
    shuffle, so an agent with very many findings is no hot key.
    """
    order = W.partitionBy("agent_id").orderBy(F.desc_nulls_last("cvss"), "cve")
    return findings.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def risk_scores(top: DataFrame) -> DataFrame:
    """agent_id and the score of its first finding, 0 if that has none."""
    return top.groupBy("agent_id").agg(F.coalesce(F.min_by("cvss", "rank"), F.lit(0.0)).alias("risk_score"))


def score_endpoints(endpoints: DataFrame, findings: DataFrame, k: int = 3) -> DataFrame:
    """Endpoints with top_cves (an array in rank order, [] without findings) and risk_score."""
    fields = [c for c in ("cve", "cvss", "cvss_version", "severity", "package", "version", "description") if c in findings.columns]
    ranked = top_findings(findings, k).groupBy("agent_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.struct(*fields).alias("finding")))).alias("ranked"))
    joined = endpoints.join(ranked, "agent_id", "left")
    top = F.transform("ranked", lambda x: x["finding"])
    scored = joined.withColumn("top_cves", F.coalesce(top, F.array().cast(ranked.select(top.alias("x")).schema["x"].dataType)))
    return scored.withColumn("risk_score", F.coalesce(F.get("top_cves", F.lit(0))["cvss"], F.lit(0.0))).drop("ranked")
