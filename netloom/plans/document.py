"""From endpoints, devices, links and tables to the graph: nodes, edges, metadata."""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from netloom.functions.mac import canonical_mac
from netloom.functions.risk import is_offline, label, or_dash, risk_bucket
from netloom.functions.roles import derive_role
from netloom.operators.graph import bfs_order, discovery_order, numbered
from netloom.operators.ladder import Placement, place
from netloom.sources import schema as S
from netloom.sources.landing import document_lines, in_order, join_texts, metadata_lines, publish_tables, remove_folder


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    placement: Placement


def _typed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` as NODE rows: given columns, or its own of that name, or null."""
    out = []
    for field in S.NODE.fields:
        value = columns.get(field.name)
        value = F.col(field.name) if value is None and field.name in df.columns else value
        out.append((F.lit(None) if value is None else value).cast(field.dataType).alias(field.name))
    return df.select(*out)


def device_nodes(devices: DataFrame) -> DataFrame:
    def own(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in devices.columns else default

    none = F.array().cast("array<string>")
    return _typed(devices, {
        "node_id": S.device_id(F.col("chassis_id")),
        "kind": F.lit(S.DEVICE),
        "discovery_method": own("discovery_method", F.lit(S.BY_LLDP)),
        "role": derive_role(F.col("lldp_cap_enabled"), S.DEVICE),
        "risk_score": own("risk_score", F.lit(0.0)),
        "neighbor_ports": own("neighbor_ports", none),
        "uplink_ports": own("uplink_ports", none),
        "port_status": own("port_status", F.create_map().cast("map<string,string>")),
    })


def endpoint_nodes(endpoints: DataFrame, devices: DataFrame, placed: DataFrame) -> DataFrame:
    """Inventory endpoints, with the MAC that placing filled in and the role that a switch reported."""
    said = devices.select("pos", canonical_mac(F.col("chassis_id")).alias("key"), F.col("lldp_cap_enabled").alias("cap")).filter("key IS NOT NULL AND cap <> ''").groupBy("key").agg(F.max_by("cap", "pos").alias("cap"))
    last = endpoints.filter("agent_id IS NOT NULL").groupBy("agent_id").agg(F.max_by(F.struct(*endpoints.columns), "pos").alias("e")).select("e.*")
    filled = placed.filter("kind_order < 2 AND enriched").groupBy("agent_id").agg(F.first("mac").alias("filled"))
    joined = last.withColumn("key", canonical_mac(F.col("mac"))).join(said, "key", "left").join(filled, "agent_id", "left")

    def own(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in endpoints.columns else default

    return _typed(joined, {
        "node_id": S.endpoint_id(F.col("agent_id")),
        "kind": F.lit(S.ENDPOINT),
        "mac": F.coalesce("filled", "mac"),
        "discovery_method": own("discovery_method", F.lit(S.BY_INVENTORY)),
        "role": derive_role(F.col("cap"), S.ENDPOINT),
        "risk_score": own("risk_score", F.lit(0.0)),
        "top_cves": own("top_cves", F.array().cast(S.NODE["top_cves"].dataType)),
    })


def host_nodes(placed: DataFrame) -> DataFrame:
    """Hosts that only the MAC table knows; they have no risk, which is not a risk of 0."""
    return _typed(placed.filter("kind_order = 2"), {"kind": F.lit(S.ENDPOINT), "discovery_method": F.lit(S.BY_FDB), "status": F.lit("discovered"), "role": derive_role(F.lit(None).cast("string"), S.ENDPOINT)})


def attachments(placed: DataFrame) -> DataFrame:
    """One placement for each node id, the first."""
    return placed.groupBy("node_id").agg(F.min_by(F.struct("kind_order", "order", "parent", "port", "confidence", "reason"), F.struct("kind_order", "order")).alias("p")).select("node_id", "p.*")


def named_edges(links: DataFrame, placed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between devices, then attachments, in order, with the names of both ends."""
    names = nodes.select("node_id", label(F.col("hostname"), F.col("ip"), F.col("node_id")).alias("name"))
    none = F.lit(None).cast("string")
    between = links.select(F.struct(F.lit(0).alias("k"), F.col("seq").alias("pos"), F.lit(0).cast("long").alias("seq")).alias("key"), S.device_id(F.col("source_chassis_id")).alias("source"), S.device_id(F.col("target_chassis_id")).alias("target"), F.lit(S.LLDP_EDGE).alias("type"), "local_port", "remote_port", none.alias("confidence"))
    attached = attachments(placed).filter("parent IS NOT NULL").select(F.struct((F.col("kind_order") + 1).alias("k"), F.col("order.pos").alias("pos"), F.col("order.seq").alias("seq")).alias("key"), F.col("node_id").alias("source"), S.device_id(F.col("parent")).alias("target"), F.lit(S.ENDPOINT_EDGE).alias("type"), F.col("port").alias("local_port"), none.alias("remote_port"), "confidence")
    edges = between.unionByName(attached)
    for end in ("source", "target"):
        edges = edges.join(names.select(F.col("node_id").alias(end), F.col("name").alias(f"{end}_name")), end, "left").withColumn(f"{end}_name", F.coalesce(f"{end}_name", end))
    return edges


def build_graph(endpoints: DataFrame, devices: DataFrame, links: DataFrame, fdb: DataFrame, arp: DataFrame) -> Graph:
    """The graph of a scan."""
    placement = place(endpoints, devices, links, fdb, arp)
    placed = placement.placed
    order = discovery_order(bfs_order(placement.devices, placement.links), attachments(placed))
    nodes = device_nodes(placement.devices).unionByName(endpoint_nodes(endpoints, devices, placed)).unionByName(host_nodes(placed))
    stamped = nodes.drop("discovery_order", "parent_id").join(order.select("node_id", F.col("discovery_order").cast("int").alias("discovery_order"), "parent_id"), "node_id", "left").select(*S.NODE.fieldNames())
    edges = numbered(named_edges(placement.links, placed, nodes), "seq", F.col("key"), F.col("source"), F.col("target")).drop("key")
    return Graph(stamped, edges, placement)


def edge_styles(edges: DataFrame) -> DataFrame:
    """Edges as a diagram draws them: id (by place), ends, label, and dashed for attachments."""
    return edges.select(F.concat(F.lit("e"), F.col("seq")).alias("id"), "source", "target", F.nullif("local_port", F.lit("")).alias("label"), (F.col("type") == S.ENDPOINT_EDGE).alias("dashed"))


#: The fields of a node that a detail view lists, in its order.
IDENTITY = ("hostname", "ip", "mac", "vendor", "model", "firmware", "serial", "role", "discovery_method", "status")


def detail_rows(nodes: DataFrame) -> DataFrame:
    """What a detail view shows of every node, a row for each line: node_id, section, at (its place there, from 0), label
    and value. Sections: head, identity; for endpoints findings, in their order; for devices ports, by name, and topology.
    Null and empty text is shown as a dash; a node without findings or ports has no rows there."""

    def row(section: str, at: Column, label_: Column, value: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), at.cast("long").alias("at"), label_.alias("label"), value.alias("value"))

    def lines(section: str, *shown: tuple[str, Column]) -> Column:
        return F.array(*(row(section, F.lit(k), F.lit(name), value) for k, (name, value) in enumerate(shown)))

    def some(value: Column) -> Column:
        return F.nullif(value.cast("string"), F.lit(""))

    under = F.concat_ws(" · ", F.coalesce(some(F.col("role")), F.col("kind")), some(F.col("discovery_method")))
    head = lines("head", ("title", label(F.col("hostname"), F.col("ip"), F.col("node_id"))), ("under", under), ("risk", risk_bucket(F.col("risk_score"))), ("offline", F.when(is_offline(F.col("status")), "yes").otherwise("no")))
    identity = lines("identity", *((name, or_dash(F.col(name))) for name in IDENTITY))

    def finding(x: Column, k: Column) -> Column:
        version = F.concat(F.lit(" (v"), some(x["cvss_version"]), F.lit(")"))
        score = F.concat(x["cvss"].cast("string"), F.coalesce(version, F.lit("")))
        return row("findings", k, x["cve"], F.concat_ws(" · ", some(x["severity"]), score, some(x["package"]), some(x["version"]), some(x["description"])))

    findings = F.transform("top_cves", finding)
    ports = F.transform(F.array_sort(F.map_entries("port_status")), lambda x, k: row("ports", k, x["key"], x["value"]))
    topology = lines("topology", *((name, or_dash(F.array_join(name, ", "))) for name in ("neighbor_ports", "uplink_ports")))
    none = F.array().cast("array<struct<section:string,at:bigint,label:string,value:string>>")
    own = F.when(F.col("kind") == S.DEVICE, F.concat(F.coalesce(ports, none), topology)).otherwise(F.coalesce(findings, none))
    return nodes.select("node_id", F.explode(F.concat(head, identity, own)).alias("x")).select("node_id", "x.*")


def toolbar_counts(graph: Graph) -> DataFrame:
    """One row: devices that answer, and edges of both kinds together."""
    shown = counts(graph).select((F.col("lldp_edges") + F.col("endpoint_edges")).alias("edges"), F.lit(1).alias("k"))
    polled = graph.placement.devices.agg(F.count_if("pollable").alias("pollable")).withColumn("k", F.lit(1))
    return polled.join(shown, "k").drop("k")


def node_counts(kind: Column, method: Column, loose: Column) -> list[Column]:
    """What a document counts of its nodes, as aggregates: for a job of its own or for one that writes them."""
    endpoint = kind == S.ENDPOINT
    return [F.count(kind).alias("nodes"), F.count_if(endpoint & (method != S.BY_FDB)).alias("endpoints"), F.count_if(kind == S.DEVICE).alias("devices"), F.count_if(method == S.BY_FDB).alias("fdb_discovered_hosts"), F.count_if(endpoint & loose).alias("unparented_endpoints")]


def edge_counts(kind: Column) -> list[Column]:
    return [F.count_if(kind == S.LLDP_EDGE).alias("lldp_edges"), F.count_if(kind == S.ENDPOINT_EDGE).alias("endpoint_edges")]


def evidence_counts(kind: Column, confidence: Column) -> list[Column]:
    """Attachments by their confidence."""
    return [F.count_if((kind == S.ENDPOINT_EDGE) & (confidence == c)).alias(f"by_{c}") for c in (S.LLDP, S.RESOLVED, S.TIEBREAK, S.SUBNET, S.FDB)]


def counts(graph: Graph) -> DataFrame:
    """One row of counts."""
    nodes = graph.nodes.agg(*node_counts(F.col("kind"), F.col("discovery_method"), F.col("parent_id").isNull()))
    edges = graph.edges.agg(*edge_counts(F.col("type")))
    return nodes.withColumn("k", F.lit(1)).join(edges.withColumn("k", F.lit(1)), "k").drop("k")


def publish_graph(graph: Graph, folder: str) -> dict:
    """Publishes nodes and edges as one version of tables; what is counted of them is counted while they are written."""
    of_nodes, of_edges = Observation(), Observation()
    nodes = graph.nodes.observe(of_nodes, *node_counts(F.col("kind"), F.col("discovery_method"), F.col("parent_id").isNull()))
    edges = graph.edges.observe(of_edges, *edge_counts(F.col("type")), *evidence_counts(F.col("type"), F.col("confidence")))
    publish_tables({"nodes": nodes, "edges": edges}, folder)
    return {**of_nodes.get, **of_edges.get}


def write_document(graph: Graph, path: str, **about) -> dict:
    """Writes the document in parts, in ranges of its order, and joins these into one file that takes the place of
    ``path`` when it is whole; no row passes the driver. Counts are those of the job that writes the rows. Returns them."""
    spark, scratch, seen = graph.nodes.sparkSession, f"{path}.{uuid4().hex}", Observation()
    # counted behind the exchange: what lies before it is also read for its ranges
    node, edge = F.col("node"), F.col("edge")
    of_both = [*node_counts(node["kind"], node["discovery_method"], node["loose"]), *edge_counts(edge["type"]), *evidence_counts(edge["type"], edge["confidence"])]
    in_order(document_lines(graph.nodes, graph.edges)).observe(seen, *of_both).select("value").write.text(f"{scratch}/1")
    shown = seen.get
    known, lists = described(graph, shown, **about)

    def items(rows: DataFrame, order: Column, *names: str) -> DataFrame:
        whole = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
        return numbered(rows.select(order.alias("order"), whole.alias("value"), "node_id"), "at", F.col("order"), F.col("node_id")).select("at", "value")

    made = {name: items(*rows) for name, rows in lists.items()}
    in_order(metadata_lines(spark, known, made)).select("value").write.text(f"{scratch}/2")
    join_texts(spark, [f"{scratch}/1", f"{scratch}/2"], path)
    remove_folder(spark, scratch)
    return shown


def confidence_histogram(placed: DataFrame) -> DataFrame:
    return attachments(placed).filter("confidence IS NOT NULL").groupBy("confidence").count()


def unparented(graph: Graph) -> DataFrame:
    missing = attachments(graph.placement.placed).filter("parent IS NULL").select("node_id", "reason", "order")
    return missing.join(graph.nodes.select("node_id", "hostname"), "node_id")


def unreachable(devices: DataFrame) -> DataFrame:
    """Devices at which the scan ended: those that don't answer."""
    silent = (~F.col("pollable")) | (F.col("status") == "unreachable")
    return devices.filter(F.coalesce(silent, F.lit(False)))


def shared_addresses(nodes: DataFrame) -> DataFrame:
    """Addresses that more than one node has."""
    return nodes.filter("ip <> ''").groupBy("ip").agg(F.count("*").alias("n")).filter("n > 1")


def described(graph: Graph, shown: dict, *, scan_time: str | None = None, network_scan_time: str | None = None, seed: str | None = None, timing: dict | None = None) -> tuple[dict, dict]:
    """What the document says about itself, from the counts of its rows, and its lists of what needs attention (places
    not found, ends of the scan): rows with node_id, their order, and the names of their columns."""
    confidence = {k.removeprefix("by_"): n for k, n in shown.items() if k.startswith("by_") and n}
    known = {
        "scan_time": scan_time,
        "network_scan_time": network_scan_time,
        "seed": seed,
        "counts": {k: n for k, n in shown.items() if not k.startswith("by_")},
        "confidence": confidence,
        "merged_lldp_endpoints": graph.placement.phantoms.count(),
        "fdb_discovered_hosts": shown["fdb_discovered_hosts"],
        "fdb_enriched_nodes": graph.placement.placed.filter("enriched").count(),
        "timing": timing,
    }
    status = F.col("status") if "status" in graph.placement.devices.columns else F.lit(None).cast("string")
    ends = unreachable(graph.placement.devices.withColumn("status", status)).withColumn("node_id", S.device_id(F.col("chassis_id")))
    lists = {
        "unparented_endpoints": (unparented(graph), F.col("order"), "node_id", "hostname", "reason"),
        "unreachable_boundaries": (ends, F.col("pos"), "node_id", "chassis_id", "ip", "status"),
    }
    return known, lists


def metadata(graph: Graph, **about) -> dict:
    """The same for small graphs, with the lists' rows."""
    seen = graph.edges.agg(*evidence_counts(F.col("type"), F.col("confidence"))).first().asDict()
    known, lists = described(graph, counts(graph).first().asDict() | seen, **about)
    rows = {name: [r.asDict() for r in df.orderBy(order, "node_id").select(*names).toLocalIterator()] for name, (df, order, *names) in lists.items()}
    return known | rows
