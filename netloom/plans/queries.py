"""Every operator as a query over the driver's tables; ``oracles`` has the SQL to compare with."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import mac as M
from netloom.functions import net as N
from netloom.functions import oid as O
from netloom.functions import risk as R
from netloom.functions import roles as C
from netloom.functions import vendors as V
from netloom.operators import crawl as K
from netloom.operators import endpoints as E
from netloom.operators import graph as G
from netloom.operators import ladder as L
from netloom.operators import mactable as T
from netloom.operators import walks as P
from netloom.plans import document as D
from netloom.plans import landed as A
from netloom.sources import landing as IO
from netloom.sources import schema as S
from netloom.sources import seeds as Z
from netloom.sources.answers import read_answers
from netloom.sources.scenario import Scenario, build_scenario
from netloom.sources.session import checkpoint, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def on_scenario(run: Callable[[Scenario], DataFrame]) -> Query:
    QUERIES[run.__name__] = lambda spark, sf_dir: run(build_scenario(spark, sf_dir))
    return QUERIES[run.__name__]


def _placed(s: Scenario) -> L.Placement:
    return L.place(s.endpoints, s.devices, s.links, s.fdb, s.arp)


def _graph(s: Scenario) -> D.Graph:
    scored = E.score_endpoints(s.endpoints, s.findings)
    return D.build_graph(scored.select("pos", "agent_id", "hostname", "ip", "mac", "status", "risk_score"), s.devices, s.links, s.fdb, s.arp)


def _walks(s: Scenario, *made: Callable[[Scenario], DataFrame]) -> DataFrame:
    """The walks as a crawl finds them: landed, not derived anew for each table that is read."""
    return checkpoint(reduce(DataFrame.unionByName, (make(s) for make in made)))


# --- addresses, roles, vendors -------------------------------------------------------------


@on_scenario
def mac_canonical(s):
    return s.endpoints.select("pos", M.canonical_mac(A.spelled(F.col("true_mac"), F.col("pos") % 5)).alias("mac_key"))


@on_scenario
def mac_format(s):
    return s.endpoints.select("pos", M.format_mac(A.spelled(F.col("true_mac"), F.col("pos") % 5)).alias("mac"))


@on_scenario
def mac_from_bytes(s):
    raw = F.unhex(F.regexp_replace("true_mac", ":", ""))
    return s.endpoints.select("pos", M.canonical_mac_bytes(F.when(F.col("pos") % 2 == 0, raw).otherwise(F.encode("true_mac", "UTF-8"))).alias("mac_key"))


@on_scenario
def mac_rejects_addresses(s):
    return s.endpoints.select("pos", M.canonical_mac(F.when(F.col("pos") % 2 == 0, F.lit("192.168.100.254")).otherwise(F.col("hostname"))).alias("mac_key"))


@on_scenario
def locally_administered(s):
    head = F.when(F.col("pos") % 3 == 0, "02").when(F.col("pos") % 3 == 1, "e4").otherwise("zz")
    return s.endpoints.select("pos", M.is_locally_administered(F.concat(head, F.substring("true_mac", 3, 15))).alias("local"))


@on_scenario
def chassis_normalize(s):
    raw = F.when(F.col("pos") % 4 == 0, F.upper("true_mac")).when(F.col("pos") % 4 == 1, F.concat(F.lit("0xCore  "), F.upper("hostname"))).when(F.col("pos") % 4 == 2, F.lit("  "))
    return s.endpoints.select("pos", M.normalize_chassis_id(raw).alias("chassis_id"))


@on_scenario
def same_subnet(s):
    return s.endpoints.select("pos", N.same_subnet(F.col("ip"), F.lit("10.0.3.254")).alias("near"), N.same_subnet(F.col("ip"), F.lit("10.0.200.1"), 16).alias("wide"), N.same_subnet(F.col("hostname"), F.col("ip")).alias("broken"))


@on_scenario
def routable_gateway(s):
    ip = F.when(F.col("pos") % 6 == 0, "0.0.0.0").when(F.col("pos") % 6 == 1, "127.0.0.1").when(F.col("pos") % 6 == 2, "224.0.0.5").when(F.col("pos") % 6 == 3, "300.1.1.1").otherwise(F.col("ip"))
    return s.endpoints.select("pos", N.is_routable_gateway(ip).alias("routable"))


@on_scenario
def capability_decode(s):
    return s.devices.select("pos", F.array_join(C.decode_capabilities(F.col("lldp_cap_enabled")), ",").alias("capabilities"))


@on_scenario
def device_role(s):
    return s.devices.select("pos", C.derive_role(F.col("lldp_cap_enabled"), "device").alias("role"), C.derive_role(F.col("lldp_cap_enabled"), "endpoint").alias("endpoint_role"))


@on_scenario
def neighbor_infrastructure(s):
    return s.devices.select("pos", C.is_infrastructure(F.col("ip"), F.col("lldp_cap_enabled")).alias("with_ip"), C.is_infrastructure(F.lit(""), F.col("lldp_cap_enabled")).alias("without_ip"))


@on_scenario
def enterprise_number(s):
    walks = IO.get_many(A.system_walks(s), {"oid": K.SYSTEM["sys_object_id"]})
    return walks.select("device_ip", V.enterprise_number(F.col("oid")).alias("enterprise"))


@on_scenario
def vendor_model(s):
    return K.system_info(A.system_walks(s)).select("device_ip", "hostname", "vendor", "model", "serial", "mac", "chassis_id", "cap_enabled")


@on_scenario
def firmware_parse(s):
    return K.system_info(A.system_walks(s)).select("device_ip", "firmware")


@query
def vendor_guess(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    way = F.col("p_partkey") % 4
    text = F.when(way == 0, F.concat(F.lit("a Juniper "), "p_name")).when(way == 1, F.concat(F.lit("FortiGate by CISCO "), "p_name")).when(way == 2, F.lit("FORTINET"))
    return part.select("p_partkey", V.vendor_of_description(text).alias("vendor"))


# --- endpoints -----------------------------------------------------------------------------


@query
def agent_projection(spark, sf_dir):
    return E.project_agents(A.inventory(spark, sf_dir)["agents"])


@query
def manager_filter(spark, sf_dir):
    return E.without_manager(A.inventory(spark, sf_dir)["agents"]).select("id", "name")


@query
def serial_clean(spark, sf_dir):
    return E.first_serial(A.inventory(spark, sf_dir)["hardware"])


@query
def iface_addr_join(spark, sf_dir):
    rows = A.inventory(spark, sf_dir)
    return E.interface_addresses(rows["netiface"], rows["netaddr"]).select("agent_id", "name", F.explode("addresses").alias("address"))


@query
def physical_iface(spark, sf_dir):
    rows = A.inventory(spark, sf_dir)["netiface"]
    return rows.select("agent_id", F.col("pos").cast("long").alias("pos"), (~M.is_locally_administered(F.col("mac")) & ~N.has_virtual_name(F.col("name"))).alias("physical"))


@query
def select_mac(spark, sf_dir):
    rows = A.inventory(spark, sf_dir)
    return E.select_mac(rows["netiface"], rows["netaddr"], rows["asked"])


def _searched(spark: SparkSession, sf_dir: str, **terms: list) -> DataFrame:
    """Hits of search answers, one answer an agent, landed as they came and read by the data source."""
    folder = f"{shared_folder(spark)}/answers-{uuid4().hex}"
    hits = A.search_hits(build_scenario(spark, sf_dir))
    listed = hits.groupBy("agent_id").agg(F.collect_list(F.struct("agent_id", "_source")).alias("hits"))
    listed.select(F.to_json(F.struct(F.struct("hits").alias("hits")))).write.text(folder)
    return read_answers(spark, folder, S.VULNERABILITY, "hits.hits", {f"_source.vulnerability.{name}": values for name, values in terms.items()})


@query
def answers_topk(spark, sf_dir):
    """The findings with the highest scores of each agent, of landed search answers."""
    return E.top_findings(E.parse_findings(_searched(spark, sf_dir))).select("agent_id", "cve", "cvss", F.col("rank").cast("long").alias("rank"))


@query
def answers_term(spark, sf_dir):
    """Findings of one severity: the term reaches the answers."""
    return E.parse_findings(_searched(spark, sf_dir, severity=["High"])).select("agent_id", "cve", "cvss")


@on_scenario
def topk_cves(s):
    return E.top_findings(s.findings).select("agent_id", "cve", "cvss", F.col("rank").cast("long").alias("rank"))


@on_scenario
def risk_score(s):
    return E.risk_scores(E.top_findings(s.findings))


@on_scenario
def parse_hit(s):
    return E.parse_findings(A.search_hits(s))


@on_scenario
def agent_scored(s):
    scored = E.score_endpoints(s.endpoints, E.parse_findings(A.search_hits(s)))
    return scored.select("agent_id", "risk_score", F.posexplode_outer("top_cves").alias("k", "c")).select("agent_id", "risk_score", F.col("k").cast("long").alias("k"), F.col("c.cve").alias("cve"), F.col("c.severity").alias("severity"))


# --- walks ---------------------------------------------------------------------------------


@on_scenario
def oid_dot1q_decode(s):
    return P.dot1q_rows(A.forwarding_walks(s)).select("device_ip", "seq", "vlan", "mac", "bridge_port")


@on_scenario
def oid_dot1d_decode(s):
    return P.dot1d_rows(A.forwarding_walks(s)).select("device_ip", "context", "seq", "mac", "bridge_port")


@on_scenario
def oid_octet_guard(s):
    octet = F.when(F.col("pos") % 3 == 0, "300").when(F.col("pos") % 3 == 1, "x").otherwise("255")
    return s.endpoints.select("pos", O.mac_of_octets(F.split(F.concat(F.lit("1.2.3.4.5."), octet), r"\.")).alias("mac"))


@on_scenario
def arp_decode(s):
    return P.arp_rows(A.forwarding_walks(s)).select("seq", "mac", "ip")


@on_scenario
def mgmt_addr_decode(s):
    return P.management_addresses(A.neighbor_walks(s)).select("device_ip", "local_num", "mgmt_ip")


@on_scenario
def port_resolution(s):
    walks = A.forwarding_walks(s)
    return P.interface_names(walks).select("device_ip", "ifindex", "name")


@on_scenario
def port_status(s):
    return P.port_status(A.forwarding_walks(s))


@on_scenario
def vlan_filter(s):
    return P.operational_vlans(A.forwarding_walks(s))


@on_scenario
def vlan_names(s):
    return P.vlan_names(A.forwarding_walks(s))


@on_scenario
def own_macs(s):
    return P.own_macs(A.forwarding_walks(s)).select("device_ip", F.array_join("own_macs", ",").alias("own_macs"))


@on_scenario
def build_fdb(s):
    return P.build_fdb(_walks(s, A.forwarding_walks))


def _stored(spark: SparkSession, walks: DataFrame) -> DataFrame:
    """The walks as a crawl lands them for many readers."""
    folder = f"{shared_folder(spark)}/walks-{uuid4().hex}"
    IO.store_walks(walks, folder)
    return IO.read_stored_walks(spark, folder)


@query
def build_fdb_stored(spark, sf_dir):
    """The same from stored walks: ranges of the identifier's key, partitions of the contexts that are read."""
    return P.build_fdb(_stored(spark, A.forwarding_walks(build_scenario(spark, sf_dir))))


@query
def walk_key_range(spark, sf_dir):
    """The rows of a table of stored walks, found by a range of the key, which orders them as the tree does."""
    rows = IO.walk_range(_stored(spark, A.forwarding_walks(build_scenario(spark, sf_dir))), O.DOT1Q_FDB_PORT)
    return rows.select("device_ip", "oid", "seq", F.lower(F.hex("oid_key")).alias("key"))


@on_scenario
def lldp_rem_pivot(s):
    return P.remote_cells(A.neighbor_walks(s)).select("device_ip", "local_num", "port_id", "port_descr", "sys_name", "cap_enabled")


@on_scenario
def build_neighbors(s):
    return P.build_neighbors(A.neighbor_walks(s)).select("device_ip", "local_port", "chassis_id", "chassis_mac", "remote_port", "sys_name", "sys_descr", "mgmt_ip", "cap_enabled")


@on_scenario
def uplink_split(s):
    return P.split_ports(P.build_neighbors(A.neighbor_walks(s))).select("device_ip", F.array_join("neighbor_ports", ",").alias("neighbor_ports"), F.array_join("uplink_ports", ",").alias("uplink_ports"))


# --- MAC table and ladder ------------------------------------------------------------------


@on_scenario
def port_mac_count(s):
    return T.port_mac_count(s.fdb)


@on_scenario
def infra_macs(s):
    return T.infra_macs(s.devices)


@on_scenario
def mac_table(s):
    return T.mac_table(s.fdb, s.arp, s.devices).drop("order")


@on_scenario
def mac_by_ip(s):
    return T.mac_by_ip(T.mac_table(s.fdb, s.arp, s.devices))


@on_scenario
def lldp_phantom_merge(s):
    return L.merged_phantoms(s.endpoints, L.known_devices(s.devices), s.links).select("chassis_id", "agent_id", "by", "port")


@on_scenario
def surviving_lldp_edges(s):
    devices = L.known_devices(s.devices)
    staying = devices.join(L.merged_phantoms(s.endpoints, devices, s.links), "chassis_id", "left_anti")
    return L.surviving_links(s.links, staying)


@on_scenario
def subnet_parent(s):
    nets = L.subnet_parents(s.devices)
    return s.endpoints.withColumn("net", N.subnet_key(F.col("ip"))).join(nets, "net", "left").select("agent_id", "gateway")


def _mixed(pos, nk) -> Column:
    """An address of one of the two families, or something that is none."""
    low = F.lower(F.hex(pos))
    six = F.when(pos % 20 == 1, F.lit("::")).when(pos % 20 == 2, F.lit("::1")).when(pos % 20 == 4, F.concat(F.lit("ff02::"), low)).when(pos % 20 == 5, F.lit("2001:db8::1::2"))
    return F.coalesce(F.when(pos % 3 == 0, F.concat_ws(".", F.lit("10.0"), nk, pos % 250 + 1)), six, F.when(pos % 3 == 1, F.concat(F.lit("2001:DB8:"), F.hex(nk), F.lit("::"), low)), F.concat(F.lit("fd00:0:0:"), F.lower(F.hex(nk)), F.lit(":0:0:0:"), low))


@on_scenario
def mixed_addresses(s):
    """Addresses of both families: key, networks, and whether they may be gateways."""
    ip = _mixed(F.col("pos"), F.col("nk").cast("long"))
    shown = s.endpoints.select("pos", ip.alias("ip"))
    return shown.select("pos", "ip", N.address_key(F.col("ip")).alias("key"), N.subnet_key(F.col("ip")).alias("net24"), N.subnet_key(F.col("ip"), 46).alias("net46"), N.same_subnet(F.col("ip"), F.lit("2001:db8:3:0:1::"), 48).alias("near"), N.is_routable_gateway(F.col("ip")).alias("routable"))


@on_scenario
def subnet_parent_mixed(s):
    """Endpoints of both families under the device that stands for their network of 64 bits, or 24."""
    n = F.col("pos").cast("long")
    devices = s.devices.filter("pos < 1000").select("pos", "chassis_id", "pollable", F.when(n % 2 == 0, F.concat(F.lit("FD00:0:0:"), F.hex(n), F.lit("::FE"))).otherwise(F.col("ip")).alias("ip"))
    hosts = s.endpoints.select("agent_id", _mixed(F.col("pos"), F.col("nk").cast("long")).alias("ip"))
    parents = L.subnet_parents(devices.filter(F.contains("ip", F.lit(":"))), 64).unionByName(L.subnet_parents(devices.filter(~F.contains("ip", F.lit(":")))))
    net = F.when(F.contains("ip", F.lit(":")), N.subnet_key(F.col("ip"), 64)).otherwise(N.subnet_key(F.col("ip")))
    return hosts.withColumn("net", net).join(parents, "net", "left").select("agent_id", "gateway")


@on_scenario
def ip_enrichment(s):
    return _placed(s).placed.filter("enriched").select("agent_id", "mac")


@on_scenario
def host_discovery(s):
    return _placed(s).placed.filter("kind_order = 2").select("node_id", "ip", "parent", "port")


@on_scenario
def parent_ladder(s):
    return _placed(s).placed.select("node_id", "parent", "port", "confidence", "reason")


# --- graph ---------------------------------------------------------------------------------


@on_scenario
def edge_list_named(s):
    return _graph(s).edges.drop("seq")


@on_scenario
def confidence_hist(s):
    return D.confidence_histogram(_placed(s).placed).withColumnRenamed("count", "n")


@on_scenario
def graph_counts(s):
    return D.counts(_graph(s))


@on_scenario
def unparented(s):
    return D.unparented(_graph(s)).select("node_id", "hostname", "reason")


@on_scenario
def unreachable(s):
    return D.unreachable(s.devices.withColumn("status", F.lit("online"))).select("chassis_id", "ip")


@on_scenario
def dedupe_links(s):
    turned = s.links.select((F.col("seq") + 5000).alias("seq"), F.col("target_chassis_id").alias("source_chassis_id"), F.col("source_chassis_id").alias("target_chassis_id"), F.when(F.col("seq") % 2 == 0, F.lit("")).otherwise(F.col("remote_port")).alias("local_port"), F.lit("late").alias("remote_port"))
    quiet = s.links.withColumn("local_port", F.when(F.col("seq") % 3 == 0, F.lit("")).otherwise(F.col("local_port")))
    return G.dedupe_links(quiet.unionByName(turned))


@on_scenario
def components(s):
    """Over every device but one, whose loss takes the network apart."""
    staying = s.devices.filter("pos <> 1")
    return G.bfs_order(staying, L.surviving_links(s.links, staying)).select("chassis_id", "root")


@on_scenario
def components_all(s):
    return G.bfs_order(s.devices, L.surviving_links(s.links, s.devices)).select("chassis_id", "root")


@on_scenario
def bfs_order(s):
    return G.bfs_order(s.devices, L.surviving_links(s.links, s.devices)).select("chassis_id", "depth", "parent", "rank")


QUERIES["bfs_order_all"] = QUERIES["bfs_order"]


@on_scenario
def discovery_order(s):
    return _graph(s).nodes.select("node_id", "parent_id", F.col("discovery_order").cast("long").alias("discovery_order"))


@on_scenario
def node_document(s):
    nodes = _graph(s).nodes
    return nodes.select("node_id", "kind", "ip", "hostname", "mac", "discovery_method", "status", "role", "risk_score", "parent_id", "agent_id", "chassis_id", "pollable")


@on_scenario
def node_json(s):
    nodes = _graph(s).nodes
    written = IO.node_json(F.col("kind"))
    return nodes.select("node_id", F.get_json_object(written, "$.parent_id").alias("parent_id"), F.contains(written, F.lit('"serial":null')).alias("nulls_written"), F.contains(written, F.lit('"chassis_id"')).alias("is_device_form"))


@on_scenario
def edge_json(s):
    edges = _graph(s).edges
    written = IO.edge_json()
    return edges.select("source", "target", F.contains(written, F.lit("remote_port")).alias("has_remote"), F.contains(written, F.lit("confidence")).alias("has_confidence"))


@on_scenario
def risk_bucket(s):
    scored = s.endpoints.join(E.risk_scores(E.top_findings(s.findings)), "agent_id", "left")
    return scored.select("agent_id", R.risk_bucket(F.col("risk_score")).alias("bucket"))


@on_scenario
def offline_flag(s):
    return s.endpoints.select("agent_id", R.is_offline(F.upper("status")).alias("offline"), R.label(F.when(F.col("pos") % 2 == 0, F.lit("")).otherwise(F.col("hostname")), F.when(F.col("pos") % 3 != 0, F.col("ip")), F.col("agent_id")).alias("label"))


@on_scenario
def role_icon(s):
    return s.devices.select("pos", R.icon(F.upper(C.derive_role(F.col("lldp_cap_enabled"), "device"))).alias("icon"), R.or_dash(F.col("hostname")).alias("shown"))


@on_scenario
def children_semi(s):
    return G.depths_and_siblings(_graph(s).nodes).select("node_id", "parent_id", F.col("sibling_rank").cast("long").alias("sibling_rank"))


@on_scenario
def node_lookup(s):
    return _graph(s).nodes.filter(F.col("node_id") == "endpoint:00007").select("node_id", "hostname", "role")


@on_scenario
def duplicate_ips(s):
    return D.shared_addresses(s.endpoints)


@on_scenario
def pollable_backbone(s):
    return K.network_document(s.devices, s.links, pollable_only=True)[1].select("source_chassis_id", "target_chassis_id", "local_port", "remote_port")


@on_scenario
def network_nodes(s):
    return K.network_document(s.devices, s.links, pollable_only=True)[0].select("chassis_id", "ip")


@on_scenario
def seed_distinct(s):
    seeds = s.devices.select("pos", "ip").unionByName(s.devices.select((F.col("pos") + 7).alias("pos"), "ip"))
    return K.distinct_seeds(seeds)


def _seed(s: Scenario) -> DataFrame:
    return s.devices.filter("pos = 0").select("pos", "ip")


@on_scenario
def crawl_frontier(s):
    """The devices of a whole crawl; ``max_nodes`` is an option that tests cover."""
    devices, _ = K.crawl_walks(_seed(s), _walks(s, A.neighbor_walks, A.system_walks))
    return devices.select("chassis_id", "ip", "status", "pollable", "pos")


@on_scenario
def crawl_links(s):
    _, links = K.crawl_walks(_seed(s), _walks(s, A.neighbor_walks, A.system_walks))
    return G.dedupe_links(links).select("source_chassis_id", "target_chassis_id", "local_port")


@on_scenario
def network_devices(s):
    """What a crawl of the walks knows of each device: its ports and own MACs."""
    devices = K.network_of_walks(_seed(s), _walks(s, A.neighbor_walks, A.system_walks, A.forwarding_walks)).devices
    up = F.size(F.filter(F.map_values("port_status"), lambda x: x == "up")).cast("long")
    return devices.select("chassis_id", F.array_join("neighbor_ports", ",").alias("neighbor_ports"), F.array_join("uplink_ports", ",").alias("uplink_ports"), F.array_join("own_macs", ",").alias("own_macs"), up.alias("ports_up"))


@on_scenario
def walks_to_graph(s):
    """From walks to the graph: crawl, tables, MAC table, ladder, document."""
    n = K.network_of_walks(_seed(s), _walks(s, A.neighbor_walks, A.system_walks, A.forwarding_walks))
    graph = D.build_graph(s.endpoints.select("pos", "agent_id", "hostname", "ip", "mac", "status"), n.devices, n.links, n.fdb, n.arp)
    at = D.attachments(graph.placement.placed).select("node_id", "parent", "port", "confidence", "reason")
    return graph.nodes.select("node_id", "kind", "ip", "hostname", "role", "pollable").join(at, "node_id", "left")


@on_scenario
def edge_styles(s):
    return D.edge_styles(_graph(s).edges).select("source", "target", "label", "dashed")


@on_scenario
def detail_rows(s):
    """The lines of every device's and endpoint's detail view."""
    placement = _placed(s)
    graded = s.findings.select("*", F.when(F.col("cvss") >= 7, "High").when(F.col("cvss") >= 4, "").otherwise("Low").alias("severity"), F.when(F.col("cvss") >= 5, "3.1").alias("cvss_version"), *(F.lit(None).cast("string").alias(c) for c in ("package", "version", "description")))
    scored = E.score_endpoints(s.endpoints, graded).select("pos", "agent_id", "hostname", "ip", "mac", "status", "risk_score", "top_cves")
    states = F.create_map(F.lit("Gi0/0"), F.lit("up"), F.concat(F.lit("Gi0/"), F.col("pos") % 6 + 1), F.when(F.col("pos") % 2 == 0, "up").otherwise("down"))
    devices = placement.devices.withColumns({"port_status": F.when(F.col("pos") % 4 != 3, states), "neighbor_ports": F.when(F.col("pos") % 3 == 0, F.array(F.lit("Te1/1"), F.lit("Te1/2")))})
    return D.detail_rows(D.device_nodes(devices).unionByName(D.endpoint_nodes(scored, s.devices, placement.placed)))


@on_scenario
def toolbar_counts(s):
    return D.toolbar_counts(_graph(s))


@on_scenario
def tree_depth(s):
    return G.tree_depths(_graph(s).nodes).withColumn("depth", F.col("depth").cast("long"))


@query
def route_gateways(spark, sf_dir):
    routes, adapters = A.routes(spark, sf_dir)
    return Z.route_gateways(routes, adapters).select("ip", "order.metric", "order.seq")


@query
def seed_texts(spark, sf_dir):
    """Seeds of texts: gateways of a routing table before the host's neighbours, each address once."""
    routing, reported = A.seed_lines(spark, sf_dir)
    return Z.merge_seeds(Z.text_gateways(routing), Z.text_neighbors(reported)).select("ip", "pos")


@query
def addresses_in_text(spark, sf_dir):
    return IO.addresses_in_text(A.seed_lines(spark, sf_dir)[0]).select("line", F.col("at").cast("long").alias("at"), "ip")


@query
def payload_items(spark, sf_dir):
    """Records of landed API answers, an answer for each nation."""
    answer = "data struct<affected_items: array<struct<id: string, name: string>>>"
    parsed = A.payloads(spark, sf_dir).select(F.from_json("value", answer).alias("x")).select("x.*")
    return IO.unwrap_items(parsed).select(F.col("pos").cast("long").alias("pos"), "id", "name")


@query
def listed_items(spark, sf_dir):
    """The objects of one JSON list, read in ranges of its file."""
    folder = f"{shared_folder(spark)}/list-{uuid4().hex}"
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    text = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.concat_ws("", F.col("c_name"), F.lit(' "}],[{\\')).alias("name"), F.struct(F.array(F.struct("c_nationkey")).alias("in")).alias("deep")))
    rows = G.numbered(customer.select("c_custkey", text.alias("value")), "at", F.col("c_custkey"))
    lines = rows.select("at", F.concat(F.when(F.col("at") > 0, ",").otherwise("["), "value").alias("value")).unionByName(spark.sql("SELECT bigint(1e18) AS at, ']' AS value"))
    lines.repartitionByRange("at").sortWithinPartitions("at").select("value").write.text(f"{folder}/parts")
    IO.join_texts(spark, [f"{folder}/parts"], f"{folder}/list.json")
    item = F.from_json("value", "id long, name string, deep struct<in: array<struct<c_nationkey: long>>>")
    return IO.list_items(spark, f"{folder}/list.json").select("at", item.alias("x")).select("at", "x.id", "x.name", F.get("x.deep.in", F.lit(0))["c_nationkey"].alias("nation"))


@query
def collected_endpoints(spark, sf_dir):
    rows = A.inventory(spark, sf_dir)
    named = rows["agents"].withColumn("id", F.format_string("%05d", F.col("id").cast("int") + 1))  # as the other records spell it
    return E.collect_endpoints(named, rows["netiface"], rows["netaddr"], rows["hardware"]).select("pos", "agent_id", "hostname", "ip", "serial", "mac")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every node of the graph: where it is attached, by which evidence, with which risk."""
    graph = _graph(build_scenario(spark, sf_dir))
    at = D.attachments(graph.placement.placed).select("node_id", "port", "confidence", "reason")
    return graph.nodes.select("discovery_order", "node_id", "kind", "hostname", "ip", "mac", "role", "risk_score", "parent_id").join(at, "node_id", "left")


QUERIES["flagship"] = flagship
__all__ = ["QUERIES", "flagship"]
