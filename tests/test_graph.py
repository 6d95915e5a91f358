import json
import random
from collections import defaultdict, deque

from pyspark.sql import functions as F

from netloom.functions.oid import DOT1D_FDB_PORT, DOT1Q_FDB_PORT, VLAN_STATIC_NAME, VTP_VLAN_STATE
from netloom.operators.crawl import crawl
from netloom.operators.endpoints import select_mac
from netloom.operators.graph import bfs_order, dedupe_links
from netloom.operators.walks import build_fdb
from netloom.plans.document import build_graph, metadata
from netloom.plans.queries import QUERIES
from netloom.sources import landing
from netloom.sources.scenario import build_scenario

LINKS = "seq long, source_chassis_id string, target_chassis_id string, local_port string, remote_port string"
DEVICES = "pos long, chassis_id string, ip string, hostname string, lldp_cap_enabled string, pollable boolean, uplink_ports array<string>, own_macs array<string>"
ENDPOINTS = "pos long, agent_id string, hostname string, mac string, ip string, status string, risk_score double"
FDB = "pos long, chassis_id string, seq long, mac string, port string, vlan int"
ARP = "pos long, seq long, mac string, ip string"
WALKS = "device_ip string, context string, base_oid string, seq long, oid string, value string"
M1, M2 = "e4:a7:a0:00:00:01", "e4:a7:a0:00:00:02"


def queue_order(nodes, edges):
    near = defaultdict(list)
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    order, parent, seen = [], {}, set()
    for root in nodes:
        if root in seen:
            continue
        seen.add(root)
        parent[root] = None
        todo = deque([root])
        while todo:
            at = todo.popleft()
            order.append(at)
            for n in near[at]:
                if n not in seen and n in set(nodes):
                    seen.add(n)
                    parent[n] = at
                    todo.append(n)
    return order, parent


def test_level_by_level_order_is_the_order_of_a_queue(spark):
    for seed in range(2):
        r = random.Random(seed)
        nodes = [f"n{k}" for k in r.sample(range(100), 18)]
        edges = [(r.choice(nodes[:12]), r.choice(nodes[:15])) for _ in range(17)]
        devices = spark.createDataFrame(list(enumerate(nodes)), "pos long, chassis_id string")
        links = spark.createDataFrame([(k, a, b, "", "") for k, (a, b) in enumerate(edges)], LINKS)
        rows = bfs_order(devices, links).orderBy("rank").collect()
        order, parent = queue_order(nodes, edges)
        assert [x.chassis_id for x in rows] == order and {x.chassis_id: x.parent for x in rows} == parent


def test_queries_order_every_device_of_the_scenario(spark, tiny):
    scenario = build_scenario(spark, tiny)
    devices = {r.chassis_id: r.pos for r in scenario.devices.select("chassis_id", "pos").collect()}
    edges = [(r.source_chassis_id, r.target_chassis_id) for r in scenario.links.orderBy("seq").collect()]
    order, parent = queue_order(sorted(devices, key=devices.get), [e for e in edges if set(e) <= set(devices)])
    rows = QUERIES["bfs_order_all"](spark, tiny).orderBy("rank").collect()
    assert max(devices.values()) >= 1000 and len(rows) == len(devices)
    assert [r.chassis_id for r in rows] == order and {r.chassis_id: r.parent for r in rows} == parent
    root = {}
    for at in order:
        root[at] = devices[at] if parent[at] is None else root[parent[at]]
    assert {r.chassis_id: r.root for r in QUERIES["components_all"](spark, tiny).collect()} == root


def test_undirected_links_keep_the_first_label_of_each_side(spark):
    rows = [(0, "b", "a", "", "p2"), (1, "a", "b", None, "q1"), (2, "a", "b", "p3", "q3"), (3, "c", "c", "x", "y")]
    got = {(r.source_chassis_id, r.target_chassis_id): (r.seq, r.local_port, r.remote_port) for r in dedupe_links(spark.createDataFrame(rows, LINKS)).collect()}
    assert got == {("a", "b"): (0, "p2", "q1"), ("c", "c"): (3, "x", "y")}


def network(spark):
    devices = [(0, "00:00:5e:00:00:01", "10.0.1.254", "core", "0x28", True, ["Te1/1", "Te1/9"], []), (1, "00:00:5e:00:00:02", "10.0.2.254", "access", "0x20", True, ["Te1/1"], []), (2, M1, None, None, "0x01", False, [], [])]
    links = [(0, devices[0][1], devices[1][1], "Te1/1", "Te1/1"), (1, devices[1][1], M1, "Gi0/3", None)]
    endpoints = [(0, "A1", "one", M1, "10.0.2.21", "active", 1.0), (1, "A2", "two", M2, "10.0.2.50", "active", 0.0), (2, "A3", "three", None, "10.0.2.99", "disconnected", 0.0), (3, "A4", "four", None, "10.9.9.9", "disconnected", 0.0)]
    fdb = [(1, devices[1][1], 0, M2, "Gi0/7", 20)]
    made = ((endpoints, ENDPOINTS), (devices, DEVICES), (links, LINKS), (fdb, FDB), ([], ARP))
    return build_graph(*(spark.createDataFrame(rows, kind) for rows, kind in made))


def test_golden_network(spark, tmp_path):
    graph = network(spark)
    nodes = {r.node_id: r for r in graph.nodes.collect()}
    access = "device:00:00:5e:00:00:02"
    assert [nodes[f"endpoint:A{k}"].parent_id for k in range(1, 5)] == [access, access, access, None]
    assert [nodes[f"endpoint:A{k}"].role for k in range(1, 5)] == ["station", "host", "host", "host"]
    assert [nodes[n].discovery_order for n in ("device:00:00:5e:00:00:01", access, "endpoint:A1", "endpoint:A2", "endpoint:A3", "endpoint:A4")] == list(range(6))
    edges = {(r.source, r.type): (r.local_port, r.confidence) for r in graph.edges.collect()}
    assert edges[("endpoint:A1", "endpoint_link")] == ("Gi0/3", "lldp") and edges[("endpoint:A2", "endpoint_link")] == ("Gi0/7", "resolved")
    assert edges[("endpoint:A3", "endpoint_link")] == (None, "subnet_fallback") and len(edges) == 4
    about = metadata(graph, seed="10.0.1.254")
    assert about["counts"] == {"nodes": 6, "endpoints": 4, "devices": 2, "fdb_discovered_hosts": 0, "unparented_endpoints": 1, "lldp_edges": 1, "endpoint_edges": 3}
    assert about["unparented_endpoints"] == [{"node_id": "endpoint:A4", "hostname": "four", "reason": "host_offline_no_l2_evidence"}] and about["merged_lldp_endpoints"] == 1
    path = str(tmp_path / "graph.json")
    landing.replace_document(landing.graph_lines(graph.nodes, graph.edges, about), path)
    document = json.load(open(path))
    assert document["nodes"][0]["serial"] is None and "agent_id" not in document["nodes"][0] and "remote_port" not in document["edges"][-1]
    back, links = landing.read_graph(spark, path)
    assert [r.node_id for r in back.orderBy("pos").collect()] == [n["node_id"] for n in document["nodes"]] and links.count() == 4
    try:
        landing.replace_document('{"nodes": 3}', path)
    except ValueError:
        pass
    assert json.load(open(path)) == document


def test_hosts_and_addresses_from_the_mac_table(spark):
    sw, svi, host, quiet, transit = "00:00:5e:00:00:01", "00:00:5e:00:01:01", "28:f1:0e:00:00:01", "28:f1:0e:00:00:02", "28:f1:0e:00:00:03"
    devices = [(0, sw, "10.0.1.254", "sw", "0x28", True, ["Te1"], [svi])]
    fdb = [(0, sw, k, m, p, 1) for k, (m, p) in enumerate([(host, "Gi1"), (quiet, "Gi2"), (svi, "Vl1"), (transit, "Te1")])]
    arp = [(0, 0, host, "10.0.1.7"), (0, 1, quiet, "10.0.1.8")]
    endpoints = [(0, "A1", "one", None, "10.0.1.8", "disconnected", 0.0)]
    graph = build_graph(*(spark.createDataFrame(rows, kind) for rows, kind in ((endpoints, ENDPOINTS), (devices, DEVICES), ([], LINKS), (fdb, FDB), (arp, ARP))))
    nodes = {r.node_id: r for r in graph.nodes.collect()}
    assert set(nodes) == {f"device:{sw}", "endpoint:A1", f"host:{host}"}
    assert nodes["endpoint:A1"].mac == quiet and nodes[f"host:{host}"].risk_score is None and nodes[f"host:{host}"].ip == "10.0.1.7"


def test_choice_of_a_card(spark):
    cards = [("a", 0, "eth0", "04:00:00:00:00:01", "up"), ("a", 1, "eth1", "04:00:00:00:00:02", "down"), ("a", 2, "docker0", "04:00:00:00:00:03", "up"), ("b", 0, "eth0", "02:00:00:00:00:01", "up"), ("b", 1, "eth1", "04:00:00:00:00:05", "down"), ("b", 2, "eth2", "04:00:00:00:00:06", "up")]
    addresses = [("a", k, n, "IPv4", f"10.0.0.{k}") for k, n in enumerate(["eth0", "eth1", "docker0"])] + [("b", 1, "eth1", "ipv4", "10.0.1.1"), ("b", 2, "eth2", "ipv4", "169.254.0.1")]
    got = select_mac(spark.createDataFrame(cards, "agent_id string, pos int, name string, mac string, state string"), spark.createDataFrame(addresses, "agent_id string, pos int, iface string, proto string, address string"), spark.createDataFrame([("a", "10.0.0.1"), ("b", "")], "agent_id string, ip string"))
    assert {r.agent_id: r.mac for r in got.collect()} == {"a": "04:00:00:00:00:02", "b": "04:00:00:00:00:05"}


def test_tagged_rows_replace_flat_ones(spark):
    rows = [("d1", "", DOT1Q_FDB_PORT, 0, f"{DOT1Q_FDB_PORT}.20.0.35.172.229.0.1", "5"), ("d1", "", DOT1D_FDB_PORT, 1, f"{DOT1D_FDB_PORT}.0.35.172.229.0.2", "6"), ("d2", "30", DOT1D_FDB_PORT, 2, f"{DOT1D_FDB_PORT}.0.35.172.229.0.3", "7"), ("d2", "", DOT1D_FDB_PORT, 3, f"{DOT1D_FDB_PORT}.0.35.172.229.0.4", "8"), ("d3", "", DOT1Q_FDB_PORT, 4, f"{DOT1Q_FDB_PORT}.x", "9"), ("d3", "", DOT1D_FDB_PORT, 5, f"{DOT1D_FDB_PORT}.0.35.172.229.0.5", "9")]
    rows.append(("d2", "", VTP_VLAN_STATE, 6, f"{VTP_VLAN_STATE}.1.30", "1"))
    walks = spark.createDataFrame(rows, WALKS)
    assert sorted(map(tuple, build_fdb(walks).collect())) == [("d1", 0, "0023ace50001", "5", 20), ("d2", 2, "0023ace50003", "7", 30)]


def test_contexts_of_readable_vlans_go_before_other_tables(spark):
    flat = lambda device, context, seq: (device, context, DOT1D_FDB_PORT, seq, f"{DOT1D_FDB_PORT}.0.35.172.229.0.{seq}", "7")
    tagged = lambda device, seq: (device, "", DOT1Q_FDB_PORT, seq, f"{DOT1Q_FDB_PORT}.20.0.35.172.229.0.{seq}", "5")
    vtp = lambda device, vlan, state="1": (device, "", VTP_VLAN_STATE, vlan, f"{VTP_VLAN_STATE}.1.{vlan}", state)
    rows = [tagged("both", 1), flat("both", "30", 2), vtp("both", 30)]
    rows += [flat("excluded", "1002", 3), vtp("excluded", 1002), flat("excluded", "", 4)]
    rows += [tagged("suspended", 5), flat("suspended", "40", 6), vtp("suspended", 40, "2"), vtp("suspended", 41)]
    rows += [flat("static", "50", 7), ("static", "", VLAN_STATIC_NAME, 0, f"{VLAN_STATIC_NAME}.50", "office")]
    rows += [("broken", "60", DOT1D_FDB_PORT, 8, f"{DOT1D_FDB_PORT}.x", "7"), vtp("broken", 60), tagged("broken", 9)]
    rows += [flat("many", str(v), 100 + v) for v in (3, 1, 2)] + [vtp("many", v) for v in (3, 1, 2)]
    walks = spark.createDataFrame(rows, WALKS)
    got = {(r.device_ip, r.seq, r.vlan) for r in build_fdb(walks, most=2).collect()}
    assert got == {("both", 2, 30), ("excluded", 4, None), ("suspended", 5, 20), ("static", 7, 50), ("many", 101, 1), ("many", 102, 2)}


def test_crawl_visits_once_and_keeps_what_it_cannot_reach(spark):
    systems = spark.createDataFrame([("10.0.0.1", "a"), ("10.0.0.2", "b"), ("10.0.0.3", "c-own")], "device_ip string, chassis_id string")
    for name in ("hostname", "model", "firmware", "serial", "mac", "cap_enabled"):
        systems = systems.withColumn(name, F.lit(None).cast("string"))
    systems = systems.withColumn("vendor", F.lit("v"))
    said = [("10.0.0.1", 0, "b", "10.0.0.2", "B", "0x20"), ("10.0.0.1", 1, "c", "10.0.0.3", "C", "0x08"), ("10.0.0.2", 2, "a", "10.0.0.1", "A", "0x28"), ("10.0.0.2", 3, "", None, "phone", "0x04"), ("10.0.0.3", 4, "d", "10.0.0.9", "D", None)]
    neighbors = spark.createDataFrame(said, "device_ip string, seq long, chassis_id string, mgmt_ip string, sys_name string, cap_enabled string")
    for name in ("sys_descr", "chassis_mac", "local_port", "remote_port"):
        neighbors = neighbors.withColumn(name, F.lit(None).cast("string"))
    seeds = spark.createDataFrame([(0, "10.0.0.1"), (1, "10.0.0.1"), (2, "127.0.0.1")], "pos long, ip string")
    devices, links = crawl(seeds, systems, neighbors)
    rows = devices.orderBy("pos").collect()
    assert [(r.chassis_id, r.status) for r in rows][:4] == [("a", "online"), ("b", "online"), ("c-own", "online"), ("d", "unreachable")]
    assert {r.chassis_id: r.lldp_cap_enabled for r in rows} == {"a": "0x28", "b": "0x20", "c-own": "0x08", "d": None, "name:phone": "0x04"}
    assert [(r.source_chassis_id, r.target_chassis_id) for r in links.orderBy("seq").collect()] == [("a", "b"), ("a", "c-own"), ("b", "a"), ("b", "name:phone"), ("c-own", "d")]
    capped, _ = crawl(seeds, systems, neighbors, max_nodes=1)
    assert sorted((r.chassis_id, r.status) for r in capped.collect()) == [("a", "online"), ("b", "discovered"), ("c", "discovered")]
