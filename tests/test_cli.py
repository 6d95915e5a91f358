import json
from functools import reduce

from pyspark.sql import DataFrame

import pytest

from netloom.__main__ import main
from netloom.plans import landed
from netloom.sources import landing
from netloom.sources.scenario import build_scenario
from netloom.sources.settings import listed, read_settings


def test_document_of_cached_inputs(spark, tmp_path):
    chassis, mac = "00:00:5e:00:00:01", "e4:a7:a0:00:00:02"
    device = {"chassis_id": chassis, "ip": "10.0.1.254", "hostname": "sw", "pollable": True, "status": "online", "lldp_cap_enabled": "0x20", "uplink_ports": ["Te1"], "neighbor_ports": ["Te1"], "port_status": {"Gi0/1": "up"}, "own_macs": [], "fdb": [{"mac": mac, "port": "Gi0/1", "vlan": 20}], "arp": {mac: "10.0.1.9"}}
    endpoint = {"agent_id": "001", "hostname": "one", "ip": "10.0.1.9", "mac": None, "status": "disconnected", "risk_score": 7.5, "top_cves": [{"cve": "CVE-1", "cvss": 7.5}]}
    (tmp_path / "network.json").write_text(json.dumps({"nodes": [device], "edges": []}))
    (tmp_path / "scored.json").write_text(json.dumps([endpoint]))
    out = tmp_path / "graph.json"
    assert main(["--scored", str(tmp_path / "scored.json"), "--network", str(tmp_path / "network.json"), "-o", str(out)]) == 0
    document = json.loads(out.read_text())
    assert [n["node_id"] for n in document["nodes"]] == [f"device:{chassis}", "endpoint:001"]
    assert document["nodes"][1]["mac"] == mac and document["nodes"][1]["top_cves"][0]["cve"] == "CVE-1" and document["nodes"][1]["risk_score"] == 7.5
    assert document["nodes"][0]["port_status"] == {"Gi0/1": "up"}
    assert document["edges"] == [{"source": "endpoint:001", "source_name": "one", "target": f"device:{chassis}", "target_name": "sw", "type": "endpoint_link", "local_port": "Gi0/1", "confidence": "resolved"}]


def test_graph_tables_of_landed_inventory_and_walks(spark, tiny, tmp_path):
    """From records and walks on disk to tables: collect, score, crawl, assemble; no document is made."""
    scenario = build_scenario(spark, tiny)
    inventory = landed.inventory(spark, tiny)
    for name in ("agents", "netiface", "netaddr", "hardware"):
        inventory[name].limit(40).write.json(f"{tmp_path}/inventory/{name}")
    landed.search_hits(scenario).limit(200).write.json(f"{tmp_path}/hits")
    reduce(DataFrame.unionByName, (make(scenario) for make in (landed.neighbor_walks, landed.system_walks, landed.forwarding_walks))).write.parquet(f"{tmp_path}/walks")
    (tmp_path / "routes.txt").write_text("default via 10.0.1.254 dev eth0\n")
    asked = ["--inventory", f"{tmp_path}/inventory", "--findings", f"{tmp_path}/hits", "--walks", f"{tmp_path}/walks", "--seed", "10.0.0.254", "--routes", f"{tmp_path}/routes.txt", "--pollable-only", "--tables", f"{tmp_path}/graph", "--scored-out", f"{tmp_path}/scored"]
    assert main(asked) == 0
    nodes = landing.read_published(spark, f"{tmp_path}/graph", "nodes").collect()
    devices = [n for n in nodes if n.kind == "device"]
    assert {n.ip for n in devices} >= {"10.0.0.254", "10.0.1.254"} and all(n.pollable for n in devices) and all(n.port_status for n in devices)
    scored = spark.read.json(f"{tmp_path}/scored").collect()
    assert scored and {n.agent_id for n in nodes if n.agent_id} == {r.agent_id for r in scored} and "000" not in {r.agent_id for r in scored}


def test_settings_of_environment_and_file(tmp_path):
    file = tmp_path / "settings.json"
    file.write_text(json.dumps({"seed": ["10.0.0.3", "10.0.0.1"], "max_nodes": 7, "walks": "of_file", "pollable_only": True}))
    kinds = {"seed": list, "max_nodes": int, "walks": str, "pollable_only": bool, "tables": str}
    given = {"NETLOOM_SEED": "10.0.0.1, 10.0.0.2 10.0.0.1", "NETLOOM_WALKS": "of_environment", "NETLOOM_POLLABLE_ONLY": "no", "NETLOOM_OTHER": "x", "NETLOOM_TABLES": " "}
    assert read_settings(kinds, str(file), given) == {"seed": ["10.0.0.1", "10.0.0.2", "10.0.0.3"], "max_nodes": 7, "walks": "of_environment", "pollable_only": False}
    assert read_settings(kinds, None, {}) == {} and listed('a,"b c"  d,,a') == ["a", "b c", "d"] and listed(None) == []
    file.write_text('{"unknown": 1}')
    with pytest.raises(ValueError):
        read_settings(kinds, str(file), {})


def test_inputs_may_come_from_settings(spark, tmp_path, monkeypatch):
    (tmp_path / "scored.json").write_text(json.dumps([{"agent_id": "001", "ip": "10.0.1.9", "status": "active"}]))
    (tmp_path / "settings.json").write_text(json.dumps({"scored": str(tmp_path / "scored.json"), "output": str(tmp_path / "never.json")}))
    monkeypatch.setenv("NETLOOM_NO_NETWORK", "true")
    monkeypatch.setenv("NETLOOM_SETTINGS", str(tmp_path / "settings.json"))
    assert main(["-o", str(tmp_path / "graph.json")]) == 0
    assert [n["node_id"] for n in json.loads((tmp_path / "graph.json").read_text())["nodes"]] == ["endpoint:001"] and not (tmp_path / "never.json").exists()
    (tmp_path / "settings.json").write_text("[]")
    with pytest.raises(SystemExit):
        main([])
