import json
import random

import pytest
from pyspark.sql import functions as F

from netloom.functions import oid as O
from netloom.operators.walks import build_fdb
from netloom.plans import document as D
from netloom.plans import landed
from netloom.sources import landing
from netloom.sources.scenario import build_scenario
from netloom.sources.seeds import text_gateways


@pytest.fixture(scope="module")
def walks(spark, tiny, tmp_path_factory):
    """Walks as a crawl finds them, and the same stored."""
    folder = str(tmp_path_factory.mktemp("walks"))
    landed.forwarding_walks(build_scenario(spark, tiny)).write.parquet(f"{folder}/raw")
    raw = landing.read_walks(spark, f"{folder}/raw")
    landing.store_walks(raw, f"{folder}/stored")
    return raw, landing.read_stored_walks(spark, f"{folder}/stored")


def rows_of(frame, columns=("device_ip", "context", "base_oid", "seq", "oid", "value")):
    return sorted(map(str, map(tuple, frame.select(*columns).collect())))


def test_ranges_of_stored_walks(walks):
    raw, stored = walks
    assert rows_of(raw) == rows_of(stored)
    for base in (O.DOT1D_FDB_PORT, "1.3.6.1.2.1.17", O.IFNAME + ".", "1.3.6.1.2.1.1"):
        assert rows_of(landing.walk_range(raw, base)) == rows_of(landing.walk_range(stored, base))
        assert rows_of(landing.walk_range(raw, base, "10")) == rows_of(landing.walk_range(stored, base, "10"))
    plan = landing.walk_range(stored, O.DOT1D_FDB_PORT, "10")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(oid_key" in plan and "LessThan(oid_key" in plan and "PartitionFilters: [" in plan


def test_row_groups_beyond_the_range_are_skipped(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = spark.range(40_000).select(F.lit("10.0.0.1").alias("device_ip"), F.lit("").alias("context"), F.lit("1.3.6").alias("base_oid"), F.col("id").alias("seq"), F.concat(F.lit("1.3.6."), (F.col("id") % 400).cast("string"), F.lit("."), F.col("id").cast("string")).alias("oid"), F.lit("v").alias("value"))
        spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", "65536")
        landing.store_walks(made.coalesce(1), f"{tmp_path}/walks")
        found = landing.walk_range(landing.read_stored_walks(spark, f"{tmp_path}/walks"), "1.3.6.77").select("oid", "oid_key")
        assert len(found.collect()) == 100
        leaves = found._jdf.queryExecution().executedPlan().collectLeaves()
        scanned = leaves.head().metrics().apply("numOutputRows").value()
        assert 100 <= scanned < 10_000
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_contexts_that_no_device_reads_are_pruned(walks):
    raw, stored = walks
    columns = ("device_ip", "seq", "mac", "port", "vlan")
    found = build_fdb(stored)
    assert rows_of(found, columns) == rows_of(build_fdb(raw), columns)
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString().lower()


def test_a_list_is_read_in_ranges(spark, tmp_path):
    r = random.Random(6)
    bits = ["a", "}", "{", "[", "]", '"', "\\", '\\"', "é", ",", "\n", "}]", "漢"]
    items = [{"id": k, "text": "".join(r.choices(bits, k=r.randint(0, 30))), "deep": {"x": [{"y": k}, {}]}} for k in range(3000)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for indent in (None, 2):
            path = tmp_path / f"list{indent}.json"
            path.write_text(json.dumps(items, indent=indent, ensure_ascii=False) + "\n")
            rows = landing.list_items(spark, str(path)).orderBy("at").collect()
            assert [x.at for x in rows] == list(range(3000)) and [json.loads(x.value) for x in rows] == items
            assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 5
        for text, n in (("[]", 0), ('[{"id": 1, "text": "x"}]', 1), ("", 0)):
            (tmp_path / "small.json").write_text(text)
            assert landing.list_items(spark, str(tmp_path / "small.json")).count() == n
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.fixture(scope="module")
def graph(spark, tiny):
    s = build_scenario(spark, tiny)
    lost = F.when(F.col("pos") % 11 == 0, F.lit("192.0.2.9")).otherwise(F.col("ip"))  # no MAC, and no device of its subnet
    return D.build_graph(s.endpoints.filter("pos < 60").withColumn("ip", lost).select("pos", "agent_id", "hostname", "ip", "mac", "status"), s.devices.filter("pos < 1060"), s.links, s.fdb, s.arp)


def test_a_document_of_parts_is_the_same_bytes(spark, graph, tmp_path):
    about = {"seed": "10.0.0.254", "timing": {"a_s": 1.5}}
    shown = D.write_document(graph, f"{tmp_path}/graph.json", **about)
    text = (tmp_path / "graph.json").read_text()
    assert text == landing.graph_lines(graph.nodes, graph.edges, D.metadata(graph, **about))
    document = json.loads(text)
    assert [n["discovery_order"] for n in document["nodes"]] == list(range(len(document["nodes"])))
    counted = D.counts(graph).first().asDict()
    assert document["metadata"]["counts"] == counted and counted["nodes"] == len(document["nodes"]) == shown["nodes"]
    histogram = {r["confidence"]: r["count"] for r in D.confidence_histogram(graph.placement.placed).collect()}
    assert document["metadata"]["confidence"] == histogram
    assert len(document["metadata"]["unparented_endpoints"]) == counted["unparented_endpoints"] > 0
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["graph.json"]
    empty = landing.graph_lines(graph.nodes.limit(0), graph.edges.limit(0), {})
    assert json.loads(empty) == {"nodes": [], "edges": [], "metadata": {}}


def test_a_failed_run_leaves_the_published_tables(spark, graph, tmp_path):
    folder = f"{tmp_path}/tables"
    shown = D.publish_graph(graph, folder)
    assert {k: v for k, v in shown.items() if not k.startswith("by_")} == D.counts(graph).first().asDict()
    before = landing.read_published(spark, folder, "nodes").count()
    broken = graph.edges.withColumn("source", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):  # between the two writes: nodes of the new version are there
        landing.publish_tables({"nodes": graph.nodes.limit(1), "edges": broken}, folder)
    assert landing.read_published(spark, folder, "nodes").count() == before == shown["nodes"]
    landing.publish_tables({"nodes": graph.nodes.limit(1), "edges": graph.edges.limit(2)}, folder)
    assert landing.read_published(spark, folder, "nodes").count() == 1 and landing.read_published(spark, folder, "edges").count() == 2


def test_addresses_of_default_routes_are_whole_words(spark):
    lines = ["default via 192.168.7.1 dev eth0", "default via 1192.5.6.7 dev eth0", "default via gw10.0.0.1", "default 10.0.0.2 UGSc", "default 10.0.0.2555 UGSc", "10.0.0.3 via nothing"]
    rows = spark.createDataFrame(list(enumerate(lines)), "line long, value string")
    assert [(r.line, r.ip) for r in text_gateways(rows).orderBy("line").collect()] == [(0, "192.168.7.1"), (3, "10.0.0.2")]
