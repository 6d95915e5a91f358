"""python -m netloom --scored FILE --network FILE -o FILE: the graph of landed inputs.

Endpoints: --scored (a JSON list, or a folder of JSON lines), or --inventory DIR with
agents, netiface, netaddr and hardware as JSON lines and, for their scores, --findings DIR.
The network: --network (a JSON document), or --walks DIR (Parquet) with one --seed or more,
--routes and --neighbors (text files with further seeds), --max-nodes and --pollable-only.
Either may be left out (--no-endpoints, --no-network).

--scored-out DIR writes the scored endpoints as JSON lines. --tables DIR publishes nodes
and edges as Parquet in a version of their own, which readers (landing.read_published)
see when both are written. The document goes to -o FILE, in parts that are joined, or,
unless --tables is given, through the driver to standard output.

What the command line leaves out is taken from variables NETLOOM_<OPTION> (NETLOOM_WALKS,
NETLOOM_MAX_NODES, ..), then from the JSON object in the file --settings (or NETLOOM_SETTINGS);
seeds are taken from all three, each once, in this order.
"""

from __future__ import annotations

import argparse
import os
import sys
import time
from datetime import UTC, datetime


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="netloom", description=__doc__)
    parser.add_argument("--scored", help="JSON list, or folder of JSON lines, of scored endpoints")
    parser.add_argument("--inventory", help="folder of inventory records")
    parser.add_argument("--findings", help="folder of search hits as JSON lines")
    parser.add_argument("--scored-out", help="folder for scored endpoints as JSON lines")
    parser.add_argument("--network", help="JSON document of devices and links")
    parser.add_argument("--walks", help="folder of landed walks")
    parser.add_argument("--seed", action="append", default=[], help="address where the crawl begins")
    parser.add_argument("--routes", help="text of a routing table with further seeds")
    parser.add_argument("--neighbors", help="text of the host's neighbours with further seeds")
    parser.add_argument("--max-nodes", type=int, default=5000)
    parser.add_argument("--settings", help="JSON file of options")
    parser.add_argument("--pollable-only", action="store_true")
    parser.add_argument("--no-endpoints", action="store_true")
    parser.add_argument("--no-network", action="store_true")
    parser.add_argument("--tables", help="folder for nodes and edges as Parquet")
    parser.add_argument("-o", "--output", help="file for the document")
    options = _with_settings(parser, arguments)
    if not (options.scored or options.inventory or options.no_endpoints) or not (options.network or options.walks or options.no_network):
        parser.error("name an input or leave it out with --no-endpoints or --no-network")
    if options.walks and not (options.seed or options.routes or options.neighbors):
        parser.error("a crawl of walks needs a seed")

    from pyspark.sql import SparkSession

    from netloom.plans.document import build_graph, metadata, publish_graph, write_document
    from netloom.sources import landing

    spark = SparkSession.builder.appName("netloom").getOrCreate()
    began, clock, timing = datetime.now(UTC), time.monotonic(), {}

    def phase(name: str) -> None:
        nonlocal clock
        timing[f"{name}_s"], clock = time.monotonic() - clock, time.monotonic()

    endpoints = _endpoints(spark, options)
    if options.scored_out:
        landing.write_records(endpoints, options.scored_out)
    phase("endpoints")
    devices, links, fdb, arp = _network(spark, options)
    phase("network")
    graph = build_graph(endpoints, devices, links, fdb, arp)
    if options.tables:
        publish_graph(graph, options.tables)
    phase("assemble")
    if options.output or not options.tables:
        about = {"scan_time": began.isoformat(), "seed": options.seed[0] if options.seed else None, "timing": {"started_at": began.isoformat(), "finished_at": datetime.now(UTC).isoformat(), **timing}}
        if options.output:
            write_document(graph, options.output, **about)
        else:
            sys.stdout.write(landing.graph_lines(graph.nodes, graph.edges, metadata(graph, **about)))
    return 0


def _with_settings(parser: argparse.ArgumentParser, arguments: list[str] | None) -> argparse.Namespace:
    """The options of the command line, with the rest from the environment and a file."""
    from netloom.sources.settings import PREFIX, read_settings

    asked = parser.parse_args(arguments)
    kinds = {name: type(value) if isinstance(value, (bool, int, list)) else str for name, value in vars(asked).items() if name != "settings"}
    try:
        known = read_settings(kinds, asked.settings or os.environ.get(f"{PREFIX}SETTINGS"), os.environ)
    except (OSError, ValueError) as problem:
        parser.error(str(problem))
    parser.set_defaults(**{name: value for name, value in known.items() if name != "seed"})
    options = parser.parse_args(arguments)
    options.seed = list(dict.fromkeys([*options.seed, *known.get("seed", [])]))
    return options


def _endpoints(spark, options):
    from pyspark.sql import functions as F

    from netloom.operators.endpoints import collect_endpoints, parse_findings, score_endpoints
    from netloom.sources import landing
    from netloom.sources import schema as S

    if options.no_endpoints:
        return spark.createDataFrame([], "pos long, agent_id string, hostname string, ip string, mac string, status string")
    if options.scored:
        return landing.read_scored(spark, options.scored)
    endpoints = collect_endpoints(**landing.read_inventory(spark, options.inventory))
    hits = spark.read.schema(S.VULNERABILITY).json(options.findings) if options.findings else spark.createDataFrame([], S.VULNERABILITY)
    return score_endpoints(endpoints, parse_findings(hits)).withColumn("discovery_method", F.lit(S.BY_INVENTORY))


def _network(spark, options):
    from pyspark.sql import functions as F

    from netloom.operators.crawl import network_of_walks
    from netloom.sources import landing, seeds
    from netloom.sources import schema as S

    if options.no_network or options.network:
        if options.no_network:
            document = spark.createDataFrame([], S.NETWORK_DOCUMENT)
            devices, links = landing.numbered_items(document, "nodes", "pos"), landing.numbered_items(document, "edges", "seq")
        else:
            devices, links = landing.read_network(spark, options.network)
        return devices, links, *landing.device_tables(devices)

    def lines(path: str):
        # one small text: the host's own table
        return spark.read.option("wholetext", True).text(path).select(F.posexplode(F.split("value", "\n")).alias("line", "value"))

    sources = [spark.createDataFrame(list(enumerate(options.seed)), "line long, ip string")]
    if options.routes:
        sources.append(seeds.text_gateways(lines(options.routes)))
    if options.neighbors:
        sources.append(seeds.text_neighbors(lines(options.neighbors)))
    found = network_of_walks(seeds.merge_seeds(*sources), landing.read_walks(spark, options.walks), max_nodes=options.max_nodes, pollable_only=options.pollable_only)
    return found.devices, found.links, found.fdb, found.arp


if __name__ == "__main__":
    raise SystemExit(main())
