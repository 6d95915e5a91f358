"""Readers of landed walks and documents, and the writer of the graph document.

A document's order is data: readers number its rows by place.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.functions import oid as O
from netloom.sources import schema as S


def read_walks(spark: SparkSession, path: str) -> DataFrame:
    """Walk rows, partitioned by base_oid and context where the folder is."""
    return spark.read.schema(S.WALK).parquet(path)


def store_walks(walks: DataFrame, path: str) -> None:
    """Walk rows for many readers: a folder for each base_oid and context, in it rows in the order of the tree,
    so that a range of identifiers is a range of the key and the statistics of files and row groups leave out
    the rest. Rows whose identifier isn't dotted numbers are dropped. What was there is replaced."""
    order = ["base_oid", "context", "oid_key", "device_ip", "seq"]
    keyed = walks.withColumn("oid_key", O.oid_key(F.col("oid"))).filter("oid_key IS NOT NULL")
    keyed.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("base_oid", "context").parquet(path)


def read_stored_walks(spark: SparkSession, path: str) -> DataFrame:
    """What ``store_walks`` wrote, with its oid_key. (A folder's name can't be empty, so no context is read as null.)"""
    kind = T.StructType([*S.WALK.fields, T.StructField("oid_key", T.BinaryType())])
    return spark.read.schema(kind).parquet(path).withColumn("context", F.coalesce("context", F.lit("")))


def walk_range(walks: DataFrame, base: str, context: str | None = None) -> DataFrame:
    """The rows below a base, those of one context if given. Walks that were made from elsewhere in the
    tree are left out by their own base, which prunes partitions; so does the context. Stored walks are
    read by a range of their key."""
    base = base.rstrip(".")
    made_above = F.startswith(F.lit(base), F.col("base_oid")) | F.col("base_oid").isNull()
    if "oid_key" in walks.columns:
        key = O.key_of(base)
        below = (F.col("oid_key") > F.lit(key)) & (F.col("oid_key") < F.lit(key + b"\xff"))
    else:
        below = F.startswith(F.col("oid"), F.lit(base + "."))
    rows = walks.filter(made_above & below)
    return rows if context is None else rows.filter(F.col("context") == context)


def get_many(walks: DataFrame, oids: dict[str, str]) -> DataFrame:
    """One row for each device with the last value of each identifier, in columns named by ``oids``."""
    last = [F.max_by("value", F.when(F.col("oid") == oid, F.col("seq"))).alias(name) for name, oid in oids.items()]
    return walks.filter(F.col("oid").isin(*oids.values())).groupBy("device_ip").agg(*last)


def unwrap_items(payloads: DataFrame, items: str = "data.affected_items") -> DataFrame:
    """The rows of API answers, one after another."""
    return payloads.select(F.posexplode_outer(items).alias("pos", "item")).filter("item IS NOT NULL").select("pos", "item.*")


def read_payloads(spark: SparkSession, path: str, item: T.StructType) -> DataFrame:
    """The rows of landed API answers, documents of the form {"data": {"affected_items": [..]}}, with the
    answer's place as pos. An answer without items gives none."""
    answer = T.StructType([T.StructField("data", T.StructType([T.StructField("affected_items", T.ArrayType(item))]))])
    return unwrap_items(spark.read.schema(answer).option("multiLine", True).json(path))


def read_inventory(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """agents, netiface, netaddr and hardware: JSON lines of a folder, each record with its agent_id and pos."""
    kinds = {"agents": S.AGENT, "netiface": S.NETIFACE, "netaddr": S.NETADDR, "hardware": S.HARDWARE}
    return {name: spark.read.schema(kind).json(f"{folder}/{name}") for name, kind in kinds.items()}


def write_records(rows: DataFrame, path: str) -> None:
    """A stage's records as JSON lines, nulls written out; what was there is replaced."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def numbered_items(documents: DataFrame, items: str, place: str) -> DataFrame:
    return documents.select(F.posexplode(items).alias(place, "item")).select(F.col(place).cast("long").alias(place), "item.*")


def read_network(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Devices with pos and links with seq, of one network document."""
    document = spark.read.schema(S.NETWORK_DOCUMENT).option("multiLine", True).json(path)
    return numbered_items(document, "nodes", "pos"), numbered_items(document, "edges", "seq")


def device_tables(devices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Forwarding and address rows of devices that carry them: fdb (pos, chassis_id, seq, mac, port, vlan)
    and arp (pos, seq, mac, ip)."""
    seen = devices.select("pos", "chassis_id", F.posexplode("fdb").alias("seq", "x"))
    fdb = seen.select("pos", "chassis_id", F.col("seq").cast("long").alias("seq"), "x.*")
    known = devices.select("pos", F.posexplode(F.map_entries("arp")).alias("seq", "x"))
    return fdb, known.select("pos", F.col("seq").cast("long").alias("seq"), F.col("x.key").alias("mac"), F.col("x.value").alias("ip"))


def list_items(spark: SparkSession, path: str) -> DataFrame:
    """at (long, the place) and value (text) of every object of one JSON list, however long: the file is read in
    ranges that end at closing braces, by as many tasks as it has blocks.

    Whether a range begins inside a string follows from the quotes before it, how deep it begins from the
    braces and brackets outside strings: running sums within each block, and over the blocks' own sums.
    """
    raw = spark.read.option("lineSep", "}").text(path)
    block = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    pieces = raw.select(block.alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    # an escape is of two characters and never ends a piece, as a brace is not escaped
    quoted = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1)

    def opened(parity: int) -> Column:
        outside = F.array_join(F.filter(quoted, lambda x, k: k % 2 == parity), "")
        return F.length(F.regexp_replace(outside, r"[^\[{]", "")) - F.length(F.regexp_replace(outside, r"[^\]}]", ""))

    measured = pieces.withColumns({"quotes": F.size(quoted) - 1, "outside": opened(0), "inside": opened(1)})
    in_block = W.partitionBy("block").orderBy("id")
    summed = measured.withColumn("upto", F.sum("quotes").over(in_block))
    blocks = measured.groupBy("block").agg(F.sum("quotes").alias("n"))
    starts = blocks.withColumn("first", F.sum("n").over(W.orderBy("block")) - F.col("n")).drop("n")  # a row for each block of the file
    odd = (F.col("first") + F.col("upto") - F.col("quotes")) % 2 == 1
    ends_inside = (F.col("first") + F.col("upto")) % 2 == 1
    turned = summed.join(F.broadcast(starts), "block").select("block", "id", "value", ends_inside.alias("cut"), F.when(odd, F.col("inside")).otherwise(F.col("outside")).alias("change"), F.when(ends_inside, 0).otherwise(1).alias("closed"))
    deep = turned.withColumn("depth", F.sum(F.col("change") - F.col("closed")).over(in_block))
    below = turned.groupBy("block").agg(F.sum(F.col("change") - F.col("closed")).alias("n")).withColumn("base", F.sum("n").over(W.orderBy("block")) - F.col("n")).drop("n")
    placed = deep.join(F.broadcast(below), "block").withColumn("ends", (~F.col("cut") & (F.col("base") + F.col("depth") == 1)).cast("long"))
    before = F.sum("ends").over(in_block) - F.col("ends")
    counted = placed.groupBy("block").agg(F.sum("ends").alias("n")).withColumn("past", F.sum("n").over(W.orderBy("block")) - F.col("n")).drop("n")
    numbered = placed.withColumn("before", before).join(F.broadcast(counted), "block").select((F.col("past") + F.col("before")).alias("at"), "block", "id", "value", "ends")
    whole = numbered.groupBy("at").agg(F.max("ends").alias("ended"), F.array_sort(F.collect_list(F.struct("block", "id", "value"))).alias("parts"))
    text = F.concat(F.array_join(F.transform("parts", lambda x: x["value"]), "}"), F.lit("}"))
    return whole.filter("ended = 1").select("at", F.regexp_replace(text, r"^[\s\[,]+", "").alias("value"))


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    """Endpoints with pos: of one JSON list (a .json file), or of a folder that a stage has written as JSON lines
    with pos; both are read in parts."""
    if not path.endswith(".json"):
        return spark.read.schema(T.StructType([T.StructField("pos", T.LongType()), *S.SCORED_ENDPOINT.fields])).json(path)
    return list_items(spark, path).select(F.col("at").alias("pos"), F.from_json("value", S.SCORED_ENDPOINT).alias("item")).select("pos", "item.*")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph document, in its order."""
    document = spark.read.schema(S.GRAPH_DOCUMENT).option("multiLine", True).json(path)
    return numbered_items(document, "nodes", "pos"), numbered_items(document, "edges", "seq")


def addresses_in_text(lines: DataFrame, column: str = "value") -> DataFrame:
    """Every IPv4 address in lines of text such as routing tables, with its place (line, then word)."""
    found = F.regexp_extract_all(F.col(column), F.lit(r"(?<![\d.])(\d{1,3}(?:\.\d{1,3}){3})(?![\d.])"), F.lit(1))
    return lines.select("line", F.posexplode(found).alias("at", "ip"))


def node_json(kind: Column) -> Column:
    """A node as JSON: every field of its kind, nulls written out."""
    shared = [f.name for f in S.NODE.fields[:15]]
    endpoint, device = [*shared, "agent_id", "top_cves"], [*shared, "chassis_id", "pollable", "neighbor_ports", "uplink_ports", "port_status"]
    written = {"ignoreNullFields": "false"}
    return F.when(kind == S.DEVICE, F.to_json(F.struct(*device), written)).otherwise(F.to_json(F.struct(*endpoint), written))


def edge_json() -> Column:
    """An edge as JSON without its null fields."""
    return F.to_json(F.struct(*S.EDGE.fieldNames()))


def document_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """section, at, value and what counts need of the first two lists of a graph document: a line for each row, and the lines around them."""
    spark = nodes.sparkSession

    def item(at: Column, text: Column) -> Column:
        return F.concat(F.when(at > 0, ",").otherwise(""), text)

    of_node = F.struct("kind", "discovery_method", F.col("parent_id").isNull().alias("loose"))
    of_edge = F.struct("type", "confidence")
    body = nodes.select(F.lit(1).alias("section"), F.col("discovery_order").cast("long").alias("at"), item(F.col("discovery_order"), node_json(F.col("kind"))).alias("value"), of_node.alias("node"), F.lit(None).cast("struct<type:string,confidence:string>").alias("edge"))
    body = body.unionByName(edges.select(F.lit(3).alias("section"), F.col("seq").cast("long").alias("at"), item(F.col("seq"), edge_json()).alias("value"), F.lit(None).cast(body.schema["node"].dataType).alias("node"), of_edge.alias("edge")))
    around = spark.createDataFrame([(0, 0, '{"nodes": ['), (2, 0, '],"edges": [')], "section int, at long, value string")
    return body.unionByName(around, allowMissingColumns=True)


def metadata_lines(spark: SparkSession, about: dict, lists: dict[str, DataFrame]) -> DataFrame:
    """section, at and value of the rest of a document: what is said of the whole, then lists of rows (at, value: JSON)."""
    import json

    known = json.dumps(about)[:-1] + (", " if about else "")
    around, rows = [(0, 0, '],"metadata": ' + known)], []
    for k, (name, items) in enumerate(lists.items()):
        around.append((3 * k + 1, 0, f'{"," if k else ""}{json.dumps(name)}: ['))
        rows.append(items.select(F.lit(3 * k + 2).alias("section"), "at", F.concat(F.when(F.col("at") > 0, ",").otherwise(""), "value").alias("value")))
        around.append((3 * k + 3, 0, "]"))
    around.append((3 * len(lists) + 4, 0, "}}"))
    whole = spark.createDataFrame(around, "section int, at long, value string")
    for more in rows:
        whole = whole.unionByName(more)
    return whole


def graph_lines(nodes: DataFrame, edges: DataFrame, metadata: dict) -> str:
    """The whole document as text, through the driver: for small graphs. ``join_texts`` makes the same bytes of parts."""
    import json

    def item(row: dict) -> str:
        return json.dumps(row, ensure_ascii=False, separators=(",", ":"))

    lines = [r.value for r in document_lines(nodes, edges).orderBy("section", "at").select("value").toLocalIterator()]
    lists = {k: v for k, v in metadata.items() if isinstance(v, list)}
    known = json.dumps({k: v for k, v in metadata.items() if k not in lists})[:-1]
    lines.append('],"metadata": ' + known + (", " if len(lists) < len(metadata) else ""))
    for k, (name, rows) in enumerate(lists.items()):
        lines.append(f'{"," if k else ""}{json.dumps(name)}: [')
        lines += [("," if at else "") + item(row) for at, row in enumerate(rows)] + ["]"]
    return "\n".join([*lines, "}}"]) + "\n"


def replace_document(text: str, path: str) -> None:
    """Write a document only if it parses and has nodes; a failed run leaves the old file as it is."""
    import json
    import os

    if not isinstance(json.loads(text).get("nodes"), list):
        raise ValueError("no graph document")
    with open(f"{path}.new", "w", encoding="utf-8", newline="\n") as out:
        out.write(text)
    os.replace(f"{path}.new", path)


def in_order(lines: DataFrame) -> DataFrame:
    """Lines in ranges, so that the files of a text are its parts in order."""
    return lines.repartitionByRange("section", "at").sortWithinPartitions("section", "at")


def join_texts(spark: SparkSession, folders: list[str], path: str) -> None:
    """Puts the files of text folders one after another into one file, which takes the place of ``path`` only when it is
    whole. The bytes are copied as a stream; no row is held."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs_path = jvm.org.apache.hadoop.fs.Path
    new = fs_path(f"{path}.new")
    system = new.getFileSystem(conf)
    out = system.create(new, True)
    for folder in folders:
        source = fs_path(folder).getFileSystem(conf)
        parts = sorted(s.getPath().toString() for s in source.listStatus(fs_path(folder)) if s.getPath().getName().startswith("part-"))
        for part in parts:
            opened = source.open(fs_path(part))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(opened, out, conf, False)
            opened.close()
    out.close()
    replace_file(spark, f"{path}.new", path)


def replace_file(spark: SparkSession, new: str, path: str) -> None:
    """Renames a file over another in one step."""
    jvm = spark._jvm
    fs_path, rename = jvm.org.apache.hadoop.fs.Path, jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = rename.getField("OVERWRITE").get(None)
    target = fs_path(fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(fs_path(path)).toString())
    source = fs_path(fs_path(new).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(fs_path(new)).toString())
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(source, target, options)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder of parts that were joined."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


#: The file that names the version of published tables that readers take.
CURRENT = "_current"


def publish_tables(tables: dict[str, DataFrame], folder: str) -> str:
    """Writes tables as one new version, which readers see only when all of them are written: one rename swaps the
    file that names it. A run that fails leaves the version before it as it is."""
    version = uuid4().hex
    spark = next(iter(tables.values())).sparkSession
    for name, rows in tables.items():
        rows.write.parquet(f"{folder}/{version}/{name}")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{CURRENT}.new")
    out = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(fs_path, True)
    out.writeBytes(version)
    out.close()
    replace_file(spark, f"{folder}/{CURRENT}.new", f"{folder}/{CURRENT}")
    return version


def read_published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the version that was published last."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{CURRENT}")
    opened = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    version = opened.readLine()
    opened.close()
    return spark.read.parquet(f"{folder}/{version}/{name}")
