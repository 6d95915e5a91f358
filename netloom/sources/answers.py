"""Landed API answers as a data source: ``spark.read.format("answers")``.

An answer is a JSON document that holds a list of items at a dotted place, as listings
(``data.affected_items``) and searches (``hits.hits``) give them. A file holds one answer or
several, one after another, and is read whole by one task; small files share a task. The schema
that is asked for is the projection: other fields are never made into rows. ``terms`` (a JSON
object of places and lists of text, whole numbers or flags) select: those on names of folders
(``agent=007``) leave out files before any is opened, others drop items before they become rows.

Terms are an option and not ``pushFilters``: in Spark 4.1 what one query pushes stays with the
DataFrame, so that ``w.filter("id = '3'").count()`` changes what a later ``w.count()`` gives.
Filters on the DataFrame therefore act after the scan. Plain listings are read faster by
``landing.read_payloads``; this source is for terms that should reach the answers.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ITEMS = "data.affected_items"
#: Bytes of files that one task reads, if no single file has more.
BYTES_PER_TASK = 16 << 20
ITEMS_PER_BATCH = 4096
#: What an empty folder value is called, as Spark writes it (fixed value).
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"
EXACT = (T.StringType, T.IntegerType, T.LongType, T.ShortType, T.BooleanType)


@dataclass
class Files(InputPartition):
    """Paths, each with the columns that its folders name."""

    found: list[tuple[str, dict[str, str | None]]]


def field_at(value, place: tuple[str, ...]):
    """The value at a place in nested objects, None if something on the way isn't there."""
    for name in place:
        value = value.get(name) if isinstance(value, dict) else None
    return value


def documents_in(text: str) -> Iterator[object]:
    """The JSON documents that follow each other in a text."""
    decoder, at = json.JSONDecoder(), 0
    while at < len(text):
        if text[at].isspace():
            at += 1
        else:
            document, at = decoder.raw_decode(text, at)
            yield document


def _folder_columns(path: str) -> dict[str, str | None]:
    named = [part.split("=", 1) for part in path.split("/")[:-1] if "=" in part]
    return {name: None if value == NULL_FOLDER else unquote(value) for name, value in named}


def _open(path: str):
    """The file system of a path and the path there."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


class AnswersReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.path = schema, options["path"]
        self.place = tuple(options.get("items", ITEMS).split("."))
        self.limit = int(options.get("bytespertask", BYTES_PER_TASK))
        self.wanted = [(tuple(place.split(".")), values) for place, values in json.loads(options.get("terms", "{}")).items()]
        for place, values in self.wanted:
            if not self._is_exact(place) or not isinstance(values, list) or None in values:
                raise ValueError(f"{'.'.join(place)}: a term needs a list of values for text, whole numbers or flags of the schema")

    def _is_exact(self, place: tuple[str, ...]) -> bool:
        kind: T.DataType = self.schema
        for name in place:
            if not isinstance(kind, T.StructType) or name not in kind.names:
                return False
            kind = kind[name].dataType
        return isinstance(kind, EXACT) and place != ("pos",)

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, folder = _open(self.path)
        listed = sorted((f.path, f.size) for f in system.get_file_info(fs.FileSelector(folder, recursive=True)) if f.is_file and f.base_name[0] not in "._")
        parts, room = [], 0
        for path, size in listed:
            columns = {k: v for k, v in _folder_columns(path[len(folder) :]).items() if k in self.schema.names}
            if all(self._cast(columns, place[0]) in values for place, values in self.wanted if place[0] in columns):
                if size > room:
                    parts.append(Files([]))
                    room = max(self.limit, size)
                parts[-1].found.append((path, columns))
                room -= size
        return parts or [Files([])]

    def _cast(self, columns: dict[str, str | None], name: str):
        value, kind = columns[name], self.schema[name].dataType
        if value is None or isinstance(kind, T.StringType):
            return value
        return value.lower() == "true" if isinstance(kind, T.BooleanType) else int(value)

    def _items(self, partition: Files) -> Iterator[dict]:
        system, _ = _open(self.path)
        for path, columns in partition.found:
            of_folder = {name: self._cast(columns, name) for name in columns}
            with system.open_input_stream(path) as opened:
                text = opened.read().decode("utf-8")
            for answer in documents_in(text):
                items = field_at(answer, self.place)
                for pos, item in enumerate(items if isinstance(items, list) else []):
                    if isinstance(item, dict):
                        item = {"pos": pos, **item, **of_folder}
                        if all(field_at(item, place) in values for place, values in self.wanted):
                            yield item

    def read(self, partition: Files):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, held = to_arrow_schema(self.schema), []
        for item in self._items(partition):
            held.append(item)
            if len(held) == ITEMS_PER_BATCH:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)


class Answers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "answers"

    def schema(self):
        raise ValueError("answers need a schema: it is what is read of them")

    def reader(self, schema: T.StructType) -> AnswersReader:
        return AnswersReader(schema, {k.lower(): v for k, v in self.options.items()})


def read_answers(spark: SparkSession, path: str, schema: T.StructType | str, items: str = ITEMS, terms: Mapping[str, list] | None = None) -> DataFrame:
    """The items of the answers below a folder, those whose fields at the places of ``terms`` have one of their values.
    Fields an item lacks are null; items that are no objects, and answers without a list, give none; ``pos`` in the
    schema is the place in the list, unless the items have one of their own. A value of another kind than its field's,
    or a file that is no JSON, is an error. The schema may have nested fields; a folder without files gives no rows."""
    spark.dataSource.register(Answers)
    return spark.read.format("answers").schema(schema).option("items", items).option("terms", json.dumps(dict(terms or {}))).load(path)
