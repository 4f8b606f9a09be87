"""A batch sink for stores that merge by key (graph and vector stores): rows go there in batches, from the tasks."""

from __future__ import annotations

import importlib
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Fixed value: rows of a batch.
BATCH = 500
FORMAT = "ravelin_merge"


@dataclass
class Written(WriterCommitMessage):
    rows: int
    batches: int


class MergeSink(DataSource):
    """``df.write.format("ravelin_merge")`` with the options ``client`` (``module:factory``, called with all options),
    ``kind``, ``key`` (columns, comma-separated) and ``batch``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return MergeWriter(dict(self.options), schema.fieldNames(), overwrite)


class MergeWriter(DataSourceWriter):
    """A task merges its rows batch after batch. A client's ``merge`` replaces rows of equal keys, so a task that runs
    again, or twice at once, leaves the same; ``begin`` is called on the driver for an overwrite, ``done`` and ``failed``
    once all tasks are."""

    def __init__(self, options: dict[str, str], fields: list[str], overwrite: bool):
        self.options, self.fields = options, fields
        self.key = [k.strip() for k in options["key"].split(",")]
        if missing := set(self.key) - set(fields):
            raise ValueError(f"no columns {sorted(missing)} for the key")
        if overwrite:
            self._client().begin(options["kind"], self.fields, self.key, True)
        else:
            self._client().begin(options["kind"], self.fields, self.key, False)

    def _client(self):
        module, _, factory = self.options["client"].partition(":")
        return getattr(importlib.import_module(module), factory)(self.options)

    def write(self, iterator: Iterator[Row]) -> Written:
        client, n, batches = self._client(), 0, 0
        for rows in batched(iterator, int(self.options.get("batch", BATCH))):
            client.merge(self.options["kind"], self.fields, self.key, [tuple(r) for r in rows])
            n, batches = n + len(rows), batches + 1
        return Written(n, batches)

    def commit(self, messages: list[Written]) -> None:
        self._client().done(self.options["kind"], sum(m.rows for m in messages if m))

    def abort(self, messages: list[Written | None]) -> None:
        self._client().failed(self.options["kind"])


class SqliteClient:
    """Merges into a SQLite file that all tasks see: for one machine, and as the model of a client."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def _run(self, statement: str, rows: list[tuple] | None = None) -> list:
        with sqlite3.connect(self.path, timeout=60) as db:  # one transaction
            found = db.execute(statement).fetchall() if rows is None else db.executemany(statement, rows).fetchall()
        db.close()
        return found

    def begin(self, kind: str, fields: list[str], key: list[str], overwrite: bool) -> None:
        if overwrite:
            self._run(f'DROP TABLE IF EXISTS "{kind}"')
        columns = ", ".join(f'"{f}"' for f in fields)
        keys = ", ".join(f'"{k}"' for k in key)
        self._run(f'CREATE TABLE IF NOT EXISTS "{kind}" ({columns}, PRIMARY KEY ({keys}))')

    def merge(self, kind: str, fields: list[str], key: list[str], rows: list[tuple]) -> None:
        marks = ", ".join("?" * len(fields))
        self._run(f'INSERT OR REPLACE INTO "{kind}" VALUES ({marks})', rows)

    def done(self, kind: str, rows: int) -> None:
        pass

    def failed(self, kind: str) -> None:
        pass

    def count(self, kind: str) -> int:
        return self._run(f'SELECT count(*) FROM "{kind}"')[0][0]

    def rows(self, kind: str) -> list[tuple]:
        return self._run(f'SELECT * FROM "{kind}"')


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MergeSink)


def merge_into(df: DataFrame, kind: str, key: list[str], client: str, overwrite: bool = False, **options: str) -> int:
    """Merges ``df`` into a store and checks that it has as many rows of ``kind`` as there are keys where it was empty,
    at least as many otherwise. Returns how many it has. Rows without a key part are an error of the caller's and are
    refused."""
    register(df.sparkSession)
    keys = df.select(*key)
    if keys.where(" OR ".join(f"`{k}` IS NULL" for k in key)).limit(1).count():
        raise ValueError("a key is null")
    df.dropDuplicates(key).write.format(FORMAT).mode("overwrite" if overwrite else "append").options(client=client, kind=kind, key=",".join(key), **options).save()
    module, _, factory = client.partition(":")
    found, expected = getattr(importlib.import_module(module), factory)(options).count(kind), keys.distinct().count()
    if found < expected or (overwrite and found != expected):
        raise ValueError(f"{kind} has {found} rows instead of {expected}")
    return found
