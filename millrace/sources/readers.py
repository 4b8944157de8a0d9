"""Sources as DataFrames with explicit schemas."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from enum import Enum
from threading import Lock
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StringType, StructType

from millrace.functions.guards import check_fragment, check_select, local_path, queue_key, quoted_identifier
from millrace.operators.chunks import item_index, sorted_index

PAGE, MOST_PAGE = 100, 10_000


class Reader(Protocol):
    def to_df(self, spark: SparkSession) -> DataFrame: ...


def resumed(df: DataFrame, order: Sequence[str | Column], position: int = 0, most: int | None = None) -> DataFrame:
    """The items of a total order from a position on, in that order, and at most so many in all: a filter on their gapless index, in as many tasks as there are."""
    if not position:
        out = df.orderBy(*order)
        return out if most is None else out.limit(max(0, most))
    at = F.col("_position")
    found = item_index(df, order, "_position").where((at >= position) & (at < most if most is not None else F.lit(True)))
    return found.orderBy("_position").drop("_position")


@dataclass(frozen=True)
class ListReader:
    """Items held by the driver: rows, or scalars as a column `value`."""

    items: Sequence[Any]
    schema: StructType | str

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [x if isinstance(x, (tuple, dict, list)) else (x,) for x in self.items]
        return spark.createDataFrame(rows, self.schema)


@dataclass(frozen=True)
class IterableReader:
    """A single pass over an iterator or generator, taken in by the driver."""

    items: Iterable[Any]
    schema: StructType | str

    def to_df(self, spark: SparkSession) -> DataFrame:
        return ListReader(list(self.items), self.schema).to_df(spark)


@dataclass(frozen=True)
class CallbackReader:
    """A callable, or an object's method, that gives items until None."""

    call: Callable[[], Any]
    schema: StructType | str

    def to_df(self, spark: SparkSession) -> DataFrame:
        return ListReader(list(iter(self.call, None)), self.schema).to_df(spark)


def method_reader(target: Any, method: str, schema: StructType | str) -> CallbackReader:
    return CallbackReader(getattr(target, method), schema)


@dataclass(frozen=True)
class ParquetReader:
    path: str | Sequence[str]

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(*([self.path] if isinstance(self.path, str) else self.path))


@dataclass(frozen=True)
class CsvReader:
    """Delimited files by schema. Strict: the first malformed record fails the job; else it goes to `corrupt_column`, never to the end of data."""

    path: str | Sequence[str]
    schema: StructType | str
    delimiter: str = ","
    quote: str = '"'
    escape: str = '"'
    header: bool = False
    strict: bool = True
    corrupt_column: str = "_corrupt_record"
    base: str | None = None

    def to_df(self, spark: SparkSession) -> DataFrame:
        paths = [self.path] if isinstance(self.path, str) else list(self.path)
        if self.base is not None:
            paths = [str(local_path(p, self.base)) for p in paths]
        schema = spark.createDataFrame([], self.schema).schema
        options = {"sep": self.delimiter, "quote": self.quote, "escape": self.escape, "header": self.header, "emptyValue": "", "nullValue": "\u0000", "enforceSchema": True}
        # a missing or empty field is '', not null
        texts = {f.name: F.coalesce(f.name, F.lit("")) for f in schema.fields if isinstance(f.dataType, StringType) and f.name != self.corrupt_column}
        if self.strict:
            return spark.read.options(**options, mode="FAILFAST").schema(schema).csv(paths).withColumns(texts)
        if self.corrupt_column not in schema.fieldNames():
            schema = StructType([*schema.fields]).add(self.corrupt_column, "string")
        return spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord=self.corrupt_column).schema(schema).csv(paths).withColumns(texts)

    def quarantine(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """(well-formed rows, malformed records)."""
        whole = replace(self, strict=False).to_df(spark).persist()  # the parser refuses to read the malformed records alone
        bad = F.col(self.corrupt_column).isNotNull()
        return whole.where(~bad).drop(self.corrupt_column), whole.where(bad).select(self.corrupt_column)


@dataclass(frozen=True)
class JsonReader:
    """A file that is one JSON array; not splittable, so a file is a task."""

    path: str | Sequence[str]
    schema: StructType | str
    strict: bool = True

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.read.option("multiLine", True).option("mode", "FAILFAST" if self.strict else "DROPMALFORMED").schema(self.schema).json(self.path)


@dataclass(frozen=True)
class JsonLinesReader:
    """An object per line; blank lines are passed over, and a line that is no object fails a strict read."""

    path: str | Sequence[str]
    schema: StructType | str
    strict: bool = True

    def to_df(self, spark: SparkSession) -> DataFrame:
        lines = spark.read.text(self.path).where(F.trim("value") != "")
        parsed = F.from_json("value", spark.createDataFrame([], self.schema).schema, {"mode": "FAILFAST" if self.strict else "PERMISSIVE"})
        objects = lines.where(F.when(F.col("value").rlike(r"^\s*\{"), True).otherwise(F.raise_error(F.concat(F.lit("not an object: "), "value")).cast("boolean"))) if self.strict else lines.where(F.col("value").rlike(r"^\s*\{"))
        return objects.select(parsed.alias("item")).where("item is not null").select("item.*")


@dataclass(frozen=True)
class FixedWidthReader:
    path: str | Sequence[str]
    tokenizer: Any

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.read.text(self.path).select(self.tokenizer(F.col("value")).alias("t")).select("t.*")


@dataclass(frozen=True)
class SqlReader:
    """A SELECT over registered tables, its parameters bound by name or position; Catalyst plans what it says."""

    sql: str
    args: dict[str, Any] | list[Any] | None = None
    check: bool = True

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.sql(check_select(self.sql) if self.check else self.sql, self.args)


@dataclass(frozen=True)
class JdbcReader:
    """A table or SELECT of a database; with predicates, a partition each."""

    url: str
    query: str | None = None
    table: str | None = None
    predicates: Sequence[str] | None = None
    fetch_size: int = 1000
    properties: dict[str, str] | None = None

    def to_df(self, spark: SparkSession) -> DataFrame:
        properties = {"fetchsize": str(self.fetch_size), **(self.properties or {})}
        if self.predicates:
            return spark.read.jdbc(self.url, quoted_identifier(self.table).replace("`", '"'), predicates=list(self.predicates), properties=properties)
        return spark.read.format("jdbc").options(url=self.url, query=check_select(self.query), **properties).load()


@dataclass(frozen=True)
class PagingQuery:
    """SELECT, FROM, WHERE and ORDER BY parts that give a page or a count."""

    select: str
    table: str
    where: str | None = None
    sort: str | None = None

    def __post_init__(self) -> None:
        for part in (self.select, self.table, self.where, self.sort):
            if part is not None:
                check_fragment(part)

    def page(self, page: int, size: int = PAGE) -> str:
        if not 1 <= size <= MOST_PAGE:
            raise ValueError(f"a page has 1 to {MOST_PAGE} rows")
        parts = [f"SELECT {self.select} FROM {self.table}", f"WHERE {self.where}" if self.where else "", f"ORDER BY {self.sort}" if self.sort else "", f"LIMIT {size} OFFSET {page * size}"]
        return " ".join(p for p in parts if p)

    def count(self) -> str:
        return f"SELECT COUNT(*) AS n FROM {self.table}" + (f" WHERE {self.where}" if self.where else "")


class PagingProvider(Protocol):
    """What gives a paged reader its statements."""

    def page(self, page: int, size: int = PAGE) -> str: ...

    def count(self) -> str: ...


@dataclass(frozen=True)
class PagedReader:
    """Pages of a query in order, from an absolute row position: a restart inside a page neither loses nor repeats rows."""

    query: PagingQuery
    size: int = PAGE

    def page(self, spark: SparkSession, number: int) -> DataFrame:
        return spark.sql(self.query.page(number, self.size))

    def pages(self, spark: SparkSession, position: int = 0) -> Iterator[DataFrame]:
        # sorted and numbered once; a page is a range of the number, which the files' statistics narrow down
        numbered = sorted_index(self.to_df(spark), "_position")
        total = spark.sql(self.query.count()).first()["n"]
        while position < total:
            most = self.size - position % self.size
            yield numbered.where(F.col("_position").between(position, position + most - 1)).orderBy("_position").drop("_position")
            position += most

    def to_df(self, spark: SparkSession) -> DataFrame:
        q = self.query
        return spark.sql(f"SELECT {q.select} FROM {q.table}" + (f" WHERE {q.where}" if q.where else "") + (f" ORDER BY {q.sort}" if q.sort else ""))


@dataclass(frozen=True)
class CriteriaReader:
    """A table by equality criteria and an order, as object mappers read it."""

    source: Callable[[SparkSession], DataFrame]
    criteria: dict[str, Any]
    order: Sequence[str | Column] = ("id",)

    def to_df(self, spark: SparkSession) -> DataFrame:
        df = self.source(spark)
        for name, value in self.criteria.items():
            df = df.where(F.col(name).isNull() if value is None else F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
        return df.orderBy(*self.order)


@dataclass(frozen=True)
class MultiReader:
    """Several resources one after the other: resource_index says which an item is of; empty ones don't end the stream."""

    readers: Sequence[Reader]

    def to_df(self, spark: SparkSession) -> DataFrame:
        frames = [r.to_df(spark).withColumn("resource_index", F.lit(i)) for i, r in enumerate(self.readers)]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out


@dataclass(frozen=True)
class MappedReader:
    """A reader whose items a processor maps as they are read."""

    inner: Reader
    processor: Callable[[DataFrame], DataFrame]

    def to_df(self, spark: SparkSession) -> DataFrame:
        return self.processor(self.inner.to_df(spark))


@dataclass(frozen=True)
class SynchronizedReader:
    """One thread of the driver at a time may open the inner reader, so steps in parallel can share it."""

    inner: Reader
    lock: Any = field(default_factory=Lock, compare=False)

    def to_df(self, spark: SparkSession) -> DataFrame:
        with self.lock:
            return self.inner.to_df(spark)


def with_resource(reader: Any, path: str) -> Any:
    """The same reader or writer for another path."""
    return replace(reader, path=path)


@dataclass(frozen=True)
class ScriptedReader:
    """Items and errors in a given order, for tests: the read fails where an error comes."""

    script: Sequence[Any]
    schema: StructType | str

    def to_df(self, spark: SparkSession) -> DataFrame:
        def items() -> Iterator[Any]:
            for x in self.script:
                if isinstance(x, BaseException):
                    raise x
                yield x

        return IterableReader(items(), self.schema).to_df(spark)


class Streams:
    """Opens, updates and closes several resources; closing tries all, then raises the first error."""

    def __init__(self, *streams: Any):
        self.streams = streams

    def open(self, context: dict) -> None:
        for s in self.streams:
            s.open(context)

    def update(self, context: dict) -> None:
        for s in self.streams:
            s.update(context)

    def close(self) -> None:
        failed = []
        for s in self.streams:
            try:
                s.close()
            except Exception as e:
                failed.append(e)
        if failed:
            raise failed[0]


class QueueStructure(Enum):
    """How a key-value server holds a queue."""

    LIST, SET, STREAM = "list", "set", "stream"


class QueueSource(DataSource):
    """A queue (list, set or stream of a key-value server) as a batch or streaming source.

    options: `client`, the dotted name of a function without arguments that gives a
    client; `key`; `batch`; `structure`; `partitions`. The client has
    range(key, start, count) -> texts for a list, and length(key) if it is read in
    several partitions; scan(key, cursor, count) -> (cursor, texts), 0 at the end, for
    a set; after(key, id, count) -> (id, text) pairs for a stream. Reading does not
    remove entries: the position is the query's checkpoint, so a restart neither
    loses nor repeats them. Sets have no order and are read in batches alone.
    """

    @classmethod
    def name(cls) -> str:
        return "millrace_queue"

    def schema(self) -> str:
        return "position long, value string"

    def _client(self) -> Any:
        import importlib

        module, _, name = self.options["client"].rpartition(".")
        return getattr(importlib.import_module(module), name)()

    def reader(self, schema: StructType) -> DataSourceReader:
        structure = QueueStructure(self.options.get("structure", "list"))
        return _QueueBatch(self._client, queue_key(self.options["key"]), int(self.options.get("batch", 1000)), structure, int(self.options.get("partitions", 1)))

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        structure = QueueStructure(self.options.get("structure", "list"))
        if structure is QueueStructure.SET:
            raise ValueError("a set has no order to resume from")
        return _QueueStream(self._client, queue_key(self.options["key"]), int(self.options.get("batch", 1000)), structure)


class _QueueBatch(DataSourceReader):
    def __init__(self, client: Callable[[], Any], key: str, batch: int, structure: QueueStructure = QueueStructure.LIST, count: int = 1):
        self.client, self.key, self.batch, self.structure, self.count = client, key, batch, structure, count

    def partitions(self) -> list[InputPartition]:
        if self.structure is not QueueStructure.LIST or self.count == 1:
            return [InputPartition((0, None))]
        total = self.client().length(self.key)
        edges = [total * i // self.count for i in range(self.count + 1)]
        return [InputPartition((a, b)) for a, b in zip(edges, edges[1:], strict=False) if a < b]

    def read(self, partition: InputPartition) -> Iterator[tuple[int, str]]:
        client, (at, end) = self.client(), partition.value
        if self.structure is QueueStructure.LIST:
            while found := client.range(self.key, at, self.batch if end is None else min(self.batch, end - at)):
                yield from ((at + i, v) for i, v in enumerate(found))
                at += len(found)
                if at == end:
                    return
        elif self.structure is QueueStructure.SET:
            cursor = None
            while cursor != 0:
                cursor, found = client.scan(self.key, cursor or 0, self.batch)
                yield from ((at + i, v) for i, v in enumerate(found))
                at += len(found)
        else:
            last = "0"
            while found := client.after(self.key, last, self.batch):
                yield from ((at + i, v) for i, (_, v) in enumerate(found))
                at, last = at + len(found), found[-1][0]


class _QueueStream(SimpleDataSourceStreamReader):
    def __init__(self, client: Callable[[], Any], key: str, batch: int, structure: QueueStructure = QueueStructure.LIST):
        self.client, self.key, self.batch, self.structure = client, key, batch, structure

    def initialOffset(self) -> dict:
        return {"at": 0} if self.structure is QueueStructure.LIST else {"at": 0, "id": "0"}

    def read(self, start: dict) -> tuple[Iterator[tuple[int, str]], dict]:
        if self.structure is QueueStructure.STREAM:
            entries = self.client().after(self.key, start["id"], self.batch)
            end = {"at": start["at"] + len(entries), "id": entries[-1][0] if entries else start["id"]}
            return iter([(start["at"] + i, v) for i, (_, v) in enumerate(entries)]), end
        found = self.client().range(self.key, start["at"], self.batch)
        return iter([(start["at"] + i, v) for i, v in enumerate(found)]), {"at": start["at"] + len(found)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple[int, str]]:
        if self.structure is QueueStructure.STREAM:
            entries = self.client().after(self.key, start["id"], end["at"] - start["at"])
            return iter([(start["at"] + i, v) for i, (_, v) in enumerate(entries)])
        found = self.client().range(self.key, start["at"], end["at"] - start["at"])
        return iter([(start["at"] + i, v) for i, v in enumerate(found)])
