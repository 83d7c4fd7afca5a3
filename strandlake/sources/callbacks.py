"""Records from and to the caller's own code: a Python data source whose functions read, and one whose functions write.

    register(spark)
    spark.read.format("records").option("reader", pickled(read, parts)).schema("tag string, seq string").load()
    df.write.format("records").option("writer", pickled(write)).mode("append").save()

read(part) gives the rows of a part, as tuples in the schema's order; each part is a task, and
may be read again if its executor is lost, so it should give the same rows each time.
write(part, rows) takes the rows of a task, and gives a picklable result; the results of all
tasks that succeeded reach `done`, on the driver, once.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType


def pickled(*what: object) -> str:
    """Functions and their parts as the text that an option can hold."""
    return base64.b64encode(cloudpickle.dumps(what)).decode()


def _unpickled(text: str) -> tuple:
    return cloudpickle.loads(base64.b64decode(text))


class Done(WriterCommitMessage):
    """What a task's write function gave."""

    def __init__(self, result: object):
        self.result = result


class _Reader(DataSourceReader):
    def __init__(self, read: Callable[[object], Iterable[tuple]], parts: Sequence[object]):
        self.call, self.parts = read, parts

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.parts]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.call(partition.value)


class _Writer(DataSourceWriter):
    def __init__(self, write: Callable[[int, Iterator], object], done: Callable[[list], None] | None):
        self.call, self.done = write, done

    def write(self, iterator: Iterator) -> Done:
        return Done(self.call(TaskContext.get().partitionId(), iterator))

    def commit(self, messages: list) -> None:
        if self.done:
            self.done([m.result for m in messages if m is not None])

    def abort(self, messages: list) -> None:
        pass


class Records(DataSource):
    """The data source "records"."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(*_unpickled(self.options["reader"]))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        write, done = (*_unpickled(self.options["writer"]), None)[:2]
        return _Writer(write, done)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Records)


def records(spark: SparkSession, read: Callable[[object], Iterable[tuple]], parts: Sequence[object], schema: str) -> DataFrame:
    """Rows that read(part) gives for each of the parts."""
    register(spark)
    return spark.read.format("records").option("reader", pickled(read, list(parts))).schema(schema).load()


def write_records(df: DataFrame, write: Callable[[int, Iterator], object], done: Callable[[list], None] | None = None) -> None:
    """Hands the rows of each task of df to write(part, rows)."""
    register(df.sparkSession)
    df.write.format("records").option("writer", pickled(write, done)).mode("append").save()


def lines_of(spark: SparkSession, text: str) -> DataFrame:
    """(line, value): the lines of a text in memory."""
    return spark.createDataFrame(list(enumerate(text.splitlines())), "line long, value string")
