"""CSV files that stand alone: a comment line, one header and rows in each file, names and values quoted.

``df.write.format("headed_csv").option("comment", text).mode(...).save(folder)`` writes a file for each partition that
has rows. Files get their names when all are there; until then, and after a task or job that failed, none is seen.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import csv, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .archive import opened


#: What stands for a quoted empty text while files are read; no character has this number.
EMPTY = "\ufdd0"


@dataclass
class Pending(WriterCommitMessage):
    """A written file and the name it will have; both are empty where a task had no rows."""

    pending: str = ""
    path: str = ""


class HeadedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, names: list[str], comment: str, overwrite: bool):
        self.path, self.names, self.comment, self.overwrite = path, names, comment, overwrite

    def _file(self, batches: Iterator[pa.RecordBatch]) -> Pending:
        """A file under another name; text is quoted and null is nothing, so that both can be told apart from ''."""
        system, folder = opened(self.path)
        name = uuid.uuid4().hex
        at = Pending(f"{folder}/_pending-{name}", f"{folder}/part-{name}.csv")
        schema = pa.schema([(n, pa.string()) for n in self.names])
        with system.open_output_stream(at.pending) as f:
            f.write("".join(f"# {line}\n" for line in self.comment.splitlines()).encode())
            with csv.CSVWriter(f, schema) as out:
                for b in batches:
                    out.write_batch(pa.RecordBatch.from_arrays([c.cast(pa.string()) for c in b.columns], schema=schema))
        return at

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        filled = (b for b in iterator if b.num_rows)
        first = next(filled, None)
        if first is None:
            return Pending()

        def every() -> Iterator[pa.RecordBatch]:
            yield first
            yield from filled

        return self._file(every())

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = opened(self.path)
        there = [f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.base_name.startswith("part-")]
        done = [m for m in messages if m is not None and m.path]
        if not done and (self.overwrite or not there):
            done = [self._file(iter([]))]  # no rows at all: a header alone
        for m in done:
            system.move(m.pending, m.path)
        for path in there if self.overwrite else []:
            system.delete_file(path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _ = opened(self.path)
        for m in messages:
            if m is not None and m.path:
                system.delete_file(m.pending)


class HeadedCsv(DataSource):
    """Options: ``comment``, whose lines come before the header. Columns are text; ``write_headed`` makes them so."""

    @classmethod
    def name(cls) -> str:
        return "headed_csv"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        system, folder = opened(self.options["path"])
        system.create_dir(folder)
        return HeadedWriter(self.options["path"], schema.names, self.options.get("comment", ""), overwrite)


def write_headed(df: DataFrame, path: str, comment: str = "", mode: str = "overwrite") -> None:
    """``df`` as CSV files; nested columns must be text by then (``sinks.flat``)."""
    df.sparkSession.dataSource.register(HeadedCsv)
    df.select(*[F.col(f"`{c.replace('`', '``')}`").cast("string").alias(c) for c in df.columns]).write.format("headed_csv").option("comment", comment).mode(mode).save(path)


def read_headed(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of the files of ``write_headed`` as ``schema``; an empty text stays one and nothing is null."""
    rows = spark.read.schema(schema).options(header=True, comment="#", multiLine=True, quote='"', escape='"', nullValue="", emptyValue=EMPTY).csv(path)
    text = lambda c: F.when(c == EMPTY, "").otherwise(c)
    cells = [(f.name, f.dataType.simpleString(), F.col(f"`{f.name.replace('`', '``')}`")) for f in rows.schema.fields]
    return rows.select(*[(text(c) if kind == "string" else c).alias(name) for name, kind, c in cells])
