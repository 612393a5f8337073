"""Bulk archives of payloads, one ZIP member for each company, as a data source.

``spark.read.format("payload_archive").load(folder)`` gives a row for each member of each archive in the folder, and
``df.write.format("payload_archive").mode("append").save(folder)`` writes one archive for each partition. The
directory of an archive is read once, when the scan is planned; its members are dealt to partitions by their size, and
a task seeks its own members and reads nothing else.
"""

from __future__ import annotations

import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from .readers import COMPANY_FACTS, facts_of, isolated

SCHEMA = "archive string, member string, value string, failure string"
#: Packed bytes of the members that one task reads, and the most that a member may unpack to.
PARTITION_BYTES, MEMBER_BYTES = 32 << 20, 50 << 20
#: Fixed part of the header before a member's data.
HEADER = struct.Struct("<4s5H3L2H")


@dataclass
class Member:
    name: str
    at: int
    packed: int
    size: int
    crc: int
    method: int


@dataclass
class Members(InputPartition):
    """Members of one archive that lie together, or the reason why the archive cannot be read."""

    archive: str
    members: list[Member]
    failure: str | None = None


@dataclass
class Written(WriterCommitMessage):
    pending: str
    path: str


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within it; a path without a scheme is local."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def directory(system: fs.FileSystem, path: str) -> list[Member]:
    """Members of an archive by place; folders are left out."""
    with system.open_input_file(path) as f, zipfile.ZipFile(f) as z:
        found = [Member(i.filename, i.header_offset, i.compress_size, i.file_size, i.CRC, i.compress_type) for i in z.infolist() if not i.is_dir()]
    return sorted(found, key=lambda m: m.at)


def unpacked(f, m: Member, most: int) -> str:
    """The text of a member, read from its place in the open file; an error if it is not what the directory says."""
    if m.size > most:
        raise ValueError(f"larger than {most} bytes")
    f.seek(m.at)
    head = HEADER.unpack(f.read(HEADER.size))
    if head[0] != b"PK\x03\x04":
        raise ValueError("no member at its place")
    f.seek(m.at + HEADER.size + head[9] + head[10])
    packed = f.read(m.packed)
    if m.method == zipfile.ZIP_STORED:
        data = packed
    elif m.method == zipfile.ZIP_DEFLATED:
        data = zlib.decompressobj(-zlib.MAX_WBITS).decompress(packed, m.size + 1)
    else:
        raise ValueError(f"packed by method {m.method}")
    if len(data) != m.size or zlib.crc32(data) != m.crc:
        raise ValueError("damaged")
    return data.decode()


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, partition_bytes: int, member_bytes: int):
        self.path, self.partition_bytes, self.member_bytes = path, partition_bytes, member_bytes

    def partitions(self) -> list[InputPartition]:
        system, path = opened(self.path)
        info = system.get_file_info(path)
        files = [info] if info.is_file else sorted((x for x in system.get_file_info(fs.FileSelector(path)) if x.is_file and not x.base_name.startswith(("_", "."))), key=lambda x: x.path)
        out: list[InputPartition] = []
        for file in files:
            try:
                members = directory(system, file.path)
            except (zipfile.BadZipFile, OSError, ValueError) as e:
                out.append(Members(file.path, [], f"unreadable archive: {e}"))
                continue
            held: list[Member] = []
            packed = 0
            for m in members:
                if held and packed + m.packed > self.partition_bytes:
                    out.append(Members(file.path, held))
                    held, packed = [], 0
                held.append(m)
                packed += m.packed
            if held:
                out.append(Members(file.path, held))
        return out or [Members(path, [])]

    def read(self, partition: Members) -> Iterator[tuple]:
        if partition.failure:
            yield partition.archive, None, None, partition.failure
        if not partition.members:
            return
        system, _ = opened(self.path)
        with system.open_input_file(partition.archive) as f:
            for m in partition.members:
                try:
                    row = (partition.archive, m.name, unpacked(f, m, self.member_bytes), None)
                except (ValueError, zlib.error, struct.error) as e:
                    row = (partition.archive, m.name, None, f"unreadable member: {e}")
                yield row


class ArchiveWriter(DataSourceWriter):
    """One archive for each partition, under another name until all are there; what an attempt that failed has left is never read."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        system, path = opened(self.path)
        name = uuid.uuid4().hex
        pending = f"{path}/_pending-{name}"
        with system.open_output_stream(pending) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            for row in rows:
                if row["member"] is not None and row["value"] is not None:
                    z.writestr(row["member"], row["value"])
        return Written(pending, f"{path}/part-{name}.zip")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _ = opened(self.path)
        for m in messages:
            if m is not None:
                system.move(m.pending, m.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _ = opened(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(m.pending)


class PayloadArchive(DataSource):
    """Options: ``partition_bytes`` and ``member_bytes``. Paths may be of any file system that Arrow opens."""

    @classmethod
    def name(cls) -> str:
        return "payload_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(self.options["path"], int(self.options.get("partition_bytes", PARTITION_BYTES)), int(self.options.get("member_bytes", MEMBER_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("archives are added; write to a new folder instead of overwriting")
        system, path = opened(self.options["path"])
        system.create_dir(path)
        return ArchiveWriter(self.options["path"])


def read_archives(spark: SparkSession, path: str, **options) -> DataFrame:
    """Members of the archives in a folder, or of one archive: archive, member, value, failure.

    A member that cannot be unpacked, or an archive that is none, is a row with a failure and stops no other.
    """
    spark.dataSource.register(PayloadArchive)
    return spark.read.format("payload_archive").options(**options).load(path)


def write_archives(payloads: DataFrame, path: str) -> None:
    """Write ``payloads(member, value)`` to a folder, an archive for each partition; rows without a member or a value go."""
    payloads.sparkSession.dataSource.register(PayloadArchive)
    rows = payloads.select(F.lit(None).cast("string").alias("archive"), "member", "value", F.lit(None).cast("string").alias("failure"))
    rows.write.format("payload_archive").mode("append").save(path)


def bulk_facts(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The facts of all members of ``read_archives``, and the members that gave none: archive, member, failure."""
    told = isolated(members.select("archive", "member", "value", F.col("failure").alias("unread")), COMPANY_FACTS)
    judged = told.withColumn("failure", F.coalesce("unread", "failure"))
    return facts_of(judged.where("failure IS NULL").select(F.col("parsed").alias("p"))), judged.where("failure IS NOT NULL").select("archive", "member", "failure")
