"""Data sources over files: listings a folder at a time, members of ZIP archives by offset, and a sink of one file a row.

They run on the executors and reach a store through its Arrow file system, so names and bytes pass through no single process.
"""

from __future__ import annotations

import posixpath
import sys
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LISTING = "path string, length long, modified timestamp"
MEMBERS = "archive string, member string, length long, content binary, problem string"
#: A cell holds less than 2 GB.
MOST = (1 << 31) - 1


def store(uri: str) -> tuple[pafs.FileSystem, str, str]:
    """File system of a path, the path in it, and what to put before a path to name it again."""
    if uri.startswith("file:") or "://" not in uri:
        path = "/" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else posixpath.abspath(uri)
        return pafs.LocalFileSystem(), path.rstrip("/") or "/", "file:"
    fs, path = pafs.FileSystem.from_uri(uri)
    scheme, _, rest = uri.partition("://")
    return fs, path.rstrip("/"), f"{scheme}://{rest.split('/')[0]}" if scheme in ("hdfs", "viewfs") else f"{scheme}://"


def _children(fs: pafs.FileSystem, path: str) -> list[pafs.FileInfo]:
    found = fs.get_file_info(pafs.FileSelector(path, recursive=False, allow_not_found=True))
    # As Spark does, leave out what is hidden or in the making.
    return [x for x in found if not x.base_name.startswith(("_", "."))]


# --- listings


@dataclass
class Folder(InputPartition):
    path: str
    deep: bool


class FileListing(DataSource):
    """path, length and modified of all files under ``path``, those of no bytes included; a task lists a folder.

    ``recursive`` (true) takes folders below, ``folders`` (64) is the number of folders from which on tasks go down by themselves.
    """

    @classmethod
    def name(cls) -> str:
        return "larkspur_files"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(self.options["path"], self.options.get("recursive", "true") == "true", int(self.options.get("folders", "64")))


class ListingReader(DataSourceReader):
    def __init__(self, path: str, recursive: bool, folders: int):
        self.uri, self.recursive, self.folders = path, recursive, folders

    def partitions(self) -> list[Folder]:
        fs, root, _ = store(self.uri)
        if not self.recursive:
            return [Folder(root, False)]
        done, level = [], [root]
        while level and len(done) + len(level) < self.folders:  # a level of folders after the other, until there are enough
            done += [Folder(x, False) for x in level]
            level = [y.path for x in level for y in _children(fs, x) if y.type == pafs.FileType.Directory]
        return done + [Folder(x, True) for x in level]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        fs, _, before = store(self.uri)
        left = [partition.path]
        while left:
            found = _children(fs, left.pop())
            if partition.deep:
                left += [x.path for x in found if x.type == pafs.FileType.Directory]
            files = [x for x in found if x.type == pafs.FileType.File]
            for k in range(0, len(files), 10_000):
                some = files[k : k + 10_000]
                times = pa.array([None if x.mtime_ns is None else x.mtime_ns // 1000 for x in some], pa.int64()).cast(pa.timestamp("us", "UTC"))
                yield pa.RecordBatch.from_arrays([pa.array([before + x.path for x in some]), pa.array([x.size or 0 for x in some], pa.int64()), times], ["path", "length", "modified"])


def listing(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path, length and modified of the files under ``root``."""
    spark.dataSource.register(FileListing)
    return spark.read.format("larkspur_files").option("recursive", str(recursive).lower()).load(root)


def texts(found: DataFrame) -> DataFrame:
    """path and text of the files of a listing, read whole by tasks that get the paths in equal numbers; the driver sees neither."""
    spark = found.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return found.select("path").repartition(tasks).mapInArrow(_read_texts, "path string, text string")


def _read_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, held, size = [], [], 0
    pack = lambda: pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(held, pa.string())], ["path", "text"])
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            fs, path, _ = store(uri)
            with fs.open_input_stream(path) as f:
                text = f.read().decode("utf-8", "replace")
            names.append(uri)
            held.append(text)
            size += len(text)
            if size >= 1 << 22 or len(held) >= 10_000:
                yield pack()
                names, held, size = [], [], 0
    if held:
        yield pack()


# --- archives


@dataclass
class Members(InputPartition):
    archive: str
    members: list  # (name, offset of its header, bytes there, bytes, method, crc, flags)


class ZipArchives(DataSource):
    """Members of ZIP archives: archive, member, length, content, problem. ``path`` is an archive or a folder of them, however long.

    Only an archive's directory is read to plan: members with ``suffix`` are dealt by ``bytes`` (64 MB) to tasks, which read each from its offset. A member
    whose name is absolute or leads out of its folder, that is encrypted, of an unknown method, of 2 GB or more, or not what its checksum says has a null content and its ``problem``.
    """

    @classmethod
    def name(cls) -> str:
        return "larkspur_zip"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> DataSourceReader:
        return ZipReader(self.options["path"], self.options.get("suffix", ""), int(self.options.get("bytes", str(64 << 20))))


class ZipReader(DataSourceReader):
    def __init__(self, path: str, suffix: str, size: int):
        self.uri, self.suffix, self.size = path, suffix, size

    def partitions(self) -> list[Members]:
        fs, root, _ = store(self.uri)
        there = fs.get_file_info(root)
        if there.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.uri)
        archives = [root] if there.type == pafs.FileType.File else [x.path for x in _children(fs, root) if x.type == pafs.FileType.File and x.base_name.endswith(".zip")]
        out = []
        for archive in sorted(archives):
            with fs.open_input_file(archive) as f, zipfile.ZipFile(f) as z:
                infos = sorted((x for x in z.infolist() if not x.is_dir() and x.filename.endswith(self.suffix)), key=lambda x: x.header_offset)
            own, held = [], 0
            for x in infos:
                own.append((x.filename, x.header_offset, x.compress_size, x.file_size, x.compress_type, x.CRC, x.flag_bits))
                held += x.compress_size
                if held >= self.size:
                    out.append(Members(archive, own))
                    own, held = [], 0
            if own:
                out.append(Members(archive, own))
        return out

    def read(self, partition: Members) -> Iterator[tuple]:
        fs, _, before = store(self.uri)
        with fs.open_input_file(partition.archive) as f:
            for name, offset, there, size, method, crc, flags in partition.members:
                problem = _refused(name, size, method, flags)
                content = None
                if problem is None:
                    f.seek(offset + 26)
                    lengths = f.read(4)  # of the name and the extra field in the member's own header
                    f.seek(offset + 30 + int.from_bytes(lengths[:2], "little") + int.from_bytes(lengths[2:], "little"))
                    content = f.read(there)
                    try:
                        content = zlib.decompress(content, -15) if method == zipfile.ZIP_DEFLATED else content
                    except zlib.error:
                        problem = "damaged"
                    if problem is None and (len(content) != size or zlib.crc32(content) != crc):
                        problem = "damaged"
                yield before + partition.archive, name, size, content if problem is None else None, problem


def _refused(name: str, size: int, method: int, flags: int) -> str | None:
    parts = name.replace("\\", "/").split("/")
    if parts[0] == "" or ".." in parts or parts[0].endswith(":"):
        return "unsafe name"
    if flags & 1:
        return "encrypted"
    if method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        return "unknown method"
    return "too large" if size >= MOST else None


def archives(spark: SparkSession, path: str, suffix: str = "", task_bytes: int = 64 << 20) -> DataFrame:
    """Members of the ZIP archives at ``path``, dealt to tasks by offset."""
    spark.dataSource.register(ZipArchives)
    return spark.read.format("larkspur_zip").option("suffix", suffix).option("bytes", str(task_bytes)).load(path)


# --- sinks


@dataclass
class Done(WriterCommitMessage):
    task: str
    files: int


class _StagedWriter(DataSourceWriter):
    """Tasks write below a staging folder, each in one of its own, and move whole files to their places when they have written all; what a failed job has moved is taken back.

    The job's folder holds a mark as long as the job is open: a task that finds it gone, as its job has been given up meanwhile, clears up and moves nothing.
    """

    def __init__(self, root: str):
        self.uri, self.job = root, f"_staging-{uuid.uuid4().hex}"
        fs, root, _ = store(self.uri)
        fs.create_dir(f"{root}/{self.job}", recursive=True)
        with fs.open_output_stream(f"{root}/{self.job}/open") as f:
            f.write(b"")

    def write(self, rows) -> Done:
        fs, root, _ = store(self.uri)
        context = TaskContext.get()
        task = f"{context.partitionId()}-{context.taskAttemptId()}"
        stage = f"{root}/{self.job}/{task}"
        fs.create_dir(stage, recursive=True)
        names = self.staged(fs, stage, rows, context.partitionId())
        if fs.get_file_info(f"{root}/{self.job}/open").type != pafs.FileType.File:
            self.commit([])
            raise RuntimeError("the job has ended")
        with fs.open_output_stream(f"{root}/{self.job}/{task}.names") as f:
            f.write("\n".join(names).encode())
        made = set()
        for name in names:
            folder = posixpath.dirname(f"{root}/{name}")
            if folder not in made:
                fs.create_dir(folder, recursive=True)
                made.add(folder)
            fs.move(f"{stage}/{name}", f"{root}/{name}")
        return Done(task, len(names))

    def commit(self, messages: list) -> None:
        fs, root, _ = store(self.uri)
        if fs.get_file_info(f"{root}/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.job}")

    def abort(self, messages: list) -> None:
        fs, root, _ = store(self.uri)
        if fs.get_file_info(f"{root}/{self.job}/open").type == pafs.FileType.File:
            fs.delete_file(f"{root}/{self.job}/open")
        for x in fs.get_file_info(pafs.FileSelector(f"{root}/{self.job}", allow_not_found=True)):
            if x.base_name.endswith(".names"):
                with fs.open_input_stream(x.path) as f:
                    for name in filter(None, f.read().decode().split("\n")):
                        if fs.get_file_info(f"{root}/{name}").type == pafs.FileType.File:
                            fs.delete_file(f"{root}/{name}")
        self.commit([])


class EachFile(DataSource):
    """A sink of rows (path, text, src): a file at ``path`` below the folder, with the bytes of ``text`` or, where that is null, of the file ``src``.

    Paths may not lead out of the folder; of several rows with one path some row's file stays, whole.
    """

    @classmethod
    def name(cls) -> str:
        return "larkspur_each_file"

    def schema(self) -> str:
        return "path string, text string, src string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return EachFileWriter(self.options["path"])


class EachFileWriter(_StagedWriter):
    def staged(self, fs: pafs.FileSystem, stage: str, rows, partition: int) -> list[str]:
        names, made = {}, set()
        for row in rows:
            if _refused(row["path"], 0, zipfile.ZIP_STORED, 0):
                raise ValueError(f"not a path below the folder: {row['path']}")
            folder = posixpath.dirname(f"{stage}/{row['path']}")
            if folder not in made:
                fs.create_dir(folder, recursive=True)
                made.add(folder)
            with fs.open_output_stream(f"{stage}/{row['path']}") as out:
                if row["text"] is not None:
                    out.write(row["text"].encode("utf-8", "surrogatepass"))
                else:
                    other, path, _ = store(row["src"])
                    with other.open_input_stream(path) as source:
                        while part := source.read(1 << 20):
                            out.write(part)
            names[row["path"]] = None
        return list(names)


class ZipParts(DataSource):
    """A sink of rows (path, text, src): a ZIP archive a task, ``part-<n>.zip``, with a member a row."""

    @classmethod
    def name(cls) -> str:
        return "larkspur_zip_parts"

    def schema(self) -> str:
        return "path string, text string, src string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ZipPartsWriter(self.options["path"])


class ZipPartsWriter(_StagedWriter):
    def staged(self, fs: pafs.FileSystem, stage: str, rows, partition: int) -> list[str]:
        name, archive = f"part-{partition:05d}.zip", None
        with fs.open_output_stream(f"{stage}/{name}") as out:
            archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
            for row in rows:
                if row["text"] is not None:
                    archive.writestr(zipfile.ZipInfo(row["path"]), row["text"].encode("utf-8", "surrogatepass"), zipfile.ZIP_DEFLATED)
                else:
                    other, path, _ = store(row["src"])
                    with other.open_input_stream(path) as source, archive.open(zipfile.ZipInfo(row["path"]), "w", force_zip64=True) as member:
                        while part := source.read(1 << 20):
                            member.write(part)
            archive.close()
        return [name]


def write_files(rows: DataFrame, root: str, zipped: bool = False) -> None:
    """Write rows (path, text, src) as a file each below ``root``, or as members of an archive a task."""
    spark, source = rows.sparkSession, ZipParts if zipped else EachFile
    spark.dataSource.register(source)
    rows.select("path", "text", "src").write.format(source.name()).mode("append").save(root)
