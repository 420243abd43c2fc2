"""Office files as Spark data sources: office_streams reads containers, office_files writes folders of reports and documents.

Call register(spark) first. Both reach paths through pyarrow's file systems
(local ones, and stores that have a URI of theirs); for a store that only Spark
reads, use containers.read_files and containers.streams, which give the same rows.
"""

from __future__ import annotations

import json
import posixpath
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from paperloom.sources import containers

#: Bytes of the files of one partition about; a larger file has one of its own.
GROUP_BYTES = 128 << 20
SCHEMA = "doc_id string, path string, source_path string, size long, payload binary, error string"


def register(spark: SparkSession) -> None:
    """Makes both formats known to the session, and lets filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(OfficeStreams)
    spark.dataSource.register(OfficeFiles)


def _file_system(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "file:", "/" + path[5:].lstrip("/")
    if "://" in path:
        found, inner = fs.FileSystem.from_uri(path)
        return found, path[: len(path) - len(inner)] if path.endswith(inner) else "", inner
    return fs.LocalFileSystem(), "file:", posixpath.abspath(path)


def _doc_id(path: str) -> str:
    """As containers.classified has it."""
    import xxhash

    name = path.rsplit("/", 1)[-1]
    stem, dot, suffix = name.rpartition(".")
    if not (dot and suffix.isascii() and suffix.isalpha()):
        stem, suffix = name, ""
    return f"{stem}_{suffix.lower()}_{xxhash.xxh64(path.encode(), seed=42).intdigest():x}"


class OfficeStreams(DataSource):
    """Streams of the compound and zipped files below option path, as SCHEMA: path is the logical name, source_path the container's.

    Filters on doc_id, path and source_path (equal to, in, starts with) are
    pushed: files of other ids aren't opened, and of streams of other names no
    payload is read. Option wanted ("true") keeps the streams that documents are made of, payload
    ("false") leaves payloads null, so only directories are read (a listing),
    and groupbytes says how many bytes of files make a partition.

    A file that can't be opened, or is of another kind, has one row with its
    error and no path; a stream that can't be read has its names and its error.
    Hidden files (. and _) are skipped, empty folders have no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "office_streams"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return StreamReader(dict(self.options))


@dataclass
class Group(InputPartition):
    files: list[str]


class StreamReader(DataSourceReader):
    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("office_streams needs a path")
        self.root = options["path"]
        self.wanted = options.get("wanted", "false").lower() == "true"
        self.payload = options.get("payload", "true").lower() == "true"
        self.group = int(options.get("groupbytes", GROUP_BYTES))
        self.tests: list[tuple[str, str, list]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in ("doc_id", "path", "source_path"):
                yield f
            elif isinstance(f, EqualTo) and isinstance(f.value, str):
                self.tests.append((column, "in", [f.value]))
            elif isinstance(f, In) and all(isinstance(v, str) for v in f.value):
                self.tests.append((column, "in", list(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", [f.value]))
            elif isinstance(f, IsNotNull):
                self.tests.append((column, "held", []))
            else:
                yield f

    def _passes(self, **row) -> bool:
        for column, how, values in self.tests:
            if column in row:
                x = row[column]
                if x is None or how == "in" and x not in values or how == "starts" and not x.startswith(values[0]):
                    return False
        return True

    def partitions(self):
        from pyarrow import fs

        system, prefix, root = _file_system(self.root)
        files = []
        for f in system.get_file_info(fs.FileSelector(root, recursive=True)):
            inner = f.path[len(root.rstrip("/")) + 1 :].split("/")
            if f.type == fs.FileType.File and not any(p.startswith((".", "_")) for p in inner) and self._passes(doc_id=_doc_id(prefix + f.path)):
                files.append((prefix + f.path, f.size or 0))
        groups, size = [[]], 0
        for path, n in sorted(files):
            if groups[-1] and size + n > self.group:
                groups.append([])
                size = 0
            groups[-1].append(path)
            size += n
        return [Group(g) for g in groups]  # one without files if there are none

    def read(self, partition: Group):
        for path in partition.files:
            doc = _doc_id(path)
            try:
                system, _, inner = _file_system(path)
                with system.open_input_file(inner) as file:

                    def read_at(start: int, n: int) -> bytes:
                        file.seek(start)
                        return file.read(n)

                    if read_at(0, 8).hex().upper() == containers.OLE_MAGIC:
                        entries = containers.ole_entries(read_at)
                    elif inner.lower().endswith(".hwpx"):
                        entries = containers.zip_entries(file)
                    else:
                        raise ValueError("unsupported file")
                    yield from self._streams(doc, entries)
            except Exception as e:  # of the file, whatever its damage
                if self._passes(path=None, source_path=None):
                    yield doc, None, None, None, None, f"{type(e).__name__}: {e}"

    def _streams(self, doc: str, entries):
        for source, size, read in entries:
            path = containers.LOGICAL.get(source, source)
            if self.wanted and path not in containers.WANTED and not path.startswith("BinData/") or not self._passes(path=path, source_path=source):
                continue
            payload = error = None
            if self.payload:
                try:
                    payload = read()
                except Exception as e:  # of the stream; others may be whole
                    error = f"{type(e).__name__}: {e}"
            yield doc, path, source, size, payload, error


class OfficeFiles(DataSource):
    """A sink of rows (doc_id, name, content binary): one file <path>/<doc_id>/<name> each; name may have folders.

    Tasks write to a folder of the job beside the documents, each attempt
    under names of its own. Only what the attempts that Spark counts have
    written is moved into place, so an attempt that is lost or repeated leaves nothing.
    With append, a file that is there already fails the job before anything is
    moved; with overwrite it is replaced, and files of other names stay. The
    same name twice in a job, a name outside its folder and a null fail it.
    An empty DataFrame writes nothing.
    """

    @classmethod
    def name(cls) -> str:
        return "office_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        missing = {"doc_id", "name", "content"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"office_files needs columns {sorted(missing)}")
        return FileWriter(dict(self.options), overwrite)


@dataclass
class Written(WriterCommitMessage):
    """An attempt's own folder; its manifest names the files, so that messages don't grow with them."""

    attempt: str


class FileWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        if "path" not in options:
            raise ValueError("office_files needs a path")
        self.root, self.overwrite = options["path"].rstrip("/"), overwrite
        self.job = f"_job-{uuid.uuid4().hex}"
        system, _, root = _file_system(self.root)
        system.create_dir(f"{root}/{self.job}", recursive=True)  # by the driver, so that tasks that outlive the job don't make it again

    def write(self, rows) -> Written:
        system, _, root = _file_system(self.root)
        attempt, targets = f"{root}/{self.job}/{uuid.uuid4().hex}", []
        system.create_dir(attempt, recursive=False)
        for r in rows:
            if r["doc_id"] is None or r["name"] is None or r["content"] is None:
                raise ValueError(f"a null in the row of {r['doc_id']!r}, {r['name']!r}")
            target = posixpath.normpath(f"{r['doc_id']}/{r['name']}")
            if "/" in r["doc_id"] or r["doc_id"].startswith((".", "_")) or r["doc_id"] == "" or not target.startswith(f"{r['doc_id']}/") or r["name"].startswith("/"):
                raise ValueError(f"{r['name']!r} is outside the folder of {r['doc_id']!r}")
            with system.open_output_stream(f"{attempt}/{len(targets)}") as out:
                out.write(bytes(r["content"]))
            targets.append(target)
        with system.open_output_stream(f"{attempt}/manifest") as out:
            out.write(json.dumps(targets).encode())
        return Written(attempt)

    def commit(self, messages) -> None:
        """Moves what was written. The driver holds the names of the job's files, as a listing does, and no contents."""
        from pyarrow import fs

        system, _, root = _file_system(self.root)
        attempts = [m.attempt for m in messages if m is not None]
        try:
            known: set[str] = set()
            for attempt, targets in self._manifests(system, attempts):
                known_before = len(known)
                known.update(targets)
                if len(known) < known_before + len(targets):
                    raise ValueError(f"a name comes twice, in {attempt}")
                if not self.overwrite:
                    there = [f.path for f in system.get_file_info([f"{root}/{t}" for t in targets]) if f.type != fs.FileType.NotFound]
                    if there:
                        raise ValueError(f"{there[0]} is there already")
            for attempt, targets in self._manifests(system, attempts):
                for folder in {posixpath.dirname(t) for t in targets}:
                    system.create_dir(f"{root}/{folder}", recursive=True)
                for k, target in enumerate(targets):
                    system.move(f"{attempt}/{k}", f"{root}/{target}")
        finally:
            self.abort(messages)

    @staticmethod
    def _manifests(system, attempts):
        for attempt in attempts:
            with system.open_input_stream(f"{attempt}/manifest") as file:
                yield attempt, json.loads(file.read())

    def abort(self, messages) -> None:
        from pyarrow import fs

        system, _, root = _file_system(self.root)
        for _ in range(3):  # a task that still writes may be in the way once
            if system.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
                try:
                    system.delete_dir(f"{root}/{self.job}")
                except OSError:
                    time.sleep(0.5)
