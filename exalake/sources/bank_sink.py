"""A sink for bank files: every task writes its own, and only what one commit names is there."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT, COMMITTED, FILES = "bank_files", "_committed", "files.jsonl"


def _store(path: str):
    """(file system, folder) of an address that the driver and all executors reach."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace(":", "://", 1))


@dataclass
class Written(WriterCommitMessage):
    """What one task attempt has written: its folder, or None if it had no rows."""

    folder: str | None


class BankFilesWriter(DataSourceWriter):
    """Rows (path, part_no, content, items) to files.  A file's parts are one after another in one task, in order."""

    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite = root, overwrite

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = _store(self.root)
        folder, out, entry, entries = uuid.uuid4().hex, None, None, None

        def close() -> None:
            out.close()
            entry["digest"] = entry["digest"].hexdigest()
            entries.write((json.dumps(entry) + "\n").encode())

        for r in iterator:
            if entries is None:
                store.create_dir(f"{root}/{folder}")
                entries = store.open_output_stream(f"{root}/{folder}/{FILES}")
            if entry is None or entry["path"] != r.path:
                if entry is not None:
                    close()
                name = f"{folder}/{uuid.uuid4().hex}"
                out, entry = store.open_output_stream(f"{root}/{name}"), {"path": r.path, "name": name, "bytes": 0, "items": 0, "digest": hashlib.md5()}
            data = r.content.encode()
            out.write(data)
            entry["digest"].update(data)
            entry["bytes"] += len(data)
            entry["items"] += r["items"]
        if entries is None:
            return Written(None)
        close()
        entries.close()
        return Written(folder)

    def commit(self, messages: list[Written]) -> None:
        """The tasks' folders are named in one file, which is put in place whole: a line a task, whatever its files."""
        store, root = _store(self.root)
        named = [] if self.overwrite else committed_folders(self.root)
        store.create_dir(root)
        with store.open_output_stream(f"{root}/{COMMITTED}.new") as out:
            out.write("".join(f"{f}\n" for f in [*named, *(m.folder for m in messages if m and m.folder)]).encode())
        store.move(f"{root}/{COMMITTED}.new", f"{root}/{COMMITTED}")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _store(self.root)
        for m in messages:
            if m and m.folder:
                store.delete_dir(f"{root}/{m.folder}")


class BankFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> BankFilesWriter:
        return BankFilesWriter(self.options["path"], overwrite)


def committed_folders(root: str) -> list[str]:
    from pyarrow.fs import FileType

    store, path = _store(root)
    if store.get_file_info(f"{path}/{COMMITTED}").type == FileType.NotFound:
        return []
    return store.open_input_stream(f"{path}/{COMMITTED}").read().decode().split()


def write_bank_files(parts: DataFrame, root: str, overwrite: bool = False) -> None:
    """packages.bank_files to whole files below root, an address that all executors reach.

    A task attempt that fails, or that another one overtakes, leaves a folder that no commit names, so its files are not there
    for readers.  With overwrite the new commit takes the place of the old one at once.
    """
    parts.sparkSession.dataSource.register(BankFiles)
    ordered = parts.select("path", "part_no", "content", "items").repartition("path").sortWithinPartitions("path", "part_no")
    ordered.write.format(FORMAT).option("path", root).mode("overwrite" if overwrite else "append").save()


def read_bank_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, bytes, items, digest) of all committed files; name is where below root each one's content is."""
    folders = committed_folders(root)
    schema = "path string, name string, bytes long, items long, digest string"
    return spark.read.schema(schema).json([f"{root}/{f}/{FILES}" for f in folders]) if folders else spark.createDataFrame([], schema)
