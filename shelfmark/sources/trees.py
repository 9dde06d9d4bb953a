"""Pages written as files of a tree, each at its own path."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "shelfmark_tree"


def _safe(path: str) -> str:
    """The path itself; one that leads out of the tree, or names no file, is an error."""
    if not path or path.startswith("/") or path.endswith("/") or posixpath.normpath(path) != path or path.split("/")[0] == "..":
        raise ValueError(f"not a path inside a tree: {path!r}")
    return path


@dataclass
class Staged(WriterCommitMessage):
    """Files that one task has put under the staging folder."""

    folder: str
    paths: list[str]


class TreeWriter(DataSourceWriter):
    """Tasks write below a staging folder of the tree; the commit moves what successful tasks have written to its place.

    A task that fails or runs twice leaves files in a folder of its own that no commit names; an aborted job leaves the tree as it was.
    """

    def __init__(self, root: str):
        self.root = root
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def _tree(self):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root.removeprefix("file:"))
        return system, base.rstrip("/")

    def write(self, iterator: Iterator[Row]) -> Staged:
        system, base = self._tree()
        folder, paths = f"{base}/{self.staging}/{uuid.uuid4().hex}", []
        for row in iterator:
            path = _safe(row["path"])
            system.create_dir(posixpath.dirname(f"{folder}/{path}"), recursive=True)
            with system.open_output_stream(f"{folder}/{path}") as out:
                out.write((row["html"] or "").encode())
            paths.append(path)
        return Staged(folder, paths)

    def commit(self, messages: list[Staged | None]) -> None:
        system, base = self._tree()
        for message in filter(None, messages):
            for path in message.paths:
                system.create_dir(posixpath.dirname(f"{base}/{path}"), recursive=True)
                system.move(f"{message.folder}/{path}", f"{base}/{path}")
        self._clear(system, base)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(*self._tree())

    def _clear(self, system, base: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{base}/{self.staging}").type != fs.FileType.NotFound:
            system.delete_dir(f"{base}/{self.staging}")


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, html string"

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options["path"])


def write_tree(pages: DataFrame, root: str) -> None:
    """Write every page (``path, html``) as a UTF-8 file below a folder that all executors reach; other files of the tree stay.

    A path may come once.  A null text is an empty file.
    """
    pages.sparkSession.dataSource.register(TreeSource)
    pages.select("path", "html").write.format(FORMAT).mode("append").option("path", root).save()
