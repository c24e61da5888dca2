"""Versions of a design in one folder, of which readers see one that is whole.

    path/versions/<id>/<table>, path/versions/<id>/manifest    written first, under a name of their own
    path/published/<number>                                    written last: the id of a version

A version counts once a file with the next number is in `published`. That file is made by create-if-absent, the one step that file systems and object
stores alike do atomically, so nothing is renamed and no listing of data has to be consistent. Of two writers of one number one is refused and takes the next. A file whose
text is cut short names no version and is passed over. What a writer that died has left is a version without a
number: readers do not see it, and sweep() removes it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

END = "\n"


class _Folder:
    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.root = spark._jvm, path
        self.files = self.at().getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def names(self, *parts: str) -> list[tuple[str, int]]:
        """Names in a folder with the times of their last change."""
        where = self.at(*parts)
        return [(f.getPath().getName(), f.getModificationTime()) for f in self.files.listStatus(where)] if self.files.exists(where) else []

    def text(self, *parts: str) -> str:
        stream = self.files.open(self.at(*parts))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8", "replace")
        finally:
            stream.close()


def _published(folder: _Folder) -> list[tuple[int, str]]:
    """(number, version), the newest first."""
    out = []
    for name, _ in folder.names("published"):
        if name.isdigit():
            text = folder.text("published", name)
            if text.endswith(END) and folder.files.exists(folder.at("versions", text.strip(), "manifest")):
                out.append((int(name), text.strip()))
    return sorted(out, reverse=True)


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the newest published version; None where nothing is published."""
    for _, version in _published(_Folder(spark, path)):
        return f"{path}/versions/{version}"
    return None


def new_version(path: str) -> str:
    """A folder for a version to be written to."""
    return f"{path}/versions/{uuid.uuid4().hex}"


def publish(spark: SparkSession, path: str, version: str, tries: int = 100) -> int:
    """Makes a written version the current one; returns its number."""
    folder, name = _Folder(spark, path), version.rsplit("/", 1)[-1]
    folder.files.mkdirs(folder.at("published"))
    number = max((int(n) for n, _ in folder.names("published") if n.isdigit()), default=0)
    for _ in range(tries):
        number += 1
        try:
            stream = folder.files.create(folder.at("published", f"{number:010d}"), False)
        except Exception as e:
            if folder.files.exists(folder.at("published", f"{number:010d}")):
                continue  # another writer has this number
            raise e
        try:
            stream.write(bytearray(f"{name}{END}".encode()))
        finally:
            stream.close()
        return number
    raise OSError(f"{path}: other writers took {tries} numbers")


def sweep(spark: SparkSession, path: str, keep: int = 2, older_than_ms: int = 86_400_000) -> list[str]:
    """Removes versions beyond the newest `keep` published ones, and unpublished ones that have not changed for so long (a writer may still be at work); returns
    their names."""
    folder = _Folder(spark, path)
    published = _published(folder)
    kept, past = {v for _, v in published[:keep]}, {v for _, v in published[keep:]}
    now = folder.jvm.java.lang.System.currentTimeMillis()
    gone = []
    for name, _ in folder.names("versions"):
        changed = max([t for _, t in folder.names("versions", name)], default=0)
        if name in past or (name not in kept and now - changed >= older_than_ms):
            folder.files.delete(folder.at("versions", name), True)
            gone.append(name)
    for number, version in published[keep:]:
        folder.files.delete(folder.at("published", f"{number:010d}"), False)
    return sorted(gone)
