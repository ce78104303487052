"""Files of a table store: atomic manifests and clean-up, by Hadoop's file API (any store that Spark can write)."""

from __future__ import annotations

import hashlib
import inspect
import json
from types import ModuleType

from pyspark.sql import SparkSession


def code_version(*modules: ModuleType) -> str:
    """Of the source of the modules that make a table: other code does not take up what this code has written."""
    return hashlib.sha256("".join(map(inspect.getsource, modules)).encode()).hexdigest()[:16]


def landed_files(spark: SparkSession, path: str) -> dict[str, str]:
    """Files at `path` (a file, or a folder of part files) with their sizes and times."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    files, seen = at.getFileSystem(conf).listFiles(at, True), {}
    while files.hasNext():
        f = files.next()
        if f.getPath().getName()[:1] not in "._":
            seen[f.getPath().toString()] = f"{f.getLen()}|{f.getModificationTime()}"
    return seen


class Folder:
    """A folder of a shared store.  Paths without a scheme are taken as the session's default store has them."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._gateway = spark.sparkContext._gateway
        self.path = path.rstrip("/")

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):
        return self._at("").getFileSystem(self._conf)

    def names(self, name: str = "") -> list[str]:
        """Sorted names in a sub-folder; none where it does not exist."""
        fs, at = self._fs(), self._at(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._fs().open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str, scratch: str) -> bool:
        """The file `name` with `text`, whole or not at all; False if it exists (another writer was first)."""
        fs = self._fs()
        out = fs.create(self._at(scratch), True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.mkdirs(self._at(name).getParent())
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._gateway.new_array(rename, 1)
        options[0] = rename.NONE  # never over an existing file
        # FileContext wants a scheme of its own
        full = fs.makeQualified(self._at(name))
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(full.toUri(), self._conf)
        try:
            context.rename(fs.makeQualified(self._at(scratch)), full, options)
            return True
        except Exception as e:  # py4j wraps the store's error
            if "FileAlreadyExists" not in str(e):
                raise
            fs.delete(self._at(scratch), False)
            return False

    def delete(self, name: str) -> None:
        self._fs().delete(self._at(name), True)


class Manifests:
    """Numbered JSON manifests of a folder; the greatest number is the current one.  A commit succeeds for one writer."""

    def __init__(self, folder: Folder, sub: str = "manifests"):
        self.folder, self.sub = folder, sub

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.folder.names(self.sub) if n.endswith(".json") and not n.startswith(".")]

    def load(self, version: int) -> dict:
        return json.loads(self.folder.read(f"{self.sub}/{version:012d}.json"))

    def latest(self) -> dict | None:
        found = self.versions()
        return self.load(found[-1]) if found else None

    def commit(self, version: int, content: dict, unique: str) -> bool:
        text = json.dumps(content | {"version": version}, sort_keys=True)
        return self.folder.create(f"{self.sub}/{version:012d}.json", text, f".pending-{unique}")
