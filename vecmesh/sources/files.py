"""Small files and directories through Hadoop's file systems, so that any store Spark reads will do."""

from __future__ import annotations

import os
import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only where it is unset and all run on this machine, as in tests, a temporary one for this application; on a
    cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="vecmesh-checkpoint-")
    return _own[context.applicationId]


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.root = root.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(name))) if self.exists(name) else []

    def is_folder(self) -> bool:
        return self.fs.exists(self._path("")) and self.fs.getFileStatus(self._path("")).isDirectory()

    def sizes(self, name: str) -> dict[str, int]:
        """The size of each file below a folder, by its path from there."""
        if not self.exists(name):
            return {}
        top, out = self._path(name).toUri().getPath(), {}
        found = self.fs.listFiles(self._path(name), True)
        while found.hasNext():
            one = found.next()
            out[one.getPath().toUri().getPath()[len(top) + 1 :]] = one.getLen()
        return out

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Write beside the target and rename over it; a reader sees the old or the new file."""
        temporary = self._path(f"{name}.new")
        stream = self.fs.create(temporary, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri() if "://" in self.root else self.fs.getUri(), self.conf)
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.jvm.java.lang.reflect.Array.newInstance(rename.OVERWRITE.getClass(), 1)
        options[0] = rename.OVERWRITE
        context.rename(temporary, self._path(name), options)

    def create(self, name: str, text: str = "") -> bool:
        """Make a file that isn't there yet; False if it is. Of several that try, one succeeds."""
        path = self._path(name)
        if self.fs.getScheme() == "file":  # whose create isn't exclusive; a link is
            target = path.toUri().getPath()
            os.makedirs(os.path.dirname(target), exist_ok=True)
            own = f"{target}.{uuid.uuid4().hex}.new"
            with open(own, "w", encoding="utf-8") as f:
                f.write(text)
            try:
                os.link(own, target)
            except FileExistsError:
                return False
            finally:
                os.unlink(own)
            return True
        try:
            stream = self.fs.create(path, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def age(self, name: str) -> float:
        """Seconds since a file or folder was changed."""
        return time.time() - self.fs.getFileStatus(self._path(name)).getModificationTime() / 1000

    def rename(self, name: str, to: str) -> None:
        """Move a file or folder to a name that isn't taken."""
        self.fs.mkdirs(self._path(to).getParent())
        if self.exists(to) or not self.fs.rename(self._path(name), self._path(to)):
            raise OSError(f"{to} is taken")

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)
