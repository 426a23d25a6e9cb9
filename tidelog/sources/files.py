"""Small files on whatever file system the path names, through Spark's own Hadoop client."""
from __future__ import annotations

import atexit
import json
import tempfile
import uuid

from pyspark.sql import SparkSession

from tidelog.model import ConflictError, CorruptionError


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf, self._gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway
        self.root = root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._fs.mkdirs(self._path(self.root))

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def full(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self.full(name)))

    def names(self, folder: str = "") -> list[str]:
        at = self._path(self.full(folder) if folder else self.root)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._path(self.full(name))).getLength()

    def age(self, name: str) -> float:
        """Seconds since the last change, by this machine's clock."""
        return (self._jvm.System.currentTimeMillis() - self._fs.getFileStatus(self._path(self.full(name))).getModificationTime()) / 1000

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(self.full(name)), True)

    def move(self, name: str, to: str) -> None:
        """Gives ``name`` the full path ``to``, which must not be there."""
        if not self._fs.rename(self._path(self.full(name)), self._path(to)):
            raise OSError(f"{self.full(name)} could not be moved to {to}")

    def read_json(self, name: str) -> dict:
        stream = self._fs.open(self._path(self.full(name)))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        except ValueError as e:
            raise CorruptionError(f"{self.full(name)} is not a manifest: {e}") from e
        finally:
            stream.close()

    def publish_json(self, name: str, content: dict) -> None:
        """Makes ``name`` appear whole, or raises ConflictError if it is there already.

        The finished content lies beside it first. One step then gives it its name, and fails
        if another writer was first: a hard link on a local disk, elsewhere a rename that
        doesn't overwrite. A writer that dies before that step leaves a part that nobody reads.
        """
        part = f"{name}.{uuid.uuid4().hex}.part"
        self.write_part(part, json.dumps(content).encode())
        try:
            self.claim(part, name)
        except Exception as e:
            if self.exists(name):
                raise ConflictError(f"{name} was committed by another handle") from e
            raise
        finally:
            self.delete(part)

    def write_part(self, part: str, raw: bytes) -> None:
        out = self._fs.create(self._path(self.full(part)), False)
        out.write(bytearray(raw))
        out.hsync()
        out.close()

    def claim(self, part: str, name: str) -> None:
        """Gives ``part`` the name ``name``; of several writers one succeeds."""
        src, dst = (self._fs.makeQualified(self._path(self.full(n))) for n in (part, name))
        if src.toUri().getScheme() == "file":
            at = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
            self._jvm.java.nio.file.Files.createLink(at(dst), at(src))
        else:
            self.rename_new(src, dst)

    def rename_new(self, src, dst) -> None:
        hadoop = self._jvm.org.apache.hadoop.fs
        kind = getattr(hadoop, "Options$Rename")
        options = self._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        hadoop.FileContext.getFileContext(src.toUri(), self._conf).rename(src, dst, options)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; it goes when the interpreter ends.

    Where that is unset, as in tests, and all tasks run on this machine, a temporary folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tidelog-')}"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may have ended before the interpreter does
        return
