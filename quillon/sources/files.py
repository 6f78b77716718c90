"""Small files on any file system that Spark knows: manifests and locks."""

from __future__ import annotations

import os
import socket
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from quillon.errors import Locked


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        base = self.jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}" if path else self.root)

    def exists(self, path: str = "") -> bool:
        return self.fs.exists(self.at(path))

    def names(self, path: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.at(path))] if self.exists(path) else []

    def age(self, path: str) -> float:
        """Seconds since a file was written."""
        return time.time() - self.fs.getFileStatus(self.at(path)).getModificationTime() / 1000

    def size(self, path: str) -> int:
        return self.fs.getContentSummary(self.at(path)).getLength()

    def mkdirs(self, path: str = "") -> None:
        self.fs.mkdirs(self.at(path))

    def delete(self, path: str) -> None:
        self.fs.delete(self.at(path), True)

    def read(self, path: str) -> str:
        stream = self.fs.open(self.at(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> None:
        """Write a new file; it fails if there is one."""
        out = self.fs.create(self.at(path), False)
        try:
            out.write(bytearray(text.encode()))
            out.hsync()
        finally:
            out.close()

    def publish(self, path: str, text: str) -> bool:
        """Write a file that appears whole or not at all; False if there is one.

        The name is given in one step that an existing file refuses: a hard link on local
        disks, whose rename would write over it, and a rename on other file systems.
        """
        temp = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}"
        self.create(temp, text)
        if self.fs.getScheme() == "file":
            try:
                self.jvm.java.nio.file.Files.createLink(*[self.jvm.java.io.File(self.at(p).toUri().getPath()).toPath() for p in (path, temp)])
                done = True
            except Py4JJavaError as e:
                if "FileAlreadyExists" not in str(e.java_exception):
                    raise
                done = False
        else:
            done = not self.exists(path) and self.fs.rename(self.at(temp), self.at(path))
        self.delete(temp)
        return done

    def copy(self, source: str, other: Files, target: str) -> None:
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self.at(source), other.fs, other.at(target), False, self.spark.sparkContext._jsc.hadoopConfiguration())

    def lock(self) -> None:
        """Take the writer's lock, also from a process of this host that has ended."""
        me = f"{socket.gethostname()} {os.getpid()}"
        try:
            self.create("_lock", me)
        except Exception as e:
            host, _, pid = self.read("_lock").partition(" ") if self.exists("_lock") else ("", "", "")
            if host == socket.gethostname() and pid.isdigit() and int(pid) != os.getpid() and not os.path.exists(f"/proc/{pid}"):
                self.delete("_lock")
                self.create("_lock", me)
                return
            raise Locked("the database is open in another process or handle") from e

    def unlock(self) -> None:
        self.delete("_lock")
