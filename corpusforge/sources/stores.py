"""Handles of the file systems that corpora are read from and written to.

A handle carries what a task needs to open its file system, and takes paths as that file system names them.  Paths are never
put into URIs or taken out of them again, so no character of a file name has a meaning.  Local paths are bytes, as the system
has them; those of object stores are their UTF-8.
"""

import os
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession

_SCHEME = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]+):(?://([^/]*))?(.*)$", re.S)
S3_SCHEMES = ("s3", "s3a", "s3n")


@dataclass(frozen=True)
class Found:
    """One entry of a folder; ``error`` says why nothing more is known of it."""
    path: bytes
    folder: bool
    link: bool = False
    size: int | None = None
    modified_us: int | None = None
    error: str | None = None


@dataclass(frozen=True)
class Store:
    """A file system by its scheme, authority (host and port, or bucket) and the options its client is opened with."""
    scheme: str
    authority: str = ""
    options: tuple[tuple[str, str], ...] = ()

    def _client(self):
        from pyarrow import fs
        options = dict(self.options)
        if self.scheme in S3_SCHEMES:
            return fs.S3FileSystem(**options)
        if self.scheme == "gs":
            return fs.GcsFileSystem(**options)
        host, _, port = self.authority.partition(":")
        return fs.HadoopFileSystem(host if self.scheme == "hdfs" and host else f"{self.scheme}://{self.authority}", int(port or 0), **options)

    def _name(self, path: bytes) -> str:
        inside = path.decode()
        return f"{self.authority}/{inside.lstrip('/')}".rstrip("/") if self.scheme in (*S3_SCHEMES, "gs") else inside

    def _own(self, name: str) -> bytes:
        inside = name[len(self.authority):] if self.scheme in (*S3_SCHEMES, "gs") else _SCHEME.sub(r"\3", name)
        return ("/" + inside.lstrip("/")).encode()

    def stat(self, path: bytes) -> Found | None:
        """What is at a path, links followed; None if there is nothing."""
        if self.scheme == "file":
            try:
                s = os.stat(path)
            except (FileNotFoundError, NotADirectoryError):
                return None
            except OSError as failure:
                return Found(path, False, error=_said(failure))
            return Found(path, os.path.isdir(path), False, s.st_size, s.st_mtime_ns // 1000)
        from pyarrow import fs
        info = self._client().get_file_info(self._name(path))
        return None if info.type == fs.FileType.NotFound else self._entry(info)

    def _entry(self, info) -> Found:
        from pyarrow import fs
        modified = info.mtime_ns // 1000 if info.mtime_ns is not None else None
        return Found(self._own(info.path), info.type == fs.FileType.Directory, False, info.size, modified)

    def entries(self, folder: bytes) -> Iterator[Found]:
        """The entries of a folder.  A folder or an entry that can't be looked at is an entry with an error."""
        try:
            if self.scheme != "file":
                from pyarrow import fs
                for info in self._client().get_file_info(fs.FileSelector(self._name(folder))):
                    yield self._entry(info)
                return
            with os.scandir(folder) as listing:
                for item in listing:
                    try:
                        link, below = item.is_symlink(), item.is_dir()
                        s = None if below else item.stat()
                        yield Found(item.path, below, link, s and s.st_size, s and s.st_mtime_ns // 1000)
                    except OSError as failure:
                        yield Found(item.path, False, True, error=_said(failure))
        except Exception as failure:  # whatever the client raises: the folder is left out and says so
            yield Found(folder, True, error=_said(failure))

    def read(self, path: bytes) -> bytes:
        if self.scheme == "file":
            with open(path, "rb") as stream:
                return stream.read()
        with self._client().open_input_stream(self._name(path), compression=None) as stream:
            return stream.read()

    def write(self, path: bytes, data: bytes, made: set[bytes]) -> None:
        """Write or overwrite a file; ``made`` remembers the folders that are there."""
        folder = posixpath.dirname(path)
        if self.scheme == "file":
            if folder not in made:
                os.makedirs(folder, exist_ok=True)
            with open(path, "wb") as stream:
                stream.write(data)
        else:
            client = self._client()
            if folder not in made:
                client.create_dir(self._name(folder), recursive=True)
            with client.open_output_stream(self._name(path), compression=None) as stream:
                stream.write(data)
        made.add(folder)


def _said(failure: Exception) -> str:
    return f"{type(failure).__name__}: {failure.strerror or failure}" if isinstance(failure, OSError) else f"{type(failure).__name__}: {failure}"


def _s3_options(bucket: str, setting) -> dict[str, str]:
    """The client's options from the cluster's Hadoop settings, those of the bucket first."""
    def value(name: str) -> str | None:
        return setting(f"fs.s3a.bucket.{bucket}.{name}") or setting(f"fs.s3a.{name}")

    names = {"access_key": "access.key", "secret_key": "secret.key", "session_token": "session.token",
             "endpoint_override": "endpoint", "region": "endpoint.region"}
    options = {k: v for k, name in names.items() if (v := value(name))}
    if (value("connection.ssl.enabled") or "").lower() == "false":
        options["scheme"] = "http"
    return options


def open_target(spark: SparkSession, target: str) -> tuple[Store, bytes]:
    """The store of a target and the path in it; without a scheme the session's default file system has it."""
    conf = spark._jsc.hadoopConfiguration()
    known = _SCHEME.match(target)
    scheme, authority, path = (known[1].lower(), known[2] or "", known[3]) if known and ("//" in target[:len(known[1]) + 3]
                                                                                  or known[3].startswith("/")) else ("", "", target)
    if not scheme:
        default = _SCHEME.match(conf.get("fs.defaultFS") or "file:///")
        scheme, authority = default[1].lower(), default[2] or ""
        if scheme != "file" and not path.startswith("/"):
            home = spark._jvm.org.apache.hadoop.fs.FileSystem.get(conf).getWorkingDirectory().toUri().getPath()
            path = f"{home}/{path}"
    if scheme == "file":
        absolute = os.path.abspath(os.fsencode(path))
        return Store("file"), absolute
    options = _s3_options(authority, conf.get) if scheme in S3_SCHEMES else {}
    return Store(scheme, authority, tuple(sorted(options.items()))), (posixpath.normpath(path) if path else "/").encode()
