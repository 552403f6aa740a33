"""File corpora from directories, files and globs.

Folders are walked in tasks, and nothing is left out for its name.  A task walks its folders down until it has listed its share;
the folders that are then open are dealt out anew, so a deep tree takes a few rounds, not one a level.  Links to folders are not
walked into.  Only files whose path passes the filters are opened; whatever can't be listed or read is a row with its error.
"""

import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.functions import paths
from corpusforge.functions.text import decode_utf8
from corpusforge.session import shuffle_partitions, stored
from corpusforge.sources.stores import Found, Store, open_target

_LISTED = "raw binary, pattern int, open boolean, size_bytes long, modified_at timestamp, error string"
_WILD = re.compile(r"[*?\[]")
#: Entries that a task lists before it hands back its open folders: in the first round, where one task has the targets, and later.
FIRST_SHARE, SHARE = 2_000, 50_000
#: Bytes and files that a reading task passes on at a time, and bytes of a task's files.
BATCH_BYTES, BATCH_FILES, TASK_BYTES = 16 << 20, 512, 128 << 20
#: A file is one value of a row, so no larger one can be read.
MAX_FILE_BYTES = (1 << 31) - (1 << 16)


class Glob:
    """A shell glob over whole paths: ``**`` is any folders, and wildcards leave out names that begin with a dot."""

    def __init__(self, pattern: bytes):
        self.parts = pattern.decode("utf-8", "surrogateescape").strip("/").split("/")
        self.fixed = next(i for i, part in enumerate(self.parts) if _WILD.search(part))
        self.names = [None if part == "**" else re.compile(self._name(part), re.S) for part in self.parts]
        #: Where ``**`` may go down without end, links are not followed.
        self.endless = None in self.names

    @staticmethod
    def _name(part: str) -> str:
        def one(token: str) -> str:
            if len(token) == 1:
                return {"*": ".*", "?": "."}.get(token) or re.escape(token)
            negated = token[1] == "!"
            inside = re.sub(r"([\\^\[])", r"\\\1", token[1 + negated:-1])
            return f"[{'^' if negated else ''}{inside}]"

        body = "".join(map(one, re.findall(r"\[!?\]?[^\]]*\]|.", part, re.S)))
        return (r"(?!\.)" if _WILD.match(part) else "") + body + r"\Z"

    @property
    def root(self) -> bytes:
        return ("/" + "/".join(self.parts[:self.fixed])).encode("utf-8", "surrogateescape")

    def _states(self, path: bytes) -> set[int]:
        """Numbers of parts that a path can have used up."""
        states = {0}
        for name in path.decode("utf-8", "surrogateescape").strip("/").split("/"):
            states = self._closed(states)
            states = {s if self.names[s] is None else s + 1 for s in states if s < len(self.names) and (
                not name.startswith(".") if self.names[s] is None else self.names[s].match(name))}
        return states

    def _closed(self, states: set[int]) -> set[int]:
        """``**`` may stand for no folder at all."""
        out = set(states)
        for s in sorted(states):
            while s < len(self.names) and self.names[s] is None:
                s += 1
                out.add(s)
        return out

    def matches(self, path: bytes) -> bool:
        return len(self.names) in self._closed(self._states(path))

    def leads_on(self, folder: bytes) -> bool:
        return any(s < len(self.names) for s in self._states(folder))


def _walk(rows: DataFrame, store: Store, globs: list[Glob], share: int) -> DataFrame:
    """Files under the folders of ``rows`` (raw, pattern), folders that are still open, and errors."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            out.clear()
            kinds = [pa.binary(), pa.int32(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC"), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                              names=["raw", "pattern", "open", "size_bytes", "modified_at", "error"])

        listed, folders = 0, deque()
        for rows_in in batches:
            folders.extend(zip(rows_in.column("raw").to_pylist(), rows_in.column("pattern").to_pylist(), strict=True))
        while folders and listed < share:
            folder, k = folders.popleft()
            glob = globs[k] if k >= 0 else None
            for found in store.entries(folder):
                listed += 1
                if found.folder and not found.error:
                    # A link may lead back up; only where the glob's depth ends the walk is it followed.
                    if glob.leads_on(found.path) and not (found.link and glob.endless) if glob else not found.link:
                        folders.append((found.path, k))
                elif glob is None or found.error or glob.matches(found.path):
                    out.append((found.path, k, False, found.size, found.modified_us, found.error))
                if len(out) >= 10_000:
                    yield batch()
        out.extend((folder, k, True, None, None, None) for folder, k in folders)
        yield batch()

    return rows.select("raw", "pattern").mapInArrow(walk, _LISTED)


def _targets(spark: SparkSession, targets: list[str]) -> dict[Store, tuple[list[Found], list[tuple[bytes, int]], list[Glob]]]:
    """Per store: files and errors that the targets name, folders to walk, and globs.

    A target that is there is taken as it is named, whatever its characters; only others are globs.
    """
    plan: dict[Store, tuple] = {}
    for target in targets:
        store, path = open_target(spark, target)
        files, folders, globs = plan.setdefault(store, ([], [], []))
        found = store.stat(path)
        if found is None and _WILD.search(target):
            glob = Glob(path)
            if (root := store.stat(glob.root)) and root.folder:
                globs.append(glob)
                folders.append((glob.root, len(globs) - 1))
        elif found is None:
            files.append(Found(path, False, error="not found"))
        elif found.folder:
            folders.append((path, -1))
        else:
            files.append(found)
    return plan


def _list_store(spark: SparkSession, store: Store, files: list[Found], folders: list[tuple[bytes, int]], globs: list[Glob]) -> DataFrame:
    named = [(f.path, -1, False, f.size, None, f.error, f.modified_us) for f in files]
    whole = spark.createDataFrame([tuple(map(lambda v: bytearray(v) if isinstance(v, bytes) else v, n)) for n in named],
                                  f"{_LISTED}, us long").withColumn("modified_at", F.timestamp_micros("us")).drop("us")
    tables, share = [whole], FIRST_SHARE
    level = spark.createDataFrame([(bytearray(p), k) for p, k in folders], "raw binary, pattern int").coalesce(1)
    width = shuffle_partitions(spark)
    while folders:
        table = stored(_walk(level, store, globs, share), "listing")
        tables.append(table.filter("not open"))
        level, share = table.filter("open").repartition(width, "raw"), SHARE
        if table.filter("open").isEmpty():
            break
    union = tables[0]
    for table in tables[1:]:
        union = union.union(table)
    return union.drop("pattern", "open").dropDuplicates(["raw"])


def _inside(spark: SparkSession, root: str | None):
    """A path as text, below ``root`` where it is there; bytes that are no UTF-8 are written as escapes."""
    raw = F.col("raw")
    if root:
        prefix = open_target(spark, root)[1].rstrip(b"/") + b"/"
        raw = F.when(F.startswith(raw, F.lit(prefix)), F.expr(f"substring(raw, {len(prefix) + 1})")).otherwise(raw)
    escaped = F.regexp_replace(F.hex(raw), "(..)", r"\\\\x$1")
    return F.coalesce(F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")), escaped)


def _files(spark: SparkSession, targets: list[str], extensions: list[str] | None, root: str | None) -> list[tuple[Store, DataFrame]]:
    """Every store with what its targets list: raw, path, size_bytes, modified_at, error."""
    path = _inside(spark, root)
    return [(store, _list_store(spark, store, *plan).withColumn("path", path)
             .filter(F.col("error").isNotNull() | paths.has_extension(F.col("path"), extensions)))
            for store, plan in _targets(spark, targets).items()]


def _read(files: DataFrame, store: Store) -> DataFrame:
    """``files`` with content (bytes) or the error that kept a file from being read."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, held, content, errors = 0, 0, [], []
            names = [*batch.schema.names, "bytes"]
            place = names.index("error")
            for k in range(batch.num_rows):
                data, error = None, batch.column("error")[k].as_py()
                size = batch.column("size_bytes")[k].as_py() or 0
                if error is None and size > MAX_FILE_BYTES:
                    error = f"larger than {MAX_FILE_BYTES} bytes"
                elif error is None:
                    try:
                        data = store.read(batch.column("raw")[k].as_py())
                    except Exception as failure:  # whatever the client raises: the file is left out and says so
                        error = f"{type(failure).__name__}: {failure}"
                content.append(data)
                errors.append(error)
                held += len(data or b"")
                following = batch.column("size_bytes")[k + 1].as_py() or 0 if k + 1 < batch.num_rows else 0
                if held + following > BATCH_BYTES or len(content) == BATCH_FILES or k + 1 == batch.num_rows:
                    columns = batch.slice(begin, len(content)).columns
                    columns[place] = pa.array(errors, pa.string())
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(content, pa.binary())], names=names)
                    begin, held, content, errors = k + 1, 0, [], []

    total = files.agg(F.sum("size_bytes")).first()[0] or 0
    wide = max(shuffle_partitions(files.sparkSession), total // TASK_BYTES + 1)
    dealt = files.select("raw", "path", "size_bytes", "modified_at", "error").repartition(int(wide), "raw")
    return dealt.mapInArrow(read, "raw binary, path string, size_bytes long, modified_at timestamp, error string, bytes binary")


def read_files(spark: SparkSession, targets: list[str], extensions: list[str] | None = None, root: str | None = None,
               corpus_id: str = "") -> DataFrame:
    """files(corpus_id, path, content, size_bytes, modified_at, error), a row for all that the targets hold.

    ``content`` is null where ``error`` says why: the file, the folder or the target could not be read.  Names may have any
    characters; a file that several targets hold is one row; no targets give no rows.  Keep the result where both kinds of
    rows are needed (``scan_once``): every use reads the files.
    """
    empty = spark.createDataFrame([], "corpus_id string, path string, content string, size_bytes long, modified_at timestamp, error string")
    for store, files in _files(spark, targets, extensions, root):
        empty = empty.union(_read(files, store).select(
            F.lit(corpus_id), "path", decode_utf8(F.col("bytes")), F.coalesce(F.octet_length("bytes").cast("long"), "size_bytes"),
            "modified_at", "error"))
    return empty


def scan_once(spark: SparkSession, targets: list[str], extensions: list[str] | None = None, root: str | None = None,
              corpus_id: str = "") -> tuple[DataFrame, DataFrame]:
    """The files that can be read and the (path, error) of what can't, from one listing and one read."""
    rows = stored(read_files(spark, targets, extensions, root, corpus_id), "scan")
    return rows.filter("error is null").drop("error"), rows.filter("error is not null").select("path", "error")


def scan_corpus(spark: SparkSession, targets: list[str], extensions: list[str] | None = None, root: str | None = None,
                corpus_id: str = "", with_content: bool = True) -> DataFrame:
    """files(corpus_id, path, content, size_bytes, modified_at); missing targets give no rows, nor do unreadable files.

    Paths are relative to ``root`` when given.  The extension filter acts on the listing, so other files are not opened;
    without content none is.  ``skipped_files`` has what could not be read, ``scan_once`` gives both.
    """
    if with_content:
        return read_files(spark, targets, extensions, root, corpus_id).filter("error is null").drop("error")
    rows = spark.createDataFrame([], "corpus_id string, path string, size_bytes long, modified_at timestamp")
    for _, files in _files(spark, targets, extensions, root):
        rows = rows.union(files.filter("error is null").select(F.lit(corpus_id), "path", "size_bytes", "modified_at"))
    return rows


def skipped_files(spark: SparkSession, targets: list[str], extensions: list[str] | None = None,
                  root: str | None = None) -> DataFrame:
    """path and error of every target, folder and file that a scan of the same targets leaves out."""
    return read_files(spark, targets, extensions, root).filter("error is not null").select("path", "error")
