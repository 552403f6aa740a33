"""The corpus scan on file names, links, folders and targets as they come."""

import os
import re

import pytest

from corpusforge.sources import corpus
from corpusforge.sources.corpus import Glob, scan_corpus, scan_once, skipped_files
from corpusforge.sources.stores import Store, open_target

NAMES = ["my file.py", "über.py", "a#b.py", "a", "a%20b", "a?b", "x[1].py", "x1.py", "q'\"uote.py", "back\\slash.py", "new\nline.py", "colon:name.py",
         "*.py", "__init__.py", "_private.py", ".dotted.py", "日本.py", "sub dir/in ner.py", "sub#dir/x.py", "sub%2Fdir/y.py", "trailing .py", "~.py"]


@pytest.fixture
def tree(tmp_path):
    for name in NAMES:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"content of {name}")
    return tmp_path


def found(spark, targets, **options):
    return {r.path: r.content for r in scan_corpus(spark, targets, **options).collect()}


def test_ordinary_and_odd_names(spark, tree):
    rows = found(spark, [str(tree)], root=str(tree))
    assert rows == {name: f"content of {name}" for name in NAMES}
    assert skipped_files(spark, [str(tree)]).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_each_name_as_a_target(tree, name):
    store, path = open_target(_session(), f"{tree}/{name}")
    assert store.stat(path).size == len(f"content of {name}".encode()) and store.read(path) == f"content of {name}".encode()


def _session():
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession()


def test_targets_are_names_first_and_globs_second(spark, tree):
    targets = [f"{tree}/{n}" for n in ("x[1].py", "a?b", "*.py", "file none", "sub dir")]
    assert set(found(spark, targets, root=str(tree))) == {"x[1].py", "a?b", "*.py", "sub dir/in ner.py"}
    assert set(found(spark, [f"{tree}/x[12].py", f"{tree}/sub[#%]*/*"], root=str(tree))) == {"x1.py", "sub#dir/x.py", "sub%2Fdir/y.py"}
    assert {(r.path, r.error) for r in skipped_files(spark, targets, root=str(tree)).collect()} == {("file none", "not found")}


def test_names_that_are_no_utf8(spark, tmp_path):
    for name in (b"caf\xe9.py", b"caf\xff.py"):
        with open(os.path.join(os.fsencode(str(tmp_path)), name), "w") as out:
            out.write(repr(name))
    rows = found(spark, [str(tmp_path)], root=str(tmp_path))
    assert sorted(rows.values()) == [repr(b"caf\xe9.py"), repr(b"caf\xff.py")] and len(rows) == 2


def test_links_and_loops(spark, tmp_path):
    (tmp_path / "real/deep").mkdir(parents=True)
    (tmp_path / "real/deep/f.py").write_text("f")
    (tmp_path / "real/deep/up").symlink_to(tmp_path)
    (tmp_path / "side").symlink_to(tmp_path / "real")
    (tmp_path / "one.py").symlink_to(tmp_path / "real/deep/f.py")
    (tmp_path / "gone.py").symlink_to(tmp_path / "nowhere")
    (tmp_path / "ring.py").symlink_to(tmp_path / "ring.py")
    root = str(tmp_path)
    files, skipped = scan_once(spark, [root], root=root)
    assert {r.path for r in files.collect()} == {"real/deep/f.py", "one.py"}
    assert {r.path for r in skipped.collect()} == {"gone.py", "ring.py"}
    assert set(found(spark, [f"{root}/side"], root=root)) == {"side/deep/f.py"}
    assert set(found(spark, [f"{root}/*/deep/*.py"], root=root)) == {"real/deep/f.py", "side/deep/f.py"}
    assert set(found(spark, [f"{root}/**/*.py"], root=root)) == {"real/deep/f.py", "one.py"}


def test_many_rounds_give_the_same_files(spark, tmp_path, monkeypatch):
    names = {f"d{i % 3}/e{i % 5}/" + "deep/" * (i % 7) + f"f{i}.txt" for i in range(60)}
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    monkeypatch.setattr(corpus, "FIRST_SHARE", 2)
    monkeypatch.setattr(corpus, "SHARE", 5)
    monkeypatch.setattr(corpus, "BATCH_BYTES", 40)
    rows = found(spark, [str(tmp_path), f"{tmp_path}/d1/*/*.txt", f"{tmp_path}/d2"], root=str(tmp_path))
    assert rows == {name: name for name in names}


def test_errors_are_rows(spark, tree, monkeypatch):
    """Folders that can't be listed and files that can't be read, or not in a row, are left out by name."""
    from pyspark.sql import functions as F
    closed = Store("file").entries(os.fsencode(tree / "a"))  # a file is no folder
    assert [(f.folder, f.error.split(":")[0]) for f in closed] == [(True, "NotADirectoryError")]
    monkeypatch.setattr(corpus, "MAX_FILE_BYTES", 20)
    files, skipped = scan_once(spark, [str(tree)], ["py"], root=str(tree))
    small = {n for n in NAMES if n.endswith(".py") and len(f"content of {n}".encode()) <= 20}
    assert {r.path for r in files.collect()} == small - {".dotted.py"} | ({".dotted.py"} & small)
    assert {r.error for r in skipped.select(F.col("error")).collect()} == {"larger than 20 bytes"}


def test_no_targets(spark):
    assert scan_corpus(spark, []).count() == 0 and skipped_files(spark, []).count() == 0


@pytest.mark.parametrize("pattern,path,matches", [
    ("/a/*.py", "/a/x.py", True), ("/a/*.py", "/a/.x.py", False), ("/a/*.py", "/a/b/x.py", False), ("/a/**/x.py", "/a/x.py", True),
    ("/a/**/x.py", "/a/b/c/x.py", True), ("/a/**/x.py", "/a/.b/x.py", False), ("/a/**", "/a/b/c", True), ("/a/[!b]x", "/a/cx", True),
    ("/a/[!b]x", "/a/bx", False), ("/a/[^b]x", "/a/^x", True), ("/a/[]x]y", "/a/]y", True), ("/a/b.c[0-9]", "/a/bxc1", False),
    ("/a/*/c/**/d?", "/a/b/c/d1", True), ("/a/*/c/**/d?", "/a/c/d1", False)])
def test_globs(pattern, path, matches):
    glob = Glob(pattern.encode())
    assert glob.matches(path.encode()) == matches
    if matches:
        above = path.rsplit("/", 1)[0]
        assert above == glob.root.decode() or glob.leads_on(above.encode())


def test_object_store_targets(spark):
    """No path becomes a URI; Hadoop's settings open the client, those of the bucket first."""
    conf = spark._jsc.hadoopConfiguration()
    for key, value in {"fs.s3a.access.key": "k", "fs.s3a.bucket.b.access.key": "own", "fs.s3a.endpoint": "store:9000",
                       "fs.s3a.connection.ssl.enabled": "false"}.items():
        conf.set(key, value)
    store, path = open_target(spark, "s3a://b/x y/#1%20?.py")
    assert path == b"/x y/#1%20?.py" and store._name(path) == "b/x y/#1%20?.py" and store._own("b/x y/#1%20?.py") == path
    assert dict(store.options) == {"access_key": "own", "endpoint_override": "store:9000", "scheme": "http"}
    assert open_target(spark, "hdfs://host:8020/a b")[0] == Store("hdfs", "host:8020")
    assert open_target(spark, "file:///a b#c") == (Store("file"), b"/a b#c") == open_target(spark, "/a b#c")
    assert re.match("/.*/rel:x", open_target(spark, "rel:x")[1].decode())
    for key in ("fs.s3a.access.key", "fs.s3a.bucket.b.access.key", "fs.s3a.endpoint"):
        conf.unset(key)
    conf.set("fs.s3a.connection.ssl.enabled", "true")
