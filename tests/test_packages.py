"""Sources, filters, archives, extraction and cache."""

import json

import pytest
from pyspark.sql import functions as F

from corpusforge import fixed_values as fv
from corpusforge.functions import paths
from corpusforge.operators import audit, cache, filters, reduce, semantic
from corpusforge.plans.pack import pack
from corpusforge.sources import archives
from corpusforge.sources.corpus import scan_corpus, skipped_files


def test_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in {"a.py": b"x = 1\n", "b.TXT": b"caf\xc3\xa9 \xff!", ".hidden.py": b"", "sub/c.md": b"# c", "sub/d.py": b"d"}.items():
        (tmp_path / name).write_bytes(data)
    root = str(tmp_path)
    rows = {r.path: (r.content, r.size_bytes) for r in scan_corpus(spark, [root, f"{root}/sub/*.md", f"{root}/none"], root=root).collect()}
    assert rows["b.TXT"] == ("café !", 8) and rows["sub/c.md"] == ("# c", 3)
    assert set(rows) == {"a.py", "b.TXT", ".hidden.py", "sub/c.md", "sub/d.py"}
    only = scan_corpus(spark, [f"{root}/a.py", f"{root}/sub"], ["py"], root, with_content=False)
    assert sorted(r.path for r in only.collect()) == ["a.py", "sub/d.py"] and "content" not in only.columns
    assert scan_corpus(spark, [f"{root}/none"]).count() == 0


def test_scan_leaves_nothing_out(spark, tmp_path):
    names = ["src/top.py", "src/pkg/__init__.py", "src/pkg/_priv.py", "src/pkg/mod.py", "src/pkg/deep/d.py", "src/pkg/deep/er/e.py",
             "src/.hid/h.py", "src/.dot.py", "src/pkg/deep/x.md"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "src/broken.py").symlink_to(tmp_path / "nowhere")
    root = str(tmp_path)

    def found(*targets, **options):
        return sorted(r.path for r in scan_corpus(spark, [f"{root}/{t}" for t in targets], root=root, **options).collect())
    assert found("src") == sorted(names)
    assert found("src/**/*.py") == sorted(n for n in names if n.endswith(".py") and "/." not in n)
    assert found("src/*") == ["src/top.py"] and found("src/pkg/?od.py", "src/pkg/mod.py") == ["src/pkg/mod.py"]
    assert found("src", extensions=["md"], with_content=False) == ["src/pkg/deep/x.md"]
    assert {r.path for r in skipped_files(spark, [f"{root}/src"], root=root).collect()} <= {"src/broken.py"}


def test_extensions_and_wildcards(corpus):
    assert paths.normalise_extensions(["py,MD", ".Js  txt", ""]) == [".js", ".md", ".py", ".txt"]
    files = corpus(("src/a.py", ""), ("src/.bashrc", ""), ("b.tar.GZ", ""), ("Makefile", ""), ("t/test_x.js", ""), ("x[1].py", ""))
    types = {r.path: r.t for r in files.select("path", paths.file_type(F.col("path")).alias("t")).collect()}
    assert types == {"src/a.py": "python", "src/.bashrc": "text", "b.tar.GZ": "text", "Makefile": "makefile", "t/test_x.js": "javascript", "x[1].py": "python"}

    def named(df):
        return sorted(r.path for r in df.collect())
    assert named(filters.by_extension(files, ["gz"])) == ["b.tar.GZ"]
    assert named(filters.by_wildcard(files, "test_*")) == ["t/test_x.js"]
    assert named(filters.by_wildcard(files, "src*")) == ["src/.bashrc", "src/a.py"]
    assert named(filters.by_wildcard(files, "x[[]1].p?")) == ["x[1].py"]
    assert len(named(filters.by_wildcard(files, ""))) == 6


@pytest.mark.parametrize("path,safe", [("a/b.txt", "a/b.txt"), ("/etc/passwd", "etc/passwd"), ("../x", None), ("a/../../x", None),
                                       ("a/./b//c", "a/b/c"), ("a/../b", "b"), ("..x/y", "..x/y"), ("a/..", None), ("//a", "a")])
def test_safe_paths(spark, path, safe):
    df = spark.createDataFrame([(path,)], "path string")
    assert df.select(archives.safe_path(F.col("path"))).first()[0] == safe


def test_extract(spark, tmp_path):
    rows = [("z", "a/x.txt", "one é"), ("z", "", "none"), ("z", "../evil.txt", "no"), ("z", "b.md", "skip")]
    plan = archives.extract_plan(spark.createDataFrame(rows, "archive_id string, path string, content string"), r"txt$")
    assert [r.action for r in plan.collect()] == ["write", "skip_empty", "skip_unsafe", "skip_pattern"]
    archives.extract_files(plan, str(tmp_path / "out"))
    assert (tmp_path / "out/a/x.txt").read_text(encoding="utf-8") == "one é"
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.*")) == ["out/a/x.txt"]


def test_archives_are_extracted_apart(spark, tmp_path):
    rows = [("one", "x.txt", "1"), ("two", "x.txt", "2")]
    rows += [("a/b", "x.txt", "3"), ("a_b", "x.txt", "4"), ("..", "x.txt", "5"), (None, "x.txt", "6"), ("", "x.txt", "7"), ("a%2Fb", "x.txt", "8"),
             ("one", "y.txt", "first"), ("one", "./y.txt", "zz"), ("one", "y.txt", "second")]
    plan = archives.extract_plan(spark.createDataFrame(rows, "archive_id string, path string, content string"))
    archives.extract_files(plan, str(tmp_path), apart=True)
    assert {str(p.relative_to(tmp_path)): p.read_text() for p in tmp_path.rglob("*.txt")} == {
        "one/x.txt": "1", "two/x.txt": "2", "a%2Fb/x.txt": "3", "a_b/x.txt": "4", "%2E%2E/x.txt": "5", "%N/x.txt": "6", "%/x.txt": "7",
        "a%252Fb/x.txt": "8", "one/y.txt": "second"}
    with pytest.raises(ValueError):
        archives.extract_files(plan, str(tmp_path / "together"))


def test_pack_write_read(spark, corpus, tmp_path):
    files = corpus(("README.md", "# t\n\n\n\nx\n"), ("src/a.py", "def f(a):\n    return a\n"), ("t.bin", "zz"))
    entries, meta = pack(files, "aggressive", ["md", "py"], created="2024-01-01T00:00:00Z")
    for volume_bytes in (1 << 20, 1):
        documents = archives.archive_documents(entries, meta, volume_bytes, slices=2)
        back, meta_back = archives.parse_documents(documents)
        assert sorted(map(tuple, back.select(*entries.columns).collect())) == sorted(map(tuple, entries.collect()))
        assert [r.total_files for r in meta_back.collect()] == [2]
    document = json.loads(archives.archive_documents(entries, meta).first().document)
    assert list(document) == ["metadata", "files"] and document["metadata"][fv.VERSION_KEY] == fv.FORMAT_VERSION
    assert [f["path"] for f in document["files"]] == ["README.md", "src/a.py"]
    archives.write_archives(entries, meta, str(tmp_path / "native"))
    assert spark.read.parquet(str(tmp_path / "native/archive_files")).count() == 2


def test_reading_indented_archives(spark, tmp_path):
    document = {"metadata": {fv.VERSION_KEY: "4", "archive_uuid": "u"}, "files": [
        {"path": "notes/rivers.md", "content": "Elbe\nOder\n", "original_size_bytes": 10, "compressed_size_bytes": 10,
         "estimated_tokens": 3, "compression_method": "light", "compression_ratio": 1.0, "importance_score": 4, "last_modified_utc": None}]}
    (tmp_path / "one.json").write_text(json.dumps(document, indent=2))
    (tmp_path / "two.json").write_text("<rivers/>")
    documents = archives.read_documents(spark, str(tmp_path))
    entries, _ = archives.parse_documents(documents)
    assert [(r.path, r.content) for r in entries.collect()] == [("notes/rivers.md", "Elbe\nOder\n")]
    assert [r.violation for r in audit.audit_archives(documents).collect()] == ["bad json"]
    with pytest.raises(Exception):
        archives.read_documents(spark, str(tmp_path / "missing")).count()


def test_archive_audit(spark):
    texts = {"a": '{"metadata": {}, "files": [{"x": 1}, 3]}', "b": "[]", "c": json.dumps({"metadata": {fv.VERSION_KEY: "1"}, "files": []})}
    rows = audit.audit_archives(spark.createDataFrame(list(texts.items()), "archive_id string, document string")).collect()
    found = [(r.archive_id, r.entry, r.violation, r.is_first) for r in rows]
    assert found[0] == ("a", 0, "missing format version", True)
    assert [f[1:3] for f in found if f[0] == "a"][1:] == [(1, f"missing {k}") for k in fv.REQUIRED_ENTRY_KEYS] + [(2, "entry not an object")]
    assert [f for f in found if f[0] != "a"] == [("b", 0, "missing metadata or files", True)]


def test_archive_files_do_not_grow_with_the_number_of_archives(spark, tmp_path):
    rows = [(f"archive {i % 300}/é", f"f{i}.txt", "t", 1, 1, 1, "none", 1.0, 0, None) for i in range(900)]
    entries = spark.createDataFrame(rows, f"archive_id string, {archives.ENTRY}")
    archives.write_archives(entries, archives.archive_metadata(entries, "none"), str(tmp_path / "native"), files=4)
    assert len(list((tmp_path / "native/archive_files").glob("*.parquet"))) <= 4
    back, meta = archives.read_archives(spark, str(tmp_path / "native"))
    assert sorted(map(tuple, back.collect())) == sorted(rows) and meta.count() == 300
    one = back.filter("archive_id = 'archive 7/é'")
    assert one.count() == 3 and "PushedFilters: [IsNotNull(archive_id), EqualTo(archive_id" in one._jdf.queryExecution().executedPlan().toString()


def test_cache_updates_touch_their_buckets_only(spark, corpus, tmp_path):
    folder = str(tmp_path / "cache")

    def results(*texts, method="m"):
        keyed = cache.fingerprinted(corpus(*[(f"{i}.txt", t) for i, t in enumerate(texts)]), "light").select(*cache.KEY)
        return keyed.selectExpr("*", "'r' as reduced", f"'{method}' as method", "1L as reduced_size", "2L as tokens")

    def files():
        return {str(p.relative_to(tmp_path)) for p in (tmp_path / "cache").rglob("*.parquet")}

    first = cache.update_cache(results(*[f"text {i}" for i in range(60)]), folder, digits=1)
    assert 10 < len(first) <= 16 and cache.read_cache(spark, folder).count() == 60
    before = files()
    touched = cache.update_cache(results("text 3", "text 3", "fresh", method="new"), folder, digits=1)
    kept = {f for f in before if f.split("bucket=")[1][0] not in touched}
    assert 1 <= len(touched) <= 2 and kept and kept == files() & before
    rows = cache.read_cache(spark, folder).collect()
    assert len(rows) == 61 and sorted(r.method for r in rows if r.method == "new") == ["new", "new"]
    assert cache.lookup_cached(cache.fingerprinted(corpus(("a.txt", "text 5"), ("b.txt", "none")), "light"), cache.read_cache(spark, folder)).filter("cached").count() == 1


def test_audit_of_documents_larger_than_a_variant(spark, monkeypatch):
    """The same findings whether a document is parsed as a whole or cut into its entries first."""
    good = {k: "x" for k in fv.REQUIRED_ENTRY_KEYS}
    meta = {fv.VERSION_KEY: "4"}
    documents = {"ok": {"metadata": meta, "files": [good, good]}, "flawed": {"metadata": meta, "files": [good, {"path": "a"}, 1, "text", [good]]},
                 "no list": {"metadata": meta, "files": {"a": 1}}, "no version": {"metadata": {}, "files": []}, "no files": {"metadata": meta},
                 "array": [good], "text": "text", "empty": {}}
    rows = [(k, json.dumps(v)) for k, v in documents.items()] + [("broken", '{"metadata": {"a": 1}, "files": [{"x": '), ("prose", "prose"), ("null", None)]
    df = spark.createDataFrame(rows, "archive_id string, document string")

    def found():
        return sorted((r.archive_id, r.entry, r.violation, r.is_first) for r in audit.audit_archives(df).collect())
    small = found()
    monkeypatch.setattr(audit, "LARGE", 1)
    large = found()
    # Cut into entries, a list that is none, or a value that is no object, is told apart less finely.
    coarse = {"no list", "array", "text"}
    assert [f for f in small if f[0] not in coarse] == [f for f in large if f[0] not in coarse]
    assert {f[0] for f in small} == {f[0] for f in large} and not any(f[0] == "ok" for f in small)


def test_long_entries_survive_the_round_trip(spark):
    """An entry of more than 20 million characters is read back and audited."""
    entries = spark.range(1).selectExpr("'big' as archive_id", "'a.txt' as path", "repeat('long \\n text ', 2000000) as content").selectExpr(
        "*", "octet_length(content) as original_size_bytes", "octet_length(content) as compressed_size_bytes", "1L as estimated_tokens",
        "'none' as compression_method", "1.0D as compression_ratio", "0 as importance_score", "cast(null as string) as last_modified_utc")
    documents = archives.archive_documents(entries, archives.archive_metadata(entries, "none", created="2024-01-01T00:00:00Z"), slices=1)
    back, _ = archives.parse_documents(documents)
    want = entries.select(F.length("content"), F.sha2("content", 256)).first()
    assert tuple(back.select(F.length("content"), F.sha2("content", 256)).first()) == tuple(want) and want[0] > 20_000_000
    assert audit.audit_archives(documents).count() == 0


def test_audits_do_not_depend_on_the_size_of_a_document(spark):
    """20 million blanks in front of a document change no finding, whatever its shape."""
    good, meta = {k: "x" for k in fv.REQUIRED_ENTRY_KEYS}, {fv.VERSION_KEY: "4"}
    values = [{"metadata": meta, "files": [good, {"path": "a"}, 1, "text", [good], None, json.dumps(good)]}, {"metadata": meta, "files": {"a": 1}},
              {"metadata": json.dumps(meta), "files": "[]"}, {"metadata": None, "files": None}, {"files": [{}]}, [good], "text", 12.5, None, {}]
    texts = [json.dumps(v) for v in values] + [
        "{'metadata': {'%s': 1}, 'files': []}" % fv.VERSION_KEY, '{"metadata": {"a": NaN}, "files": []}', '{"metadata": {}, "files": []} tail', "prose",
        '{"metadata": {"%s": 1}, "files": [], "files": 1}' % fv.VERSION_KEY, '{"metadata": {"a": 01}, "files": []}', '{"files": [{"x": ', "1 2", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "archive_id int, document string").repartition(4)

    def found(rows):
        return sorted((r.archive_id, r.entry, r.violation, r.is_first) for r in audit.audit_archives(rows).collect())

    small = found(df)
    assert found(df.withColumn("document", F.concat(F.repeat(F.lit(" "), F.lit(20_000_000)), F.col("document")))) == small
    assert [f for f in small if f[0] < 10 and f[1:3] not in [(2, f"missing {k}") for k in fv.REQUIRED_ENTRY_KEYS]] == [
        (0, 3, "entry not an object", False), (0, 4, "entry not an object", False), (0, 5, "entry not an object", False),
        (0, 6, "entry not an object", False), (0, 7, "entry not an object", False), (1, 0, "files not a list", True),
        (2, 0, "files not a list", False), (2, 0, "missing format version", True), (3, 0, "files not a list", False), (3, 0, "missing format version", True),
        (4, 0, "missing metadata or files", True), *[(4, 1, v, False) for v in sorted(f"missing {k}" for k in fv.REQUIRED_ENTRY_KEYS)],
        *[(i, 0, "missing metadata or files", True) for i in range(5, 10)]]
    assert [f[::2] for f in small if f[0] >= 10] == [(i, "bad json") for i in (10, 11, 12, 13, 15, 16, 17, 18)]


def test_audits_read_strings_names_and_numbers_of_any_length(spark):
    """Nothing long makes a document bad, nor hides what is broken behind it."""
    head, word = '{"metadata": {"%s": ' % fv.VERSION_KEY, r'long \\ \"text\" \u00e9 '
    middles = {"name": ('1, "', "n", 60_000, '": 1'), "string": ('"', word, 1_000_000, '"'), "number": ("", "7", 2_000, ""), "zeros": ("0.", "0", 2_000, "1"),
               "bad escape": ('"', word, 1_000_000, r'\q"'), "line feed": ('"', "x", 2_000, '\n"'), "open": ('"', "x", 2_000, r'\"'),
               "leading zeros": ("", "0", 2_000, ""), "two points": ("1.", "5", 2_000, ".5"), "sign": ("1", "2", 2_000, "-3")}
    df = spark.createDataFrame([(k, *v) for k, v in middles.items()], "archive_id string, a string, b string, n int, c string").repartition(4)
    documents = df.select("archive_id", F.expr("repeat(b, n)").alias("b"), "a", "c").select(
        "archive_id", F.concat(F.lit(head), "a", "b", "c", F.lit('}, "files": []}')).alias("document"))
    assert {r.archive_id: r.violation for r in audit.audit_archives(documents).collect()} == {
        k: "bad json" for k in ("bad escape", "line feed", "open", "leading zeros", "two points", "sign")}


def test_budgeted_pack(spark, corpus):
    files = corpus(*[(f"src/f{i}.txt", "word " * 50) for i in range(6)], ("README.md", "read me\n"), ("tests/test_a.txt", "t"))
    entries, meta = pack(files, "light", max_tokens=300)
    kept = {r.path for r in entries.collect()}
    assert "README.md" in kept and "tests/test_a.txt" not in kept
    assert meta.first().total_estimated_tokens <= 300


def test_cache(spark, corpus):
    files = corpus(*[(f"d/{i}.txt", "same  \n") for i in range(30)], ("a.py", "same  \n"), ("b.txt", "other"))
    keyed = cache.fingerprinted(files, "light")
    reduced = reduce.reduce_corpus(corpus(("d/0.txt", "same  \n")), "light")
    stored = reduced.join(cache.fingerprinted(files, "light").drop("file_type", "level"), ["corpus_id", "path"]).select(*cache.KEY, *cache.RESULT)
    found = cache.lookup_cached(keyed, stored, hot_rows=5).collect()
    assert len(found) == 32 and sum(r.cached for r in found) == 30
    assert {r.method for r in found if r.cached} == {"light (whitespace norm.) (cached)"}
    assert cache.misses(keyed, stored).count() == 2
    again = cache.upsert(stored, stored.withColumn("method", F.lit("new")))
    assert [r.method for r in again.collect()] == ["new"]
    rows = {r.path: (r.reduced, r.tokens, r.method) for r in cache.reduce_distinct(files, "light", hot_rows=5).collect()}
    alone = {r.path: (r.reduced, r.tokens, r.method) for r in reduce.reduce_corpus(files, "light").collect()}
    assert rows == alone


def test_a_value_with_text_behind_it_is_no_json(spark):
    """The variant parser stops behind the first value; a number, a list or an object with prose behind it is no document."""
    whole = '{"metadata": {"%s": "4"}, "files": []}' % fv.VERSION_KEY
    texts = ["8294846167456848 Inly onhe.", "[1] [2]", "{} x", whole + " tail", '1,"x"] y', "", "1, 2"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(100, whole), (101, f" {whole}\n")], "archive_id long, document string")
    found = {r.archive_id: r.violation for r in audit.audit_archives(rows).collect()}
    assert found == {i: "bad json" for i in range(len(texts))}
    answers = spark.createDataFrame([("c", "a.py", "python", '{"file_path": "a"} done'), ("c", "b.py", "python", '{"file_path": "a"}')],
                                    "corpus_id string, path string, file_type string, raw_text string")
    assert {r.path: r.record is not None for r in semantic.parse_responses(answers).select("path", "record").collect()} == {"a.py": False, "b.py": True}
