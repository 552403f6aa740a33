"""One query per operator over the given tables.  Text results are shown as hashes and measures."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.checks import corpora as c
from corpusforge.functions import paths, text, tokens
from corpusforge.operators import (
    audit, budget, cache, calllog, compare, edits, filters, reduce, semantic, signatures, stats, structure,
)
from corpusforge.session import new_folder, stored
from corpusforge.sources import archives, corpus, edit_scripts

K = ["corpus_id", "path"]
BUDGET = 20000
WILDCARD, REGEX = "*/src1/*_[0-9]*.[jp]*", r"src[13]/.*\.(?:py|md)$"
CREATED = "2024-01-01T00:00:00Z"

# Fixed expressions of the call log, the responses and the scripts, read by both engines.
CALLS = {"caller": "user_id", "call_id": "event_id", "ts": "ts",
         "status_code": "case when event_type = 'error' then case event_id % 3 when 0 then 429 when 1 then 503 else 400 end else 200 end",
         "duration_s": "value / 100e0", "waited_s": "case when event_type = 'view' then value / 50e0 else 0e0 end"}
_DOC_JSON = ("concat('{\"file_path\": \"', doc_id, '\", \"overall_purpose\": \"', lang, ' ', source, '\"', "
             "case when doc_id % 5 = 0 then '' else ', \"key_components\": {\"classes\": [], \"configuration\": [\"a\", 1.5, {}]}' end, "
             "case when doc_id % 11 = 0 then '' else '}' end)")
RESPONSES = {**c.DOCS, "model": "'m1'", "raw_text": (
    f"case doc_id % 6 when 0 then {_DOC_JSON} when 1 then concat('```json', chr(10), {_DOC_JSON}, chr(10), '```') "
    f"when 2 then concat('```', chr(10), {_DOC_JSON}, chr(10), '```') when 3 then concat('Here: ', {_DOC_JSON}, ' done.') "
    "when 4 then 'no object here' else concat('[', doc_id, ']') end")}
ENVELOPES = {"corpus_id": c.DOCS["corpus_id"], "path": c.DOCS["path"], "text": (
    "case doc_id % 4 when 0 then text when 1 then concat('# SEMANTIC COMPRESSION v1.0', chr(10), text) else "
    "concat('# SEMANTIC COMPRESSION v1.0', chr(10), '# Original: ', doc_id, chr(10), '{\"purpose\": 1}', chr(10), text, "
    "chr(10), '# END SEMANTIC COMPRESSION', case when doc_id % 4 = 2 then concat(chr(10), 'tail') else '' end) end")}
MESSY = {"corpus_id": "concat('repo_', doc_id % 7)", "path": (
    "case doc_id % 8 when 0 then concat('./', lang, '//', doc_id, '.py') when 1 then concat('/', lang, '/../', doc_id) "
    "when 2 then concat('../', lang, '/./../../', doc_id) when 3 then concat('//', lang, '/', doc_id, '/') "
    "when 4 then concat(lang, '/..') when 5 then concat('/../', lang, '/a/b/../c') when 6 then '' "
    "else concat('///', lang, '/../../', doc_id, '/.') end"), "content": "text"}
SCRIPTS = {"script_id": "doc_id", "script": (
    "case when doc_id % 10 = 0 then '' when doc_id % 10 = 1 then text else concat("
    "case when doc_id % 10 = 2 then concat('FIND_METHOD: lost', chr(10)) else '' end, 'FILE: ', lang, '/a.py', chr(10), "
    "case when doc_id % 10 = 3 then concat('SECTION: INI_SECTION', chr(10)) when doc_id % 10 = 4 then concat('SECTION: GLOBAL_PREAMBLE', chr(10)) else '' end, "
    "'noise', chr(10), 'FIND_METHOD: def a', chr(10), '  FIND_METHOD:  def b(x: int) ', chr(10), "
    "case when doc_id % 10 = 5 then '' else concat('UNTIL_EXCLUDE: def c', chr(10)) end, "
    "'REPLACE_WITH: ignored', chr(10), text, chr(10), 'UNTIL_EXCLUDE: part of the body', chr(10), chr(10), "
    "case when doc_id % 10 = 6 then concat(' FILE:', chr(10)) else '' end, 'FILE: b.py', chr(10), "
    "case when doc_id % 10 = 7 then 'REPLACE_WITH:' else 'SECTION: METHOD' end) end")}
DOCUMENTS = {"archive_id": "doc_id", "document": (
    "case doc_id % 9 when 0 then text when 1 then '{}' when 2 then '{\"metadata\": {}, \"files\": []}' "
    "when 3 then '{\"metadata\": {\"VERSION_KEY\": \"4\"}, \"files\": {}}' "
    "when 4 then '{\"metadata\": {\"VERSION_KEY\": \"4\"}, \"files\": [1, {\"path\": \"a\"}]}' "
    "when 5 then '[1]' when 6 then '{\"metadata\": {\"VERSION_KEY\": \"4\"}, \"files\": []}' "
    "else concat('{\"metadata\": {\"VERSION_KEY\": \"4\"}, \"files\": [{\"path\": \"', doc_id, '\", \"content\": null, "
    "\"original_size_bytes\": 1, \"compressed_size_bytes\": ', n_chars, ', \"estimated_tokens\": 1', "
    "case when doc_id % 2 = 0 then ', \"compression_method\": \"none\"' else '' end, '}]}') end"
).replace("VERSION_KEY", archives.fv.VERSION_KEY)}


def _sha(column):
    return F.sha2(column, 256)


def _shown(reduced: DataFrame) -> DataFrame:
    return reduced.select(*K, "file_type", "method", _sha(F.col("reduced")).alias("reduced_sha"), "original_size",
                          "reduced_size", "tokens", "ratio")


def _table(spark, sf, name, columns):
    return c.table(spark, sf, name).selectExpr(*[f"{e} as {n}" for n, e in columns.items()])


def _calls(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").selectExpr(*[f"{e} as {n}" for n, e in CALLS.items()])


def _prose(spark, sf):
    return c.docs(spark, sf).unionByName(c.sites(spark, sf))


def _level(name, source=_prose):
    return lambda spark, sf: _shown(reduce.reduce_corpus(source(spark, sf), name))


def _signature_query(*names):
    def run(spark, sf):
        source = c.docs(spark, sf)
        for name in names:
            source = source.unionByName(c.twin(spark, sf, name))
        kind = paths.file_type(F.col("path"))
        return (source.withColumn("file_type", kind)
                .withColumn("skeleton", signatures.signatures(F.col("content"), F.col("file_type")))
                .filter("skeleton is not null").select(*K, "file_type", _sha(F.col("skeleton")).alias("skeleton_sha"),
                                                       F.length("skeleton").alias("n_chars")))
    return run


def regex_generic(spark, sf):
    rows = c.files(spark, sf).withColumn("file_type", paths.file_type(F.col("path"))).filter("file_type <> 'python'")
    return rows.select(*K, "file_type", _sha(reduce.regex_medium(F.col("content"), F.col("file_type"))).alias("reduced_sha"))


def summary(spark, sf):
    """Totals by level and file type over every corpus: the flagship."""
    return stats.compression_summary(reduce.reduce_levels(c.files(spark, sf), ["none", "light", "medium", "aggressive"]))


def dedupe(spark, sf):
    rows = cache.reduce_distinct(_prose(spark, sf), "medium", hot_rows=5)
    return rows.select(*K, "content_sha256", "file_type", "method", _sha(F.col("reduced")).alias("reduced_sha"), "tokens")


def scan(spark, sf):
    """Write the documents as files through the extraction sink, then scan the folder twice (folder and glob)."""
    folder = new_folder(spark, "scan")
    entries = c.docs(spark, sf).withColumnRenamed("corpus_id", "archive_id")
    archives.extract_files(archives.extract_plan(entries), folder, apart=True)
    found = corpus.scan_corpus(spark, [folder, f"{folder}/repo_1/repo_1/*/*/*/*", f"{folder}/none"], ["py,md", ".TXT"], folder)
    return found.select("path", "size_bytes", _sha(F.col("content")).alias("content_sha"))


def scan_binary(spark, sf):
    """Every document as bytes with stray ones in some places, and genuine replacement characters, decoded again."""
    raw = F.expr("""concat(case when doc_id % 3 = 0 then X'FF' else X'' end, encode(text, 'UTF-8'),
                           case when doc_id % 2 = 0 then X'EFBFBD' else X'' end, case when doc_id % 5 = 0 then X'C3' else X'' end)""")
    decoded = text.decode_utf8(raw)
    return c.table(spark, sf, "documents").select("doc_id", _sha(decoded).alias("text_sha"), F.length(decoded).cast("long").alias("n_decoded"))


def estimated(spark, sf):
    rows = c.files(spark, sf).withColumn("file_type", paths.file_type(F.col("path")))
    return tokens.add_tokens(rows, "content").select(*K, "file_type", "tokens")


def cleaned(spark, sf):
    rows = c.files(spark, sf).withColumn("file_type", paths.file_type(F.col("path")))
    clean = tokens.clean(F.col("content"), F.col("file_type"))
    return rows.select(*K, _sha(clean).alias("clean_sha"), F.length(clean).alias("n_chars"))


def _cached(spark, sf):
    """A cache holding the documents whose source is src1 to src3, reduced at the light level."""
    known = c.table(spark, sf, "documents").filter("source in ('src1', 'src2', 'src3')").selectExpr(
        *[f"{e} as {n}" for n, e in c.DOCS.items()])
    rows = reduce.reduce_corpus(known, "light").join(cache.fingerprinted(known, "light").drop("file_type", "level"), K)
    return rows.select(*cache.KEY, *cache.RESULT).dropDuplicates(cache.KEY)


def cache_lookup(spark, sf):
    keyed = cache.fingerprinted(c.docs(spark, sf), "light")
    rows = cache.lookup_cached(keyed, _cached(spark, sf), hot_rows=5)
    return rows.select(*K, "content_sha256", "file_type", "cached", "method", _sha(F.col("reduced")).alias("reduced_sha"))


def cache_upsert(spark, sf):
    fresh = c.table(spark, sf, "documents").filter("source in ('src3', 'src4')").selectExpr(
        *[f"{e} as {n}" for n, e in c.DOCS.items()])
    results = (cache.fingerprinted(fresh, "light").select(*cache.KEY).distinct()
               .select("*", F.lit("").alias("reduced"), F.lit("forced").alias("method"),
                       F.lit(0).cast("bigint").alias("reduced_size"), F.lit(0).cast("bigint").alias("tokens")))
    return cache.upsert(_cached(spark, sf), results).select(
        "content_sha256", "file_type", "level", "model", "method", "reduced_size", "tokens")


def cache_hit_stats(spark, sf):
    keyed = cache.fingerprinted(c.docs(spark, sf), "light")
    return stats.cache_stats(cache.lookup_cached(keyed, _cached(spark, sf)))


def _entries(spark, sf):
    return archives.archive_entries(reduce.reduce_corpus(_prose(spark, sf), "light"))


def _packed(spark, sf):
    """Entries as a stored table, as a packing job leaves them: totals and documents do not reduce again."""
    return stored(_entries(spark, sf), "entries")


def archive_write(spark, sf):
    entries = _packed(spark, sf)
    made = archives.archive_documents(entries, archives.archive_metadata(entries, "light", created=CREATED))
    n = F.size(F.from_json(F.get_json_object("document", "$.files"), "array<struct<path:string>>"))

    def meta(key):
        return F.get_json_object("document", f"$.metadata.{key}").cast("bigint").alias(key)

    return made.select("archive_id", "volume", n.alias("n_entries"), meta("total_files"), meta("total_original_size_bytes"),
                       meta("total_compressed_size_bytes"), meta("total_estimated_tokens"),
                       F.get_json_object("document", "$.files[0].path").alias("first_path"))


def archive_roundtrip(spark, sf):
    entries = _packed(spark, sf)
    made = archives.archive_documents(entries, archives.archive_metadata(entries, "light", created=CREATED),
                                      volume_bytes=200_000, slices=4)
    folder = new_folder(spark, "documents")
    archives.write_documents(made, folder)
    back, _ = archives.parse_documents(archives.read_documents(spark, folder, whole_files=False))
    return back.select("archive_id", "path", "original_size_bytes", "compressed_size_bytes", "estimated_tokens",
                       "compression_method", "compression_ratio", _sha(F.col("content")).alias("content_sha"))


def _plan(spark, sf):
    entries = _table(spark, sf, "documents", MESSY).withColumnRenamed("corpus_id", "archive_id")
    return entries, archives.extract_plan(entries, "e")


def extract_plan(spark, sf):
    return _plan(spark, sf)[1].select("archive_id", "path", "safe_path", "action", _sha(F.col("content")).alias("content_sha"))


def audit_counts(spark, sf):
    entries, plan = _plan(spark, sf)
    return stats.audit_counts(entries, plan, "e")


def listing(spark, sf):
    entries = _packed(spark, sf)
    return filters.list_archive(entries, archives.archive_metadata(entries, "light", created=CREATED), REGEX)


def listing_detailed(spark, sf):
    rows = filters.list_archive_detailed(_entries(spark, sf), REGEX)
    return rows.withColumn("preview_sha", _sha(F.col("preview"))).drop("preview")


def _requested(spark, sf):
    """One path per document id of labels, and as many that do not exist."""
    known = c.table(spark, sf, "documents").join(c.table(spark, sf, "labels").select("doc_id").distinct(), "doc_id")
    rows = known.selectExpr(f"{c.DOCS['corpus_id']} as corpus_id", f"{c.DOCS['path']} as path")
    return rows.unionByName(rows.select("corpus_id", F.concat("path", F.lit(".gone")).alias("path")))


def corpus_stats(spark, sf):
    sizes = c.docs(spark, sf).select("corpus_id", "path", text.utf8_size(F.col("content")).alias("size_bytes"))
    return stats.corpus_stats(_requested(spark, sf), sizes)


def union_targets(spark, sf):
    source = c.docs(spark, sf)
    rows = filters.union_targets(filters.by_extension(source, ["py"]), filters.by_regex(source, "src1"),
                                 filters.by_wildcard(source, "main.*"))
    return rows.select(*K)


def _scripts(spark, sf):
    return _table(spark, sf, "documents", SCRIPTS)


def parsed_scripts(spark, sf):
    rows = edit_scripts.parse_edit_scripts(_scripts(spark, sf))
    return rows.select("script_id", "seq", "file", "section", "find_method", "until_exclude",
                       _sha(F.col("replace_with")).alias("replace_sha"))


def audited_scripts(spark, sf):
    scripts = _scripts(spark, sf)
    return audit.audit_edit_scripts(scripts, edit_scripts.parse_edit_scripts(scripts))


#: Ends of modules that are no Python, each for a reason of its own.
BREAKAGES = ["x = = 1", "x = 1 +", "f() = 3", "print 'x'", "3 apples", "    x = 1", "if x:", "def f(a):\npass", "class A:", "x = [1, (2]", "s = 'open",
             "if x:\n        y = 1\n    z = 2", "a b", "for x in y\n    pass", "x = 'a' b", "total.", "x = 1; y = = 2", "while x: pass; 3 apples",
             "try:\n    a = 1\nexcept E as e:\nb = 2", "f(1) g"]


def python_validity(spark, sf):
    """Every old module as it is (0) and with each breakage at its end: does it parse?"""
    old = c.modules(spark, sf, "old")
    found = structure.parses_with(old, ["", *BREAKAGES])
    return found.select(*K, F.col("ending").cast("bigint").alias("breakage"), "parses")


def _versions(spark, sf):
    return c.modules(spark, sf, "old"), c.modules(spark, sf, "new")


def compared(spark, sf):
    rows = compare.compare_versions(*_versions(spark, sf))
    return rows.select(*K, "change_type", "method_name", "old_signature", "new_signature",
                       _sha(F.col("old_source")).alias("old_sha"), _sha(F.col("new_source")).alias("new_sha"))


def next_definition(spark, sf):
    old = c.modules(spark, sf, "old")
    return compare.next_definition(old, structure.definitions(old, with_source=False).select(*K, "end_line").distinct())


def generated(spark, sf):
    rows = compare.generate_edits(*_versions(spark, sf))
    return rows.select("script_id", "seq", "file", "find_method", "until_exclude", _sha(F.col("replace_with")).alias("replace_sha"))


def rendered(spark, sf):
    rows = compare.render_edit_scripts(compare.generate_edits(*_versions(spark, sf)))
    return rows.select("script_id", _sha(F.col("script")).alias("script_sha"), F.length("script").alias("n_chars"))


def _single(kind):
    """One instruction per row, over every old module (preamble, append) or every definition (replace)."""
    def run(spark, sf):
        old = c.modules(spark, sf, "old")
        body = F.concat(F.lit("# new\n"), F.col("path"), F.lit("\n\n"))
        lines = text.splitlines(F.col("content"))
        if kind == "preamble":
            until = F.array(F.lit("class Bin"), F.lit(""), F.lit("absent"))
            rows = old.select(*K, F.explode(until).alias("until"), edits.apply_preamble(lines, F.col("until"), body).alias("after"))
        elif kind == "append":
            bodies = F.array(body, F.lit(" \n"))
            rows = old.select(*K, F.posexplode(bodies).alias("until", "body"), F.col("content")) \
                .select(*K, "until", edits.apply_append(lines, F.col("body")).alias("after"))
        else:
            names = structure.definitions(old, with_source=False).select(*K, F.concat(F.lit("def "), "name", F.lit("(")).alias("find"))
            split = old.select(*K, lines.alias("lines"))
            rows = split.join(names, K).select(*K, "lines", "find", F.explode(F.array(F.lit(""), F.lit("def top_"), F.lit("# brand"))).alias("until"))
            replaced = edits.apply_replace(F.col("lines"), F.col("find"), F.col("until"), F.when(F.col("until") == "# brand", "").otherwise(body))
            return rows.select(*K, "find", "until", _sha(edits.file_text(replaced)).alias("after_sha"))
        return rows.select(*K, "until", _sha(edits.file_text(F.col("after"))).alias("after_sha"))
    return run


def _applied(spark, sf):
    old, new = _versions(spark, sf)
    scripts = compare.generate_edits(old, new, whole_path=True).withColumn("corpus_id", F.expr("left(script_id, length(script_id) - length(file) - 1)"))
    return edits.apply_edits(scripts, old)


def applied(spark, sf):
    return _applied(spark, sf).select("script_id", "file", _sha(F.col("content")).alias("content_sha"), "n_instructions", "applied")


def report(spark, sf):
    return edits.apply_report(_applied(spark, sf))


def _chain(spark, sf):
    """Three scripts on every old module: one replaces a function, one looks for it in vain, one appends."""
    old = c.modules(spark, sf, "old")
    steps = [("s2", 2, 1, "def top_", "async def poll_", "# gone"), ("s1", 3, 1, "def top_", "", "# late"), ("s1", 3, 2, "# gone", "async def", "# went"),
             ("s0", 4, 1, "", "", "# done")]
    names = ["script_id", "script_seq", "seq", "find_method", "until_exclude", "replace_with"]
    listed = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, step, strict=True)]) for step in steps])
    rows = old.select("corpus_id", F.concat(F.lit("./"), "path").alias("file"), F.lit(None).cast("string").alias("section"), F.inline(listed))
    return edits.apply_script_chain(rows, old)


def apply_chain(spark, sf):
    return _chain(spark, sf)[0].withColumn("content_sha", _sha(F.col("content"))).drop("content")


def chain_report(spark, sf):
    return _chain(spark, sf)[1]


def budget_level(spark, sf):
    reduced = reduce.reduce_levels(_prose(spark, sf), budget.LEVELS_WEAK_TO_STRONG)
    return budget.budget_level(budget.level_tokens(reduced), BUDGET, slices=4)


def prompts(spark, sf):
    rows = semantic.prompt_table(_prose(spark, sf), "m1", limit=2000)
    return rows.select(*K, "content_sha256", "model", "max_tokens", "temperature", F.length("prompt").alias("n_chars"),
                       _sha(F.regexp_extract("prompt", r"(?s)<<<FILE\n(.*)\nFILE>>>", 1)).alias("body_sha"))


def ingested(spark, sf):
    source = c.docs(spark, sf)
    responses = _table(spark, sf, "documents", RESPONSES).withColumn("file_type", paths.file_type(F.col("path")))
    parsed = semantic.parse_responses(responses).select(
        *K, F.coalesce("n_missing_keys", F.lit(0)).alias("n_missing_keys"), F.col("record").isNotNull().alias("usable"),
        F.get_json_object("record_json", "$.file_path").alias("file_path"),
        F.get_json_object("record_json", "$.overall_purpose").alias("purpose"),
        F.get_json_object("record_json", "$.key_components.imports_dependencies").alias("imports"),
        F.get_json_object("record_json", "$.key_components.configuration").alias("configuration"))
    reduced = semantic.ingest_responses(source, responses.drop("content")).select(*K, "method")
    return parsed.withColumn("n_missing_keys", F.when(F.col("usable"), F.col("n_missing_keys")).otherwise(0)).join(reduced, K)


def unwrapped(spark, sf):
    rows = _table(spark, sf, "documents", ENVELOPES)
    return rows.select(*K, _sha(semantic.unwrap_envelope(F.col("text"))).alias("inner_sha"))


def method_summary(spark, sf):
    reduced = reduce.reduce_corpus(c.docs(spark, sf), "smart")
    waits = _table(spark, sf, "documents", {**c.DOCS, "waited_s": "n_chars / 64e0"}).drop("content")
    return stats.method_summary(reduced, waits)



QUERIES = {
    "scan_corpus": scan, "scan_binary": scan_binary, "archive_roundtrip": archive_roundtrip, "archive_write": archive_write,
    "extract_plan": extract_plan, "parse_edit_scripts": parsed_scripts, "render_edit_scripts": rendered,
    "cache_upsert": cache_upsert,
    "filter_extension": lambda s, sf: filters.by_extension(c.files(s, sf), ["py, JS", ".html"]).select(*K),
    "filter_path_regex": lambda s, sf: filters.by_regex(c.files(s, sf), REGEX).select(*K),
    "filter_wildcard": lambda s, sf: filters.by_wildcard(c.files(s, sf), WILDCARD).select(*K),
    "available_paths": lambda s, sf: filters.available(_requested(s, sf), c.docs(s, sf)),
    "missing_paths": lambda s, sf: filters.missing(_requested(s, sf), c.docs(s, sf)),
    "detect_file_type": lambda s, sf: c.files(s, sf).select(*K, paths.file_type(F.col("path")).alias("file_type")),
    "normalise_paths": lambda s, sf: _table(s, sf, "documents", MESSY).select(*K, paths.normalise(F.col("path")).alias("normal")),
    "list_archive": listing, "list_archive_detailed": listing_detailed,
    "compress_none": _level("none"), "compress_light": _level("light", c.files), "compress_medium": _level("medium", c.files),
    "signatures_js": _signature_query("js"), "signatures_java": _signature_query("java"),
    "signatures_cfamily": _signature_query("cpp", "h"), "compress_regex_generic": regex_generic,
    "compress_aggressive": _level("aggressive", c.files), "compress_smart": _level("smart", c.files),
    "compress_smart_unavailable": lambda s, sf: _shown(reduce.reduce_without_model(_prose(s, sf), "smart")),
    "compress_semantic_unavailable": lambda s, sf: _shown(reduce.reduce_without_model(_prose(s, sf), "semantic")),
    "compress_summary": summary,
    "prefix_preview": lambda s, sf: c.files(s, sf).select(*K, _sha(reduce.prefix_preview(F.col("content"))).alias("preview_sha")),
    "prompt_table": prompts, "ingest_responses": ingested, "unwrap_envelope": unwrapped,
    "estimate_tokens": estimated, "clean_for_tokens": cleaned,
    "estimate_tokens_crude": lambda s, sf: c.files(s, sf).select(*K, tokens.crude(F.col("content")).alias("tokens")),
    "line_table": lambda s, sf: structure.line_table(c.files(s, sf)).select(*K, "line_no", "indent", _sha(F.col("line")).alias("line_sha")),
    "definition_index": lambda s, sf: structure.definitions(c.modules(s, sf, "new")).withColumn(
        "source", _sha(F.col("source"))).withColumnRenamed("source", "source_sha"),
    "import_index": lambda s, sf: structure.import_index(c.modules(s, sf, "new")),
    "class_index": lambda s, sf: structure.class_index(c.modules(s, sf, "new")),
    "toplevel_symbols": lambda s, sf: structure.toplevel_symbols(c.modules(s, sf, "new")),
    "structure_skeleton": lambda s, sf: structure.structure_skeleton(c.modules(s, sf, "new")).select(
        *K, _sha(F.col("skeleton")).alias("skeleton_sha"), F.length("skeleton").alias("n_chars")),
    "python_validity": python_validity,
    "outline": lambda s, sf: structure.outline(c.modules(s, sf, "new")).select(
        *K, _sha(F.col("outline")).alias("outline_sha"), F.length("outline").alias("n_chars")),
    "compare_versions": compared, "next_definition": next_definition, "generate_edits": generated,
    "apply_preamble": _single("preamble"), "apply_append": _single("append"), "apply_replace": _single("replace"),
    "apply_edits": applied, "apply_report": report, "apply_script_chain": apply_chain, "script_chain_report": chain_report,
    "archive_totals": lambda s, sf: stats.archive_totals(_entries(s, sf)), "corpus_stats": corpus_stats,
    "extension_histogram": lambda s, sf: stats.extension_histogram(c.files(s, sf)), "cache_stats": cache_hit_stats,
    "call_log_stats": lambda s, sf: calllog.call_log_stats(_calls(s, sf)),
    "errors_by_class": lambda s, sf: calllog.errors_by_class(_calls(s, sf)),
    "method_summary": method_summary, "audit_counts": audit_counts,
    "cache_lookup": cache_lookup,
    "cache_misses": lambda s, sf: cache.misses(cache.fingerprinted(c.docs(s, sf), "light"), _cached(s, sf)),
    "dedupe_compute": dedupe, "union_targets": union_targets,
    "priority_rank": lambda s, sf: budget.priority_rank(c.files(s, sf), slices=4),
    "budget_fit": lambda s, sf: budget.budget_fit(estimated(s, sf), BUDGET, slices=4),
    "budget_level": budget_level,
    "sliding_requests": lambda s, sf: calllog.sliding_requests(_calls(s, sf), 6 * 3600, 2, slices=4).drop("ts"),
    "error_streak": lambda s, sf: calllog.error_streak(_calls(s, sf), slices=4).drop("ts"),
    "recent_errors": lambda s, sf: calllog.recent_errors(_calls(s, sf), horizon_seconds=5 * 86400),
    "audit_archives": lambda s, sf: audit.audit_archives(_table(s, sf, "documents", DOCUMENTS)),
    "audit_edit_scripts": audited_scripts,
}
