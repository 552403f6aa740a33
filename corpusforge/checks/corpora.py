"""Test corpora derived from the given tables, as the same expressions for Spark and for DuckDB.

Each corpus reads whole tables.  Generated code groups 16 consecutive keys of ``part`` into one file; the key is
unique, so a file never holds more than 16 blocks whatever the data.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.session import shuffle_partitions


def text(*parts) -> str:
    """SQL text of one line: plain strings are literals, one-element tuples are SQL expressions."""
    quoted = [f"cast({p[0]} as varchar(64))" if isinstance(p, tuple) else
              ", chr(39), ".join(f"'{s}'" for s in p.split("'")) for p in parts]
    return f"concat({', '.join(quoted)})"


def block(*lines) -> str:
    """Lines joined by line feeds; a (condition, line) pair is left out when the condition fails."""
    parts = [f"case when {line[0]} then {line[1]} end" if isinstance(line, tuple) else line for line in lines]
    return f"concat_ws(chr(10), {', '.join(parts)})"


EXTENSIONS = [".py", ".js", ".java", ".c", ".h", ".cpp", ".hpp", ".go", ".rs", ".md", ".txt", ".json", ".ts", ".sh",
              ".yaml", ".HTML"]
_EXTENSION = ("case doc_id % 16 " + " ".join(f"when {i} then '{e}'" for i, e in enumerate(EXTENSIONS)) + " end")
_DOC_NAME = (f"case when doc_id % 97 = 0 then 'Dockerfile' when doc_id % 89 = 0 then 'makefile' "
             f"when doc_id % 83 = 0 then 'README.md' when doc_id % 79 = 0 then 'main.py' "
             f"when doc_id % 73 = 0 then concat('test_', doc_id, '.py') when doc_id % 71 = 0 then 'utils.js' "
             f"else concat('doc_', doc_id, {_EXTENSION}) end")
DOCS = {"corpus_id": "concat('repo_', doc_id % 7)",
        "path": f"concat('repo_', doc_id % 7, '/', lang, '/', source, '/', doc_id, '/', {_DOC_NAME})",
        "content": "text"}
PAGES = {"corpus_id": "concat('site_', page_id % 3)", "path": "concat('site_', page_id % 3, '/page_', page_id, '.html')",
         "content": "html"}

MODULE = "cast(floor(p_partkey / 16e0) as bigint)"
M, P, S = ("m",), ("p_partkey",), ("p_size",)

_METHOD = block(
    ("p_size % 4 = 2", text("    @cached")),
    ("p_size % 4 = 2", text("    @trace(level=", S, ", tag='a # b')")),
    ("p_size % 4 = 0", text("    def part_", P, "(self, qty: int, rate: float = 0.5, *, note='a, b') -> Dict[str,int]:")),
    ("p_size % 4 = 1", text("    async def part_", P, "(self, qty):")),
    ("p_size % 4 = 2", text("    def part_", P, "(")),
    ("p_size % 4 = 2", text("        self,  # owner")),
    ("p_size % 4 = 2", text("        qty: 'Opt[int]' = None,")),
    ("p_size % 4 = 2", text("    ) -> int|None:")),
    ("p_size % 4 = 3", text("    def part_", P, "(self, key, /, qty, *rest, **options):")),
    text('        """Part of ', ("p_name",), "."),
    text(""),
    text("        def phantom_", P, "(x): only text"),
    text('        """'),
    text("        # brand ", ("p_brand",)),
    text("        total = qty * ", ("bonus",), "  # inline ", ("p_type",)),
    ("p_size % 4 = 3", text("        def inner_", P, "(x):")),
    ("p_size % 4 = 3", text("            import json")),
    ("p_size % 4 = 3", text("            return json.dumps({'x': x})  # tail")),
    ("p_size % 4 = 3", text("")),
    text("        return {'type': total, 'it': \"isn't\"}"),
    text(""))
_HEADER = block(
    text("#!/usr/bin/env python3"), text('"""Stock module ', M, "."), text(""), text("def phantom(x): only text"),
    text('"""'), text("import os"), text("import sys as system"), text("from typing import (Dict,"),
    text("    Optional as Opt)  # types"), text("from . import util_", M), text("import re; import time as clock, csv"),
    text("if LEVEL: import json as levels"), text("try: import yaml"), text("except ImportError: yaml = None; found = 'a;b'"), text(""), text("LIMIT = ", M),
    text("TOTAL: int = 0"), text("alpha = beta = ", M, "  # shared"), text("TOTAL += 1"), text("gamma = ", M, "; delta: int = 2; gamma += 1;"),
    text("class One", M, "(Base, key={'a': (1, 2)}): first = 1; second: int = 2"), text(""),
    text("@register"), text("class Bin", M, "(Base, Mixin, metaclass=Meta):"), text('    """Holds parts."""'),
    text("    capacity: int = 16"), text("    label = 'bin # ", M, "'"), text(""))
_FOOTER = block(
    text("def top_", M, "(a, b=(1, 2), *rest, flag=None) -> Dict[str, int]:"), text("    def inner(x):"),
    text("        return x == a"), text(""), text("    # after inner"), text("    return inner(b)"), text(""),
    text("async def poll_", M, "("), text("    queue,  # source"), text("    delay: float = 0.5,"), text("):"),
    text("    return await queue.get()"), text(""),
    text("def deep_", M, "(a: A[B[C[D[E[F[int]]]]]], b: int = (1, [2, {3: 4}]), *, c={'x': [1, (2, 3)]}) -> Dict[str, List[Set[int]]]: return a"),
    text("def nest_", M, "(x: ", "T[" * 30, "int", "]" * 30, " = 'a:b, c', y=", "(" * 30, "0", ")" * 30, "): x = 1; return x"), ("fresh and m % 2 = 0", text("")),
    ("fresh and m % 2 = 0", text("def extra_", M, "():")), ("fresh and m % 2 = 0", text("    return ", M)), text(""))

_JS = (block(text("import { x } from './util_", M, ".js';"), text("// stock ", M), text("let url = \"http://host\";")),
       block(text("export class Part", P, " extends Base {"), text("  constructor(qty) { super(qty); }  // build"),
             text("  /* block"), text("     comment */"), text("}"),
             text("async function part_", P, "(a, b) { return a + ", S, "; }"), text("const f_", P, " = function (x) {"),
             text("  return x; // '", S, "'"), text("};"), text("")), block(text("export default url;"), text("")))
_JAVA = (block(text("import java.util.List;"), text(""), text("public class Bin", M, " {")),
         block(text("    // part ", P), text("    private int size", P, " = ", S, ";"),
               text("    public int part", P, "(int qty) { /* body */"), text("        return qty * ", S, ";  // times"),
               text("    }"), text("")), block(text("}"), text("")))
_CPP = (block(text("#include <vector>"), text("#define LIMIT ", M), text("namespace bin", M, " {"), text("")),
        block(text("template <typename T>"), text("struct Part", P, " { int size; };"),
              text("// int commented(int x)"), text("int part_", P, "(int qty, double rate) {"),
              text("    return qty * ", S, ";  // size"), text("}"), text("void probe_", P, "(char c);"), text("")),
        block(text("}  // namespace"), text("")))

# name: (suffix, header, block, footer); all twins share one shape.
TWINS = {"js": (".js", *_JS), "java": (".java", *_JAVA), "cpp": (".cpp", *_CPP), "h": (".h", *_CPP)}


def _module_parts(version: str) -> tuple[str, str]:
    """Row filter and constant of the old and the new version of the generated modules."""
    if version == "old":
        return "true", "p_size"
    return "p_size > 5", "case when p_size <= 15 then p_size + 1 else p_size end"


def _module_columns(suffix: str, header: str, footer: str, fresh: str) -> dict[str, str]:
    fresh_footer = footer.replace("fresh and", f"{fresh} and")
    return {"corpus_id": "concat('wh_', m % 5)", "path": f"concat('wh_', m % 5, '/stock/mod_', m, '{suffix}')",
            "content": f"concat_ws(chr(10), {header}, body, {fresh_footer})"}


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} as {n}" for n, e in columns.items())


def sql_ctes() -> dict[str, str]:
    """DuckDB text of every corpus, by name."""
    ctes = {"docs": f"select {_select(DOCS)} from documents", "sites": f"select {_select(PAGES)} from pages"}

    def grouped(keep, bonus, row_block, columns):
        return (f"select {_select(columns)} from (select m, string_agg(b, chr(10) order by p_partkey) "
                f"filter (where keep) as body from (select *, {row_block} as b from (select *, {MODULE} as m, "
                f"({keep}) as keep, {bonus} as bonus from part)) group by m)")

    for version in ("old", "new"):
        keep, bonus = _module_parts(version)
        ctes[f"mods_{version}"] = grouped(keep, bonus, _METHOD, _module_columns(
            ".py", _HEADER, _FOOTER, "true" if version == "new" else "false"))
    for name, (suffix, header, row_block, footer) in TWINS.items():
        ctes[f"twin_{name}"] = grouped("true", "0", row_block, _module_columns(suffix, header, footer, "false"))
    ctes["files"] = " union all ".join(f"select * from {c}" for c in
                                       ["docs", "sites", "mods_new"] + [f"twin_{t}" for t in TWINS])
    return ctes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} as {n}" for n, e in columns.items()])


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _columns(table(spark, sf_dir, "documents"), DOCS)


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _columns(table(spark, sf_dir, "pages"), PAGES)


def _grouped(spark, sf_dir, keep, bonus, row_block, columns) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size", f"{MODULE} as m", f"({keep}) as keep", f"{bonus} as bonus")
    body = F.expr("listagg(b, chr(10)) within group (order by p_partkey) filter (where keep)")
    keyed = rows.withColumn("b", F.expr(row_block)).repartition(shuffle_partitions(spark), "m")
    return _columns(keyed.groupBy("m").agg(body.alias("body")), columns)


def modules(spark: SparkSession, sf_dir: str, version: str) -> DataFrame:
    keep, bonus = _module_parts(version)
    return _grouped(spark, sf_dir, keep, bonus, _METHOD, _module_columns(
        ".py", _HEADER, _FOOTER, "true" if version == "new" else "false"))


def twin(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    suffix, header, row_block, footer = TWINS[name]
    return _grouped(spark, sf_dir, "true", "0", row_block, _module_columns(suffix, header, footer, "false"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All corpora together: prose under code suffixes, web pages, Python modules and their twins."""
    corpus = docs(spark, sf_dir).unionByName(sites(spark, sf_dir)).unionByName(modules(spark, sf_dir, "new"))
    for name in TWINS:
        corpus = corpus.unionByName(twin(spark, sf_dir, name))
    return corpus
