"""Reduction levels and token estimates: worked values and small restatements over awkward text."""

import pytest
from pyspark.sql import functions as F

from corpusforge.functions import paths, tokens
from corpusforge.operators import reduce, semantic

# Text, then its light level and its medium level as Python, Go and Markdown; None where medium equals the Markdown one.
LEVELS = [
    ("x = 1  \n\n\n\ny = 2 \n \nz\x0bw\x85v\n", "x = 1\n\ny = 2\n\nz\nw\nv", None, None, "x = 1  \ny = 2 \nz\nw\nv"),
    ("# top\ncode  # tail\n'#' + x # after\n\"#\n", "# top\ncode  # tail\n'#' + x # after\n\"#", "code\n'#' + x # after\n\"#", None,
     "# top\ncode  # tail\n'#' + x # after\n\"#"),
    ("#!/bin/sh\necho 'a # b' # c\n", "#!/bin/sh\necho 'a # b' # c", "echo 'a # b' # c", None, "#!/bin/sh\necho 'a # b' # c"),
    ("int a; // b\n// c\n\"//\" x // y\n'//\n", "int a; // b\n// c\n\"//\" x // y\n'//", None, "int a;\n\"//\" x // y\n'//",
     "int a; // b\n// c\n\"//\" x // y\n'//"),
    ("\tif\tx :\n\n \n\n\tpass", "\tif\tx :\n\n\tpass", None, None, "\tif\tx :\n\tpass"),
    ("a\r\nb\rc", "a\nb\nc", None, None, "a\nb\nc"), ("", "", "", "", ""), (" \n\n", "", "", "", "")]


@pytest.mark.parametrize("suffix,column", [(".py", 2), (".go", 3), (".md", 4)])
def test_levels_of_worked_texts(corpus, suffix, column):
    files = corpus(*[(f"{i}{suffix}", row[0]) for i, row in enumerate(LEVELS)])
    light = {r.path: r.reduced for r in reduce.reduce_corpus(files, "1").collect()}
    medium = {r.path: r.reduced for r in reduce.reduce_corpus(files, "2").collect()}
    for i, row in enumerate(LEVELS):
        assert light[f"{i}{suffix}"] == row[1]
        assert medium[f"{i}{suffix}"] == (row[4] if row[column] is None else row[column])


def test_token_counts_of_worked_texts(corpus):
    """Cleaned length / 2.8 plus 0.7 for every keyword, both worked out by hand."""
    worked = [("if x:\n    return y  # why\n", 8), ("# only\n", 1), ("IF a and b\n\n\n\nelse c", 8), ("value = other + 1\n", 6),
              ("\u00e9t\u00e9 if\u00e9 _if if2 if IF", 8), ("", 0)]
    files = corpus(*[(f"{i}.py", text) for i, (text, _) in enumerate(worked)]).withColumn("file_type", paths.file_type(F.col("path")))
    got = {r.path: r.tokens for r in tokens.add_tokens(files, "content").collect()}
    assert got == {f"{i}.py": n for i, (_, n) in enumerate(worked)}


def test_worked_values(corpus):
    files = corpus(("test1.py", "def hello(): pass\n"), ("test4.txt", "Plain text content here\n"), ("blank.md", " \n"))
    rows = {r.path: r for r in reduce.reduce_corpus(files, "aggressive").collect()}
    one, four, blank = rows["test1.py"], rows["test4.txt"], rows["blank.md"]
    assert one.reduced.startswith("def hello():\n    ...\n\n# ... (Structure extracted via AST")
    assert (one.method, one.original_size, one.reduced_size, one.tokens, one.ratio) == ("aggressive (python-ast)", 18, 75, 6, 0.24)
    assert four.reduced == ("Plain text content here\n# ... (Light compression via regex - text)\n"
                            "# ... (Medium compression via regex - text)")
    assert (four.method, four.reduced_size, four.tokens) == ("aggressive (text-ast)", 110, 47)
    assert (blank.method, blank.reduced, blank.tokens, blank.ratio, blank.original_size) == (
        "skip (empty/whitespace)", "", 0, 1.0, 2)


def test_comment_only_file_vanishes_with_infinite_ratio(corpus):
    row = reduce.reduce_corpus(corpus(("a.py", "# only\n")), "medium").first()
    assert (row.reduced, row.tokens, row.ratio) == ("", 0, float("inf"))


def test_levels_together_equal_levels_alone(corpus):
    files = corpus(("a.py", "import os\ndef f(a):\n    # c\n    return 1\n"), ("b.js", "function f() {\n return 1; }\n"), ("c.txt", ""))
    names = ["none", "light", "medium", "aggressive", "smart"]
    together = {(r.level, r.path): r for r in reduce.reduce_levels(files, names).collect()}
    for name in names:
        for row in reduce.reduce_corpus(files, name).collect():
            assert together[(name, row.path)] == row


def test_unknown_level_is_refused(corpus):
    with pytest.raises(ValueError):
        reduce.reduce_corpus(corpus(("a", "b")), "9")


def test_smart_routes(corpus):
    code, prose = "x = 1\n", "word\n"
    files = corpus(("s.py", code), ("m.py", code * 300), ("l.go", code * 2000), ("s.txt", prose), ("m.txt", prose * 200), ("l.txt", prose * 1100))
    methods = {r.path: r.method for r in reduce.reduce_corpus(files, "s").collect()}
    assert methods["s.py"] == methods["s.txt"] == "smart->light (whitespace norm.)"
    assert methods["m.py"] == methods["m.txt"] == "smart->medium (comments/blanks removed)"
    assert methods["l.go"] == "smart->aggressive (go-ast)" and methods["l.txt"] == "smart->aggressive (text-ast)"


def test_responses(corpus, spark):
    body = "import os\ndef f(a):\n    return a\n" * 40
    files = corpus(("a.py", body), ("b.py", body), ("c.py", body))
    good = '{"file_path": "a.py", "overall_purpose": "p", "key_components": {"classes": []}, "core_logic_flow": "f"}'
    responses = spark.createDataFrame([("c", "a.py", "python", "m", f"```json\n{good}\n```"), ("c", "b.py", "python", "m", "sorry")],
                                      "corpus_id string, path string, file_type string, model string, raw_text string")
    rows = {r.path: r for r in semantic.ingest_responses(files, responses).collect()}
    assert rows["a.py"].method == "semantic-llm" and rows["a.py"].reduced.startswith("# SEMANTIC COMPRESSION v1.1")
    assert '"overall_purpose": "p"' in rows["a.py"].reduced and '"imports_dependencies": []' in rows["a.py"].reduced
    assert rows["b.py"].method == rows["c.py"].method == "semantic-llm-failed, fallback to aggressive (python-ast)"
    smart = {r.path: r.method for r in semantic.ingest_responses(files, responses, "smart").collect()}
    assert smart == {"a.py": "smart->semantic-llm", "b.py": "smart->medium (comments/blanks removed)",
                     "c.py": "smart->medium (comments/blanks removed)"}


@pytest.mark.parametrize("answer,want", [
    ('{"file_path": "\u00e9.py", "overall_purpose": "a \\\\ \\"b\\" {x}, [y]: z", "key_components": {"classes": [{"name": "A", "keys": []}]}}',
     '''{
  "file_path": "\\u00e9.py",
  "overall_purpose": "a \\\\ \\"b\\" {x}, [y]: z",
  "key_components": {
    "classes": [
      {
        "name": "A",
        "keys": []
      }
    ],
    "imports_dependencies": [],
    "functions_methods": [],
    "data_structures": "",
    "configuration": ""
  },
  "file_type": "p.py",
  "core_logic_flow": ""
}'''),
    ('{"key_components": "none", "extra": [1, {}, null, true]}', '''{
  "key_components": "none",
  "extra": [
    1,
    {},
    null,
    true
  ],
  "file_path": "p.py",
  "file_type": "p.py",
  "overall_purpose": "",
  "core_logic_flow": ""
}''')])
def test_answers_are_laid_out_with_defaults(spark, answer, want):
    row = semantic.parse_responses(spark.createDataFrame([("p.py", "Sure: " + answer)], "path string, raw_text string")).first()
    assert row.record_json == want


def test_levels_without_a_model(corpus):
    body = "import os\ndef f(a):\n    return a\n" + "    # filler line\n" * 300
    files = corpus(("a.py", body), ("s.py", "x = 1\n"), ("t.md", "words\n"), ("b.py", " "))
    semantic_rows = {r.path: r.method for r in reduce.reduce_without_model(files, "semantic").collect()}
    assert semantic_rows["a.py"] == "semantic-llm-unavailable, fallback to aggressive (python-ast)"
    smart = {r.path: r.method for r in reduce.reduce_without_model(files, "smart").collect()}
    assert smart["a.py"] == "smart->semantic-llm-unavailable, fallback to aggressive (python-ast)"
    assert smart["s.py"] == smart["t.md"] == "smart->light (whitespace norm.)" and smart["b.py"] == "skip (empty/whitespace)"


def test_files_of_one_split_are_reduced_by_many_tasks(spark, corpus):
    """A table of one row group is read by one task; reducing it is dealt over all."""
    files = corpus(*[(f"d{i}.md", f"# line {i}\n\n\n\nwords  of\ttext {i}") for i in range(64)]).coalesce(1)
    for level in ("light", "aggressive"):
        rows = reduce.reduce_corpus(files, level).select("path", "reduced", F.spark_partition_id().alias("part")).collect()
        assert len(rows) == 64 and len({r["part"] for r in rows}) > 4


def test_blank_runs_and_keywords_of_the_estimate(spark):
    """The cheaper patterns of the estimate give what the plain ones give."""
    texts = ["a\tb", "a  b", "a b", " \t", "\t", "  x \t\ty  \n\t\n", "public  static\tfinal", "publicx xstatic FINAL_ final", "Élan classé class", "new\tNEW(new)"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    word = tokens.WORD
    for kind, (_, _, words) in tokens.fv.TOKEN_WORDS.items():
        plain = f"(?i)(?<!{word})(?:{'|'.join(words.split())})(?!{word})"
        assert rows.filter(F.regexp_count("t", F.lit(plain)) != F.regexp_count("t", F.lit(tokens.word_pattern(words)))).count() == 0, kind
    spaced = tokens.strip(F.regexp_replace(F.regexp_replace("t", "[ \t]{2,}|\t", " "), f"\n[{tokens.SPACE}]*\n[{tokens.SPACE}]*\n", "\n\n"))
    assert rows.filter(spaced != tokens.clean(F.col("t"), F.lit("text"))).count() == 0


AWKWARD = ["", " \n\t", "if a:\n    return b  # not c\n", "# class x\nwhile True: pass\n\n\n\n# if\n\nelse", "a\rif b\r# for c\x0bclass d\n", "#!for\nif\n",
           "int x; // if y\n// for z\n\"//\" return\n", "/* if\nelse */ public class A { }\nreturn; /* this */", "x /", "*\n/ if /* for", "//* if */ a",
           "a  if\tb \u3000 \n\u3000\n \u2003\nclass\u2028else\x85for", "  lead\n\n\n\ntail\u00a0\u00a0\n", "\u00e9t\u00e9 if\u00e9 _if if2 IF\n" * 3,
           "# one\n\n\n[a](b) **c** `d` __e__\n#", "function f() { return 1; }\nclass A {\n}", "#include <a>\nint f(int a) {\n  return a; // x\n}\n",
           "import os\ndef f(a):\n    # c\n    return 1\n", "x = 1 # if\n\n\n\n\ny = 2", "a\n# ... (Medium compression via regex - java)", "if \"\"\"\nfor\n\"\"\" else"]


@pytest.mark.parametrize("level", ["light", "medium", "aggressive"])
def test_estimates_of_levels_together_equal_those_alone(corpus, level):
    """A count that levels share is that of each level's own text, whatever comments, breaks and blanks stand in it."""
    suffixes = [".py", ".js", ".ts", ".java", ".c", ".h", ".cpp", ".hpp", ".cs", ".go", ".rs", ".md", ".txt", ".sh", ".html"]
    files = corpus(*[(f"{i}{suffix}", text) for suffix in suffixes for i, text in enumerate(AWKWARD)])
    shown = ["path", "method", "reduced", "tokens"]
    together = reduce.reduce_levels(files, ["light", "medium", "aggressive"]).filter(F.col("level") == level)
    alone = reduce.reduce_corpus(files, level)
    assert sorted(together.select(*shown).collect()) == sorted(alone.select(*shown).collect())


def test_words_are_counted_once_for_all_levels(corpus):
    """The keyword patterns meet the content below the generator that repeats a file for its levels."""
    plan = reduce.reduce_levels(corpus(("a.c", "int a;")), ["light", "medium", "aggressive"])._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all(content" in plan[plan.index("Generate inline"):]


def test_unusual_breaks_are_found_wherever_they_stand(spark):
    from corpusforge.functions import text as t
    texts = ["a\nb", "", "\r", "a\r\nb", "\x85", "a\u2028", "\u2029b", "\x0b\x0c\x1c\x1d\x1ex", "\u00e9\n\u3000"]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", t.unify_breaks(F.col("t")).alias("u"), t.is_blank(F.col("t")).alias("blank"))
    for r in rows.collect():
        assert r.u == "\n".join((r.t + "x").splitlines())[:-1] and r.blank == (r.t.strip() == "")
    late = spark.createDataFrame([(" " * 70 + "x",), (" " * 70,), ("\u3000" * 64 + "\n" * 9,)], "t string")
    assert [r[0] for r in late.select(t.is_blank(F.col("t"))).collect()] == [False, True, True]
