"""Python structure against the standard library's parser, over the generated modules and library sources."""

import ast
import glob
import os
import sysconfig
import time

import pytest
from pyspark.sql import functions as F

from corpusforge.checks import corpora
from corpusforge.operators import structure
from tests.conftest import SMALL


def parsed_definitions(path, text):
    tree, lines = ast.parse(text), text.split("\n")
    for node in ast.walk(tree):
        if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            continue
        args = [a.arg + (f": {ast.unparse(a.annotation)}" if a.annotation else "") for a in node.args.args]
        returns = f" -> {ast.unparse(node.returns)}" if node.returns else ""
        yield path, node.name, node.lineno, node.end_lineno, f"def {node.name}({', '.join(args)}){returns}"


def found_definitions(rows):
    return {(r.path, r.name, r.start_line, r.end_line, r.signature) for r in rows}


def test_generated_modules_are_exact(spark):
    files = corpora.modules(spark, SMALL, "new")
    want = {d for r in files.collect() for d in parsed_definitions(r.path, r.content)}
    assert found_definitions(structure.definitions(files).collect()) == want


def test_generated_structure_is_exact(spark):
    files = corpora.modules(spark, SMALL, "new")
    skeletons = {r.path: r.skeleton for r in structure.structure_skeleton(files).collect()}
    for row in files.collect():
        tree = ast.parse(row.content)
        lines = skeletons[row.path].split("\n")
        classes = [n for n in tree.body if isinstance(n, ast.ClassDef)]
        for node in [n for n in tree.body if isinstance(n, ast.FunctionDef)]:
            assert any(line.startswith(f"def {node.name}({', '.join(a.arg for a in node.args.args)})") for line in lines)
        for node in classes:
            assert f"class {node.name}({', '.join(map(ast.unparse, node.bases))}):" in lines
        methods = [n.name for node in classes for n in node.body if isinstance(n, ast.FunctionDef)]
        shown = [line.split("(")[0][8:] for line in lines if line.startswith("    def ")]
        assert shown == methods
        imports = sum(len(n.names) for n in ast.walk(tree) if isinstance(n, (ast.Import, ast.ImportFrom)))
        assert sum(line.startswith(("import ", "from ")) for line in lines) == imports


@pytest.fixture(scope="module")
def library(corpus):
    paths = sorted(glob.glob(os.path.join(sysconfig.get_paths()["stdlib"], "*.py")))[:120]
    pairs = [(os.path.basename(p), open(p, encoding="utf-8", errors="ignore").read()) for p in paths]
    return pairs, corpus(*pairs).repartition(16)


def test_library_spans(library):
    pairs, files = library
    want = {d[:4] for path, text in pairs for d in parsed_definitions(path, text)}
    found = {d[:4] for d in found_definitions(structure.definitions(files, with_source=False).collect())}
    print("definitions", len(want), "exact", len(want & found), "files off", len({d[0] for d in want ^ found}))
    assert len(want & found) / len(want) > 0.99
    assert len(found - want) / len(want) < 0.005


class Imports(ast.NodeVisitor):
    """Every imported alias as a statement of its own, printed by the standard library."""

    def __init__(self):
        self.lines = []

    def visit_Import(self, node):
        self.lines += [(node.lineno, ast.unparse(ast.Import([alias]))) for alias in node.names]

    def visit_ImportFrom(self, node):
        self.lines += [(node.lineno, ast.unparse(ast.ImportFrom(node.module, [alias], node.level))) for alias in node.names]


def parsed_imports(text):
    visitor = Imports()
    visitor.visit(ast.parse(text))
    return visitor.lines


def test_library_imports(library):
    pairs, files = library
    want, found = [], [(r.path, r.statement) for r in structure.import_index(files).collect()]
    for path, text in pairs:
        want += [(path, line) for _, line in parsed_imports(text)]
    missing = set(want) - set(found)
    print("imports", len(want), "missing", len(missing), sorted(missing)[:10], "extra", sorted(set(found) - set(want))[:10])
    assert len(missing) / len(want) < 0.02


def test_broken_files_have_no_structure(corpus):
    files = corpus(("a.py", "total = [1, (2, 3]\n"), ("b.py", "Some prose here.\n"), ("c.py", 'x = "open\n'), ("d.py", "def f(): pass\n"),
                   ("e.py", "s = '''never closed\n"), ("f.py", "for x in y\n    pass\n"))
    assert [r.path for r in structure.structure_skeleton(files).collect()] == ["d.py"]
    assert [r.path for r in structure.definitions(files).collect()] == ["d.py"]


def test_long_literals_in_headers(corpus):
    """Header parsing takes no stack that grows with a literal."""
    text = f"def f(a='{'x' * 1_000_000}', b=\"{chr(92)}{chr(92)}{'y' * 500_000}\"):\n    return a\n"
    rows = structure.definitions(corpus(("a.py", text), ("b.py", "def g(k: int = 1):\n    pass\n"))).collect()
    assert {r.path for r in rows} == {"a.py", "b.py"}


def test_members_of_one_statement_keep_their_order(corpus):
    names = [f"v{i}" for i in range(1200)]
    text = "class A:\n    " + " = ".join(names) + " = 0\n    last = 1\n"
    skeleton = structure.structure_skeleton(corpus(("a.py", text))).first().skeleton
    found = [line.split()[0] for line in skeleton.splitlines() if line.startswith("    v") or line.startswith("    last")]
    assert found == [*names, "last"]


LINES = """import os; import sys as system, json
if 1: import csv
try: import yaml
except ImportError: yaml = None; found = 'a;b'
finally: done = True
a = 1; b = 2; c: int = 3; a += 1;
class A: x = 1; y: int = 2
class B(Base[int, str], metaclass=M(a=1, b=2)):
    def one(self, k: Dict[str, Tuple[int, ...]] = {1: 2}, v=lambda p, q: (p, q)) -> List[int]: import re; return k
    z = "text; with: marks"; w = [1,
        2]; u = 3
async def two(x): return x; y = 1
def three(a, /, b, c=(1, (2, [3])), *d, e=lambda: 0, **f): pass
for i in range(3): total = i; other = lambda k: k
while False: pass
with open("f") as f: text = f.read(); more = 1
if x: y = 1
elif z: y = 2
else: y = 3
def four(k={"a": [(1, 2), {3: 4}]}, *, q: "str;:,(" = ";"): return k; z = 1
def five[T: (int, str)](x: T, y: list[T] = [1]) -> dict[str, T]:
    if x: return y
    else: import zlib; return x
lambda_free = 1 if x else 2
"""


def test_one_line_statements_against_the_parser(corpus):
    """Semicolons, one-line blocks and nested headers: imports, definitions and variables as the parser has them."""
    files = corpus(("a.py", LINES))
    found = found_definitions(structure.definitions(files).collect())
    assert found == set(parsed_definitions("a.py", LINES))
    rows = [(r.line_no, r.statement) for r in structure.import_index(files).collect()]
    assert sorted(rows) == sorted(parsed_imports(LINES))
    variables = {r.value for r in structure.toplevel_symbols(files).collect() if r.symbol == "variable"}
    assert {"a", "b", "c", "lambda_free"} == variables
    members = {(r["class"], r.member, r.value) for r in structure.class_index(files).collect() if r.member != "class"}
    assert members == {("class A:", "variable", "x"), ("class A:", "variable", "y"), ("class B(Base[int, str]):", "method", "def one(self, k, v) -> List[int]"),
                       ("class B(Base[int, str]):", "variable", "z"), ("class B(Base[int, str]):", "variable", "w"), ("class B(Base[int, str]):", "variable", "u")}


def test_deep_headers(corpus):
    deep = f"def f(a: {'T[' * 60}int{']' * 60}, b: int = {'(' * 60}1{')' * 60}) -> A[B[C[D[E[F[G]]]]]]:\n    pass\n"
    wide = f"def g(a={{{', '.join(f'({i}, [{i}])' for i in range(2000))}}}, b: int = 1): pass\n"
    files = corpus(("a.py", deep), ("b.py", wide))
    assert found_definitions(structure.definitions(files).collect()) == {
        d for p, x in (("a.py", deep), ("b.py", wide)) for d in parsed_definitions(p, x)}


BROKEN = ["x = = 1", "x = 1 +", "f() = 3", "print 'x'", "3 apples", "  x = 1", "if x:", "if x:\npass", "class A:\n\nb = 1", "if x:\n    y = 1\n  z = 2",
          "x = 1; y = = 2", "x = [1, 2] 3 four", "x = 'a' b", "def f(): return 1\n    x = 2", "a.b.", "if x: pass\nelse:", "x = 1 *"]
SOUND = ["x = -1", "x = not y", "f(a)[0] = 3", "f(a).b = 3", "print('x')", "x = 3 if y else 4", "if x:\n  y = 1", "if x: y = 1\nelse: z = 1", "x = 'a' 'b' f'c'",
         "if x:\n    y = 1\n# note\n  # note\nz = 2", "from a import *", "from .. import b", "x = yield", "x = a if b else c", "raise A from b", "del a, b",
         "x: int", "x = [\n 1,\n   2]", "if x:\n\ty = 1\n\tz = 2", "for x in 1, 2: pass", "match = 1\nmatch.x = 2", "assert 'a' in b", "x = (1,) * 2",
         "try:\n    a\nexcept (A, B) as e:\n    b", "x = lambda: 0", "(a, b) = c", "[a, b] = c = d", "x = a @ b", "x **= 2", "async def f():\n    await g()", "x = 0xFF and 1",
         "return_value = 1", "x = a <= b >= c != d", "global_x = b'x' rb'y'", "x = *a, *b", "print(*a, **b)", "@a.b(c)\ndef f(): pass", "type X = int", "if (a := 1): pass"]


def test_validity(spark, corpus):
    """Broken files take the medium level; what the parser accepts is never called broken."""
    for text in BROKEN:
        with pytest.raises(SyntaxError):
            ast.parse(text)
    for text in SOUND:
        ast.parse(text)
    files = corpus(*[(f"b{i}.py", t + "\n") for i, t in enumerate(BROKEN)], *[(f"s{i}.py", t + "\n") for i, t in enumerate(SOUND)])
    parses = {r.path: r.parses for r in structure.statements(files).select("path", "parses").distinct().collect()}
    assert [t for i, t in enumerate(BROKEN) if parses[f"b{i}.py"]] == []
    assert [t for i, t in enumerate(SOUND) if not parses[f"s{i}.py"]] == []
    from corpusforge.operators.reduce import reduce_corpus
    methods = {r.path: r.method for r in reduce_corpus(files, "aggressive").collect()}
    assert len({m for p, m in methods.items() if p.startswith("b")}) == 1
    assert not {m for p, m in methods.items() if p.startswith("b")} & {m for p, m in methods.items() if p.startswith("s")}


def test_a_star_at_the_end_is_broken_unless_it_is_imported(spark):
    texts = {"prose": "Of%%% the\nand.***\n", "star": "x = a**\n", "colon": "if a *:\n    pass\n", "from": "from a import *\n",
             "tight": "from a import*\n", "call": "f(*a)\nx = a * b\n"}
    rows = spark.createDataFrame([("c", k, v) for k, v in texts.items()], "corpus_id string, path string, content string")
    found = {r.path for r in structure.parsed_statements(rows).select("path").distinct().collect()}
    assert found == {"from", "tight", "call"}


def test_endings_parse_as_with_the_whole_text(spark):
    """Files that end in an open bracket, quote, line or block, and endings that close, continue or break them."""
    texts = ["", "\n", "x = 1", "x = 1\n", "x = (1,", "x = (1,\n", "f(a))", "x = 1 + \\", "x = 1 + \\\r", "x = \"\"\"a\n", "x = 'a", "if x:", "if x:\n    y = 1",
             "class A:\n    def f(self):\n        pass  # (", "def f(\n    a", "x = = 1", "x = = 1\ny = (1", "# only", "x = [1\n]", "if x:\n    y = (1\nz = 2", "@d", "x; y = 2"]
    endings = ["", "y = 2", "    y = 2", ")", "2)", "1", "'", '\"\"\"', "\n\n    pass", "else:\n    z = 3", "if z:", "):\n    pass", "y = (", "# )", "def g(): pass", "x = = 2"]
    files = spark.createDataFrame([("c", f"a#{i}.py", t) for i, t in enumerate(texts)], "corpus_id string, path string, content string")
    whole = spark.createDataFrame([("c", f"{i}:{j}", f"{t}\n{e}\n") for i, t in enumerate(texts) for j, e in enumerate(endings)],
                                  "corpus_id string, path string, content string")
    want = {r.path: r.parses for r in structure.statements(whole).select("path", "parses").distinct().collect()}
    got = {f"{r.path[2:-3]}:{r.ending}": r.parses for r in structure.parses_with(files, endings).collect()}
    assert got == want and len(got) == len(texts) * len(endings) and 0 < sum(got.values()) < len(got)


def test_signs_of_broken_neighbours_show_at_their_gap(spark):
    """Whatever shows two words that can't be neighbours passes the cheap test for the blank between them."""
    words = ["a", "if", "in", "not", "print", "3", "3.if", "x.y", ".b", '"', 'r"', 'f("', "f(1)", "[2]", "}", "é", "lambda", "import", "=", "_", "", "ab1"]
    rows = (spark.range(len(words)).crossJoin(spark.range(len(words)).toDF("j")).crossJoin(spark.range(len(words)).toDF("k"))
            .select(F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("id") + 1).cast("int")).alias("a"),
                    F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("j") + 1).cast("int")).alias("b"),
                    F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("k") + 1).cast("int")).alias("c"))
            .select(F.explode(F.array(F.concat_ws(" ", "a", "b", "c"), F.concat("a", F.lit(" \t"), "b", "c"), F.concat("a", "b", F.lit("  "), "c"))).alias("t")))
    signs = F.col("t").rlike("|".join(structure.NEIGHBOURS))
    counts = rows.select(F.count_if(signs), F.count_if(signs & ~F.col("t").rlike(structure.GAP)), F.count_if(~signs & ~F.col("t").rlike(structure.GAP))).first()
    assert counts[0] > 1000 and counts[1] == 0 and counts[2] > 1000
    # The final dot is looked for from the dot on.
    plain = r'[\p{L}_)\]}"]\.\s*\z'
    assert rows.select(F.concat("t", F.lit(". ")).alias("t")).filter(F.col("t").rlike(plain) != F.col("t").rlike(structure.OPERATORS[-1])).count() == 0


def test_bracket_depth_of_a_long_statement_is_cheap(spark):
    """The running depth over 60,000 brackets: a few seconds, several times as long with an array as the state."""
    text = "([{}])" * 5000 + "(" * 15000 + "x" + ")" * 15000
    rows = spark.createDataFrame([(text,)], "t string")
    began = time.time()
    flat = rows.select(structure.flattened(F.col("t")).alias("f")).select("f.around", "f.within").first()
    fill = structure.FILL
    assert flat["around"] == f"({fill * 4})" * 5000 + "(" + fill * 29999 + ")"
    assert flat["within"] == f"([{fill * 2}])" * 5000 + "((" + fill * 29997 + "))"
    assert time.time() - began < 12


def test_lines_are_no_rows_of_their_own(spark, corpus):
    """Statements come from the files' texts in one step, without windows, sorts or groups; only turns of definitions meet windows."""
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    files = corpus(("a.py", "@one\n@two\ndef f(a):\n    x = [\n        1]\n\n    return x\nz = 1\nclass B:\n    async def g(): pass\n"), ("b.py", "x = (\n" * 70 + ")\n" * 70 + "y = 2"))
    assert not [step for step in ("Window", "Aggregate", "Sort") if step in plan(structure.statements(files))]
    rows = structure.statements(files)
    assert [tuple(r) for r in rows.filter("path = 'b.py'").select("start_line", "end_line", "parses").orderBy("stmt").collect()] == [(1, 140, True), (141, 141, True)]
    assert [tuple(r) for r in structure.definitions(files).select("name", "start_line", "end_line", "source").orderBy("start_line").collect()] == [
        ("f", 3, 7, "@one\n@two\ndef f(a):\n    x = [\n        1]\n\n    return x"), ("g", 10, 10, "async def g(): pass")]


def test_broken_neighbours_are_told_before_statements_are_cut(spark):
    """Prose under a Python name costs no statements, and no text that may parse is given up."""
    import random
    draw = random.Random(5)
    words = ["a", "b1", "if", "not", "in", ":", ";", "\n", "\n    ", " ", "  ", "'", '"', '"""', "#", "(", ")", "[", "]", "=", ",", "f'x'", "r", "\\\n", "1", ".", "def f():", "lambda x:", "for", "\t"]
    texts = ["".join(draw.choice(words) for _ in range(draw.randrange(2, 14))) for _ in range(1500)] + ["some words here", "if a:\n    b = 'c d'  # e f\n"]
    read = spark.createDataFrame([(t,) for t in texts], "content string").select(
        "content", structure._read(F.col("content")).alias("whole"), structure._read(F.col("content"), True).alias("sound")).select(
        "content", F.col("sound").isNull().alias("given_up"), structure._flawed(F.col("whole")).alias("flawed"),
        F.col("sound").eqNullSafe(F.col("whole")).alias("same"),
        F.exists("whole", lambda x: structure._neighbours(x.masked)).alias("neighbours")).collect()
    assert all(r.flawed for r in read if r.given_up) and all(r.same for r in read if not r.given_up)
    assert all(r.given_up == r.neighbours for r in read), [r.content for r in read if r.given_up != r.neighbours][:5]
    assert [r.given_up for r in read][-2:] == [True, False] and 100 < sum(r.given_up for r in read) < 1400
