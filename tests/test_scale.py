"""Skew: running totals and lookups with one key that holds most rows, against brute force."""

import random

from pyspark.sql import functions as F

from corpusforge.functions.scale import lookup, running, sliced
from corpusforge.operators import budget, calllog


def skewed(n=600, seed=7):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", i, rng.randrange(100)) for i in range(n)]


def test_running_totals_split_groups(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "g string, i int, v int")
    order = [F.asc("i")]
    cut = sliced(df, ["g"], order, slices=7)
    assert cut.filter("g = 'hot'").select("_slice").distinct().count() > 3
    got = {(r.g, r.i): (r.total, r.top) for r in running(cut, ["g"], order, {
        "total": ("sum", F.col("v")), "top": ("max", F.when(F.col("v") > 90, F.col("v")))}).collect()}
    for g in {r[0] for r in rows}:
        total, top = 0, None
        for _, i, v in sorted(r for r in rows if r[0] == g):
            total, top = total + v, max(top or 0, v) if v > 90 else top
            assert got[(g, i)] == (total, top)


def test_lookup_salts_hot_keys(spark):
    rows = skewed()
    left = spark.createDataFrame(rows, "g string, i int, v int")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("other", 3)], "g string, w int")
    joined = lookup(left, right, ["g"], ["i"], hot_rows=50, salts=8)
    want = sorted((g, i, {"hot": 1, "k1": 2}.get(g)) for g, i, _ in rows)
    assert sorted((r.g, r.i, r.w) for r in joined.collect()) == want


def calls(spark, n=400):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else "b", i, rng.randrange(300) * 1_000_000, rng.choice([200, 200, 429, 500, 404]))
            for i in range(n)]
    df = spark.createDataFrame(rows, "caller string, call_id int, us long, status_code int")
    return rows, df.select("caller", "call_id", F.timestamp_micros("us").alias("ts"), "status_code",
                           F.lit(1.0).alias("duration_s"), F.lit(0.0).alias("waited_s"))


def test_sliding_requests_and_streaks(spark):
    rows, df = calls(spark)
    recent = {(r.caller, r.call_id): r.recent_requests for r in calllog.sliding_requests(df, 60, 15, slices=6).collect()}
    streak = {(r.caller, r.call_id): r.consecutive_errors for r in calllog.error_streak(df, slices=6).collect()}
    for caller in ("hot", "b"):
        mine, errors = sorted((us, i, s) for c, i, us, s in rows if c == caller), 0
        for place, (us, i, status) in enumerate(mine):
            assert recent[(caller, i)] == sum(us - e[0] <= 60_000_000 for e in mine[:place])
            errors = errors + 1 if status >= 400 else 0
            assert streak[(caller, i)] == errors


def test_budget_is_a_rank_prefix(spark):
    rng = random.Random(5)
    names = ["README.md", "main.py", "src/a.py", "src/b.py", "utils.py", "tests/test_a.py", "src/c.py", "docs/x.md"]
    rows = [(c, n, rng.randrange(1, 50)) for c in ("p", "q") for n in names]
    df = spark.createDataFrame(rows, "corpus_id string, path string, tokens int")
    rank = {(r.corpus_id, r.path): r.priority_rank for r in budget.priority_rank(df, slices=5).collect()}
    assert [rank[("p", n)] for n in ("README.md", "main.py", "docs/x.md", "utils.py", "tests/test_a.py")] == [1, 2, 3, 7, 8]
    kept = {(r.corpus_id, r.path) for r in budget.budget_fit(df, 90, slices=5).collect()}
    for c in ("p", "q"):
        total, want = 0, set()
        for _, n, t in sorted((r for r in rows if r[0] == c), key=lambda r: rank[(r[0], r[1])]):
            total += t
            if total > 90:
                break
            want.add((c, n))
        assert {k for k in kept if k[0] == c} == want
    assert budget.budget_fit(df, 0).count() == len(rows)


def test_requests_are_answered_within_their_corpus(spark, corpus):
    files = corpus(("README.md", "x"), corpus_id="b").union(corpus(("README.md", "yz"), ("a.py", "q"), corpus_id="c"))
    sizes = files.selectExpr("corpus_id", "path", "length(content) as size_bytes")
    wanted = spark.createDataFrame([("a", "README.md"), ("b", "README.md")], "corpus_id string, path string")
    from corpusforge.operators import filters, stats
    assert [r.corpus_id for r in filters.available(wanted, files).collect()] == ["b"]
    assert [r.corpus_id for r in filters.missing(wanted, files).collect()] == ["a"]
    assert {r.corpus_id: (r.total_files, r.total_size_bytes) for r in stats.corpus_stats(wanted, sizes).collect()} == {"a": (1, 0), "b": (1, 1)}


def test_invalid_bytes_go_and_genuine_replacement_characters_stay(spark):
    from corpusforge.functions.text import decode_utf8
    rows = spark.createDataFrame([(bytearray(b"a\xef\xbf\xbdb\xffc"),), (bytearray("ü�".encode()),)], "content binary")
    assert [r[0] for r in rows.select(decode_utf8(rows.content)).collect()] == ["a�bc", "ü�"]


def test_texts_behind_ranks_and_cache_keys_are_read_once(spark, tmp_path):
    """What is returned reads stored narrow rows, not the files again."""
    from corpusforge.functions import tokens
    from corpusforge.operators import cache
    from corpusforge.operators.reduce import reduce_levels
    rows = [("c", f"f{i}.txt", f"some words {i} " * 20) for i in range(50)]
    spark.createDataFrame(rows, "corpus_id string, path string, content string").write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    counted = tokens.add_tokens(files.withColumn("file_type", F.lit("text")), "content")
    known = cache.fingerprinted(files.limit(3), "light").select(*cache.KEY).selectExpr(
        "*", "'r' as reduced", "'m' as method", "1L as reduced_size", "2L as tokens")
    known.write.parquet(str(tmp_path / "known"))
    levels = budget.level_tokens(reduce_levels(files, budget.LEVELS_WEAK_TO_STRONG))
    for result in (budget.budget_fit(counted, 1000), budget.budget_level(levels, 1000),
                   cache.lookup_cached(cache.fingerprinted(files, "light"), spark.read.parquet(str(tmp_path / "known")))):
        plan = result._jdf.queryExecution().executedPlan().toString()
        assert f"{tmp_path}/files" not in plan and result.count() > 0
