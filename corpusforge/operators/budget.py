"""Priority ranks and token budgets per corpus, by running totals that split corpora of any size."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.paths import basename
from corpusforge.functions.scale import running, sliced
from corpusforge.session import stored

# Documented order: README and main files, then ordinary files, then helpers, then tests.
CRITICAL, ORDINARY, HELPER, TEST = 3, 2, 1, 0
LEVELS_WEAK_TO_STRONG = ["light", "medium", "aggressive"]


def importance(path: Column) -> Column:
    name = F.lower(basename(path))
    return (F.when(name.rlike(r"^(?:readme|main)(?:\.|\z)"), CRITICAL)
            .when(name.rlike(r"^test_|_test\.|\.test\.|\.spec\.") | path.rlike("(?:^|/)tests?/"), TEST)
            .when(name.rlike(r"^(?:utils?|helpers?)(?:\.|\z)"), HELPER).otherwise(ORDINARY))


def _order() -> list[Column]:
    return [F.desc("importance_score"), F.asc("path")]


def _cut(files: DataFrame, values: dict[str, Column], slices: int | None) -> DataFrame:
    """Narrow rows in rank order.  They are stored before their slices are drawn, so the text behind the counts is read once."""
    rows = files.select("corpus_id", "path", importance(F.col("path")).alias("importance_score"),
                        *[v.cast("bigint").alias(n) for n, v in values.items()])
    return sliced(stored(rows, "ranks"), ["corpus_id"], _order(), slices)


def _ranked(cut: DataFrame, names: list[str]) -> DataFrame:
    """Rank within the corpus and running sums of the named columns."""
    totals = {"priority_rank": ("sum", F.lit(1)), **{f"running_{n}": ("sum", F.col(n)) for n in names}}
    return running(cut, ["corpus_id"], _order(), totals).drop("_slice")


def priority_rank(files: DataFrame, slices: int | None = None) -> DataFrame:
    """corpus_id, path, importance_score, priority_rank (1 = first; ties by path)."""
    return _ranked(_cut(files, {}, slices), [])


def budget_fit(files: DataFrame, budget: int, tokens: str = "tokens", slices: int | None = None) -> DataFrame:
    """Files in rank order up to the first that would pass the budget of its corpus; 0 means no limit."""
    rows = _ranked(_cut(files, {"tokens": F.col(tokens)}, slices), ["tokens"])
    fits = F.lit(True) if budget == 0 else F.col("running_tokens") <= budget
    return rows.filter(fits)


def level_tokens(reduced: DataFrame) -> DataFrame:
    """Rows of ``reduce.reduce_levels`` to one row per file with the tokens of each level side by side."""
    return reduced.groupBy("corpus_id", "path").agg(*[
        F.max(F.when(F.col("level") == level, F.col("tokens"))).alias(f"tokens_{level}") for level in LEVELS_WEAK_TO_STRONG])


def budget_level(files: DataFrame, budget: int, slices: int | None = None) -> DataFrame:
    """Per corpus, the weakest level at which all files fit the budget, else the strongest; then the budget prefix.

    ``files`` carries tokens_light, tokens_medium and tokens_aggressive.  Result rows name the chosen level and say
    whether the file is kept.
    """
    columns = {level: F.col(f"tokens_{level}") for level in LEVELS_WEAK_TO_STRONG}
    cut = _cut(files, columns, slices)
    totals = cut.groupBy("corpus_id").agg(*[F.sum(n).alias(f"total_{n}") for n in columns])
    chosen = F
    for level in LEVELS_WEAK_TO_STRONG[:-1]:
        chosen = chosen.when((F.lit(budget) == 0) | (F.col(f"total_{level}") <= budget), level)
    levels = totals.select("corpus_id", chosen.otherwise(LEVELS_WEAK_TO_STRONG[-1]).alias("level"))
    rows = _ranked(cut, list(columns)).join(levels, "corpus_id")
    tokens, total = F, F
    for level in LEVELS_WEAK_TO_STRONG:
        tokens = tokens.when(F.col("level") == level, F.col(level))
        total = total.when(F.col("level") == level, F.col(f"running_{level}"))
    return (rows.withColumn("tokens", tokens).withColumn("running_tokens", total)
            .withColumn("kept", (F.lit(budget) == 0) | (F.col("running_tokens") <= budget))
            .select("corpus_id", "path", "importance_score", "priority_rank", "level", "tokens", "running_tokens",
                    "kept"))
