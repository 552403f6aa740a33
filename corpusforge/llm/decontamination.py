"""Benchmark decontamination: one Aho-Corasick automaton over the word windows of all test items."""

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.llm.arrow_text import LOWER, Words, chunks, worker_path
from corpusforge.session import stored

WIDTH = 10
#: Windows in one automaton (about ten nodes each): the bound of what is broadcast.  More windows take more automata.
MAX_WINDOWS = 400_000
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS = np.ones(256, bool)
_GAPS[48:58] = _GAPS[97:123] = _GAPS[128:] = False
_FIELDS = [T.StructField("n_words", T.LongType()),
           T.StructField("runs", T.ArrayType(T.ArrayType(T.LongType()))),
           T.StructField("items", T.ArrayType(T.StringType()))]


def item_windows(items: DataFrame, item_id: str = "item_id", texts: tuple[str, ...] = ("text",),
                 width: int = WIDTH) -> DataFrame:
    """(window, item): every run of ``width`` words of each question or answer, or all words of a shorter one."""
    each = items.select(F.col(item_id).cast("string").alias("item"), F.explode(F.array(*[F.col(t) for t in texts])).alias("_t"))
    words = F.regexp_extract_all(F.translate("_t", _UPPER, _LOWER), F.lit(_WORD), F.lit(0))
    begins = F.sequence(F.lit(1), F.greatest(F.size("_w") - width + 1, F.lit(1)))
    return (each.select("item", words.alias("_w")).filter(F.size("_w") > 0)
            .select("item", F.explode(F.transform(begins, lambda i: F.array_join(F.slice("_w", i, width), " "))).alias("window"))
            .distinct())


def _automaton(windows: list[tuple[str, list[str]]]):
    """Word numbers, and the automaton over windows as sequences of word numbers; 0 is any other word."""
    numbers: dict[bytes, int] = {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for window, owners in windows:
        key = tuple(numbers.setdefault(w, len(numbers) + 1) for w in window.encode().split(b" "))
        automaton.add_word(key, (len(key), owners))
    if windows:
        automaton.make_automaton()
    return numbers, automaton if windows else None


def _scan(shared, text: str):
    """Batches with n_words, runs ([first word, last word + 1, first byte, last byte + 1] of hit text) and items."""
    def found(numbers, automaton, words, i, row_runs, row_items):
        a, b = words.first[i], words.first[i + 1]
        base = words.offsets[i]
        marks, owners = np.zeros(b - a + 1, np.int64), set(row_items)
        for run in row_runs:
            marks[run[0]] += 1
            marks[run[1]] -= 1
        if automaton is not None and b > a:
            data = words.data[base:words.offsets[i + 1]].tobytes()
            number = numbers.get
            spans = zip((words.starts[a:b] - base).tolist(), (words.stops[a:b] - base).tolist(), strict=True)
            sequence = tuple([number(data[s:e], 0) for s, e in spans])
            if any(sequence):
                for last, (length, names) in automaton.iter(sequence):
                    marks[last + 1 - length] += 1
                    marks[last + 1] -= 1
                    owners.update(names)
        covered = np.concatenate([[False], np.cumsum(marks[:-1]) > 0, [False]])
        edges = np.flatnonzero(covered[1:] != covered[:-1]).reshape(-1, 2)
        runs = [[int(s), int(e), int(words.starts[a + s] - base), int(words.stops[a + e - 1] - base)] for s, e in edges]
        return b - a, runs, sorted(owners)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, automaton = shared.value
        for whole in batches:
            for batch in chunks(whole, text):
                words = Words(batch.column(text), _GAPS, LOWER)
                old_runs = batch.column("runs").to_pylist()
                old_items = batch.column("items").to_pylist()
                got = [found(numbers, automaton, words, i, old_runs[i], old_items[i]) for i in range(batch.num_rows)]
                kept = [batch.column(k) for k in range(batch.num_columns - 3)]
                yield pa.RecordBatch.from_arrays(kept + [
                    pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.list_(pa.list_(pa.int64()))),
                    pa.array([g[2] for g in got], pa.list_(pa.string()))], names=batch.schema.names)
    return scan


def matches(docs: DataFrame, items: DataFrame, text: str = "text", width: int = WIDTH,
            item_id: str = "item_id", item_texts: tuple[str, ...] = ("text",)) -> DataFrame:
    """``docs`` as one struct column ``row``, with n_words, runs and items.

    A run is [first word, last word + 1, first byte, last byte + 1] of text that item windows cover; bytes are those of
    the unchanged text in UTF-8 (lower-casing A-Z keeps them).  ``items`` are the ids with a window in the text.  Null
    and empty texts have no words; items without words never match; equal items are all named.  All columns of ``docs``
    are kept inside ``row``, so no name can clash.  Each text is read once for every MAX_WINDOWS windows.
    """
    spark = docs.sparkSession
    worker_path(spark)
    windows = stored(item_windows(items, item_id, item_texts, width).groupBy("window").agg(
        F.sort_array(F.collect_set("item")).alias("owners")), "benchmark-windows")
    parts = max(1, -(-windows.count() // MAX_WINDOWS))
    df = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text].alias("_text"),
                     F.lit(0).cast("long").alias("n_words"), F.array().cast(_FIELDS[1].dataType).alias("runs"),
                     F.array().cast(_FIELDS[2].dataType).alias("items"))
    for part in range(parts):
        mine = windows.filter(F.pmod(F.xxhash64("window"), F.lit(parts)) == part).collect()
        shared = spark.sparkContext.broadcast(_automaton([(r["window"], r["owners"]) for r in mine]))
        df = df.mapInArrow(_scan(shared, "_text"), df.schema)
        if part < parts - 1:
            df = stored(df, "benchmark-pass")
    return df.drop("_text")


def decontaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` whose text holds no window of any item, with their columns as they were."""
    return matches(docs, items, **options).filter(F.size("runs") == 0).select("row.*")


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda total, run: total + run[1] - run[0])
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"),
                        F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
                        (F.size("runs") > 0).alias("contaminated"))


_SQL_WORDS = (f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), "
              r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
ORACLE = f"""
with item_words as (select cast(item_id as varchar) as item, {_SQL_WORDS} as w from benchmark),
windows as (
  select distinct item, least(len(w), {WIDTH}) as n, array_to_string(w[i:i + {WIDTH - 1}], ' ') as win
  from (select item, w, unnest(range(1, greatest(len(w) - {WIDTH - 1}, 1) + 1)) as i from item_words where len(w) > 0)),
doc_words as (select doc_id, {_SQL_WORDS} as w from documents),
places as (
  select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as win
  from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from doc_words), (select distinct n from windows)
  where i + n - 1 <= len(w)),
hits as (select p.doc_id, p.i, p.n, v.item from places p join windows v on p.win = v.win and p.n = v.n),
hit_words as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from hits) group by doc_id),
hit_items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names
              from (select distinct doc_id, item from hits) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc_words d left join hit_words using (doc_id) left join hit_items using (doc_id)
"""
