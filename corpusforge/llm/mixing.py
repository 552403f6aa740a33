"""Mixing sources to target weights: copies of each document by its source's repetition rate."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.scale import running, sliced
from corpusforge.session import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                   most: float = MOST) -> DataFrame:
    """Tokens to take from every source: (source, source_size, target, rate).

    ``sizes`` has (source, size), one row per document.  Sources in code point order, null last, take the ``weights``
    in turn.  All targets together are ``share`` of all sizes.  A target stops at ``most`` times its source; the excess
    goes to the others by weight until none is above, so target = min(most * size, level * weight) for one level.  That
    level is the largest of (wanted - capped sizes) / (weights left) over all prefixes of the sources in the order in
    which they reach their stop.  A source without tokens has target and rate 0.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = [F.col("source").asc_nulls_last()]
    ranked = running(sliced(totals, [], by_name), [], by_name, {"_rank": ("sum", F.lit(1))})
    turn = F.array(*[F.lit(float(w)) for w in weights])
    stops = (ranked.withColumn("_weight", F.element_at(turn, (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int")))
             .withColumn("_stop", F.col("source_size") * F.lit(float(most)))
             .withColumn("_ratio", F.col("_stop") / F.col("_weight")))
    by_ratio = [F.col("_ratio"), F.col("_rank")]
    filled = running(sliced(stops, [], by_ratio), [], by_ratio,
                     {"_stopped": ("sum", F.col("_stop")), "_used": ("sum", F.col("_weight"))})
    whole = filled.agg(F.sum("source_size").alias("size"), F.sum("_weight").alias("weight")).first()
    wanted = float(share) * (whole["size"] or 0)
    left = F.lit(float(whole["weight"] or 0)) - (F.col("_used") - F.col("_weight"))
    level = filled.agg(F.max((F.lit(wanted) - (F.col("_stopped") - F.col("_stop"))) / left)).first()[0] or 0.0
    target = F.least(F.col("_stop"), F.lit(float(level)) * F.col("_weight"))
    return filled.select("source", "source_size", target.alias("target"), F.when(
        F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(most)))).otherwise(0.0).alias("rate"))


def copies(doc_id: Column, text: Column, rate: Column, seed: str = SEED) -> Column:
    """floor(rate) and one more with the fraction as probability, decided by a hash of the id (of the text without id)."""
    key = F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.md5(text), F.lit("")))
    drawn = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    return (F.floor(rate) + F.when(drawn < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def _with_rates(df: DataFrame, sizes: DataFrame, **options) -> DataFrame:
    """Join each row to its source's figures; the table is read from files, so it is only broadcast when it is small."""
    targets = stored(source_targets(sizes, **options), "mix-targets").withColumnRenamed("source", "_source")
    return df.join(targets, df["source"].eqNullSafe(targets["_source"])).drop("_source")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, rate, copies, taken (tokens with repeats).

    Null texts count as empty, null sources are one source, repeated rows are separate documents with the same draw.
    No rows give no rows; other columns of ``docs`` are not read.
    """
    narrow = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.when(
        F.col("doc_id").isNull(), F.col("text")).alias("_text")), "mix-sizes")
    return (_with_rates(narrow, narrow.select("source", "size"), **options)
            .withColumn("copies", copies(F.col("doc_id"), F.col("_text"), F.col("rate")))
            .withColumn("taken", F.col("copies") * F.col("size")).drop("_text"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs``, with all its columns, as often as its source's rate says (maybe never)."""
    columns = docs.columns
    sizes = stored(docs.select("source", word_count(F.col("text")).alias("size")).groupBy("source").agg(
        F.sum("size").alias("size")), "mix-sources")
    packed = docs.select("source", F.struct(*[docs[c] for c in columns]).alias("_row"))
    rated = _with_rates(packed, sizes, **options).select("_row", copies(
        F.col("_row.doc_id"), F.col("_row.text"), F.col("rate")).alias("_copies"))
    return (rated.filter("_copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
            .select("_row.*"))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """Mix all documents; contract columns first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_report(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


ORACLE = f"""
with sizes as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size from documents),
totals as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as n
  from sizes group by source),
weighted as (select *, case (n - 1) % 3 when 0 then 5e0 when 1 then 2e0 else 1e0 end as weight, source_size * 2e0 as stop from totals),
filled as (
  select *, sum(stop) over w - stop as stopped, sum(weight) over () - (sum(weight) over w - weight) as weight_left,
         1.5e0 * cast(sum(source_size) over () as double) as wanted
  from weighted window w as (order by stop / weight, n rows unbounded preceding)),
targets as (
  select *, least(stop, (select max((wanted - stopped) / weight_left) from filled) * weight) as target from filled),
rates as (select *, case when source_size > 0 then least(target / source_size, 2e0) else 0e0 end as rate from targets),
drawn as (
  select d.doc_id, d.size, r.source_size, r.target, d.source, r.rate,
         cast('0x' || substr(md5('{SEED}|' || cast(d.doc_id as varchar)), 1, 13) as bigint) / 4503599627370496e0 as u
  from sizes d join rates r on d.source is not distinct from r.source)
select doc_id, size, source_size, target, source,
       cast(floor(rate) as bigint) + case when u < rate - floor(rate) then 1 else 0 end as copies,
       size * (cast(floor(rate) as bigint) + case when u < rate - floor(rate) then 1 else 0 end) as taken
from drawn
"""
