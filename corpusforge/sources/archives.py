"""Archives: Parquet tables as the native layout, JSON documents for exchange, and extraction to files."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge import fixed_values as fv
from corpusforge.functions.paths import normalise
from corpusforge.functions.scale import running, sliced
from corpusforge.operators.stats import archive_totals
from corpusforge.session import shuffle_partitions
from corpusforge.sources.stores import open_target

ENTRY = ("path string, content string, original_size_bytes bigint, compressed_size_bytes bigint, estimated_tokens bigint, "
         "compression_method string, compression_ratio double, importance_score int, last_modified_utc string")
METADATA = (f"{fv.VERSION_KEY} string, archive_uuid string, creation_timestamp_utc string, source_tool_version string, "
            "compression_level_setting string, max_tokens_setting int, total_files bigint, total_original_size_bytes bigint, "
            "total_compressed_size_bytes bigint, total_estimated_tokens bigint")
DOCUMENT = (f"struct<metadata:struct<{METADATA.replace(' ', ':').replace(',:', ',')}>,"
            f"files:array<struct<{ENTRY.replace(' ', ':').replace(',:', ',')}>>>")
#: JSON readers stop at strings of 20 million characters unless told otherwise.
READING = {"mode": "PERMISSIVE", "maxStringLen": "2147483647"}
#: Files that an archive of any size is dealt over at most.
SPREAD = 64
ENTRY_COLUMNS = [c.split()[0] for c in ENTRY.split(", ")]


def archive_entries(reduced: DataFrame, modified: Column | None = None) -> DataFrame:
    """Reduced rows as archive entries; the corpus is the archive."""
    finite = F.when(F.col("ratio") != float("inf"), F.col("ratio"))
    stamp = F.date_format(modified, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'") if modified is not None else F.lit(None)
    score = F.col("importance_score") if "importance_score" in reduced.columns else F.lit(0)
    return reduced.select(
        F.col("corpus_id").alias("archive_id"), "path", F.col("reduced").alias("content"),
        F.col("original_size").alias("original_size_bytes"), F.col("reduced_size").alias("compressed_size_bytes"),
        F.col("tokens").alias("estimated_tokens"), F.col("method").alias("compression_method"),
        finite.alias("compression_ratio"), score.cast("int").alias("importance_score"),
        stamp.cast("string").alias("last_modified_utc"))


def archive_metadata(entries: DataFrame, level: str, max_tokens: int = 0, created: str | None = None,
                     tool: str = "corpusforge") -> DataFrame:
    """One metadata row per archive with its totals."""
    created_at = F.lit(created) if created else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return archive_totals(entries).select(
        "archive_id", F.lit(fv.FORMAT_VERSION).alias(fv.VERSION_KEY), F.col("archive_id").alias("archive_uuid"),
        created_at.alias("creation_timestamp_utc"), F.lit(tool).alias("source_tool_version"),
        F.lit(level).alias("compression_level_setting"), F.lit(max_tokens).alias("max_tokens_setting"),
        "total_files", "total_original_size_bytes",
        "total_compressed_size_bytes", "total_estimated_tokens")


def write_archives(entries: DataFrame, archives: DataFrame, folder: str, files: int | None = None) -> None:
    """Native layout: entries and metadata as Parquet.

    Entries lie in ``files`` files (the shuffle width unless given), however many archives there are, sorted by archive and
    path, so that one archive is found by the files' own statistics.  Every archive is dealt over SPREAD files, so none makes one of them large.
    """
    salt = F.pmod(F.xxhash64("path"), F.lit(SPREAD))
    dealt = entries.repartition(files or shuffle_partitions(entries.sparkSession), "archive_id", salt)
    dealt.sortWithinPartitions("archive_id", "path").write.mode("errorifexists").parquet(f"{folder}/archive_files")
    archives.write.mode("errorifexists").parquet(f"{folder}/archives")


def read_archives(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Entries and metadata that ``write_archives`` wrote."""
    entries = spark.read.schema(f"archive_id string, {ENTRY}").parquet(f"{folder}/archive_files")
    return entries, spark.read.schema(f"archive_id string, {METADATA}").parquet(f"{folder}/archives")


def archive_documents(entries: DataFrame, archives: DataFrame, volume_bytes: int = 16 << 20,
                      slices: int | None = None) -> DataFrame:
    """archive_id, volume, document: JSON documents with entries in path order.

    An archive is cut into volumes of about ``volume_bytes`` of text by a running total of sizes, so no task ever gathers more
    than a volume plus one entry; escaped, text takes six times its bytes at most.  Archives that fit one volume give the single-document form; every volume repeats
    the metadata of the whole archive.
    """
    order = [F.asc("path")]
    sizes = entries.select("archive_id", "path", F.col("compressed_size_bytes").alias("size"))
    placed = running(sliced(sizes, ["archive_id"], order, slices), ["archive_id"], order, {"end": ("sum", F.col("size"))})
    volumes = placed.select("archive_id", "path", F.floor((F.col("end") - F.col("size")) / volume_bytes).alias("volume"))
    entry = F.struct(*ENTRY_COLUMNS)
    gathered = (entries.join(volumes, ["archive_id", "path"]).groupBy("archive_id", "volume")
                .agg(F.array_sort(F.collect_list(entry)).alias("files")))
    metadata = archives.select("archive_id", F.struct(*[c for c in archives.columns if c != "archive_id"]).alias("metadata"))
    document = F.to_json(F.struct("metadata", "files"), {"ignoreNullFields": "false"})
    return gathered.join(metadata, "archive_id").select("archive_id", "volume", document.alias("document"))


def write_documents(documents: DataFrame, folder: str) -> None:
    """One document per line (line feeds are escaped inside JSON), partitioned by archive."""
    documents.select("archive_id", F.col("document").alias("value")).write.partitionBy("archive_id").text(folder)


def read_documents(spark: SparkSession, target: str, whole_files: bool = True) -> DataFrame:
    """(archive_id, document) rows; a missing target raises.  Whole files suit indented JSON."""
    rows = spark.read.text(target, wholetext=whole_files)
    archive = F.col("archive_id").cast("string") if "archive_id" in rows.columns else F.input_file_name()
    return rows.select(archive.alias("archive_id"), F.col("value").alias("document"))


def parse_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of the readable documents and one metadata row per archive (all its volumes carry the same one).

    audit_archives reports the other documents.
    """
    parsed = documents.withColumn("d", F.from_json("document", DOCUMENT, READING))
    good = parsed.filter(F.col(f"d.metadata.{fv.VERSION_KEY}").isNotNull() & F.col("d.files").isNotNull())
    return good.select("archive_id", F.inline("d.files")), good.select("archive_id", "d.metadata.*").dropDuplicates(["archive_id"])


def safe_path(path: Column) -> Column:
    """Path below the output folder, or null when it would leave it; leading slashes collapse."""
    relative = normalise(F.regexp_replace(path, "^/+", ""))
    return F.when(~relative.rlike(r"^\.\.(?:/|\z)") & (relative != "."), relative)


def extract_plan(entries: DataFrame, pattern: str | None = None) -> DataFrame:
    """What extraction does with each entry: write, skip_empty (no path), skip_pattern or skip_unsafe."""
    target = safe_path(F.col("path"))
    skipped = F.when(F.coalesce("path", F.lit("")) == "", "skip_empty")
    if pattern:
        skipped = skipped.when(~F.col("path").rlike(pattern), "skip_pattern")
    action = skipped.when(target.isNull(), "skip_unsafe").otherwise("write")
    rows = entries.withColumn("action", action)
    return rows.select("archive_id", "path", F.when(F.col("action") == "write", target).alias("safe_path"), "action",
                       F.coalesce("content", F.lit("")).alias("content"))


def archive_folder(archive_id: Column) -> Column:
    """A folder name for an archive: different ids have different names, and every name stays one folder below the base."""
    escaped = F.replace(F.replace(archive_id, F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F"))
    return (F.when(archive_id.isNull(), "%N").when(archive_id == "", "%").when(archive_id.isin(".", ".."), F.replace(archive_id, F.lit("."), F.lit("%2E")))
            .otherwise(escaped))


def extract_files(plan: DataFrame, base: str, apart: bool = False) -> None:
    """Write every planned file below ``base``, on any storage there is a handle for.  Retries overwrite.

    With ``apart`` each archive has a folder of its own (``archive_folder``); without, more than one archive raises.  Entries of
    an archive that come to one file give the last of them by path, then content.  A base without scheme is on the session's
    default file system.
    """
    if not apart and plan.agg(F.count_distinct(F.coalesce("archive_id", F.lit("")))).first()[0] > 1:
        raise ValueError("several archives need folders of their own: extract them apart")
    store, folder = open_target(plan.sparkSession, base)

    def write(rows):
        made = set()
        for row in rows:
            store.write(folder.rstrip(b"/") + b"/" + row.target.encode(), row.content.encode(), made)

    target = F.concat(archive_folder(F.col("archive_id")), F.lit("/"), F.col("safe_path")) if apart else F.col("safe_path")
    # One task writes a file, whatever entries name it.
    last = plan.filter("action = 'write'").groupBy(target.alias("target")).agg(F.max(F.struct("path", "content")).alias("last"))
    last.select("target", "last.content").foreachPartition(write)
