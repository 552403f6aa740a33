"""Token-ID files: each document's ids compressed on their own with one shared dictionary, and an offset index.

A file set is a folder with three Parquet tables:

- ``dictionary``: sha256, data (a zstandard dictionary trained on serialized id arrays; at most DICTIONARY_BYTES);
- ``blocks``: slice, block, dictionary_sha256, first_id, last_id, n_tokens, then the index (doc_ids, counts, offsets:
  document k of the block is ``payload[offsets[k]:offsets[k + 1]]``) and payload, the frames one after the other;
- ``starts``: slice, block, start (tokens of all blocks before this one).

Blocks ascend by document id, nulls first.  Ids are little-endian unsigned 32-bit integers before compression.  One
document needs its block's row (found by first_id and last_id, which Parquet prunes on) and one frame of it.
"""

import gc
import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.functions.scale import running, sliced
from corpusforge.llm.arrow_text import chunks, worker_path
from corpusforge.session import new_folder, stored

#: The dictionary is trained on this many documents at most (lowest hashes of their ids), each of at most so many bytes.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 16_384, 65_536
LEVEL = 3
END_ID = 2
#: A block ends at the document that fills it; a longer document is a block of its own.
BLOCK_BYTES, BLOCK_DOCS = 4 << 20, 4096
#: Words whose ids a Python worker remembers between documents and tasks, in each of two generations.
CACHE_WORDS = 400_000
_cache: dict[str, tuple] = {}


class _Encoder:
    """Ids of whole texts by the tokenizers library, which is asked once for every distinct word.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words in turn.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer, self.words, self.older = Tokenizer.from_file(path), {}, {}

    def learn(self, wanted: set[bytes]) -> None:
        """Have the ids of all these words at hand; a full generation makes way, and its words stay while they are used."""
        if len(self.words) > CACHE_WORDS:
            self.older, self.words = self.words, {}
        missing = wanted.difference(self.words)
        self.words.update((w, self.older[w]) for w in missing if w in self.older)
        words = list(missing.difference(self.words))
        for k in range(0, len(words), 4096):
            part = words[k:k + 4096]
            got = self.tokenizer.encode([w.decode("utf-8", "replace") for w in part], is_pretokenized=True,
                                        add_special_tokens=False)
            ids = np.array(got.ids, "<u4").tobytes()
            owner = np.array(got.word_ids, np.int64)
            cuts = (np.searchsorted(owner, np.arange(len(part) + 1)) * 4).tolist()
            self.words.update(zip(part, [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Serialized ids of every text."""
        split = [t.split() for t in texts]
        # A great many small objects and no rings among them: looking for rings takes a quarter of the time.
        gc.disable()
        try:
            self.learn(set().union(*split))
        finally:
            gc.enable()
        known = self.words
        for words in split:
            yield b"".join([known[w] for w in words])


def _encoder(path: str) -> _Encoder:
    if path not in _cache:
        _cache.clear()
        _cache[path] = _Encoder(path)
    return _cache[path]


def _encoded(docs: DataFrame, tokenizer: str, end_id: int, frames) -> DataFrame:
    """doc_id, n_tokens, frame; ``frames`` is None for plain ids or a broadcast dictionary."""
    worker_path(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        pack = compressor(frames.value).compress if frames is not None else bytes
        for whole in batches:
            for batch in chunks(whole, "text", 1 << 20):
                texts = [t or b"" for t in batch.column("text").to_pylist()]
                ids = [i + end for i in encoder.encode(texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()),
                     pa.array([pack(i) for i in ids], pa.binary())], names=["doc_id", "n_tokens", "frame"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, frame binary")


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary),
                                    write_content_size=True, write_checksum=False)


def decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> bytes:
    """A dictionary from a bounded sample; samples too few or too even for training serve as raw content."""
    drawn = docs.filter(F.octet_length("text") <= SAMPLE_BYTES).withColumn("_draw", F.xxhash64("doc_id", "text"))
    last = drawn.select("_draw").distinct().orderBy("_draw").limit(SAMPLE_DOCS).agg(F.max("_draw")).first()[0]
    # Equal rows have equal draws: one of each, so at most SAMPLE_DOCS.
    sample = drawn.filter(F.col("_draw") <= last).dropDuplicates(["_draw"]).select("doc_id", "text")
    ids = sorted(bytes(r["frame"]) for r in _encoded(sample, tokenizer, end_id, None).collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, ids).as_bytes()
    except zstandard.ZstdError:
        return b"".join(ids)[:DICTIONARY_BYTES]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Write (doc_id, text) as a file set.  Null text is empty; equal ids stay separate documents, by their content."""
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer, end_id)
    name = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(name, dictionary)], "sha256 string, data binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    rows = stored(_encoded(docs, tokenizer, end_id, spark.sparkContext.broadcast(dictionary)).withColumn(
        "tie", F.xxhash64("frame")), "token-rows")
    # The bounds of the slices are drawn from two numbers a row; frames only order equal ones inside a slice.
    order = [F.asc_nulls_first("doc_id"), F.asc("tie")]
    ranged = (rows.repartitionByRange(*order).sortWithinPartitions(*order, "frame").drop("tie")
              .withColumn("slice", F.spark_partition_id()))

    def block(slice_no: int, number: int, ids: list, counts: list, frames: list) -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).tolist()
        known = [i for i in ids if i is not None]
        one = {"slice": slice_no, "block": number, "dictionary_sha256": name, "first_id": min(known, default=None),
               "last_id": max(known, default=None), "n_tokens": sum(counts), "doc_ids": ids, "counts": counts,
               "offsets": offsets, "payload": b"".join(frames)}
        return pa.RecordBatch.from_pylist([one], schema=pa.schema([
            ("slice", pa.int32()), ("block", pa.int32()), ("dictionary_sha256", pa.string()), ("first_id", pa.int64()),
            ("last_id", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
            ("counts", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary())]))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, frames, size, number, slice_no = [], [], [], 0, 0, 0
        for batch in batches:
            for doc_id, n, frame, slice_no in zip(*[batch.column(c).to_pylist() for c in
                                                    ("doc_id", "n_tokens", "frame", "slice")], strict=True):
                ids.append(doc_id)
                counts.append(n)
                frames.append(frame)
                size += len(frame)
                if size >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                    yield block(slice_no, number, ids, counts, frames)
                    ids, counts, frames, size, number = [], [], [], 0, number + 1
        if ids:
            yield block(slice_no, number, ids, counts, frames)

    ranged.mapInArrow(build, "slice int, block int, dictionary_sha256 string, first_id long, last_id long, n_tokens long, "
                      "doc_ids array<long>, counts array<long>, offsets array<long>, payload binary").write.option(
        "compression", "none").parquet(f"{folder}/blocks")
    order = [F.col("slice"), F.col("block")]
    sizes = spark.read.parquet(f"{folder}/blocks").select("slice", "block", "n_tokens")
    starts = running(sliced(sizes, [], order), [], order, {"_end": ("sum", F.col("n_tokens"))})
    starts.select("slice", "block", (F.col("_end") - F.col("n_tokens")).alias("start")).write.parquet(f"{folder}/starts")


def _unpacked(blocks: DataFrame, folder: str, schema: str, values) -> DataFrame:
    """Rows (doc_id, start, n_tokens, *values(ids bytes)) of every document in the given blocks."""
    spark = blocks.sparkSession
    worker_path(spark)
    # One row of at most DICTIONARY_BYTES by construction.
    dictionaries = spark.sparkContext.broadcast(
        {r["sha256"]: bytes(r["data"]) for r in spark.read.parquet(f"{folder}/dictionary").collect()})
    placed = blocks.join(spark.read.parquet(f"{folder}/starts"), ["slice", "block"]).select(
        "dictionary_sha256", "start", "doc_ids", "counts", "offsets", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ones = {name: decompressor(data) for name, data in dictionaries.value.items()}
        for batch in batches:
            for k in range(batch.num_rows):
                name, start, ids, counts, offsets, payload = [batch.column(c)[k].as_py() for c in range(6)]
                firsts = (np.cumsum([0, *counts[:-1]]) + start).tolist()
                view, unpack = memoryview(payload), open_ones[name].decompress
                found = [values(unpack(view[a:b])) for a, b in zip(offsets, offsets[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(firsts, pa.int64()), pa.array(counts, pa.int64()),
                     *[pa.array(v) for v in zip(*found, strict=True)]], names=names)

    names = [part.split()[0] for part in f"doc_id long, start long, n_tokens long, {schema}".split(", ")]
    return placed.mapInArrow(run, f"doc_id long, start long, n_tokens long, {schema}")


def read_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of a file set: doc_id, start, n_tokens (as counted in the file), ids_crc32 of the ids read back."""
    return _unpacked(spark.read.parquet(f"{folder}/blocks"), folder, "ids_crc32 long, n_read long",
                     lambda ids: (zlib.crc32(ids), len(ids) // 4))


def read_documents(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """doc_id, start, n_tokens, ids (serialized) of chosen documents; only blocks that may hold them are read."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    wanted = F.lit(False)
    for doc_id in doc_ids:
        wanted = wanted | ((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    return _unpacked(blocks.filter(wanted), folder, "ids binary", lambda ids: (ids,)).filter(F.col("doc_id").isin(doc_ids))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def token_files(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` to a new file set in the shared folder and read it back."""
    spark = docs.sparkSession
    folder = new_folder(spark, "token-files")
    write_token_files(docs, folder, tokenizer or tokenizer_path())
    return read_summary(spark, folder)


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    return token_files(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
