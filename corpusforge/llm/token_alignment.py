"""Alignment of two tokenizers' tokens by lockstep vectorised merging, and how well corpus-wide id pairs back each link.

Both tokenizers cover the same bytes, so their token ends are two ascending lists of byte offsets.  One state vector holds a
pointer into each list for every document of a batch; a step emits a link for all of them at once, a cut where both tokens
end together, and moves the pointers of the tokens that end first.  Finished entries are compacted away.  A long document
has an entry for every LANE bytes, which start where a merge of the whole would stand, so it does not hold up its batch.
"""

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.arrow_text import chunks, worker_path
from corpusforge.session import stored

#: Bytes of a document per entry of the state vector.
LANE = 512
#: Id pairs whose counts are broadcast: the most frequent ones.  Links of all other pairs are joined with their counts.
FREQUENT = 1 << 19
#: Distinct pairs that a task gathers before it passes them on.
GATHER = 1_000_000
#: A pair is ``a * IDS + b``; 64-bit, so any vocabularies up to this size fit.
IDS = 1 << 31
_LAST = np.iinfo(np.int64).max
_cache: dict[tuple, tuple] = {}


class ByteLevel:
    """Ids of a byte-level BPE tokenizer file of the tokenizers library.

    tiktoken runs the same merges (its ranks are the file's ids) several times faster; it is asked for texts of Latin letters
    and signs, whose character classes never changed, and the tokenizers library for all others and for what tiktoken refuses.
    """

    #: First UTF-8 byte of the characters from U+0280 on.
    BEYOND = 0xCA
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        special = {i for i, t in self.slow.get_added_tokens_decoder().items() if t.special}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
        ranks = {bytes(byte[c] for c in token): i for token, i in self.slow.get_vocab(with_added_tokens=True).items() if i not in special}
        self.fast = tiktoken.Encoding("plain", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.pieces[i] = token

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        return [self._one(t) for t in texts]

    def _one(self, text: bytes) -> np.ndarray:
        whole = (b" " + text).decode("utf-8", "replace")
        if len(text) and np.frombuffer(text, np.uint8).max() < self.BEYOND:
            try:
                return self.fast.encode_to_numpy(whole, disallowed_special=()).astype(np.int64)
            except ValueError:  # a run of white space beyond its stack
                pass
        return np.array(self.slow.encode(whole, add_special_tokens=False).ids, np.int64)


class Pieces:
    """Ids of a sentencepiece model, which adds the space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [(self.model.id_to_piece(i), self.model.is_byte(i)) for i in range(self.model.get_piece_size())]
        self.pieces = [bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in names]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(i, np.int64) for i in self.model.encode([t.decode("utf-8", "replace") for t in texts], num_threads=1)]


def _encoders(a_path: str, b_path: str) -> tuple[ByteLevel, Pieces]:
    if (a_path, b_path) not in _cache:
        _cache.clear()
        _cache[a_path, b_path] = (ByteLevel(a_path), Pieces(b_path))
    return _cache[a_path, b_path]


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, starts: np.ndarray, stops: np.ndarray):
    """Merge all entries at once; entry k covers the bytes ``starts[k] < end <= stops[k]``.

    Gives the links, as places in a_ends and b_ends, and the cuts: the places of tokens that end together.
    """
    a, b = np.searchsorted(a_ends, starts, "right"), np.searchsorted(b_ends, starts, "right")
    a_ends, b_ends = np.append(a_ends, _LAST), np.append(b_ends, _LAST)
    links, cuts = [], []
    while len(a):
        a_end, b_end = a_ends[a], b_ends[b]
        live = np.minimum(a_end, b_end) <= stops
        if not live.all():
            a, b, stops, a_end, b_end = (x[live] for x in (a, b, stops, a_end, b_end))
        links.append((a, b))
        both = a_end == b_end
        cuts.append((a[both], b[both]))
        a, b = a + (a_end <= b_end), b + (b_end <= a_end)
    empty = (np.zeros(0, np.int64),) * 2
    return tuple(tuple(np.concatenate(x) for x in zip(*(found or [empty]), strict=True)) for found in (links, cuts))


class Aligned:
    """Tokens, links and cuts of a batch of texts; a text without tokens on one side has none on either.

    ``a_ids`` and ``b_ids`` are the ids of all texts in turn, ``a_first`` and ``b_first`` the bounds of each text's; links are
    places in them (``link_a``, ``link_b``), and the tokens at ``cut_a`` and ``cut_b`` end a group.
    """

    def __init__(self, texts: list[bytes | None], a: ByteLevel, b: Pieces):
        texts = [t or b"" for t in texts]
        a_all, b_all = a.encode(texts), b.encode(texts)
        for k, text in enumerate(texts):
            whole = b" " + text
            if not text or any(b"".join(map(side.pieces.__getitem__, ids[k].tolist())) != whole
                               for side, ids in ((a, a_all), (b, b_all))):
                a_all[k] = b_all[k] = np.zeros(0, np.int64)
                texts[k] = None
        none = np.zeros(0, np.int64)
        self.a_ids, self.b_ids = (np.concatenate(x) if x else none for x in (a_all, b_all))
        self.a_first, self.b_first = (np.concatenate([[0], np.cumsum([len(i) for i in x], dtype=np.int64)]) for x in (a_all, b_all))
        size = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        ends = np.cumsum(size)
        a_ends, b_ends = (np.cumsum(np.array(list(map(len, side.pieces)), np.int64)[ids])
                          for side, ids in ((a, self.a_ids), (b, self.b_ids)))
        lanes = -(-size // LANE)
        at = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        starts = np.repeat(ends - size, lanes) + at * LANE
        stops = np.minimum(starts + LANE, np.repeat(ends, lanes))
        (self.link_a, self.link_b), (cut_a, cut_b) = lockstep(a_ends, b_ends, starts, stops)
        self.cut_a, self.cut_b = np.sort(cut_a), np.sort(cut_b)
        owner = np.repeat(np.arange(len(texts)), np.diff(self.a_first))
        self.link_text, self.cut_text = owner[self.link_a], owner[self.cut_a]
        self.size = len(texts)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct id pairs of every text: bounds by text, pairs, and how many links hold each."""
        pair = self.a_ids[self.link_a] * IDS + self.b_ids[self.link_b]
        values, code = np.unique(pair, return_inverse=True)
        keys, counts = np.unique(self.link_text * max(len(values), 1) + code, return_counts=True)
        text = keys // max(len(values), 1)
        return np.searchsorted(text, np.arange(self.size + 1)), values[keys % max(len(values), 1)] if len(keys) else values, counts

    def groups(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` for every text."""
        a_group = np.searchsorted(self.cut_a, np.arange(len(self.a_ids)))
        b_group = np.searchsorted(self.cut_b, np.arange(len(self.b_ids)))
        n = len(self.cut_a)
        a_count, b_count = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
        parts = np.empty(len(a_group) + len(b_group), object)
        a_last, b_last = np.zeros(len(a_group), bool), np.zeros(len(b_group), bool)
        a_last[self.cut_a] = b_last[self.cut_b] = True
        for ids, place, last, mark in (
                (self.a_ids, np.arange(len(a_group)) + (np.cumsum(b_count) - b_count)[a_group], a_last, "|"),
                (self.b_ids, np.arange(len(b_group)) + np.cumsum(a_count)[b_group], b_last, ";")):
            # Every distinct (id, whether it ends its part) is written once.
            keys, code = np.unique(ids * 2 + last, return_inverse=True)
            words = np.array([f"{k // 2}{mark if k % 2 else ','}" for k in keys.tolist()], object)
            parts[place] = words[code] if len(keys) else parts[:0]
        first = (self.a_first + self.b_first).tolist()
        flat = parts.tolist()
        return ["".join(flat[i:j])[:-1] for i, j in zip(first, first[1:], strict=False)]


def _run(docs: DataFrame, paths: tuple[str, str], schema: str, columns, keep: list[str]) -> DataFrame:
    """``keep`` and what ``columns`` (a function of Aligned) makes of every text."""
    worker_path(docs.sparkSession)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _encoders(*paths)
        for whole in batches:
            for batch in chunks(whole, "text"):
                found = columns(Aligned(batch.column("text").to_pylist(), a, b))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *found.values()], names=[*keep, *found])

    kept = docs.select(*keep, F.col("text").cast("binary").alias("text"))
    types = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    return kept.mapInArrow(align, ", ".join([*[f"`{c}` {types[c]}" for c in keep], schema]))


def _lists(first: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(first.astype(np.int32), pa.array(values))


def align(docs: DataFrame, a_path: str, b_path: str, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (doc_id if not given) with the alignment of every text.

    a_ids, b_ids; a_cuts, b_cuts: numbers of tokens up to the end of every group; link_a, link_b: places of linked tokens, by
    B token and A token.  Texts that are null, empty, or whose tokens' bytes are not the space and the text have empty lists.
    Every row stands for itself, repeated ids and texts included.  A text is aligned whole, in memory of about 100 bytes a
    token.
    """
    def columns(x: Aligned) -> dict[str, pa.Array]:
        order = np.lexsort((x.link_a, x.link_b))
        link = np.searchsorted(x.link_text[order], np.arange(x.size + 1))
        cut = np.searchsorted(x.cut_text, np.arange(x.size + 1))
        return {"a_ids": _lists(x.a_first, x.a_ids), "b_ids": _lists(x.b_first, x.b_ids),
                "a_cuts": _lists(cut, x.cut_a + 1 - x.a_first[x.cut_text]), "b_cuts": _lists(cut, x.cut_b + 1 - x.b_first[x.cut_text]),
                "link_a": _lists(link, (x.link_a - x.a_first[x.link_text])[order]),
                "link_b": _lists(link, (x.link_b - x.b_first[x.link_text])[order])}

    return _run(docs, (a_path, b_path), ", ".join(f"{c} array<long>" for c in ("a_ids", "b_ids", "a_cuts", "b_cuts", "link_a", "link_b")),
                columns, keep or ["doc_id"])


def _measured(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """Counts, digest of the groups, and distinct pairs of every text."""
    def columns(x: Aligned) -> dict[str, pa.Array]:
        first, pairs, counts = x.pairs()
        digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in x.groups()]
        numbers = {"n_a": np.diff(x.a_first), "n_b": np.diff(x.b_first), "n_groups": np.bincount(x.cut_text, minlength=x.size),
                   "n_links": np.bincount(x.link_text, minlength=x.size)}
        return {**{k: pa.array(v.astype(np.int64)) for k, v in numbers.items()}, "groups_sha256": pa.array(digests, pa.string()),
                "pairs": _lists(first, pairs), "counts": _lists(first, counts.astype(np.int32))}

    return _run(docs, paths, "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, counts array<int>",
                columns, ["doc_id"])


def pair_counts(measured: DataFrame) -> DataFrame:
    """(pair, n): how many links of all texts hold each id pair, added up inside tasks first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            more = [batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pairs", "counts")]
            keys, code = np.unique(np.concatenate([keys, more[0]]), return_inverse=True)
            sums = np.bincount(code, np.concatenate([sums, more[1]]), len(keys)).astype(np.int64)
            if len(keys) > GATHER:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], names=["pair", "n"])
                keys, sums = keys[:0], sums[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], names=["pair", "n"])

    return measured.select("pairs", "counts").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def alignment_support(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A link counts for n_best if its id pair has the most links of all pairs with its B id in the corpus, ties included;
    count_sum adds up the pairs' counts over the links.  Rows without tokens have zeros and ''.  Rows as in ``align``.
    """
    spark = docs.sparkSession
    numbered = _measured(docs, (a_path, b_path)).withColumn("row", F.monotonically_increasing_id())
    measured = stored(numbered, "alignment-rows")  # from here on a row's number is fixed
    counted = stored(pair_counts(measured), "alignment-pairs")
    # One row per B id: no more than its vocabulary has.
    best = counted.groupBy((F.col("pair") % IDS).alias("b")).agg(F.max("n").alias("best")).collect()
    top = np.zeros(max((r["b"] for r in best), default=-1) + 1, np.int64)
    for r in best:
        top[r["b"]] = r["best"]
    # At most FREQUENT pairs.
    frequent = counted.orderBy(F.desc("n"), "pair").limit(FREQUENT).toArrow()
    known, sums = frequent.column("pair").to_numpy(), frequent.column("n").to_numpy()
    order = np.argsort(known)
    shared = spark.sparkContext.broadcast((known[order], sums[order], top))
    del known, sums, frequent, order
    worker_path(spark)
    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, tops = shared.value
        for batch in batches:
            lists = batch.column("pairs")
            first = lists.offsets.to_numpy().astype(np.int64)
            first = first - first[0]
            pairs = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            links = batch.column("counts").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(first))
            place = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            hit = keys[place] == pairs if len(keys) else np.zeros(len(pairs), bool)
            n = np.where(hit, counts[place], 0) if len(keys) else np.zeros(len(pairs), np.int64)
            is_best = hit & (n == tops[pairs % IDS]) if len(pairs) else hit
            # Sums of whole numbers, taken without a detour over floating point.
            run = np.concatenate([[0], np.cumsum(links * n)])
            rest = np.flatnonzero(~hit)
            cuts = np.searchsorted(owner[rest], np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept],
                 pa.array(np.bincount(owner, links * is_best, batch.num_rows).astype(np.int64)),
                 pa.array(run[first[1:]] - run[first[:-1]]),
                 _lists(cuts, pairs[rest]), _lists(cuts, links[rest].astype(np.int32))],
                names=[*kept, "n_best", "count_sum", "pairs", "counts"])

    types = {f.name: f.dataType.simpleString() for f in measured.schema.fields}
    partial = stored(measured.select(*kept, "pairs", "counts").mapInArrow(
        add, ", ".join([*[f"{c} {types[c]}" for c in kept], "n_best long, count_sum long, pairs array<long>, counts array<int>"])),
        "alignment-partial")
    # Pairs that are not among the frequent ones have few links each, so no key of this join is hot.
    tops = spark.createDataFrame([(int(i), int(n)) for i, n in enumerate(top) if n], "b long, best long")
    open_links = partial.filter("size(pairs) > 0").select(
        "row", F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("links"))
    rest = (open_links.join(counted, "pair").withColumn("b", F.col("pair") % IDS).join(F.broadcast(tops), "b")
            .groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("links")).otherwise(0)).alias("_best"),
                                F.sum(F.col("links") * F.col("n")).alias("_sum")))
    whole = partial.drop("pairs", "counts").join(rest, "row", "left")
    return whole.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"), "groups_sha256")


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    """Every document's alignment between the byte-level and the piece tokenizer."""
    import public_tokenizers
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return alignment_support(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
