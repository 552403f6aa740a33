"""MinHash near-duplicates with bottom-k sketches of one hash function.

The k smallest shingle hashes of a document are its sketch.  Two documents of similarity J share about J * k of the k
smallest hashes of their union, so any pair worth verifying meets in the inverted lists of sketch values.  Documents
with equal shingle sets are one class throughout, and only classes are compared.
"""

import hashlib

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.arrow_text import LOWER, Words, chunks, released, span_hashes, worker_path
from corpusforge.llm.components import components
from corpusforge.session import checkpointed, stored

WORDS, PERCENT, SKETCH = 5, 75, 64
#: A pair at the threshold shares fewer than so many of its union's SKETCH smallest hashes with a chance below 1e-8.
LEAST_SHARED = 27
#: While more than LINEAR pairs per list entry are open, every list compares its documents with one hub, and those linked
#: to it take its label; pairs of one label are settled.  What is open after HUB_ROUNDS is compared pair by pair.
HUB_ROUNDS, LINEAR = 2, 4
#: Lists with so many open pairs are compared in tasks of two blocks of their documents.  Of the pairs of sets under PROFILE
#: shingles, which a task holds whole, it gives a spanning forest of the links; of others the likely pairs.
HOT_PAIRS, BLOCK, PROFILE = 300, 1000, 256
#: Bits of the map of documents whose texts are needed: the bound of what is broadcast for it.
BITS = 1 << 22
#: Bytes of text that a Python step works on at a time.
PIECE_BYTES = 1 << 18
_PAD = np.iinfo(np.int64).max


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 63-bit hashes of every text's shingles; a shorter text is one shingle, an empty one has none."""
    found = Words(texts, fold=LOWER)
    each = found.hashes()
    out = []
    for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
        n = b - a
        if not n:
            out.append(np.zeros(0, np.int64))
            continue
        width = min(words, n)
        begins = np.arange(n - width + 1)
        hashes = span_hashes(each[a:b], begins, begins + width)
        out.append(np.unique((hashes >> np.uint64(1)).astype(np.int64)))
    return out


def _sketched(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n (set size), class (fingerprint of the set), sketch (ascending longs)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in released(batches):
            for batch in chunks(whole, "text", PIECE_BYTES):
                sets = shingle_sets(batch.column("text"), words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                     pa.array([s[:SKETCH] for s in sets], pa.list_(pa.int64()))], names=["doc_id", "n", "class", "sketch"])

    worker_path(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, class binary, sketch array<long>")


def _least_shared(n, percent: int):
    """Sketch values that a document shares with any partner at the threshold: all of a small set, or LEAST_SHARED."""
    return F.least(F.lit(LEAST_SHARED), F.ceil(n * F.lit(percent / 100)).cast("int"))


def _listed(classes: DataFrame, percent: int) -> DataFrame:
    """Entries (value, doc, n) of the inverted lists that candidate pairs must meet in.

    Of a sketch, ordered by how many sketches hold each value, a partner shares at least ``c`` values, so it holds one
    of the first size - c + 1.  Only these are listed: values of passages that very many documents share stay out, unless
    a document has little else.
    """
    entries = classes.select("doc", "n", F.size("sketch").alias("size"), F.explode("sketch").alias("value"))
    common = stored(entries.groupBy("value").count().filter("count > 1"), "near-values")
    kept = entries.join(common, "value").groupBy("doc", "n", "size").agg(
        F.sort_array(F.collect_list(F.struct("count", "value"))).alias("held"))
    prefix = F.col("size") - _least_shared(F.col("n"), percent) + 1 - (F.col("size") - F.size("held"))
    listed = kept.select("doc", "n", F.explode(F.slice("held", 1, F.greatest(prefix, F.lit(0)))).alias("h"))
    return listed.select("doc", "n", F.col("h.value").alias("value"))


def _open_lists(marked: DataFrame, turn: int) -> DataFrame:
    """Lists whose documents carry several labels: value, pairs (with different labels), hub (one document by hash)."""
    one = F.struct(F.xxhash64(F.lit(turn), "doc").alias("h"), "doc", "n", "label")
    by_label = marked.groupBy("value", "label").agg(F.count("*").alias("c"), F.min(one).alias("hub"))
    lists = by_label.groupBy("value").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("same"), F.min("hub").alias("hub"))
    return lists.filter("m * m > same").select("value", "m", ((F.col("m") * F.col("m") - F.col("same")) / 2).cast("long").alias("pairs"), "hub")


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and union sketches allow the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def padded(column: pa.Array) -> np.ndarray:
            flat, rows = column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())
            wide = np.full((len(column), SKETCH), _PAD)
            wide[np.repeat(np.arange(len(column)), rows), np.arange(len(flat)) - np.repeat(np.cumsum(rows) - rows, rows)] = flat
            return wide

        for batch in batches:
            both = np.sort(np.hstack([padded(batch.column("sketch_a")), padded(batch.column("sketch_b"))]), axis=1)
            twice = np.zeros(both.shape, bool)
            twice[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != _PAD)
            inside = np.cumsum(~twice & (both != _PAD), axis=1) <= SKETCH
            shared = (twice & inside).sum(1)
            union = ((~twice & (both != _PAD)) & inside).sum(1)
            n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            whole = (n_a < SKETCH) & (n_b < SKETCH)  # then the sketches are the sets
            good = np.where(whole, shared * 100 >= percent * (n_a + n_b - shared),
                            shared >= np.minimum(LEAST_SHARED, np.ceil(union * percent / 100)))
            yield batch.filter(pa.array(good)).select(["a", "b", "label"])

    sized = pairs.filter(f"n_a * 100 >= n_b * {percent} and n_b * 100 >= n_a * {percent}")
    side = classes.select("doc", "sketch")
    return (sized.join(side.toDF("b", "sketch_b"), "b").join(side.toDF("a", "sketch_a"), "a")
            .select("a", "b", "label", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long, label long"))


def _marked_places(ids: DataFrame, spread: int) -> DataFrame:
    """(_word, _bits): a bitmap of ``spread`` places, as a table of at most spread / 32 rows, of the hashes of ``ids`` (_id)."""
    place = F.pmod(F.xxhash64("_id"), F.lit(spread))
    return ids.select(F.shiftright(place, 5).alias("_word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(_id), {spread}) & 31 as int))").alias("_bit")
                      ).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))


def _flagged(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` with ``_marked``: whether their _id may be among ``ids`` (_id); those that are always are.

    What is broadcast are BITS / 32 rows of two numbers at most.
    """
    bit = F.expr(f"shiftright(_bits, cast(pmod(xxhash64(_id), {BITS}) & 31 as int)) & 1")
    placed = rows.withColumn("_word", F.shiftright(F.pmod(F.xxhash64("_id"), F.lit(BITS)), 5))
    return placed.join(F.broadcast(_marked_places(ids, BITS)), "_word", "left").withColumn(
        "_marked", F.coalesce(bit == 1, F.lit(False)) & F.col("_id").isNotNull()).drop("_word", "_bits")


def _only(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of (doc, text) that may be in ``wanted`` (doc): a bitmap of BITS hash values keeps other texts from the shuffle."""
    rows = texts.filter("doc is not null").select(F.col("doc").alias("_id"), "text")
    return _flagged(rows, wanted.select(F.col("doc").alias("_id"))).filter("_marked").select(F.col("_id").alias("doc"), "text")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold.  Rows arrive ordered by ``a``, whose set is made once."""
    pairs = checkpointed(pairs)
    texts = _only(texts, pairs.select(F.explode(F.array("a", "b")).alias("doc")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None
        for whole in released(batches):
            for batch in chunks(whole, "text_b", PIECE_BYTES):
                ids, theirs, good = batch.column("a").to_pylist(), shingle_sets(batch.column("text_b"), words), []
                for k, other in enumerate(theirs):
                    if ids[k] != last:
                        last, mine = ids[k], shingle_sets(batch.column("text_a").slice(k, 1), words)[0]
                    shared = len(np.intersect1d(mine, other, assume_unique=True))
                    good.append(shared * 100 >= percent * (len(mine) + len(other) - shared))
                yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b", "label"])

    return (pairs.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a")
            .select("a", "b", "label", "text_a", "text_b").mapInArrow(run, "a long, b long, label long"))


def forest(link: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a symmetric matrix of links: ends of links that join all that it joins, without rings, and each row's group."""
    group, ends = np.full(len(link), -1), [(np.zeros(0, int),) * 2]
    for root in range(len(link)):
        if group[root] >= 0:
            continue
        group[root], front = root, np.array([root])
        while len(front):
            near = link[front]
            new = np.flatnonzero(near.any(0) & (group < 0))
            ends.append((front[near[:, new].argmax(0)], new))
            group[new], front = root, new
    return np.concatenate([e[0] for e in ends]), np.concatenate([e[1] for e in ends]), group


def _super_lists(entries: DataFrame) -> DataFrame:
    """Entries (doc, n, label, value, blocks) of hot lists, after lists that hold nearly the same documents became one.

    The values of a large cluster are listed by nearly all of its documents, which would meet in every one of them.  A list goes
    to the longest list that half of its documents or more have as their longest one, unless the union has over twice the
    documents of that list.  Documents that met in a list still do.
    """
    longest = entries.groupBy("doc").agg(F.max(F.struct("m", "value")).alias("top"))
    votes = entries.join(longest, "doc").groupBy("value", "m", F.col("top.value").alias("leader")).agg(F.count("*").alias("c"))
    leads = stored(votes.groupBy("value", "m").agg(F.max(F.struct("c", "leader")).alias("best")).select(
        "value", "m", F.when(F.col("best.c") * 2 >= F.col("m"), F.col("best.leader")).otherwise(F.col("value")).alias("leader")), "near-leaders")
    # A list may lead others and follow one itself: two steps, and what then has no end stays as it is.
    step = leads.select(F.col("value").alias("leader"), F.col("leader").alias("next"))
    for _ in range(2):
        leads = leads.join(step, "leader").select("value", "m", F.col("next").alias("leader"))
    ends = step.filter("leader = next").select("leader")
    leads = stored(leads.join(ends, "leader"), "near-leads")
    joined = entries.join(leads.select("value", "leader"), "value").select("leader", "doc").distinct()
    sizes = joined.groupBy("leader").count().join(entries.groupBy(F.col("value").alias("leader")).agg(F.max("m").alias("own")), "leader")
    fit = sizes.filter("count <= 2 * own").select("leader")
    moves = stored(leads.join(fit, "leader").select("value", "leader"), "near-moves")
    merged = entries.join(moves, "value", "left").select("doc", "n", "label", F.coalesce("leader", "value").alias("value")).distinct()
    merged = stored(merged, "near-merged")
    blocks = merged.groupBy("value").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    return merged.join(blocks, "value")


def _likely_in_blocks(marked: DataFrame, hot: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b, label) with different labels that meet in hot lists and whose larger sketches allow the threshold.

    A list is cut into blocks and its pairs of blocks into tasks.  A pair is left to the first hot list that it meets in.
    Lists that hold nearly the same documents are one list (``_super_lists``).  Links of sets that a task holds whole are decided there, and a spanning forest of them is given: at most one row per
    document and task.  A larger pair is given unless its ends are joined by that forest.
    """
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in released(batches):
            for batch in chunks(whole, "text", PIECE_BYTES):
                sets = [s[:PROFILE].tobytes() for s in shingle_sets(batch.column("text"), words)]
                yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(sets, pa.binary())], names=["doc", "profile"])

    def compare(rows: pa.Table) -> pa.Table:
        side = rows.column("side").to_numpy()
        value = rows.column("value")[0].as_py()
        doc, n, label = (rows.column(c).to_numpy() for c in ("doc", "n", "label"))
        profiles = [np.frombuffer(p, np.int64) for p in rows.column("profile").to_pylist()]
        left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() else (np.arange(len(doc)),) * 2
        sizes = np.array([len(p) for p in profiles])
        last = np.array([p[-1] if len(p) == PROFILE else _PAD for p in profiles])

        def together(lists: list) -> np.ndarray:
            """How many values the rows of every pair have in common."""
            owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            values, column, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
            column = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[column]
            total = np.zeros((len(left), len(right)), np.float32)
            for k in range(0, int((times > 1).sum()), 4096):
                wide = np.zeros((len(lists), 4096), np.float32)
                inside = (column >= k) & (column < k + 4096)
                wide[owner[inside], column[inside] - k] = 1
                total += wide[left] @ wide[right].T
            return total

        earlier = together([np.array([x for x in h if x < value], np.int64) for h in rows.column("hot").to_pylist()])
        shared = together(profiles)
        # Below the smaller of two last values both sets are known whole: that is the sketch of their union.  What a set lists
        # above it is not counted, of sets that are listed whole either.
        until = np.minimum(last[left][:, None], last[right][None, :])
        whole = sizes[left][:, None] + sizes[right][None, :] - shared
        for rows_of, at in ((left, 0), (right, 1)):
            for i, r in enumerate(rows_of):
                line = until[i] if at == 0 else until[:, i]
                if line.min() == _PAD:
                    continue
                beyond = sizes[r] - np.searchsorted(profiles[r], line, side="right")
                if at == 0:
                    whole[i] -= beyond
                else:
                    whole[:, i] -= beyond
        p = percent / 100
        exact = (n[left] < PROFILE)[:, None] & (n[right] < PROFILE)[None, :]
        margin = 6 * np.sqrt(p * (1 - p) * np.maximum(whole, 1))
        good = (np.where(exact, shared * 100 >= percent * whole, shared + margin >= p * whole)
                & (earlier == 0) & (label[left][:, None] != label[right][None, :])
                & (n[left][:, None] * 100 >= n[right][None, :] * percent) & (n[right][None, :] * 100 >= n[left][:, None] * percent))
        link = np.zeros((len(doc), len(doc)), bool)
        link[np.ix_(left, right)] = good & exact
        a, b, group = forest(link | link.T)
        good &= ~exact & (group[left][:, None] != group[right][None, :])
        more, others = np.nonzero(np.triu(good, 1) if not side.any() else good)
        a, b = np.concatenate([a, left[more]]), np.concatenate([b, right[others]])
        return pa.table({"a": np.minimum(doc[a], doc[b]), "b": np.maximum(doc[a], doc[b]), "label": label[a]})

    entries = _super_lists(stored(marked.join(hot.select("value", "m"), "value"), "near-entries"))
    members = entries.groupBy("doc").agg(F.collect_set("value").alias("hot"))
    members = stored(members.join(_only(texts, entries.select("doc")), "doc").select("doc", "hot", "text"), "near-hot")
    profiles = members.select("doc", "text").mapInArrow(profile, "doc long, profile binary").dropDuplicates(["doc"])
    rows = entries.withColumn("block", F.pmod(F.xxhash64("doc", "value"), F.col("blocks")).cast("int")).select(
        "doc", "n", "label", "value", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = rows.select("doc", "n", "label", "value", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                         (F.col("block") > F.col("other")).cast("int").alias("side"))
    placed = placed.join(members.select("doc", "hot").dropDuplicates(["doc"]), "doc").join(profiles, "doc")
    return placed.groupBy("value", "i", "j").applyInArrow(compare, "a long, b long, label long")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_shingles, component_id (smallest doc_id linked directly or in steps), kept.

    Documents are linked when 100 * shared >= ``percent`` * union of their full sets of ``words``-word shingles, A-Z
    lower-cased.  Texts without words, and null texts, link with nothing.  Rows of one doc_id are one document; rows
    without id take part through equal texts only and are always kept.  Hubs join most of each list with few pairs, then all
    pairs that are still open are compared, so no component is missed however large a list is.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    rows = stored(_sketched(docs, words), "near-sketches")
    firsts = stored(rows.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("doc")), "near-classes")
    classes = stored(rows.join(firsts, "class").filter("doc_id = doc").select("doc", "n", "sketch")
                     .filter("doc is not null"), "near-firsts")
    listed = checkpointed(_listed(classes, percent))
    few = LINEAR * listed.count()
    marked, links = listed.withColumn("label", F.col("doc")), []
    for turn in range(HUB_ROUNDS + 1):
        lists = stored(_open_lists(marked, turn), "near-lists")
        left = lists.agg(F.sum("pairs")).first()[0] or 0
        if left <= few or turn == HUB_ROUNDS:
            break
        meet = marked.join(lists, "value").filter(F.col("label") != F.col("hub.label"))
        pairs = meet.select(F.col("hub.doc").alias("a"), F.col("doc").alias("b"), F.col("hub.n").alias("n_a"),
                            F.col("n").alias("n_b"), F.col("hub.label").alias("label")).distinct()
        found = checkpointed(_verified(_estimated(pairs, classes, percent), texts, words, percent))
        links.append(found.select("a", "b"))
        moved = found.groupBy(F.col("b").alias("doc")).agg(F.min("label").alias("_label"))
        marked = checkpointed(marked.join(moved, "doc", "left").select(
            "doc", "n", "value", F.coalesce("_label", "label").alias("label")))
    if left:
        open_ones = marked.join(lists.filter(F.col("pairs") < HOT_PAIRS).select("value"), "value", "left_semi")
        left, right = (open_ones.select("value", *[F.col(c).alias(f"{c}_{side}") for c in ("doc", "n", "label")]) for side in "ab")
        pairs = left.join(right, "value").filter(
            f"doc_a < doc_b and label_a <> label_b and n_a * 100 >= n_b * {percent} and n_b * 100 >= n_a * {percent}")
        pairs = pairs.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"), "n_a", "n_b", F.col("label_a").alias("label"))
        likely = _estimated(pairs.distinct(), classes, percent).union(
            _likely_in_blocks(marked, lists.filter(F.col("pairs") >= HOT_PAIRS), texts, words, percent))
        links.append(checkpointed(_verified(likely.dropDuplicates(["a", "b"]), texts, words, percent)).select("a", "b"))
    owners = firsts
    if links:
        grouped = components(_union(links))
        owners = firsts.join(grouped, firsts["doc"] == grouped["node"], "left").select(
            "class", F.coalesce("component", "doc").alias("doc"))
    owners = stored(owners, "near-owners")
    component = F.when(F.col("n") > 0, F.coalesce("doc", "doc_id")).otherwise(F.col("doc_id"))
    return (rows.drop("sketch").join(owners, "class", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def _union(tables: list[DataFrame]) -> DataFrame:
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.union(table)
    return whole


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` with one document of every component; of rows that repeat a doc_id, one.  Rows without id stay.

    Decisions are narrow rows.  A bitmap of the ids that go, or come more than once, tells the other documents, which are kept
    where they are; only the texts of those that it marks are shuffled.
    """
    found = near_duplicates(docs, **options).filter("doc_id is not null")
    status = found.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_rows"), F.bool_or("kept").alias("_kept"))
    special = stored(status.filter("not _kept or _rows > 1"), "near-special")
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    rows = _flagged(rows, special.select("_id"))
    marked = rows.filter("_marked").select("_id", "_row")
    repeated = marked.join(special.filter("_kept").select("_id"), "_id", "left_semi").dropDuplicates(["_id"])
    plain = rows.filter("not _marked").select("_id", "_row").union(marked.join(special.select("_id"), "_id", "left_anti"))
    return plain.union(repeated).select("_row.*")


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
