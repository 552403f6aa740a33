"""The prefix trie, the tokenizers' alignment and the quality model on small awkward tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from corpusforge.llm import prefix_trie, quality, token_alignment
from tests.llm.conftest import rows_of

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TURNS = "conv_id long, turn long, role string, text string"
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def true_trie(rows, rebuild=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn), (role or "", text or "")))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = own.get(c - c % 100, [])[:h] + turns[h:] if rebuild else turns
    members, ends = defaultdict(set), defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].add(c)
        ends[tuple(path)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def below(node):
        return [node] + [x for child in children[node] for x in below(child)]

    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]),
                    sum(not children[x] for x in below(n)),
                    sum((len(members[x]) - 1) * len(x[-1][1]) for x in below(n) if x),
                    hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, m in members.items()), key=str)


def conversations(seed, n):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["é", "hello", ""]))
            for c in [*range(n), 100, 150, 257, 12345] for t in range(rng.choice([1, 2, 3, 7, 12]))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rebuild,subtree", [(True, 1 << 20), (False, 1 << 20), (True, 400), (False, 1)])
def test_trie(spark, monkeypatch, rebuild, subtree):
    """Peeled in tasks alone, in both ways, and depth by depth alone."""
    monkeypatch.setattr(prefix_trie, "SUBTREE_BYTES", subtree)
    rows = conversations(3, 60)
    rows += [(7, None, None, None), (None, 1, "user", "lost"), (8, 90, "user", "x" * 70_000), (8, 91, "user", "日本")]
    found = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS), rebuild)
    assert rows_of(found, *NODE) == true_trie(rows, rebuild)


def test_trie_of_equal_conversations_in_many_fragments(spark, monkeypatch):
    """One node where most conversations end; extra columns with the operator's own names; rows repeated."""
    monkeypatch.setattr(prefix_trie, "FRAGMENT", 7)
    rows = [(c, t, "user", f"turn {t}") for c in range(1000) for t in range(2)] + [(2000, 0, "user", "turn 0")] * 3
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "'x' as path", "'y' as depth", "'z' as _base", "'k' as at")
    assert rows_of(prefix_trie.prefix_trie(df, False), *NODE) == true_trie(rows, False)


def test_trie_of_a_very_long_conversation(spark):
    """A conversation of 3,000 turns, and one that leaves it near its end, take no job per turn."""
    rows = [(c, t, "user", f"{t}") for c in (1, 2) for t in range(3000 - c)] + [(2, 5000, "user", "other")]
    found = {r["depth"]: r for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS), False).collect() if r["conv_id"] == 1}
    assert len(found) == 3000 and found[2998]["n_convs"] == 2 and found[2998]["n_leaves"] == 2 and found[2999]["parent_conv_id"] == 1
    assert found[0]["saved_tokens"] == sum(len(str(t)) for t in range(2998)) and found[0]["parent_conv_id"] is None


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    short = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 == 5)
    rows = [(short, 0, "user", "gone")]
    assert rows_of(prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS)), *NODE) == true_trie(rows)


AWKWARD = ["plain words, twice plain words", "", None, "   ", "ÄÖ ß naïve <|endoftext|> </s>", "日本語 text ☃ \U0001f600", "a▁b", "\x00\x01",
           "tabs\t\tand\n\n lines  \r\n", " leading", "plain words, twice plain words", "x" * 3000, " " * 3000, "don't stop 12345!!",
           "word " * 4000]


def true_alignment(texts):
    a_model, b_model = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a_model.encode_special_tokens = True
    a_bytes, b_bytes = token_alignment.ByteLevel(A_PATH).pieces, token_alignment.Pieces(B_PATH).pieces
    found, pairs = [], Counter()
    for text in texts:
        whole = f" {text or ''}".encode()
        a, b = a_model.encode(f" {text or ''}", add_special_tokens=False).ids, b_model.encode(text or "")
        if not text or any(b"".join(t[i] for i in ids) != whole for t, ids in ((a_bytes, a), (b_bytes, b))):
            found.append(None)
            continue
        owner_a = [k for k, i in enumerate(a) for _ in a_bytes[i]]
        owner_b = [k for k, i in enumerate(b) for _ in b_bytes[i]]
        links = sorted(set(zip(owner_a, owner_b, strict=True)))
        cuts = [p for p in range(1, len(whole) + 1) if p == len(whole) or owner_a[p] != owner_a[p - 1] and owner_b[p] != owner_b[p - 1]]
        groups = []
        for start, stop in zip([0, *cuts], cuts, strict=False):
            groups.append("|".join(",".join(str(ids[k]) for k in dict.fromkeys(owner[start:stop]))
                                   for ids, owner in ((a, owner_a), (b, owner_b))))
        linked = [(a[i], b[j]) for i, j in links]
        pairs.update(linked)
        found.append((len(a), len(b), len(groups), linked, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = Counter()
    for (_, b), n in pairs.items():
        best[b] = max(best[b], n)
    return sorted(((k, 0, 0, 0, 0, 0, 0, "") if x is None else
                   (k, *x[:3], len(x[3]), sum(pairs[p] == best[p[1]] for p in x[3]), sum(pairs[p] for p in x[3]), x[4])
                   for k, x in enumerate(found)), key=str)


@pytest.mark.parametrize("frequent", [0, 20, 1 << 19])
def test_alignment(clashing, monkeypatch, frequent):
    monkeypatch.setattr(token_alignment, "FREQUENT", frequent)
    found = token_alignment.alignment_support(clashing(*AWKWARD), A_PATH, B_PATH)
    assert rows_of(found, "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256") == true_alignment(AWKWARD)


def test_alignment_of_repeated_rows_and_of_nothing(documents):
    rows = token_alignment.alignment_support(documents((1, "same text"), (1, "same text"), (1, "other"), (2, None)), A_PATH, B_PATH).collect()
    assert sorted((r["doc_id"], r["n_a"]) for r in rows) == [(1, 1), (1, 2), (1, 2), (2, 0)]
    assert token_alignment.alignment_support(documents().filter("false"), A_PATH, B_PATH).count() == 0


def test_alignment_lists(documents):
    row = token_alignment.align(documents("unbelievable things"), A_PATH, B_PATH).first()
    assert row["a_cuts"][-1] == len(row["a_ids"]) and row["b_cuts"][-1] == len(row["b_ids"])
    assert len(row["link_a"]) == len(row["a_ids"]) + len(row["b_ids"]) - len(row["a_cuts"])
    assert list(zip(row["link_b"], row["link_a"], strict=True)) == sorted(zip(row["link_b"], row["link_a"], strict=True))


def test_byte_level_ids_are_the_tokenizers():
    rng, ours = random.Random(5), token_alignment.ByteLevel(A_PATH)
    theirs = Tokenizer.from_file(A_PATH)
    theirs.encode_special_tokens = True
    for _ in range(400):
        text = "".join(chr(rng.choice([rng.randrange(128), rng.randrange(0x280), 32, 10, 0xA0, 0x85, rng.randrange(0xD800)])) for _ in range(40))
        assert ours.encode([text.encode()])[0].tolist() == theirs.encode(f" {text}", add_special_tokens=False).ids


def test_quality_is_learnt_from_labels_only_where_allowed(spark):
    """Held-out accuracy on the given tables."""
    folder = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in quality.op13_quality(spark, folder).collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in rows.items())
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows.values())
    held = [(q, rows[d]["score"]) for d, q in labels if rows[d]["held_out"]]
    good, bad = [s for q, s in held if q], [s for q, s in held if not q]
    assert sum(g > b for g in good for b in bad) >= 0.97 * len(good) * len(bad)
    assert sum(s >= 0.3 for s in good) >= 0.97 * len(good)


def test_quality_of_awkward_rows(spark, clashing):
    df = clashing(*[("good words here " * 5, "good " * 30, "BAD!! TEXT!! " * 9)[i % 3] + str(i) for i in range(30)], *AWKWARD)
    labels = spark.createDataFrame([(i, int(i % 3 < 2)) for i in range(30)] * 2 + [(None, 1), (3, None), (31, 1)], "doc_id long, label int")
    scored = quality.score_quality(df, quality.train_quality(df, labels)).select("row.*", "score")
    assert scored.columns == [*df.columns, "score"] and scored.count() == df.count()
    got = {r["doc_id"]: r["score"] for r in scored.collect()}
    assert min(got[i] for i in range(30) if i % 3 < 2) > max(got[i] for i in range(30) if i % 3 == 2)
    assert got[31] == got[32] == got[33] and got[30] == got[40]
    nothing = quality.train_quality(df, labels.filter("false"))
    assert {r["score"] for r in quality.score_quality(df, nothing).collect()} == {0.5}
    assert quality.score_quality(df.filter("false"), nothing).count() == 0


def test_quality_sums_equal_a_plain_walk(documents):
    """Mean vectors of a chunk against the sums of each text's counted features."""
    import numpy as np
    import pyarrow as pa
    texts = ["one two two", "", "éé a a a b", None, "two one"]
    found = quality._Features(pa.array(texts))
    vectors = np.random.default_rng(1).normal(size=(quality.BUCKETS, 3))
    first, numbers, counts = found.counts()
    for k, mean in enumerate(found.means(vectors)):
        own, n = numbers[first[k]:first[k + 1]], counts[first[k]:first[k + 1]]
        assert np.allclose(mean, (vectors[own] * n[:, None]).sum(0) / max(n.sum(), 1))
    # "one two two": 3 words, 2 pairs, and 2 + 1 byte runs a word of three bytes.
    assert counts[first[0]:first[1]].sum() == 3 + 2 + 9


def test_deduplicated_rows_of_repeated_ids_and_of_none(documents, monkeypatch):
    """Every component keeps one document, a repeated id one row, rows without id stay; also when every place is marked."""
    from corpusforge.llm import near_dedup
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text), (2, text), (3, "another text of six words here"), (3, "another text of six words here"), (None, text), (None, text), (4, ""), (5, None),
            (6, "x"), (6, "different")]
    for bits in (1 << 22, 32):
        monkeypatch.setattr(near_dedup, "BITS", bits)
        kept = near_dedup.deduplicated(documents(*rows))
        assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect() if r["doc_id"] is not None) == [(False, i) for i in (1, 3, 4, 5, 6)]
        assert kept.filter("doc_id is null").count() == 2


def test_hot_lists_of_one_cluster_become_one(spark, documents, monkeypatch):
    """Variants of one text meet once or a few times, not once a hot value, and the links stay the same."""
    from corpusforge.llm import near_dedup
    from tests.llm.test_operators import true_components
    for name, value in (("HUB_ROUNDS", 0), ("LINEAR", 0), ("HOT_PAIRS", 10), ("BLOCK", 20)):
        monkeypatch.setattr(near_dedup, name, value)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(w if rng.random() > 0.02 else f"v{rng.randrange(999)}" for w in base) for _ in range(150)]
    seen, original = [], near_dedup._super_lists

    def counted(entries):
        merged = original(entries)
        seen.append((entries.count(), merged.count(), merged.select("doc").distinct().count()))
        return merged

    monkeypatch.setattr(near_dedup, "_super_lists", counted)
    found = near_dedup.near_duplicates(documents(*texts))
    assert rows_of(found, "doc_id", "n_shingles", "component_id", "kept") == sorted(true_components(texts), key=str)
    before, after, docs = seen[0]
    assert before > 8 * docs and after < 4 * docs


def test_pipeline_stage_by_stage_against_brute_force(spark, documents, tmp_path):
    """Every stage on what the one before it kept: known toxic rows, components, windows, shares of sources, token ids."""
    import re
    import numpy as np
    import corpus_pipeline
    from tests.llm.test_operators import true_components
    rng = random.Random(9)
    words = [f"{a}{b}" for a in "kmprst" for b in ("alo", "eni", "uro", "ima", "osi", "etu")]

    def prose(n=24):
        return " ".join(rng.choice(words) for _ in range(n))

    item = " ".join(f"exam{i}" for i in range(12))
    texts, toxic = [], set()
    for i in range(240):
        kind = i % 8
        if kind == 0:
            toxic.add(i)
            texts.append(f"{prose(8)} vilea vileb vilec viled {prose(8)}")
        elif kind == 1 and i > 8:
            copied = texts[-6].split()
            copied[rng.randrange(2)] = "changed"
            texts.append(" ".join(copied))
        elif kind == 2 and i % 16 == 2:
            texts.append(f"{prose(6)} {item.upper()} {prose(6)}")
        else:
            texts.append(prose())
    folder = str(tmp_path)
    documents(*[(i, t, ["a", "b", "c", None][i % 4]) for i, t in enumerate(texts)]).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs.cache()
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        assert docs.columns == columns or name == "tokens"
        kept[name] = [tuple(r) for r in docs.collect()]
    ids = {name: [r[0] for r in rows] for name, rows in kept.items()}
    assert sorted(ids["toxicity"]) == [i for i in range(240) if i not in toxic]

    left = sorted(ids["toxicity"])
    components = true_components([texts[i] for i in left])
    assert sorted(ids["near_dedup"]) == [left[k] for k, _, group, first in components if first]
    windows = {tuple(item.split()[i:i + 10]) for i in range(3)}

    def leaks(text):
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        return any(tuple(own[i:i + 10]) in windows for i in range(len(own)))
    clean = [i for i in ids["near_dedup"] if not leaks(texts[i])]
    assert sorted(ids["decontamination"]) == sorted(clean) and len(clean) < len(ids["near_dedup"])

    size = {i: len(texts[i].split()) for i in clean}
    total = {s: sum(size[i] for i in clean if i % 4 == s) for s in range(4)}
    share, rest, open_ones = {}, 1.5 * sum(total.values()), {0: 5, 1: 2, 2: 1, 3: 5}
    while open_ones:
        over = [s for s in open_ones if rest * open_ones[s] / sum(open_ones.values()) > 2 * total[s]]
        if not over:
            share.update({s: rest * w / sum(open_ones.values()) for s, w in open_ones.items()})
            break
        for s in over:
            share[s] = 2 * total[s]
        for s in over:
            rest -= share[s]
            del open_ones[s]
    copies = Counter(ids["mixing"])
    for i in clean:
        rate = share[i % 4] / total[i % 4]
        assert int(rate + 1e-9) <= copies[i] <= -int(-rate // 1) + (rate > int(rate)) <= 3
    for s in share:
        taken = sum(copies[i] * size[i] for i in clean if i % 4 == s)
        assert abs(taken - share[s]) <= 6 * 24 * (len([i for i in clean if i % 4 == s]) ** 0.5)

    tokenizer, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    names = docs.columns
    for row, i in zip(sorted(kept["tokens"], key=lambda r: r[names.index("start")]), sorted(ids["mixing"]), strict=True):
        own = np.array([*tokenizer.encode(texts[i], add_special_tokens=False).ids, 2], "<u4")
        assert [row[names.index(c)] for c in ("doc_id", "start", "n_tokens", "ids_crc32")] == [i, start, len(own), zlib.crc32(own.tobytes())]
        start += len(own)
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(kept["tokens"])
