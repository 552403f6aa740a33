"""Corpus operators on small awkward tables: brute force, round trips, held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusforge.llm import decontamination, embedding_dedup, html_text, lm_scoring, mixing, near_dedup, token_files, toxicity
from corpusforge.llm.components import components
from tests.llm.conftest import rows_of

ODD = ["", None, "   \n", "ÄB ß <|endoftext|> don't", "x" * 5000, "word " * 3000, "tie tie", "tie tie"]


def near_copies(seed, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    bases = [[word() for _ in range(rng.choice([3, 4, 6, 30, 90]))] for _ in range(6)]
    texts = []
    for _ in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            words[rng.randrange(len(words))] = word()
        texts.append(" ".join(words))
    return texts


def true_components(texts):
    sets = []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    group = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return sorted((i, len(s), g, i == g) for i, (s, g) in enumerate(zip(sets, group, strict=True)))


@pytest.mark.parametrize("hubs,linear,hot", [(3, 4, 2000), (0, 0, 1), (3, 0, 10)])
def test_near_duplicates(documents, monkeypatch, hubs, linear, hot):
    """With hub rounds, with block tasks alone, and with both."""
    for name, value in (("HUB_ROUNDS", hubs), ("LINEAR", linear), ("HOT_PAIRS", hot), ("BLOCK", 4)):
        monkeypatch.setattr(near_dedup, name, value)
    texts = near_copies(hubs + hot, 60) + ODD
    found = near_dedup.near_duplicates(documents(*texts))
    assert rows_of(found, "doc_id", "n_shingles", "component_id", "kept") == sorted(true_components(texts), key=str)


def test_near_duplicates_of_a_truncated_and_a_whole_profile(documents, monkeypatch):
    """Pairs at the threshold with one set above PROFILE and one below it, met in block tasks alone."""
    for name, value in (("HUB_ROUNDS", 0), ("LINEAR", 0), ("HOT_PAIRS", 1), ("BLOCK", 4), ("PROFILE", 512)):
        monkeypatch.setattr(near_dedup, name, value)
    texts = []
    for k in range(6):
        words = [f"w{k}x{i}" for i in range(684)]
        texts += [" ".join(words), " ".join(words[:514]), " ".join(words[:513 - k])]
    found = near_dedup.near_duplicates(documents(*texts))
    assert rows_of(found, "doc_id", "n_shingles", "component_id", "kept") == sorted(true_components(texts), key=str)


def test_forest_joins_what_links_join():
    rng = np.random.default_rng(1)
    for n, rate in ((1, 0), (7, 0.3), (40, 0.03), (40, 0.0), (30, 1.0)):
        link = np.triu(rng.random((n, n)) < rate, 1)
        a, b, group = near_dedup.forest(link | link.T)
        assert (link | link.T)[a, b].all() and len(a) == n - len(set(group.tolist()))
        assert (group[a] == group[b]).all() and not link[group[:, None] != group[None, :]].any()


def test_deduplicated_keeps_one(documents, clashing):
    texts = near_copies(9, 20)
    kept = near_dedup.deduplicated(clashing(*texts))
    assert kept.columns == clashing("x").columns
    assert [r.doc_id for r in kept.orderBy("doc_id").collect()] == sorted({c for _, _, c, _ in true_components(texts)})
    assert near_dedup.deduplicated(documents((1, "a b"), (1, "a b"), (None, "q"), (None, None), (2, "a b"))).count() == 3
    assert near_dedup.near_duplicates(documents().limit(0)).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (3, 1), (4, None)] + [(k, k + 1) for k in range(20, 60)]
    found = components(spark.createDataFrame(links, "a long, b long"))
    want = [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 7)] + [(k, 20) for k in range(20, 61)]
    assert rows_of(found, "node", "component") == sorted(want, key=str)


def test_mixing(documents, clashing):
    docs = documents(*[(i, "w " * (i % 7 + 1), f"s{i % 3}") for i in range(300)], (900, None, None), (901, "a b", None), (902, "", "empty"))
    rows = mixing.mix_report(docs).collect()
    by = {r.source: r for r in rows}
    assert abs(sum(r.target for r in by.values()) - 1.5 * sum(r.size for r in rows)) < 1e-6
    for source, first in by.items():
        own = [r for r in rows if r.source == source]
        assert first.source_size == sum(r.size for r in own) and first.target <= 2 * first.source_size + 1e-9
        assert all(r.taken in (r.size * int(first.rate), r.size * (int(first.rate) + 1)) and r.taken <= 2 * r.size for r in own)
        assert first.source_size < 100 or abs(sum(r.taken for r in own) / first.target - 1) < 0.25
    wanted = {r.doc_id: r.copies for r in rows if r.copies}
    assert Counter(r.doc_id for r in mixing.mixed_documents(docs).collect()) == wanted
    assert mixing.mixed_documents(clashing("a", "b")).columns == clashing("a").columns
    assert mixing.mix_report(documents().limit(0)).count() == 0 and mixing.mixed_documents(documents().limit(0)).count() == 0


def test_word_cache_keeps_the_words_in_use(monkeypatch):
    """Words known from texts before stay at hand when a full cache makes way in the middle of a text."""
    from tokenizers import Tokenizer
    monkeypatch.setattr(token_files, "CACHE_WORDS", 5)
    path, rng = token_files.tokenizer_path(), random.Random(3)
    encoder, plain = token_files._Encoder(path), Tokenizer.from_file(path)
    signs = [*"aBcdE.,:;!?*-_()[]{}~`^#$%&/=+@|<>\\\"'0129éßİK", "'s", "'LL", "n't", "<|endoftext|>", "The", "ing", "\u0331", "\u2003"]
    for turn in range(150):
        pick = (lambda: rng.choice("abcdefgh") * rng.randint(1, 3)) if turn < 60 else (
            lambda: "".join(rng.choice(signs) for _ in range(rng.randint(1, 6))))
        texts = [" ".join(pick() for _ in range(rng.choice([0, 1, 4, 12]))) for _ in range(3)]
        expected = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert list(encoder.encode([t.encode() for t in texts])) == expected


def test_token_files_round_trip(spark, documents, tmp_path):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(token_files.tokenizer_path())
    texts = [*ODD, *near_copies(3, 30), "tabs\tand\x0bfeeds\x0c\x1c  end", "é 'S x<|startoftext|>y 12ab​"]
    rows = [(7 * i % 101, t) for i, t in enumerate(texts)] + [(500, "same"), (500, "same"), (None, "no id")]
    folder = str(tmp_path / "set")
    token_files.write_token_files(documents(*rows), folder, token_files.tokenizer_path())
    got = sorted(token_files.read_summary(spark, folder).collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for (doc_id, text), row in zip(order, got, strict=True):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    one = token_files.read_documents(spark, folder, [500]).collect()
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in one] == [[*tokenizer.encode("same").ids, 2]] * 2
    assert token_files.token_files(documents().limit(0)).count() == 0


def test_decontamination(spark, documents, clashing):
    item = " ".join(f"q{i}" for i in range(14))
    items = spark.createDataFrame([(1, item), (12, "short Answer"), (3, None), (4, "!!"), (2, item)], "item_id long, text string")
    inside = "Intro " + item.upper().replace(" ", ", ", 3) + " outro"
    docs = [inside, "a short, ANSWER here short answer", "q0 q1 q2 q3 q4 q5 q6 q7 q8", "clean é text", *ODD]
    found = {r["row"].doc_id: r for r in decontamination.matches(documents(*docs), items).collect()}
    assert [r[:2] for r in found[0].runs] == [[1, 15]] and found[0]["items"] == ["1", "2"]
    first, last = found[0].runs[0][2:]
    assert inside.encode()[first:last].decode().startswith("Q0, Q1") and inside.encode()[last - 3:last] == b"Q13"
    assert [r[:2] for r in found[1].runs] == [[1, 3], [4, 6]] and found[1]["items"] == ["12"]
    assert all(not found[i].runs for i in range(2, len(docs)))
    kept = decontamination.decontaminated(clashing(*docs), items)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(2, len(docs))) and kept.columns == clashing("a").columns
    assert decontamination.decontaminated(documents("a b"), items.limit(0)).count() == 1


def test_decontamination_in_several_automata(spark, documents, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(f"w{i + k}" for k in range(12))) for i in range(9)], "item_id long, text string")
    docs = documents(" ".join(f"w{k}" for k in range(16)), "w3 w4", "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 x")
    whole = rows_of(decontamination.matches(docs, items), "n_words", "runs", "items")
    monkeypatch.setattr(decontamination, "MAX_WINDOWS", 4)
    assert rows_of(decontamination.matches(docs, items), "n_words", "runs", "items") == whole


def test_toxicity_on_held_out(spark, documents, clashing):
    rng = random.Random(4)
    common = ["the", "tree", "stands", "near", "water", "and", "grows"]
    def text(bad):
        words = [rng.choice(common) for _ in range(40)]
        for _ in range(4 * bad):
            words[rng.randrange(40)] = rng.choice(["zlorp", "zlorpen", "zlorped", "qqvile"])
        return " ".join(words)
    marks = [int(rng.random() < 0.25) for _ in range(400)]
    docs = documents(*[text(m) for m in marks], "zlorpest thing zlorpian", "", None)
    labels = spark.createDataFrame([(i, int(i % 9 != 0), m) for i, m in enumerate(marks) if i % 3] + [(None, 1, 1), (5, None, 1)],
                                   "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in toxicity.clean_documents(docs, labels).collect()}
    assert sum((i in kept) == (not m) for i, m in enumerate(marks)) >= 396
    assert 400 not in kept and {401, 402} <= kept
    assert toxicity.clean_documents(clashing("a", "b"), labels.limit(0)).count() == 2
    assert toxicity.clean_documents(documents().limit(0), labels).count() == 0


def test_toxicity_features_count_all_documents(spark):
    """The same rows in one chunk and in many give the same features, and no word that is as common in clean documents."""
    rng = random.Random(6)
    rows = [(" ".join([w for w in ("tree", "water", "stone", "grows") if rng.random() < 0.6] + ["zlorp"] * (i % 10 == 0)), int(i % 10 == 0))
            for i in range(200)]
    toxicity.worker_path(spark)
    labelled = spark.createDataFrame(rows, "text string, toxic long")
    one, many = (toxicity._select(labelled.repartition(n), ["toxic"]).tolist() for n in (1, 100))
    alone = {int(v) for t in ("zlorp",) for v in toxicity._features(pa.array([t]))[1]}
    assert one == many and one and set(one) <= alone


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((12, 16))
    rows = [(int(i), (base[i % 12] * (1 + i % 3) + rng.standard_normal(16) * 0.15).astype(float).tolist()) for i in range(150)]
    odd = [(200, None), (201, [0.0] * 16), (202, [float("nan")] * 16), (203, [1.0, None]), (204, [1.0, 2.0]), (205, [2.0, 4.0]), (206, [])]
    found = {r.vec_id: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")).collect()}
    m = np.array([r[1] for r in rows])
    m /= np.linalg.norm(m, axis=1)[:, None]
    near = m @ m.T >= 0.95
    np.fill_diagonal(near, False)
    got, want = sum(found[i].n_links for i in range(150)), near.sum()
    assert 0.98 * want <= got <= want
    assert all(found[i].n_links == 0 and found[i].kept for i in (200, 201, 202, 203, 206))
    assert (found[205].n_links, found[205].component_id, found[205].kept) == (1, 204, False)
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body><header>Site</header><nav><a href=x>Menu</a></nav>
<div class="cookie-notice">Cookies</div><aside><p>Side</p></aside><form><label>Name</label></form>
<article><h1>Title &amp; more</h1><p>One <b>two</b>\n three<p>Four&nbsp;five<br>six<script>var t="</p>";</script>
<!-- <p>hidden</p> --><div class="ads">Buy</div><ul><li>a<li>b</ul><section id="comments"><p>Nice!</p></section></article>
<footer>&copy; us</footer>"""


def test_pages(spark):
    pages = [(1, "http://a.example/x", PAGE), (2, None, None), (3, "bad", ""), (4, "http://b.example", "plain &lt; text"),
             (5, "http://a.example/y", "<p>no article</p><div role=navigation>nav</div><p>two"), (1, "http://a.example/x", PAGE)]
    found = html_text.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string"))
    article = "Title & more\nOne two three\nFour five six\na\nb"
    assert rows_of(found, "page_id", "text", "n_chars") == sorted(
        [(1, article, len(article))] * 2 + [(2, "", 0), (3, "", 0), (4, "plain < text", 12), (5, "no article\ntwo", 14)], key=str)


def test_wrapper_tells_template_from_content(spark):
    pages = [(i, f"http://host.example/{i}", f"<div><p>Welcome to us</p></div><table><tr><td>story {i} of many</td></tr></table>"
              f"<div><p>Call {i % 2}</p></div>") for i in range(30)]
    found = html_text.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert {r.text for r in found.collect()} == {f"story {i} of many" for i in range(30)}


def test_copies_of_pages_weigh_once(spark):
    """Equal pages, with and without a host, and a host where 70% of the pages are mirrors of one."""
    page = "<div><p>Welcome to us</p></div><table><tr><td>story {} of many</td></tr></table><ul><li>a</ul>"
    rows = [(i, "http://equal.example/x", page.format("one")) for i in range(14)] + [(20 + i, None, page.format("none")) for i in range(14)]
    rows += [(40 + i, f"http://mirror.example/{i}", page.format(max(i, 28))) for i in range(40)]
    found = {r.page_id: r.text for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for host, ids in (("one", range(14)), ("none", range(20, 34))):
        assert {found[i] for i in ids} == {f"Welcome to us\nstory {host} of many\na"}
    assert [found[40 + i] for i in range(40)] == [f"story {max(i, 28)} of many" for i in range(40)]


@pytest.mark.parametrize("trees,nodes", [(16, 512), (3, 8)])
def test_wrapper_of_few_pages_and_of_many_layouts(spark, monkeypatch, trees, nodes):
    """Two pages of a host, and a host of 40 layouts whose notice stands in an element of its own in the rarer ones."""
    monkeypatch.setattr(html_text, "MERGED_TREES", trees, raising=False)
    monkeypatch.setattr(html_text, "WRAPPER_NODES", nodes, raising=False)
    rows = [(i, f"http://few.example/{i}", f"<div><p>Welcome to us</p></div><table><tr><td>story {i}</table>") for i in range(2)]
    for i in range(40):
        notice = "<section><p>Please register</section>" if i >= 30 else ""
        rows.append((10 + i, f"http://many.example/{i}", f"<div class=a{i}><h1>title {i}</h1><dl><dt>story {i}</dl></div>{notice}"))
    found = {r.page_id: r.text for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [found[i] for i in range(2)] == ["story 0", "story 1"]
    assert [found[10 + i] for i in range(40)] == [f"title {i}\nstory {i}" for i in range(40)]


def test_slots_by_path_where_the_wrapper_lacks_nodes():
    wrapper, page = ["r", ["x", ["#"]]], ["r", ["x", ["#"]], ["y", ["#"]], ["z", ["#"]], ["y", ["#"]]]
    first, *rest = html_text.slots(wrapper, page)
    assert first == 0 and max(rest) < 0 and rest[0] == rest[2] != rest[1]


def test_tree_matching():
    a = ["r", ["x", ["#"]], ["y", ["#"], ["z"]], ["#"]]
    b = ["r", ["y", ["z"]], ["w"], ["#"]]
    assert html_text.match(a, b, {})[0] == 4
    assert html_text.slots(html_text.merged(a, b), a) == [0, 1, 2]


def test_language_model(documents):
    texts = near_copies(5, 60) + ODD + ["Der Hund läuft. " * 20]
    docs = documents(*texts)
    model = lm_scoring.train(docs.filter(~lm_scoring.held_out(F.col("doc_id"))))
    assert np.allclose((10.0 ** model["table"]).sum(1), 1, atol=1e-4)
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    counts = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    rows = {r.doc_id: r for r in lm_scoring.score(docs, model).collect()}
    for i, t in enumerate(tokens):
        base = sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in t)
        assert abs(rows[i].base_score - base) < 1e-6 and rows[i].n_tokens == len(t)
        assert rows[i].n_known == sum(counts[w] > 0 for w in t) and np.isfinite(rows[i].score)
    assert sum(r.score for r in rows.values()) > sum(r.base_score for r in rows.values())
    nothing = lm_scoring.score(documents("a b"), lm_scoring.train(documents().limit(0))).first()
    assert (nothing.n_tokens, nothing.n_known, nothing.base_score) == (3, 0, 0.0)


def test_pipeline_stages_keep_columns(spark, documents):
    names = documents("x").columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "tokens"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, docs.filter("doc_id < 30"), "/root/testdata/sf0.001")
        assert kept.columns == names and 15 < kept.count() <= 30, name
    assert hashlib.sha256(b"x").hexdigest()
