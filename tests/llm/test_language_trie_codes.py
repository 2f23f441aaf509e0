"""Language profiles, the prefix trie and vector codes against brute force, and their edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from wattflow.llm import language
from wattflow.llm.language import identify_languages
from wattflow.llm.prefix_trie import prefix_trie
from wattflow.llm.scan import running_sums
from wattflow.llm.scratch import Scratch
from wattflow.llm.vector_codes import Codebooks, vector_codes, with_label_error

# --- sums in a global order


def test_running_sums_span_tasks(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([1, 1, 1, 2, 5]), i, rnd.randint(-9, 9), 2**62) for i in range(400)]
    rnd.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "k long, i long, v long, big long").repartition(7)
        got = running_sums(Scratch(spark, "test"), df, "sums", ["k"], ["i"], ["v", "big"], ["k", "i"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sums, seen, expected = {}, {}, set()
    for k, i, v, _ in sorted(rows):
        before, n = sums.get(k, 0), seen.get(k, 0)
        sums[k], seen[k] = before + v, n + 1
        around = lambda x: (x + 2**63) % 2**64 - 2**63
        expected.add((k, i, sums[k], before, around((n + 1) * 2**62), around(n * 2**62)))
    assert set(map(tuple, got)) == expected and len(got) == len(rows)


# --- language


def plain_bundle(text, n, dimensions):
    letters = "".join(c if language._kind()[ord(c)] else "\0" for c in text.lower())
    words = [w for w in letters.split("\0") if w]
    line = "\0" + "\0".join(words) + "\0" if words else "\0"
    total = np.zeros(dimensions)
    for i in range(len(line) - n + 1):
        vector = np.ones(dimensions)
        for k, c in enumerate(line[i : i + n]):
            vector *= np.roll(language.letter_vectors(np.array([ord(c)]), dimensions)[0], n - 1 - k)
        total += vector
    return total


@pytest.mark.parametrize("stretch", [7, 1 << 18])
def test_bundles_equal_a_plain_version(monkeypatch, stretch):
    monkeypatch.setattr(language, "STRETCH", stretch)
    monkeypatch.setattr(language, "BLOCK", 16)
    texts = ["Hello, World! hello", "  a  ", "", None, "Ärger über Öl — é́t́é 日本語", "...", "x" * 50, "ab\ncd  ef\n"]
    found = language.Profiles(texts, 3)
    bundles = found.bundled(found.owner, found.size, 64)
    for text, bundle in zip(texts, bundles, strict=True):
        assert (bundle == plain_bundle(text or "", 3, 64)).all() or not text
    assert found.has_letter.tolist() == [True, True, False, False, True, False, True, True]
    classes = np.array([0, 1, 0, -1, 1, 0, -1, 0])
    both = found.by_class(classes, 2, 64)
    for k in (0, 1):
        assert (both[k] == sum(b for b, c in zip(bundles, classes, strict=True) if c == k)).all()


def test_language_edge_cases(spark):
    en, de = "the cat and the other thing that they had", "der die das und nicht eine schöne Straße ich"
    rows = [(i, en if i % 2 else de, "en" if i % 2 else "de") for i in range(40)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "123 !!! ́", None), (103, "the thing", None), (104, "Straße schöne", None), (None, "the cat", "fr"), (105, (en + " ") * 30_000, None), (5, en, "en"), (5, en, "en")]
    docs = spark.createDataFrame([(*r, "x", 1.0, True) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double, held_out boolean")
    got = identify_languages(spark, docs).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "held_out", "lang_pred", "score"}
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == ("en" if i % 2 else "de") for i in range(40))
    assert [(by_id[i].lang_pred, by_id[i].score) for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert (by_id[103].lang_pred, by_id[104].lang_pred, by_id[105].lang_pred) == ("en", "de", "en")
    assert by_id[None].lang_pred == "en" and by_id[None].held_out is False  # nothing is learned from a row without an id
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert all(0 <= r.score <= 1 for r in got)
    assert identify_languages(spark, docs.limit(0)).count() == 0
    alone = identify_languages(spark, docs.withColumn("lang", docs.lang.substr(9, 1)).where("lang = 'none'").unionByName(docs.where("doc_id = 103"))).collect()
    assert [(r.lang_pred, r.score) for r in alone] == [("und", 0.0)]


def test_labels_of_held_out_rows_do_not_count(spark):
    rows = [(i, "the cat and the other" if i % 2 else "der die das und nicht", "en" if i % 2 else "de") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    wrong = spark.createDataFrame([(i, t, "fr" if zlib.crc32(str(i).encode()) % 5 == 0 else k) for i, t, k in rows], docs.schema)
    assert sorted(map(tuple, identify_languages(spark, docs).collect())) == sorted(map(tuple, identify_languages(spark, wrong).collect()))


# --- prefix trie

CONV = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(own)] for c, own in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(turns.get(c - c % 100, [])[:h] + own[h:])
    nodes = {}
    for c, own in built.items():
        for d in range(len(own) + 1):
            nodes.setdefault(own[:d], []).append(c)
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        kids = lambda k: sum(1 for x in nodes if len(x) == len(k) + 1 and x[: len(k)] == k)
        saved = sum((len(nodes[k]) - 1) * len(k[-1][1]) for k in below if k)
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(key))
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), kids(key), sum(kids(k) == 0 for k in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie(spark, rows, tasks=1):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], f"{CONV}, depth int, conv string").repartition(tasks)
    return prefix_trie(spark, df)


def digest(df):
    return sorted(map(tuple, df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, seed, monkeypatch):
    from wattflow.llm import prefix_trie as module

    monkeypatch.setattr(module, "LOT_TURNS", 3)
    monkeypatch.setattr(module, "LOT_ENDS", 2)
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(320), 60) + [0, 200]:
        rows += [(c, rnd.choice([t, t, None, 1]), rnd.choice(["user", "bot", None]), rnd.choice(["a", "bé", "", None, "a"])) for t in range(rnd.choice([1, 2, 3, 9]))]
    rows += [(7, t, "user", "long") for t in range(60)] + [(None, 0, "user", "lost")] + [(12, 0, "user", "same")] * 3
    rnd.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = trie(spark, rows, 5)
        assert digest(found) == plain_trie(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spans = {r["rank"]: r for r in found.collect()}  # intervals nest and their sizes are those of the subtrees
    assert sorted(spans) == list(range(len(spans))) and spans[0].rank_end == len(spans)
    for r in spans.values():
        inner = [spans[i] for i in range(r["rank"] + 1, r.rank_end)]
        assert all(x.depth > r.depth and x.rank_end <= r.rank_end for x in inner)
        assert r.rank_end == len(spans) or spans[r.rank_end].depth <= r.depth


def test_trie_of_turnless_and_no_conversations(spark):
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)  # its base 100 is absent, its own two turns are cut
    rows = [(c, 0, "user", "x"), (c, 1, "bot", "y")]
    assert digest(trie(spark, rows)) == plain_trie(rows)
    assert digest(trie(spark, rows))[0][:6] == (c, 0, None, 1, 0, 1)
    assert trie(spark, [(None, 0, "user", "x")]).count() == 0


# --- vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    whole = [(i, label, [int(np.floor(scale * float(x))) for x in v]) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = len(whole[0][2]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    first = sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[cut(v)[p] for _, _, v in first] for p in range(parts)]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    near = lambda x, book: min((far(x, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        new = []
        for p, book in enumerate(books):
            own = [[] for _ in book]
            for _, _, v in whole:
                own[near(cut(v)[p], book)[1]].append(cut(v)[p])
            new.append([[sum(x[k] for x in xs) // len(xs) for k in range(width)] if xs else c for xs, c in zip(own, book, strict=True)])
        books = new
    found = [(i, label, [near(x, book) for x, book in zip(cut(v), books, strict=True)]) for i, label, v in whole]
    total = {}
    for _, label, best in found:
        total[label] = total.get(label, 0) + sum(d for d, _ in best)
    sha = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), total[label], sha) for i, label, best in found), key=repr)


VECTORS = "vec_id long, embedding array<float>, label int, code string, v binary"


def coded(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", b"y") for r in rows], VECTORS).repartition(3)
    return sorted(map(tuple, vector_codes(spark, df, **how).drop("label").collect()), key=repr)


def test_codes_equal_brute_force(spark):
    rnd = random.Random(5)
    value = lambda: float(np.float32(rnd.choice([rnd.gauss(0, 1), -0.5, 0.25])))
    rows = [(i, [value() for _ in range(16)], rnd.choice([0, 1, None])) for i in rnd.sample(range(-20, 200), 90)]
    rows += rows[:5] + [(301, [0.25] * 16, 1)] * 4 + [(302, None, 1), (303, [0.0] * 15 + [None], 1), (304, [float("nan")] * 16, 0), (305, [float("inf")] + [0.0] * 15, 0), (None, [0.5] * 16, 2)]
    assert coded(spark, rows) == plain_codes(rows)
    assert coded(spark, rows[:7]) == plain_codes(rows[:7])
    assert coded(spark, rows, parts=4, entries=5, rounds=2) == plain_codes(rows, 4, 5, 2)


def test_codes_of_odd_tables(spark):
    assert coded(spark, []) == coded(spark, [(1, None, 1), (2, [float("nan")] * 8, 1)]) == []
    with pytest.raises(ValueError):
        coded(spark, [(1, [0.0] * 8, 1), (2, [0.0] * 16, 1)])
    with pytest.raises(ValueError):
        coded(spark, [(1, [0.0] * 9, 1)])
    with pytest.raises(ValueError):
        coded(spark, [(1, [1e20] * 8, 1)])


def test_exponion_search_is_exact():
    rng = np.random.default_rng(2)
    for spread in (2, 40, 5000):
        books = Codebooks(rng.integers(-spread, spread, (3, 9, 4)))
        x = rng.integers(-spread, spread, (500, 4))
        every = ((x[:, None] - books.entries[1][None]) ** 2).sum(2)
        for start in (np.zeros(500, np.uint8), rng.integers(0, 9, 500).astype(np.uint8)):
            best, least = books.search(1, x, start)
            assert (best == every.argmin(1)).all() and (least == every.min(1)).all()


def test_many_labels_are_salted(spark, monkeypatch):
    from wattflow.llm import vector_codes as module

    rows = spark.createDataFrame([(i, i % 3 or None, "00", i) for i in range(30)], "id long, label int, code string, error long")
    labels = rows.groupBy("label").agg({"error": "sum"}).withColumnRenamed("sum(error)", "label_error")
    few = sorted(map(tuple, with_label_error(rows, labels).collect()))
    monkeypatch.setattr(module, "BROADCAST_LABELS", 1)
    assert sorted(map(tuple, with_label_error(rows, labels).select("id", "label", "code", "error", "label_error").collect())) == few and len(few) == 30
