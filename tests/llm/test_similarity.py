"""Near duplicates, passages and decontamination against plain versions."""

import hashlib
import random
import re

import pyarrow as pa
import pytest

from wattflow.llm import decontaminate, jaccard, substrings
from wattflow.llm import words as W
from wattflow.llm.components import connected_components

lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def copies(seed, n=60):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n):
        if out and rnd.random() < 0.6:
            own = rnd.choice(out).split()
            for _ in range(rnd.choice([0, 1, 2, 4])):
                own[rnd.randrange(len(own))] = rnd.choice(words)
        else:
            own = [rnd.choice(words) for _ in range(rnd.choice([1, 3, 5, 30, 60, 120]))]
        out.append(" ".join(own))
    return [None, "", " \n ", "A b", "a B", *out]


def components_of(links, nodes):
    top = {x: x for x in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


@pytest.mark.parametrize("few", [8, 1])
def test_near_duplicates(spark, make_docs, monkeypatch, few):
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "BLOCK", 3 if few == 1 else 512)
    texts = copies(few)
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    expected = components_of(links, range(len(texts)))
    got = {r.doc_id: r for r in jaccard.near_duplicates(spark, make_docs(texts)).collect()}
    assert {k: r.component_id for k, r in got.items()} == expected
    assert all(r.n_shingles == len(sets[k]) for k, r in got.items()) and links


def test_near_duplicates_of_odd_tables(spark, make_docs):
    text = "one two three four five six"
    rows = jaccard.near_duplicates(spark, make_docs([(None, text), (4, text), (4, text), (9, "x")])).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in rows) == [(-1, 4), (4, 4), (4, 4), (9, 9)]
    assert jaccard.near_duplicates(spark, make_docs([])).count() == 0


def test_rows_without_an_id_are_bridges(spark, make_docs):
    """1 and 2 are linked only through a text that no row with an id has; rows of one id are told apart."""
    own = [f"w{i}" for i in range(64)]
    a, n, b = " ".join(own), " ".join([*own[4:], "x1", "x2", "x3", "x4"]), " ".join([*own[8:], *(f"x{i}" for i in range(1, 9))])
    sets = [shingles(t) for t in (a, n, b)]
    link = lambda i, j: 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    assert link(0, 1) and link(1, 2) and not link(0, 2)
    rows = jaccard.near_duplicates(spark, make_docs([(1, a), (None, n), (None, n), (2, b), (1, "quite another"), (None, "alone")])).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in rows) == [(-1, 1, -1), (-1, 60, 1), (-1, 60, 1), (1, 1, 1), (1, 60, 1), (2, 60, 1)]
    assert len({r.component_key for r in rows}) == 3 and len({(r.doc_id, r.text_key) for r in rows}) == 5


def test_words_are_those_of_the_pattern():
    rnd = random.Random(0)
    for table, pattern in ((W.BLANK_SEPARATED, rb"[^\x20\x09-\x0D]+"), (W.ALPHANUMERIC, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        texts = [None if rnd.random() < 0.1 else "".join(rnd.choice("aBz\x00é日 \n\t.,|Z9 ") for _ in range(rnd.choice([0, 1, 30]))) for _ in range(200)]
        found, seen = W.words(*W.column_bytes(pa.array(texts, pa.string()).slice(1)), table), {}
        expected = [re.findall(pattern, lower(t).encode()) for t in texts[1:]]
        assert [int(x) for x in found.bounds[1:] - found.bounds[:-1]] == list(map(len, expected))
        for word, value in zip([w for own in expected for w in own], found.prints.tolist(), strict=True):
            assert seen.setdefault(word, value) == value
        assert len(set(seen.values())) == len(seen)


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)] + [(7, 7)]
    nodes = {x for e in edges for x in e}
    got = {r.node: r.root for r in connected_components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == components_of(edges, nodes)
    for lot in (1, 3, 20):  # forests of several lots, joined by rounds of stars
        found = connected_components(spark, spark.createDataFrame(edges, "a long, b long"), lot_edges=lot).collect()
        assert len(found) == len(nodes) and {r.node: r.root for r in found} == components_of(edges, nodes)
    assert connected_components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


PASSAGE = " ".join(f"p{i}" + "." * (i % 9 == 8) for i in range(63))


def test_repeated_passages(spark, make_docs):
    own = lambda k, n=40: " ".join(f"{k}{i}" for i in range(n))
    line = own("line", 60)
    texts = [own("a") + " " + PASSAGE + " " + own("b"), own("c"), "x\n" + own("d") + ". " + PASSAGE + " " + own("e"), None, "", line, line.replace("line30", "other") + "\n" + own("f"), own("g") + "\n" + own("g")]
    df = make_docs(texts)
    found = substrings.repeated_passages(spark, df)
    assert {r.doc_id for r in found.collect()} == {2, 6}
    left = {r.doc_id: r for r in substrings.remove_passages(df, found).collect()}
    assert len(left) == len(texts) and left[2].n_tokens == 7
    assert all(left[i].text == texts[i] for i in (0, 1, 3, 4, 5, 7))
    assert "p20" not in left[2].text and "d39" in left[2].text and "e39" in left[2].text
    assert left[6].text == own("f")
    assert substrings.repeated_passages(spark, make_docs([])).count() == 0
    assert substrings.repeated_passages(spark, make_docs([(1, PASSAGE), (1, PASSAGE), (None, PASSAGE)])).count() == 0


def test_lines_of_a_common_template_are_all_compared(spark, make_docs):
    """Lines that share bands by their template, in which each line is like one other only."""
    head = " ".join(f"t{i}" for i in range(106))
    texts = [f"{head} " + " ".join(f"own{k // 2}x{i}" for i in range(13)) + f" last{k}" for k in range(240)]
    found = substrings.repeated_passages(spark, make_docs(texts)).where("kind = 'near'").collect()
    assert sorted((r.doc_id, r.kept_ids, r.first_word, r.n_words) for r in found) == [(k, [k - 1], 0, 120) for k in range(1, 240, 2)]


@pytest.mark.parametrize("size", [19, 20, 33, 51, 60])
@pytest.mark.parametrize("stops", [0, 25])
def test_passages_that_keep_to_no_sentences(spark, make_docs, size, stops):
    """Whole passages of 20 words or more go, whatever surrounds them, with other line breaks and in capitals."""
    own = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    passages = [[f"P{k}x{i}" + "." * (stops and i % stops == stops - 1) for i in range(size)] for k in range(6)]
    texts = [f"{own(f'a{k}', 7 + k)} {' '.join(p)} {own(f'b{k}', 50)}" for k, p in enumerate(passages)]
    texts += [f"{own(f'c{k}', 60)} {' '.join(p[:9])}\n{' '.join(p[9:]).lower()} {own(f'd{k}', k)}" for k, p in enumerate(passages)]
    found = substrings.repeated_passages(spark, make_docs(texts)).collect()
    expected = [(6 + k, "exact", 60, size, [k]) for k in range(6)] if size >= 20 else []
    assert sorted((r.doc_id, r.kind, r.first_word, r.n_words, r.kept_ids) for r in found) == expected
    for r in found:
        cut = texts[r.doc_id].encode()[r.first_byte : r.first_byte + r.n_bytes].decode().split()
        assert [w.lower() for w in cut] == [w.lower() for w in passages[r.doc_id - 6]]


def gone(found):
    out = {}
    for r in found:
        out.setdefault(r.doc_id, set()).update(range(r.first_word, r.first_word + r.n_words))
    return out


def plain_gone(texts, window=20):
    """The words of all windows that a text of a smaller number has as well."""
    words, least, out = [t.split() for t in texts], {}, {}
    for i, w in enumerate(words):
        for a in range(len(w) - window + 1):
            least.setdefault(tuple(w[a : a + window]), i)
    for i, w in enumerate(words):
        for a in range(len(w) - window + 1):
            if least[tuple(w[a : a + window])] < i:
                out.setdefault(i, set()).update(range(a, a + window))
    return out


def test_a_passage_several_times_in_one_text(spark, make_docs):
    own = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    p = own("p", 30)
    inside = f"{own('s', 15)} {p} {own('t', 15)}"  # equal around p at both places of text 2, not in text 1
    texts = [
        own("x", 9) + " w" * 25, own("y", 9) + " w" * 42,
        f"{own('a', 30)} {p} {own('b', 30)}", f"{own('c', 14)} {inside} {own('d', 29)} {inside}",
    ]
    expected = plain_gone(texts)
    assert expected[1] == set(range(9, 51)) and expected[3] == set(range(29, 59)) | set(range(118, 148))
    assert gone(repeated_exact(spark, make_docs(texts))) == expected


def repeated_exact(spark, docs):
    return substrings.repeated_passages(spark, docs).where("kind = 'exact'").collect()


@pytest.mark.parametrize("seed", range(4))
def test_repeats_of_few_words_equal_brute_force(spark, make_docs, seed):
    """Texts over two words, in which anchors and what surrounds them repeat within and across texts."""
    rnd, texts = random.Random(seed), []
    for _ in range(24):
        parts = [rnd.choice(["u", "v"]) * 1 for _ in range(rnd.randint(0, 30))]
        for _ in range(rnd.randint(0, 4)):
            unit = rnd.choice([["u"], ["u", "v"], ["v", "v", "u"]])
            parts += unit * rnd.randint(1, 30) + [rnd.choice("uv") for _ in range(rnd.randint(0, 12))]
        texts.append(" ".join(parts))
    assert gone(repeated_exact(spark, make_docs(texts))) == plain_gone(texts)


def test_band_recall():
    rnd, hits = random.Random(5), 0
    for _ in range(100):
        a = {rnd.randrange(1 << 62) for _ in range(90)}
        b = set(list(a)[10:]) | {rnd.randrange(1 << 62) for _ in range(10)}  # 0.8
        values = [sorted(a), sorted(b)]
        keys = substrings.band_keys(W.np.array(values[0] + values[1], W.np.uint64), W.np.array([0, len(a), len(a) + len(b)]))
        hits += (keys[0] == keys[1]).any()
    assert hits >= 95


def plain_matches(text, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    own, hit, found = words(text), set(), set()
    for item, other in items:
        w = words(other)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            part = w[i : i + window]
            for at in range(len(own) - len(part) + 1):
                if own[at : at + len(part)] == part:
                    hit |= set(range(at, at + len(part)))
                    found.add(item)
    return len(own), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination(spark, make_docs, block_bytes):
    q = [f"q{i}" for i in range(30)]
    items = [(10, " ".join(q)), (2, "Short, item!"), (3, None), (4, ""), (5, " ".join(q[5:17])), (2, "other two")]
    texts = ["x y " + " ".join(q[3:20]) + " z", "a SHORT item and other two", None, "", " ".join(q[:9]), "q " * 50 + " ".join(q[8:18]), "short\x00item"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(spark, make_docs(texts), bench, block_bytes=block_bytes).collect()}
    for i, text in enumerate(texts):
        assert (got[i].n_words, got[i].n_hit, sorted(set(got[i]["items"]))) == plain_matches(text, items)
    assert got[0].near_items == [5] and [tuple(h) for h in got[0].hits] == [(2, 19)]
    digest = {r.doc_id: r for r in decontaminate.digest(decontaminate.decontaminate(spark, make_docs(texts), bench)).collect()}
    assert digest[0].items_sha256 == hashlib.sha256(b"10,5").hexdigest() and not digest[2].contaminated
    assert digest[2].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert decontaminate.decontaminate(spark, make_docs([]), bench).count() == 0
    assert decontaminate.decontaminate(spark, make_docs(texts), bench.where("false")).agg({"n_hit": "sum"}).first()[0] == 0


def test_hits_do_not_depend_on_query_blocks(spark, make_docs):
    """Windows of several items that follow one another, overlap or repeat."""
    rnd = random.Random(8)
    words = [f"v{i}" for i in range(12)]
    items = [(k, " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 2, 3])))) for k in range(40)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.choice([0, 5, 60]))) for _ in range(12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = [{r.doc_id: r.asDict(True) for r in decontaminate.decontaminate(spark, make_docs(texts), bench, window=3, block_bytes=b).collect()} for b in (1 << 20, 60)]
    assert found[0] == found[1] and any(len(r["hits"]) > 1 for r in found[0].values())
    for i, text in enumerate(texts):
        assert (found[0][i]["n_words"], found[0][i]["n_hit"], found[0][i]["items"]) == plain_matches(text, items, 3)


@pytest.mark.parametrize("parts", [1, 4])
def test_near_items_do_not_depend_on_blocks(spark, make_docs, parts):
    """Words that no text has are left out, items of few words are found, and other texts of a block change nothing."""
    q = [f"q{i}" for i in range(30)]
    items = [(1, " ".join(q)), (2, "few words"), (3, "nowhere seen")]
    texts = ["x " + " ".join(q[3:20]), "words between few", "few", "q3 q4 q5 q6 q7", "y z"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.decontaminate(spark, make_docs(texts).repartition(parts), bench).collect()
    assert {r.doc_id: r.near_items for r in found} == {0: [1], 1: [2], 2: [], 3: [], 4: []}
