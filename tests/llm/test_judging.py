"""Toxicity and quality rules."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from wattflow.llm import quality, toxicity

rng = np.random.default_rng(0)
WORDS = [f"{a}{b}" for a in ("ba", "ke", "li", "mo", "nu", "pre", "stra", "vo") for b in ("ne", "ton", "r", "mil", "sa", "dok", "xi", "lle", "q", "rn")]


def prose(n):
    return " ".join(rng.choice(WORDS, n))


def plain_segments(places, weights, drift):
    """Maximal scoring segments by their definition: the best one, then those left and right of it."""
    n = places[-1] + 1 if places else 0
    score = [-drift] * n
    for p, w in zip(places, weights, strict=True):
        score[p] = w

    def best(a, b):
        found = max(((sum(score[i:j]), -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
        if found[0] <= 1e-9:
            return []
        i = -found[2]
        j = i - found[1]
        return best(a, i) + [(i, j - 1, found[0])] + best(j, b)

    return best(0, n)


def test_segments_are_the_maximal_ones():
    for seed in range(40):
        own = np.random.default_rng(seed)
        places = sorted(own.choice(30, 8, replace=False).tolist())
        weights = own.uniform(0.3, 3, 8).round(3).tolist()
        got = toxicity.segments(places, weights, 0.37)
        expected = plain_segments(places, weights, 0.37)
        assert [x[:2] for x in got] == [x[:2] for x in expected]
        assert np.allclose([x[2] for x in got], [x[2] for x in expected])
    assert toxicity.segments([], []) == []


def test_extreme_value_rate():
    weights, chances = np.array([2.0, -0.5]), np.array([0.1, 0.9])
    rate = toxicity.extreme_value_rate(weights, chances)
    assert (chances * np.exp(rate * weights)).sum() == pytest.approx(1, abs=1e-9) and rate > 0
    assert toxicity.extreme_value_rate(np.array([-1.0]), np.array([1.0])) == 1.0


def test_toxicity_on_held_out_texts(spark, make_docs):
    texts, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = prose(60).split()
        for place in rng.choice(60, 4 if toxic else 0, replace=False):
            words[place] = str(rng.choice(["vilewort", "Schmutzig", "grobian"])) + str(rng.choice(["", "a", "b"]))
        texts.append(" ".join(words))
        labels.append((i, int(toxic)))
    texts += [None, "", "vilewort grobian vilewort", (None, "no id")]
    labels += [(3, None), (None, 1), (0, 0)]
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(spark, make_docs(texts), table).collect()}
    assert len(got) == len(texts) and all(0 <= r.score <= 1 for r in got.values())
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in held) for i in range(400)) and got[None].held_out
    assert np.mean([got[i].predicted == labels[i][1] for i in held]) > 0.97
    assert got[402].predicted == 1 and got[400].predicted == got[401].predicted == 0 and got[400].score == got[401].score
    assert got[0].passages and not got[1].passages
    flipped = table.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    again = {r.doc_id: r.score for r in toxicity.score_toxicity(spark, make_docs(texts), flipped).collect()}
    assert all(again[i] == pytest.approx(got[i].score) for i in got)


def test_toxicity_without_labels(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score_toxicity(spark, make_docs(["a", None]), none).collect()] == [0, 0]
    assert toxicity.score_toxicity(spark, make_docs([]), none).count() == 0


def plain_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    triples = Counter(zip(words, words[1:], words[2:], strict=False))
    again = {k for i in range(len(words) - 2) if triples[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again), failed


def test_quality_rules(spark, make_docs):
    texts = [prose(int(n)) for n in rng.integers(60, 200, 150)]
    junk = [" ".join(w + "###" for w in prose(90).split()), prose(90).upper(), "\n".join(f"{prose(4)}\nsame line" for _ in range(20)), " ".join(w * 5 for w in prose(90).split())]
    odd = [None, "", " \n\t ", "a b a b a b", "one two\nthree\none two\n", "x " * 300, "é ß |\x0b<b>\r\n\r\n", "same " * 3 + prose(70)]
    df = make_docs([*texts, *junk, *odd, (None, texts[0])])
    rows = quality.quality_rules(spark, df.withColumnRenamed("n_tokens", "n_words")).collect()
    assert len(rows) == len(texts) + len(junk) + len(odd) + 1
    for row in rows:
        text = [*texts, *junk, *odd][row.doc_id] if row.doc_id is not None else texts[0]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed) == plain_base(text)
        assert not (row.base_failed and row.kept)
    kept = {r.doc_id for r in rows if r.kept}
    assert set(range(len(texts))) <= kept and not kept & set(range(len(texts), len(texts) + len(junk)))
    assert quality.quality_rules(spark, make_docs([])).count() == 0


def test_quality_of_small_and_unknown_groups(spark):
    rows = [(i, prose(80), None if i % 2 else "en", f"s{i}" if i % 3 else None) for i in range(12)]
    got = quality.quality_rules(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert len(got) == 12 and all(r.kept for r in got)


def test_salted_joins_give_the_same(spark, make_docs, monkeypatch):
    df = make_docs([prose(int(n)) for n in rng.integers(60, 90, 60)])
    few = sorted((r.doc_id, r.kept) for r in quality.quality_rules(spark, df).collect())
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", 0)
    assert sorted((r.doc_id, r.kept) for r in quality.quality_rules(spark, df).collect()) == few
