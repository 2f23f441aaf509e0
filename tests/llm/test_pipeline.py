"""The corpus pipeline on a small folder of tables, stage by stage."""

import random

import corpus_pipeline

PASSAGE = " ".join(f"shared{i}" for i in range(60)) + "."


def tables(spark, folder):
    rnd = random.Random(4)
    words = [f"{a}{b}" for a in ("ba", "ke", "li", "mo", "nu", "vo") for b in ("ne", "ton", "r", "mil", "sa", "dok", "lle")]
    prose = lambda n: " ".join(rnd.choice(words) + str(rnd.randrange(300)) for _ in range(n))
    docs, labels = {}, []
    for i in range(120):
        toxic = i % 4 == 1
        own = prose(50).split()
        for k in range(4 if toxic else 0):
            own[k * 9] = "vilewort"
        docs[i] = " ".join(own)
        labels.append((i, 1, int(toxic)))
    item = prose(14)
    docs |= {200: prose(40) + " vilewort and vilewort then vilewort", 210: prose(60), 220: prose(30) + ". " + PASSAGE + " " + prose(30), 221: prose(30) + ". " + PASSAGE + " " + prose(30), 230: prose(20) + " " + item + " " + prose(20), 240: PASSAGE, 250: None, 251: ""}
    docs |= {211: docs[210], 212: docs[210] + " more"}
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_stages(spark, tmp_path):
    folder = f"file://{tmp_path}"
    docs = tables(spark, folder)
    now, kept = spark.read.parquet(f"{folder}/documents.parquet"), set(docs)
    gone = [{i for i in range(120) if i % 4 == 1} | {200}, {211, 212}, {240}, {230}]
    for (name, stage), out in zip(corpus_pipeline.STAGES[:-1], gone, strict=True):
        columns = now.columns
        stage(spark, now, folder).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept -= out
        rows = {r.doc_id: r for r in now.collect()}
        assert set(rows) == kept and now.columns == columns, name
    assert "shared7" in rows[220].text and "shared7" not in rows[221].text
    assert rows[221].n_chars == len(rows[221].text) and all(rows[i].text == docs[i] for i in kept - {221})
    packed = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in packed.collect()} == kept
    assert len(corpus_pipeline.STAGES) == 5
