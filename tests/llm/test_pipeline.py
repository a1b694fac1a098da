"""The corpus pipeline, stage by stage on its own input, with planted cases."""

import random

from conftest import DOCS, prose

import corpus_pipeline


def corpus(spark):
    rng = random.Random(12)
    rows = [(i, prose(rng, 120), "en", "a", 1) for i in range(80)]
    rows += [(100 + i, rows[i][1], "en", "a", 1) for i in range(10)]  # copies
    shared = "This very line stands in a good many documents, word for word, of course."
    rows += [(200 + i, f"{prose(rng, 60)}\n{shared}\n{prose(rng, 60)}", "en", "a", 1) for i in range(8)]
    item = prose(rng, 40)
    rows += [(300 + i, f"{prose(rng, 60)} {item} {prose(rng, 60)}", "en", "a", 1) for i in range(3)]
    rows += [(400 + i, f"{prose(rng, 40)} vilescum hatefool gruntslur {prose(rng, 40)} vilescum gruntslur", "en", "a", 1) for i in range(60)]
    rows += [(None, None, None, None, None), (500, "", None, None, 0)]
    labels = [(i, 1, 0) for i in range(80)] + [(400 + i, 1, 1) for i in range(40)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), spark.createDataFrame([(1, item)], "item_id long, text string")


def test_stages(spark, save):
    docs, labels, benchmark = corpus(spark)
    d = save(documents=docs, labels=labels, benchmark=benchmark)
    seen, own = {}, spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, own, d))
        if name != "packing":
            assert out.columns == list(corpus_pipeline.COLUMNS) and out.dtypes == own.dtypes
            seen[name] = {r.doc_id: r.text for r in out.collect()}
        own = out
    clean = set(range(80))
    assert set(range(400, 460)).isdisjoint(seen["toxicity"]) and clean <= seen["toxicity"].keys()
    assert sum("This very line" in (t or "") for t in seen["line_dedup"].values()) == 1 and "This very line" in seen["line_dedup"][207]
    assert seen["near_dedup"].keys() >= clean and set(range(100, 110)).isdisjoint(seen["near_dedup"])
    assert set(range(300, 303)).isdisjoint(seen["decontamination"]) and seen["decontamination"].keys() >= clean | set(range(200, 208))
    assert {r.doc_id for r in own.select("doc_id").distinct().collect()} == seen["decontamination"].keys()
    again = {r.doc_id for r in corpus_pipeline.run(spark, d).select("doc_id").distinct().collect()}
    assert again == seen["decontamination"].keys()


def test_empty_tables(spark, save):
    docs, labels, benchmark = corpus(spark)
    d = save(documents=docs.limit(0), labels=labels.limit(0), benchmark=benchmark.limit(0))
    assert corpus_pipeline.run(spark, d).collect() == []


def test_clean_texts_stay_beside_bad_ones(spark, save):
    docs, labels, benchmark = corpus(spark)
    rng = random.Random(31)
    item, copied = benchmark.collect()[0].text, docs.where("doc_id = 0").collect()[0].text
    clean = {i: prose(rng, 120) for i in (None, 700, 701, 702)}
    toxic = f"{prose(rng, 40)} vilescum hatefool gruntslur {prose(rng, 40)} vilescum gruntslur"
    bad = {None: toxic, 700: toxic, 701: f"{prose(rng, 60)} {item} {prose(rng, 60)}", 702: copied}
    leaking = f"{prose(rng, 50)} {item} {prose(rng, 50)}"
    rows = [(i, t, "en", "a", 1) for texts in (clean, bad) for i, t in texts.items()] + [(None, leaking, "en", "a", 1)]
    d = save(documents=docs.unionByName(spark.createDataFrame(rows, DOCS)), labels=labels, benchmark=benchmark)
    own = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        own = corpus_pipeline.written(stage(spark, own, d))
    kept = {(r.doc_id, r.text) for r in own.collect()}
    assert clean.items() <= kept and kept.isdisjoint(bad.items()) and (None, leaking) not in kept
    assert (0, copied) in kept
