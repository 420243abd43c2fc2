"""The pipeline against brute force, stage by stage."""

import random

import corpus_pipeline
from tests.llm.test_simhash import plain_components, plain_fingerprint


def corpus():
    rng = random.Random(8)
    words = "stone river lamp cloud seven under table grass winter yellow paper engine of the and".split()
    prose = lambda n: "\n".join(" ".join(rng.choice(words) + rng.choice(words) for _ in range(rng.randrange(6, 14))).capitalize() + "." for _ in range(n))
    items = [prose(2).replace("\n", " ") for _ in range(3)]
    texts = [prose(rng.randrange(2, 12)) for _ in range(40)]
    texts[3] += "\n" + items[1]
    texts[5] += "\n" + 'token = "4534254f83b7e27b3670756d7cab6da61ccfcea9" here.'
    texts += [texts[0], texts[1] + " ", texts[2].upper(), None, "", "too short.", "a | b | c | d\n" * 9, " ".join(["same old words again"] * 20)]
    return texts, items


def test_stages_match_brute_force(spark, tmp_path):
    texts, items = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 5}", len(t or "")) for i, t in enumerate(texts)] + [(4, texts[4], "en", "src4", len(texts[4]))], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, now, str(tmp_path)).write.parquet(path)
        now = spark.read.parquet(path)
        if name != "best_fit_packing":
            assert now.columns == docs.columns
            kept[name] = [(r.doc_id, r.text) for r in now.collect()]
    bad = {len(texts) - k for k in range(1, 6)}
    assert sorted(i for i, _ in kept["quality_rules"]) == sorted([i for i in range(len(texts)) if i not in bad] + [4])
    assert all(t == texts[i] for i, t in kept["quality_rules"])
    prints = {i: plain_fingerprint(t) for i, t in kept["quality_rules"]}
    root = plain_components(prints)
    assert sorted(i for i, _ in kept["near_duplicates"]) == sorted({root[i] for i in prints})
    leaked = {i for i, t in kept["near_duplicates"] if any(x in t.replace("\n", " ") for x in items)}
    assert 3 in leaked and sorted(i for i, _ in kept["decontamination"]) == sorted(i for i, _ in kept["near_duplicates"] if i not in leaked)
    clean = dict(kept["secret_scan"])
    for i, t in kept["decontamination"]:
        want = t.replace('token = "4534254f83b7e27b3670756d7cab6da61ccfcea9', "[ASSIGN]")
        assert clean[i] == want
    assert {r.doc_id for r in now.collect()} == set(clean)
    sizes = {}
    for r in now.collect():
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
    assert max(sizes.values()) <= 2048
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, now.select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_stages_keep_columns_of_any_name_and_empty_tables(spark, tmp_path):
    texts, items = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long, _before string, key long, row long, quality long"
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 5}", len(t or ""), "b", 1, 2, 3) for i, t in enumerate(texts)], schema)
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        if name != "best_fit_packing":
            found = stage(spark, docs, str(tmp_path))
            assert found.columns == docs.columns and {(r._before, r.key, r.row, r.quality) for r in found.collect()} == {("b", 1, 2, 3)}


def test_failed_lines_leave_the_corpus(spark, tmp_path):
    text = "The river was wide and the boat was small, so they waited for the morning.\nHome | About | News\n\nThen they went on."
    docs = spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long")
    want = text.replace("Home | About | News\n", "")
    assert [(r.text, r.n_chars) for r in corpus_pipeline.quality_rules(spark, docs, "").collect()] == [(want, len(want))]


def test_columns_of_any_name(spark, tmp_path):
    texts, items = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), i, "x", None) for i, t in enumerate(texts[:6])], "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, row string, q string")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, str(tmp_path))
        assert name == "best_fit_packing" or found.columns == docs.columns
        assert found.count() > 0
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        cased = docs.withColumnRenamed("row", "Text").withColumnRenamed("a.b", "DOC_ID")
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, cased, str(tmp_path)).count() > 0, name
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
