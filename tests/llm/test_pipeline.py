import random

import corpus_pipeline
from corpus import words
from trackweave.llm import common, queries


def test_stages_keep_clean_documents_and_act(spark, tmp_path):
    rng = random.Random(91)
    clean = [words(rng, 150) for _ in range(12)]
    item = words(rng, 40)
    secret = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
    near = clean[0].replace(" ", "  ", 1).upper()
    texts = [*clean, clean[1], near, "too short", f"{words(rng, 90)} {item}", f"{words(rng, 60)} {secret} {words(rng, 60)}"]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = common.store(stage(spark, docs, str(tmp_path)))
        left[name] = {r.doc_id for r in docs.collect()}
        assert name == "mixture" or docs.columns == columns
        if name == "secret_masks":
            masked = docs.where("doc_id = 16").first()
            assert "[secret]" in masked.text and "04dbebab" not in masked.text and masked.n_chars == len(masked.text)
    assert left["quality_rules"] == set(range(17)) - {14}
    assert left["near_dedup"] == set(range(12)) | {15, 16}
    assert left["decontamination"] == left["secret_masks"] == left["mixture"] == set(range(12)) | {16}
    texts_left = {r.text for r in docs.collect()}
    assert len(texts_left) == 13 and any("[secret]" in t for t in texts_left)
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, ran.collect())) == sorted(map(tuple, docs.collect()))


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_stages_take_an_empty_table(spark, none, tmp_path):
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.store(stage(spark, docs, str(tmp_path)))
        assert docs.count() == 0


def test_stages_take_odd_rows(spark, odd, tmp_path):
    spark.createDataFrame([(0, "a passage that no text of the table has, of some length")], "item_id bigint, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    docs, rows = common.store(odd), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.store(stage(spark, docs, str(tmp_path)))
        rows[name] = sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)
        assert name == "mixture" or docs.columns == odd.columns
    given = [(r.doc_id, r.text) for r in odd.collect()]
    long_enough = sorted((g for g in given if len((g[1] or "").split()) >= 50), key=repr)
    assert rows["quality_rules"] == long_enough
    # The repeated row and the null id's copy of the same text go.
    assert rows["near_dedup"] == sorted({g for g in long_enough if g[0] is not None}, key=repr)
    assert rows["decontamination"] == rows["secret_masks"] == rows["near_dedup"]
    assert set(rows["mixture"]) == set(rows["near_dedup"])
