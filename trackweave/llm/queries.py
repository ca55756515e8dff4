"""One registered query per corpus operator, over the whole of its table."""

from __future__ import annotations

import public_tokenizers

from trackweave.catalog.inputs import Query
from trackweave.llm import (
    bag_ranking,
    classifier,
    decontaminate,
    licenses,
    mixing,
    packing,
    pii,
    quality_rules,
    repeats,
    secrets,
    simhash,
    url_filter,
    whitening,
)
from trackweave.llm.common import table


def op1_byte_cnn(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return classifier.score(docs, classifier.fit(docs, table(spark, sf_dir, "labels")))


def op2_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_temperature_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_url_trees(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op5_qgram_decontamination(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_feistel_pii(spark, sf_dir):
    # The key of a real run is a secret of its own; this one is for checks.
    return pii.pseudonymised(table(spark, sf_dir, "documents"), key="check key")


def op8_secret_scan(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_host_quality(spark, sf_dir):
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules.judge(table(spark, sf_dir, "documents")).select("doc_id", *measures)


def op10_suffix_dedup(spark, sf_dir):
    return repeats.digest(repeats.without_repeats(table(spark, sf_dir, "documents")))


def op11_bag_ranking(spark, sf_dir):
    return bag_ranking.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_spectrum_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_swap_packing(spark, sf_dir):
    how = packing.Packing(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.sequences(table(spark, sf_dir, "documents"), how)


QUERIES = {
    "op1_byte_cnn": Query(op1_byte_cnn),
    "op2_simhash_near_dedup": Query(op2_simhash_near_dedup),
    "op3_temperature_mixing": Query(op3_temperature_mixing),
    "op4_url_trees": Query(op4_url_trees),
    "op5_qgram_decontamination": Query(op5_qgram_decontamination),
    "op6_license_scan": Query(op6_license_scan),
    "op7_feistel_pii": Query(op7_feistel_pii),
    "op8_secret_scan": Query(op8_secret_scan),
    "op9_host_quality": Query(op9_host_quality),
    "op10_suffix_dedup": Query(op10_suffix_dedup),
    "op11_bag_ranking": Query(op11_bag_ranking),
    "op12_spectrum_whitening": Query(op12_spectrum_whitening),
    "op13_swap_packing": Query(op13_swap_packing),
}
