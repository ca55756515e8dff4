import random
import re
from collections import Counter

from corpus import words
from trackweave.llm import quality_rules


def measures(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    covered = {i + k for i in range(len(ws) - 2) if windows[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(ws), sum(map(len, ws)), symbols, len(lines) - len(set(lines)), len(covered)


def test_measures_equal_brute_force(spark, odd):
    rng = random.Random(21)
    texts = [
        " ".join(rng.choice("abc") for _ in range(n)) for n in (0, 1, 2, 3, 4, 60, 300)
    ] + ["a\nb\na\n\n\n \n b\n", "\x0b\x0c\r  x é ü\u0085y", "# * $ % & | < >", "a a a", "a a a a", words(rng, 80)]
    docs = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    docs = docs.unionByName(odd.select("doc_id", "text", "source"))
    rows = quality_rules.measured(docs, "text").collect()
    assert len(rows) == len(texts) + 10
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measures(r.text)


def test_outlying_host_is_blocked_and_small_ones_follow_the_rest(spark):
    rng = random.Random(22)
    good = words(rng, 60)
    rows = [(f"good{h}", good) for h in range(12) for _ in range(30)]
    rows += [("bad", "short")] * 38 + [("bad", good)] * 2 + [("tiny", "short"), ("tiny", good)] + [(None, "short")] * 50
    docs = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(rows)], "doc_id bigint, text string, source string")
    judged = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    for i, (source, text) in enumerate(rows):
        assert judged[i].base_failed == (text == "short")
        assert judged[i].kept == (text == good and source != "bad")
    assert quality_rules.keep_good(docs).count() == 12 * 30 + 1


def test_hosts_that_fail_alike_are_not_blocked(spark):
    good = words(random.Random(23), 60)
    rows = [(i, good if i % 3 == 0 else "short", f"h{i % 5}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert quality_rules.judge(docs).where("kept").count() == 100


def test_odd_rows(odd, none):
    rows = quality_rules.judge(odd).collect()
    assert len(rows) == 10
    assert Counter(r.kept for r in rows) == {True: 6, False: 4}
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() == 6
    assert quality_rules.judge(none).count() == 0 and quality_rules.keep_good(none).count() == 0


def blocked(spark, hosts):
    """Names of the blocked among ``hosts``: name -> (failures, documents)."""
    rows = [(h, i < bad) for h, (bad, n) in hosts.items() for i in range(n)]
    docs = spark.createDataFrame(rows, "source string, failed boolean")
    return {r.source for r in quality_rules.blocked_hosts(docs, quality_rules.HostRules()).collect()}


def test_many_bad_hosts_do_not_shield_each_other(spark):
    for bad in (1, 3, 5, 6, 12):
        hosts = {f"h{i}": (20, 20) if i < bad else (0, 20) for i in range(20)}
        assert blocked(spark, hosts) == {f"h{i}" for i in range(bad)}
    hosts = {f"h{i}": (17, 20) if i < 5 else (1, 20) for i in range(20)}
    assert blocked(spark, hosts) == {f"h{i}" for i in range(5)}


def test_a_tail_of_single_documents_shields_no_host_and_is_not_blocked(spark):
    hosts = {f"one{i}": (int(i % 4 == 0), 1) for i in range(400)} | {f"good{i}": (1, 20) for i in range(10)} | {"bad": (39, 40)}
    assert blocked(spark, hosts) == {"bad"}
