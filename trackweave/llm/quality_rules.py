"""Quality rules for documents, and verdicts on whole hosts drawn from them.

A host's share of failing documents is shrunk towards the corpus with a beta prior, so that a host with few
documents is judged mostly by the others. The prior's moments weigh hosts by their documents (mean squares
between and within hosts), so that a tail of small hosts doesn't pass for differences between hosts. Everything is
a column expression, an aggregate or a join; sorting for repeated windows happens inside a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import documents, store
from trackweave.session import settle_small

GAP = "[\\x20\\x09-\\x0D]+"


@dataclass(frozen=True)
class HostRules:
    """Limits of the rules that count against a host, and of its verdict."""

    min_words: int = 50
    max_repeated: int = 50  # percent of the words that stand in repeated windows
    max_symbols: int = 10  # percent of the words
    max_dup_lines: int = 30  # percent of the lines with a word
    worst_rate: float = 0.5  # shrunk share of failing documents beyond which a host is blocked
    outlying: float = 2.0  # standard deviations of the prior by which it must also exceed the mean, at most half way to 1
    hopeless: float = 0.9  # shrunk share beyond which it is blocked however the others do
    least_prior: float = 2.0  # documents the prior weighs at least, so that one document never blocks its host


def _repeated_words(ordered: Column) -> Column:
    """Words covered by windows whose hash occurs twice; ``ordered``: (hash, start) structs in order, null if no hash does."""
    n = F.size(ordered)
    # A window next to an equal one in order is repeated.
    beside = F.arrays_zip(
        F.slice(ordered, 1, n - 1).alias("a"),
        F.slice(ordered, 2, n - 1).alias("b"),
    )
    equal = F.filter(beside, lambda x: x["a"]["h"] == x["b"]["h"])
    starts = F.concat(equal["a"]["i"], equal["b"]["i"])
    spread = F.concat(starts, F.transform(starts, lambda i: i + 1), F.transform(starts, lambda i: i + 2))
    return F.when(ordered.isNotNull(), F.size(F.array_distinct(spread))).otherwise(0).cast("bigint")


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """The rule measures of every row, beside the columns named in ``keep``.

    A null text has no words. Windows are compared by 64-bit hashes within one text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents(docs, *dict.fromkeys([*keep, "text"])).withColumns(
        {
            "_words": F.array_remove(F.split(text, GAP, -1), ""),
            "_lines": F.filter(F.split(text, "\n", -1), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")),
            "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("bigint"),
        }
    )
    rows = rows.withColumns(
        {
            "n_words": F.size("_words").cast("bigint"),
            "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
            "n_lines": F.size("_lines").cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "_n": F.greatest(F.size("_words") - 2, F.lit(0)),
        }
    )
    # Each word is hashed once, and a window's hash is made of those of its words.
    rows = rows.withColumn("_codes", F.transform("_words", lambda w: F.xxhash64(w)))
    windows = F.arrays_zip(*[F.slice("_codes", at, F.col("_n")) for at in (1, 2, 3)])
    rows = rows.withColumn("_hashes", F.transform(windows, lambda w: F.xxhash64(w)))
    # Only texts with a repeated window are put in order.
    again = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    pairs = F.arrays_zip(F.col("_hashes").alias("h"), F.sequence(F.lit(1), F.col("_n")).alias("i"))
    rows = rows.withColumn("_ordered", F.when((F.col("_n") > 1) & again, F.sort_array(pairs)))
    return rows.withColumn("n_repeat_words", _repeated_words(F.col("_ordered"))).select(
        *keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"
    )


def with_failures(rows: DataFrame, rules: HostRules) -> DataFrame:
    """``base_failed``: the document's own verdict; ``failed``: any rule, which counts against its host."""
    base = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeated * F.col("n_words")
    )
    more = (100 * F.col("n_symbols") > rules.max_symbols * F.col("n_words")) | (
        100 * F.col("n_dup_lines") > rules.max_dup_lines * F.col("n_lines")
    )
    return rows.withColumn("base_failed", base).withColumn("failed", base | more)


def blocked_hosts(rows: DataFrame, rules: HostRules) -> DataFrame:
    """(source, docs, failures, rate) of the hosts whose shrunk rate of failures is too high.

    ``rows``: (source, failed). Documents without a host judge no host.
    """
    hosts = rows.where("source IS NOT NULL").groupBy("source")
    hosts = hosts.agg(F.count("*").alias("docs"), F.sum(F.col("failed").cast("bigint")).alias("failures"))
    hosts = store(hosts)
    n, x = F.col("docs"), F.col("failures")
    # One row: what the mean squares between and within hosts are made of.
    k, all_docs, all_failures, squares, between = hosts.agg(
        F.count("*"), F.sum(n), F.sum(x), F.sum(n.cast("double") * n), F.sum(x.cast("double") * x / n)
    ).first()
    if not all_failures:
        return hosts.where("false").select("source", "docs", "failures", F.lit(0.0).alias("rate"))
    mean = all_failures / all_docs
    alike = 0.0  # correlation of two documents of a host; hosts of one document each tell nothing of it
    if all_docs > k > 1:
        within = (all_failures - between) / (all_docs - k)
        among = (between - all_docs * mean**2) / (k - 1)
        usual = (all_docs - squares / all_docs) / (k - 1)
        total = among + (usual - 1) * within
        alike = min(max((among - within) / total, 0.0), 1.0) if total > 0 else 0.0
    alike = max(alike, 1e-9)
    strength = max(1 / alike - 1, rules.least_prior)
    rate = (x + mean * strength) / (n + strength)
    outlying = mean + rules.outlying * (mean * (1 - mean) * alike) ** 0.5
    # Bad hosts raise mean and deviation themselves, and no rate exceeds 1.
    limit = max(rules.worst_rate, min(outlying, (1 + mean) / 2, rules.hopeless))
    return hosts.withColumn("rate", rate).where(F.col("rate") > limit).select("source", "docs", "failures", "rate")


def judge(docs: DataFrame, rules: HostRules = HostRules()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): its measures, ``base_failed`` and ``kept``.

    A document is kept if it passes the base rule and its host is not blocked. A null text fails
    (no words); a null source is never blocked; repeated rows are judged one by one.
    """
    rows = store(with_failures(measured(docs, "doc_id", "source"), rules))
    bad = settle_small(blocked_hosts(rows, rules).select("source", F.lit(True).alias("blocked")))
    joined = rows.join(bad, "source", "left")
    kept = ~F.col("base_failed") & F.col("blocked").isNull()
    return joined.withColumn("kept", kept).drop("blocked", "failed")


def keep_good(docs: DataFrame, rules: HostRules = HostRules()) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, all columns as they were (also such named like the measures).

    Null and empty texts fail, a null source is never blocked, repeated rows share their fate; an empty table gives none.

    Only verdicts are joined to the texts: on two hashes of the text (96 bits), which alone decides the
    base rule, and on the host.
    """

    def hashes(text: Column) -> list[Column]:
        whole = F.coalesce(text, F.lit(""))
        return [F.xxhash64(whole), F.hash(whole)]

    one, two = hashes(F.col("text"))
    own = docs.select("text", "source", one.alias("_one"), two.alias("_two"))
    rows = store(with_failures(measured(own, "_one", "_two", "source"), rules))
    bad = settle_small(blocked_hosts(rows, rules).select(F.col("source").alias("_host")))
    gone = settle_small(rows.where("base_failed").select("_one", "_two").distinct())
    one, two = hashes(docs["text"])
    kept = docs.join(gone, (one == gone["_one"]) & (two == gone["_two"]), "left_anti")
    return kept.join(bad, docs["source"] == bad["_host"], "left_anti")
