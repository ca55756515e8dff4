"""URL filter: fixed host and path rules first, gradient-boosted trees on lexical features for the rest.

Rules label a part of the URLs; the trees learn from those what blocked URLs look like (length, depth,
digits, entropy, parameters, and how often a host's suffixes are blocked) and judge the others. Features are
column expressions, statistics are aggregates, and the trees are Spark ML's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import documents, store
from trackweave.session import settle_small

# Rules and what they decide.
RULES = {
    "org/": "allow",
    "example.org/es/": "block",
    "example.org/en/1": "block",
    "com/fr/": "allow",
    "com/de/": "block",
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"
FEATURES = (
    "length host_length path_length depth labels host_digits url_digits host_entropy path_entropy hyphens parameters "
    "query_length has_fragment secure suffix_rate domain_rate"
).split()


@dataclass(frozen=True)
class Trees:
    """Boosting, and the bound on its sample: labelled URLs used at most, those with the least hash first."""

    rounds: int = 12
    depth: int = 4
    rate: float = 0.2
    sample: int = 50_000
    folds: int = 5  # rates that a labelled URL is trained with come from the other folds
    prior: float = 20.0  # labelled URLs that a suffix needs for its own rate to weigh half
    block: float = 0.5
    seed: int = 42


def parted(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, path); a null url or one without :// has empty parts."""
    url = F.coalesce("url", F.lit(""))
    return documents(pages, "page_id", "url").select(
        "page_id",
        "url",
        F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER).alias("host"),
        F.regexp_extract(url, PARTS, 2).alias("path"),
    )


def rule_of(rules: dict[str, str]) -> Column:
    """The longest rule whose host is the url's or above it, and whose path begins the url's; else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        host, _, path = rule.partition("/")
        at_host = (F.col("host") == host) | F.col("host").endswith(f".{host}")
        out = F.when(at_host & F.col("path").startswith("/" + path), F.lit(rule)).otherwise(out)
    return out


def _entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text)

    def part(total: Column, char: Column) -> Column:
        share = (n - F.length(F.replace(text, char, F.lit("")))) / n
        return total - F.when(share > 0, share * F.log2(share)).otherwise(0.0)

    letters = F.array_distinct(F.split(text, ""))
    return F.when(n > 0, F.aggregate(F.array_remove(letters, ""), F.lit(0.0), part)).otherwise(0.0)


def _share(text: Column, pattern: str) -> Column:
    return F.when(F.length(text) > 0, F.regexp_count(text, F.lit(pattern)) / F.length(text)).otherwise(0.0)


def lexical(rows: DataFrame) -> DataFrame:
    """Features of ``parted`` rows that need nothing but the URL, and the suffixes that statistics are kept of."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, "(?s)\\?([^#]*)", 1)
    columns = {
        "length": F.length(url),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": F.regexp_count(path, F.lit("/")),
        "labels": F.regexp_count(host, F.lit("\\.")),
        "host_digits": _share(host, "[0-9]"),
        "url_digits": _share(url, "[0-9]"),
        "host_entropy": _entropy(host),
        "path_entropy": _entropy(path),
        "hyphens": F.regexp_count(host, F.lit("-")),
        "parameters": F.when(F.length(query) > 0, F.regexp_count(query, F.lit("&")) + 1).otherwise(0),
        "query_length": F.length(query),
        "has_fragment": url.contains("#").cast("int"),
        "secure": url.startswith("https").cast("int"),
    }
    return rows.select(
        "*",
        *[c.cast("double").alias(name) for name, c in columns.items()],
        F.substring_index(host, ".", -1).alias("suffix"),
        F.substring_index(host, ".", -2).alias("domain"),
    )


def rates(labelled: DataFrame, key: str, prior: float, folds: int) -> DataFrame:
    """(key, fold, rate): share of blocked URLs below each suffix, shrunk towards all labelled URLs' share.

    A row of fold f has the rate over the other folds, so that no labelled URL's own label is in its features;
    the row of fold -1 has the rate over all of them, for URLs to be judged.
    """
    overall = labelled.agg(F.avg("label")).first()[0]
    parts = labelled.groupBy(key, "fold").agg(F.sum("label").alias("blocked"), F.count("*").alias("n"))
    whole = parts.groupBy(key).agg(F.sum("blocked").alias("all_blocked"), F.sum("n").alias("all_n"))
    every = F.sequence(F.lit(-1), F.lit(folds - 1))
    spread = whole.withColumn("fold", F.explode(every)).join(parts, [key, "fold"], "left")
    blocked = F.col("all_blocked") - F.coalesce("blocked", F.lit(0.0))
    n = F.col("all_n") - F.coalesce("n", F.lit(0))
    rate = (blocked + prior * overall) / (n + prior)
    return settle_small(spread.select(F.col(key).alias(f"_{key}"), F.col("fold").alias("_fold"), rate.alias(f"{key}_rate")))


def with_rates(rows: DataFrame, tables: dict[str, DataFrame], overall: float, fold: Column) -> DataFrame:
    for key, table in tables.items():
        rows = rows.join(table, (rows[key] == table[f"_{key}"]) & (fold == table["_fold"]), "left")
        rows = rows.drop(f"_{key}", "_fold").withColumn(f"{key}_rate", F.coalesce(f"{key}_rate", F.lit(overall)))
    return rows


def fit(labelled: DataFrame, trees: Trees) -> GBTClassificationModel:
    """Trees from at most ``trees.sample`` of the labelled rows (``label`` 1: blocked)."""
    count = labelled.count()
    # Rows of equal URLs share their hash, so the bound holds up to repeated URLs; those are taken once.
    share = min(1.0, trees.sample / max(count, 1))
    below = F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = labelled.where(below).dropDuplicates(["url"]).limit(2 * trees.sample)
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    booster = GBTClassifier(maxIter=trees.rounds, maxDepth=trees.depth, stepSize=trees.rate, seed=trees.seed)
    return booster.fit(store(assembler.transform(sample).select("features", "label")))


def judge(pages: DataFrame, rules: dict[str, str] = RULES, trees: Trees = Trees()) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) per row of ``pages`` (page_id, url).

    ``verdict`` is the rule's where one fits, else the trees': block from a score of ``trees.block`` on. A null
    url has empty parts and is judged by the trees like any other; without labelled URLs of both kinds
    everything else is allowed (score 0). Repeated rows are judged alike; an empty table gives none.
    """
    rows = store(lexical(parted(pages)).withColumn("rule", rule_of(rules)))
    named = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair]) if rules else None
    decided = F.element_at(named, F.col("rule")) if rules else F.lit(None).cast("string")
    labelled = rows.where("rule IS NOT NULL").withColumn("label", (decided == "block").cast("double"))
    least, most, overall = labelled.agg(F.min("label"), F.max("label"), F.avg("label")).first()
    if least is None or least == most:
        scored = rows.withColumn("score", F.lit(0.0))
    else:
        labelled = labelled.withColumn("fold", F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(trees.folds)).cast("int"))
        tables = {key: rates(labelled, key, trees.prior, trees.folds) for key in ("suffix", "domain")}
        model = fit(with_rates(labelled, tables, overall, F.col("fold")), trees)
        assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        told = model.transform(assembler.transform(with_rates(rows, tables, overall, F.lit(-1))))
        scored = told.withColumn("score", vector_to_array("probability")[1])
    own = F.when(F.col("score") >= trees.block, "block").otherwise("allow")
    verdict = F.coalesce(decided, own)
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
