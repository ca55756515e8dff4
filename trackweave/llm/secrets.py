"""Secrets in texts: fixed patterns, and values in credential contexts that would be hard to guess.

The guess cost of a value is the least over all ways to cut it into words, dates, repeats, keyboard
walks and brute-force characters (dynamic programming over positions); hard values are secrets
although no fixed pattern knows them.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.llm.common import blocks, documents, store

# The base patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "guess")

# Names that announce a credential, with a value that may hold any printable character.
CONTEXT = re.compile(
    r"""(?:passphrase|password|passwd|pass|pwd|secret|token|credentials?|bearer|authorization|
    (?:api|access|private|client|signing|encryption)[_-]?(?:key|secret|token))
    ["']?\x20*(?:[:=]|=>|\x20is\x20)\x20*["']?([!#-&(-+\--~]{8,})""",
    re.I | re.A | re.X,
)
HINTS = ("pass", "pwd", "secret", "token", "credential", "bearer", "authorization", "key")

# Common parts of chosen passwords, most common first: the rank is the cost.
WORDS = (
    "password welcome admin login letmein master hello test user default secret changeme example sample "
    "dragon monkey shadow sunshine princess football baseball summer winter spring autumn january february march "
    "april june july august september october november december monday friday love iloveyou baby angel "
    "super star magic flower cookie banana orange apple cheese pepper ginger hunter ranger soccer hockey "
    "batman superman michael jordan jennifer ashley jessica daniel thomas robert andrew charlie "
    "trust freedom access system server root guest temp demo pass key token dev prod stage local host "
    "your here insert replace placeholder none null undefined todo redacted value string"
).split()
# Values that stand for a secret kept elsewhere: ${NAME}, $NAME, $(call), {{ name }}, <name>, %NAME%, env.NAME, os.environ...
TEMPLATE = re.compile(
    r"\$\{[^}]*\}?|\$\([^)]*\)?|\$[A-Z_][A-Z0-9_]*|\{\{.*|<[\w.-]+>?|%[A-Z_]+%|(?:process\.)?env[.\[(].*|os\.(?:environ|getenv).*", re.A
)
LEET = str.maketrans("013457@$!", "oieastasi")
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d")


@dataclass(frozen=True)
class Words:
    """A dictionary: the rank of each word, most frequent first, is its cost."""

    rank: dict[str, int]

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.rank), default=0)

    @classmethod
    def of(cls, more: list[str] = []) -> Words:
        """The common parts of passwords, then ``more`` in their order."""
        return cls({word: rank for rank, word in enumerate(dict.fromkeys([*WORDS, *more]), 1)})


COMMON = Words.of()


@dataclass(frozen=True)
class Vocabulary:
    """Which words of a corpus its dictionary has: the ``most`` most frequent ones of ``least`` to ``longest`` letters.

    A word counts once for a text, and must be in ``texts`` of them: a random value is in one, or in its copies. Words that are
    equally frequent are all in it, or none if they would be too many. The bound on the dictionary (about three
    megabytes) does not depend on the corpus; the counts are over all of it.
    """

    most: int = 50_000
    least: int = 4
    longest: int = 24
    texts: int = 3


def learned(docs: DataFrame, how: Vocabulary = Vocabulary()) -> Words:
    """The dictionary of ``docs`` (text): words of a-z, counted by Spark with partial sums before the shuffle; ties by the word."""
    parts = F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z\\x{80}-\\x{10FFFF}]+")
    words = documents(docs, "text").select(F.explode(F.array_distinct(parts)).alias("word"))
    words = words.where(F.length("word").between(how.least, how.longest) & F.col("word").rlike("^[a-z]+$"))
    counts = store(words.groupBy("word").agg(F.count("*").alias("texts")).where(F.col("texts") >= how.texts))
    # The least number of texts at which the words are not too many; one row for each number of texts is looked at.
    sizes = counts.groupBy("texts").agg(F.count("*").alias("words"))
    upto = F.sum("words").over(Window.orderBy(F.desc("texts")))
    cut = sizes.withColumn("upto", upto).where(F.col("upto") <= how.most).agg(F.min("texts")).first()[0]
    found = counts.where(F.col("texts") >= cut).collect() if cut is not None else []
    return Words.of([r.word for r in sorted(found, key=lambda r: (-r.texts, r.word))])


@cache
def _steps() -> frozenset[str]:
    """Neighbouring characters of a keyboard row or of the alphabet, in either direction."""
    pairs = [row[i : i + 2] for row in ROWS for i in range(len(row) - 1)]
    return frozenset(pairs + [p[::-1] for p in pairs])


def _brute(char: str) -> float:
    if char.isdigit():
        return 1.0
    return math.log10(26 if char.isalpha() and char.isascii() else 33) + (0.1 if char.isupper() else 0)


def guess_cost(value: str, enough: float = math.inf, words: Words = COMMON) -> float:
    """log10 of the guesses for ``value``, by its cheapest segmentation; stops at ``enough``.

    Segments go forwards from each position, so the cheapest end still open bounds all that follows.
    """
    n, rank_of, longest = len(value), words.rank, words.longest
    low = value.lower()
    plain = low.translate(LEET)
    best = [0.0] + [math.inf] * n
    open_ends = {0}
    walk_end = list(range(1, n + 1))
    for i in range(n - 2, -1, -1):
        if low[i : i + 2] in _steps():
            walk_end[i] = walk_end[i + 1]
    # Per unit, the first place from here on where the value differs from itself a unit later.
    differs = [-1] * 9
    for i in range(n):
        open_ends.discard(i)
        cost = best[i]
        if min([cost, *(best[e] for e in open_ends)]) >= enough:
            return enough

        def reach(end: int, extra: float) -> None:
            if cost + extra < best[end]:
                best[end] = cost + extra
                open_ends.add(end)

        if cost == math.inf:
            continue
        reach(i + 1, _brute(value[i]))
        for size in range(3, min(longest, n - i) + 1):
            rank = rank_of.get(low[i : i + size]) or rank_of.get(plain[i : i + size], 0) * 4
            if rank:
                cased = 0.0 if value[i : i + size] == low[i : i + size] else 0.3
                reach(i + size, 0.3 + math.log10(rank + 10) + cased)
        if found := DATE.match(value, i):
            reach(found.end(), 0.3 + (2.0 if found.end() - i == 4 else 4.5))
        if walk_end[i] - i >= 3:
            reach(walk_end[i], 0.3 + math.log10(36 * (walk_end[i] - i)))
        for unit in range(1, min(9, n - i)):
            if differs[unit] < i:
                differs[unit] = next((j for j in range(i, n - unit) if value[j] != value[j + unit]), n - unit)
            end = i + unit * (1 + (differs[unit] - i) // unit)
            if end - i >= max(3, 2 * unit):
                reach(end, 0.3 + sum(map(_brute, value[i : i + unit])) + math.log10((end - i) / unit))
    return min(best[n], enough)


def base_spans(text: str) -> list[tuple[int, str, int, tuple[int, int]]]:
    """(start, kind, end, value span) of the fixed patterns."""
    found = []
    low = text.lower() if text.isascii() else text.translate(_ASCII_LOWER)
    if any(h in low for h in ("passw", "secret", "token", "api")):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 8:
                found.append((m.start(), "assign", m.end(), m.span(2)))
    if "AKIA" in text:
        found.extend((m.start(), "access", m.end(), m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16)
    found.extend((m.start(), "hex", m.end(), m.span()) for m in HEX.finditer(text))
    return found


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def all_spans(text: str, enough: float = 10.0, words: Words = COMMON) -> list[tuple[int, str, int, tuple[int, int]]]:
    """Base spans and those of values whose guess cost reaches ``enough``, by start, then kind; templates are no values."""
    found = base_spans(text)
    low = text.lower()
    if any(h in low for h in HINTS):
        covered = sorted(span for *_, span in found)
        furthest = list(accumulate((b for _, b in covered), max))
        for m in CONTEXT.finditer(text):
            span = m.span(1)
            before = bisect_right(covered, (span[0], math.inf))
            inside = before and span[1] <= furthest[before - 1]
            if not inside and not TEMPLATE.fullmatch(m[1].rstrip("\"',;.")) and guess_cost(m[1], enough, words) >= enough:
                found.append((span[0], "guess", span[1], span))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def _joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end, _ in spans)


def _scanned(enough: float, words: Words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            counts, shas, texts = [[], [], []], [], []
            for text in block.column("text").to_pylist():
                spans = all_spans(text or "", enough, words)
                base = [s for s in spans if s[1] != "guess"]
                for kind, column in zip(KINDS, counts):
                    column.append(sum(s[1] == kind for s in base))
                shas.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                texts.append(_joined(spans))
            columns = [block.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(shas), pa.array(texts)]
            yield pa.record_batch(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def scan(docs: DataFrame, enough: float = 10.0, words: Words | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): counts and spans (code points, end exclusive) of its secrets.

    ``enough``: log10 of the guesses from which a credential's value counts as a secret; ``words``: the dictionary, by
    default that of ``docs`` itself. A null or
    empty text has none; repeated rows and null ids are scanned like others.
    """
    kinds = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return documents(docs, "doc_id", "text").mapInArrow(_scanned(enough, words or learned(docs)), kinds)


def mask(text: str | None, enough: float = 10.0, words: Words = COMMON, by: str = "[secret]") -> str | None:
    """``text`` with the value of each secret replaced; overlapping values are replaced once."""
    if not text or not (spans := all_spans(text, enough, words)):
        return text
    parts, at = [], 0
    for a, b in sorted(span for *_, span in spans):
        if a >= at:
            parts += [text[at:a], by]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def masked(docs: DataFrame, enough: float = 10.0, words: Words | None = None) -> DataFrame:
    """``docs`` with secret values masked in ``text``, and ``n_chars`` (if there) brought in line; no row goes.

    Null and empty texts stay as they are, as do repeated rows and all other columns; an empty table gives none.
    ``words`` as in ``scan``.
    """
    known = words or learned(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            before = block.column("text").to_pylist()
            after = [mask(t, enough, known) for t in before]
            names = block.schema.names
            block = block.set_column(names.index("text"), "text", pa.array(after, pa.string()))
            if "n_chars" in names:
                old = block.column("n_chars").to_pylist()
                new = [len(b) if a != b else n for a, b, n in zip(before, after, old)]
                kind = block.schema.field("n_chars").type
                block = block.set_column(names.index("n_chars"), "n_chars", pa.array(new, kind))
            yield block

    return docs.mapInArrow(run, docs.schema)
