"""Quality probability of a text by a small convolutional network over its bytes, in numpy.

Bytes are embedded, filters slide over them, and every chunk of the text keeps each filter's largest
response (chunks overlap by the filters' width, and cover the text to its last byte). The largest and
the mean response over all chunks are combined into one probability. The network is trained here, by
gradient descent on a bounded sample of labelled rows, each seen whole; scoring is one pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.llm.common import blocks, documents, store, utf8


@dataclass(frozen=True)
class Network:
    """Shape and training of the network.

    The bounds on the training sample: ``sample`` labelled rows at most (those with the least hash of the id),
    none of more than ``longest`` bytes, ``budget`` bytes together. Every text of the sample is learned from whole.
    ``short``: share of the training texts that a step sees as one short piece only, so that short texts are
    judged fairly.
    """

    width: int = 8
    stride: int = 2
    chunk: int = 256
    embedding: int = 6
    filters: int = 24
    sample: int = 6000
    longest: int = 1 << 21
    budget: int = 1 << 25
    short: float = 0.3
    epochs: int = 14
    batch: int = 64
    rate: float = 0.004
    decay: float = 1e-4
    seed: int = 42


def chunk_starts(n: int, net: Network) -> np.ndarray:
    return np.arange(0, max(n - net.width + 1, 1), net.chunk)


def start_weights(net: Network) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(net.seed)
    size = net.width * net.embedding
    return {
        "bytes": rng.normal(0, 0.5, (256, net.embedding)).astype(np.float32),
        "filters": rng.normal(0, size**-0.5, (size, net.filters)).astype(np.float32),
        "bias": np.zeros(net.filters, np.float32),
        "out": np.zeros(2 * net.filters, np.float32),
        "offset": np.zeros(1, np.float32),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _responses(chunks: np.ndarray, w: dict[str, np.ndarray], net: Network) -> tuple[np.ndarray, np.ndarray]:
    """(windows, responses) of chunks of bytes, shape (n, positions, ...)."""
    x = w["bytes"][chunks]
    positions = (chunks.shape[1] - net.width) // net.stride + 1
    span = net.stride * (positions - 1) + 1
    windows = np.concatenate([x[:, j : j + span : net.stride] for j in range(net.width)], axis=2)
    return windows, windows @ w["filters"]


def _padded(text: bytes, net: Network) -> np.ndarray:
    """Bytes of a text, filled up with zeros so that its last chunk is whole."""
    last = int(chunk_starts(len(text), net)[-1])
    return np.frombuffer(text.ljust(last + net.chunk + net.width, b"\0"), np.uint8)


def _piece(text: np.ndarray, rng: np.random.Generator, net: Network) -> np.ndarray:
    """One chunk of a padded text, cut off somewhere after its first eight bytes."""
    length = net.chunk + net.width
    at = net.chunk * rng.integers((len(text) - length) // net.chunk + 1)
    one = text[at : at + length].copy()
    one[rng.integers(8, length) :] = 0
    return one


def _peaks(
    data: np.ndarray, starts: np.ndarray, w: dict[str, np.ndarray], net: Network, at_once: int = 512
) -> tuple[np.ndarray, np.ndarray]:
    """Each chunk's largest response per filter, and the bytes under the filter there."""
    tops, under = [], []
    for at in range(0, len(starts), at_once):
        some = starts[at : at + at_once, None]
        _, z = _responses(data[some + np.arange(net.chunk + net.width)], w, net)
        best = z.argmax(axis=1)  # (chunks, filters)
        tops.append(np.take_along_axis(z, best[:, None], axis=1)[:, 0] + w["bias"])
        under.append(data[(some + best * net.stride)[:, :, None] + np.arange(net.width)])
    return np.concatenate(tops), np.concatenate(under)


def gradients(
    texts: list[np.ndarray], labels: np.ndarray, w: dict[str, np.ndarray], net: Network, at_once: int = 512
) -> dict[str, np.ndarray]:
    """Slopes of the mean log loss over padded texts, all chunks of each.

    Only the bytes under the largest responses are kept from the way forward, so what is held at a time
    grows with the texts by some 300 bytes a chunk.
    """
    length = net.chunk + net.width
    counts = np.array([(len(t) - length) // net.chunk + 1 for t in texts])
    firsts = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(texts)), counts)
    offsets = np.cumsum([0, *(len(t) for t in texts[:-1])])
    starts = offsets[owner] + net.chunk * (np.arange(len(owner)) - firsts[owner])
    top, under = _peaks(np.concatenate(texts), starts, w, net, at_once)
    active = top > 0
    pooled = np.where(active, top, 0)
    most = np.maximum.reduceat(pooled, firsts)
    features = np.concatenate([most, np.add.reduceat(pooled, firsts) / counts[:, None]], axis=1)
    slope = (_sigmoid(features @ w["out"] + w["offset"]) - labels) / len(texts)
    back = slope[:, None] * w["out"]
    is_most = pooled == most[owner]
    share_of = np.add.reduceat(is_most.astype(np.int64), firsts)
    g = back[owner, : net.filters] * is_most / share_of[owner] + back[owner, net.filters :] / counts[owner, None]
    g = (g * active).astype(np.float32)
    grads = {"out": features.T @ slope, "offset": slope.sum(keepdims=True), "bias": g.sum(axis=0)}
    grads["filters"], grads["bytes"] = np.zeros_like(w["filters"]), np.zeros_like(w["bytes"])
    for at in range(0, len(g), at_once):
        some, read = g[at : at + at_once], under[at : at + at_once]
        chosen = w["bytes"][read].reshape(*some.shape, -1)  # (chunks, filters, width * embedding)
        grads["filters"] += np.einsum("cfk,cf->kf", chosen, some)
        spread = (some[:, :, None] * w["filters"].T).reshape(-1, net.embedding)
        for d in range(net.embedding):
            grads["bytes"][:, d] += np.bincount(read.ravel(), spread[:, d], 256)
    return grads


def train(texts: list[bytes], labels: np.ndarray, net: Network) -> dict[str, np.ndarray]:
    """Weights fitted to whole texts; by Adam on the log loss."""
    w = start_weights(net)
    share = float(np.clip(labels.mean(), 0.01, 0.99))
    w["offset"][:] = np.log(share / (1 - share))
    rng = np.random.default_rng(net.seed + 1)
    padded = [_padded(text, net) for text in texts]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    step = 0
    for epoch in range(net.epochs):
        rate = net.rate * (1 - epoch / net.epochs) + net.rate * 0.05
        order = rng.permutation(len(padded))
        for at in range(0, len(order), net.batch):
            rows = order[at : at + net.batch]
            seen = [_piece(padded[i], rng, net) if rng.random() < net.short else padded[i] for i in rows]
            step += 1
            for k, grad in gradients(seen, labels[rows], w, net).items():
                grad = grad + (net.decay * w[k] if k in ("filters", "out", "bytes") else 0)
                m, v = moments[k]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                w[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def probabilities(texts: list[bytes], w: dict[str, np.ndarray], net: Network, at_once: int = 64) -> list[float]:
    """Probability of label 1 for whole texts; an empty text is one chunk of zeros."""
    out = []
    length = net.chunk + net.width
    for text in texts:
        starts = chunk_starts(len(text), net)
        data = _padded(text, net)
        most, total = np.zeros(net.filters, np.float32), np.zeros(net.filters, np.float64)
        for at in range(0, len(starts), at_once):
            # A chunk reads on into the next one by the filters' width.
            some = starts[at : at + at_once]
            chunks = data[some[:, None] + np.arange(length)]
            _, z = _responses(chunks, w, net)
            pooled = np.maximum(z.max(axis=1) + w["bias"], 0)
            most = np.maximum(most, pooled.max(axis=0))
            total += pooled.sum(axis=0)
        features = np.concatenate([most, total / len(starts)])
        out.append(float(_sigmoid(features @ w["out"] + w["offset"])[0]))
    return out


def held_out(doc_id: str):
    """Rows that labels are never learned from: crc32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, net: Network = Network()) -> dict[str, np.ndarray]:
    """Weights from a sample of labelled rows that are not held out, within the bounds that ``net`` states.

    Without any such row (or with one class only) the network keeps its prior.
    """
    usable = documents(labels, "doc_id", "quality").where("doc_id IS NOT NULL AND quality IN (0, 1)")
    usable = usable.where(~held_out("doc_id")).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = F.broadcast(usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(net.sample))
    texts = documents(docs, "doc_id", "text").join(chosen, "doc_id")
    # One row for each chosen id, the one with the least hash of its text, whatever the documents repeat.
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    texts = store(texts.withColumn("_place", place).where("_place = 1").withColumn("_size", size))
    # Sizes of at most ``sample`` rows; texts in order of hash while the budget of bytes lasts.
    sizes = texts.where(F.col("_size") <= net.longest).select("doc_id", "_size", F.xxhash64("doc_id").alias("_hash"))
    before = Window.orderBy("_hash", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    within = sizes.withColumn("_total", F.sum("_size").over(before)).where(F.col("_total") <= net.budget)
    rows = texts.join(F.broadcast(within.select("doc_id")), "doc_id").select("quality", "text").collect()
    rows.sort(key=lambda r: (r.quality, r.text or ""))
    if not rows:
        return start_weights(net)
    return train([(r.text or "").encode() for r in rows], np.array([r.quality for r in rows], np.float32), net)


def _scored(w: dict[str, np.ndarray], net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            scores = probabilities(utf8(block.column("text")), w, net)
            yield pa.record_batch([block.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, w: dict[str, np.ndarray], net: Network = Network(), accept: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs`` (doc_id, text).

    A null text is empty and is scored as such; a null id is not held out; repeated rows are scored alike;
    an empty table gives none.
    """
    scored = documents(docs, "doc_id", "text").mapInArrow(_scored(w, net), "doc_id bigint, score double")
    predicted = (F.col("score") >= accept).cast("int").alias("predicted")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", predicted)
