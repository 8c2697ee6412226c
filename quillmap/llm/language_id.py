"""Language identification by a byte convolutional network, trained in numpy.

Filters of several widths run over the bytes of a fixed-length window; each keeps its maximum,
and a softmax layer gives the probabilities of the languages. A text's score is the
mean over all its windows, weighted by their bytes, so every byte of every text counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.llm.common import fresh, query, table

WINDOW = 256
#: Widths of the filters in bytes, and filters of each width.
WIDTHS = (2, 3, 4)
FILTERS = 8

#: The training sample: at most so many texts of each language, so many windows of each.
SAMPLE_TEXTS = 200
SAMPLE_WINDOWS = 8
EPOCHS = 8
BATCH = 128
RATE = 0.02

#: For texts that are null or have no letter.
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_POSITIONS = WINDOW - max(WIDTHS) + 1
_PORTION = 2 << 20
#: Windows that go through the filters at a time: their values fit a core's cache.
_CHUNK = 48


@dataclass
class Network:
    """``filters[w][j]``: what byte j of a filter of width w adds, by byte value."""

    labels: list[str]
    filters: dict[int, np.ndarray]
    weights: np.ndarray
    bias: np.ndarray

    @cached_property
    def pair_tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Filter values by two bytes at a time: bytes 0 and 1 of all filters, and bytes 2 and 3 of the wider ones."""
        f = self.filters
        first = np.concatenate([f[w][0][:, None, :] + f[w][1][None, :, :] for w in WIDTHS], axis=2)
        second = np.concatenate([
            np.broadcast_to(f[3][2][:, None, :], (256, 256, FILTERS)), f[4][2][:, None, :] + f[4][3][None, :, :]
        ], axis=2)
        return first.reshape(1 << 16, -1).copy(), second.reshape(1 << 16, -1).copy()

    def __getstate__(self) -> dict:
        """Tasks get the filters and make the tables themselves."""
        return {k: v for k, v in self.__dict__.items() if k != "pair_tables"}

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """One row per window of ``WINDOW`` bytes, zeros after the end of a text."""
        first, second = self.pair_tables
        out = np.empty((len(windows), len(self.labels)), np.float32)
        low = np.empty((_CHUNK * _POSITIONS, first.shape[1]), np.float32)
        high = np.empty((_CHUNK * _POSITIONS, second.shape[1]), np.float32)
        for at in range(0, len(windows), _CHUNK):
            part = windows[at: at + _CHUNK].astype(np.int32)
            pairs = part[:, :-1] * 256 + part[:, 1:]
            n = len(part) * _POSITIONS
            np.take(first, pairs[:, :_POSITIONS].ravel(), axis=0, out=low[:n], mode="clip")
            np.take(second, pairs[:, 2: 2 + _POSITIONS].ravel(), axis=0, out=high[:n], mode="clip")
            low[:n, FILTERS:] += high[:n]
            pooled = low[:n].reshape(len(part), _POSITIONS, -1).max(axis=1)
            out[at: at + len(part)] = _softmax(np.maximum(pooled, 0) @ self.weights + self.bias)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.labels:
            return names, scores
        known = [i for i, t in enumerate(texts) if t is not None and _LETTER.search(t)]
        data = [texts[i].encode("utf-8", "replace") for i in known]
        counts = [-(-len(d) // WINDOW) for d in data]
        flat = b"".join(d.ljust(c * WINDOW, b"\0") for d, c in zip(data, counts))
        if not data:
            return names, scores
        windows = np.frombuffer(flat, np.uint8).reshape(-1, WINDOW)
        ends = np.cumsum(counts)
        sizes = np.full(len(windows), WINDOW, np.float32)
        sizes[ends - 1] = [len(d) - (c - 1) * WINDOW for d, c in zip(data, counts)]
        sums = np.add.reduceat(self.probabilities(windows) * sizes[:, None], ends - counts, axis=0)
        mean = sums / np.array([len(d) for d in data])[:, None]
        for i, row in zip(known, mean):
            best = int(row.argmax())
            names[i], scores[i] = self.labels[best], min(1.0, float(row[best]))
        return names, scores


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(windows: np.ndarray, classes: np.ndarray, labels: list[str], seed: int = 7) -> Network:
    """Train with Adam; the gradient of a filter flows to the place of its maximum alone."""
    rng = np.random.default_rng(seed)
    params = {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
    params |= {"weights": rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32)}
    params |= {"bias": np.zeros(len(labels), np.float32)}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    step = 0
    for _ in range(EPOCHS if len(labels) > 1 else 0):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            chosen = order[at: at + BATCH]
            batch, n = windows[chosen], len(chosen)
            pooled, places = [], {}
            for w in WIDTHS:
                values = sum(params[w][j][batch[:, j: j + _POSITIONS]] for j in range(w))
                places[w] = values.argmax(axis=1)
                pooled.append(np.take_along_axis(values, places[w][:, None, :], axis=1)[:, 0])
            features = np.concatenate(pooled, axis=1)
            active = np.maximum(features, 0)
            error = _softmax(active @ params["weights"] + params["bias"])
            error[np.arange(n), classes[chosen]] -= 1
            error /= n
            grads = {"weights": active.T @ error, "bias": error.sum(axis=0)}
            back = (error @ params["weights"].T) * (features > 0)
            for k, w in enumerate(WIDTHS):
                part, grads[w] = back[:, k * FILTERS: (k + 1) * FILTERS], np.zeros_like(params[w])
                for j in range(w):
                    hit = np.take_along_axis(batch, places[w] + j, axis=1)
                    np.add.at(grads[w][j], (hit, np.arange(FILTERS)[None, :]), part)
            step += 1
            for key, grad in grads.items():
                mean, square = moments[key]
                mean += 0.1 * (grad - mean)
                square += 0.001 * (grad * grad - square)
                params[key] -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Network(labels, {w: params[w] for w in WIDTHS}, params["weights"], params["bias"])


def sample_windows(labelled: DataFrame, text: str, label: str) -> list:
    """Rows ``label, windows`` of a bounded sample: at most ``SAMPLE_TEXTS`` texts of each label.

    Texts are drawn by their own hash, so copies count once and the partitioning has no
    influence. The labels are the languages of the corpus, a list of bounded length.
    """
    content = F.encode(F.col(text), "UTF-8")
    size = F.octet_length(F.col(text))
    starts = F.transform(
        F.sequence(F.lit(0), F.lit(SAMPLE_WINDOWS - 1)),
        lambda i: F.floor((size - WINDOW) * i / (SAMPLE_WINDOWS - 1)).cast("int"),
    )
    windows = F.when(size <= WINDOW, F.array(content)).otherwise(
        F.transform(starts, lambda s: F.substring(content, s + 1, F.lit(WINDOW)))
    )
    known = labelled.where(F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}"))
    known = known.select(F.col(label).cast("string").alias("label"), F.xxhash64(text).alias("hash"), windows.alias("windows"))
    distinct = known.groupBy("label").agg(F.approx_count_distinct("hash").alias("texts")).collect()
    if not distinct:
        return []
    scale = 1 << 30
    limit = F.coalesce(*[
        F.when(F.col("label") == r.label, F.lit(min(scale, 1 + 2 * SAMPLE_TEXTS * scale // max(1, r.texts)))) for r in distinct
    ])
    drawn = known.where(F.pmod("hash", F.lit(scale)) < limit).dropDuplicates(["label", "hash"])
    rows = drawn.orderBy("label", "hash").limit(4 * SAMPLE_TEXTS * len(distinct)).collect()
    kept: dict[str, int] = {}
    out = []
    for row in rows:
        kept[row.label] = kept.get(row.label, 0) + 1
        if kept[row.label] <= SAMPLE_TEXTS:
            out.append(row)
    return out


def train(labelled: DataFrame, text: str = "text", label: str = "lang") -> Network:
    """A network for the labels that are there; without any it knows no language."""
    rows = sample_windows(labelled, text, label)
    labels = sorted({r.label for r in rows})
    flat = [(w, labels.index(r.label)) for r in rows for w in r.windows]
    windows = np.frombuffer(b"".join(bytes(w).ljust(WINDOW, b"\0") for w, _ in flat), np.uint8).reshape(-1, WINDOW)
    return fit(windows, np.array([c for _, c in flat], np.int64), labels)


def predicted(network: Network, text: Column) -> Column:
    """A struct ``lang, score``; ``und`` with 0 for a null text or one without letters."""

    @F.pandas_udf("lang string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            texts, names, scores, first = series.tolist(), [], [], 0
            while first < len(texts):
                last, size = first, 0
                while last < len(texts) and size < _PORTION:
                    size += len(texts[last] or "")
                    last += 1
                more = network.predict(texts[first:last])
                names += more[0]
                scores += more[1]
                first = last
            yield pd.DataFrame({"lang": names, "score": scores})

    return run(text)


def accepted_documents(docs: DataFrame, text: str = "text", label: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text has a language that its labelled rows teach, with all their columns.

    Rejected are null texts and those without a letter. A table without labels teaches no language; there
    every text with a letter is accepted. An empty table stays empty.
    """
    network = train(docs, text, label)
    if not network.labels:
        return docs.where(F.col(text).rlike(r"\p{L}"))
    (found,) = fresh(docs.columns, "language")
    kept = docs.withColumn(found, predicted(network, F.col(text)))
    return kept.where(F.col(found)["lang"] != UNKNOWN).drop(found)


def held_out(doc_id: Column) -> Column:
    """Every fourth document by the checksum of its identifier; null identifiers are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    network = train(docs.where(~held_out(F.col("doc_id"))))
    found = docs.select("doc_id", predicted(network, F.col("text")).alias("found"))
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("found.lang").alias("lang_pred"), "found.score"
    )
