"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes go through ``filters`` learned filters of ``width``
bytes, one step every ``stride`` bytes. Their rectified outputs are averaged
over each of the overlapping chunks (``chunk`` steps, half of them shared with
the next) that cover the whole document. A second learned layer combines a
chunk's averages into ``hidden`` rectified units, which also show a chunk that
is unlike any text (a few words again and again), and each unit's largest value
over the chunks is a feature. A logistic unit combines the features into one
probability. A filter's weights are a number per place and byte value, so
running it is adding up table rows.

The model is fitted by gradient descent on the driver on at most
``sample_rows`` labelled rows and ``sample_bytes`` of text, of texts of at most
``longest`` bytes each (the bounds are parameters; rows are chosen by a hash of
their id). Texts are run in windows there as well, and gradients go through the
best chunks only. The model scores every document in its partition. Only the
text enters a score.

Defined results: null and empty texts are scored as one step over padding;
labels that are null are not used, of several labels for one id the mean
counts, of several texts for one id the first in order is learned from; without any labelled row of both classes every score is the share of
label 1 (1 if there are no labels); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.shared import PRIVATE, filled


@dataclass
class ByteNet:
    """Weights: ``table[place, byte, filter]`` and ``bias[filter]``;
    ``mix[filter, unit]`` and ``mix_bias[unit]`` of the second layer;
    ``out[unit]`` and ``out_bias`` of the logistic unit."""

    table: np.ndarray
    bias: np.ndarray
    mix: np.ndarray
    mix_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    stride: int = 2
    chunk: int = 32
    #: Chunks run at once, so that a long text needs no more memory.
    window: int = 1 << 11

    def steps(self, data: np.ndarray) -> np.ndarray:
        """Rectified filter outputs, a row per step. ``data`` is padded."""
        width = len(self.table)
        number = (len(data) - width) // self.stride + 1
        total = self.table[0].take(data[: self.stride * number : self.stride], axis=0)
        for place in range(1, width):
            total += self.table[place].take(data[place : place + self.stride * number : self.stride], axis=0)
        total += self.bias
        return np.maximum(total, 0, out=total)

    def padded(self, text: str) -> np.ndarray:
        data = text.encode("utf-8")
        width = len(self.table)
        number = max(1, -(-len(data) // self.stride))
        return np.frombuffer(data.ljust((number - 1) * self.stride + width, b"\0"), np.uint8)

    def starts(self, number: int) -> np.ndarray:
        """First steps of the chunks that cover so many steps."""
        if number <= self.chunk:
            return np.zeros(1, np.int64)
        found = np.arange(0, number - self.chunk + 1, self.chunk // 2)
        return found if found[-1] + self.chunk == number else np.append(found, number - self.chunk)

    def means(self, held: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The averages of rows of ``held`` over the chunks that start there."""
        size = min(self.chunk, len(held))
        sums = np.concatenate([np.zeros((1, held.shape[1])), np.cumsum(held, axis=0, dtype=np.float64)])
        return (sums[starts + size] - sums[starts]) / size

    def tops(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each unit's largest value over the chunks of a padded text, before it
        is rectified, and the first step of the chunk that has it, worked out in
        windows of chunks."""
        starts = self.starts((len(data) - len(self.table)) // self.stride + 1)
        best, first, units = np.full(len(self.out), -np.inf), np.zeros(len(self.out), np.int64), np.arange(len(self.out))
        for at in range(0, len(starts), self.window):
            some = starts[at : at + self.window]
            low, high = some[0] * self.stride, (some[-1] + self.chunk - 1) * self.stride + len(self.table)
            mixed = self.means(self.steps(data[low:high]), some - some[0]) @ self.mix + self.mix_bias
            top = mixed.argmax(axis=0)
            more = mixed[top, units] > best
            best, first = np.where(more, mixed[top, units], best), np.where(more, some[top], first)
        return best, first

    def features(self, text: str) -> np.ndarray:
        """Each unit's largest value over the chunks."""
        return np.maximum(self.tops(self.padded(text))[0], 0)

    def score(self, text: str) -> float:
        z = float(self.features(text) @ self.out) + self.out_bias
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


#: The weights that are learned.
LEARNED = ("table", "bias", "mix", "mix_bias", "out", "out_bias")


def gradients(net: ByteNet, data: list[np.ndarray], labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The mean logistic loss over padded texts, and its gradients; of a maximum
    over chunks, through the chunk that gave it."""
    width, _, filters = net.table.shape
    total, columns, units = 0.0, np.arange(filters), np.arange(len(net.out))
    found = {name: np.zeros(np.shape(getattr(net, name))) for name in LEARNED}
    table = found["table"].reshape(width, -1)
    for bytes_, label in zip(data, labels):
        # Forward in windows; back through the best chunks only.
        most, first = net.tops(bytes_)
        best = np.maximum(most, 0)
        size = min(net.chunk, (len(bytes_) - width) // net.stride + 1)
        z = np.clip(best @ net.out + net.out_bias, -60, 60)
        total += np.logaddexp(0, -z if label else z)
        error = (1 / (1 + np.exp(-z)) - label) / len(data)
        found["out"] += error * best
        found["out_bias"] += error
        d_mixed = np.where(best > 0, error * net.out, 0.0)
        found["mix_bias"] += d_mixed
        # The steps of each unit's best chunk, where the filter is active.
        rows = (first[:, None] + np.arange(size)).ravel()
        held = np.concatenate([net.steps(bytes_[at * net.stride : (at + size - 1) * net.stride + width]) for at in first])
        found["mix"] += held.reshape(len(units), size, filters).mean(axis=1, dtype=np.float64).T * d_mixed
        grad = np.repeat((net.mix * d_mixed).T / size, size, axis=0) * (held > 0)
        found["bias"] += grad.sum(axis=0)
        for place in range(width):
            spot = bytes_[rows * net.stride + place].astype(np.int64)[:, None] * filters + columns
            table[place] += np.bincount(spot.ravel(), grad.ravel(), table.shape[1])
    return total / len(data), found


def fit(texts: list[str], labels: np.ndarray, filters: int = 16, width: int = 6, hidden: int = 16, epochs: int = 4, batch: int = 32, rate: float = 0.02, seed: int = 7, steps: int = 400) -> ByteNet:
    """Logistic loss, Adam. Few rows are gone through more than ``epochs`` times,
    for at least ``steps`` gradient steps."""
    epochs = max(epochs, -(-steps // max(1, -(-len(texts) // batch))))
    draw = np.random.default_rng(seed)
    share = float(labels.mean()) if len(labels) else 1.0
    prior = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    net = ByteNet(
        (draw.normal(0, 0.3, (width, 256, filters))).astype(np.float32), np.full(filters, 0.1, np.float32),
        draw.normal(0, filters**-0.5, (filters, hidden)).astype(np.float32), np.zeros(hidden, np.float32),
        draw.normal(0, 0.3, hidden).astype(np.float32), np.clip(prior, -20, 20),
    )
    if not 0 < share < 1:
        net.out[:] = 0
        return net
    data = [net.padded(t) for t in texts]
    #: How much of a weight is added to its gradient.
    decay = {"table": 1e-5, "mix": 1e-4, "out": 1e-4}
    moments = {name: (0.0, 0.0) for name in LEARNED}
    step = 0
    for epoch in range(epochs):
        pace = rate * (1 - epoch / epochs)
        order = draw.permutation(len(data))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            step += 1
            _, found = gradients(net, [data[i] for i in some], labels[some])
            for name, gradient in found.items():
                value = getattr(net, name)
                gradient = gradient + decay.get(name, 0) * value
                m, v = moments[name]
                moments[name] = m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * np.square(gradient)
                new = value - pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
                setattr(net, name, float(new) if name == "out_bias" else new.astype(np.float32))
    return net


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether labels of these rows are left for testing."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 4000, sample_bytes: int = 48 << 20, longest: int = 1 << 20, **options) -> ByteNet:
    """Fit on at most ``sample_rows`` labelled rows that aren't held out, none
    of more than ``longest`` bytes, with at most ``sample_bytes`` in all."""
    label, size, text, rank = (PRIVATE + x for x in ("label", "size", "text", "rank"))
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(id_col).agg(F.avg(label_col).alias(label))
    sizes = docs.select(id_col, F.octet_length(filled(text_col)).alias(size)).join(known, id_col).groupBy(id_col, label).agg(F.max(size).alias(size))
    first = sizes.filter(F.col(size) <= longest).withColumn(rank, F.xxhash64(id_col)).orderBy(rank, id_col).limit(sample_rows)
    # At most ``sample_rows`` rows of a few numbers, here and in the broadcast.
    in_all = F.sum(size).over(Window.orderBy(rank, id_col).rowsBetween(Window.unboundedPreceding, 0))
    chosen = first.withColumn(size, in_all).filter(F.col(size) <= sample_bytes).select(id_col, label)
    rows = docs.select(id_col, filled(text_col).alias(text)).join(F.broadcast(chosen), id_col)
    rows = rows.groupBy(id_col).agg(F.min(text), F.first(label)).orderBy(id_col).collect()
    return fit([r[1] for r in rows], np.array([float(r[2] >= 0.5) for r in rows]), **options)


def scored(docs: DataFrame, net: ByteNet, keep: list[str], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The kept columns and each text's score. Equal texts that follow one
    another in a batch are scored once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, float] = {}
            found = []
            for text in batch.column(len(keep)).to_pylist():
                if text not in known:
                    known[text] = net.score(text)
                found.append(known[text])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(found, pa.float64())], names=[*keep, score_col])

    rows = docs.select(*keep, filled(text_col).alias(PRIVATE + "text"))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{schema}, `{score_col}` double")


def rejecting(docs: DataFrame, net: ByteNet, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all columns."""
    score = PRIVATE + "score"
    return scored(docs, net, docs.columns, text_col, score).filter(F.col(score) >= least).select(*docs.columns)
