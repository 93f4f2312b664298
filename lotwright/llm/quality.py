"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded from learned embeddings
of its words (hashed words and letter trigrams) and from measures of its
characters; gated attention weighs the encodings; the weighted sum is scored.
Only documents have labels, so the attention learns which passages decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, table, unique_name
from .labelled import labelled_sample

#: Labelled rows used for fitting, in expectation (all if there are fewer), and passages of each, evenly spaced.
TRAIN_ROWS, TRAIN_PASSAGES = 4_000, 64
PASSAGE_WORDS = 64
THRESHOLD = 0.7
#: Rows of the table of embeddings, to which words and trigrams are hashed, and its columns.
BUCKETS, EMBEDDING = 1 << 14, 16
_HIDDEN, _GATE, _EPOCHS, _BATCH = 16, 8, 8, 64

_CLASSES = 10
_CLASS = np.full(256, 9, dtype=np.uint8)  # other marks
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[128:] = 4
_CLASS[list(b".,;:'\"-?()")] = 5
_CLASS[ord("!")] = 6
_CLASS[ord("|")] = 7
_CLASS[10] = 8
MEASURES = _CLASSES + 4
FEATURES = MEASURES + EMBEDDING


def _powers(base: int, n: int, held: dict = {}) -> np.ndarray:  # noqa: B006
    """base**0 ... base**(n - 1) modulo 2**64; the longest asked for so far is held."""
    p = held.get(base, np.ones(1, dtype=np.uint64))
    while len(p) < n:
        p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
    held[base] = p
    return p[:n]


_BASE = 0x9E3779B97F4A7C15


class Passages:
    """A text's passages of PASSAGE_WORDS words: measures, and the buckets of words and trigrams.

    ``measures``: (passages, MEASURES). ``words`` and ``grams``: the table's rows
    for each word, and for each byte of a word with its neighbours (white space
    is one mark); ``word_at`` and ``gram_at``: where each passage's start. Case
    is ignored but in the measures. A text without words has no passage.
    """

    def __init__(self, raw: bytes):
        codes = np.frombuffer(raw, dtype=np.uint8)
        kind = _CLASS[codes]
        solid = (kind != 0) & (kind != 8)
        edge = np.diff(solid.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = len(starts)
        n = self.count = -(-total // PASSAGE_WORDS)
        if not n:
            self.measures = np.zeros((0, MEASURES), dtype=np.float32)
            return
        of_word = np.arange(total) // PASSAGE_WORDS
        self.word_at = np.arange(0, total, PASSAGE_WORDS)
        edges = np.append(starts[self.word_at], len(raw))
        edges[0] = 0
        low = np.frombuffer(raw.lower(), dtype=np.uint8)
        sums = np.zeros(len(low) + 1, dtype=np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(low)), out=sums[1:])
        h = (sums[ends] - sums[starts]) * _powers(pow(_BASE, -1, 1 << 64), len(low))[starts]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        self.words = (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
        mark = np.where(solid, low, 32).astype(np.uint32)
        around = np.concatenate([[np.uint32(32)], mark, [np.uint32(32)]])
        gram = ((around[:-2] << np.uint32(16)) | (around[1:-1] << np.uint32(8)) | around[2:])[solid] * np.uint32(2654435761)
        self.grams = (gram >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)
        before = np.cumsum(solid)
        self.gram_at = np.where(edges[:-1] > 0, before[np.maximum(edges[:-1] - 1, 0)], 0)

        counts = np.bincount(np.repeat(np.arange(n), np.diff(edges)) * _CLASSES + kind, minlength=n * _CLASSES).reshape(n, _CLASSES).astype(np.float32)
        size = np.minimum(PASSAGE_WORDS, total - PASSAGE_WORDS * np.arange(n)).astype(np.float32)
        by = np.lexsort((h, of_word))
        new = np.append(True, (np.diff(h[by]) != 0) | (np.diff(of_word[by]) != 0))
        out = self.measures = np.empty((n, MEASURES), dtype=np.float32)
        out[:, :_CLASSES] = counts / np.maximum(counts.sum(1, keepdims=True), 1)
        out[:, 0] = np.log1p(size)
        out[:, _CLASSES] = (counts.sum(1) - counts[:, 0] - counts[:, 8]) / size / 10
        out[:, _CLASSES + 1] = np.bincount(of_word[by][new], minlength=n) / size
        letters = counts[:, 1] + counts[:, 2]
        out[:, _CLASSES + 2] = counts[:, 2] / np.maximum(letters, 1)
        out[:, _CLASSES + 3] = counts[:, 9] / size

    def embedded(self, table: np.ndarray) -> np.ndarray:
        """(passages, EMBEDDING): half the mean of the words' rows and half that of the trigrams'."""
        out = np.zeros((self.count, table.shape[1]), table.dtype)
        for rows, at in ((self.words, self.word_at), (self.grams, self.gram_at)):
            sizes = np.diff(np.append(at, len(rows)))
            out += np.add.reduceat(table[rows], at) / (2 * sizes[:, None]).astype(table.dtype)
        return out


#: Bytes of a longer text that are read at once; it is cut where a passage ends, so the passages are those of the whole.
_PART = 1 << 20


def passages(text: str | None) -> list[Passages]:
    """The passages of a text, in one part unless it is very long; none for a text without words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if len(raw) <= _PART:
        parts = [raw]
    else:
        spaces = np.isin(np.frombuffer(raw, dtype=np.uint8), (9, 10, 11, 12, 13, 32))
        starts = np.flatnonzero(~spaces & np.append(True, spaces[:-1]))[::PASSAGE_WORDS]
        cuts = [0, *(starts[np.unique(np.searchsorted(starts, np.arange(_PART, len(raw), _PART)).clip(max=len(starts) - 1))].tolist() if len(starts) else []), len(raw)]
        parts = [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
    return [p for p in map(Passages, parts) if p.count]


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For fitting: TRAIN_PASSAGES passages' measures at most, and their embeddings' parts: passage, bucket, weight."""
    parts = passages(text)
    total = sum(p.count for p in parts)
    chosen = np.unique(np.linspace(0, total - 1, min(total, TRAIN_PASSAGES)).astype(int)) if total else np.zeros(0, int)
    measures, keys, weights, base = [np.zeros((0, MEASURES), np.float32)], [np.zeros(0, np.int64)], [np.zeros(0)], 0
    for p in parts:
        mine = chosen[(chosen >= base) & (chosen < base + p.count)] - base
        measures.append(p.measures[mine])
        place = np.full(p.count, -1)
        place[mine] = np.searchsorted(chosen, mine + base)
        for rows, at in ((p.words, p.word_at), (p.grams, p.gram_at)):
            sizes = np.diff(np.append(at, len(rows)))
            row, weight = np.repeat(place, sizes), np.repeat(0.5 / sizes, sizes)
            keys.append(row[row >= 0] * BUCKETS + rows[row >= 0])
            weights.append(weight[row >= 0])
        base += p.count
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    weight = np.bincount(back, np.concatenate(weights), len(key)) if len(key) else np.zeros(0)
    return np.concatenate(measures), (key // BUCKETS).astype(np.uint16), (key % BUCKETS).astype(np.uint16), weight.astype(np.float32)


class Network:
    """Embeddings, encoder, gated attention and scorer over bags of passages."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        init = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        self.mean, self.sd = mean, sd
        self.p = {"E": rng.normal(0, 0.3, (BUCKETS, EMBEDDING)), "W": init(FEATURES, _HIDDEN), "b": np.zeros(_HIDDEN), "V": init(_HIDDEN, _GATE), "U": init(_HIDDEN, _GATE), "w": init(_GATE, 1)[:, 0], "c": init(_HIDDEN, 1)[:, 0], "d": np.zeros(1)}

    def embed(self, n: int, row: np.ndarray, bucket: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """(n, EMBEDDING): weighted sums of rows of the table; ``row`` ascends and leaves none out."""
        parts = self.p["E"][bucket] * weight[:, None]
        return np.add.reduceat(parts, np.searchsorted(row, np.arange(n))) if n else np.zeros((0, EMBEDDING))

    def forward(self, x: np.ndarray, embedded: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Logits of the bags that start at rows ``first`` of measures and embeddings; no bag is empty."""
        p, sizes = self.p, np.diff(np.append(first, len(x)))
        x = np.concatenate([(x - self.mean) / self.sd, embedded], axis=1)
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), sizes))
        a = e / np.repeat(np.add.reduceat(e, first), sizes)
        z = np.add.reduceat(a[:, None] * h, first)
        return z @ p["c"] + p["d"], (x, h, t, s, a, z, sizes)

    def gradients(self, x: np.ndarray, sparse: tuple[np.ndarray, np.ndarray, np.ndarray], first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, (row, bucket, weight) = self.p, sparse
        logit, (x, h, t, s, a, z, sizes) = self.forward(x, self.embed(len(x), row, bucket, weight), first)
        g = (1 / (1 + np.exp(-logit)) - y) / len(y)
        dz = np.repeat(g[:, None] * p["c"], sizes, axis=0)
        da = (dz * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, first), sizes))
        dt, ds = de[:, None] * p["w"] * s * (1 - t * t), de[:, None] * p["w"] * t * s * (1 - s)
        dh = (a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        dx = (dh @ p["W"][MEASURES:].T)[row] * weight[:, None]
        table = np.column_stack([np.bincount(bucket, dx[:, k], BUCKETS) for k in range(EMBEDDING)])
        return {"E": table, "W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": de @ (t * s), "c": g @ z, "d": np.array([g.sum()])}

    def train(self, bags: list[tuple], y: np.ndarray, epochs: int = _EPOCHS, rate: float = 0.01, decay: float = 1e-3, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        m, v = ({n: np.zeros_like(a) for n, a in self.p.items()} for _ in range(2))
        k = 0
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), _BATCH):
                part = order[at : at + _BATCH]
                first = np.concatenate([[0], np.cumsum([len(bags[i][0]) for i in part])[:-1]])
                row = np.concatenate([bags[i][1] + f for i, f in zip(part, first, strict=True)])
                sparse = (row, *(np.concatenate([bags[i][c] for i in part]) for c in (2, 3)))
                k += 1
                for n, g in self.gradients(np.concatenate([bags[i][0] for i in part]), sparse, first, y[part]).items():
                    g = g + decay * (0.01 if n == "E" else 1) * self.p[n] * (n not in "bd")
                    m[n] = 0.9 * m[n] + 0.1 * g
                    v[n] = 0.999 * v[n] + 0.001 * g * g
                    self.p[n] = self.p[n] - rate * (m[n] / (1 - 0.9**k)) / (np.sqrt(v[n] / (1 - 0.999**k)) + 1e-8)

    def rounded(self) -> Network:
        """The same in single precision, for scoring."""
        self.p = {n: a.astype(np.float32) for n, a in self.p.items()}
        self.mean, self.sd = self.mean.astype(np.float32), self.sd.astype(np.float32)
        return self


def fit(sample: DataFrame) -> Network | float:
    """A network from (doc_id, text, label); where the labels are all the same or absent, their mean (or 1)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [[a.tobytes() for a in bag(t)] for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.binary()) for c in zip(*rows, strict=True)), part.column(1), part.column(2)], names=["x", "r", "k", "w", "label", "doc_id"])

    got = sample.select("text", "label", "doc_id").mapInArrow(run, "x binary, r binary, k binary, w binary, label int, doc_id bigint").toArrow()
    kinds, bags, y = (np.float32, np.uint16, np.uint16, np.float32), [], []
    # Rows come in any order; the order of training should not depend on it.
    for row in sorted(zip(*(got.column(c).to_pylist() for c in ("doc_id", "x", "r", "k", "w", "label")), strict=True)):
        if row[1]:
            x, r, k, w = (np.frombuffer(c, dtype=t) for c, t in zip(row[1:5], kinds, strict=True))
            bags.append((x.reshape(-1, MEASURES), r.astype(np.int64), k, w))
            y.append(float(row[5]))
    y = np.array(y)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 1.0
    every = np.concatenate([b[0] for b in bags]).astype(np.float64)
    net = Network(every.mean(0), every.std(0) + 1e-3)
    net.train(bags, y)
    return net.rounded()


def scores_of(net: Network, texts: list[str | None]) -> np.ndarray:
    """The score of each text, 0 for those without words."""
    measures, embedded, sizes, out = [], [], np.zeros(len(texts), int), np.zeros(len(texts))
    for k, text in enumerate(texts):
        for p in passages(text):
            measures.append(p.measures)
            embedded.append(p.embedded(net.p["E"]))
            sizes[k] += p.count
    full = np.flatnonzero(sizes)
    if len(full):
        first = np.cumsum(sizes[full]) - sizes[full]
        logit = net.forward(np.concatenate(measures), np.concatenate(embedded), first)[0]
        out[full] = 1 / (1 + np.exp(-logit.astype(np.float64)))
    return out


def score(docs: DataFrame, model: Network | float, column: str = "score") -> DataFrame:
    """``docs`` with a column ``column`` (underscores are added where it has one of that name).

    Texts without words, null ones too, have 0; equal texts have equal scores,
    also in rows that repeat a doc_id or have none. Texts of any length are read
    whole, and an empty table gives no row.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    column = unique_name(docs, column)

    def run(batches):
        net = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column("text").to_pylist()
                out = np.array([net if t and t.strip() else 0.0 for t in texts]) if isinstance(net, float) else scores_of(net, texts)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.float64())], names=[*part.schema.names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def scored(docs: DataFrame, fitted_on: DataFrame, labels: DataFrame, column: str = "score") -> DataFrame:
    """``docs`` with scores by a model fitted on the labelled rows of ``fitted_on`` outside the held-out fold."""
    sample = labelled_sample(fitted_on, labels, "quality", crc_mod(F.col("doc_id"), 4) != 2, TRAIN_ROWS)
    return score(docs, fit(sample), column)


def accepted(docs: DataFrame, fitted_on: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, in its columns (a column ``score`` of its own stays as it is)."""
    column = unique_name(docs, "quality_score")
    return scored(docs, fitted_on, labels, column).where(F.col(column) >= threshold).select(*docs.columns)


def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = scored(docs.select("doc_id", "text"), docs, table(spark, sf_dir, "labels"))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
