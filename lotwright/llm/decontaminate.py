"""Benchmark decontamination by latent semantic retrieval.

Texts are coded with the benchmark's words and cut into blocks. Word weights
come from the blocks of all documents. A randomised singular value
decomposition of weighted passages (the blocks of all documents, and the items)
gives a space of DIMENSIONS directions: executors add up the product of the
passages' covariance with a random matrix. Windows of blocks and
items are compared by cosine in that space. Candidates are verified by a
weighted longest common subsequence, and by a check of the item's answer (its
last words).
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table, unique_name

DIMENSIONS, OVERSAMPLE = 96, 8
#: Tasks that add up what those before them found for each word.
FIT_TASKS = 16
#: Words of a block; blocks of the windows that items of rising length are sought in, doubled on to the longest item.
BLOCK, WINDOWS = 24, (2, 4)
COSINE = 0.4
#: A window is compared with items if its weight is at least this part of the lightest one's; a find needs LIKELY of an item.
WEIGHED = 0.3
#: Part of an item's weight that its longest common subsequence holds: enough alone, and enough with the answer.
SURE, LIKELY, ANSWER_WORDS, ANSWER = 0.65, 0.5, 6, 0.8
#: Words in more than this part of all blocks carry no weight where an item has RARE_WORDS others.
COMMON, RARE_WORDS = 0.02, 5
#: The benchmark is read in parts of so many items and about so many words, so what is sent to executors is bounded.
ITEMS, ITEM_WORDS = 5_000, 100_000
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _coded(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(doc_id, tie, ids): each word's number as little-endian uint32, 0 for words no item has; docs: (doc_id, tie, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        get = sent.value.get
        for batch in batches:
            rows = []
            for text in batch.column(2).to_pylist():
                words = words_of(text)
                rows.append(np.fromiter(map(get, words, repeat(0)), dtype="<u4", count=len(words)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["doc_id", "tie", "ids"])

    return docs.mapInArrow(run, "doc_id bigint, tie bigint, ids binary")


def _blocks(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch's documents: known words' ids, their blocks, the documents' first blocks (and the end), all ids' offsets."""
    arrays = [np.frombuffer(b, dtype="<u4") for b in column.to_pylist()]
    sizes = np.array([len(a) for a in arrays], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(-(-sizes // BLOCK))])
    ids = np.concatenate(arrays) if len(arrays) else np.zeros(0, np.uint32)
    start = np.cumsum(sizes) - sizes
    block = np.repeat(first[:-1], sizes) + (np.arange(len(ids)) - np.repeat(start, sizes)) // BLOCK
    there = ids > 0
    return ids[there], block[there], first, np.concatenate([start, [len(ids)]])


def _by_word(ids: np.ndarray, terms: int) -> np.ndarray:
    """Places in order of words, a word's in their own order; short numbers are sorted by radix."""
    return np.argsort(ids.astype(np.uint16) if terms <= 1 << 16 else ids, kind="stable")


def block_counts(coded: DataFrame, terms: int) -> tuple[int, np.ndarray]:
    """The number of blocks with a known word, and of those with each word."""

    def run(batches):
        n, counts = 0, np.zeros(terms, np.int64)
        for batch in batches:
            ids, block, _, _ = _blocks(batch.column(0))
            if len(ids):
                by = _by_word(ids, terms)
                word, place = ids[by], block[by]
                counts += np.bincount(word[np.concatenate([[True], (word[1:] != word[:-1]) | (place[1:] != place[:-1])])], minlength=terms)
                n += 1 + int(np.count_nonzero(np.diff(block)))
        counts[0] = n
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["term", "n"])

    rows = coded.select("ids").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(terms, np.int64)
    out[rows.column("term").to_numpy()] = rows.column("n").to_numpy()
    return int(out[0]), out


def latent_space(coded: DataFrame, weight: np.ndarray, items: list[np.ndarray], dimensions: int = DIMENSIONS, seed: int = 5) -> np.ndarray:
    """(terms, dimensions): the leading right singular vectors of weighted passages.

    The passages are the blocks of all documents and the items, both with the
    same total energy. With their covariance G and a random matrix O, each task
    gives its part of G O, and FIT_TASKS tasks sum these by words, so the driver
    gets one row for each word; G is then about (G O)(O' G O)^-1 (G O)'.
    """
    used = np.flatnonzero(weight)
    size = min(dimensions + OVERSAMPLE, len(used))
    if not size:
        return np.zeros((len(weight), 0))
    omega = np.zeros((len(weight), size), dtype=np.float32)
    omega[used] = np.random.default_rng(seed).normal(size=(len(used), size))
    scaled = (omega * weight[:, None]).astype(np.float32)
    sent = coded.sparkSession.sparkContext.broadcast((scaled, weight.astype(np.float32)))

    def run(batches):
        scaled, weight = sent.value
        total, energy = np.zeros(scaled.shape, dtype=np.float32), 0.0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                ids, block, _, _ = _blocks(batch.slice(at, 512).column(0))
                keep = weight[ids] > 0
                ids, block = ids[keep], block[keep]
                if not len(ids):
                    continue
                energy += float((weight[ids] ** 2).sum())
                y = np.add.reduceat(scaled[ids], np.flatnonzero(np.diff(block, prepend=-1)), axis=0)
                row = np.cumsum(np.diff(block, prepend=block[0]) > 0)
                by = _by_word(ids, len(weight))
                starts = np.flatnonzero(np.diff(ids[by].astype(np.int64), prepend=-1))
                total[ids[by][starts]] += np.add.reduceat(y[row[by]], starts, axis=0)
        at = np.flatnonzero(total.any(axis=1))
        total[0, 0] = energy
        yield pa.RecordBatch.from_arrays([pa.array([0, *at.tolist()]), pa.array([total[0], *(total[at] * weight[at][:, None])], pa.list_(pa.float32()))], names=["term", "y"])

    def add_up(batches):
        held = {}
        for batch in batches:
            values = batch.column(1).values.to_numpy().reshape(-1, size)
            for term, y in zip(batch.column(0).to_pylist(), values, strict=True):
                if term in held:
                    held[term] += y
                else:
                    held[term] = y.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([*held], pa.int64()), pa.array([*held.values()], pa.list_(pa.float64()))], names=["term", "y"])

    parts = coded.select("ids").mapInArrow(run, "term bigint, y array<float>").repartition(FIT_TASKS, "term")
    y, energy = np.zeros((len(weight), size)), 0.0
    for part in parts.mapInArrow(add_up, "term bigint, y array<double>").toArrow().to_batches():
        at, values = part.column(0).to_numpy(), part.column(1).values.to_numpy().reshape(-1, size)
        energy += values[at == 0, 0].sum()
        y[at[at > 0]] = values[at > 0]
    own = sum(float((weight[x] ** 2).sum()) for x in items)
    for x in items:
        np.add.at(y, x, (scaled[x].sum(0, dtype=np.float64) * weight[x][:, None]) * (energy or own) / max(own, 1e-12))
    core = omega.T.astype(np.float64) @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > max(values.max(), 0) * 1e-9
    if not good.any():
        return np.zeros((len(weight), 0))
    u, _, _ = np.linalg.svd(y @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    return u[:, :dimensions]


def common_weight(item: np.ndarray, text: np.ndarray, weight: np.ndarray) -> float:
    """The weight of the heaviest common subsequence of two word sequences, as a part of the item's weight."""
    own = weight[item]
    text = text[np.isin(text, item)]
    best = np.zeros(len(item) + 1)
    for word in text:
        taken = np.where(item == word, best[:-1] + own, 0)
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], taken))
    return float(best[-1] / max(own.sum(), 1e-12))


def windows_for(longest: int) -> tuple[int, ...]:
    """WINDOWS, doubled on until one holds ``longest`` words wherever they start in a block."""
    out = [*WINDOWS]
    while (out[-1] - 1) * BLOCK < longest:
        out.append(out[-1] * 2)
    return tuple(out)


def _verify(text: np.ndarray, item: np.ndarray, total: float, weight: np.ndarray, there: np.ndarray) -> tuple[float, float] | None:
    """The weights of the item and its answer that a stretch of text holds in order; none if too little. ``there`` is scratch."""
    # No subsequence weighs more than the item's words that are there at all.
    there[text] = True
    most = weight[item] @ there[item]
    there[text] = False
    if most < LIKELY * total:
        return None
    common = common_weight(item, text, weight)
    if common < LIKELY:
        return None
    answer = common_weight(item[-ANSWER_WORDS:], text, weight)
    return (common, answer) if common >= SURE or answer >= ANSWER else None


def _check(docs: DataFrame, items: list[tuple[int, list[str]]], cosine: float) -> DataFrame:
    vocabulary: dict[str, int] = {}
    for _, words in items:
        for w in words:
            vocabulary.setdefault(w, len(vocabulary) + 1)
    terms = len(vocabulary) + 1
    coded = cut(_coded(docs, vocabulary), "coded")
    n, counts = block_counts(coded, terms)
    weight = np.log((n + 1) / (counts + 1)) + 0.01
    weight[0] = 0
    ids = [np.array([vocabulary[w] for w in words], dtype=np.int64) for _, words in items]
    rare = weight.copy()
    rare[counts > COMMON * n] = 0
    for x in ids:
        if len(np.unique(x[rare[x] > 0])) < RARE_WORDS:
            rare[x] = weight[x]
    space = latent_space(coded, rare, ids)
    queries = np.array([rare[x] @ space[x] for x in ids]).reshape(len(ids), space.shape[1])
    queries /= np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-12)
    windows = windows_for(max(len(x) for x in ids))
    reach = np.searchsorted([BLOCK * (w - 1) for w in windows[:-1]], [len(x) for x in ids])
    heavy = np.array([rare[x].sum() for x in ids])
    least = [WEIGHED * min(heavy[reach == k], default=np.inf) for k in range(len(windows))]
    model = (ids, (space * rare[:, None]).astype(np.float32), rare, least, queries.astype(np.float32), reach, weight, [i for i, _ in items])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        ids, space, rare, least, queries, reach, weight, names = sent.value
        total, there = np.array([weight[x].sum() for x in ids]), np.zeros(len(weight), bool)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                known, block, first, offsets = _blocks(part.column(2))
                keep = rare[known] > 0
                known, block = known[keep], block[keep]
                if not len(known):
                    continue
                end = int(first[-1])
                mass = np.bincount(block, rare[known], minlength=end + max(windows))
                rows, needed, width = [], np.zeros(end + max(windows) + 1, np.int64), 1
                for k, w in enumerate(windows):
                    while width < w:
                        mass = mass[:-width] + mass[width:]
                        width *= 2
                    rows.append(np.flatnonzero(mass[:end] >= max(least[k], 1e-9)))
                    needed[rows[k]] += 1
                    needed[rows[k] + w] -= 1
                needed = np.cumsum(needed) > 0
                keep = needed[block]
                known, block = known[keep], block[keep]
                if not len(known):
                    continue
                # Vectors of the needed blocks alone, the last one of zeros for those without a word.
                starts = np.flatnonzero(np.diff(block, prepend=-1))
                own = block[starts]
                place = np.full(len(needed), len(own))
                place[own] = np.arange(len(own))
                p = np.vstack([np.add.reduceat(space[known], starts, axis=0), np.zeros((1, space.shape[1]), np.float32)])
                sums = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p[:-1], axis=0, dtype=np.float64)]) if len(windows) > len(WINDOWS) else None
                found = []
                for k, w in enumerate(windows):
                    mine = np.flatnonzero(reach == k)
                    for a in range(0, len(rows[k]) if len(mine) else 0, 4096):
                        r = rows[k][a : a + 4096]
                        if w <= max(WINDOWS):
                            v = sum(p[place[r + j]] for j in range(w))
                        else:
                            # Wide ones end with their document.
                            stop = np.minimum(r + w, first[np.searchsorted(first, r, "right")])
                            v = (sums[np.searchsorted(own, stop)] - sums[np.searchsorted(own, r)]).astype(np.float32)
                        sims = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)) @ queries[mine].T
                        i, j = np.nonzero(sims >= cosine)
                        found.append((r[i], mine[j], np.full(len(i), w), sims[i, j]))
                if not any(len(x[0]) for x in found):
                    continue
                # All windows of a document and item, those whose stretches overlap together.
                row, item, wide, sim = (np.concatenate(x) for x in zip(*found, strict=True))
                doc = np.searchsorted(first, row, "right") - 1
                by = np.lexsort((row, item, doc))
                row, item, wide, sim, doc = row[by], item[by], wide[by], sim[by], doc[by]
                margin = np.maximum(BLOCK, wide * BLOCK // 2)
                begin = (row - first[doc]) * BLOCK
                stop = begin + wide * BLOCK + margin
                begin = np.maximum(0, begin - margin)
                fresh = np.diff(doc * len(ids) + item, prepend=-1) != 0
                fresh[1:] |= begin[1:] > stop[:-1]
                lead = np.flatnonzero(fresh)
                texts, best = {}, {}
                for a, b in zip(lead.tolist(), [*lead[1:].tolist(), len(row)], strict=True):
                    d, x = int(doc[a]), int(item[a])
                    if d not in texts:
                        texts = {d: np.frombuffer(part.column(2)[d].as_py(), dtype="<u4").astype(np.int64)}
                    # What all stretches hold together bounds what each one does.
                    limit = _verify(texts[d][begin[a] : stop[b - 1]], ids[x], total[x], weight, there)
                    if limit is None:
                        continue
                    for k in (a + np.argsort(-sim[a:b], kind="stable")).tolist():
                        got = limit if b - a == 1 else _verify(texts[d][begin[k] : stop[k]], ids[x], total[x], weight, there)
                        if got is not None:
                            best[d, x] = max(best.get((d, x), (0.0, 0.0, 0.0)), (*got, float(sim[k])))
                            if got >= limit:
                                break
                out = [(part.column(0)[d].as_py(), part.column(1)[d].as_py(), names[x], sim, common, answer) for (d, x), (common, answer, sim) in best.items()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)], names=["doc_id", "tie", "item_id", "cosine", "common", "answer"])

    return coded.mapInArrow(run, "doc_id bigint, tie bigint, item_id bigint, cosine double, common double, answer double")


def _found(docs: DataFrame, benchmark: DataFrame, cosine: float) -> DataFrame:
    """(doc_id, tie, item_id, cosine, common, answer): rows that hold an item, told apart by id and hash of the text."""
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").orderBy("item_id", "text")
    out, part, size = None, [], 0

    def add(out, part):
        found = _check(docs, part, cosine)
        return found if out is None else out.union(found)

    for r in rows.toLocalIterator():
        if words := words_of(r["text"]):
            part.append((r["item_id"], words))
            size += len(words)
        if len(part) == ITEMS or size >= ITEM_WORDS:
            out, part, size = add(out, part), [], 0
    if part:
        out = add(out, part)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, tie bigint, item_id bigint, cosine double, common double, answer double")
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(doc_id, item_id, cosine, common, answer) of the documents that hold a benchmark item.

    One row for each pair of ids, with the greatest values among rows that
    repeat them (all rows with a null id are one here). Null and empty texts
    and items hold nothing and are not found; items that repeat an id or a text
    are each sought; a long text is searched to its end. Empty tables give no
    row. Other columns are ignored, whatever their names. The benchmark is read
    in parts of ITEMS or about ITEM_WORDS words, each of which passes over all
    documents.
    """
    return _found(docs, benchmark, cosine).groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("cosine", "common", "answer")])


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, in its columns.

    Rows go by their own text: another row with the same or a null doc_id
    stays if its text is clean.
    """
    bad_id, bad_text = unique_name(docs, "bad_id"), unique_name(docs, "bad_text")
    found = cut(_found(docs, benchmark, COSINE).select(F.col("doc_id").alias(bad_id), F.col("tie").alias(bad_text)).distinct(), "contaminated")
    same = docs["doc_id"].cast("bigint").eqNullSafe(found[bad_id]) & (F.xxhash64(docs["text"].cast("string")) == found[bad_text])
    return docs.join(found, same, "left_anti")


def op5(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
