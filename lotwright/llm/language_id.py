"""Language identification by segmentation-marginalised unigrams.

Every language has probabilities for the pieces of a fixed public vocabulary. A
word's probability is the sum over all its segmentations into pieces, by the
forward algorithm; a text's is the product over its words. The probabilities
come from expectation maximisation over the words of labelled texts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, table

UNKNOWN = "und"
#: Characters of labelled text used for each language, in expectation; all of it if there is less.
TRAIN_CHARS = 2_000_000
ROUNDS, SMOOTHING = 4, 0.1
#: Words of so many letters are summed side by side, longer ones one by one; those beyond TRAIN_LETTERS teach nothing.
TOGETHER, TRAIN_LETTERS = 48, 96
#: Every piece's probability is multiplied by this for each of its characters, so that sums stay in a double's range.
SCALE = 12.0
_CACHED_WORDS, _CACHED_LETTERS = 250_000, 64
_WORD = re.compile(r"[^\W\d_]+")
_START = "▁"


def vocabulary(path: str | None = None) -> dict[str, int]:
    """The lower-case pieces of the public vocabulary, numbered from 0; single characters come as they are met."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    found = sorted(p for p in found if p and all(c.isalpha() or c == _START for c in p))
    return {p: i for i, p in enumerate(found)}


def words_of(text: str | None) -> list[str]:
    """The lower-case runs of letters."""
    return _WORD.findall((text or "").lower())


def longest(pieces: dict[str, int]) -> int:
    return max(map(len, pieces), default=1)


def _lattice(words: list[str], pieces: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """For words of one length, the piece (or -1) of each span, and the spans (from, to)."""
    n, most = len(words[0]) + 1, longest(pieces)
    spans = [(i, j) for i in range(n) for j in range(i + 1, min(n, i + most) + 1)]
    get, unknown = pieces.get, len(pieces)
    ids = np.fromiter((get(w[i:j], unknown if j - i == 1 else -1) for w in (_START + x for x in words) for i, j in spans), dtype=np.int32, count=len(words) * len(spans))
    return ids.reshape(len(words), len(spans)), np.array(spans)


def _by_length(words: list[str]):
    groups: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        groups.setdefault(len(w), []).append(k)
    return groups.values()


def forward(words: list[str], pieces: dict[str, int], probs: np.ndarray) -> np.ndarray:
    """(words, languages): the logarithm of each word's probability, summed over all its segmentations. probs: (pieces + 2, languages), the last row 0."""
    out = np.zeros((len(words), probs.shape[1]))
    long, short = [k for k, w in enumerate(words) if len(w) > TOGETHER], [k for k, w in enumerate(words) if len(w) <= TOGETHER]
    for k in long:
        out[k] = _forward_long(words[k], pieces, probs)
    for group in _by_length([words[k] for k in short]):
        group = [short[k] for k in group]
        for at in range(0, len(group), 8192):
            part = group[at : at + 8192]
            ids, spans = _lattice([words[k] for k in part], pieces)
            n = int(spans[-1][1])
            alpha = np.zeros((n + 1, len(part), probs.shape[1]))
            alpha[0] = 1
            for s, (i, j) in enumerate(spans):
                there = np.flatnonzero(ids[:, s] >= 0)
                if len(there):
                    alpha[j, there] += alpha[i, there] * (probs[ids[there, s]] * SCALE ** (j - i))
            out[part] = np.log(np.maximum(alpha[n], 1e-300)) - n * np.log(SCALE)
    return out


def _forward_long(word: str, pieces: dict[str, int], probs: np.ndarray) -> np.ndarray:
    """forward() for one word of any length: only as many sums as the longest piece has characters are held, and scaled."""
    word = _START + word
    most, unknown = longest(pieces), len(pieces)
    held, shift = np.zeros((most, probs.shape[1])), np.zeros(probs.shape[1])
    held[0] = 1
    for j in range(1, len(word) + 1):
        new = np.zeros(probs.shape[1])
        for size in range(1, min(j, most) + 1):
            piece = pieces.get(word[j - size : j], unknown if size == 1 else -1)
            if piece >= 0:
                new += held[(j - size) % most] * (probs[piece] * SCALE**size)
        held[j % most] = new
        top = held.max(axis=0)
        off = (top < 1e-100) | (top > 1e100)
        if off.any():
            factor = np.where(off, 1 / np.maximum(top, 1e-300), 1.0)
            held *= factor
            shift -= np.log(factor)
    return np.log(np.maximum(held[len(word) % most], 1e-300)) + shift - len(word) * np.log(SCALE)


def train(counts: dict[str, dict[str, int]], pieces: dict[str, int], rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """The languages and their piece probabilities from word counts, by expectation maximisation."""
    languages = sorted(counts)
    probs = np.zeros((len(pieces) + 2, len(languages)))
    for k, lang in enumerate(languages):
        words = sorted(w for w in counts[lang] if len(w) <= TRAIN_LETTERS)
        weight = np.array([counts[lang][w] for w in words], dtype=float)
        groups = []
        for group in _by_length(words):
            for at in range(0, len(group), 8192):
                part = group[at : at + 8192]
                ids, spans = _lattice([words[x] for x in part], pieces)
                # Spans without a piece go to the last row, whose probability is 0.
                groups.append((np.where(ids < 0, len(pieces) + 1, ids), spans, weight[part]))
        p = np.full(len(pieces) + 2, 1.0 / (len(pieces) + 1))
        p[-1] = 0
        for _ in range(rounds):
            got = np.full(len(p), SMOOTHING)
            for ids, spans, w in groups:
                n = int(spans[-1][1])
                alpha, beta = np.zeros((n + 1, len(w))), np.zeros((n + 1, len(w)))
                alpha[0], beta[n] = 1, 1
                for s, (i, j) in enumerate(spans):
                    alpha[j] += alpha[i] * (p[ids[:, s]] * SCALE ** (j - i))
                for s in range(len(spans) - 1, -1, -1):
                    i, j = spans[s]
                    beta[i] += beta[j] * (p[ids[:, s]] * SCALE ** (j - i))
                scale = w / np.maximum(alpha[n], 1e-300)
                for s, (i, j) in enumerate(spans):
                    got += np.bincount(ids[:, s], alpha[i] * (p[ids[:, s]] * SCALE ** (j - i)) * beta[j] * scale, len(p))
            got[-1] = 0
            p = got / got.sum()
        probs[:, k] = p
    return languages, probs


def learn(docs: DataFrame, pieces: dict[str, int], train_chars: int = TRAIN_CHARS) -> tuple[list[str], np.ndarray]:
    """Fit on the rows of ``docs`` with a language: hashed samples of at most about ``train_chars`` characters each."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy("lang").agg(F.sum(F.length("text"))).collect() if r[1]}
    if not sizes:
        return [], np.zeros((len(pieces) + 2, 0))
    part = F.lit(0.0)
    for lang, chars in sizes.items():
        part = F.when(F.col("lang") == lang, F.lit(min(1.0, train_chars / chars))).otherwise(part)
    chosen = known.where(F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 20)) < part * (1 << 20))

    def run(batches):
        for batch in batches:
            langs, found = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                found += words
                langs += [lang] * len(words)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.string())], names=["lang", "word"])

    rows = chosen.select("lang", "text").mapInArrow(run, "lang string, word string").groupBy("lang", "word").count().toArrow()
    counts: dict[str, dict[str, int]] = {}
    for lang, word, n in zip(*(rows.column(k).to_pylist() for k in range(3)), strict=True):
        counts.setdefault(lang, {})[word] = n
    return train(counts, pieces)


def identify(docs: DataFrame, languages: list[str], probs: np.ndarray, pieces: dict[str, int]) -> DataFrame:
    """(doc_id, lang_pred, score) of every document.

    The score is the language's posterior probability under equal priors. A
    null text, one without a letter, and every text of a model without a
    language get UNKNOWN and 0. Ties go to the first language in order of code
    points. Rows that repeat a doc_id, or have none, each get their row; texts
    and words of any length are read whole; an empty table gives no row. Other
    columns are ignored, whatever their names.
    """
    model = docs.sparkSession.sparkContext.broadcast((languages, probs, pieces))

    def run(batches):
        languages, probs, pieces = model.value
        at: dict[str, int] = {}
        scores = np.zeros((_CACHED_WORDS * 2, len(languages)))
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                if len(at) > _CACHED_WORDS:
                    at.clear()
                split = [words_of(t) for t in part.column(1).to_pylist()]
                new = list({w for words in split for w in words if w not in at})
                # Long words aren't held any longer than their documents.
                brief = [w for w in new if len(w) <= _CACHED_LETTERS]
                new = brief + [w for w in new if len(w) > _CACHED_LETTERS]
                if len(at) + len(new) > len(scores):
                    scores = np.concatenate([scores, np.zeros((len(at) + len(new), len(languages)))])
                if new and languages:
                    scores[len(at) : len(at) + len(new)] = forward(new, pieces, probs)
                at.update(zip(new, range(len(at), len(at) + len(new)), strict=True))
                names, sure = [], []
                for words in split:
                    if not languages or not any(c.isalpha() for w in words for c in w):
                        names.append(UNKNOWN)
                        sure.append(0.0)
                        continue
                    total = scores[np.fromiter(map(at.__getitem__, words), dtype=np.int64, count=len(words))].sum(0)
                    k = int(total.argmax())
                    names.append(languages[k])
                    sure.append(float(1 / np.exp(total - total[k]).sum()))
                for w in new[len(brief) :]:
                    del at[w]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(sure, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kept = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def op8(spark, sf_dir):
    docs, pieces = table(spark, sf_dir, "documents"), vocabulary()
    languages, probs = learn(docs.where(crc_mod(F.col("doc_id"), 5) != 0), pieces)
    found = identify(docs, languages, probs, pieces)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
