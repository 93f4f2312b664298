"""Toxicity by weak supervision.

Many voters (public insult lexicons, style patterns, and word and stem patterns
mined from labelled rows) vote for or abstain. A generative label model, fitted
by expectation maximisation on labelled and unlabelled rows, estimates each
voter's rates on toxic and clean texts and how voters correlate within both; a
row's label, where it has one, is one more voter, whose error rates are
estimated with the others'. A linear classifier is trained on the posteriors.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, table
from .labelled import labelled_sample, unlabelled_sample

#: Labelled and unlabelled rows used for fitting, in expectation; all if there are fewer.
TRAIN_ROWS, UNLABELLED_ROWS = 12_000, 6_000
#: Mined patterns: at most so many, each in at least so many fitting rows; lengths of stems.
MINED, SUPPORT, STEMS = 400, 4, (4, 5, 6, 7)
#: Labels are taken to be wrong this often, as if that many rows of each class had been seen before.
GOLD_ERROR, GOLD_PRIOR = 0.02, 200.0
#: The marks no row of the label column has: unlabelled.
UNLABELLED = -1
#: Everyday insults of four languages, each list a voter of its own.
LEXICONS = {
    "intellect": "idiot idiots moron morons stupid dumb fool imbecile cretin dunce dimwit",
    "worth": "worthless pathetic useless loser losers trash garbage scum filth vermin",
    "disgust": "disgusting vile revolting repulsive gross sickening",
    "mockery": "clown clowns joke laughable ridiculous buffoon",
    "german": "dumm dummkopf blöd trottel depp versager abschaum widerlich arschloch",
    "french": "stupide imbécile connard ordure minable abruti débile crétin salaud",
    "spanish": "estúpido idiota imbécil basura inútil asqueroso payaso tonto escoria",
}
_LEXICON = {w: k for k, words in enumerate(LEXICONS.values()) for w in words.split()}
_WORD = re.compile(r"[^\W\d_]+")
_STYLE = 3
#: Shouting: 40 words in a row that have two or more letters and no lower-case one.
_SHOUT = re.compile(r"(?:\b[^\W\d_a-zß-öø-ÿ]{2,}\b[\W\d_]+){40}")
_ADDRESSED = re.compile(r"\b(?:you|your|du|ihr|tu|toi|vous|tú|usted)\s+(?:\w+\s+){0,2}(?:" + "|".join(sorted(_LEXICON)) + r")\b")


def patterns(text: str) -> set[str]:
    """The different words of a text and their stems, the latter with a star."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def votes(text: str | None, mined: dict[str, int]) -> np.ndarray:
    """1 for each voter that fires: lexicons, styles, mined patterns."""
    text = text or ""
    low = text.lower()
    words = set(_WORD.findall(low))
    base = len(LEXICONS)
    out = np.zeros(base + _STYLE + len(mined), dtype=np.uint8)
    hits = words & _LEXICON.keys()
    for w in hits:
        out[_LEXICON[w]] = 1
    out[base] = any(m.group().isupper() for m in _SHOUT.finditer(text))
    out[base + 1] = text.count("!") * 20 > len(words) > 0
    out[base + 2] = bool(hits and _ADDRESSED.search(low))
    if mined:
        for w in words:
            k = mined.get(w)
            if k is not None:
                out[base + _STYLE + k] = 1
            for n in STEMS:
                if len(w) > n:
                    k = mined.get(w[:n] + "*")
                    if k is not None:
                        out[base + _STYLE + k] = 1
    return out


def label_model(fired: np.ndarray, gold: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[float, float]]:
    """Posterior of each row, each voter's rates on toxic and clean rows, and the labels' rates (of 1 on both).

    Voters are Bernoulli given the hidden class. A voter's log ratio is divided
    by one plus its correlations with the other voters within the
    classes, so that copies of one voter count about once. ``gold`` is 0, 1 or
    UNLABELLED; the labels' rates have a prior of GOLD_PRIOR rows.
    """
    v = fired.astype(float)
    known, marked = gold != UNLABELLED, gold == 1
    share_toxic = marked.sum() / max(known.sum(), 1)
    post = np.where(marked, 1 - GOLD_ERROR, np.where(known, GOLD_ERROR, share_toxic))
    truth = (1 - GOLD_ERROR, GOLD_ERROR)
    for _ in range(rounds):
        mass = np.array([post.sum(), (1 - post).sum()])
        on = np.clip((post @ v + 0.05) / (mass[0] + 1), 1e-6, 1 - 1e-6)
        off = np.clip(((1 - post) @ v + 0.05) / (mass[1] + 1), 1e-6, 1 - 1e-6)
        truth = tuple((w[marked].sum() + GOLD_PRIOR * prior) / (w[known].sum() + GOLD_PRIOR) for w, prior in ((post, 1 - GOLD_ERROR), (1 - post, GOLD_ERROR)))
        spread = np.zeros((v.shape[1],) * 2)
        for w, mean in ((post, on), (1 - post, off)):
            z = (v - mean) * np.sqrt(w / max(w.sum(), 1e-9))[:, None]
            cov = z.T @ z
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            spread += np.maximum(cov / np.outer(sd, sd), 0) / 2
        np.fill_diagonal(spread, 0)
        share = 1 / (1 + np.where(spread > 0.1, spread, 0).sum(0))
        prior = np.clip(mass[0] / mass.sum(), 1e-4, 1 - 1e-4)
        told = np.where(marked, np.log(truth[0] / truth[1]), np.where(known, np.log((1 - truth[0]) / (1 - truth[1])), 0.0))
        logit = np.log(prior / (1 - prior)) + told + v @ (np.log(on / off) * share) + (1 - v) @ (np.log((1 - on) / (1 - off)) * share)
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        done = np.abs(new - post).max() < 1e-4
        post = new
        if done:
            break
    return post, on, off, truth


def linear_classifier(x: np.ndarray, target: np.ndarray, weight: np.ndarray | None = None, ridge: float = 0.05, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets of weighted rows, by accelerated gradient steps."""
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    weight = np.ones(len(x)) if weight is None else weight
    step = 1 / (0.25 * np.linalg.norm(x * np.sqrt(weight)[:, None], 2) ** 2 + ridge)
    w = np.zeros(x.shape[1])
    w[-1] = -3.0
    at, t = w.copy(), 1.0
    penalty = np.append(np.full(x.shape[1] - 1, ridge), 0)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        new = at - step * (x.T @ (weight * (p - target)) + penalty * at)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        at = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return w[:-1], float(w[-1])


def mine(sample: DataFrame) -> dict[str, int]:
    """The patterns most tied to toxic fitting rows, numbered."""

    def run(batches):
        for batch in batches:
            found = [(p, y) for text, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True) for p in patterns(text)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([y for _, y in found], pa.int64())], names=["pattern", "toxic"])

    n, n1 = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < n1 < n:
        return {}
    counts = sample.select("text", "label").mapInArrow(run, "pattern string, toxic bigint").groupBy("pattern").agg(F.sum("toxic").alias("k"), F.count(F.lit(1)).alias("n"))
    lift = (F.col("k") / float(n1)) / ((F.col("n") - F.col("k") + 0.5) / float(n - n1))
    rank = F.col("k") * F.log(lift)
    best = counts.where((F.col("n") >= SUPPORT) & (F.col("k") >= SUPPORT) & (lift > 8)).orderBy(rank.desc(), "pattern").limit(MINED)
    return {r[0]: k for k, r in enumerate(best.select("pattern").collect())}


def fit(sample: DataFrame, unlabelled: DataFrame | None = None) -> tuple[dict[str, int], np.ndarray, float]:
    """The mined patterns and the classifier's weights, from (doc_id, text, label) and (doc_id, text)."""
    mined = mine(sample)

    def run(batches):
        for batch in batches:
            rows = [votes(t, mined).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column("label")], names=["v", "label"])

    rows = sample.select("text", "label")
    if unlabelled is not None:
        rows = rows.union(unlabelled.select("text", F.lit(UNLABELLED).alias("label")))
    got = rows.mapInArrow(run, "v binary, label int").toArrow()
    size = len(LEXICONS) + _STYLE + len(mined)
    fired = np.frombuffer(b"".join(got.column("v").to_pylist()), dtype=np.uint8).reshape(-1, size)
    gold = got.column("label").to_numpy().astype(int)
    if not (gold == 1).any() or not (gold == 0).any():
        # Nothing to learn from: each lexicon counts the same.
        w = np.zeros(size)
        w[: len(LEXICONS)] = 4.0
        return mined, w, -3.0
    # Rows come in any order; sums of them should not depend on it.
    by = np.lexsort((*np.packbits(fired, axis=1).T, gold))
    fired, gold = fired[by], gold[by]
    post = label_model(fired, gold)[0]
    # Rows that only voters tell about count as far as the posterior is sure.
    return mined, *linear_classifier(fired, post, np.where(gold == UNLABELLED, np.abs(2 * post - 1) ** 4, 1.0))


def score(docs: DataFrame, mined: dict[str, int], weights: np.ndarray, bias: float) -> DataFrame:
    """(doc_id, score) of every document.

    Null and empty texts have the score of no vote; equal texts have equal
    scores, also in rows that repeat a doc_id or have none. Texts of any length
    are read whole; an empty table gives no row. Other columns are ignored,
    whatever their names.
    """
    model = docs.sparkSession.sparkContext.broadcast((mined, weights, bias))

    def run(batches):
        mined, weights, bias = model.value
        for batch in batches:
            z = np.array([float(votes(t, mined) @ weights) for t in batch.column(1).to_pylist()]) + bias
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], names=["doc_id", "score"])

    kept = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id bigint, score double")


def op2(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    usable = crc_mod(F.col("doc_id"), 5) != 0
    sample = labelled_sample(docs, labels, "toxic", usable, TRAIN_ROWS)
    found = score(docs, *fit(sample, unlabelled_sample(docs, labels, "toxic", usable, UNLABELLED_ROWS)))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
