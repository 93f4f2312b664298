"""Decontamination where items are long, or stand in a document more than once."""

import numpy as np
from pyspark.sql import functions as F

from lotwright.llm import decontaminate


def _words(rng, n, base="v"):
    return [f"{base}{k}" for k in rng.integers(0, 900, n)]


def test_long_items_are_found(spark):
    rng = np.random.default_rng(6)
    items = [_words(rng, n) for n in (30, 130, 400, 900, 2500)]
    docs, want = [], set()
    for k, item in enumerate(items):
        docs.append((10 * k, " ".join(_words(rng, 700, "o") + item + _words(rng, 333, "o"))))
        docs.append((10 * k + 1, " ".join(item)))
        docs.append((10 * k + 2, " ".join(_words(rng, 50, "o") + [w for j, w in enumerate(item) if j % 9 != 4])))
        want |= {(10 * k + j, k) for j in range(3)}
    docs += [(100 + k, " ".join(_words(rng, 3000, "o" if k % 2 else "v"))) for k in range(20)]
    found = decontaminate.contaminated(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id bigint, text string")
    )
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want
    long = found.sparkSession.createDataFrame([(4, " ".join(items[4]))], "item_id bigint, text string")
    assert {r.doc_id for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), long).collect()} == {40, 41, 42}


def test_decoys_hide_no_passage(spark):
    rng = np.random.default_rng(8)
    items = [_words(rng, 36) for _ in range(12)]
    docs = []
    for k, item in enumerate(items):
        # Its words backwards fill whole blocks; the passage itself straddles others, amid its neighbours' words.
        decoy = item[::-1] * 2
        other = [w for x in items[:3] for w in x[::-1]]
        docs.append((k, " ".join(_words(rng, 240, "o") + decoy + _words(rng, 245, "o") + other[:7] + item + other[7:20] + _words(rng, 200, "o"))))
        docs.append((100 + k, " ".join(_words(rng, 240, "o") + decoy + _words(rng, 200, "o"))))
    found = decontaminate.contaminated(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id bigint, text string")
    )
    rows = found.collect()
    assert {(k, k) for k in range(len(items))} <= {(r.doc_id, r.item_id) for r in rows}
    assert all(r.doc_id < 100 for r in rows) and all(r.common > 0.99 for r in rows if r.doc_id == r.item_id)


def _paraphrase(rng, words):
    """Every seventh word by a new one, every ninth pair swapped, a word put in after every tenth."""
    out = [f"syn{rng.integers(1 << 30)}" if k % 7 == 3 else w for k, w in enumerate(words)]
    for k in range(4, len(out) - 7, 9):
        out[k], out[k + 1] = out[k + 1], out[k]
    for k in range(len(out) - 8, 0, -10):
        out.insert(k, f"put{rng.integers(1 << 30)}")
    return out


def test_paraphrases_are_found(spark):
    rng = np.random.default_rng(10)
    items = [_words(rng, int(n)) for n in rng.integers(16, 120, 60)]
    docs = [(k, " ".join(_words(rng, int(rng.integers(0, 400)), "o") + _words(rng, 30) + _paraphrase(rng, x) + _words(rng, 200))) for k, x in enumerate(items)]
    docs += [(1000 + k, " ".join(_words(rng, 600))) for k in range(200)]
    found = decontaminate.contaminated(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id bigint, text string")
    )
    hits = {(r.doc_id, r.item_id) for r in found.collect()}
    want = {(k, k) for k in range(len(items))}
    assert len(hits & want) >= 0.9 * len(want) and len(hits - want) <= 1


def test_verbatim_items_of_all_lengths(spark):
    rng = np.random.default_rng(12)
    items = [_words(rng, n) for n in (8, 14, 24, 25, 26, 48, 60, 73, 74, 96, 150, 300, 600, 2000)]
    docs = [(100 * k + at, " ".join(_words(rng, at, "o") + x + _words(rng, 150, "o"))) for k, x in enumerate(items) for at in (0, 7, 13, 23, 24)]
    found = decontaminate.contaminated(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id bigint, text string")
    )
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(d, d // 100) for d, _ in docs}


def test_rows_go_by_their_own_text(spark):
    rng = np.random.default_rng(14)
    item = " ".join(_words(rng, 40))
    rows = [(None, item, "x"), (None, "clean text without an id", "y"), (3, item + " more", "x"), (3, "a clean text of the same id", "z"), (3, "a clean text of the same id", "z"), (4, None, "n"), (5, "", "n")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, bad_id string")
    kept = decontaminate.without_contaminated(docs, spark.createDataFrame([(1, item), (2, None), (None, "")], "item_id bigint, text string"))
    assert kept.columns == docs.columns and sorted(map(str, (r.bad_id for r in kept.collect()))) == ["n", "n", "y", "z", "z"]


def test_the_space_is_that_of_all_blocks(spark):
    """Of more documents than a sample of 200,000 blocks would take: the exact directions of all blocks and the items."""
    rng = np.random.default_rng(12)
    docs, terms = rng.integers(0, 12, (700, 10 * decontaminate.BLOCK)).astype("<u4"), 12
    # A few documents alone hold a direction of much energy.
    docs[5:8] = 7
    rows = spark.createDataFrame([(k, k, bytearray(d.tobytes())) for k, d in enumerate(docs)], "doc_id bigint, tie bigint, ids binary").repartition(6)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(40)))).drop("copy")
    weight = np.concatenate([[0.0], rng.uniform(0.5, 2, terms - 1)])
    items = [np.array([3, 4, 4]), np.array([9])]
    space = decontaminate.latent_space(rows, weight, items, dimensions=5)
    blocks = np.array([np.bincount(b, minlength=terms) * weight for d in docs for b in d.reshape(-1, decontaminate.BLOCK)])
    own = np.array([np.bincount(x, minlength=terms) * weight for x in items])
    energy = sum((weight[b] ** 2).sum() for b in docs)
    g = 40 * blocks.T @ blocks + own.T @ own * 40 * energy / sum((weight[x] ** 2).sum() for x in items)
    want = np.linalg.eigh(g)[1][:, -5:]
    assert np.abs(space @ space.T - want @ want.T).max() < 1e-4
