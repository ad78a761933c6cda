"""Cases in which a bound or a cut once lost part of the result."""

import os
import random

import numpy as np

from wavelattice.llm import lm_score, ngram_join, toxicity

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_near_duplicates_with_insertions_and_truncations(spark):
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.getrandbits(60):x}" for _ in range(n)]
    texts = []
    for k in range(60):
        base = fresh(89 + k % 3)
        at, extra = rng.randrange(len(base)), fresh(8 + k % 13)
        texts += [base, [base + extra, extra + base, base[:at] + extra + base[at:], base[: -8 - k % 13]][k % 4]]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if 100 * both >= ngram_join.PERCENT * (len(sets[a]) + len(sets[b]) - both):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    assert 20 < len(texts) - len(set(root)) < 60
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()} == dict(enumerate(root))


def test_candidates_whose_shingles_have_different_majors(spark):
    # token, node, comp, n, cap, matches, rank: node 3 makes the component of node 1 the major of three of four shared shingles
    rows = [(t, 1, 1, 100, 100, 1, 12 + t) for t in range(4)]
    rows += [(t, 2, 2, 90, 90, 1, 2 + t) for t in range(4)]
    rows += [(t, 3, 1, 100, 100, 1, 50) for t in range(1, 4)]
    rows = spark.createDataFrame(rows, "token long, node long, comp long, n int, cap int, matches int, rank int")
    assert [tuple(r) for r in ngram_join._candidates(rows).collect()] == [(1, 2)]


def test_lm_scores_do_not_depend_on_pieces_and_buckets(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    good = spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1").select("doc_id")
    usual, small = (sorted(tuple(r) for r in lm_score.cross_entropy_difference(docs, good, piece=piece, bucket_keys=keys).collect()) for piece, keys in ((lm_score.PIECE, lm_score.BUCKET_KEYS), (3000, 500)))
    assert len(usual) > 100 and np.allclose(usual, small)


def test_long_documents_do_not_end_the_training_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_CLASS_BYTES", 2000)
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id long, toxic int")

    def sample(long):
        docs = spark.createDataFrame([(k, f"word{k} some text" + " x" * (2000 if long(k) else 0)) for k in range(80)], "doc_id long, text string")
        return toxicity.training_rows(docs, labels, "doc_id", "text", "toxic")

    every = sample(lambda k: False)[0]
    some = sample(lambda k: k % 10 == 0)[0]
    assert len(every) > 50 and max(map(len, some)) < 100 and set(some) >= {t for t in every if int(t.split()[0][4:]) % 10}
    texts, y, share = sample(lambda k: k % 2 == 0)
    assert (y == 0).sum() >= 2 and (y == 1).sum() > 20 and toxicity.fit(texts, y, share).weights.any()
