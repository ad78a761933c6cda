"""Phrase and proximity matches against brute force on random texts."""

import random
from collections import Counter

import pytest

from wavelattice.llm import decontam


def brute(docs, items, window=decontam.WINDOW):
    """n_hit, items and near items of each document."""
    count = Counter(w for d in docs for w in d)
    out = []
    for d in docs:
        hit, found, near = set(), set(), set()
        for k, item in enumerate(items):
            n = min(window, len(item))
            for i in range(len(item) - n + 1) if n else ():
                for s in range(len(d) - n + 1):
                    if d[s : s + n] == item[i : i + n]:
                        hit |= set(range(s, s + n))
                        found.add(str(k))
            distinct = list(dict.fromkeys(item))
            keys = sorted((w for w in distinct if count[w]), key=lambda w: (count[w], item.index(w)))[: decontam.NEAR_TERMS]
            if keys and len(keys) == min(len(distinct), decontam.NEAR_TERMS) and any(set(keys) <= set(d[s : s + decontam.NEAR_SPAN]) for s in range(len(d))):
                near.add(str(k))
        out.append((len(hit), sorted(found), sorted(near)))
    return out


def rows(seed):
    rng = random.Random(seed)
    vocab = [f"v{k}" for k in range(60)]
    word = lambda: vocab[min(int(rng.expovariate(0.08)), 59)]
    items = [[word() for _ in range(rng.choice((0, 1, 2, 3, 9, 10, 14, 30)))] for _ in range(25)] + [["unheard", "of"], ["v1", "unheard", "v2", "v3"]]
    docs = []
    for _ in range(60):
        d = [word() for _ in range(rng.choice((0, 1, 5, 40, 200)))]
        if rng.random() < 0.4:
            item = rng.choice(items)
            at = rng.randrange(len(item) + 1)
            d[at:at] = item[rng.randrange(len(item) + 1) :]
        docs.append(d)
    return docs, items


@pytest.mark.parametrize("seed", range(3))
def test_matches_are_those_of_brute_force(spark, monkeypatch, seed):
    docs, items = rows(seed)
    monkeypatch.setattr(decontam, "INDEX_BLOCK", 700)
    monkeypatch.setattr(decontam, "CANDIDATES", 50)
    table = spark.createDataFrame([(k, ", ".join(d).upper()) for k, d in enumerate(docs)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    want = brute(docs, items)
    assert sum(bool(f) for _, f, _ in want) > 10 and sum(bool(n) for _, _, n in want) > 10
    for size in (decontam.MAX_BENCHMARK_BYTES, 300):
        matches = {r.doc_id: r for r in decontam.benchmark_matches(table, bench, max_bytes=size).collect()}
        assert [(list(matches[k]["items"]), matches[k].near) for k in range(len(docs))] == [(f, n) for _, f, n in want]
    got = {r.doc_id: r for r in decontam.decontaminate(table, bench).collect()}
    assert [(got[k].n_words, got[k].n_hit, got[k].n_items, got[k].n_near_items) for k in range(len(docs))] == [(len(d), h, len(f), len(n)) for d, (h, f, n) in zip(docs, want, strict=True)]


def test_one_index_serves_any_benchmark(spark):
    docs = spark.createDataFrame([(0, "t1 " + "x " * 5 + "base " + "y " * 6 + "t1 t2"), (1, "t1"), (2, "t2 base z t1")], "doc_id long, text string")
    index = decontam.build_index(docs, "doc_id", "text")
    for text, want in (("base t1 t2", [0, 2]), ("y y y y y", [0]), ("z t1", [2])):
        items = decontam.read_items([("a", text)])
        assert sorted(r.id for r in decontam.search(index, items, 10).collect() if r.near) == want
