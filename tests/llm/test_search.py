"""Ranked lexical search against a plain score of every document."""

import collections
import math
import random
import re

import numpy as np
import pytest

from seqspark.llm import search


def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))


def ranked(docs, items, k):
    held = [(i, collections.Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    total, length, df = len(held), sum(sum(c.values()) for _, c in held), collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * total // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            found += [(score, i)] if score > 0 else []
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, rank, i, score) for rank, (score, i) in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("k,shard,block,at_once", [(20, 8192, 128, 1 << 18), (5, 40, 4, 60), (1, 7, 1, 1), (3, 500, 16, 300)])
def test_search(spark, monkeypatch, k, shard, block, at_once):
    rnd = random.Random(k)
    monkeypatch.setattr(search, "SHARD", shard)
    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "_PIECE", 50)
    pool = ["".join(rnd.choice("abcé漢́Z09") for _ in range(rnd.randint(1, 5))) for _ in range(150)]
    word = lambda: pool[min(int(rnd.expovariate(0.05)), 149)]
    text = lambda n: "".join(word() + rnd.choice([" ", "\n", "_", "'", "\0", "\x7f", " "]) for _ in range(n))
    docs = [(i * 3 % 1009, text(rnd.choice([0, 1, 5, 40, 200]))) for i in range(300)] + [(None, None), (None, text(30)), (5, ""), (6, " -- "), (7, "thé " * 3000)]
    docs += docs[20:60] + [(i, docs[3][1] or "a") for i in range(2000, 2040)]
    items = [(i, text(rnd.choice([1, 8, 30]))) for i in range(25)] + [(None, text(4)), (3, text(2)), (98, None), (99, "..."), (100, "unheardof"), (101, "thé THé thé"), (3, "É é")]
    items += items[:2]
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id long, text string, item_id string, q int, n int").repartition(3)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = search.search(df, asked, k=k, block_terms=at_once).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=repr) == ranked(docs, items, k)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a c")], "item_id long, text string")
    assert search.search(docs.limit(0), items).count() == 0 and search.search(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in search.search(docs, items).collect()] == [(1, 1, 1, 287 * (10**9 // (1000 + 12 * 100)))]


def test_blocks_are_rejected_unread(monkeypatch):
    """Lists whose bounds can't reach the threshold are probed block by block, and most blocks stay compressed."""
    rnd, n = np.random.default_rng(4), 8000
    places, terms_, times = [], [], []
    for t, share in enumerate([0.9, 0.8, 0.7, 0.01, 0.005]):
        at = np.flatnonzero(rnd.random(n) < share)
        places, terms_, times = [*places, at], [*terms_, np.full(len(at), t)], [*times, rnd.integers(1, 4, len(at))]
    shard = search.Shard(rnd.integers(50, 400, n), *map(np.concatenate, (places, terms_, times)), n, 225 * n)
    weights = {0: 100, 1: 200, 2: 300, 3: 5000, 4: 6000}
    read, plain = [], search.Postings.read
    monkeypatch.setattr(search.Postings, "read", lambda self, b: read.append(b) or plain(self, b))
    found, score = shard.search(weights, 5, 1)
    whole = np.zeros(n, np.int64)
    for t, p in shard.lists.items():
        shard._add(whole, weights[t], p, range(len(p.blocks)))
    best = np.lexsort((np.arange(n), -whole))[:5]
    assert set(best) <= set(found) and (whole[found] == score).all()
    assert len(read) - sum(len(p.blocks) for p in shard.lists.values()) < 0.4 * sum(len(p.blocks) for p in shard.lists.values())
