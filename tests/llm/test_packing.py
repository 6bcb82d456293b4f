"""Packing of very many sources against the loop of deficits, and targets of small and null sources."""

import collections
import random

import public_tokenizers as P
from pyspark.sql import functions as F

from seqspark.llm import packing


def streamed(spark, rows, **more):
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), P.path("byte_bpe_50k.json"), **more).collect()
    got.sort(key=lambda r: (r.sequence_id, r.offset))
    return got


def test_many_sources_match_loop(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(20, 40))), f"s{i % 1500}") for i in range(2600)]
    rows += [(i, "one two three four " * 60, "large") for i in range(2600, 2700)]
    source = {i: s for i, _, s in rows}
    got = streamed(spark, rows)
    at, done = 0, collections.Counter()
    for r in got:
        assert r.sequence_id * 1024 + r.offset == at and r.start == done[r.doc_id]
        at += r.length
        done[r.doc_id] += r.length
    assert done == {r.doc_id: r.doc_tokens for r in got} and len(done) == len(rows)
    total = collections.Counter()
    for r in got:
        total[source[r.doc_id]] += r.length
    names = spark.createDataFrame([(s,) for s in total], "s string").select("s", (F.pmod(F.xxhash64(F.concat(F.lit("="), "s")), F.lit(1 << 20)) + 1).alias("h"))
    phase = {r.s: r.h / (1 << 20) for r in names.collect()}
    quantum = {s: 1024 * n / at for s, n in total.items()}
    deficit = {s: 1 - phase[s] if quantum[s] < 1 else 0.0 for s in total}
    sent, want = collections.Counter(), []
    turns = sorted(total, key=lambda s: (-total[s], "=" + s))
    while len(want) < at:
        for s in turns:
            deficit[s] += quantum[s]
            n = min(int(deficit[s]), total[s] - sent[s])
            deficit[s] -= int(deficit[s])
            sent[s] += n
            want += [s] * n
    assert [source[r.doc_id] for r in got for _ in range(r.length)] == want


def test_targets_of_small_and_null_sources(spark):
    rows = [(i, "one two three four " * 60, ("a", None)[i % 2]) for i in range(600)] + [(1000 + i, "five six", "tiny") for i in range(40)]  # 120 tokens: below 1 of 1,024
    source = {i: s for i, _, s in rows}
    got = streamed(spark, rows, targets={"a": 0.25, None: 0.65, "tiny": 0.1})
    first = collections.Counter()
    for r in got:
        if not r.sequence_id:
            first[source[r.doc_id]] += r.length
    assert abs(first["a"] - 256) <= 1 and abs(first["tiny"] - 102) <= 1 and abs(first[None] - 665) <= 1
