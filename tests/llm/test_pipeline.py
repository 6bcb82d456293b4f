"""The whole pipeline against brute force, on rows with null, repeated and clashing ids."""

import collections
import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from seqspark.llm import toxicity


def one_of_each(rows):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in ((t or "").lower().split() for _, t in rows)]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                lo, hi = sorted((group[a], group[b]))
                group = [lo if g == hi else g for g in group]
    members = collections.defaultdict(list)
    for i, g in enumerate(group):
        members[g].append(i)
    return [(key, members[g]) for g in members for key in [min((rows[i][0] is None, rows[i][0] or 0) for i in members[g])]]


def test_run(spark, tmp_path):
    rng = random.Random(3)
    fresh = lambda n: " ".join(f"r{rng.randrange(10**9)}" for _ in range(n))
    passage, copied, other, nulls = fresh(50), fresh(60), fresh(60), fresh(60)
    rows = [(None, fresh(30 + i)) for i in range(8)]  # unrelated, all without an id
    rows += [(7, fresh(40)), (7, fresh(41)), (7, copied), (8, copied + " x"), (7, other), (9, other + " y"), (None, other)]  # components with one least id
    rows += [(None, nulls), (None, nulls + " z"), (20, passage + " " + fresh(20)), (21, fresh(25) + " " + passage), (None, None), (30, ""), (30, " \n"), (31, fresh(10)), (31, fresh(11))]
    rows += [(40, "vile " * 3 + fresh(20)), *[rows[8]] * 2]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(20, 1, 0), (21, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    chain = toxicity.fitted(spark, str(tmp_path))
    scored = [(r.doc_id, r.text) for r in toxicity.score(docs, chain).collect() if r.p_toxic < 0.5]
    assert len(scored) == len(rows)  # no label is toxic
    groups = one_of_each(scored)
    stayed = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_each_group(spark, docs, str(tmp_path)).collect()]
    where = {scored[i]: g for g, (_, members) in enumerate(groups) for i in members}
    wordy = lambda t: bool((t or "").split())
    assert sorted(where[r] for r in stayed if wordy(r[1])) == [g for g, (_, m) in enumerate(groups) if wordy(scored[m[0]][1])]
    assert all((r[0] is None, r[0] or 0) == groups[where[r]][0] for r in stayed)
    assert sum(not wordy(t) for _, t in stayed) == 3

    words = [(t or "").split() for _, t in stayed]
    seen = collections.Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want, whole = [], Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for (key, text), w in zip(stayed, words):
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone) if gone else text or ""
        if kept or not gone:
            want.append((key, np.array([*whole.encode(kept, add_special_tokens=False).ids, 0], "<u4")))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == collections.Counter((k, len(x)) for k, x in want)
    for r in got:
        assert any(k == r.doc_id and len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for k, x in want)
    assert sum(r.length for r in got) == sum(len(x) for _, x in want)
