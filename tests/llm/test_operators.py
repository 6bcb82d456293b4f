"""The operators for training text against brute force, round trips and the public tokenizers, on small
tables with nulls, empty texts, repeated rows and extra columns."""

import collections
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seqspark.llm import bpe, components, hashing, jaccard, packing, pages, sharding, simple8b, substrings, tokens, toxicity, vectors

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, ids string, key string"


def table(spark, texts):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, None, 1, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeé ß") for _ in range(rnd.randint(1, 7))).strip() or "x"
    passage = [word() for _ in range(60)]
    long = [" ".join(word() for _ in range(rnd.randint(40, 120))) for _ in range(12)]
    shared = [" ".join([*(word() for _ in range(20)), *passage, *(word() for _ in range(k))]) for k in (0, 5, 30)]
    return [None, "", " \t\n", "one", "It's 12 <|endoftext|> DON'T\n\n  ok", *long, *shared, *shared[:1], long[0], long[1] + " tail", long[0].upper(), "a " * 300, "word " * 3000]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_byte_bpe(spark, texts):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    got = bpe.decode(bpe.encode(table(spark, texts), path, P.PATTERN), path).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == want.encode_ordinary(t) and bytes(r.decoded) == t.encode()
    assert bpe.encode(table(spark, []), path, P.PATTERN).count() == 0


def test_byte_bpe_of_long_runs_pieces_and_other_patterns(spark, monkeypatch):
    import tiktoken

    path, rnd = P.path("byte_bpe_multi_50k.tiktoken"), random.Random(2)
    ranks = bpe.load_ranks(path)
    some = ["".join(rnd.choice("abcdefghij") for _ in range(100_000)), "ab" * 40_000, "é" * 3000, "a  b \n \n c\0d \0 e", None, "x y " * 500]
    some += [" ".join(b.decode(errors="ignore") for b in rnd.sample(list(ranks), 3000)) for _ in range(4)]
    monkeypatch.setattr(bpe, "KEPT_WORDS", 400)  # words are numbered anew between texts
    monkeypatch.setattr(hashing, "_SOME", 1)
    for pattern in (P.PATTERN, r"\p{L}+|[^\p{L}]"):
        want = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for r in bpe.encode(table(spark, some), path, pattern, decoded=True).collect():
            assert np.frombuffer(r.ids, "<u4").tolist() == want.encode_ordinary(some[r.doc_id] or "") and bytes(r.decoded) == (some[r.doc_id] or "").encode()


def test_encoders(texts):
    rnd = random.Random(1)
    parts = [*" \n\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\0\u00a0\u2009\u3000\u200b'aZé\u0301ΣςİßﬁÅ1½²٣漢!?…🙂", "'s", "'re", "ll", "e\u0301", "<|end", "of", "text|>", "<|endoftext|>", " and"]
    odd = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(5000)]
    for make, name in ((tokens.ByteEncoder, "byte_bpe_50k.json"), (tokens.WordEncoder, "word_bpe_49k.json")):
        own, whole = make(P.path(name)), Tokenizer.from_file(P.path(name))
        pieces = [whole.decode([i]) for i in range(0, whole.get_vocab_size(), 3)]  # and all of them, in runs of some ids
        some = [*filter(None, texts), *odd, *pieces, *(whole.decode(list(range(i, i + 8))) for i in range(0, whole.get_vocab_size() - 8, 8)), ""]
        for got in (own.ids(pa.array([*some, None])), own.ids(pa.array([*some, None]))):  # unknown and remembered runs
            assert got[-1] == b""
            for t, x, want in zip(some, got, whole.encode_batch(some, add_special_tokens=False)):
                assert np.frombuffer(x, own.kind).tolist() == want.ids, repr(t)


def test_packing(spark, texts):
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {i: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in enumerate(texts)}
    got = packing.pack(table(spark, texts), P.path("byte_bpe_50k.json")).collect()
    at = 0
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.sequence_id * 1024 + r.offset == at and r.offset + r.length <= 1024
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        at += r.length
    assert at == sum(map(len, ids.values()))
    assert packing.pack(table(spark, []), P.path("byte_bpe_50k.json")).count() == 0


def test_round_robin_matches_loop():
    totals = [5000, 300, 41, 7]
    q = packing.quanta(totals)
    want, sent, deficit = [], [0] * 4, [0] * 4
    while sent != totals:
        for s in range(4):
            deficit[s] += q[s]
            n = min(deficit[s] >> 18, totals[s] - sent[s])
            deficit[s] -= (deficit[s] >> 18) << 18
            want += [(s, sent[s] + k) for k in range(n)]
            sent[s] += n
    queue, place = np.array(want).T
    assert packing.stream_places(queue, place, np.array(totals), np.array(q)).tolist() == list(range(len(want)))


def test_simple8b(spark, texts):
    rnd = np.random.default_rng(1)
    for k in range(100):
        v = rnd.integers(0, 2**63, rnd.integers(0, 200), dtype=np.uint64) * np.uint64(2) >> rnd.integers(0, 64, 1).astype(np.uint64)
        w, e = simple8b.pack_words(v)
        assert (simple8b.unpack_words(w, np.array([0]), np.array([len(v)]), e, np.array([0])) == v).all()
    whole, start = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    got = {r.doc_id: r for r in simple8b.read_ids(simple8b.write_ids(table(spark, texts), P.path("word_bpe_49k.json"), block_ids=100)).collect()}
    for i, t in enumerate(texts):
        want = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        assert got[i].start == start and np.frombuffer(got[i].ids, "<u4").tolist() == want
        start += len(want)


def test_sharding(spark, texts):
    for bits, dims in ((3, 2), (2, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        h = sharding.hilbert_index(grid, bits)
        assert sorted(h) == list(range(len(grid))) and (np.abs(np.diff(grid[np.argsort(h)], axis=0)).sum(axis=1) == 1).all()
    rows = sharding.shards(table(spark, texts)).collect()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.size == len((texts[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode())
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    ends = [(min(x), max(x)) for x in ([r.curve_index for r in rows if r.shard == k] for k in range(8))]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
    assert sharding.shards(table(spark, [])).count() == 0


def test_substrings(spark, texts):
    count = collections.Counter(tuple(w[i : i + 35]) for w in map(words, texts) for i in range(len(w) - 34))
    got = {r.doc_id: r for r in substrings.remove_repeats(table(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = words(t)
        keep = [True] * len(w)
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                keep[k : k + 35] = [False] * 35
        assert got[i].n_words == len(w) and got[i].n_removed == len(w) - sum(keep) and got[i].kept == " ".join(x for x, y in zip(w, keep) if y)


def test_jaccard(spark, texts):
    sets = []
    for t in texts:
        w = words((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set()))
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                lo, hi = sorted((group[a], group[b]))
                group = [lo if g == hi else g for g in group]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(table(spark, texts)).collect()}
    assert got == {i: (len(sets[i]), group[i]) for i in range(len(texts))}


def test_overlap_bound():
    rnd = np.random.default_rng(2)
    for _ in range(200):
        both, a, b = (rnd.integers(0, 2**63, rnd.integers(1, 300), dtype=np.uint64) for _ in range(3))
        x, y = np.unique(np.concatenate([both, a])), np.unique(np.concatenate([both, b]))
        assert jaccard.overlap_bound(jaccard.signature(x), jaccard.signature(y), len(x), len(y)) >= len(np.intersect1d(x, y))


def test_components(spark):
    rnd = random.Random(0)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(130)]
    group = list(range(200))
    for a, b in edges:
        lo, hi = sorted((group[a], group[b]))
        group = [lo if g == hi else g for g in group]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {x: group[x] for e in edges if e[0] != e[1] for x in e}


def test_window_hashes():
    h = np.random.default_rng(0).integers(0, 2**63, 60, dtype=np.uint64)
    for size in (1, 2, 3, 12, 35):
        want = [sum(int(x) * pow(hashing.WINDOW_BASE, size - 1 - j, 2**64) for j, x in enumerate(h[i : i + size])) % 2**64 for i in range(61 - size)]
        assert (hashing.window_hashes(h, size) == hashing.mix(np.array(want, np.uint64))).all()


def test_vectors(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, rnd.normal(size=16).tolist()) for i in range(400)]
    rows += [(1000, None), (1001, [None] * 16), (1002, [float("nan")] * 16), (1050, rows[50][1]), (1051, rows[50][1]), (1052, [0.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1))
    ok = [(i, np.array(v)) for i, v in rows if v and all(x is not None and x == x for x in v)]
    ids, m = np.array([i for i, _ in ok]), np.stack([v for _, v in ok])
    scores = np.floor(256 * m) @ np.floor(256 * m).T
    got = collections.defaultdict(list)
    for r in sorted(vectors.exact_top_k(df).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score))
    for a in np.flatnonzero(ids % 50 == 0):
        order = [b for b in np.lexsort((ids, -scores[a])) if b != a][:5]
        assert got[ids[a]] == [(ids[b], scores[a][b]) for b in order]
    live, hits = ids != 1052, 0
    near = collections.defaultdict(list)
    for r in vectors.nearest(df, share=0.2).collect():
        near[r.query_id].append(r.vec_id)
    for a in np.flatnonzero((ids % 100 == 0) & live):
        d = np.linalg.norm(m - m[a], axis=1)
        hits += len(set(near[ids[a]]) & {ids[b] for b in [b for b in np.lexsort((ids, d)) if b != a and live[b]][:10]})
    assert hits >= 0.9 * 10 * sum((ids % 100 == 0) & live)


def test_pages(spark):
    page = lambda body: f"<html><head><title>t</title></head><body>{body}</body></html>"
    shell = "<div>Top of the site</div><div>{}</div><div>Contact us here</div>"
    rows = [
        (1, "http://a.example/x/1", page("<nav>n</nav><div class='ad'>ad</div><article><h1>T &amp; x</h1><p>a <b>b</b>\n c<p>d<script>1<2</script></article><footer>f</footer>")),
        (2, "http://b.example/x/1", page(shell.format("First page text, long enough to stay here"))),
        (3, "http://b.example/x/2", page(shell.format("Second page text, quite another story told"))),
        (4, None, None),
        (5, "http://c.example/", ""),
    ]
    got = {r.page_id: r.text for r in pages.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "T & x\na b c\nd", 2: "First page text, long enough to stay here", 3: "Second page text, quite another story told", 4: "", 5: ""}


def test_shared_lines():
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert len(pages.shared_lines(a, b)) == t[-1][-1] and pages._lengths(a, b).tolist() == t[-1]


def test_toxicity_held_out(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randint(3, 8)))
    made = []
    for i in range(600):
        w = [word() for _ in range(60)]
        toxic, low = i % 4 == 0, i % 7 == 0
        for _ in range(2 if toxic else 0):
            w[rnd.randrange(60)] = "vex" + rnd.choice(["ag", "um", "ore"])
        made.append((i, " ".join(x + "!!" for x in w) + (" zzgarble" if low else ""), int(not low), int(toxic)))
    df = spark.createDataFrame(made, "doc_id long, text string, quality int, toxic int")
    chain = toxicity.fit(df, df.filter("doc_id < 400"), {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}, features=64)
    got = toxicity.score(df.filter("doc_id >= 400"), chain).select(((F.col("p_toxic") >= 0.5) == (F.col("toxic") == 1)).alias("right")).collect()
    assert sum(r.right for r in got) >= 0.97 * len(got)
    assert toxicity.score(table(spark, [None, ""]), chain).count() == 2


def test_toxicity_of_odd_tables(spark, texts):
    """Repeated ids under one label, null and single labels, no labels, no documents, clashing names."""
    kinds = {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")
    score = lambda docs, chain: toxicity.score(docs, chain).collect()
    docs = spark.createDataFrame([(1, f"vexing words number {i}") for i in range(300)] + [(i, f"plain words number {i}") for i in range(2, 60)], "doc_id long, text string")
    given = labels([(1, 1, 1, "x"), *((i, 1, 0, "y") for i in range(2, 60)), (None, 1, 1, "z"), (3, None, 1, "z")])
    chain = toxicity.fit(docs, given, kinds, sample=40, features=16)
    got = {r.text: r.p_toxic for r in score(docs, chain)}
    assert all((p >= 0.5) == t.startswith("vexing") for t, p in got.items()) and len(got) == 358
    again = toxicity.fit(docs.repartition(7), given.repartition(3), kinds, sample=40, features=16)
    assert again.features == chain.features and all(np.allclose(a, b) for a, b in zip(again.weights, chain.weights))
    for some in ([], [(1, 1, 1, "x")], [(2, 1, 0, "x"), (3, 1, 0, "x")], [(10**9, 0, 1, "x")]):
        rows = score(table(spark, texts), toxicity.fit(docs, labels(some), kinds))
        assert len(rows) == len(texts) and all(0 <= r.p_toxic <= 1 for r in rows), some
    assert score(table(spark, []), chain) == [] and len(score(table(spark, texts), toxicity.fit(docs.filter("false"), given, kinds))) == len(texts)


def test_repeats_of_equal_rows_and_within_a_document(spark):
    """Equal texts in several rows, windows that repeat inside one text, null keys, nulls, short copies."""
    rng = random.Random(5)
    fresh = lambda n: " ".join(f"r{rng.randrange(10**9)}" for _ in range(n))
    line, short, alone = " ".join(f"w{i}" for i in range(50)), fresh(20), fresh(80)
    rows = [(1, None), (2, ""), (3, line), (3, line), (4, line + " " + fresh(10)), (5, "a b c " * 60), (6, "x y " * 100 + fresh(40)), (None, alone), (9, short), (10, short), (None, line)]
    words = [(text or "").split() for _, text in rows]
    seen = collections.Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = []
    for (key, _), w in zip(rows, words):
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want.append((key, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    out = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out), key=str) == sorted(want, key=str)


def test_numbers_of_words(monkeypatch):
    """In this process: words of one hash, and a memory that is emptied between texts."""
    ranks = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    words, ids = ["qzxj vk", "wqpzk", "zzqqj"], [[7, 8], [9], [1, 2, 3]]
    monkeypatch.setattr(bpe.xxhash, "xxh64_intdigest", lambda data: 5)
    monkeypatch.setattr(bpe, "KEPT_SETTLED", 1)
    folded = bpe.Folded(pa.array(words), pa.array(ids, pa.list_(pa.int32())))
    numbers = bpe._Numbers(P.PATTERN, ranks, folded)
    for some in (["zzqqj", "the", "xqxqzj"], ["wqpzk"], ["xqxqzj", "qqzzxk", "qzxj vk"], ["the", "y" * 600]):
        got = [np.frombuffer(x, np.int32).tolist() for x in numbers.numbers(some)]
        settled = dict(zip(words, ids)) | {"the": [ranks[b"the"]], "y" * 600: bpe.merge_long(b"y" * 600, ranks)}
        assert got == [[-1 - i for i in settled[w]] if w in settled else [numbers.fresh.index(w)] for w in some]
    assert numbers.fresh == ["xqxqzj", "qqzzxk"]


def test_substrings_keep_every_key(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [(None, passage), (-(2**62), passage), (0, passage), (None, passage), (0, "other"), (None, "other"), (5, None), (None, None)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed) for r in got), key=repr) == sorted(((i, n, n if n > 1 else 0) for i, t in rows if (n := len((t or "").split())) >= 0), key=repr)
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_files_in_curve_order_are_skipped_by_any_dimension(spark, tmp_path):
    import pyarrow.parquet as pq

    rnd = random.Random(3)
    rows = [(i, "x" * int(rnd.lognormvariate(6, 1)), rnd.choice(["de", "en", "es", "fr"]), f"source-{min(int(rnd.expovariate(0.1)), 39):02d}", None, 1, "a", "b") for i in range(8000)]
    rows += [(None, None, None, None, None, None, None, None), (1, "", "", "", 0, 0, "", "")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long"))
    sharding.write_in_curve_order(df, str(tmp_path / "out"), 16)
    files = [f for f in sorted((tmp_path / "out").glob("*.parquet")) if pq.read_metadata(f).num_rows]
    assert len(files) == 16 and spark.read.parquet(str(tmp_path / "out")).count() == len(rows)

    def met(column, lo, hi):
        n = 0
        for f in files:
            m = pq.read_metadata(f)
            at = [j for j in range(m.num_columns) if m.row_group(0).column(j).path_in_schema == column][0]
            n += any((s := m.row_group(g).column(at).statistics) is not None and s.has_min_max and s.min <= hi and s.max >= lo for g in range(m.num_row_groups))
        return n

    # About half of the files, or one more: rows are cut evenly, so runs reach a little over a cube's edges.
    sizes = sorted(len(r[1] or "") for r in rows)
    assert np.mean([met("lang", x, x) for x in ("de", "en", "es", "fr")]) <= 9
    assert np.mean([met("source", x, x) for x in (f"source-{i:02d}" for i in range(40))]) <= 9
    assert np.mean([met("n_chars", sizes[i * 800], sizes[i * 800 + 700]) for i in range(10)]) <= 9
    for bad in (spark.createDataFrame([], SCHEMA), df.limit(1).withColumn("lang", F.lit(None).cast("string"))):
        assert sharding.shards(bad).count() == bad.count()


def test_targets_are_above_zero(spark, texts):
    with pytest.raises(ValueError, match="above zero"):
        packing.pack(table(spark, texts), P.path("byte_bpe_50k.json"), targets={"s0": 0.0, "s1": 1.0})


def test_byte_bpe_sends_few_bytes_to_all_tasks(spark, monkeypatch):
    import tiktoken

    path, ranks = P.path("byte_bpe_multi_50k.tiktoken"), bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    some = [" ".join(f"{'漢字' * (k % 60)}{k}" for k in range(300))] * 6 + [None, ""]
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for most in (0, 3000):
        monkeypatch.setattr(bpe, "COMMON_BYTES", most)
        df = table(spark, some).repartition(6)
        for r in bpe.encode(df, path, P.PATTERN).collect():
            assert np.frombuffer(r.ids, "<u4").tolist() == want.encode_ordinary(some[r.doc_id] or "")


def test_pages_with_many_lines_to_delete(spark, monkeypatch):
    body = lambda i: f"<div>menu</div><div>news</div><p>text {i} of its own</p><div>foot line</div>"
    df = spark.createDataFrame([(i, f"http://h.org/{i:03d}", body(i)) for i in range(20)], "page_id long, url string, html string")
    got = []
    for few in (1 << 22, 0):
        monkeypatch.setattr(pages, "FEW", few)
        got.append(sorted(map(tuple, pages.main_texts(df).collect())))
    assert got[0] == got[1] and all(t == f"text {i} of its own" for i, _, t in got[0])


def test_bounds_of_cells_are_the_quantiles_of_all_rows(spark):
    rnd = random.Random(4)
    values = [None] * 300 + [7] * 2_000 + [rnd.randrange(10**6) for _ in range(7_000)]
    df = spark.createDataFrame([(v, str(v) if v else None) for v in values], "size long, name string").repartition(5)
    for column in ("size", "name"):
        order = sorted((r[column] for r in df.collect()), key=lambda v: (v is not None, v))
        for bits in (1, 6):
            got = [v for v, held in sharding.value_bounds(df, column, bits) for _ in range(held)]
            assert got == [order[len(order) * i >> bits] for i in range(1, 1 << bits)]
    assert sharding.value_bounds(df.limit(0), "size", 6) == []
    few = spark.createDataFrame([(3,), (1,), (2,)], "size long")
    assert sharding.value_bounds(few, "size", 2) == [(1, 1), (2, 1), (3, 1)]


def test_encoders_learn_distinct_runs_from_arrow(texts, monkeypatch):
    for make, name in ((tokens.ByteEncoder, "byte_bpe_50k.json"), (tokens.WordEncoder, "word_bpe_49k.json")):
        own, whole, met = make(P.path(name)), Tokenizer.from_file(P.path(name)), []
        learned = own.learned
        monkeypatch.setattr(own, "learned", lambda runs: met.append(runs) or learned(runs))  # noqa: B023
        before = set(vars(own))
        for some in ([*texts, "zz\x1fy z", "one \x1c\n one", None], ["word word"] * 50, [], [None, ""]):
            column = pa.array([*some, "left out"], pa.string())[: len(some)]
            got = [np.frombuffer(x, own.kind).tolist() for x in own.ids(column)]
            assert got == [whole.encode(t or "", add_special_tokens=False).ids for t in some]
        assert all(isinstance(runs, pa.Array) and len(runs) == len(runs.unique()) for runs in met)
        assert set(vars(own)) == before  # what it has met isn't kept


def test_words_are_merged_together_without_a_pass_of_their_own(spark, texts, monkeypatch):
    import tiktoken

    path, rnd = P.path("byte_bpe_multi_50k.tiktoken"), random.Random(8)
    ranks = bpe.load_ranks(path)
    pieces = [b.decode(errors="ignore") for b in rnd.sample(list(ranks), 2000)]
    some = [*pieces, *("".join(rnd.sample(pieces, 2)) for _ in range(2000)), "", "a", "", "é" * 60, "ab" * 64, "漢字" * 20]
    merges = bpe.Merges(ranks)
    assert merges(pa.array(some)).to_pylist() == [bpe.merge_long(w.encode(), ranks) for w in some]
    assert merges(pa.array([], pa.string())).to_pylist() == []
    monkeypatch.setattr(hashing, "_SOME", 64)
    assert merges(pa.array(some[:300])).to_pylist() == [bpe.merge_long(w.encode(), ranks) for w in some[:300]]
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for common in (0, 50):
        got = bpe.encode(table(spark, texts).repartition(3), path, P.PATTERN, common=common, decoded=True)
        assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # one worker a task
        rows = got.collect()
        assert len(rows) == len(texts)
        for r in rows:
            t = texts[r.doc_id] or ""
            assert np.frombuffer(r.ids, "<u4").tolist() == want.encode_ordinary(t) and bytes(r.decoded) == t.encode()


def test_blocks_of_ids_are_read_one_by_one_without_a_shuffle(spark, texts, monkeypatch, tmp_path):
    table(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    conf = "spark.sql.autoBroadcastJoinThreshold"
    kept = spark.conf.get(conf)
    spark.conf.set(conf, "-1")  # no block is shuffled, however large the files
    try:
        got = simple8b.op3_simple8b(spark, str(tmp_path))
        plan = got._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan  # one worker a task
        rows = sorted(got.collect())
    finally:
        spark.conf.set(conf, kept)
    whole, start = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    for r, t in zip(rows, texts, strict=True):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)

    ids = np.full(1 << 15, 2**59, np.uint64)  # a word each
    words, n, escapes, _ = simple8b.pack_block([ids])
    row = {"part": 0, "block": 0, "start": 0, "n_ids": len(ids), "doc_ids": [1], "sizes": [len(ids)], "first_words": [0], "first_escapes": [0], "words": words.tobytes(), "escapes": escapes.tobytes(), "base": 0}
    batch = pa.RecordBatch.from_pylist([row] * 64, schema=simple8b._BLOCK.append(pa.field("base", pa.int64())))
    tracemalloc.start()
    assert sum(x.num_rows for x in simple8b._read(iter([batch]))) == 64
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n.tolist() == [1 << 15] and most < 32 * len(row["words"])

    monkeypatch.setattr(simple8b, "_GROUP_BYTES", 1024)
    made = simple8b.write_ids(spark.range(400).selectExpr("id AS doc_id", "'one two' AS text").coalesce(1), P.path("word_bpe_49k.json"), block_ids=1)
    groups = [m.row_group(i).num_rows for f in made.inputFiles() for m in [pq.read_metadata(f.removeprefix("file://"))] for i in range(m.num_row_groups)]
    assert sum(groups) == 400 == simple8b.read_ids(made).count() and max(groups) <= 100
