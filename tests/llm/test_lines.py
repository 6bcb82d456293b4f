"""Lines that repeat, and words one edit apart, against brute force."""

import collections
import random
import re
import zlib

import pytest

from seqspark.llm import lines, spelling

SCHEMA = "doc_id long, text string, h1 long, lines string, word string, keep string, n int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y", "z", 0) for i, t in rows], SCHEMA)


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t)


def without_lines(rows, least, documents):
    """Rows equal in id and text are one document; a null id is below all others."""
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    held = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                held[key(line)].add((i if i is not None else float("-inf"), t))
    goes = {k: max(d for d, _ in s) for k, s in held.items() if len(s) >= documents}
    out = []
    for i, t in rows:
        all_of = (t or "").split("\n")
        own = i if i is not None else float("-inf")
        kept = [x for x in all_of if goes.get(key(x), own) == own]
        out.append((i, len(all_of), len(all_of) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("share,most", [(1000, 4096), (10**9, 0), (20, 5)])  # none, all or some keys are hot
def test_line_dedup(spark, share, most):
    rnd = random.Random(share)
    pool = ["".join(rnd.choice("abcÉß Z\t") for _ in range(rnd.randint(8, 14))) for _ in range(12)] + ["hot line of them all"]
    rows = [(None, "hot line of them all"), (None, "\n\n"), (3, None), (4, ""), (5, "hot line of them ALL \r\n\x0b hot line of them all"), (5, "another\nhot line of them all")]
    rows += [(i, "\n".join(rnd.choice([*pool, *pool[-1:] * 6, str(i) * 12, "short", ""]).join(rnd.choice([("", ""), (" ", "\r"), ("\t", "")])) for _ in range(rnd.choice([1, 5, 90, 300])))) for i in range(10, 60)]
    rows += rows[10:14] + [(None, rows[20][1])] * 2
    df = table(spark, rows)
    got = lines.drop_lines(df, lines.keep_bitmaps(df, 10, 5, hot_share=share, hot_lines=most)).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got), key=repr) == without_lines(rows, 10, 5)


def test_line_dedup_of_few_rows(spark):
    none = table(spark, [])
    assert lines.drop_lines(none, lines.keep_bitmaps(none)).count() == 0
    only_null = table(spark, [(None, f"{'a' * 40}\n{i}") for i in range(6)])
    assert {r.n_dropped for r in lines.drop_lines(only_null, lines.keep_bitmaps(only_null)).collect()} == {0}
    long = table(spark, [(i, "\n".join(f"line number {j % 5000} of a very long document, indeed" for j in range(30_000 + i))) for i in range(5)])
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in lines.drop_lines(long, lines.keep_bitmaps(long)).collect()}
    assert [got[i][:2] for i in range(5)] == [(30_000, 30_000), (30_001, 30_001), (30_002, 30_002), (30_003, 30_003), (30_004, 0)] and not got[0][2] and got[4][2].count("\n") == 30_003


def words_of(rows, one_in):
    n = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 5
    return {w: c for w, c in n.items() if c >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else len(b) == len(a) + 1 and a[i:] == b[i + 1 :])


@pytest.mark.parametrize("seed,number", [(0, 6), (1, 3), (2, 9)])
def test_spelling_variants(spark, seed, number):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcdeéÿÀz") for _ in range(rnd.randint(4, 8))) for _ in range(40)] + ["aaaaa", "aaaaaa", "aaaaaaa", "naïve", "×÷×÷×"]
    vary = lambda w: w[: (i := rnd.randrange(len(w)))] + rnd.choice("abé") * rnd.randint(0, 2) + w[i + rnd.randint(0, 1) :]
    base += [vary(w) for w in base for _ in range(4)]
    rows = [(i if i % 9 else None, " ".join(rnd.choice(base[: rnd.choice([10, 200])]) for _ in range(60)) + rnd.choice(["", "-", "1 Ünder_Score"])) for i in range(80)] + [(1, None), (2, "")]
    rows += rows[:3]
    n = words_of(rows, 5)
    got = {r.word: r for r in spelling.spelling_variants(table(spark, rows), one_in=5).collect()}
    assert {w: r.n for w, r in got.items()} == n
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: v for w, v in form.items() if n[v] >= 2 * n[w]}
    for w, r in got.items():
        root = w
        while root in form:
            root = form[root]
        assert (r.form, r.root, r.n_near, r.form_n) == (form.get(w), root, len(near[w]), n.get(form.get(w)))
    assert any(form.get(v) for v in form.values())  # there are chains
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    assert sorted(spelling.near_pairs(words, number).select("a", "b").collect()) == sorted((a, b) for a in n for b in near[a] if a < b)


def test_spelling_variants_of_no_words(spark):
    assert spelling.spelling_variants(table(spark, [])).count() == 0
    assert [tuple(r) for r in spelling.spelling_variants(table(spark, [(1, "lonely lonely Lonely")])).collect()] == [("lonely", None, "lonely", 3, 0, None)]


def test_spelling_variants_broadcast_no_words(spark):
    """A word has 15 rows by signature, which Spark's sizes don't count: the driver would gather them all."""
    words = spark.createDataFrame([("lonely", 3), ("lonly", 3)], "word string, n long")
    plan = spelling.near_pairs(words)._jdf.queryExecution().toString()
    plan += spelling.spelling_variants(table(spark, [(1, "lonely lonely Lonely lonelys")]))._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
