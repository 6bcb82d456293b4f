"""Records, motif rows and a profile taken from the given tables, in Spark and in SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alphabet as A
from ..functions.scoring import Position, Profile
from ..operators.windows import BLOCK, records_of

#: k-mer number of a vector: an affine map of its id, read in base 20.
_AFFINE = {1: (1, 0), 3: (37, 11), 5: (7919, 13)}


def records(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Records of the documents. A table of fewer splits than cores is dealt to all cores first: each letter
    becomes a window, so the work behind is many times that of the shuffle. Larger tables stay as they are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    cores = spark.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:
        docs = docs.repartition(4 * cores, "doc_id")
    return records_of(docs, keep)


def written_fasta(found: DataFrame) -> str:
    """Writes records as FASTA files and returns their folder: below spark.checkpoint.dir, which all executors
    share, or where that isn't set (local tests) a temporary one."""
    spark = found.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-fasta-")
    folder = f"{shared.rstrip('/')}/fasta-{uuid.uuid4().hex}"
    found.select(F.concat(F.lit(">"), "header", F.lit("\n"), "sequence")).write.text(folder)
    return folder


def kmer(vec_id: int, size: int) -> str:
    a, b = _AFFINE[size]
    code = (vec_id * a + b) % 20**size
    return "".join(A.ALPHABET[code // 20**i % 20] for i in reversed(range(size)))


def motif_rows(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """(seq, geom, row) from the embeddings: 20 components, in steps of 1/1024 so that sums are exact."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    a, b = _AFFINE[size]
    code = (F.col("vec_id") * a + b) % F.lit(20**size)
    letters = [F.substring(F.lit(A.ALPHABET), (F.floor(code / F.lit(20**i)) % 20 + 1).cast("int"), F.lit(1)) for i in reversed(range(size))]
    row = F.transform(F.slice("embedding", 1, 20), lambda x: F.floor(x.cast("double") * 1024 + 0.5) / 1024)
    return e.select(F.concat(*letters).alias("seq"), F.col("label").cast("string").alias("geom"), row.alias("row"))


def profile(residues: str) -> Profile:
    """A profile whose energies are multiples of 1/16: sums are exact in any order."""
    return [
        Position(r, [((i * 7 + k * 11) % 41 - 20) / 16 for k in range(20)], [1 + (i * 3 + k * 5) % 8 / 8 for k in range(20)]) for i, r in enumerate(residues)
    ]


#: Scanned with: nine positions, and five with charged and aromatic ones.
NINE, FIVE = "TLRLKHNYV", "REKFD"
#: A query whose k-mers the index holds, besides one 5-mer that differs from an indexed one by a near residue.
QUERY = kmer(0, 5) + kmer(1, 3) + kmer(2, 5) + "V" + kmer(3, 5)[1:] + kmer(4, 3)


# SQL


def sql_records() -> str:
    return """SELECT doc_id AS record_ord, concat_ws('|', lang, source, CAST(doc_id AS VARCHAR)) AS header, lang,
        upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS sequence FROM documents"""


def sql_windows(length: int) -> str:
    return f"""r AS ({sql_records()}),
    b AS (SELECT record_ord, header, lang, {BLOCK} * i AS off, substr(sequence, {BLOCK} * i + 1, {BLOCK + length - 1}) AS t
        FROM (SELECT *, unnest(range(0, CAST(ceil(length(sequence) / {BLOCK}.0) AS BIGINT))) AS i FROM r WHERE length(sequence) >= {length})),
    w AS (SELECT record_ord, header, lang, off + j AS start, substr(t, j, {length}) AS win
        FROM (SELECT *, unnest(range(1, length(t) - {length} + 2)) AS j FROM b)
        WHERE regexp_full_match(substr(t, j, {length}), '[{A.ALPHABET}]+'))"""


def sql_energy(i: int, letter: str) -> str:
    return f"((({i * 7} + (instr('{A.ALPHABET}', {letter}) - 1) * 11) % 41 - 20) / 16.0)"


def sql_rigid(residues: str, mode: str = "raw", w: str = "win") -> str:
    terms = []
    for i, p in enumerate(profile(residues)):
        letter = f"substr({w}, {i + 1}, 1)"
        e = sql_energy(i, letter)
        if mode != "raw":
            e = f"({e} - ({sum(p.energies) / 20!r}))"
        if mode == "confidence_adjusted":
            e = f"({e} / (1 + ({i * 3} + (instr('{A.ALPHABET}', {letter}) - 1) * 5) % 8 / 8.0))"
        terms.append(e)
    return " + ".join(terms)


def sql_rescue(residues: str, source: str, columns: str, w: str = "win", energy=sql_energy, context=None, trace: bool = False, own: str | None = None) -> str:
    """A SELECT of the columns and `score`, from a source with windows: one step per position. `energy` gives a
    letter's energy at a position, `context` what replaces that of the donor at a place (null: nothing). With
    trace also `parts` and `labels`, lists with a value for each position. `own` is a column (one of `columns`)
    with the profile's residues, where these differ from row to row; `residues` then only says how many."""
    lists = ", CAST([] AS DOUBLE[]) AS parts, CAST([] AS VARCHAR[]) AS labels" if trace else ""
    sql = f"SELECT {columns}, {w} AS win_, 0.0 AS total, FALSE AS before, FALSE AS now_{lists} FROM {source}"
    for i, r in enumerate(residues):
        suits, n = A.RESCUERS.get(r, ""), len(residues)
        is_suited, charged = f"instr('{suits}', {{}}) > 0", "TRUE" if r in "DERK" else "FALSE"
        if own:
            r = f"substr({own}, {i + 1}, 1)"
            suits = "CASE " + " ".join(f"WHEN {r} = '{a}' THEN '{b}'" for a, b in A.RESCUERS.items()) + " ELSE '' END"
            is_suited, charged = f"instr({suits}, {{}}) > 0", f"{r} IN ('D', 'E', 'R', 'K')"
        d = energy(i, f"substr(win_, {i + 1}, 1)")

        def near(j: int, free: str) -> str:
            if not suits or not 0 <= j < n:
                return "CAST(NULL AS DOUBLE)"
            letter = f"substr(win_, {j + 1}, 1)"
            e = energy(i, letter)
            if context and charged != "FALSE" and 0 < j < n - 1:
                e = f"coalesce(CASE WHEN {charged} THEN {context(r, j)} END, {e})"
            return f"CASE WHEN NOT now_ AND {free} AND {is_suited.format(letter)} AND {e} < {d} THEN {e} END"

        sql = f"SELECT *, CAST({d} AS DOUBLE) AS d, {near(i - 1, 'NOT before')} AS l, {near(i + 1, 'TRUE')} AS r FROM ({sql})"
        sql = f"SELECT *, l IS NOT NULL AND (r IS NULL OR l <= r) AS first_l FROM ({sql})"
        sql = f"SELECT *, coalesce(CASE WHEN first_l THEN l ELSE r END, d) AS e1, CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN greatest(l, r) END AS e2 FROM ({sql})"
        two = f"{charged} AND e2 IS NOT NULL AND e2 < 0 AND greatest(e1 + {A.SECOND_DONOR_WEIGHT} * e2, {A.SECOND_DONOR_CAP} * e1) < e1"
        sql = f"SELECT *, {two} AS two FROM ({sql})"
        best = f"CASE WHEN two THEN greatest(e1 + {A.SECOND_DONOR_WEIGHT} * e2, {A.SECOND_DONOR_CAP} * e1) ELSE e1 END"
        if trace:
            at = lambda j: f"substr(win_, {j + 1}, 1) || '@{j + 1}'"
            label = f"""substr(win_, {i + 1}, 1) || CASE WHEN first_l THEN '<-' || {at(i - 1)} || CASE WHEN two THEN ',' || {at(i + 1)} ELSE '' END
                WHEN r IS NOT NULL THEN '<-' || {at(i + 1)} || CASE WHEN two THEN ',' || {at(i - 1)} ELSE '' END ELSE '' END"""
            lists = f", list_append(parts, {best}) AS parts, list_append(labels, {label}) AS labels"
        sql = f"""SELECT {columns}, win_, total + {best} AS total,
            now_ AS before, (r IS NOT NULL AND NOT first_l) OR (two AND first_l) AS now_{lists} FROM ({sql})"""
    return f"SELECT {columns}, total AS score{', parts, labels' if trace else ''} FROM ({sql})"


def sql_regions(length: int) -> str:
    """`g`: windows as `w`, with the region of one letter more on either side, and where it starts; regions with
    other letters are null. Records are led and followed by a space."""
    return f"""r AS ({sql_records()}),
    b AS (SELECT record_ord, header, {BLOCK} * i AS off, substr(' ' || sequence || ' ', {BLOCK} * i + 1, {BLOCK + length + 1}) AS t
        FROM (SELECT *, unnest(range(0, CAST(ceil(length(sequence) / {BLOCK}.0) AS BIGINT))) AS i FROM r WHERE length(sequence) >= {length})),
    w AS (SELECT record_ord, header, off + j AS start, substr(t, j + 1, {length}) AS win, trim(substr(t, j, {length + 2})) AS around
        FROM (SELECT *, unnest(range(1, length(t) - {length})) AS j FROM b) WHERE regexp_full_match(substr(t, j + 1, {length}), '[{A.ALPHABET}]+')),
    g AS (SELECT record_ord, header, start, win, CASE WHEN regexp_full_match(around, '[{A.ALPHABET}]+') THEN around END AS region, greatest(start - 1, 1) AS region_from FROM w)"""


def sql_semiglobal(residues: str, source: str, trace: bool = False) -> str:
    """CTEs that end in `best`: region, score, qs, qe, ts, gap, aligned, for each distinct region of the source. With
    trace also labels, energies, and head and tail: the letters beside the alignment that ease its ends, or ''.

    All alignments are listed: from qs to qe of the profile, ts in the region, one letter skipped at most; the
    ends may take half of what the letter beside them scores lower. The first of least score stays."""
    n = len(residues)

    def eased(part: str, letter: str, i: int) -> str:
        f = sql_energy(i, letter)
        return f"CASE WHEN {letter} <> '' AND {f} < {part} THEN {part} + 0.5 * ({f} - {part}) ELSE {part} END"

    scored = []
    for qs in range(n):
        for qe in range(qs + n - 1, n + 1):
            k = qe - qs
            steps = sql_rescue(residues[qs:qe], f"(SELECT * FROM al WHERE qs = {qs} AND qe = {qe})", "region, qs, qe, ts, gap, before_, after_, aligned", "aligned", lambda i, x, qs=qs: sql_energy(i + qs, x), trace=True)
            parts = [f"parts[{i}]" for i in range(1, k + 1)]
            took = ", ".join(f"CASE WHEN {x} <> '' AND {sql_energy(i, x)} < {part} THEN {x} ELSE '' END AS {name}" for name, x, i, part in (("head", "before_", qs, parts[0]), ("tail", "after_", qe - 1, parts[-1])))
            parts[0], parts[-1] = eased(parts[0], "before_", qs), eased(parts[-1], "after_", qe - 1)
            more = f", labels, [{', '.join(parts)}] AS energies, {took}" if trace else ""
            scored.append(f"SELECT region, qs, qe, ts, gap, aligned, 0.0 + {' + '.join(f'({x})' for x in parts)} AS score{more} FROM ({steps})")
    return f"""st AS (SELECT * FROM (SELECT unnest(range({n}, {n + 3})) AS size), (SELECT unnest(range(0, {n})) AS qs), (SELECT unnest(range(1, {n + 1})) AS qe),
        (SELECT unnest(range(0, {n + 2})) AS ts), (SELECT unnest(range(-1, {n + 1})) AS gap) WHERE qe - qs >= {n - 1} AND gap <= qe - qs AND ts + (qe - qs) + CAST(gap >= 0 AS INTEGER) <= size),
    al AS (SELECT region, qs, qe, ts, gap, substr(region, ts + CAST(gap = 0 AS INTEGER), 1) AS before_, substr(region, ts + (qe - qs) + 1 + CAST(gap >= 0 AND gap < qe - qs AS INTEGER), 1) AS after_,
        CASE WHEN gap < 0 THEN substr(region, ts + 1, qe - qs) ELSE substr(region, ts + 1, gap) || substr(region, ts + gap + 2, qe - qs - gap) END AS aligned
        FROM (SELECT DISTINCT region FROM {source} WHERE region IS NOT NULL) x JOIN st ON st.size = length(x.region)),
    best AS (SELECT * FROM ({" UNION ALL ".join(scored)}) QUALIFY row_number() OVER (PARTITION BY region ORDER BY score, qs, qe, gap >= 0, ts, gap) = 1)"""


#: Places of an alignment, from the columns of `best` and region_from.
SQL_PLACES = """qs + 1 AS query_start, qe AS query_end, region_from + ts AS target_start, region_from + ts + (qe - qs) + CAST(gap >= 0 AS INTEGER) - 1 AS target_end,
    CASE WHEN gap >= 0 THEN region_from + ts + gap ELSE 0 END AS skipped, aligned AS aligned_window"""


def sql_metrics(length: int, w: str = "win") -> dict[str, str]:
    """The heuristic metrics of windows of this length."""
    n = float(length)
    count = lambda letters, s=w: f"(length({s}) - length(translate({s}, '{letters}', '')))"
    groups = {"a": A.ACIDIC, "b": A.BASIC, "p": A.POLAR, "g": A.SMALL, "h": A.HYDROPHOBIC}
    cls = f"translate({w}, '{''.join(groups.values())}', '{''.join(k * len(v) for k, v in groups.items())}')"

    def scale(table: dict[str, float]) -> str:
        by: dict[float, str] = {}
        for a, x in table.items():
            by[x] = by.get(x, "") + a
        total = " + ".join(f"{count(letters)} * ({x!r})" for x, letters in by.items())
        return f"((({total}) / {n} - ({min(table.values())!r})) / {max(table.values()) - min(table.values())!r})"

    def longest(patterns: list[str]) -> str:
        cases = " ".join(f"WHEN regexp_matches({w}, '{'|'.join(f'{p}{{{k}}}' for p in patterns)}') THEN {k}" for k in range(length, 0, -1))
        return f"((CASE {cases} ELSE 0 END) / {n})"

    terms = " + ".join(f"CASE WHEN {count(v)} > 0 THEN -({count(v)} / {n}) * log2({count(v)} / {n}) ELSE 0 END" for v in groups.values())
    changes = " + ".join(f"CAST(substr({cls}, {i}, 1) <> substr({cls}, {i + 1}, 1) AS INTEGER)" for i in range(1, length))
    return {
        "surface": scale(A.SURFACE), "flex": scale(A.FLEX), "polar": f"({count(A.POLAR_OR_CHARGED)} / {n})", "acidic": f"({count(A.ACIDIC)} / {n})",
        "basic": f"({count(A.BASIC)} / {n})", "gp": f"({count(A.SMALL)} / {n})", "hydrophobe": f"({count(A.HYDROPHOBIC)} / {n})",
        "entropy": f"(({terms}) / log2({float(min(5, length))}))", "transition": f"(({changes}) / {n - 1})",
        "repeat": longest(list(A.STANDARD)), "acidic_run": longest([f"[{A.ACIDIC}]"]), "basic_run": longest([f"[{A.BASIC}]"]), "charged_run": longest([f"[{A.CHARGED}]"]),
    }


def sql_bonus() -> str:
    """From columns named as the metrics."""
    return """0.25 * surface + 0.2 * flex + 0.1 * polar + 0.25 * gp + 0.3 * entropy + 0.2 * transition - 0.15 * hydrophobe - 0.4 * repeat
        - 0.6 * acidic_run - 0.55 * basic_run - 0.9 * charged_run - 0.8 * greatest(0.0, acidic - 0.25)"""


def sql_with_metrics(length: int, columns: str, source: str = "w") -> str:
    return f"SELECT {columns}, {', '.join(f'{v} AS {k}' for k, v in sql_metrics(length).items())} FROM {source}"


def sql_index(size: int, name: str) -> str:
    """The long index of one k-mer size as CTEs; `name` has seq, idx, n, buckets, mean, std."""
    a, b = _AFFINE[size]
    code = f"((vec_id * {a} + {b}) % {20**size})"
    seq = " || ".join(f"substr('{A.ALPHABET}', CAST({code} // {20**i} % 20 + 1 AS BIGINT), 1)" for i in reversed(range(size)))
    return f"""{name}_rows AS (SELECT {seq} AS seq, label AS geom, k AS idx, floor(CAST(embedding[k + 1] AS DOUBLE) * 1024 + 0.5) / 1024 AS e
        FROM (SELECT *, unnest(range(0, 20)) AS k FROM embeddings)),
    {name}_buckets AS (SELECT seq, idx, geom, count(*) AS n, sum(e) / count(*) AS m, greatest(sum(e * e) / count(*) - (sum(e) / count(*)) * (sum(e) / count(*)), 0) AS v
        FROM {name}_rows GROUP BY seq, idx, geom),
    {name}_means AS (SELECT seq, idx, sum(n) AS n, count(*) AS buckets, -ln(sum(n * exp(-m)) / sum(n)) AS mean FROM {name}_buckets GROUP BY seq, idx),
    {name} AS (SELECT x.seq, x.idx, CAST(x.n AS BIGINT) AS n, x.buckets, x.mean, sqrt(greatest(sum(y.n * (y.v + (y.m - x.mean) * (y.m - x.mean))) / x.n, 0)) AS std
        FROM {name}_means x JOIN {name}_buckets y ON x.seq = y.seq AND x.idx = y.idx GROUP BY x.seq, x.idx, x.n, x.buckets, x.mean)"""


def sql_profile(strategy: str, query: str = QUERY, one: str = "directed", many: str | None = None) -> str:
    """CTEs that end in `p`: position, idx, energy, std, mode; `one` is the mode of the 1x1 index. `many` is a CTE whose
    `query` has the sequences, as long as the query, whose profiles are wanted; `p` has that column too."""
    singles = sql_index(1, "i1")
    if one != "directed":
        half = {"reciprocal_sum": 1, "reciprocal_mean": 2}[one]
        singles = f"""{sql_index(1, "i0")}, i1 AS (SELECT a.seq, a.idx, a.n, a.buckets, (a.mean + b.mean) / {half} AS mean, sqrt(a.std * a.std + b.std * b.std) / {half} AS std
        FROM i0 a JOIN i0 b ON b.seq = substr('{A.ALPHABET}', a.idx + 1, 1) AND b.idx = instr('{A.ALPHABET}', a.seq) - 1)"""
    n = len(query)
    rows = ", ".join(f"({i + 1}, '{c}', {repr(query[i - 1 : i + 2]) if 0 < i < n - 1 else 'NULL'}, {repr(query[i - 2 : i + 3]) if 1 < i < n - 2 else 'NULL'})" for i, c in enumerate(query))
    listed, key = f"SELECT * FROM (VALUES {rows}) t(position, residue, k3, k5)", ""
    if many:
        around = lambda h: f"CASE WHEN position > {h} AND position <= {n - h} THEN substr(query, position - {h}, {2 * h + 1}) END"
        listed, key = f"SELECT query, position, substr(query, position, 1) AS residue, {around(1)} AS k3, {around(2)} AS k5 FROM {many}, (SELECT CAST(unnest(range(1, {n + 1})) AS INTEGER) AS position)", "query, "
    near = ", ".join(f"('{a}', '{b}')" for (a, b), d in A.distances().items() if d <= 50)
    pool = ""
    if "degen" in strategy:
        on = " AND ".join(f"EXISTS (SELECT 1 FROM near WHERE a = substr(k.k5, {i}, 1) AND b = substr(s.seq, {i}, 1))" for i in (1, 2, 4, 5))
        pool = f""", near AS (SELECT * FROM (VALUES {near}) t(a, b)),
    pool AS (SELECT k.k5, s.idx, sum(s.n) AS n, sum(s.n * s.mean) / sum(s.n) AS mean,
        sqrt(greatest(sum(s.n * (s.std * s.std + s.mean * s.mean)) / sum(s.n) - (sum(s.n * s.mean) / sum(s.n)) * (sum(s.n * s.mean) / sum(s.n)), 0)) AS std
        FROM (SELECT DISTINCT k5 FROM q WHERE k5 IS NOT NULL) k JOIN i5 s ON substr(s.seq, 3, 1) = substr(k.k5, 3, 1) AND {on} GROUP BY k.k5, s.idx)"""
    joined = f"""j AS (SELECT {key}q.position, a.idx, a.n AS n1, a.mean AS m1, a.std AS s1, b.n AS n3, b.mean AS m3, b.std AS s3, c.n AS n5, c.mean AS m5, c.std AS s5
        {', d.n AS nd, d.mean AS md, d.std AS sd' if pool else ''}
        FROM q JOIN i1 a ON a.seq = q.residue LEFT JOIN i3 b ON b.seq = q.k3 AND b.idx = a.idx LEFT JOIN i5 c ON c.seq = q.k5 AND c.idx = a.idx
        {'LEFT JOIN pool d ON d.k5 = q.k5 AND d.idx = a.idx' if pool else ''})"""
    end = f"position = 1 OR position = {n}"
    mix = lambda w, x, y: (f"{w} * m{x} + (1 - {w}) * m{y}", f"sqrt({w} * {w} * s{x} * s{x} + (1 - {w}) * (1 - {w}) * s{y} * s{y})")
    if strategy.startswith("blend"):
        w = "(CASE WHEN n3 >= 100 THEN 0.8 ELSE 0.5 END)"
        m, s = mix(w, "3", "1")
        cases = [("n3 IS NOT NULL", m, s, "CASE WHEN n3 >= 100 THEN 'strong' ELSE 'weak' END"), ("TRUE", "m1", "s1", "'1x1_only'")]
    elif strategy.startswith("shrinkage"):
        joined += """, j0 AS (SELECT *, coalesce(n3 / (n3 + 25.0), 0) AS w3, coalesce(n5 / (n5 + 10.0), 0) AS w5 FROM j),
    j2 AS (SELECT *, w3 * coalesce(m3, 0) + (1 - w3) * m1 AS mb, sqrt(w3 * w3 * coalesce(s3, 0) * coalesce(s3, 0) + (1 - w3) * (1 - w3) * s1 * s1) AS sb FROM j0)"""
        m, s = mix("w5", "5", "b")
        cases = [("n5 IS NOT NULL", m, s, "'5x5_shrinkage'"), ("n3 IS NOT NULL", "mb", "sb", "'3x3_shrinkage'"), ("TRUE", "m1", "s1", "'1x1_only'")]
    else:
        cases = [("n5 IS NOT NULL", "m5", "s5", "'5x5_primary'")]
        if pool:
            m, s = mix("0.25", "d", "3")
            cases += [("nd IS NOT NULL AND n3 IS NOT NULL", m, s, "'5x5_degen_3x3_blend'"), ("nd IS NOT NULL", "md", "sd", "'5x5_degen_only'")]
        cases += [("n3 IS NOT NULL", "m3", "s3", "'3x3_primary'"), ("TRUE", "m1", "s1", "'1x1_only'")]
    cases = [(end, "m1", "s1", "'1x1_terminal'"), *cases]
    case = lambda k: "CASE " + " ".join(f"WHEN {c[0]} THEN {c[k]}" for c in cases) + " END"
    last = "j2" if strategy.startswith("shrinkage") else "j"
    return f"""{singles}, {sql_index(3, 'i3')}, {sql_index(5, 'i5')}, q AS ({listed}){pool}, {joined},
    p AS (SELECT {key}position, idx, {case(1)} AS energy, {case(2)} AS std, {case(3)} AS mode FROM {last})"""
