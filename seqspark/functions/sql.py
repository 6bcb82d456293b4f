"""The scores and heuristics as functions of ``spark.sql``.

``register`` makes them temporary functions of a session. Their bodies are SQL expressions, which Spark puts
in place of the call, so they run as built-in ones do; no Python is called for a row. Those that fold over a
window's letters are interpreted, though: for whole scans ``register_arrays`` adds functions of arrays of
windows, which are scored in numpy and take a profile once for each array."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import alphabet as A
from . import heuristics as H
from .scoring import Position

TABLE = "ARRAY<ARRAY<DOUBLE>>"
_CLASSES = {"a": A.ACIDIC, "b": A.BASIC, "p": A.POLAR, "g": A.SMALL, "h": A.HYDROPHOBIC}


def _count(letters: str, of: str = "w") -> str:
    return f"(length({of}) - length(translate({of}, '{letters}', '')))"


def _scale(table: dict[str, float]) -> str:
    by_weight: dict[float, str] = {}
    for letter, weight in table.items():
        by_weight[weight] = by_weight.get(weight, "") + letter
    total = " + ".join(f"{_count(letters)} * {w}D" for w, letters in by_weight.items())
    return f"(({total}) / length(w) - ({min(table.values())}D)) / {max(table.values()) - min(table.values())}D"


def _index(letter: str) -> str:
    return f"(instr('{A.ALPHABET}', {letter}) - 1)"


def _rescue() -> str:
    """The fold of scoring.rescued: whether the last two places serve as donors is all that it carries."""
    suits = "CASE substr(residues, i + 1, 1) " + " ".join(f"WHEN '{r}' THEN '{s}'" for r, s in A.RESCUERS.items()) + " ELSE '' END"
    energy = lambda j: f"energies[i][{_index(f'substr(w, {j} + 1, 1)')}]"
    donor = lambda j, free: f"if(NOT s.now AND {free} AND instr(x.suits, substr(w, {j} + 1, 1)) > 0 AND {energy(j)} < x.d, {energy(j)}, NULL)"
    # Each step binds what the next one uses: the direct energy, then both donors, then what the position scores.
    direct = f"named_struct('d', {energy('i')}, 'suits', {suits}, 'charged', substr(residues, i + 1, 1) IN ('D', 'E', 'R', 'K'))"
    donors = f"named_struct('d', x.d, 'charged', x.charged, 'l', {donor('(i - 1)', 'NOT s.before AND i > 0')}, 'r', {donor('(i + 1)', 'i < length(w) - 1')})"
    scored = f"""named_struct('one', coalesce(least(y.l, y.r), y.d), 'first_l', y.l IS NOT NULL AND (y.r IS NULL OR y.l <= y.r), 'r', y.r IS NOT NULL,
        'both', if(y.charged AND y.l IS NOT NULL AND y.r IS NOT NULL AND greatest(y.l, y.r) < 0,
            greatest(least(y.l, y.r) + {A.SECOND_DONOR_WEIGHT}D * greatest(y.l, y.r), {A.SECOND_DONOR_CAP}D * least(y.l, y.r)), NULL))"""
    two = "coalesce(z.both < z.one, false)"
    after = f"named_struct('total', s.total + if({two}, z.both, z.one), 'before', s.now, 'now', (z.r AND NOT z.first_l) OR ({two} AND z.first_l))"
    step = f"transform(transform(transform(array({direct}), x -> {donors}), y -> {scored}), z -> {after})[0]"
    return f"aggregate(sequence(0, length(w) - 1), named_struct('total', 0D, 'before', false, 'now', false), (s, i) -> {step}, s -> s.total)"


def _functions() -> dict[str, tuple[str, str, str]]:
    """Name -> (parameters, result, body)."""
    known = "".join(_CLASSES.values())
    classes = f"translate(regexp_replace(w, '[^{known}]', '_'), '{known}_', '{''.join(k * len(v) for k, v in _CLASSES.items())}o')"
    entropy = " + ".join(f"if({_count(k, 'c')} > 0, -({_count(k, 'c')} / length(c)) * log2({_count(k, 'c')} / length(c)), 0D)" for k in "abpgho")
    distance = A.distances()
    far = ", ".join(str(distance[a, b]) for a in A.STANDARD for b in A.STANDARD)
    weights = {f.name: getattr(H.BonusWeights(), f.name) for f in fields(H.BonusWeights)}
    run = lambda letters: f"longest_run(w, '{letters}') / length(w)"
    plus = {"surface": "surface_scale(w)", "flexibility": "flex_scale(w)", "polar": f"fraction_of(w, '{A.POLAR_OR_CHARGED}')", "gp": f"fraction_of(w, '{A.SMALL}')", "complexity": "class_entropy(w)", "transition": "transition_rate(w)"}
    minus = {
        "hydrophobe_penalty": f"fraction_of(w, '{A.HYDROPHOBIC}')", "repeat_penalty": "longest_repeat(w) / length(w)", "acidic_run_penalty": run(A.ACIDIC), "basic_run_penalty": run(A.BASIC),
        "charged_run_penalty": run(A.CHARGED), "acidic_excess_penalty": f"greatest(0D, fraction_of(w, '{A.ACIDIC}') - 0.25D)",
    }
    valid = f"w RLIKE '^[{A.ALPHABET}]+$' AND length(w) = size(energies)"
    return {
        "residue_index": ("residue STRING", "INT", _index("residue")),
        "is_sequence": ("w STRING", "BOOLEAN", f"w RLIKE '^[{A.ALPHABET}]+$'"),
        "grantham_distance": ("a STRING, b STRING", "INT", f"if(instr('{A.STANDARD}', a) > 0 AND instr('{A.STANDARD}', b) > 0, array({far})[(instr('{A.STANDARD}', a) - 1) * 20 + instr('{A.STANDARD}', b) - 1], 999)"),
        "class_labels": ("w STRING", "STRING", classes),
        "fraction_of": ("w STRING, letters STRING", "DOUBLE", "(length(w) - length(translate(w, letters, ''))) / length(w)"),
        "surface_scale": ("w STRING", "DOUBLE", _scale(A.SURFACE)),
        "flex_scale": ("w STRING", "DOUBLE", _scale(A.FLEX)),
        "class_entropy": ("w STRING", "DOUBLE", f"transform(array(class_labels(w)), c -> if(length(c) > 1, ({entropy}) / log2(CAST(least(5, length(c)) AS DOUBLE)), 0D))[0]"),
        "transition_rate": ("w STRING", "DOUBLE", "if(length(w) > 1, (regexp_count(class_labels(w), '(.)\\\\1*') - 1) / (length(w) - 1), 0D)"),
        "longest_repeat": ("w STRING", "INT", "coalesce(array_max(transform(regexp_extract_all(w, '(.)\\\\1*', 0), x -> length(x))), 0)"),
        "longest_run": ("w STRING, letters STRING", "INT", "coalesce(array_max(transform(regexp_extract_all(w, concat('[', letters, ']+'), 0), x -> length(x))), 0)"),
        "sequence_bonus": (
            "w STRING, " + ", ".join(f"{k} DOUBLE DEFAULT {v}D" for k, v in weights.items()), "DOUBLE",
            " + ".join(f"{k} * {x}" for k, x in plus.items()) + "".join(f" - {k} * {x}" for k, x in minus.items()),
        ),
        "rigid_score": (f"w STRING, energies {TABLE}", "DOUBLE", f"if({valid}, aggregate(sequence(0, length(w) - 1), 0D, (s, i) -> s + energies[i][{_index('substr(w, i + 1, 1)')}]), NULL)"),
        "rescue_score": (f"w STRING, residues STRING, energies {TABLE}", "DOUBLE", f"if({valid} AND length(residues) = length(w), {_rescue()}, NULL)"),
    }


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to a session and returns their names. Scores are null where a letter is no
    residue or lengths differ; ``energies`` are 20 for each position in the alphabet's order."""
    made = _functions()
    for name, (parameters, result, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return list(made)


def _each(windows: pa.Array, tables: np.ndarray | None, scored: Callable[[np.ndarray, int], np.ndarray]) -> pa.Array:
    """An array of numbers for each array of windows (null: null). scored gets the residue codes of windows of one
    length and of arrays with one table of energies (``tables`` numbers these; -1: none), and the table's number."""
    from ..operators.align import _codes  # operators build upon functions

    sizes = windows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    texts = windows.flatten().cast(pa.string())
    lengths = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    table = np.repeat(np.zeros(len(sizes), np.int64) if tables is None else tables, sizes)
    out, missing = np.zeros(len(texts)), np.ones(len(texts), bool)
    many = int(table.max(initial=0)) + 2
    kind = lengths.astype(np.int64) * many + table + 1
    kinds = kind[:1] if (kind == kind[:1]).all() else np.unique(kind)
    for k in kinds.tolist():
        n, t = k // many, k % many - 1
        some = np.arange(len(texts)) if len(kinds) == 1 else np.flatnonzero(kind == k)
        for at in np.split(some, range(1 << 14, len(some), 1 << 14)) if n and t >= 0 else []:  # fits the cache
            codes = _codes(texts.slice(at[0], len(at)) if at[-1] - at[0] + 1 == len(at) else texts.take(pa.array(at)), n)
            good = (codes >= 0).all(axis=1)
            scores = scored(codes[good], t) if good.any() else None
            if scores is not None:
                out[at[good]], missing[at[good]] = scores, False
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(out, mask=missing), mask=windows.is_null())


def _profiles(energies: pa.Array, residues: pa.Array | None = None) -> tuple[np.ndarray, list]:
    """The number of each row's profile (-1: none) and the profiles, of which rows that share a literal have one."""

    def table_of(e: list | None) -> tuple | None:
        return tuple(map(tuple, e)) if e is not None and all(x is not None and len(x) == 20 and None not in x for x in e) else None

    energies = energies.cast(pa.list_(pa.list_(pa.float64())))
    sizes = [x.value_lengths() for x in (energies, energies.flatten())]
    flat = energies.flatten().flatten()
    even = all(not x.null_count and len(set(x.to_pylist())) == 1 for x in sizes) and len(flat) > 0 and not flat.null_count
    if even and ((grid := flat.to_numpy(zero_copy_only=False).reshape(len(energies), -1)) == grid[0]).all():
        tables = [table_of(energies[0].as_py())] * len(energies)
    else:
        tables = [table_of(e) for e in energies.to_pylist()]
    known: dict = {}
    numbers = []
    for r, t in zip(residues.to_pylist() if residues is not None else ["A" * len(t or "") for t in tables], tables):
        whole = r is not None and t is not None and len(r) == len(t)
        numbers.append(known.setdefault((r, t), len(known)) if whole else -1)
    return np.array(numbers, np.int64), [[Position(a, list(x), [1.0] * 20) for a, x in zip(r, t)] for r, t in known]


def sequence_bonuses(windows: pa.Array) -> pa.Array:
    from ..operators.metrics import metrics

    return _each(windows, None, lambda codes, _: H.bonus(metrics(codes), H.BonusWeights(), float, np.maximum))


def rigid_scores(windows: pa.Array, energies: pa.Array) -> pa.Array:
    return _rescued(windows, *_profiles(energies), full=False)


def rescue_scores(windows: pa.Array, residues: pa.Array, energies: pa.Array) -> pa.Array:
    return _rescued(windows, *_profiles(energies, residues), full=True)


def _rescued(windows: pa.Array, numbers: np.ndarray, profiles: list, full: bool) -> pa.Array:
    from ..operators import align as L

    def scored(codes: np.ndarray, number: int) -> np.ndarray | None:
        profile = profiles[number]
        if len(profile) != codes.shape[1]:
            return None
        table = np.array([p.energies for p in profile])
        return L._sum(L.rescue_scores(codes, table, profile) if full else table[np.arange(len(profile)), codes])

    return _each(windows, numbers, scored)


def register_arrays(spark: SparkSession) -> list[str]:
    """Makes sequence_bonuses(windows), rigid_scores(windows, energies) and rescue_scores(windows, residues, energies)
    known to a session and returns their names: sequence_bonus, rigid_score and rescue_score of each window of an
    array, null where a letter is no residue or lengths differ."""
    made = (sequence_bonuses, rigid_scores, rescue_scores)
    for f in made:
        spark.udf.register(f.__name__, F.arrow_udf(f, "array<double>"))
    return [f.__name__ for f in made]
