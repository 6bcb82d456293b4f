"""Scores of windows against a profile, as columns: rigid sums, score modes, neighbour rescue.

A profile is a few dozen positions, so it becomes literals of the expression; no join is needed. Every
score mode is folded into the profile's own numbers first, so each mode is a plain lookup per position."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import alphabet as A

SCORE_MODES, RESCUE_MODES = ("raw", "centered", "confidence_adjusted"), ("full", "none")


@dataclass
class Position:
    """A profile's position: the query's residue, and energy and deviation for each residue of a target."""

    residue: str
    energies: list[float]
    stds: list[float] = field(default_factory=lambda: [1.0] * 20)

    @property
    def charged(self) -> bool:
        return self.residue in "DERK"

    @property
    def aromatic(self) -> bool:
        return self.residue in "FWY"

    def scores(self, mode: str = "raw", floor: float = 1.0) -> list[float]:
        """The 20 energies in a score mode."""
        if mode not in SCORE_MODES:
            raise ValueError(f"unknown score mode {mode!r}")
        if mode == "raw":
            return list(self.energies)
        mean = sum(self.energies) / 20
        centred = [e - mean for e in self.energies]
        return centred if mode == "centered" else [e / max(s, floor) for e, s in zip(centred, self.stds)]


Profile = list[Position]


def let(value: Column, of) -> Column:
    """of(value) with the value computed once."""
    return F.get(F.transform(F.array(value), of), 0)


def residue_at(window: Column, i: int) -> Column:
    return F.substring(window, i + 1, 1)


def position_score(window: Column, i: int, scores: list[float]) -> Column:
    return F.element_at(F.array(*map(F.lit, scores)), A.index_of(residue_at(window, i)) + 1)


def rigid_score(window: Column, profile: Profile, mode: str = "raw", floor: float = 1.0, checked: bool = False) -> Column:
    """The sum over positions; null if a letter is no residue, unless windows are ``checked`` already.
    Unrolled, so it stays in generated code."""
    total = sum((position_score(window, i, p.scores(mode, floor)) for i, p in enumerate(profile)), F.lit(0.0))
    return total if checked else F.when(A.is_valid(window) & (F.length(window) == len(profile)), total)


def rescued(window: Column, profile: Profile, mode: str = "raw", floor: float = 1.0, context: dict[str, list[float]] | None = None) -> Column:
    """struct(total, energies, donors, second): the score with neighbour rescue.

    From left to right, a charged or aromatic position of the profile may score the residue beside its own
    place instead, if that residue suits it, scores lower, and serves no other position yet; a charged one
    may also add 0.35 of a second donor below zero. Only whether the last two places serve as donors
    matters later, so the fold carries two bits. donors and second are places in the window (from 0; the
    own place if there is none, and -1). context: for D, E, R and K, the 8,000 energies of that residue
    as centre of a target's triplet (NaN where the triplet is unknown), which replace the plain one."""
    n = len(profile)
    table = F.array(*[F.array(*map(F.lit, p.scores(mode, floor))) for p in profile])
    suits = F.array(*[F.lit(A.RESCUERS.get(p.residue, "")) for p in profile])
    charged = F.array(*[F.lit(p.charged) for p in profile])
    centre = F.array(*[F.lit(p.residue) for p in profile])
    known = {r: F.split(F.lit(",".join(map(str, t))), ",").cast("array<double>") for r, t in (context or {}).items()}

    def by_triplet(i: Column, j: Column, cs: Column) -> Column:
        code, found = F.get(cs, j - 1) * 400 + F.get(cs, j) * 20 + F.get(cs, j + 1), F.lit(float("nan"))
        for r, t in known.items():
            found = F.when(F.get(centre, i) == r, F.get(t, code)).otherwise(found)
        return found

    return _fold(window, F.lit(n), F.array(*[F.lit(i) for i in range(n)]), table, suits, charged, by_triplet if known else None)


def rescued_by_rows(window: Column, residues: Column, table: Column, around: Column | None = None) -> Column:
    """As ``rescued``, with the profile in columns: its residues (a string) and energies (an array of 20 for each
    position), so that one plan scores many profiles. around: for each place of the window the energies of its
    triplet's centre, null where the triplet is unknown."""
    no = F.lit("")
    suits = F.create_map(*[F.lit(x) for r, s in A.RESCUERS.items() for x in (r, s)])
    own = F.split(residues, "")
    by_place = None if around is None else lambda i, j, cs: F.coalesce(F.get(F.get(around, j), A.index_of(F.get(own, i))), F.lit(float("nan")))
    n = F.length(residues)
    places = F.sequence(F.lit(0), n - 1)
    return _fold(window, n, places, table, F.transform(own, lambda r: F.coalesce(F.element_at(suits, r), no)), F.transform(own, lambda r: r.isin(*"DERK")), by_place)


def _fold(window: Column, n: Column, places: Column, table: Column, suits: Column, charged: Column, context) -> Column:
    """The fold of ``rescued`` over columns; context: the energy of donor j for position i from its triplet, or NaN."""
    nan, no = F.lit(float("nan")), F.lit(False)
    letters = F.split(window, "")
    codes = F.transform(letters, A.index_of)

    def of(ls: Column, cs: Column) -> Column:
        def candidate(i: Column, j: Column, free: Column) -> Column:
            """The energy of donor j for position i, or NaN."""
            plain = F.get(F.get(table, i), F.get(cs, j))
            if context:
                inner = F.get(charged, i) & (j > 0) & (j < n - 1)
                plain = let(F.when(inner, context(i, j, cs)).otherwise(nan), lambda x: F.when(F.isnan(x), plain).otherwise(x))
            ok = free & (j >= 0) & (j < n) & F.contains(F.get(suits, i), F.get(ls, j))
            return F.when(F.coalesce(ok, no), plain).otherwise(nan)

        def step(s: Column, i: Column) -> Column:
            def after(t: Column) -> Column:  # t: direct, left, right; candidates that don't lower the score are NaN
                d, left, right = t["d"], t["l"], t["r"]
                use_l = (left < d) & ~F.isnan(left)
                use_r = (right < d) & ~F.isnan(right)
                first_l = use_l & (~use_r | (left <= right))
                e1 = F.when(first_l, left).otherwise(F.when(use_r, right).otherwise(d))
                e2 = F.when(use_l & use_r, F.greatest(left, right)).otherwise(nan)
                both = F.get(charged, i) & ~F.isnan(e2) & (e2 < 0)
                mixed = F.greatest(e1 + A.SECOND_DONOR_WEIGHT * e2, A.SECOND_DONOR_CAP * e1)
                two = both & (mixed < e1)
                donor = F.when(first_l, i - 1).otherwise(F.when(use_r, i + 1).otherwise(i))
                return F.struct(
                    (s["total"] + F.when(two, mixed).otherwise(e1)).alias("total"),
                    F.concat(s["energies"], F.array(F.when(two, mixed).otherwise(e1))).alias("energies"),
                    F.concat(s["donors"], F.array(donor)).alias("donors"),
                    F.concat(s["second"], F.array(F.when(two, F.when(first_l, i + 1).otherwise(i - 1)).otherwise(F.lit(-1)))).alias("second"),
                    s["now"].alias("before"),
                    ((donor == i + 1) | (two & first_l)).alias("now"),
                )

            able = ~s["now"] & (F.get(suits, i) != "")
            return let(
                F.struct(
                    F.get(F.get(table, i), F.get(cs, i)).alias("d"),
                    candidate(i, i - 1, able & ~s["before"]).alias("l"),
                    candidate(i, i + 1, able).alias("r"),
                ),
                after,
            )

        ints = F.array().cast("array<int>")
        start = F.struct(F.lit(0.0).alias("total"), F.array().cast("array<double>").alias("energies"), ints.alias("donors"), ints.alias("second"), no.alias("before"), no.alias("now"))
        return F.aggregate(places, start, step, lambda s: F.struct(s["total"].alias("total"), s["energies"].alias("energies"), s["donors"].alias("donors"), s["second"].alias("second")))

    whole = let(F.struct(letters.alias("ls"), codes.alias("cs")), lambda x: of(x["ls"], x["cs"]))
    return F.when(A.is_valid(window) & (F.length(window) == n), whole)


def labels(window: Column, profile: Profile, trace: Column) -> Column:
    """What each position scored: its residue, or ``X<-Y@j`` and ``X<-Y@j,Z@k`` with donors at places from 1."""
    own = F.split(window, "")
    at = lambda j: F.concat(F.get(own, j), F.lit("@"), (j + 1).cast("string"))

    def of(i: Column) -> Column:
        x, j, k = F.get(own, i), F.get(trace["donors"], i), F.get(trace["second"], i)
        return F.when(j == i, x).otherwise(F.concat(x, F.lit("<-"), at(j), F.when(k >= 0, F.concat(F.lit(","), at(k))).otherwise("")))

    return F.transform(F.array(*[F.lit(i) for i in range(len(profile))]), of)


def rescues(profile: Profile, rescue: str) -> bool:
    """Whether rescue can change scores of this profile."""
    if rescue not in RESCUE_MODES:
        raise ValueError(f"unknown rescue mode {rescue!r}")
    return rescue == "full" and any(p.residue in A.RESCUERS for p in profile)


def window_score(window: Column, profile: Profile, mode: str = "raw", floor: float = 1.0, rescue: str = "full", context=None) -> Column:
    """The score as an expression, for few rows; operators.align.add_score suits whole scans."""
    return rescued(window, profile, mode, floor, context)["total"] if rescues(profile, rescue) else rigid_score(window, profile, mode, floor)
