"""Musical keys: Camelot notation and the harmonic scales."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Tonics of Camelot numbers 1 to 12, minor (A) and major (B), with their enharmonic spellings.
MINOR = ("Abm G#m", "Ebm D#m", "Bbm A#m", "Fm", "Cm", "Gm", "Dm", "Am", "Em", "Bm", "F#m Gbm", "Dbm C#m")
MAJOR = ("B", "F# Gb", "Db C#", "Ab G#", "Eb D#", "Bb A#", "F", "C", "G", "D", "A", "E")
SPELLINGS = {f"{i + 1}{mode}": f"{i + 1}{mode}" for i in range(12) for mode in "AB"}
SPELLINGS |= {s: f"{i + 1}A" for i, row in enumerate(MINOR) for name in row.split() for s in (name, f"{name[:-1]} minor")}
SPELLINGS |= {s: f"{i + 1}B" for i, row in enumerate(MAJOR) for name in row.split() for s in (name, f"{name} major")}
#: Scales that take any spelling; the others compare keys as they are written.
SPELLED = ("engine", "readme")
#: Scores by relation: (equal, relative, neighbour with the same letter, neighbour with the other letter, two steps with the same letter, anything else, a key missing).
PROFILES = {
    "engine": (1.0, 0.8, 0.8, 0.1, 0.1, 0.1, 0.5),
    "readme": (1.0, 0.9, 0.8, 0.7, 0.5, 0.1, 0.5),
    "searcher": (1.5, 1.2, 1.2, 0.3, 0.3, 0.3, 0.0),
    "explain": (1.0, 0.8, 0.8, 0.2, 0.2, 0.2, None),
}


def to_camelot(key: Column) -> Column:
    """Any known spelling (``Am``, ``A minor``, ``F#``, ``8A``) as Camelot; null for anything else."""
    return F.create_map(*(F.lit(x) for kv in SPELLINGS.items() for x in kv))[F.trim(key)]


def _steps(a: Column, b: Column) -> Column:
    n = F.abs(F.regexp_extract(a, r"^\d+", 0).cast("int") - F.regexp_extract(b, r"^\d+", 0).cast("int"))
    return F.least(n, 12 - n)


def harmonic(a: Column, b: Column, profile: str = "engine") -> Column:
    """Score of two keys on one of the scales.

    ``engine`` and ``readme`` turn any spelling into Camelot first, and an unknown key counts as a missing one. On the other two
    scales a key that is not Camelot goes only with itself.
    """
    a, b = (to_camelot(a), to_camelot(b)) if profile in SPELLED else (F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))
    same, relative, near, across, two, other, missing = (F.lit(x).cast("double") for x in PROFILES[profile])
    n, letters = _steps(a, b), F.right(a, F.lit(1)) == F.right(b, F.lit(1))
    sound = a.rlike(r"^\d{1,2}[AB]$") & b.rlike(r"^\d{1,2}[AB]$")
    return (
        F.when(a.isNull() | b.isNull(), missing)
        .when(a == b, same)
        .when(~sound, other)
        .when((n == 0) & ~letters, relative)
        .when((n == 1) & letters, near)
        .when(n == 1, across)
        .when((n == 2) & letters, two)
        .otherwise(other)
    )


def compatible(a: Column, b: Column) -> Column:
    """Equal, relative or neighbouring keys; null if one is missing."""
    return harmonic(a, b, "explain") >= 0.8


def key_passes(key: Column, reference: Column, mode: Column) -> Column:
    """Whether a key goes with a reference key: ``same``, ``compatible``, or ``any`` (also without a mode or a reference). A missing key passes only ``any``."""
    free = mode.isNull() | (mode == "any") | reference.isNull()
    return F.when(free, True).when(mode == "same", F.coalesce(to_camelot(key) == to_camelot(reference), F.lit(False))).otherwise(F.coalesce(compatible(key, reference), F.lit(False)))
