"""Cleaning of dirty track metadata, as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

UNKNOWN = "Unknown"


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def as_tag_array(c: Column) -> Column:
    """A JSON list as it is, another non-blank string as its only tag, null and blank as no tags."""
    parsed = F.when(F.trim(c).startswith("["), F.from_json(c, "array<string>"))
    return F.coalesce(parsed, F.when(F.trim(c) != "", F.array(F.trim(c))), F.array().cast("array<string>"))


def as_vector(c: Column) -> Column:
    """Text ``[a, b, ...]`` as numbers; null if it is not a list."""
    return F.from_json(c, "array<float>")


def title_or_stem(title: Column, path: Column) -> Column:
    """The title, or the file's name without folder and extension if the title is missing or ``Unknown``."""
    return F.coalesce(F.nullif(title, F.lit(UNKNOWN)), F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1))


def norm_artist(c: Column) -> Column:
    return F.coalesce(blank_to_null(c), F.lit("unknown artist"))


def norm_title(c: Column) -> Column:
    return blank_to_null(c)


def artist_title_key(artist: Column, title: Column) -> Column:
    """``artist_title`` in lower case, both normalised; null without a title."""
    return F.lower(F.concat(norm_artist(artist), F.lit("_"), norm_title(title)))


def renormalised_key(key: Column) -> Column:
    """A stored key split at its first ``_`` and normalised again."""
    parts = F.split(key, "_", 2)
    return artist_title_key(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))


def _file_name(c: Column) -> Column:
    kept = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_-]", "_"), "_+", "_")
    return F.substring(F.regexp_replace(kept, "^_+|_+$", ""), 1, 150)


def safe_filename(artist: Column, title: Column) -> Column:
    """Lower case, anything but letters, digits, ``-`` and ``_`` as one ``_``, none at the ends, 150 characters at most."""
    return _file_name(F.concat_ws("_", artist, title))


def _unaccented() -> dict[str, str]:
    """Characters whose canonical decomposition holds an ASCII character, with that one."""
    found = ((chr(c), [x for x in unicodedata.normalize("NFD", chr(c)) if x < "\x80"]) for c in range(0x80, 0x2FFF))
    return {c: x[0] for c, x in found if x}


ACCENTED = _unaccented()


def _ascii(c: Column) -> Column:
    """Accents taken off, and characters dropped that are not ASCII then."""
    return F.regexp_replace(F.translate(c, "".join(ACCENTED), "".join(ACCENTED.values())), r"[^\x00-\x7F]", "")


def safe_filename_ascii(artist: Column, title: Column) -> Column:
    """As ``safe_filename`` after accents are taken off."""
    return _file_name(_ascii(F.concat_ws("_", artist, title)))


def first_known(a: Column, b: Column) -> Column:
    return F.coalesce(F.nullif(a, F.lit("")), b)


def valid_bpm(primary: Column, fallback: Column) -> Column:
    """The first of both from 40 to 250, to two places."""
    return F.coalesce(F.when(primary.between(40, 250), F.round(primary, 2)), F.when(fallback.between(40, 250), F.round(fallback, 2)))


def parse_tag_input(text: Column) -> Column:
    """Comma-separated text as trimmed distinct tags."""
    return F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda t: F.trim(t)), lambda t: t != ""))


def vector_fault(v: Column, width: int) -> Column:
    """Why a vector is unusable: ``missing``, ``empty``, ``width``, ``nan``, ``inf`` or ``zero``; null if it is sound."""
    return (
        F.when(v.isNull(), "missing")
        .when(F.size(v) == 0, "empty")
        .when(F.size(v) != width, "width")
        .when(F.exists(v, lambda x: x.isNull() | F.isnan(x)), "nan")
        .when(F.exists(v, lambda x: F.abs(x) == float("inf")), "inf")
        .when(F.forall(v, lambda x: x == 0), "zero")
    )
