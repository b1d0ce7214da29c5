"""Filters, joins, paging and edits of track tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def page(df: DataFrame, limit: int, offset: int, key: str = "trackid", cap: int = 500) -> DataFrame:
    """One page in key order, of ``cap`` rows at most, with the total and whether more follows."""
    limit = min(limit, cap)
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(key).offset(offset).limit(limit)
    return rows.join(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)  # one row


def scan_capped(df: DataFrame, cap: int = 2000, key: str = "trackid") -> DataFrame:
    return df.orderBy(key).limit(cap)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Base and changes, the first of each key in the order (latest wins) being kept."""
    return latest(base.unionByName(changes, allowMissingColumns=True), keys, order)


def insert_ignore(base: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Base with those new rows whose key it lacks, one per key."""
    return base.unionByName(latest(new, keys, order).join(base.select(*keys), keys, "left_anti").select(base.columns))


def update_from(base: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Base with the columns' new values where the updates have some."""
    new = updates.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    joined = base.join(new, key, "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns))


def cascade_delete(tables: dict[str, DataFrame], keys: DataFrame, key: str = "trackid") -> dict[str, DataFrame]:
    """Each table without the rows of the given keys."""
    gone = keys.select(key).distinct()
    return {name: df.join(gone, key, "left_anti") for name, df in tables.items()}


def deletion_report(tables: dict[str, DataFrame], keys: DataFrame, key: str = "trackid") -> DataFrame:
    """``table_name, n``: how many rows of each table go."""
    gone = keys.select(key).distinct()
    out = None
    for name, df in tables.items():
        part = df.join(gone, key, "left_semi").agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def init_labels(tracks: DataFrame) -> DataFrame:
    """An empty label row for each new track."""
    none = F.array().cast("array<string>")
    return tracks.select("trackid", none.alias("semantic_tags"), F.lit(None).cast("double").alias("energy"), none.alias("vibe"))


def with_labels(tracks: DataFrame, labels: DataFrame) -> DataFrame:
    return tracks.join(labels, "trackid", "left")


def labelled(tracks: DataFrame, labels: DataFrame) -> DataFrame:
    return tracks.join(labels, "trackid", "inner")


def labels_first(labels: DataFrame, tracks: DataFrame) -> DataFrame:
    return labels.join(tracks, "trackid", "left")


def unlabeled(tracks: DataFrame, labels: DataFrame, mode: str = "tags") -> DataFrame:
    """Tracks without tags (``tags``) or without a label row (``row``)."""
    some = labels.where(F.size("semantic_tags") > 0) if mode == "tags" else labels
    return tracks.join(some.select("trackid"), "trackid", "left_anti")


def exclude(df: DataFrame, ids: DataFrame, key: str = "trackid") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def keep(df: DataFrame, ids: DataFrame, key: str = "trackid") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def by_ids(tracks: DataFrame, asked: DataFrame, request: str = "request_id", place: str = "pos") -> DataFrame:
    """The tracks that requests name (a row for each request and place, with a ``trackid``), each request's in its own order; unknown ids give no row."""
    return asked.select(request, place, "trackid").join(tracks, "trackid").orderBy(request, place)


def bpm_between(df: DataFrame, low: float, high: float, keep_null: bool = False) -> DataFrame:
    inside = F.col("bpm").between(low, high)
    return df.where(F.col("bpm").isNull() | inside if keep_null else inside)


def energy_between(df: DataFrame, low: float, high: float) -> DataFrame:
    return df.where(F.col("energy").between(low, high))


def any_tag(df: DataFrame, tags: list[str] = (), vibes: list[str] = ()) -> DataFrame:
    """Rows with one of the tags and one of the vibes; an empty list asks nothing."""
    for column, wanted in (("semantic_tags", tags), ("vibe", vibes)):
        if wanted:
            df = df.where(F.arrays_overlap(column, F.array(*map(F.lit, wanted))))
    return df


def semantic_search(df: DataFrame, tags: list[str] = (), vibes: list[str] = (), energy: tuple | None = None, bpm: tuple | None = None, without: list[str] = ()) -> DataFrame:
    df = any_tag(df, tags, vibes)
    df = energy_between(df, *energy) if energy else df
    df = bpm_between(df, *bpm) if bpm else df
    return df.where(~F.coalesce(F.arrays_overlap("semantic_tags", F.array(*map(F.lit, without))), F.lit(False))) if without else df


def flatten_labels(labels: DataFrame, order: list[Column]) -> DataFrame:
    """The first label row of each track, vibes named ``vibe_descriptors``."""
    return latest(labels, ["trackid"], order).withColumnRenamed("vibe", "vibe_descriptors")


def track_view(tracks: DataFrame, labels: DataFrame) -> DataFrame:
    """Tracks with their labels and the defaults of a listing; ``position`` is null unless all three coordinates are known."""
    none = F.array().cast("array<string>")
    at = [F.col(c).cast("double") if c in tracks.columns else F.lit(None).cast("double") for c in ("x_coord", "y_coord", "z_coord")]
    placed = F.when(at[0].isNotNull() & at[1].isNotNull() & at[2].isNotNull(), F.array(*at))
    return with_labels(tracks, labels).select(
        "trackid", F.coalesce("title", F.lit("Unknown")).alias("title"), F.coalesce("artist", F.lit("Unknown")).alias("artist"), "bpm",
        F.coalesce("energy", F.lit(0.5)).alias("energy"), F.coalesce("semantic_tags", none).alias("tags"), F.coalesce("vibe", none).alias("vibe"), placed.alias("position"),
    )


def crate_defaults(df: DataFrame) -> DataFrame:
    """Defaults for what is null, empty or 0."""
    falsy = lambda c, d: F.when(F.col(c).isNull() | (F.col(c) == (0 if isinstance(d, float) else "")), F.lit(d)).otherwise(F.col(c)).alias(c)
    return df.select("trackid", falsy("title", "Unknown Title"), falsy("artist", "Unknown Artist"), falsy("bpm", 120.0), falsy("key", "Unknown"), falsy("energy", 0.5))


def normalise_similar(df: DataFrame, ids: list[str], score: str) -> DataFrame:
    """The first id that is not null, score .5 by default; rows without an id go."""
    return df.select(F.coalesce(*ids).alias("id"), F.coalesce(score, F.lit(0.5)).alias("score")).where("id is not null")


def track_index(tracks: DataFrame) -> DataFrame:
    """Display labels, by artist and id."""
    tempo = F.when(F.coalesce(F.col("bpm"), F.lit(0)) != 0, F.concat(F.lit("  ("), F.round("bpm").cast("long").cast("string"), F.lit(" BPM)"))).otherwise("")
    label = F.concat(F.coalesce("artist", F.lit("Unknown")), F.lit(" — "), F.coalesce("title", F.lit("Unknown")), tempo)
    return tracks.select("trackid", "artist", label.alias("label")).orderBy("artist", "trackid")


def dedupe_titles(tracks: DataFrame) -> DataFrame:
    """The first track of each title (trimmed, any case); tracks without a title go."""
    titled = tracks.where("title is not null and title != ''").withColumn("_t", F.lower(F.trim("title")))
    return latest(titled, ["_t"], [F.col("trackid")]).drop("_t")


def enrich_art(tracks: DataFrame, art: DataFrame) -> DataFrame:
    """Art addresses by the normalised artist and title; ``art`` is ``art_key, art_url``."""
    from segue.functions.clean import artist_title_key

    keyed = tracks.withColumn("art_key", artist_title_key(F.col("artist"), F.col("title")))
    return keyed.join(art, "art_key", "left").withColumn("matched", F.col("art_url").isNotNull())


def match_titles(files: DataFrame, tracks: DataFrame) -> DataFrame:
    """Tracks whose title is a file's stem; one file may match many."""
    stems = files.select("path", F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("title"))
    return stems.join(tracks, "title")


def random_unlabeled(tracks: DataFrame, labels: DataFrame, seen: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` tracks without tags in the order of a seeded hash, those not seen first (so all come again once all were seen)."""
    pool = unlabeled(tracks, labels).join(seen.select("trackid").distinct().withColumn("seen", F.lit(1)), "trackid", "left")
    return pool.orderBy(F.coalesce("seen", F.lit(0)), F.md5(F.concat_ws("/", "trackid", F.lit(seed)).cast("binary")), "trackid").limit(n).drop("seen")
