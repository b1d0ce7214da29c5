"""Text requests, in batch: keyword intents, their validation and suggestions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from segue.operators import blocks

#: Energy ranges of descriptors, in the order in which they are tried.
DESCRIPTORS = (
    ("low", 0.0, 0.3), ("chill", 0.0, 0.3), ("relaxed", 0.1, 0.4), ("laid-back", 0.1, 0.4), ("moderate", 0.3, 0.6), ("medium", 0.3, 0.6), ("groovy", 0.4, 0.7),
    ("energetic", 0.5, 0.8), ("high", 0.6, 0.9), ("driving", 0.6, 0.9), ("intense", 0.7, 1.0), ("banging", 0.8, 1.0), ("peak", 0.8, 1.0),
)
INTENT = "struct<tag_scores:map<string,double>,vibe_scores:map<string,double>,energy_range:array<double>,bpm_range:array<double>,key_compatibility:string,direction:string,track_count:int,confidence:double,reasoning:string>"


def contained(texts: DataFrame, patterns: DataFrame, block: tuple[int, int] = (4096, 20_000)) -> DataFrame:
    """``text_id, pattern``: which of ``patterns (pattern)`` each of ``texts (text_id, text)`` contains, as they are written, each once.

    Patterns are dealt into blocks, each of which is one automaton in the task that has it, and texts run through it letter by letter: no text is
    compared with single patterns. The empty pattern is in every text; null patterns and texts match nothing.
    """
    import ahocorasick

    kind = dict(texts.dtypes)["text_id"]
    asking = texts.where("text is not null").select(F.xxhash64("text_id", "text").alias("id"), F.struct(F.col("text_id").cast("string").alias("text_id"), "text").alias("asked"))
    own = patterns.where("pattern is not null").select("pattern").distinct().select(F.xxhash64("pattern").alias("id"), F.col("pattern").alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, machine, empty = None, None, False
        for rows, asking_ in blocks.pairs(batches):
            if rows is not held:
                held, machine = rows, ahocorasick.Automaton()
                for _, pattern in rows:
                    if pattern:
                        machine.add_word(pattern, pattern)
                machine.make_automaton()
                empty = any(not pattern for _, pattern in rows)
            out: list[tuple[str | None, str]] = []
            for _, asked in asking_:
                found = {p for _, p in machine.iter(asked["text"])} if len(machine) else set()
                out += [(asked["text_id"], p) for p in sorted(found | ({""} if empty else set()))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=["text_id", "pattern"])

    found = blocks.dealt(asking, own, block).mapInArrow(run, "text_id string, pattern string")
    return found.select(F.col("text_id").cast(kind).alias("text_id"), "pattern")


def matched_terms(requests: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``request_id, term``: vocabulary terms that the text contains, in any case."""
    v = vocabulary.where("tag is not null").select(F.col("tag").alias("term"), F.lower("tag").alias("pattern")).distinct()
    found = contained(requests.select(F.col("request_id").alias("text_id"), F.lower("text").alias("text")), v)
    return found.join(v, "pattern").select(F.col("text_id").alias("request_id"), "term").distinct()


def energy_range(text: Column) -> Column:
    """``low, high`` of the first descriptor that the lower-cased text contains; null without one."""
    t = F.lower(text)
    return F.coalesce(*(F.when(F.contains(t, F.lit(w)), F.struct(F.lit(lo).alias("low"), F.lit(hi).alias("high"))) for w, lo, hi in DESCRIPTORS))


def track_count(text: Column) -> Column:
    """The number before ``track``, ``song``, ``result`` or ``tune``; 5 without one, 1 at least."""
    n = F.nullif(F.regexp_extract(F.lower(text), r"(\d+)\s*(?:\w+\s+)*?(?:track|song|result|tune)s?", 1), F.lit(""))
    return F.greatest(F.lit(1), F.coalesce(n.try_cast("int"), F.lit(5)))


def parse_requests(requests: DataFrame, tags: DataFrame, vibes: DataFrame) -> DataFrame:
    """The keyword intent of each request: all terms score 1, confidence is .3 and the tempo range is open."""
    none = F.create_map().cast("map<string,double>")

    def terms(vocabulary: DataFrame, name: str) -> DataFrame:
        return matched_terms(requests, vocabulary).groupBy("request_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", F.lit(1.0))))).alias(name))

    out = requests.join(terms(tags, "tag_scores"), "request_id", "left").join(terms(vibes, "vibe_scores"), "request_id", "left")
    e = energy_range(F.col("text"))
    return out.select(
        "request_id", F.coalesce("tag_scores", none).alias("tag_scores"), F.coalesce("vibe_scores", none).alias("vibe_scores"), e["low"].alias("energy_low"), e["high"].alias("energy_high"),
        F.lit(None).cast("double").alias("bpm_low"), F.lit(None).cast("double").alias("bpm_high"), track_count(F.col("text")).alias("track_count"), F.lit(0.3).alias("confidence"),
    )


def validate_terms(wanted: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``request_id, term, score, known``: terms in the vocabulary's spelling, scores to three places; unknown ones are marked."""
    v = vocabulary.groupBy(F.lower("tag").alias("low")).agg(F.min("tag").alias("tag"))
    joined = wanted.join(v, F.lower("term") == F.col("low"), "left")
    return joined.select("request_id", F.coalesce("tag", "term").alias("term"), F.round("score", 3).alias("score"), F.col("tag").isNotNull().alias("known"))


def widened_bpm(low: Column, high: Column) -> Column:
    """A range narrower than 6 becomes four beats either way of its middle, from 1 on."""
    mid = (low + high) / 2
    return F.when(F.round(high - low, 6) < 6, F.struct(F.greatest(F.lit(1.0), mid - 4).alias("low"), (mid + 4).alias("high"))).otherwise(F.struct(low.alias("low"), high.alias("high")))


def with_defaults(intents: DataFrame, context: DataFrame) -> DataFrame:
    """Confidence .7, five tracks (one at least), and, where no kind of key is asked for and a track is playing, keys that go with its own.

    ``context`` is ``request_id, context_key``; the key to go with is ``reference_key``.
    """
    joined = intents.join(context, "request_id", "left")
    implied = F.col("key_compatibility").isNull() & F.col("context_key").isNotNull()
    given = F.col("reference_key") if "reference_key" in intents.columns else F.lit(None).cast("string")
    return joined.withColumns({
        "confidence": F.coalesce("confidence", F.lit(0.7)), "track_count": F.greatest(F.lit(1), F.coalesce("track_count", F.lit(5))),
        "reference_key": F.when(implied, F.col("context_key")).otherwise(given), "key_compatibility": F.when(implied, "compatible").otherwise(F.col("key_compatibility")),
    }).drop("context_key")


def suggest_similar(inputs: DataFrame, tags: DataFrame, vibes: DataFrame, n: int = 5) -> DataFrame:
    """``input, tag, kind, rank``: terms that contain an input or lie within it, in any case, tags before vibes; ``n`` of them."""
    v = tags.select("tag", F.lit(0).alias("kind")).unionByName(vibes.select("tag", F.lit(1).alias("kind"))).where("tag is not null")
    a = inputs.where("input is not null").select("input", F.lower("input").alias("low_input")).distinct()
    b = v.select("tag", "kind", F.lower("tag").alias("low_tag"))
    low_a, low_b = a.select("low_input").distinct(), b.select("low_tag").distinct()
    within = contained(low_a.select(F.col("low_input").alias("text_id"), F.col("low_input").alias("text")), low_b.select(F.col("low_tag").alias("pattern"))).select(F.col("text_id").alias("low_input"), F.col("pattern").alias("low_tag"))
    around = contained(low_b.select(F.col("low_tag").alias("text_id"), F.col("low_tag").alias("text")), low_a.select(F.col("low_input").alias("pattern"))).select(F.col("pattern").alias("low_input"), F.col("text_id").alias("low_tag"))
    pairs = within.unionByName(around).distinct().join(a, "low_input").join(b, "low_tag")
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("input").orderBy("kind", "tag"))).where(F.col("rank") <= n).select("input", "tag", "kind", "rank")


def intents_from_json(df: DataFrame, column: str = "json") -> DataFrame:
    """Intents out of JSON text; a text that is no JSON gives nulls."""
    return df.withColumn("intent", F.from_json(column, INTENT, {"mode": "PERMISSIVE"})).select("*", "intent.*").drop("intent")


def relaxed_terms(wanted: DataFrame, least: float) -> DataFrame:
    """A step of relaxation: the terms whose score reaches its threshold."""
    return wanted.where(F.col("score") >= least)
