"""Search for what a request asks: steps of relaxation, then tracks that are inferred where too few were found."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from segue.functions import scores
from segue.operators import blocks
from segue.operators.vectors import mean_vector, nearest, unit_vectors
from segue.store import scratch, scratch_dir, written

#: The steps of relaxation: least tag score, least vibe score, and whether ranges are dropped.
STEPS = ((0, 0.65, 0.65, False), (1, 0.45, 0.45, False), (2, 0.20, 0.20, False), (3, 0.20, 0.20, True), (4, 0.0, 0.0, True))
#: How many matches make a centroid, how near to it a track must be, and what is told of inferred tracks.
REFERENCES, NEAR = 30, 0.25
BY_CENTROID, BY_FEATURES = "embedding similarity to tagged references", "audio feature proximity (untagged)"
RANGES = ("energy_low", "energy_high", "bpm_low", "bpm_high")
LAST, REFERENCE, ALL = len(STEPS) - 1, len(STEPS), len(STEPS) + 1
#: Most requests and tracks of a block: requests pass by and are not held, so their blocks only serve to keep the cores busy, and a request costs less in few large blocks of tracks.
BLOCK = 1 << 18, 1 << 19


class _Terms:
    """Which groups of tracks have a term, as written and in small letters; the latter with how often."""

    def __init__(self, own: list[list[str]]) -> None:
        exact: dict[str, list[int]] = {}
        lower: dict[str, list[int]] = {}
        for i, terms in enumerate(own):
            for t in terms:
                exact.setdefault(t, []).append(i)
                lower.setdefault(t.lower(), []).append(i)
        self.n = len(own)
        self.exact = {t: np.unique(x) for t, x in exact.items()}
        self.lower = {t: np.unique(x, return_counts=True) for t, x in lower.items()}

    def share(self, wanted: dict[str, float]) -> np.ndarray:
        """The scores of each group's terms, of the sum of all wanted; of terms that differ in case the greatest score counts."""
        got = np.zeros(self.n)
        for t, s in {t.lower(): s for t, s in sorted(wanted.items(), key=lambda x: (x[1], x[0]))}.items():
            if t in self.lower:
                at, times = self.lower[t]
                got[at] += s * times
        return got / (sum(wanted.values()) or 1.0)

    def having(self, terms: tuple[str, ...]) -> np.ndarray | None:
        """The groups with any of these terms, in order; none if no term is wanted, as then all pass."""
        if not terms:
            return None
        found = [self.exact[t] for t in terms if t in self.exact]
        if len(found) < 2:
            return found[0] if found else np.zeros(0, np.int64)
        any_ = np.zeros(self.n, bool)
        for at in found:
            any_[at] = True
        return np.flatnonzero(any_)


def _near(value: np.ndarray, low: float, high: float, least: float, weight: float) -> np.ndarray:
    return np.nan_to_num(np.maximum(0.0, 1 - np.abs(value - (low + high) / 2) / max(high - low, least)) * weight)


class _Ranges:
    """What a request's ranges give each track of a block, which tracks lie in them (none: all do), and of each group how many do and the most that one gets; the same of all its tracks."""

    def __init__(self, block: _Block, energy: tuple | None, bpm: tuple | None) -> None:
        self.parts, self.fits = [], None
        if energy:
            self.parts.append(block.nearness(*energy))
            self.fits = (block.energy >= energy[0]) & (block.energy <= energy[1])
        if bpm:
            self.parts.append(_near(block.bpm, *bpm, 10.0, 0.08))
            fits = np.isnan(block.bpm) | ((block.bpm >= bpm[0]) & (block.bpm <= bpm[1]))
            self.fits = fits if self.fits is None else self.fits & fits
        first, sizes = block.starts[:-1], np.diff(block.starts)
        near = sum(self.parts, np.zeros(len(block.ids)))
        self.sizes, self.most = {True: sizes, False: sizes}, dict.fromkeys((True, False), np.maximum.reduceat(near, first))
        if self.parts:
            self.sizes[False], self.most[False] = np.add.reduceat(self.fits.astype(np.int64), first), np.maximum.reduceat(np.where(self.fits, near, -np.inf), first)


class _Block:
    """A block of labelled tracks. Those with the same tags and vibes are a group, which has or lacks a term as a whole; a group's tracks lie together, by id.

    So terms are looked up for groups, and of the tracks only those of groups are scored that can be among the best.
    """

    def __init__(self, rows: list[pa.RecordBatch]) -> None:
        groups: dict[str, int] = {}
        of, ids, energy, bpm = [], [], [], []
        for batch in rows:
            terms, e, b = batch.column("own").flatten()
            of.append(np.array([groups.setdefault(t, len(groups)) for t in terms.to_pylist()]))
            ids.append(batch.column("id").to_numpy())
            energy.append(e.to_numpy(zero_copy_only=False).astype(float))
            bpm.append(b.to_numpy(zero_copy_only=False).astype(float))
        group, id_ = np.concatenate(of), np.concatenate(ids)
        order = np.lexsort((id_, group))
        self.ids, self.energy, self.bpm = id_[order], np.concatenate(energy)[order], np.concatenate(bpm)[order]
        self.order = order  # which row lies at each place
        self.starts = np.searchsorted(group[order], np.arange(len(groups) + 1))
        own = [json.loads(g) for g in groups]
        self.tags, self.vibes = (_Terms([g.get(c) or () for g in own]) for c in ("tags", "vibes"))
        self.kept: dict[tuple, _Ranges] = {}

    def nearness(self, low: float, high: float) -> np.ndarray:
        """What a range of energy gives each track."""
        return _near(self.energy, low, high, 0.1, 0.12)

    def ranges(self, asked: dict) -> _Ranges:
        """Requests share few ranges, of which some are kept."""
        key = tuple((low, high) if low is not None and high is not None else None for low, high in ((asked.get(f"{c}_low"), asked.get(f"{c}_high")) for c in ("energy", "bpm")))
        if key not in self.kept:
            if len(self.kept) >= 8:
                self.kept.clear()
            self.kept[key] = _Ranges(self, *key)
        return self.kept[key]

    def passing(self, tags: tuple[str, ...], vibes: tuple[str, ...]) -> np.ndarray | None:
        """The groups that have a wanted tag and a wanted vibe; what is not asked for does not exclude."""
        at, other = self.tags.having(tags), self.vibes.having(vibes)
        if at is None or other is None:
            return other if at is None else at
        both = np.zeros(self.tags.n, bool)
        both[at] = True
        return other[both[other]]

    def counts(self, asked: dict) -> list[int]:
        """How many tracks pass each step."""
        near, seen = self.ranges(asked), {}
        for key in (keys := [_step(asked, i) for i, *_ in STEPS]):
            if key not in seen:
                at, sizes = self.passing(*key[:2]), near.sizes[key[2]]
                seen[key] = int(sizes.sum() if at is None else sizes[at].sum())
        return [seen[key] for key in keys]

    def shares(self, asked: dict) -> np.ndarray:
        """What the terms give each group."""
        tags, vibes = asked["tags"], asked["vibes"]
        if not (tags or vibes or self.ranges(asked).parts):
            return np.full(self.tags.n, 0.5)
        out = 0.45 * self.tags.share(tags) if tags else np.zeros(self.tags.n)
        return out + 0.35 * self.vibes.share(vibes) if vibes else out

    def rounded(self, score: np.ndarray) -> np.ndarray:
        """1 at most, three places, in place."""
        np.minimum(1.0, score, out=score)
        score *= 1000
        score += 0.5
        np.floor(score, out=score)
        score /= 1000
        return score

    def least(self, score: float) -> float:
        """What a group's shares and ranges must add up to, for a track of it to have this score, which is rounded to three places."""
        return score - 0.0006

    def scored(self, groups: np.ndarray, shares: np.ndarray, near: _Ranges, all_: bool) -> tuple[np.ndarray, np.ndarray]:
        """The places of the groups' tracks (but for ``all_`` those in the ranges), and their scores."""
        sizes = self.starts[groups + 1] - self.starts[groups]
        places = np.arange(sizes.sum()) + np.repeat(self.starts[groups] - (np.cumsum(sizes) - sizes), sizes)
        score = np.repeat(shares[groups], sizes)
        if not all_ and near.fits is not None:
            inside = near.fits[places]
            places, score = places[inside], score[inside]
        for part in near.parts:
            score += part[places]
        return places, self.rounded(score)

    def best(self, at: np.ndarray | None, shares: np.ndarray, near: _Ranges, all_: bool, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``n`` best tracks of the groups, in order. Groups come in the order of the most that a track of theirs may score, until no other can have one as good."""
        upper = shares + near.most[all_] if at is None else shares[at] + near.most[all_][at]
        if not all_ and near.parts:
            some = np.flatnonzero(upper > -np.inf)
            at, upper = some if at is None else at[some], upper[some]
        at = np.arange(len(upper)) if at is None else at
        if not len(at):
            return self.ids[:0], np.zeros(0)
        first = np.argpartition(upper, len(at) - n)[len(at) - n :] if len(at) > n else np.arange(len(at))  # these have n tracks at least, if there are as many
        first = first[np.argsort(-upper[first])]
        first = first[: np.searchsorted(np.cumsum(near.sizes[all_][at[first]]), n) + 1]
        places, score = self.scored(at[first], shares, near, all_)  # of these the best are sure, unless a group that is left out may have better ones
        if len(first) < len(at):
            rest = upper >= (self.least(np.partition(score, len(score) - n)[len(score) - n]) if len(score) >= n else -np.inf)
            rest[first] = False
            rest = np.flatnonzero(rest)
            if len(rest):
                more = self.scored(at[rest], shares, near, all_)
                places, score = np.concatenate([places, more[0]]), np.concatenate([score, more[1]])
        if len(score) > n:
            least = np.partition(score, len(score) - n)[len(score) - n]
            over, even = np.flatnonzero(score > least), np.flatnonzero(score == least)
            lack = n - len(over)
            even = even[np.argpartition(self.ids[places[even]], lack - 1)[:lack]] if lack < len(even) else even
            some = np.concatenate([over, even])
            places, score = places[some], score[some]
        order = np.lexsort((self.ids[places], -score))
        return self.ids[places[order]], score[order]


def _asked_for(text: str) -> dict:
    """What is asked, out of JSON, where nulls are left out and numbers that are not finite are text."""
    asked = json.loads(text)
    asked |= {c: {x["term"]: float(x["score"]) for x in asked.get(c) or () if x.get("score") is not None} for c in ("tags", "vibes")}
    return asked | {c: None if asked.get(c) is None else float(asked[c]) for c in RANGES}


def _step(asked: dict, step: int) -> tuple[tuple[str, ...], tuple[str, ...], bool]:
    """The tags and vibes of which a step wants one each, and whether it drops the ranges. References have the full lists, and there is a step that all tracks pass."""
    if step == ALL:
        return (), (), True
    if step == REFERENCE:
        return tuple(asked["all_tags"]), tuple(asked["all_vibes"]), False
    _, tags, vibes, dropped = STEPS[step]
    return tuple(t for t, s in asked["tags"].items() if s >= tags), tuple(t for t, s in asked["vibes"].items() if s >= vibes), dropped


def _asked(requests: DataFrame) -> DataFrame:
    """``id, asked, track_count``. Without lists of their own (``semantic_tags``, ``vibes``), the terms of the score maps are the lists."""
    entries = lambda c: F.transform(F.map_entries(c), lambda x: F.struct(x["key"].alias("term"), x["value"].cast("double").alias("score")))
    terms = lambda own, c: F.coalesce(F.col(own) if own in requests.columns else F.lit(None).cast("array<string>"), F.map_keys(c), F.array().cast("array<string>"))
    asked = F.struct(
        entries("tag_scores").alias("tags"), entries("vibe_scores").alias("vibes"), terms("semantic_tags", "tag_scores").alias("all_tags"), terms("vibes", "vibe_scores").alias("all_vibes"),
        *(F.col(c).cast("double").alias(c) for c in RANGES),
    )
    return requests.select(F.col("request_id").alias("id"), asked.alias("asked"), F.greatest(F.coalesce(F.col("track_count").cast("int"), F.lit(5)), F.lit(1)).alias("track_count"))


def _met(asking: DataFrame, labels: DataFrame, tracks: DataFrame, visit: Callable[[_Block, dict], Iterator[tuple]], block: tuple[int, int]) -> DataFrame:
    """``request_id, step, n, best``: what a visit of each request to each block of tracks tells of a step: a number, and tracks in order as ids and scores (``minus`` is a score's negative)."""
    terms = F.to_json(F.struct(F.col("semantic_tags").alias("tags"), F.col("vibe").alias("vibes"))).alias("terms")  # one column is much faster to hand over than nested ones
    own = labels.join(tracks.select("trackid", "bpm"), "trackid", "left").select(F.col("trackid").alias("id"), F.struct(terms, (F.col("energy").cast("double") / 10).alias("energy"), F.col("bpm").cast("double").alias("bpm")).alias("own"))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, lists = None, [], None
        for at, asks, rows in blocks.slices(batches):
            if at != place:
                place, held, lists = at, [], None
            if not asks:
                held.append(rows)
                continue
            if held:
                lists, held = _Block(held), []
            if lists is None:
                continue
            out: list[tuple] = []
            for id_, asked in zip(rows.column("id").to_pylist(), rows.column("asked").to_pylist(), strict=True):
                out += [(id_, *x) for x in visit(lists, _asked_for(asked))]
            if out:
                *told, ids, scores = zip(*out, strict=True)
                ends = np.cumsum([0, *map(len, ids)])
                best = pa.StructArray.from_arrays([pa.array(-np.concatenate(scores)), pa.array(np.concatenate(ids))], ["minus", "trackid"])
                yield pa.RecordBatch.from_arrays([*map(pa.array, told, (pa.int64(), pa.int32(), pa.int64())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), best)], names=["request_id", "step", "n", "best"])

    return blocks.dealt(asking.select("id", F.to_json("asked").alias("asked")), own, block, whole=True).mapInArrow(searched, "request_id long, step int, n long, best array<struct<minus:double,trackid:long>>")


def _counted(asking: DataFrame, labels: DataFrame, tracks: DataFrame, block: tuple[int, int]) -> DataFrame:
    """``request_id, n0, n1 ...``: how many tracks pass each step."""
    none = np.zeros(0, np.int64), np.zeros(0)
    met = _met(asking, labels, tracks, lambda lists, asked: [(i, n, *none) for i, n in enumerate(lists.counts(asked))], block)
    return met.groupBy("request_id").agg(*(F.sum(F.when(F.col("step") == i, F.col("n"))).alias(f"n{i}") for i, *_ in STEPS))


def _listed(asking: DataFrame, labels: DataFrame, tracks: DataFrame, block: tuple[int, int]) -> DataFrame:
    """``request_id, step, best``: in order as many ``(minus, trackid)`` as a request (``asked.wants``) wants of a step, by score and id. A block tells lists, not rows."""

    def best(lists: _Block, asked: dict) -> Iterator[tuple]:
        shares, near = lists.shares(asked), lists.ranges(asked)
        for want in asked["wants"]:
            tags, vibes, all_ = _step(asked, want["step"])
            yield want["step"], want["n"], *lists.best(lists.passing(tags, vibes), shares, near, all_, want["n"])

    met = _met(asking, labels, tracks, best, block)
    return met.groupBy("request_id", "step").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), F.lit(1), F.max("n").cast("int")).alias("best"))


def _wanting(asking: DataFrame, wants: DataFrame) -> DataFrame:
    """Requests with what they want: ``wants`` is ``request_id, step, n``."""
    own = wants.groupBy(F.col("request_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("step", "n"))).alias("wants"))
    return asking.join(own.hint("merge"), "id").select("id", F.col("asked").withField("wants", F.col("wants")).alias("asked"))


def _ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy(*order)))


def _rows(df: DataFrame, best: Column, *columns: str) -> DataFrame:
    """The columns, and ``trackid, score, rank`` of each entry of a list."""
    return df.select(*columns, F.posexplode(best).alias("at", "x")).select(*columns, "x.trackid", (-F.col("x.minus")).alias("score"), (F.col("at") + 1).alias("rank"))


def relevance(requests: DataFrame, labels: DataFrame, tracks: DataFrame, block: tuple[int, int] = BLOCK) -> DataFrame:
    """``request_id, trackid, score, rank``: for each request as many labelled tracks as it asks for, by how well they match all of it.

    Tags give up to .45, vibes .35, energy .12 and tempo .08; the sum is 1 at most and has three places; a request for nothing gives .5 to all.
    No table is joined on terms, so a term that very many tracks have costs no more than others. Requests that ask for the same, if not as many, are answered once.
    """
    path = scratch_dir(requests.sparkSession)
    with scratch(requests.sparkSession):
        asking, members = blocks.distinct(written(_asked(requests)))
        wants = members.groupBy(F.col("first").alias("request_id")).agg(F.lit(ALL).alias("step"), F.max("track_count").alias("n"))
        lists = _listed(_wanting(asking, wants), labels, tracks, block).select(F.col("request_id").alias("first"), "best")
        told = members.hint("merge").join(lists, "first")
        return written(_rows(told, F.slice("best", F.lit(1), F.col("track_count")), "request_id").select("request_id", "trackid", "score", "rank"), path, keep=True)


def score_detail(found: DataFrame, requests: DataFrame, labels: DataFrame) -> DataFrame:
    """``request_id, trackid, matched_tags, matched_vibes``: for rows ``request_id, trackid``, the track's own terms that the request scores, with the scores (two places)."""
    lower = lambda m: F.transform(F.map_entries(m), lambda x: F.struct(F.lower(x["key"]).alias("term"), x["value"].cast("double").alias("score")))
    asked = requests.select("request_id", lower("tag_scores").alias("tags"), lower("vibe_scores").alias("vibes"))
    own = labels.select("trackid", "semantic_tags", "vibe")

    def matched(terms: str, wanted: str) -> Column:
        score = lambda t: F.array_max(F.transform(F.filter(wanted, lambda w: w["term"] == F.lower(t)), lambda w: w["score"]))
        hit = F.filter(F.array_distinct(F.coalesce(F.col(terms), F.array().cast("array<string>"))), lambda t: F.exists(wanted, lambda w: w["term"] == F.lower(t)))
        return F.map_from_entries(F.transform(hit, lambda t: F.struct(t.alias("key"), F.round(score(t), 2).alias("value"))))

    return found.join(asked, "request_id").join(own, "trackid").select("request_id", "trackid", matched("semantic_tags", "tags").alias("matched_tags"), matched("vibe", "vibes").alias("matched_vibes"))


def relaxation_search(requests: DataFrame, labels: DataFrame, tracks: DataFrame, vectors: DataFrame | None = None, vector: str = "feat", block: tuple[int, int] = BLOCK) -> DataFrame:
    """``request_id, trackid, score, step, rank, inferred, reason``: as many tracks for each request as it asks for, if the library has them.

    A step lets labelled tracks pass that have a tag among those of at least the step's score and a vibe likewise, and lie in the ranges; a list that
    is empty at a step excludes nothing, so a later step may let fewer pass. The first step with enough tracks counts, else the last one; tracks are
    ranked by the full request in any case. Slots that stay empty are filled with further tracks: those nearest to the mean vector of up to
    ``REFERENCES`` tracks that match the request's full lists and ranges and were not found, or, where there are no such vectors (or ``vectors`` is not
    given), the nearest in energy and tempo.

    Requests and tracks meet in pairs of blocks, where terms are lists of groups of tracks: first to count who passes each step, then for the best of the steps that
    count. Requests that ask for the same, if not as many, are answered once: whoever asks for fewer has the first of the others' tracks.
    """
    path = scratch_dir(requests.sparkSession)
    with scratch(requests.sparkSession):
        asking, members = blocks.distinct(written(_asked(requests)))
        sums = written(_counted(asking, labels, tracks, block)).withColumnRenamed("request_id", "first")
        k, last = F.col("track_count"), F.coalesce(F.col(f"n{LAST}"), F.lit(0))
        step = F.coalesce(*(F.when(F.col(f"n{i}") >= k, i) for i, *_ in STEPS), F.lit(LAST))
        counted = members.hint("merge").join(sums, "first", "left").select("request_id", "first", "track_count", step.alias("step"), last.cast("int").alias("held"))
        plan = written(counted.withColumn("needed", F.when(F.col("step") == LAST, F.greatest(k - F.col("held"), F.lit(0))).otherwise(0).cast("int")))
        by_request = plan.groupBy(F.col("first").alias("request_id"))
        sparse = written(by_request.agg(F.max("needed").alias("needed"), F.max("track_count").alias("track_count")).where("needed > 0").join(asking.withColumnRenamed("id", "request_id").hint("merge"), "request_id"))
        wants = plan.groupBy(F.col("first").alias("request_id"), "step").agg(F.max("track_count").alias("n")).unionByName(sparse.select("request_id", F.lit(REFERENCE).alias("step"), F.lit(REFERENCES).alias("n")))
        lists = written(_listed(_wanting(asking, wants), labels, tracks, block))
        told = plan.hint("merge").join(lists.withColumnRenamed("request_id", "first"), ["first", "step"])
        answers = [_rows(told, F.slice("best", F.lit(1), F.col("track_count")), "request_id", "step").select("request_id", "trackid", "score", "step", "rank", F.lit(False).alias("inferred"), F.lit(None).cast("string").alias("reason"))]
        few = lists.join(sparse.select("request_id"), "request_id", "left_semi")
        found = written(_rows(few.where(F.col("step") == LAST), F.col("best"), "request_id"))
        filled = []
        if vectors is not None:
            references = _rows(few.where(F.col("step") == REFERENCE), F.col("best"), "request_id")
            centres = written(_centres(references, found, vectors, vector))
            filled.append(infer_by_centroid(centres, found, sparse, vectors, vector))
            sparse = sparse.join(centres, "request_id", "left_anti")
        filled.append(infer_by_features(found, sparse, labels, tracks))
        for x in filled:
            more = plan.where("needed > 0").join(x.select(F.col("request_id").alias("first"), "trackid", "score", F.col("rank").alias("nth"), "reason"), "first").where("nth <= needed")
            answers.append(more.select("request_id", "trackid", "score", F.lit(LAST).alias("step"), (F.col("nth") + F.col("held")).cast("int").alias("rank"), F.lit(True).alias("inferred"), "reason"))
        return written(reduce(DataFrame.unionByName, answers), path, keep=True)


def _centres(references: DataFrame, found: DataFrame, vectors: DataFrame, vector: str) -> DataFrame:
    """``request_id, unit``: the direction of the mean vector of each request's best references that were not found."""
    best = _ranked(references, [F.desc("score"), F.col("trackid")]).where(F.col("rank") <= REFERENCES)
    fresh = best.join(found.select("request_id", "trackid"), ["request_id", "trackid"], "left_anti")
    means = mean_vector(fresh.join(vectors.where(F.col(vector).isNotNull()), "trackid"), "request_id", vector)
    return means.select("request_id", scores.unit(F.col("mean")).alias("unit"))


def infer_by_centroid(centres: DataFrame, found: DataFrame, sparse: DataFrame, vectors: DataFrame, vector: str = "feat") -> DataFrame:
    """``request_id, trackid, score, rank, reason``: the tracks nearest to a request's centre (``request_id, unit``), but for those found; as many as
    ``sparse`` says are ``needed``. What was found and what is needed make up the count asked for, so that many neighbours are enough."""
    most = sparse.agg(F.coalesce(F.max("track_count"), F.lit(1))).first()[0]
    units = unit_vectors(vectors, vector)
    near = nearest(centres.select(F.col("request_id").alias("seed"), "unit"), units.select(F.col("trackid").alias("neighbour"), "unit"), most, NEAR, same=True)
    sims = near.select(F.col("seed").alias("request_id"), F.col("neighbour").alias("trackid"), "sim").join(found.select("request_id", "trackid"), ["request_id", "trackid"], "left_anti")
    ranked = _ranked(sims.join(sparse.select("request_id", "needed"), "request_id"), [F.desc("sim"), F.col("trackid")]).where(F.col("rank") <= F.col("needed"))
    return ranked.select("request_id", "trackid", F.round("sim", 3).alias("score"), "rank", F.lit(BY_CENTROID).alias("reason"))


def infer_by_features(found: DataFrame, sparse: DataFrame, labels: DataFrame, tracks: DataFrame) -> DataFrame:
    """``request_id, trackid, score, rank, reason``: the tracks nearest in energy and tempo to the middle of the request's ranges, none of them found.

    Tracks of one energy and tempo score alike, so each such cell keeps only as many of its smallest ids as the largest request asks for;
    cells meet the distinct targets in pairs of blocks, not tracks the requests.
    """
    wanted = sparse.select("request_id", "needed", "track_count", *((F.col(f"asked.{c}_low") + F.col(f"asked.{c}_high")).alias(c) for c in ("energy", "bpm")))
    wanted = wanted.withColumns({"energy": F.col("energy") / 2, "bpm": F.col("bpm") / 2}).withColumn("target", F.xxhash64("energy", "bpm"))
    most = wanted.agg(F.coalesce(F.max("track_count"), F.lit(0))).first()[0]
    if not most:
        return found.select("request_id", "trackid", "score", F.col("rank"), F.lit(BY_FEATURES).alias("reason")).limit(0)
    own = tracks.select("trackid", F.col("bpm").cast("double").alias("bpm")).join(labels.select("trackid", (F.col("energy").cast("double") / 10).alias("energy")), "trackid", "left")
    first = own.withColumn("nth", F.row_number().over(Window.partitionBy("energy", "bpm", F.pmod(F.xxhash64("trackid"), F.lit(32))).orderBy("trackid"))).where(F.col("nth") <= most)
    cells = first.groupBy("energy", "bpm").agg(F.slice(F.array_sort(F.collect_list("trackid")), 1, most).alias("ids"))
    targets = wanted.select("target", "energy", "bpm").distinct()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for rows, asking in blocks.pairs(batches):
            if rows is not held:
                held = rows
                energy, bpm = (np.array([np.nan if r[1][c] is None else r[1][c] for r in rows], float) for c in ("energy", "bpm"))
                ids = [r[1]["ids"] for r in rows]
            out: list[tuple] = []
            for target, at in asking:
                score = np.full(len(ids), 0.5)
                if at["energy"] is not None:
                    score += np.nan_to_num(np.maximum(0.0, 0.5 - np.abs(energy - at["energy"])))
                if at["bpm"] is not None:
                    score += np.nan_to_num(np.maximum(0.0, 0.5 - np.abs(bpm - at["bpm"]) / 30.0))
                score = np.floor(np.minimum(1.0, score) * 1000 + 0.5) / 1000
                taken: list[tuple] = []
                for s in -np.unique(-score):  # from the best score down, all cells of a score together
                    taken += sorted((t, float(s)) for i in np.flatnonzero(score == s).tolist() for t in ids[i])[: most - len(taken)]
                    if len(taken) >= most:
                        break
                out += [(target, t, s) for t, s in taken]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["target", "trackid", "score"])

    asking = targets.select(F.col("target").alias("id"), F.struct("energy", "bpm").alias("asked"))
    near = blocks.dealt(asking, cells.select(F.xxhash64("energy", "bpm").alias("id"), F.struct("energy", "bpm", "ids").alias("own")), (1 << 18, 4096)).mapInArrow(scored, "target long, trackid long, score double")
    best = near.withColumn("nth", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("score"), "trackid"))).where(F.col("nth") <= most)
    fresh = wanted.join(best, "target").where(F.col("nth") <= F.col("track_count")).join(found.select("request_id", "trackid"), ["request_id", "trackid"], "left_anti")
    ranked = _ranked(fresh, [F.desc("score"), F.col("trackid")]).where(F.col("rank") <= F.col("needed"))
    return ranked.select("request_id", "trackid", "score", "rank", F.lit(BY_FEATURES).alias("reason"))
