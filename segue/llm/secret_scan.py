"""Secret scanning with DataFrame functions alone: base patterns, and character Markov models for what they miss.

Positions come from ``split`` and ``regexp_extract_all`` of one pattern: the lengths of the parts between matches and of
the matches, added up, are the code-point offsets. Random strings that no base pattern covers are found by two character
Markov models (one of random strings, one of ordinary identifiers): a token counts as random if the log-likelihood ratio
of its transitions is high, in total and on average. The models are transition counts, so they are tables of fixed size.

Work grows with a text's length (times the logarithm of its spans): running sums are made by doubling, never by growing an array for each
match, and characters are split off once, never looked up by place. A null text is an empty text (no spans). Rows are independent: ties,
repeated rows and further columns need no rule.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from segue.llm.common import sample, scratch, written

#: The base patterns by kind, with the least length of what the group captures.
#: For ``access`` and ``hex`` a run's length is part of the pattern: a run is matched whole from its start, so a failing run hides none that passes.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
KINDS = (*(k for k, *_ in BASE), "random")
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
#: The symbols of the models; any other character counts as one further symbol.
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, the value being worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, both: Callable[[Column, Column], Column], forward: bool = True) -> Column:
    """Running results from the left (or right), by doubling: some ``n log n`` steps, where growing an array would take a square of them."""
    way = 1 if forward else -1
    rounds = F.when(F.size(values) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(values))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))

    def step(acc: Column, k: Column) -> Column:
        def value(x: Column, i: Column) -> Column:
            other = F.get(acc, i - way * F.pow(F.lit(2), k).cast("int"))
            return F.when(other.isNull(), x).otherwise(both(x, other))

        return F.transform(acc, value)

    return F.aggregate(rounds, values, step)


def spans(text: Column, pattern: str, group: int = 0, least: int = 1) -> Column:
    """The pattern's matches from the left, not overlapping, as an array of ``(start, end, value)``; ``value`` is the group, of ``least`` characters or more."""
    p = F.lit(pattern)
    parts, whole, value = F.split(text, pattern, -1), F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(group))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    matches = F.filter(F.arrays_zip(parts.alias("a"), whole.alias("b"), value.alias("c")), lambda z: z["b"].isNotNull())

    def placed(m: Column) -> Column:
        ends = running(F.transform(m, lambda z: F.length(z["a"]) + F.length(z["b"])), lambda x, y: x + y)
        return F.zip_with(m, ends, lambda z, e: F.struct((e - F.length(z["b"])).alias("start"), e.alias("end"), z["c"].alias("value")))

    return F.when(text.rlike(pattern), F.filter(let(matches, placed), lambda s: F.length(s["value"]) >= least)).otherwise(none)


def base_spans(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, text``, further columns to ``keep``, and one array of spans per base kind."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *keep)
    return texts.select("doc_id", "text", *keep, *(spans(F.col("text"), p, g, n).alias(k) for k, p, g, n in BASE))


def _symbols(token: Column) -> Column:
    """The numbers of a token's symbols."""
    return F.transform(F.split(token, ""), lambda c: F.instr(F.lit(SYMBOLS), c))


def train(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratios of symbol transitions, random against ordinary, from labelled samples ``token, random``.

    The result is a square table laid out row by row (0 is any other symbol); counts are smoothed, so a class without
    samples is the uniform model.
    """
    n = len(SYMBOLS) + 1
    coded = samples.where(F.length("token") > 1).select(F.col("random").cast("boolean").alias("random"), _symbols(F.col("token")).alias("s"))
    pairs = F.zip_with(F.slice("s", F.lit(1), F.size("s") - 1), F.slice("s", F.lit(2), F.size("s") - 1), lambda a, b: a * n + b)
    counted = coded.select("random", F.explode(pairs).alias("pair")).groupBy("random", "pair").count()
    table = {True: [smoothing] * (n * n), False: [smoothing] * (n * n)}
    for r in counted.collect():  # 2 * n * n rows at most
        table[r["random"]][r["pair"]] += r["count"]

    def logs(kind: bool) -> list[float]:
        rows = [table[kind][a * n : (a + 1) * n] for a in range(n)]
        return [math.log(c / sum(row)) for row in rows for c in row]

    return [round(a - b, 4) for a, b in zip(logs(True), logs(False), strict=True)]


def ratio(token: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of a token's transitions."""
    n = len(SYMBOLS) + 1
    ratios = F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>")
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    add = lambda acc, c: F.struct(c.alias("last"), (acc["sum"] + F.when(acc["last"] < 0, 0.0).otherwise(F.get(ratios, acc["last"] * n + c))).alias("sum"))
    return F.aggregate(_symbols(token), start, add, lambda acc: acc["sum"])


def apart(tokens: Column, others: Column) -> Column:
    """The tokens that touch none of the others, all being spans: both are put in one order, and for each token the greatest end before it and the least start after it tell."""
    none = F.lit(2**31 - 1)
    both = F.array_sort(F.concat(F.transform(others, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("own"), s["end"].alias("end"), F.lit("").alias("value"))), F.transform(tokens, lambda t: F.struct(t["start"].alias("start"), F.lit(1).alias("own"), t["end"].alias("end"), t["value"].alias("value")))))

    def judged(x: Column) -> Column:
        before = running(F.transform(x, lambda z: F.when(z["own"] == 0, z["end"]).otherwise(0)), lambda p, q: F.greatest(p, q))
        after = running(F.transform(x, lambda z: F.when(z["own"] == 0, z["start"]).otherwise(none)), lambda p, q: F.least(p, q), forward=False)
        kept = F.filter(F.arrays_zip(x.alias("x"), before.alias("b"), after.alias("a")), lambda z: (z["x"]["own"] == 1) & (z["b"] <= z["x"]["start"]) & (z["a"] >= z["x"]["end"]))
        return F.transform(kept, lambda z: F.struct(z["x"]["start"].alias("start"), z["x"]["end"].alias("end"), z["x"]["value"].alias("value")))

    return F.when((F.size(tokens) == 0) | (F.size(others) == 0), tokens).otherwise(let(both, judged))


def corpus_samples(docs: DataFrame, sample_docs: int = 2000) -> DataFrame:
    """Labelled samples ``token, random`` (to be used inside a ``scratch`` block, where the sample is written) from at most ``sample_docs`` documents, drawn by a hash of id and text.

    Ordinary identifiers are the documents' words outside base spans, and four of them at a time, at some forty places all over a
    text, joined as names are: in camel
    case, with ``_``, ``-`` or ``/``, and in capitals; and days and versions. Random strings are the values of base spans and, since
    these show few alphabets, digests of the texts in hexadecimal (either case), Base64, Base64 without signs, letters and
    digits of one case, and digits.
    """
    some = base_spans(written(sample(docs.select("doc_id", "text"), sample_docs)).repartition(16))
    pattern = "|".join(f"(?:{p})" for _, p, *_ in BASE)
    rest = F.regexp_replace("text", pattern, " ")
    words = some.select(F.explode(F.regexp_extract_all(rest, F.lit(r"[A-Za-z0-9+/_=-]{6,}"), F.lit(0))).alias("token"), F.lit(False).alias("random"))
    plain = F.filter(F.regexp_extract_all(F.lower(rest), F.lit(r"[a-z]{2,12}"), F.lit(0)), lambda w: F.length(w) > 0)
    listed = some.select(plain.alias("w"), F.abs(F.xxhash64("doc_id", "text") % 10_000).alias("n")).where("size(w) >= 4")
    fours = listed.select("n", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - 3, F.greatest(F.lit(4), F.ceil(F.size("w") / 40).cast("int"))), lambda i: F.slice("w", i, 4))).alias("i", "w"))
    titled = F.transform("w", lambda x: F.initcap(x))
    day = F.concat_ws("-", (2000 + F.col("n") % 30).cast("string"), F.lpad((1 + F.col("i") % 12).cast("string"), 2, "0"), F.lpad((1 + F.col("n") % 28).cast("string"), 2, "0"))
    named = F.array(
        F.array_join(titled, ""), F.concat(F.element_at("w", 1), F.array_join(F.slice(titled, 2, 3), "")), F.array_join("w", "_"), F.array_join("w", "-"), F.array_join("w", "/"), F.upper(F.array_join("w", "_")),
        F.concat(F.lit("/"), F.array_join("w", "/"), F.lit("/"), day), F.concat(F.array_join(F.slice("w", 1, 2), "_"), F.lit("_"), day), F.concat(F.array_join(F.slice(titled, 1, 3), ""), (F.col("i") % 10).cast("string")),
    )
    made = fours.select(F.explode(named).alias("token"), F.lit(False).alias("random"))
    known = some.select(F.explode(F.concat(*(F.transform(k, lambda s: s["value"]) for k, *_ in BASE))).alias("token"), F.lit(True).alias("random"))
    digest = F.sha2(F.concat_ws("/", F.col("doc_id").cast("string"), "text"), 256)
    base64 = F.base64(F.unhex(digest))
    bare = F.regexp_replace(base64, "[+/=]", "")
    drawn = some.select(F.explode(F.array(digest, F.upper(digest), base64, bare, bare, F.upper(bare), F.lower(bare), F.regexp_replace(F.conv(F.substring(digest, 1, 15), 16, 10), "^0+", ""), F.translate(digest, "abcdef", "147036"))).alias("token"), F.lit(True).alias("random"))
    return words.unionByName(made).unionByName(known).unionByName(drawn)


def corpus_model(docs: DataFrame, sample_docs: int = 2000) -> list[float]:
    """``train`` on ``corpus_samples``."""
    with scratch(docs.sparkSession):
        return train(corpus_samples(docs, sample_docs))


def scan(docs: DataFrame, table: list[float], least_total: float = 30.0, least_mean: float = 2.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, text``, further columns to ``keep``, and ``assign, access, hex, random``: arrays of ``(start, end, value)``.

    ``random`` holds tokens of 20 or more characters whose ratio reaches both limits and that touch no base span.
    """
    based = base_spans(docs, keep)
    tokens = based.withColumn("tokens", let(spans(F.col("text"), TOKEN), lambda t: let(F.concat(*(F.col(k) for k, *_ in BASE)), lambda s: apart(t, s))))
    scored = tokens.withColumn("scored", F.transform("tokens", lambda t: F.struct(t.alias("t"), ratio(t["value"], table).alias("r"))))
    kept = F.filter("scored", lambda x: (x["r"] >= least_total) & (x["r"] >= least_mean * (F.length(x["t"]["value"]) - 1)))
    return scored.select("doc_id", "text", *keep, *(k for k, *_ in BASE), F.transform(kept, lambda x: x["t"]).alias("random"))


def _tagged(kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of all spans of these kinds, by start and then kind."""

    def told(at: int, kind: str):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(at).alias("at"), F.concat_ws(":", F.lit(kind), s["start"], s["end"]).alias("said"))

    parts = [F.transform(k, told(i, k)) for i, k in enumerate(kinds)]
    return F.array_join(F.transform(F.array_sort(F.concat(*parts)), lambda s: s["said"]), ",")


def digests(scanned: DataFrame) -> DataFrame:
    """Counts of base spans, the digest of their list, and the list of all spans."""
    listed = scanned.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k, *_ in BASE), F.size("random").cast("long").alias("n_random"), _tagged(KINDS[:3]).alias("base"), _tagged(KINDS).alias("spans"))
    return listed.select("doc_id", "n_assign", "n_access", "n_hex", "n_random", F.sha2("base", 256).alias("base_sha256"), "spans")


def masked(scanned: DataFrame, mask: str = "[SECRET]", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, text`` with each run of overlapping spans replaced by the mask, and further columns to ``keep``."""
    every = F.array_sort(F.concat(*(F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS)))

    def done(x: Column) -> Column:
        reach = running(F.transform(x, lambda z: z["end"]), lambda p, q: F.greatest(p, q))
        return let(reach, lambda r: let(F.filter(F.transform(x, lambda z, i: F.struct(z["start"].alias("start"), F.coalesce(F.get(r, i - 1), F.lit(0)).alias("was"))), lambda z: z["start"] >= z["was"]), lambda heads: joined(heads, F.element_at(r, -1))))

    def joined(heads: Column, last: Column) -> Column:
        """The text from the end of each run to the start of the next, by its characters."""
        bounds = F.concat(F.transform(heads, lambda z: F.struct(z["was"].alias("a"), z["start"].alias("b"))), F.array(F.struct(last.alias("a"), F.length("text").alias("b"))))
        return let(F.split("text", ""), lambda chars: F.array_join(F.transform(bounds, lambda z: F.array_join(F.slice(chars, z["a"] + 1, F.greatest(z["b"] - z["a"], F.lit(0))), "")), mask))

    return scanned.select("doc_id", F.when(F.size(every) > 0, let(every, done)).otherwise(F.col("text")).alias("text"), *keep)
