"""Benchmark decontamination by templates. DataFrame functions only.

A text becomes a row of tokens, in two forms. In the typed one numbers (the parts of a decimal one by one), units behind numbers and names
(words with a capital, those that open a sentence too) are typed placeholders; in the plain one only numbers and units are, so that
copies in other letter case match as well. Every other token is its lower-cased word.
Windows of five template tokens with at least two words are hashed and joined by equality with the benchmark's windows of the same form.
An item is leaked by a document that holds at least `least` of the item's distinct windows of one form and
fills its slots consistently: of the pairs (value in the item, value in the document) at matched
slots, each item value goes with one document value, but for a share of 1 - `least`; two item values may go with the same one. Both are judged for each alignment (place in the document
less place in the item, exact and with up to DRIFT words put in or left out) and for the whole document; one that passes is enough,
whatever else the document holds. Items without such a window match by their tokens as they stand: those of fewer than
five tokens as a whole, others (nothing but numbers, say) in windows of five.

The benchmark's windows are counted first: up to BROADCAST rows they are sent to all executors, beyond
that the join shuffles. Null texts have no tokens; items without tokens match nothing. Each row is judged by itself, told apart by doc_id (null or not) and the hash of its text; equal rows have equal results.
Empty tables give no matches; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

WIDTH, LEAST, BROADCAST, DRIFT = 5, 0.8, 500_000, 4
UNITS = (
    "kg|g|mg|lb|lbs|oz|km|m|cm|mm|mi|miles?|ft|feet|inch|inches|meters?|metres?|kilometers?|kilometres?|liters?|litres?|l|ml|"
    "hours?|hrs?|h|minutes?|mins?|seconds?|secs?|s|days?|weeks?|months?|years?|dollars?|cents?|euros?|pounds?|percent|degrees?"
)
MEASURE = f"(?i)([0-9]) *({UNITS})\\b"
OTHER = "[^\\p{L}\\p{N}\u0001]+"
#: Forms of windows; SHORT + n is the whole of an item of n tokens.
TYPED, PLAIN, RAW, SHORT = 0, 1, 2, 10
#: Placeholders of names, numbers and units.
TYPES = (1, 2, 3)


def row_key() -> Column:
    """What tells rows of docs apart: doc_id, which may be null or repeated, and the hash of the text. Nulls in it are equal to each other."""
    return F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))


def templates(rows: DataFrame, key: str) -> DataFrame:
    """key, n (tokens) and arrays of their hashes: typed and plain (the forms; TYPES for placeholders) and raw (as they stand)."""
    text = F.translate(F.coalesce("text", F.lit("")), "\u0001", " ")
    marked = F.when(text.rlike("[0-9]"), F.regexp_replace(text, MEASURE, "$1 \u0001$2 ")).otherwise(text)
    words = F.split(F.trim(F.regexp_replace(marked, OTHER, " ")), " ")
    # each token once: its first sign and the hash of its lower-cased form
    token = F.transform("words", lambda w: F.struct(F.left(w, F.lit(1)).alias("first"), F.xxhash64(F.lower(w)).alias("raw")))
    rows = rows.select(key, words.alias("words")).select(key, F.when(F.get("words", 0) == "", 0).otherwise(F.size("words")).alias("n"), token.alias("tokens"))

    def kind(t: Column, names: bool) -> Column:
        first = t["first"]
        out = F.when(first == "\u0001", F.lit(3).cast("long")).when(first.between("0", "9"), F.lit(2).cast("long"))
        return (out.when(first != F.lower(first), F.lit(1).cast("long")) if names else out).otherwise(t["raw"])

    forms = [F.transform("tokens", lambda t: kind(t, True)).alias("typed"), F.transform("tokens", lambda t: kind(t, False)).alias("plain")]
    return rows.select(key, "n", *forms, F.col("tokens.raw").alias("raw"))


def windows(tokens: DataFrame, key: str, at: str, forms: list[int]) -> DataFrame:
    """key, at (the window's place), form, window (its hash), its template tokens h0.. and the tokens as they stand, raw0.. (null beyond the end)."""
    source = {TYPED: "typed", PLAIN: "plain"}
    each = [F.struct(F.lit(f).alias("form"), F.col(source.get(f, "raw")).alias("h")) for f in forms]
    rows = tokens.select(key, "n", "raw", F.explode(F.array(*each)).alias("x")).select(key, "n", "raw", "x.form", "x.h")
    short = [f for f in forms if f > SHORT]
    width = F.when(F.col("form") > SHORT, F.col("form") - SHORT).otherwise(WIDTH) if short else F.lit(WIDTH)
    # what follows must read the arrays where they lie: rows that carry them cost a text's length squared
    rows = rows.select(key, "form", "h", "raw", F.explode(F.when(F.col("n") >= width, F.sequence(F.lit(0), F.col("n") - width))).alias(at))
    h = [F.get("h", F.col(at) + k) for k in range(WIDTH)]
    words: Column = sum((F.when(x.isin(*TYPES), 0).otherwise(1) for x in h), F.lit(0))
    window = F.xxhash64(*h)
    for f in short:
        window = F.when(F.col("form") == f, F.xxhash64(*h[: f - SHORT])).otherwise(window)
    fits = (words >= 2) | ~F.col("form").isin(TYPED, PLAIN) if len(forms) > 2 or RAW in forms or short else words >= 2
    return rows.where(fits).select(
        key, at, "form", window.alias("window"), *[x.alias(f"h{k}") for k, x in enumerate(h)], *[F.get("raw", F.col(at) + k).alias(f"raw{k}") for k in range(WIDTH)]
    )


def matches(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """row (see row_key), doc_id, item_id, coverage, consistency of the leaks."""
    tokens = templates(benchmark.withColumn("item_id", F.col("item_id").cast("long")), "item_id")
    items = cut(windows(tokens, "item_id", "item_at", [TYPED, PLAIN]))
    # items without a window, by the form that stands in for it: most often none
    bare = cut(tokens.where("n > 0").join(items.select("item_id").distinct(), "item_id", "left_anti"))
    bare = bare.withColumn("stand_in", F.when(F.col("n") < WIDTH, F.col("n") + SHORT).otherwise(RAW))
    forms = sorted(r["stand_in"] for r in bare.select("stand_in").distinct().collect())
    if forms:
        more = windows(bare, "item_id", "item_at", forms).join(bare.select("item_id", "stand_in"), "item_id").where("form = stand_in")
        items = cut(items.unionByName(more.drop("stand_in")))
    slot = [F.when(F.col(f"h{k}").isin(*TYPES) & F.col("form").isin(TYPED, PLAIN), F.struct(F.lit(k).alias("k"), F.col(f"raw{k}").alias("item_raw"))) for k in range(WIDTH)]
    items = cut(items.select("item_id", "item_at", "form", "window", F.filter(F.array(*slot), lambda x: x.isNotNull()).alias("slots")))
    sizes = items.groupBy("item_id", "form").agg(F.countDistinct("window").alias("n_windows"))
    small = items.count() <= BROADCAST
    side = F.broadcast(items) if small else items
    hits = windows(templates(docs.select(row_key().alias("row"), "text"), "row"), "row", "at", [TYPED, PLAIN, *forms])
    raws = F.array(*[f"raw{k}" for k in range(WIDTH)])
    pair = F.transform("slots", lambda s: F.struct(s["item_raw"].alias("a"), F.get(raws, s["k"]).alias("b")))
    # one row per distinct (document, item, form, window, alignment, slot pairs): copies fold before they are sent
    hits = hits.join(side, ["form", "window"]).select("row", "item_id", "form", "window", (F.col("at") - F.col("item_at")).alias("shift"), pair.alias("pairs"))
    hits = cut(hits.groupBy(*hits.columns).agg(F.lit(1).alias("one")).drop("one"))
    sizes = F.broadcast(sizes) if small else sizes
    # no alignment holds more of an item than the whole document does
    held = _covered(hits, sizes, ["row", "item_id", "form"], least).select("row", "item_id", "form")
    group = lambda kind, place: F.struct(F.lit(kind).alias("kind"), place.cast("long").alias("place"))
    step = lambda by: F.floor((F.col("shift") + by) / (2 * DRIFT))
    groups = F.array(group(0, F.lit(0)), group(1, F.col("shift")), group(2, step(0)), group(3, step(DRIFT)))
    near = hits.join(held, ["row", "item_id", "form"], "left_semi").select("row", "item_id", "form", "window", "pairs", F.explode(groups).alias("group"))
    keys = ["row", "item_id", "form", "group"]
    cover = _covered(near, sizes, keys, least)
    filled = near.select(*keys, F.explode("pairs").alias("p")).join(cover.select(*keys), keys, "left_semi")
    filled = filled.groupBy(*keys).agg(F.countDistinct("p.a").alias("values"), F.countDistinct("p").alias("pairs"))
    out = cover.join(filled, keys, "left")
    out = out.withColumn("consistency", F.coalesce(F.col("values") / F.col("pairs"), F.lit(1.0))).where(F.col("consistency") >= least)
    best = F.max(F.struct("coverage", "consistency")).alias("best")
    return out.groupBy("row", "item_id").agg(best).select("row", "row.doc_id", "item_id", "best.coverage", "best.consistency")


def _covered(hits: DataFrame, sizes: DataFrame, keys: list[str], least: float) -> DataFrame:
    """keys and coverage of the groups that hold at least `least` of their item's distinct windows."""
    cover = hits.groupBy(*keys).agg(F.countDistinct("window").alias("found")).join(sizes, ["item_id", "form"])
    return cover.select(*keys, (F.col("found") / F.col("n_windows")).alias("coverage")).where(F.col("coverage") >= least)


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """One row per row of docs(doc_id, text): leaked, n_items, item_ids (ascending, comma-joined), coverage (the largest, else 0)."""
    found = matches(docs, benchmark, least).groupBy("row").agg(
        F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_set("item_id")).cast("array<string>"), ",").alias("item_ids"),
        F.max("coverage").alias("coverage"),
    )
    out = docs.select(row_key().alias("row")).join(found, "row", "left")
    return out.select(
        "row.doc_id", F.col("n_items").isNotNull().alias("leaked"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("item_ids", F.lit("")).alias("item_ids"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
    )


def drop_leaking(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of docs, all columns, that hold no item; others with the same doc_id stay."""
    leaks = cut(matches(docs, benchmark, least).select("row").distinct())
    return docs.select(row_key().alias("row"), F.struct("*").alias("doc")).join(leaks, "row", "left_anti").select("doc.*")
