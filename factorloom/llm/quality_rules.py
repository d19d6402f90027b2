"""Quality rules: base statistics, and robust multivariate outliers. DataFrame functions only.

Base statistics come from one pass over each text. A document with at least ten words that passes the
base rules has a vector of transformed statistics (log mean word length; roots of the shares of
symbols, repeated lines and repeated words). Per language and source, a minimum-covariance-determinant
estimate is found by concentration steps from two starts, the medians with the quartiles' spread, and the mean and covariance of all
rows: keep the share `h` of rows with the smallest Mahalanobis distance, estimate anew, and repeat until no
group's determinant falls any more; of the two, the smaller determinant counts. A step is one aggregation of moments by
(group, start, distance bin); a group's bins are then taken from the nearest on until they hold the share h, so
no quantile needs a sort and no group meets in one task. Variances have floors, so that clean prose, which hardly varies, is kept.
Documents beyond the cutoff are not kept.

Null texts have no words. Null languages or sources count as the empty string. Groups of fewer than
`least` vectors are estimated together. Repeated rows are judged alike; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut

#: Smallest standard deviation of each statistic: what clean prose varies by anyway.
FLOORS = (0.12, 0.06, 0.10, 0.10)
D = len(FLOORS)
#: Share of rows in the estimate, the factor that makes it consistent for normal data in four dimensions, and
#: the squared distance with tail 1e-5 there.
SHARE, CONSISTENCY, CUTOFF = 0.75, 1.486, 28.5
#: Bins a unit of the first medians, and the fall of a log determinant that counts as none.
BINS, TOLERANCE = 64, 1e-3


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base statistics and n_lines (lines with a word)."""
    text = F.coalesce("text", F.lit(""))
    blank = "[\\x20\\x09-\\x0D]+"
    cells = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
        F.filter(F.split(text, blank), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    # word hashes as longs, so that windows hash five longs rather than joined strings
    cells = cells.select(
        "doc_id", "lang", "source", "n_symbols", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    window = F.when(
        F.size("h") >= 5,
        F.transform(F.sequence(F.lit(0), F.size("h") - 5), lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(5)])),
    ).otherwise(F.array().cast("array<bigint>"))
    keep = ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    cells = cells.select(*keep, window.alias("win"))
    # only texts with a repeated window are looked at further
    ranked = F.sort_array(F.transform("win", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    cells = cells.select(*keep, F.when(F.size(F.array_distinct("win")) < F.size("win"), ranked).alias("ranked"))
    same = lambda j, k: F.get("ranked", j)["x"] == F.get("ranked", k)["x"]
    last = F.size("ranked") - 1
    place = F.sort_array(
        F.transform(
            F.filter(
                F.sequence(F.lit(0), last),
                lambda j: F.coalesce(((j > 0) & same(j, F.greatest(j - 1, F.lit(0)))) | ((j < last) & same(j, j + 1)), F.lit(False)),
            ),
            lambda j: F.get("ranked", j)["i"],
        )
    )
    cells = cells.select(*keep, F.when(F.col("ranked").isNotNull(), place).alias("place"))
    covered = F.aggregate(
        F.sequence(F.lit(0), F.size("place") - 1), F.lit(0).cast("long"),
        lambda n, j: n + F.least(F.lit(5), F.coalesce(F.get("place", j + 1) - F.get("place", j), F.lit(5))).cast("long"),
    )
    return cells.select(*keep, F.when(F.col("place").isNotNull(), covered).otherwise(0).cast("long").alias("n_repeat_words"))


def _vector() -> list[Column]:
    ratio = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return [
        F.log(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))).alias("x0"), ratio("n_symbols", "word_chars").alias("x1"),
        ratio("n_dup_lines", "n_lines").alias("x2"), ratio("n_repeat_words", "n_words").alias("x3"),
    ]


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(D) for j in range(i + 1)]


def _moments() -> list[Column]:
    """Sums about fixed points near the data, lest the covariance lose digits."""
    return [
        F.count("*").alias("n"), *[F.sum(F.col(f"x{i}")).alias(f"s{i}") for i in range(D)],
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in _pairs()],
    ]


KEYS = ["g", "start"]


def _estimate(sums: DataFrame, scale: float) -> DataFrame:
    """KEYS, the means m, the Cholesky factor l of the covariance, whose diagonal has floors, and the log of its determinant."""
    out = sums.select(*KEYS, *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(D)], "n", *[f"q{i}{j}" for i, j in _pairs()])
    for i, j in _pairs():
        c = scale * (F.col(f"q{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}"))
        if i == j:
            c = F.greatest(c, F.lit(0.0)) + FLOORS[i] ** 2
        c = c - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(c, F.lit(1e-12))) if i == j else c / F.col(f"l{j}{j}"))
    return out.select(*KEYS, *_parameters(), sum((2 * F.log(f"l{i}{i}") for i in range(D)), F.lit(0.0)).alias("log_det"))


def _parameters() -> list[str]:
    return [f"m{i}" for i in range(D)] + [f"l{i}{j}" for i, j in _pairs()]


def _robust_start(good: DataFrame) -> DataFrame:
    """Medians, and the spread that a normal distribution with the same quartiles has, from counts in bins of 1 / BINS."""
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col(f"x{i}") * BINS).alias("b")) for i in range(D)])
    counts = good.select("g", F.explode(each).alias("x")).groupBy("g", "x.i", "x.b").agg(F.count("*").alias("n"))
    own = W.partitionBy("g", "i")
    share = F.sum("n").over(own.orderBy("b")) / F.sum("n").over(own)
    at = lambda p: (F.min(F.when(F.col("share") >= p, F.col("b"))) + 0.5) / BINS
    spots = counts.withColumn("share", share).groupBy("g", "i").agg(at(0.5).alias("mid"), ((at(0.75) - at(0.25)) / 1.349).alias("spread"))
    pick = lambda i, c: F.max(F.when(F.col("i") == i, F.col(c)))
    lower = [F.lit(0.0).alias(f"l{i}{j}") if j < i else F.sqrt(pick(i, "spread") ** 2 + FLOORS[i] ** 2).alias(f"l{i}{j}") for i, j in _pairs()]
    return spots.groupBy("g").agg(*[pick(i, "mid").alias(f"m{i}") for i in range(D)], *lower).select("g", F.lit(1).alias("start"), *_parameters())


def _distance() -> Column:
    z: list[Column] = []
    for i in range(D):
        rest = F.col(f"x{i}") - F.col(f"m{i}") - sum((F.col(f"l{i}{k}") * z[k] for k in range(i)), F.lit(0.0))
        z.append(rest / F.col(f"l{i}{i}"))
    return sum((x * x for x in z[1:]), z[0] * z[0])


def quality_rules(docs: DataFrame, share: float = SHARE, cutoff: float = CUTOFF, least: int = 40) -> DataFrame:
    """One row per row of docs(doc_id, text, lang, source): the statistics, base_failed, distance (squared; null where base_failed) and kept."""
    n = F.col("n_words")
    failed = (n < 10) | (100 * F.col("n_repeat_words") > 20 * n)
    rows = statistics(docs).withColumn("base_failed", failed).withColumn("g", F.concat_ws("\u0001", "lang", "source"))
    rows = cut(rows.select("*", *_vector()))
    good = rows.where("not base_failed")
    # small groups share one estimate
    big = good.groupBy("g").count().where(F.col("count") >= least).select("g", F.col("g").alias("own"))
    named = lambda x: x.join(big, "g", "left").withColumn("g", F.coalesce("own", F.lit("\u0002"))).drop("own")
    big = cut(big)
    good = named(good).select("g", *[f"x{i}" for i in range(D)])
    plain = _estimate(good.groupBy("g", F.lit(0).alias("start")).agg(*_moments()), 1.0)
    estimate, best = cut(plain.drop("log_det").unionByName(_robust_start(good))), None
    while True:
        bin_ = F.floor(16 * F.log2(F.greatest(_distance(), F.lit(1e-9)))).cast("int")
        sums = good.join(estimate, "g").groupBy(*KEYS, bin_.alias("bin")).agg(*_moments())
        own = W.partitionBy(*KEYS)
        nearer = F.coalesce(F.sum("n").over(own.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        sums = sums.withColumn("take", nearer < share * F.sum("n").over(own)).where("take")
        sums = sums.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in sums.columns if c not in (*KEYS, "bin", "take")])
        estimate = cut(_estimate(sums, CONSISTENCY))
        # the bins make a step inexact, so the least determinant so far is what counts; once none falls, all have settled
        if best is not None:
            both = best.join(estimate.select(*KEYS, F.struct("log_det", *_parameters()).alias("now")), KEYS)
            fall = both.agg(F.max(F.col("log_det") - F.col("now.log_det"))).first()[0]
            if fall is None or fall <= TOLERANCE:
                break
            then = F.struct("log_det", *_parameters())
            best = cut(both.select(*KEYS, F.when(F.col("now.log_det") < F.col("log_det"), F.col("now")).otherwise(then).alias("e")).select(*KEYS, "e.*"))
        else:
            best = estimate
    first = F.min_by(F.struct(*_parameters()), F.struct("log_det", "start")).alias("e")
    estimate = cut(best.groupBy("g").agg(first).select("g", "e.*"))
    judged = named(rows).join(estimate, "g", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).alias("kept"), "lang", "source", "distance",
    )
