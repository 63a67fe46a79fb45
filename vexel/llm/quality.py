"""Operator 9: quality rules by robust multivariate outliers, in DataFrame functions alone.

Base statistics come from the whole text. Rows that pass the base rules give a vector of transformed
statistics; each (lang, source) group of at least `MIN_GROUP` such rows has its own minimum-covariance-
determinant estimate (concentration steps, the `H` part with smallest distances kept, from `STARTS` starts until the determinant
falls no more; the least determinant stands; the covariance carries the consistency factor of the part); smaller groups are judged by the estimate of their language, and rows of a language below `MIN_GROUP` by that of all. A row is rejected when its Mahalanobis distance squared
exceeds `CUT`, a chi-squared quantile. Every step is an aggregate with map-side combining, so a hot group is no burden.

Defined results: null and empty texts have no words and fail the base rules; null lang or source is a
group value of its own; repeated rows each get a row; other columns are not read; an empty table gives no rows.
very long texts count whole; ties in distance fall on one side of a limit together. Windows are compared by 64-bit hashes within one text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _store
from ._text import WORD

#: Five rows a parameter of location and one more: what an estimate in four dimensions needs.
MIN_GROUP = 25
H = 0.75
#: Starts of an estimate, rows of each but the first, steps at most, and the fall of the log determinant that counts as one.
STARTS, FEW, STEPS, LEAST_FALL = 4, 10, 30, 1e-4
#: Least standard deviation of each transformed statistic: rounding and rare events aren't outliers.
FLOORS = {"f_word": 0.08, "f_symbol": 0.05, "f_line": 0.1, "f_repeat": 0.1}
#: Groups sent to all tasks: at most these, else they are joined by a shuffle.
SENT = 50_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def chi_squared(x: float, p: int) -> float:
    """P(chi-squared with p degrees of freedom <= x), p even."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(p // 2))


def quantile(q: float, p: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_squared(mid, p) < q else (low, mid)
    return high


def consistency(p: int, h: float) -> float:
    """What the covariance of the h part nearest to the centre is multiplied by to be that of all, for normal rows."""
    return h / chi_squared(quantile(h, p), p + 2)


#: The 0.999 quantile of chi-squared with one degree of freedom a statistic.
CUT = quantile(0.999, len(FLOORS))


def statistics(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))
    rows = rows.select(
        "doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.when(F.size("words") > 8, F.transform(F.sequence(F.lit(1), F.size("words") - 7), lambda i: F.xxhash64(F.slice("words", i, 8)))).alias("windows"),
    )
    at = F.expr("sort_array(transform(windows, (h, i) -> struct(h, i)))")
    rows = rows.withColumn("sorted", F.when(F.size("windows") > F.size(F.array_distinct("windows")), at))
    # The starts of windows with an equal neighbour in hash order, by place; each covers up to eight words.
    twice = F.expr("sort_array(transform(filter(sorted, (s, j) -> (j > 0 and sorted[j - 1].h = s.h) or (j + 1 < size(sorted) and sorted[j + 1].h = s.h)), s -> s.i))")
    covered = F.aggregate("twice", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-8).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(8), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    rows = rows.withColumn("twice", twice)
    return rows.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    ).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _factored(estimate: DataFrame, names: list[str]) -> DataFrame:
    """The estimate with the Cholesky factor of its covariance, floors added, as columns l{i}{j}, and its log determinant."""
    p = len(names)
    for i in range(p):
        for j in range(i + 1):
            s = F.col(f"c{j}{i}") + (F.lit(FLOORS[names[i]] ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                s = s - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            estimate = estimate.withColumn(f"l{i}{j}", F.sqrt(F.greatest(s, F.lit(1e-12))) if i == j else s / F.col(f"l{j}{j}"))
    det = sum((2 * F.log(f"l{i}{i}") for i in range(p)), F.lit(0.0))
    return estimate.select("g", "start", det.alias("det"), *[f"m{i}" for i in range(p)], *[f"l{i}{j}" for i in range(p) for j in range(i + 1)])


def _distance(names: list[str]) -> Column:
    """Mahalanobis distance squared, by forward substitution in the factor."""
    solved: list[Column] = []
    for i, name in enumerate(names):
        s = F.col(name) - F.col(f"m{i}")
        for k in range(i):
            s = s - F.col(f"l{i}{k}") * solved[k]
        solved.append(s / F.col(f"l{i}{i}"))
    return sum((x * x for x in solved[1:]), solved[0] * solved[0])


def _groups(rows: DataFrame, min_group: int) -> DataFrame:
    """For each (lang, source), as `own`: g, the estimate that judges it, and all estimates its rows serve."""
    json = {"ignoreNullFields": "false"}
    n = rows.groupBy("lang", "source").agg(F.sum((~F.col("base_failed")).cast("long")).alias("n"))
    n = n.select(F.to_json(F.struct("lang", "source"), json).alias("own"), F.to_json(F.struct("lang"), json).alias("tongue"), "n")
    tongues = n.groupBy("tongue").agg(F.sum("n").alias("n_tongue"), (F.min("n") < min_group).alias("asked"))
    n = n.join(tongues, "tongue")
    g = F.when(F.col("n") >= min_group, F.col("own")).when(F.col("n_tongue") >= min_group, F.col("tongue")).otherwise("all")
    n = n.withColumn("g", g).crossJoin(tongues.agg(F.coalesce(F.min("n_tongue") < min_group, F.lit(False)).alias("rare")))
    serves = F.array(F.when(F.col("g") == F.col("own"), F.col("own")), F.when(F.col("asked") & (F.col("n_tongue") >= min_group), F.col("tongue")), F.when(F.col("rare"), F.lit("all")))
    return n.select("own", "g", F.filter(serves, lambda x: x.isNotNull()).alias("serves"))


def verdicts(docs: DataFrame, min_group: int = MIN_GROUP, cut: float = CUT) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept, and the distance squared."""
    names, p = list(FLOORS), len(FLOORS)
    rows = statistics(docs).select(
        "*", F.log((1.0 + F.col("word_chars")) / (1.0 + F.col("n_words"))).alias("f_word"),
        F.log1p(F.col("n_symbols") / F.greatest("n_words", F.lit(1))).alias("f_symbol"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("f_line"),
        (F.col("n_repeat_words") / F.greatest("n_words", F.lit(1))).alias("f_repeat"),
    )
    rows = _store.saved(rows, "quality")
    groups = _store.saved(_groups(rows, min_group), "groups")
    own = F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"})
    rows = rows.withColumn("own", own).join(F.broadcast(groups) if groups.limit(SENT + 1).count() <= SENT else groups, "own").drop("own")
    good = rows.where(~F.col("base_failed")).select(F.explode("serves").alias("g"), "doc_id", *names)

    scale = F.lit(consistency(p, H))

    def sent(few: DataFrame) -> DataFrame:
        """Estimates, one row for a group and start: sent to all tasks while they are few, so that no group's rows meet in one."""
        return F.broadcast(few) if few.limit(SENT + 1).count() <= SENT else few

    def moments(part: DataFrame) -> DataFrame:
        aggs = [F.avg(x).alias(f"m{i}") for i, x in enumerate(names)]
        aggs += [(scale * F.covar_pop(names[i], names[j])).alias(f"c{i}{j}") for i in range(p) for j in range(i, p)]
        return part.groupBy("g", "start").agg(*aggs)

    middle = good.groupBy("g").agg(F.count("*").alias("n"), *[F.percentile_approx(x, 0.5, 10000).alias(f"m{i}") for i, x in enumerate(names)])
    middle = _store.saved(middle, "middle")
    # Start 0 is the median; the others are the moments of about `FEW` rows each, chosen by hashes of their values.
    first = middle.select("g", F.lit(0).alias("start"), *[f"m{i}" for i in range(p)], *[F.lit(0.0).alias(f"c{i}{j}") for i in range(p) for j in range(i, p)])
    luck = F.pmod(F.xxhash64("start", "doc_id", *names), F.lit(1 << 20)) / F.lit(float(1 << 20))
    few = good.join(sent(middle.select("g", "n")), "g").withColumn("start", F.explode(F.array(*[F.lit(i) for i in range(1, STARTS)]))).where(luck * F.col("n") < FEW)
    going = _store.saved(_factored(first.unionByName(moments(few)), names).withColumn("last", F.lit(float("inf"))), "estimate")
    ended = None
    for step in range(STEPS):
        few_left = going.limit(SENT + 1).count() <= SENT
        far = good.join(F.broadcast(going) if few_left else going, "g").select("g", "start", "last", *names, _distance(names).alias("d"))
        limit = far.groupBy("g", "start").agg(F.percentile_approx("d", H, 10000).alias("limit"), F.first("last").alias("last"))
        bounds = limit.drop("last")
        near = far.drop("last").join(F.broadcast(bounds) if few_left else bounds, ["g", "start"]).where(F.col("d") <= F.col("limit"))
        after = _factored(moments(near), names).join(limit.select("g", "start", "last"), ["g", "start"])
        fell = F.col("det") < F.col("last") - LEAST_FALL
        after = _store.saved(after.withColumn("going", fell).withColumn("last", F.least("det", "last")), "estimate")
        done = after.where(~F.col("going") | F.lit(step == STEPS - 1)).drop("going")
        ended = done if ended is None else ended.unionByName(done)
        going = after.where("going").drop("going")
        if going.isEmpty():
            break
    fields = [c for c in ended.columns if c != "g"]
    estimate = ended.groupBy("g").agg(F.min_by(F.struct(*fields), F.struct("det", "start")).alias("e")).select("g", "e.*")
    estimate = _store.saved(estimate, "estimates")
    out = rows.join(sent(estimate), "g", "left").select("doc_id", *BASE, "base_failed", _distance(names).alias("distance"))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cut, F.lit(True)))
