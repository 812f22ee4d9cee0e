"""Feature screening statistics as aggregates."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketry.operators.features import fit_edges
from basketry.functions.numeric import edges_of
from basketry.operators.ordered import between, codes_of, places, ranges_for, running, written
from basketry.schema import FAMILIES, FEATURE_SETS, PRUNED, family_of

#: Values of a class among which neighbours are looked for at once.
NEIGHBOUR_BLOCK = 50_000


def _pair_sums(p: int, means: np.ndarray):
    """From an array of p numbers to sums of every pair, over rows that have both: count, both, squares and product, less the means."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, p, p))
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, p) - means
            has = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            total += np.stack([has.T @ has, x.T @ has, has.T @ x, (x * x).T @ has, has.T @ (x * x), x.T @ x])
        i, j = np.triu_indices(p, 1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), *(pa.array(t[i, j]) for t in total)], names=["i", "j", *_PAIR_SUMS])

    return run


_PAIR_SUMS = ("n", "sa", "sb", "saa", "sbb", "sab")


def pair_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature_a, feature_b, n and r: Pearson's correlation of every two columns over rows that have both, null where one does not vary.

    A task sums up all pairs of its rows as products of matrices, so the rows are read once for the means and once for all pairs.
    """
    one = df.agg(*(F.avg(c).alias(c) for c in columns)).first()
    means = np.array([0.0 if one[c] is None else float(one[c]) for c in columns])
    array = F.array(*(F.col(c).cast("double") for c in columns)).alias("x")
    sums = df.select(array).mapInArrow(_pair_sums(len(columns), means), "i long, j long, " + ", ".join(f"{c} double" for c in _PAIR_SUMS)).groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in _PAIR_SUMS))
    n, spread = F.col("n"), lambda s, ss: F.col(ss) - F.try_divide(F.col(s) * F.col(s), F.col("n"))
    # What is left of a constant after rounding is no variance.
    varies = lambda s, ss: F.when(spread(s, ss) > 1e-12 * F.col(ss), spread(s, ss))
    r = F.try_divide(F.col("sab") - F.try_divide(F.col("sa") * F.col("sb"), n), F.sqrt(varies("sa", "saa")) * F.sqrt(varies("sb", "sbb")))
    names = F.array(*(F.lit(c) for c in columns))
    return sums.select(F.get(names, F.col("i").cast("int")).alias("feature_a"), F.get(names, F.col("j").cast("int")).alias("feature_b"), n.cast("long").alias("n"), r.alias("r"))


def redundant_pairs(df: DataFrame, columns: Sequence[str], least: float = 0.95) -> DataFrame:
    """Pairs with an absolute Pearson correlation of at least `least`, over rows that have both."""
    return pair_correlations(df, columns).where(F.abs("r") >= least).select("feature_a", "feature_b", "r").orderBy(F.desc(F.abs("r")), "feature_a", "feature_b")


def near_zero_variance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values, their ratio to rows, the ratio of the two commonest, and the flags made from them."""
    tags = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns)))
    counts = df.select(tags.alias("t")).where("t.value is not null").groupBy("t.feature", "t.value").agg(F.count("*").alias("n"))
    # The two commonest through max and max of the rest, so that no list of all values is made.
    best = counts.groupBy("feature").agg(F.count("*").alias("n_unique"), F.sum("n").alias("n_rows"), F.max(F.struct("n", "value")).alias("first"))
    second = counts.join(best.select("feature", F.col("first.value").alias("top")), "feature").where("value <> top").groupBy("feature").agg(F.max("n").alias("second"))
    out = best.join(second, "feature", "left").select("feature", "n_unique", (F.col("n_unique") / F.col("n_rows")).alias("unique_ratio"), (F.col("first.n") / F.col("second")).alias("freq_ratio"))
    return out.withColumns({"is_constant": F.col("n_unique") <= 1, "is_nzv": (F.col("unique_ratio") < 0.01) & ((F.coalesce("freq_ratio", F.lit(math.inf)) > 19) | (F.col("n_unique") <= 1))})


def spearman(df: DataFrame, columns: Sequence[str], target: str, least: int = 20) -> DataFrame:
    """feature, n and the rank correlation with the target, over rows that have both; null with fewer than `least` of them.

    All columns in one pass: rows are counted by (feature, value, target), average ranks of both come
    from running sums over the counts, and the correlation from five sums over them.
    """
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns))).alias("f"), F.col(target).cast("double").alias("y"))
    cells = written(long.select("f.feature", "f.x", "y").dropna().groupBy("feature", "x", "y").agg(F.count("*").alias("n")))
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    return every.join(_rank_correlations(cells, least), "feature", "left").na.fill(0, ["n"])


def _rank_correlations(cells: DataFrame, least: int) -> DataFrame:
    """feature, n and spearman from a written table of counts (feature, x, y, n)."""

    def ranks(side: str) -> DataFrame:
        counts = written(cells.groupBy("feature", F.col(side).alias("v")).agg(F.sum("n").alias("c")))
        placed = running(counts, "v", {"before": "c"}, ["feature"], edges_by=["feature"])
        return placed.select("feature", F.col("v").alias(side), (F.col("before") + (F.col("c") + 1) / 2).alias(f"r{side}"))

    # Ranks are taken from the middle, so that their products keep their digits.
    sizes = cells.groupBy("feature").agg(((F.sum("n") + 1) / 2).alias("middle"))
    both = cells.join(ranks("x"), ["feature", "x"]).join(ranks("y"), ["feature", "y"]).join(sizes, "feature").withColumns({c: F.col(c) - F.col("middle") for c in ("rx", "ry")})
    n, product = F.sum("n"), lambda a, b: F.sum(F.col("n") * F.col(a) * F.col(b))
    rho = F.try_divide(product("rx", "ry"), F.sqrt(product("rx", "rx") * product("ry", "ry")))
    return both.groupBy("feature").agg(n.alias("n"), F.when(n >= least, rho).alias("spearman"))


def chi_square(df: DataFrame, column: str, target: str, bins: int = 10, least: int = 20) -> DataFrame:
    """Chi-square of equal-frequency bins against classes, with Yates' correction for two by two."""
    both = df.select(F.col(column).cast("double").alias("x"), F.col(target).alias("y")).dropna()
    edges = fit_edges(both, ["x"], bins).select(F.col("x_edges").alias("e"))
    inner = F.slice("e", 2, F.greatest(F.size("e") - 2, F.lit(0)))
    binned = both.join(F.broadcast(edges)).select((F.size(F.filter(inner, lambda e: e < F.col("x"))) + 1).alias("b"), "y")
    cells = binned.groupBy("b", "y").agg(F.count("*").alias("o"))
    rows, cols, total = cells.groupBy("b").agg(F.sum("o").alias("r")), cells.groupBy("y").agg(F.sum("o").alias("c")), cells.agg(F.sum("o").alias("n"))
    # Bins by classes: a small grid.
    grid = rows.crossJoin(cols).join(F.broadcast(total)).join(cells, ["b", "y"], "left").na.fill(0, ["o"]).withColumn("ex", F.col("r") * F.col("c") / F.col("n"))
    dof = (F.count_distinct("b") - 1) * (F.count_distinct("y") - 1)
    gap = F.abs(F.col("o") - F.col("ex"))
    plain, yates = F.sum(gap * gap / F.col("ex")), F.sum(F.pow(gap - F.least(F.lit(0.5), gap), F.lit(2.0)) / F.col("ex"))
    return grid.agg(F.lit(column).alias("feature"), F.max("n").alias("n"), dof.alias("dof"), F.when((F.max("n") >= least) & (dof >= 1), F.when(dof == 1, yates).otherwise(plain)).alias("chi2"))


def binned_mutual_information(df: DataFrame, column: str, target: str, bins: int = 10) -> DataFrame:
    """Plug-in mutual information (nats) of equal-frequency bins and classes; not the nearest-neighbour estimate."""
    both = df.select(F.col(column).cast("double").alias("x"), F.col(target).alias("y")).dropna()
    edges = fit_edges(both, ["x"], bins).select(F.col("x_edges").alias("e"))
    inner = F.slice("e", 2, F.greatest(F.size("e") - 2, F.lit(0)))
    cells = both.join(F.broadcast(edges)).select((F.size(F.filter(inner, lambda e: e < F.col("x"))) + 1).alias("b"), "y").groupBy("b", "y").agg(F.count("*").alias("o"))
    r, c = F.sum("o").over(Window.partitionBy("b")), F.sum("o").over(Window.partitionBy("y"))
    n = F.sum("o").over(Window.partitionBy(F.lit(1)))
    terms = cells.select("o", r.alias("r"), c.alias("c"), n.alias("n"))
    return terms.agg(F.lit(column).alias("feature"), F.sum(F.col("o") / F.col("n") * F.ln(F.col("o") * F.col("n") / (F.col("r") * F.col("c")))).alias("binned_mi"))


def digamma(x: Column) -> Column:
    """For numbers from 1: ten steps up, then the asymptotic series, to about 15 digits."""
    up = x + 10
    steps = sum((1 / (x + k) for k in range(1, 10)), 1 / x)
    square = 1 / (up * up)
    return F.ln(up) - 1 / (2 * up) - square * (1 / 12 - square * (1 / 120 - square * (1 / 252 - square * (1 / 240 - square / 132)))) - steps


def _kth_distances(cells: DataFrame, k: int) -> DataFrame:
    """cells (feature, y, v, n, n_y) with k_y and d: the distance of v to its k_y-th neighbour of the class, equal rows counting as neighbours.

    The values of a class are numbered, and cut into blocks by their number. A block gets the k values
    on either side of it too, so windows run within blocks, whatever the size of a class.
    """
    size = max(k, NEIGHBOUR_BLOCK)
    placed = running(cells.withColumn("__one", F.lit(1).cast("long")), "v", {"__place": "__one"}, ["feature", "y"], edges_by=["feature"])
    at, offset = F.floor(F.col("__place") / size), F.col("__place") % size
    blocks = F.array_compact(F.array(at, F.when((offset < k) & (at > 0), at - 1), F.when(offset >= size - k, at + 1)))
    dealt = placed.withColumn("__own", at).withColumn("__block", F.explode(blocks))
    w = Window.partitionBy("feature", "y", "__block").orderBy("v")
    near = lambda low, high: F.collect_list(F.struct("v", "n")).over(w.rowsBetween(low, high))
    around = dealt.withColumns({"__low": near(-k, -1), "__high": near(1, k)}).where("__block = __own")
    by_distance = F.array_sort(F.transform(F.concat("__low", "__high", F.array(F.struct("v", (F.col("n") - 1).alias("n")))), lambda x: F.struct(F.abs(x["v"] - F.col("v")).alias("d"), x["n"].alias("n"))))
    k_y = F.least(F.lit(k).cast("long"), F.col("n_y") - 1)
    none = F.struct(F.lit(0).cast("long").alias("held"), F.lit(0.0).alias("d"))
    step = lambda acc, x: F.when(acc["held"] >= k_y, acc).otherwise(F.struct((acc["held"] + x["n"]).alias("held"), x["d"].alias("d")))
    return around.select("feature", "y", "v", "n", "n_y", k_y.alias("k_y"), F.aggregate(by_distance, none, step)["d"].alias("d"))


def knn_mutual_information(df: DataFrame, columns: Sequence[str], target: str, k: int = 3) -> DataFrame:
    """feature, n and knn_mi: the nearest-neighbour estimate (nats) between a number and classes, over all rows that have both.

    For a row of class y, with the distance d to its k-th neighbour of the class and m rows of any class
    nearer than d (itself included; at distance 0 the equal rows), the estimate is the mean of
    digamma(k) - digamma(n_y) - digamma(m), plus digamma(n), and at least 0. Rows that are alone in
    their class are left out; k is n_y - 1 in classes of fewer rows. No noise is added to equal values.

    Equal rows are summed up first. m is the difference of two running counts: the ends of a row's
    interval are sorted among the values, as rows that count for nothing.
    """
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x"), F.col(target).alias("y"))
    counted = long.select("x.feature", "y", "x.v").where("v is not null and not isnan(v) and y is not null").groupBy("feature", "y", "v").agg(F.count("*").alias("n"))
    return _information(written(counted), k)


def _information(cells: DataFrame, k: int) -> DataFrame:
    """feature, n and knn_mi from a written table of counts (feature, y, v, n)."""
    classes = cells.groupBy("feature", "y").agg(F.sum("n").alias("n_y")).where("n_y > 1")
    near = written(_kth_distances(written(cells.join(classes, ["feature", "y"])), k))
    apart = F.col("d") > 0
    data = near.groupBy("feature", "v").agg(F.sum("n").alias("w")).select("feature", "v", F.lit(1).alias("flag"), "w", *(F.lit(None).cast(t).alias(c) for c, t in (("y", near.schema["y"].dataType), ("x", "double"), ("sign", "long"))))
    # An end stands before the rows that equal it (flag 0) or behind them (2); ends are open, but for d = 0.
    ends = F.explode(F.array(
        F.struct((F.col("v") - F.col("d")).alias("at"), F.when(apart, 2).otherwise(0).alias("flag"), F.lit(-1).cast("long").alias("sign")), F.struct((F.col("v") + F.col("d")).alias("at"), F.when(apart, 0).otherwise(2).alias("flag"), F.lit(1).cast("long").alias("sign"))
    ))
    asked = near.select("feature", "y", F.col("v").alias("x"), ends.alias("e")).select("feature", F.col("e.at").alias("v"), "e.flag", F.lit(0).cast("long").alias("w"), "y", "x", "e.sign")
    stream = data.unionByName(asked)
    counts = running(stream, "v", {"before": "w"}, ["feature"], then=["flag"], ranges=ranges_for(3 * near.count()), edges_by=["feature"])
    inside = counts.where("sign is not null").groupBy("feature", "y", F.col("x").alias("v")).agg(F.sum(F.col("sign") * F.col("before")).alias("m"))
    each = near.join(inside, ["feature", "y", "v"])
    term = F.col("n") * (digamma(F.col("k_y")) - digamma(F.col("n_y")) - digamma(F.col("m")))
    return each.groupBy("feature").agg(F.sum("n").alias("n"), F.sum(term).alias("s")).select("feature", "n", F.greatest(F.lit(0.0), digamma(F.col("n")) + F.col("s") / F.col("n")).alias("knn_mi"))


def _cells_of_bins(numbers: DataFrame, texts: DataFrame, bins: int) -> DataFrame:
    """feature, b, y and o: counts by class of equal-frequency bins of numbers, and of the values of texts."""
    counts = written(numbers.groupBy("feature", "v").agg(F.sum("n").alias("n")))
    found = places(counts, ["feature"], [k / bins for k in range(bins + 1)])
    edges = found.select(F.col("feature").alias("of"), edges_of(F.transform("ends", lambda x: between(x["a"], x["b"], x["part"]))).alias("e"))
    inner = F.slice("e", 2, F.greatest(F.size("e") - 2, F.lit(0)))
    # A row of at most bins + 1 numbers for each feature.
    binned = numbers.join(F.broadcast(edges), F.col("feature") == F.col("of")).select("feature", F.size(F.filter(inner, lambda e: e < F.col("v"))).cast("string").alias("b"), "y", "n")
    return binned.unionByName(texts.select("feature", F.col("s").alias("b"), "y", "n")).groupBy("feature", "b", "y").agg(F.sum("n").alias("o"))


def _tables(cells: DataFrame, least: int) -> DataFrame:
    """feature, chi2 (with Yates' correction for two by two) and plug-in mutual information of counts (feature, b, y, o).

    The cells that are not there need no row: chi-square is n times the sum of o^2 / (row * column), less n.
    """
    rows, columns = cells.groupBy("feature", "b").agg(F.sum("o").alias("r")), cells.groupBy("feature", "y").agg(F.sum("o").alias("c"))
    sides = rows.groupBy("feature").agg(F.count("*").alias("n_r"), F.sum(1 / F.col("r")).alias("over_r"), F.sum("r").alias("n")).join(columns.groupBy("feature").agg(F.count("*").alias("n_c"), F.sum(1 / F.col("c")).alias("over_c")), "feature")
    full = cells.join(rows, ["feature", "b"]).join(columns, ["feature", "y"]).join(sides, "feature")
    expected, n = F.col("r") * F.col("c") / F.col("n"), F.first("n")
    g = full.groupBy("feature").agg(
        n.alias("n"), ((F.first("n_r") - 1) * (F.first("n_c") - 1)).alias("dof"), (n * F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))) - n).alias("plain"),
        F.max(F.abs(F.col("o") - expected)).alias("gap"), (n * F.first("over_r") * F.first("over_c")).alias("inverse"),
        F.sum(F.col("o") / F.col("n") * F.ln(F.col("o") / expected)).alias("table_mi"),
    )
    yates = F.pow(F.col("gap") - F.least(F.lit(0.5), F.col("gap")), F.lit(2.0)) * F.col("inverse")
    return g.select("feature", F.when((F.col("n") >= least) & (F.col("dof") >= 1), F.when(F.col("dof") == 1, yates).otherwise(F.col("plain"))).alias("chi2"), "table_mi")


def filter_report(df: DataFrame, features: Sequence[str], target: str, bins: int = 10, k: int = 3, least: int = 20) -> DataFrame:
    """A row for each feature: its kind and family, rows, share of missing values, distinct values, whether it is constant or has near-zero variance, chi-square of its bins or values against the
    target's classes, mutual information (of nearest neighbours for numbers, plug-in for texts), rank correlation (numbers), and notes.

    The fact is read once, for counts by (feature, value, target); all figures are made from these
    counts, over all rows. Figures against the target leave out rows without one.
    """
    texts = {f.name for f in df.schema if f.dataType.simpleString() == "string"}
    tags = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), (F.lit(None).cast("double") if c in texts else F.col(c).cast("double")).alias("v"), (F.col(c) if c in texts else F.lit(None).cast("string")).alias("s")) for c in features)))
    cells = written(df.select(tags.alias("f"), F.col(target).alias("y")).select("f.*", "y").groupBy("feature", "v", "s", "y").agg(F.count("*").alias("n")))
    has = F.col("v").isNotNull() | F.col("s").isNotNull()
    sizes = cells.groupBy("feature").agg(F.sum("n").alias("n_rows"), F.sum(F.when(has, 0).otherwise(F.col("n"))).alias("n_missing"))
    values = cells.where(has).groupBy("feature", "v", "s").agg(F.sum("n").alias("n"))
    best = values.groupBy("feature").agg(F.count("*").alias("n_unique"), F.max(F.struct("n", "v", "s")).alias("top"))
    second = values.join(best, "feature").where("not (v <=> top.v and s <=> top.s)").groupBy("feature").agg(F.max("n").alias("second"))
    known = cells.where(has & F.col("y").isNotNull())
    numbers, strings = written(known.where("v is not null").select("feature", "v", "y", "n")), known.where("s is not null")
    every = df.sparkSession.createDataFrame([(c, family_of(c), c in texts) for c in features], "feature string, family string, is_text boolean")
    out = every.join(sizes, "feature", "left").join(best, "feature", "left").join(second, "feature", "left").join(_tables(_cells_of_bins(numbers, strings, bins), least), "feature", "left")
    out = out.join(_information(numbers, k).drop("n"), "feature", "left").join(_rank_correlations(numbers.withColumnRenamed("v", "x").withColumn("y", F.col("y").cast("double")), least).drop("n"), "feature", "left")
    unique, missing = F.coalesce("n_unique", F.lit(0)), F.col("n_missing") / F.col("n_rows")
    constant = unique <= 1
    flat = (unique / F.col("n_rows") < 0.01) & ((F.coalesce(F.col("top.n") / F.col("second"), F.lit(math.inf)) > 19) | constant)
    notes = F.array_join(F.array_compact(F.array(F.when(constant, "CONSTANT"), F.when(flat & ~constant, "NEAR_ZERO_VAR"), F.when(missing > 0.5, "HIGH_MISSING"))), "; ")
    return out.select(
        "feature", "family", F.when(F.col("is_text"), "categorical").when(unique <= 2, "binary").otherwise("numeric").alias("kind"), "n_rows", missing.alias("missing_rate"), unique.alias("n_unique"),
        constant.alias("is_constant"), flat.alias("near_zero_variance"), "chi2", F.when(F.col("is_text"), F.greatest(F.lit(0.0), "table_mi")).otherwise(F.col("knn_mi")).alias("mutual_information"), "spearman", notes.alias("notes"),
    )


def assessed_families(report: DataFrame, pairs: DataFrame, least: float = 0.002) -> DataFrame:
    """A row for each family of a filter report: means, redundant features (those in `pairs`), and what the rules say of it."""
    redundant = pairs.select(F.explode(F.array("feature_a", "feature_b")).alias("twin")).distinct()
    rows = report.join(redundant, F.col("feature") == F.col("twin"), "left")
    # Families hold a few features each.
    g = rows.groupBy("family").agg(
        F.count("*").alias("n_features"), F.avg("missing_rate").alias("mean_missing_rate"), F.avg("mutual_information").alias("mean_information"), F.count_if("near_zero_variance").alias("n_flat"),
        F.array_join(F.array_sort(F.collect_list("twin")), ", ").alias("redundant_features"),
    )
    signals = F.array_compact(F.array(F.when(F.col("mean_information") > least, "relevant"), F.when(F.col("redundant_features") != "", "has redundancy"), F.when(F.col("n_flat") > 0, F.concat(F.col("n_flat").cast("string"), F.lit(" near-zero variance")))))
    return g.withColumn("assessment", F.when(F.size(signals) > 0, F.array_join(signals, "; ")).otherwise("neutral"))


def family_report(scores: DataFrame, score: str = "score") -> DataFrame:
    """Features, number, mean and best score of each feature family."""
    spark = scores.sparkSession
    families = spark.createDataFrame([(f, n) for n, fs in FAMILIES.items() for f in fs], "feature string, family string")
    g = scores.join(F.broadcast(families), "feature", "left").groupBy(F.coalesce("family", F.lit("other")).alias("family"))
    return g.agg(F.count("*").alias("n_features"), F.avg(score).alias("mean_score"), F.max(score).alias("max_score"), F.array_join(F.sort_array(F.collect_set("feature")), ", ").alias("features"))


def family_importance(importance: DataFrame, score: str = "importance") -> DataFrame:
    """Number of features, sum, mean and maximum of their importance within each family."""
    spark = importance.sparkSession
    families = spark.createDataFrame([(f, n) for n, fs in FAMILIES.items() for f in fs], "feature string, family string")
    g = importance.join(F.broadcast(families), "feature", "left").groupBy(F.coalesce("family", F.lit("other")).alias("family"))
    return g.agg(F.count("*").alias("n_features"), F.sum(score).alias("total"), F.avg(score).alias("mean"), F.max(score).alias("most"))


def candidates(spark: SparkSession) -> DataFrame:
    """Every feature and stage: whether the pruned sets hold it, and the reasons (from `schema.PRUNED`, `schema.FAMILIES`)."""
    rules = spark.createDataFrame([(f, s, why) for (why, stages), fs in PRUNED.items() for f in fs for s in stages], "feature string, stage string, why string")
    of = [(f, s, not n.startswith("conditional"), f in FEATURE_SETS[f"{s}_expanded_safe"] or f in FEATURE_SETS[f"{s}_conditional"]) for n, fs in FAMILIES.items() for f in fs for s in ("cls", "reg")]
    all_features = spark.createDataFrame(of, "feature string, stage string, is_safe boolean, in_stage boolean")
    reasons = rules.groupBy("feature", "stage").agg(F.array_join(F.array_sort(F.collect_list("why")), "; ").alias("drop_reason"))
    df = all_features.join(reasons, ["feature", "stage"], "left").withColumn("drop_reason", F.coalesce("drop_reason", F.lit("")))
    kept = F.col("in_stage") & (F.col("drop_reason") == "")
    why = F.when(kept, F.when(F.col("is_safe"), "signal; always available").otherwise("signal; needs history")).otherwise("")
    return df.select("feature", "stage", (kept & F.col("is_safe")).alias("in_safe_pruned"), kept.alias("in_full_pruned"), why.alias("keep_reason"), "drop_reason", F.col("drop_reason").contains("redundant").alias("redundant"))


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """value and code of each value that is not null, from 0 in the order of values."""
    return codes_of(df.select(column).where(F.col(column).isNotNull()).distinct(), column)


def feature_kind(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """categorical, binary or numeric, and the family of each feature."""
    texts = {f.name for f in df.schema if f.dataType.simpleString() == "string"}
    one = df.agg(*(F.count_distinct(c).alias(c) for c in columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("n_unique"), F.lit(c in texts).alias("is_text"), F.lit(family_of(c)).alias("family")) for c in columns))
    rows = one.select(F.inline(pairs))
    return rows.select("feature", "family", "n_unique", F.when(F.col("is_text"), "categorical").when(F.col("n_unique") <= 2, "binary").otherwise("numeric").alias("kind"))


def safe_vs_conditional(scores: DataFrame, score: str = "score") -> DataFrame:
    """Number, mean and best feature of the unconditional and of the conditional families."""
    conditional = [f for n, fs in FAMILIES.items() if n.startswith("conditional") for f in fs]
    kind = F.when(F.col("feature").isin(*conditional), "conditional").otherwise("safe")
    return scores.groupBy(kind.alias("kind")).agg(F.count("*").alias("n_features"), F.avg(score).alias("mean_score"), F.max_by("feature", F.struct(score, "feature")).alias("best_feature"))
