"""Ranking candidates of a scan, and score cutoffs by target-decoy false discovery rates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.operators.work import written


def ordinal(by: Sequence[str], order: Sequence[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The k first rows of each group under a total order (Spark limits groups before the shuffle)."""
    return df.withColumn("rank", ordinal(by, order)).where(F.col("rank") <= k)


def top_in_any_score(df: DataFrame, by: Sequence[str], scores: Sequence[str], ties: Sequence[Column], k: int) -> DataFrame:
    """Rank rows of a group by each score (descending) on its own; keep those among the k first by any."""
    for s in scores:
        df = df.withColumn(f"rank_{s}", ordinal(by, [F.desc(s), *ties]))
    return df.where(F.least(*(F.col(f"rank_{s}") for s in scores)) <= k)


def score_difference(score: str, by: Sequence[str], order: Sequence[Column]) -> Column:
    """Score less that of the next-ranked row; 0 for the last."""
    w = Window.partitionBy(*by).orderBy(*order)
    return F.coalesce(F.col(score) - F.lead(score, 1).over(w), F.lit(0.0))


def relative_difference(score: str, by: Sequence[str], order: Sequence[Column]) -> Column:
    """First row: its score over the second's, less 1 (1 if that is 0, and 0 if it is alone); others: their score over the first's, less 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    following, best = F.lead(score, 1).over(w), F.first(score).over(w)
    first = F.when(following.isNull(), 0.0).when(following == 0, 1.0).otherwise(F.col(score) / following - 1)
    return F.when(F.row_number().over(w) == 1, first).otherwise(F.when(best == 0, 0.0).otherwise(F.col(score) / best - 1))


def best_and_second(df: DataFrame, by: Sequence[str], score: str, order: Sequence[Column]) -> DataFrame:
    """The best row of each group, with second (the next row's score, or its own) and delta between both."""
    w = Window.partitionBy(*by).orderBy(*order)
    ranked = df.withColumn("rank", F.row_number().over(w)).withColumn("second", F.coalesce(F.lead(score, 1).over(w), F.col(score)))
    return ranked.where(F.col("rank") == 1).drop("rank").withColumn("delta", F.col(score) - F.col("second"))


def consensus(df: DataFrame, by: Sequence[str], scores: Sequence[str], peptide: str, ties: Sequence[Column]) -> DataFrame:
    """The winner of each score, with how far the winners disagree: 0 all agree, 1 in a pair, 2 alone, 3 alone against a pair."""
    ranked = top_in_any_score(df, by, scores, ties, 1)
    wins = ranked.select(*by, peptide, F.explode(F.array(*(F.when(F.col(f"rank_{s}") == 1, F.lit(s)) for s in scores))).alias("score")).where("score is not null")
    same = F.count("*").over(Window.partitionBy(*by, peptide))
    pair = F.max((F.col("agreeing") == 2).cast("int")).over(Window.partitionBy(*by))
    wins = wins.withColumn("agreeing", same)
    level = F.when(F.col("agreeing") == 3, 0).when(F.col("agreeing") == 2, 1).when(pair == 1, 3).otherwise(2)
    return wins.select(*by, peptide, "score", level.alias("disagreement"))


def running_sums(df: DataFrame, by: Sequence[str], position: str, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """Add running sums (up to and including the row) in descending order of a number and further ties.

    No task holds a whole class: rows are dealt to ranges of the whole order, ties and all, so neither an outlier
    nor one frequent number fills a range. The ranges' sums (a row for each class and range) are run up first,
    then the rows within each range. Null positions come last.
    """
    keyed = df.select("*", *(c.alias(f"_s_{n}") for n, c in sums.items()))
    keys = [F.desc(position), *order]
    dealt, _ = written(keyed.repartitionByRange(*(F.col(c) for c in by), *keys).withColumn("_part", F.spark_partition_id()), "running-sums")
    part = [*by, "_part"]
    totals = dealt.groupBy(*part).agg(*(F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums))
    ahead = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*(F.col(c).alias(f"_k_{c}") for c in part), *(F.coalesce(F.sum(f"_t_{n}").over(ahead), F.lit(0)).alias(f"_o_{n}") for n in sums))
    within = Window.partitionBy(*part).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    same = reduce(lambda x, y: x & y, (dealt[c].eqNullSafe(offsets[f"_k_{c}"]) for c in part))
    out = dealt.join(offsets, same)
    return out.select(*df.columns, *((F.sum(f"_s_{n}").over(within) + F.col(f"_o_{n}")).alias(n) for n in sums))


def decoy_cutoff(df: DataFrame, by: Sequence[str], score: str, target: Column, decoy: Column, threshold: float, order: Sequence[Column]) -> DataFrame:
    """Lowest score of each class down to which decoys / targets stays within threshold at some row: columns by, cutoff.

    order: ties below the score. Rows that are neither target nor decoy never set the cutoff.
    """
    marked = df.withColumn("_t", target.cast("long")).withColumn("_d", decoy.cast("long"))
    running = running_sums(marked, by, score, order, {"_ct": F.col("_t"), "_cd": F.col("_d")})
    good = running.where(((F.col("_t") == 1) | (F.col("_d") == 1)) & (F.col("_ct") > 0) & (F.col("_cd") <= F.lit(threshold) * F.col("_ct")))
    return good.groupBy(*by).agg(F.min(score).alias("cutoff"))


def passing(df: DataFrame, cutoffs: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    """Rows at or above their class's cutoff; classes without one have none. cutoffs has a row for each class."""
    return df.join(cutoffs, list(by)).where(F.col(score) >= F.col("cutoff"))


def grid_cutoff(df: DataFrame, by: Sequence[str], score: str, decoy: Column, threshold: float, steps: int = 10_000) -> DataFrame:
    """Cutoff on the grid max, max - mean/steps, ... above min: the last at which decoys / all <= threshold and rows were added."""
    span = df.groupBy(*by).agg(F.max(score).alias("_max"), F.min(score).alias("_min"), (F.avg(score) / steps).alias("_step"))
    placed = df.join(F.broadcast(span), list(by)).withColumn("_k", F.ceil((F.col("_max") - F.col(score)) / F.col("_step")).cast("long"))
    bins = placed.groupBy(*by, "_max", "_min", "_step", "_k").agg(F.count("*").alias("_n"), F.sum(decoy.cast("long")).alias("_f"))
    w = Window.partitionBy(*by).orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    running = bins.withColumn("_rows", F.sum("_n").over(w)).withColumn("_decoys", F.sum("_f").over(w)).withColumn("cutoff", F.col("_max") - F.col("_k") * F.col("_step"))
    good = running.where((F.col("_decoys") <= F.lit(threshold) * F.col("_rows")) & ((F.col("cutoff") > F.col("_min")) | (F.col("_k") == 0)))
    return good.groupBy(*by).agg(F.max("_k").alias("grid_index"), F.max("_rows").alias("n_rows"), F.max("_decoys").alias("n_decoys"))


def refine_by_maximum(df: DataFrame, score: str, decoy: Column, threshold: float, order: Sequence[Column]) -> DataFrame:
    """From the lowest score up, the first row from which decoys / rows left is at most threshold; that row and all above.

    order: ties in descending order, so that the last of them is the lowest row.
    """
    left = running_sums(df.withColumn("_d", decoy.cast("long")), [], score, order, {"_rows": F.lit(1).cast("long"), "_decoys": F.col("_d")})
    start = left.where(F.col("_decoys") <= F.lit(threshold) * F.col("_rows")).agg(F.max("_rows").alias("_from"))
    return left.join(F.broadcast(start), F.col("_rows") <= F.col("_from")).drop("_d", "_rows", "_decoys", "_from")


def label_of(proteins: Column, reserved: str | None, train: str, test: str) -> Column:
    """4 if all proteins are reserved decoys, else 2 if all are training or reserved, 3 if all are decoys, 1 with any forward one."""
    def all_of(*prefixes: str) -> Column:
        return F.forall(proteins, lambda p: F.lit(False) if not prefixes else F.greatest(*(p.startswith(x) for x in prefixes), F.lit(False)))

    known = [x for x in (reserved,) if x]
    out = F.when(all_of(*known), 4) if known else F.when(F.lit(False), 4)
    return out.when(all_of(train), 2).when(all_of(train, test, *known), 3).otherwise(1)


def has_target(proteins: Column, prefixes: Sequence[str]) -> Column:
    """Whether any protein has none of the decoys' prefixes."""
    return F.exists(proteins, lambda p: ~F.greatest(*(p.startswith(x) for x in prefixes), F.lit(False)))


def score_statistics(df: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    """Number, mean and sample deviation (0 for one) of a group's scores."""
    return df.groupBy(*by).agg(F.count(score).alias("n"), F.avg(score).alias("mean"), F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("deviation"))


def purge(df: DataFrame, by: Sequence[str], scores: Sequence[str], ties: Sequence[Column], trigger: int = 100, k: int = 20) -> DataFrame:
    """Groups of more than `trigger` rows keep those among the k first by any score; others keep all."""
    ranked = df.withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    for s in scores:
        ranked = ranked.withColumn(f"_rank_{s}", ordinal(by, [F.desc(s), *ties]))
    ranks = [f"_rank_{s}" for s in scores]
    return ranked.where((F.col("_n") <= trigger) | (F.least(*ranks) <= k)).drop("_n", *ranks)


def best_with_merged_ties(df: DataFrame, by: Sequence[str], order: Sequence[Column], item: str, name: str) -> DataFrame:
    """The first row of each group; rows that tie with it in all of `order` add their items to its sorted list."""
    w = Window.partitionBy(*by).orderBy(*order)
    tied = df.withColumn("_r", F.rank().over(w)).where("_r = 1").drop("_r")
    rest = [c for c in df.columns if c not in (*by, item)]
    return tied.groupBy(*by).agg(*(F.min_by(c, item).alias(c) for c in rest), F.array_sort(F.collect_set(item)).alias(name))


#: Masses that differ by less are equal.
SAME_MASS = 0.00005


def localisation(df: DataFrame, by: Sequence[str], scores: Sequence[str], original: str, identified: str, ptms: str, ties: Sequence[Column], mass: str | None = None) -> DataFrame:
    """For each score's first candidate of a scan: delta_p, how far its first isomer falls behind.

    An isomer has the same original peptide and number of modifications at other places; where a column of
    calculated masses is given, an equal mass and as long a text instead of the number. Its
    distance is the mean over all scores, relative to the scan's best of each (0 where that
    is 0). A modified peptide without an isomer has 1, an unmodified one null.
    """
    w = Window.partitionBy(*by)
    df = df.withColumns({f"_max_{s}": F.max(s).over(w) for s in scores})
    parts = []
    for s in scores:
        ordered = w.orderBy(F.desc(s), *ties)
        ranked = df.select("*", F.row_number().over(ordered).alias("_r"), F.first(F.struct(original, identified, ptms, *scores, *([mass] if mass else []))).over(ordered).alias("_top"))
        same = F.col(ptms) == F.col(f"_top.{ptms}")
        if mass:
            same = (F.abs(F.col(mass) - F.col(f"_top.{mass}")) < SAME_MASS) & (F.length(F.col(identified).cast("string")) == F.length(F.col(f"_top.{identified}").cast("string")))
        isomer = (F.col(original) == F.col(f"_top.{original}")) & same & (F.col(identified) != F.col(f"_top.{identified}"))
        behind = sum((F.when(F.col(f"_max_{x}") != 0, (F.col(f"_top.{x}") - F.col(x)) / F.col(f"_max_{x}")).otherwise(0.0) for x in scores), F.lit(0.0)) / len(scores)
        found = ranked.groupBy(*by).agg(F.first("_top").alias("_top"), F.min_by(behind, F.when(isomer, F.col("_r"))).alias("_behind"))
        delta = F.when(F.col(f"_top.{ptms}") > 0, F.coalesce("_behind", F.lit(1.0)))
        parts.append(found.select(*by, F.lit(s).alias("score"), F.col(f"_top.{identified}").alias(identified), delta.alias("delta_p")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_positive_best(df: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    """Rows of the groups whose best score is above 0."""
    return df.withColumn("_best", F.max(score).over(Window.partitionBy(*by))).where("_best > 0").drop("_best")


def without_zero_scores(df: DataFrame, scores: Sequence[str]) -> DataFrame:
    """Rows of which no score is exactly 0."""
    keep = F.lit(True)
    for s in scores:
        keep = keep & (F.col(s) != 0)
    return df.where(keep)


def report_statistics(psms: DataFrame, label: Column, peptide: list[str]) -> DataFrame:
    """One row: matches, distinct peptides and the decoy share of both, by label (1 forward, 2 training decoy, 3 test decoy)."""
    labelled = psms.withColumn("_label", label)
    peptides = labelled.groupBy(*peptide).agg(F.min("_label").alias("_label"), F.count("*").alias("_n"), *(F.count(F.when(F.col("_label") == k, 1)).alias(f"_n{k}") for k in (1, 2, 3)))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    n = {k: F.coalesce(F.sum(f"_n{k}"), F.lit(0)) for k in (1, 2, 3)}
    m = {k: F.count(F.when(F.col("_label") == k, 1)) for k in (1, 2, 3)}
    return peptides.agg(
        n[1].alias("forward_psms"), n[2].alias("train_psms"), n[3].alias("test_psms"), ratio(n[3], n[1]).alias("psm_fdr"),
        m[1].alias("forward_peptides"), m[2].alias("train_peptides"), m[3].alias("test_peptides"), ratio(m[3], m[1]).alias("peptide_fdr"),
    )


def without_decoys(df: DataFrame, names: str, prefixes: Sequence[str]) -> DataFrame:
    """Rows whose protein names (a text) hold none of the decoys' prefixes anywhere; rows without names stay."""
    for p in prefixes:
        df = df.where(F.coalesce(~F.col(names).contains(p), F.lit(True)))
    return df
