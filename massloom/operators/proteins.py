"""Protein inference and counting on the graph of proteins and peptides."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def peptide_rollup(psms: DataFrame, key: list[str], score: str, psm_id: Column, extra: list[Column]) -> DataFrame:
    """A row for each peptide key: spectral_count, best_score, sorted psm ids, and the extra aggregates."""
    return psms.groupBy(*key).agg(F.count("*").alias("spectral_count"), F.max(score).alias("best_score"), F.array_join(F.array_sort(F.collect_list(psm_id)), ",").alias("psms"), *extra)


def indistinguishable_groups(edges: DataFrame) -> DataFrame:
    """Proteins with equal peptide sets as one group: columns protein_group ({a,b}), proteins, n_peptides. edges: protein, peptide, distinct.

    The sets are compared by count and two order-free sums of hashes, so no protein's
    peptides are gathered in one row.
    """
    signature = edges.groupBy("protein").agg(F.count("*").alias("n_peptides"), F.sum(F.xxhash64("peptide").cast("decimal(38,0)")).alias("_a"), F.sum(F.hash(F.lit(17), "peptide").cast("long")).alias("_b"))
    groups = signature.groupBy("n_peptides", "_a", "_b").agg(F.array_sort(F.collect_list("protein")).alias("proteins"))
    text = F.array_join(F.transform("proteins", lambda p: p.cast("string")), ",")
    return groups.select(F.when(F.size("proteins") == 1, text).otherwise(F.concat(F.lit("{"), text, F.lit("}"))).alias("protein_group"), "proteins", "n_peptides")


def parsimonious(edges: DataFrame, least_peptides: int, least_unique: int) -> DataFrame:
    """Proteins with enough peptides and enough that no other holds (edges distinct): columns protein, n_peptides, n_unique.

    least_unique of 0 leaves a greedy cover: see greedy_cover.
    """
    degree = edges.groupBy("peptide").agg(F.count("*").alias("_n"))
    counts = edges.join(degree, "peptide").groupBy("protein").agg(F.count("*").alias("n_peptides"), F.count(F.when(F.col("_n") == 1, 1)).alias("n_unique"))
    return counts.where((F.col("n_peptides") >= least_peptides) & (F.col("n_unique") >= max(least_unique, 1)))


def greedy_cover(edges: DataFrame, chosen: DataFrame, least_peptides: int) -> DataFrame:
    """More proteins, largest first (ties: smallest), until no unchosen protein with enough peptides is free of chosen peptides.

    Each round takes, at once, all proteins that are largest among those they share a
    peptide with: what one by one would take, too, as they don't affect each other. Rounds
    end when none is left; what is left after each is written to the shared folder.
    """
    sizes = edges.groupBy("protein").agg(F.count("*").alias("size")).where(F.col("size") >= least_peptides)
    left = edges.join(sizes, "protein")
    taken = _written(chosen.select("protein").distinct())
    out = taken
    while not taken.isEmpty() or out is taken:
        used = edges.join(taken, "protein", "left_semi").select("peptide").distinct()
        hit = left.join(used, "peptide", "left_semi").select("protein").distinct()
        left = _written(left.join(hit.unionByName(taken).distinct(), "protein", "left_anti"))
        rank = F.struct((-F.col("size")).alias("size"), "protein")
        best = left.groupBy("peptide").agg(F.min(rank).alias("best"))
        taken = _written(left.join(best, "peptide").groupBy("protein").agg(F.min((F.col("best.protein") == F.col("protein")).cast("int")).alias("all")).where("all = 1").select("protein"))
        if taken.isEmpty():
            break
        out = out.unionByName(taken)
    return out.distinct()


def _written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, reread: no lineage, and safe from lost executors."""
    spark = df.sparkSession
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    path = f"{base.rstrip('/')}/cover-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def run_counts(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of each (protein, run) from rows (run, peptide, spectra) and the chosen proteins' edges (protein, peptide).

    Unique peptides are those of one chosen protein; balanced spectra are each row's spectra
    divided by the number of chosen proteins that hold its peptide.
    """
    degree = edges.groupBy("peptide").agg(F.count("*").alias("_n"))
    per = rows.groupBy("run", "peptide").agg(F.sum("spectra").alias("spectra"))
    each = per.join(edges.join(degree, "peptide"), "peptide")
    unique = F.col("_n") == 1
    return each.groupBy("protein", "run").agg(
        F.count(F.when(unique, 1)).alias("unique_peptides"),
        F.count("*").alias("total_peptides"),
        F.sum(F.when(unique, F.col("spectra")).otherwise(0)).alias("unique_spectra"),
        F.sum("spectra").alias("total_spectra"),
        F.sum(F.col("spectra") / F.col("_n")).alias("balanced_spectra"),
    )


def normalised(counts: DataFrame, digits: int = 2) -> DataFrame:
    """balanced_spectra scaled so that all runs have the mean run's total: column normalised_spectra."""
    totals = counts.groupBy("run").agg(F.sum("balanced_spectra").alias("_total"))
    mean = totals.agg(F.avg("_total").alias("_mean"))
    scale = F.broadcast(totals.crossJoin(mean))  # one row a run
    return counts.join(scale, "run").withColumn("normalised_spectra", F.round(F.col("balanced_spectra") * F.col("_mean") / F.col("_total"), digits)).drop("_total", "_mean")


def match_features(psms: DataFrame, peptide: str, protein: str) -> DataFrame:
    """Features of each (peptide, protein) pair's peptide from the graph: how many proteins share it, and its proteins' largest counts.

    Columns: peptide, n_proteins, most_unique_spectra, most_shared_spectra, most_peptides. All
    are aggregates of distinct edges with their spectra, joined back by peptide.
    """
    edges = psms.groupBy(peptide, protein).agg(F.count("*").alias("spectra"))
    degree = edges.groupBy(peptide).agg(F.count("*").alias("n_proteins"))
    each = edges.join(degree, peptide)
    alone = F.col("n_proteins") == 1
    of_protein = each.groupBy(protein).agg(F.sum(F.when(alone, F.col("spectra")).otherwise(0)).alias("unique_spectra"), F.sum(F.when(~alone, F.col("spectra")).otherwise(0)).alias("shared_spectra"), F.count("*").alias("peptides"))
    best = each.join(of_protein, protein).groupBy(peptide, "n_proteins")
    return best.agg(F.max("unique_spectra").alias("most_unique_spectra"), F.max("shared_spectra").alias("most_shared_spectra"), F.max(F.col("peptides") - 1).alias("most_other_peptides"))


def first_protein_wins(psms: DataFrame, psm: list[str], order: list[Column]) -> DataFrame:
    """Each match counts for its first protein only."""
    w = Window.partitionBy(*psm).orderBy(*order)
    return psms.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def identical_sets(members: DataFrame, owner: str, item: str) -> DataFrame:
    """Owners with equal item sets as one row: owners (joined by commas, in order), n_items. members distinct."""
    signature = members.groupBy(owner).agg(F.count("*").alias("n_items"), F.sum(F.xxhash64(item).cast("decimal(38,0)")).alias("_a"), F.sum(F.hash(F.lit(17), item).cast("long")).alias("_b"))
    return signature.groupBy("n_items", "_a", "_b").agg(F.array_join(F.transform(F.array_sort(F.collect_list(owner)), lambda o: o.cast("string")), ",").alias("owners")).select("owners", "n_items")


def census(proteins: DataFrame, train: Column, test: Column) -> DataFrame:
    """Counts of training and test decoys and forward proteins, and the test to forward ratio."""
    counts = proteins.agg(F.count(F.when(train, 1)).alias("n_train"), F.count(F.when(test & ~train, 1)).alias("n_test"), F.count(F.when(~train & ~test, 1)).alias("n_forward"))
    return counts.withColumn("test_to_forward", F.col("n_test") / F.col("n_forward"))


def cluster_levels(levels: list[float], threshold: float) -> list[int]:
    """Cluster number of each of the sorted levels: the two neighbouring clusters whose means are nearest merge, while at most threshold apart."""
    clusters = [[x] for x in levels]
    while len(clusters) > 1:
        means = [sum(c) / len(c) for c in clusters]
        gap, i = min((b - a, i) for i, (a, b) in enumerate(zip(means, means[1:], strict=False)))
        if gap > threshold:
            break
        clusters[i : i + 2] = [clusters[i] + clusters[i + 1]]
    return [k for k, c in enumerate(clusters) for _ in c]


def _cluster_group(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Clusters distinct levels with their weights: an agglomeration over at most as many nodes as levels differ."""
    group = group.sort_values("level")
    means, weights = group["level"].tolist(), group["n"].tolist()
    members = [[i] for i in range(len(means))]
    while len(means) > 1:
        gap, i = min((b - a, i) for i, (a, b) in enumerate(zip(means, means[1:], strict=False)))
        if gap > threshold:
            break
        total = weights[i] + weights[i + 1]
        means[i : i + 2] = [(means[i] * weights[i] + means[i + 1] * weights[i + 1]) / total]
        weights[i : i + 2] = [total]
        members[i : i + 2] = [members[i] + members[i + 1]]
    cluster = {m: k for k, c in enumerate(members) for m in c}
    return group.assign(cluster=[cluster[i] for i in range(len(group))])[["owner", "level", "n", "cluster"]]


def enrichment_clusters(levels: DataFrame, threshold: float) -> DataFrame:
    """Agglomerative clusters of each owner's levels (owner, level): owner, cluster, mean_level, sd_level, n, levels.

    Equal levels are one weighted node before the shuffle to owners, and levels come from
    the few enrichment settings of a sweep, so an owner's group is small.
    """
    owner = levels.schema["owner"].dataType.simpleString()
    counted = levels.groupBy("owner", "level").agg(F.count("*").alias("n"))
    placed = counted.groupBy("owner").applyInPandas(lambda g: _cluster_group(g, threshold), f"owner {owner}, level double, n long, cluster int")
    mean = F.sum(F.col("level") * F.col("n")) / F.sum("n")
    square = F.sum(F.col("level") * F.col("level") * F.col("n"))
    out = placed.groupBy("owner", "cluster").agg(mean.alias("mean_level"), square.alias("_q"), F.sum("n").alias("n"), F.array_sort(F.collect_list("level")).alias("levels"))
    variance = (F.col("_q") - F.col("n") * F.col("mean_level") * F.col("mean_level")) / (F.col("n") - 1)
    return out.withColumn("sd_level", F.when(F.col("n") > 1, F.sqrt(F.greatest(variance, F.lit(0.0)))).otherwise(0.0)).drop("_q")


def linked_features(psms: DataFrame, peptide: str, form: str, protein: str) -> DataFrame:
    """Features of each form of a peptide from the graph of peptides and proteins: one row for each (peptide, form).

    psms: a row for each match and protein of it. A peptide's proteins are those of all its matches, and each
    of them counts all its matches, as unique if it has one protein, else as shared (or a share
    each, balanced). Of a peptide's proteins the counts without the match itself are compared.

    form_spectra, peptide_spectra, n_proteins; most_unique, most_shared, most_balanced and sum_unique, sum_shared, sum_balanced over the
    proteins; linked_unique and linked_shared of the protein with most of both (ties: the
    smallest), linked_balanced_unique and linked_balanced_shared likewise; peptides,
    unique_peptides, shared_peptides (the most of a protein); most_other_spectra, those of the
    strongest other peptide that shares a protein with this one (0 without any).
    """
    forms = psms.groupBy(peptide, form).agg(F.count("*").alias("form_spectra"))
    counts = forms.groupBy(peptide).agg(F.sum("form_spectra").alias("peptide_spectra"))
    edges = psms.select(peptide, protein).distinct()
    degree = edges.groupBy(peptide).agg(F.count("*").alias("n_proteins"))
    each = edges.join(degree, peptide).join(counts, peptide)
    alone = F.col("n_proteins") == 1
    spectra = F.col("peptide_spectra")
    rank = F.struct(spectra.alias("n"), F.col(peptide).alias("p"))
    of_protein = each.groupBy(protein).agg(
        F.sum(F.when(alone, spectra).otherwise(0)).alias("u"), F.sum(F.when(alone, 0).otherwise(spectra)).alias("s"), F.sum(F.when(alone, 0.0).otherwise(spectra / F.col("n_proteins"))).alias("b"),
        F.count("*").alias("peptides"), F.count(F.when(alone, 1)).alias("up"), F.count(F.when(~alone, 1)).alias("sp"), F.max(rank).alias("first"),
    )
    # the best holder but for the best one: with the two, the greatest over all others is known to each peptide
    second = each.join(of_protein.select(protein, "first"), protein).where(F.col(peptide) != F.col("first.p")).groupBy(protein).agg(F.max(rank).alias("second"))
    both = each.join(of_protein, protein).join(second, protein, "left")
    u, s = F.col("u") - alone.cast("int"), F.col("s") - (~alone).cast("int")
    b = F.round(F.col("b") - F.when(alone, 0.0).otherwise(1 / F.col("n_proteins")), 6)
    other = F.when(F.col(peptide) == F.col("first.p"), F.col("second.n")).otherwise(F.col("first.n"))
    both = both.select(peptide, protein, "n_proteins", "peptide_spectra", u.alias("u"), s.alias("s"), b.alias("b"), "peptides", "up", "sp", other.alias("other"))
    linked = F.min(F.struct((-(F.col("u") + F.col("s"))).alias("order"), F.col(protein).alias("by"), "u", "s"))
    balanced = F.min(F.struct(F.round(-(F.col("u") + F.col("b")), 6).alias("order"), F.col(protein).alias("by"), "u", "b"))
    rows = both.groupBy(peptide, "n_proteins", "peptide_spectra").agg(
        F.max("u").alias("most_unique"), F.max("s").alias("most_shared"), F.max("b").alias("most_balanced"), F.sum("u").alias("sum_unique"), F.sum("s").alias("sum_shared"), F.round(F.sum("b"), 6).alias("sum_balanced"),
        linked.alias("l"), balanced.alias("m"), F.max("peptides").alias("peptides"), F.max("up").alias("_up"), F.max("sp").alias("_sp"), F.coalesce(F.max("other"), F.lit(0)).alias("most_other_spectra"),
    )
    one = F.col("n_proteins") == 1
    rows = rows.select(
        peptide, "n_proteins", "peptide_spectra", "most_unique", "most_shared", "most_balanced", "sum_unique", "sum_shared", "sum_balanced",
        F.col("l.u").alias("linked_unique"), F.col("l.s").alias("linked_shared"), F.col("m.u").alias("linked_balanced_unique"), F.col("m.b").alias("linked_balanced_shared"),
        "peptides", F.when(one, F.col("_up")).otherwise(0).alias("unique_peptides"), F.when(one, 0).otherwise(F.col("_sp")).alias("shared_peptides"), "most_other_spectra",
    )
    return forms.join(rows, peptide)


def peptide_spectra(psms: DataFrame, peptide: str, protein: str) -> DataFrame:
    """Of linked_features those that rescoring needs: peptide, peptide_spectra and linked_spectra, the most unique and shared spectra of one of its proteins without itself.

    A protein counts all spectra of each of its peptides, as unique or as shared, so their sum needs neither told apart.
    """
    pairs = psms.groupBy(peptide, protein).agg(F.count("*").alias("_n"))
    counts = pairs.groupBy(peptide).agg(F.sum("_n").alias("peptide_spectra"))
    each = pairs.select(peptide, protein).join(counts, peptide)
    of_protein = each.groupBy(protein).agg(F.sum("peptide_spectra").alias("_all"))
    return each.join(of_protein, protein).groupBy(peptide, "peptide_spectra").agg((F.max("_all") - 1).alias("linked_spectra"))
