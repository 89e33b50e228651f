"""Queries over the graph of proteins and peptides, and quantification by protein."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.operators import digest, inference, joins, proteins, quant
from massloom.operators.work import written
from massloom.plans.spectrum_queries import AFTER, BEFORE, _digest_sql
from massloom.plans.tables import EDGES, PROTEINS, PSM, TIES, Registry, edges, is_test, is_train, psms, sequences, table, ties

REGISTRY = Registry()
query = REGISTRY.add


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_discount >= 0.1 AND l_quantity >= 50)")
def protein_subset_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    needed = table(spark, sf_dir, "lineitem").where((F.col("l_discount") >= 0.1) & (F.col("l_quantity") >= 50)).select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf_dir, "supplier").join(needed, "s_suppkey", "left_semi").select("s_suppkey", "s_name", "s_nationkey")


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_discount >= 0.1 AND l_quantity >= 50)")
def protein_subset_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").where((F.col("l_discount") >= 0.1) & (F.col("l_quantity") >= 50)).select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf_dir, "supplier").join(used, "s_suppkey", "left_anti").select("s_suppkey", "s_name", "s_nationkey")


@query(f"""WITH e AS (SELECT pep, protein, count(*) AS s FROM {PSM} GROUP BY ALL), x AS (SELECT *, count(*) OVER (PARTITION BY pep) AS n FROM e),
    p AS (SELECT protein, sum(CASE WHEN n = 1 THEN s ELSE 0 END) AS u, sum(CASE WHEN n > 1 THEN s ELSE 0 END) AS h, count(*) AS k FROM x GROUP BY protein)
    SELECT pep, n AS n_proteins, CAST(max(u) AS BIGINT) AS most_unique_spectra, CAST(max(h) AS BIGINT) AS most_shared_spectra, CAST(max(k - 1) AS BIGINT) AS most_other_peptides FROM x JOIN p USING (protein) GROUP BY pep, n""")
def protein_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proteins.match_features(psms(spark, sf_dir), "pep", "protein")


#: A sparse part of the graph, so that equal peptide sets occur.
_SPARSE = "(SELECT DISTINCT l_orderkey AS protein, l_suppkey % 7 AS peptide FROM lineitem)"


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("protein"), (F.col("l_suppkey") % 7).alias("peptide")).distinct()


@query(f"WITH s AS (SELECT protein, list_sort(list(peptide)) AS k FROM {_SPARSE} GROUP BY protein) SELECT CASE WHEN count(*) = 1 THEN CAST(min(protein) AS VARCHAR) ELSE '{{' || array_to_string(list_sort(list(protein)), ',') || '}}' END AS protein_group, CAST(len(k) AS BIGINT) AS n_peptides FROM s GROUP BY k")
def indistinguishable_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proteins.indistinguishable_groups(_sparse(spark, sf_dir)).select("protein_group", "n_peptides")


@query(f"WITH s AS (SELECT protein, list_sort(list(peptide)) AS k FROM {_SPARSE} GROUP BY protein) SELECT array_to_string(list_sort(list(protein)), ',') AS owners, CAST(len(k) AS BIGINT) AS n_items FROM s GROUP BY k")
def identical_set_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proteins.identical_sets(_sparse(spark, sf_dir), "protein", "peptide")


#: Suppliers and the orders that they have a part in: many orders have one supplier.
_SHARED = "(SELECT DISTINCT l_suppkey AS protein, l_orderkey AS peptide FROM lineitem)"


@query(f"WITH x AS (SELECT *, count(*) OVER (PARTITION BY peptide) AS n FROM {_SHARED}) SELECT protein, CAST(count(*) AS BIGINT) AS n_peptides, CAST(count(CASE WHEN n = 1 THEN 1 END) AS BIGINT) AS n_unique FROM x GROUP BY protein HAVING count(*) >= 100 AND count(CASE WHEN n = 1 THEN 1 END) >= 15")
def protein_filter_parsimony(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("protein"), F.col("l_orderkey").alias("peptide")).distinct()
    return proteins.parsimonious(shared, 100, 15)


@query(f"""WITH RECURSIVE s AS MATERIALIZED (SELECT protein, list(peptide) AS k FROM {_SPARSE} GROUP BY protein),
    r AS (SELECT 0 AS step, CAST(NULL AS BIGINT) AS protein, CAST([] AS BIGINT[]) AS used UNION ALL
        SELECT step + 1, best.protein, list_concat(used, best.k) FROM (SELECT r.step, r.used, min(struct_pack(size := -len(s.k), protein := s.protein, k := s.k)) AS best FROM r JOIN s ON NOT list_has_any(s.k, r.used) GROUP BY r.step, r.used))
    SELECT protein FROM r WHERE step > 0""")
def greedy_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proteins taken one by one, the largest that shares no peptide with those taken."""
    graph = _sparse(spark, sf_dir)
    return proteins.greedy_cover(graph, graph.select("protein").limit(0), 1)


_RUNS = "(SELECT o_orderpriority AS run, l_partkey AS peptide, l_suppkey AS protein FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_COUNTS = f"""SELECT protein, run, CAST(count(CASE WHEN n = 1 THEN 1 END) AS BIGINT) AS unique_peptides, CAST(count(*) AS BIGINT) AS total_peptides, CAST(sum(CASE WHEN n = 1 THEN s ELSE 0 END) AS BIGINT) AS unique_spectra, CAST(sum(s) AS BIGINT) AS total_spectra, sum(s / CAST(n AS DOUBLE)) AS balanced
    FROM (SELECT run, peptide, count(*) AS s FROM {_RUNS} GROUP BY ALL) JOIN (SELECT *, count(*) OVER (PARTITION BY peptide) AS n FROM {EDGES}) USING (peptide) GROUP BY protein, run"""


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("run"))
    rows = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("run", F.col("l_partkey").alias("peptide"), F.lit(1).alias("spectra"))
    return proteins.run_counts(rows, edges(spark, sf_dir))


@query(f"SELECT * EXCLUDE (balanced), round(balanced, 6) AS balanced_spectra FROM ({_COUNTS})")
def balanced_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).withColumn("balanced_spectra", F.round("balanced_spectra", 6))


@query(f"WITH c AS ({_COUNTS}), t AS (SELECT run, sum(balanced) AS total FROM c GROUP BY run) SELECT protein, run, round(balanced * (SELECT avg(total) FROM t) / total, 6) AS normalised_spectra FROM c JOIN t USING (run)")
def normalized_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proteins.normalised(_counts(spark, sf_dir), digits=6).select("protein", "run", "normalised_spectra")


_WINS = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, scan ORDER BY protein, {TIES}) r FROM {PSM}) WHERE r = 1)"


@query(f"SELECT protein, CAST(count(CASE WHEN file = 'A' THEN 1 END) AS BIGINT) AS n_A, CAST(count(CASE WHEN file = 'N' THEN 1 END) AS BIGINT) AS n_N, CAST(count(CASE WHEN file = 'R' THEN 1 END) AS BIGINT) AS n_R, CAST(count(DISTINCT file) AS BIGINT) AS n_files FROM {_WINS} GROUP BY protein")
def spectra_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    won = proteins.first_protein_wins(psms(spark, sf_dir), ["file", "scan"], [F.col("protein"), *ties()])
    return quant.spectra_pivot(won, "protein", "file", ["A", "N", "R"])


@query(f"SELECT file, protein, CAST(count(*) AS BIGINT) AS n_psms, median(pct) AS median_pct, CAST(count(CASE WHEN pct > 0.05 THEN 1 END) AS BIGINT) AS n_labelled FROM {_WINS} GROUP BY file, protein")
def label_pct_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    won = proteins.first_protein_wins(psms(spark, sf_dir), ["file", "scan"], [F.col("protein"), *ties()])
    return quant.labelled_summary(won, ["file", "protein"], "pct", 0.05)


@query(f"SELECT protein, max(mvh) AS best_score, CAST(count(*) AS BIGINT) AS n_psms FROM {PSM} GROUP BY protein")
def max_score_protein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return psms(spark, sf_dir).groupBy("protein").agg(F.max("mvh").alias("best_score"), F.count("*").alias("n_psms"))


@query(f"WITH d AS (SELECT scan FROM {PSM} GROUP BY scan HAVING count(DISTINCT protein) = 1) SELECT protein, round(sum(mvh), 2) AS ion_1, round(sum(xcorr), 2) AS ion_2 FROM {PSM} JOIN d USING (scan) GROUP BY protein")
def reporter_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = psms(spark, sf_dir)
    unique = rows.groupBy("scan").agg(F.min("protein").alias("a"), F.max("protein").alias("b")).where("a = b").select("scan")
    return rows.join(unique, "scan", "left_semi").groupBy("protein").agg(F.round(F.sum("mvh"), 2).alias("ion_1"), F.round(F.sum("xcorr"), 2).alias("ion_2"))


@query(f"WITH t AS (SELECT sum(mvh) AS a, sum(xcorr) AS b FROM {PSM}) SELECT file, scan, line, pep, round(mvh * (a + b) / (2 * a), 4) AS ion_1, round(xcorr * (a + b) / (2 * b), 4) AS ion_2 FROM {PSM} CROSS JOIN t")
def intensity_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = psms(spark, sf_dir).select("file", "scan", "line", "pep", F.col("mvh").alias("ion_1"), F.col("xcorr").alias("ion_2"))
    return quant.intensity_normalised(rows, ["ion_1", "ion_2"]).select("file", "scan", "line", "pep", F.round("ion_1", 4).alias("ion_1"), F.round("ion_2", 4).alias("ion_2"))


@query(f"SELECT protein, round(avg(pct), 8) AS mean_level, round(coalesce(stddev_samp(pct), 0), 8) AS sd_level, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT pep) AS BIGINT) AS n_peptides FROM {PSM} GROUP BY protein")
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    sd = F.coalesce(F.stddev_samp("pct"), F.lit(0.0))
    return psms(spark, sf_dir).groupBy("protein").agg(F.round(F.avg("pct"), 8).alias("mean_level"), F.round(sd, 8).alias("sd_level"), F.count("*").alias("n"), F.count_distinct("pep").alias("n_peptides"))


@query()
def hier_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrichment clusters of each protein's label percentages."""
    levels = psms(spark, sf_dir).where(~is_train() & ~is_test()).select(F.col("protein").alias("owner"), (F.col("pct") * 100).alias("level"))
    out = proteins.enrichment_clusters(levels, 1.5)
    return out.select("owner", "cluster", F.round("mean_level", 6).alias("mean_level"), F.round("sd_level", 6).alias("sd_level"), "n")


@query()
def logreg_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of each match not to be a training decoy, by a logistic regression over its scores."""
    from massloom.operators.learning import rescore

    rows = psms(spark, sf_dir).withColumn("label", F.when(is_train(), 0.0).otherwise(1.0))
    return rescore(rows, ["mvh", "xcorr", "wdp", "pct"], "label").select("file", "scan", "line", "pep", "protein", F.round("probability", 6).alias("probability"))


@query()
def glm_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted target probability of each match by a binomial model."""
    from massloom.operators.learning import binomial_fit

    rows = psms(spark, sf_dir).withColumn("target", F.when(is_test(), 0.0).otherwise(1.0))
    return binomial_fit(rows, ["z", "mvh", "pct"], "target").select("file", "scan", "line", "pep", "protein", F.round("fitted", 6).alias("fitted"))


_FEATURE_SCORES = ("mvh", "xcorr", "wdp")


def _featured(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    from massloom.operators.learning import rescoring_features

    matches = psms(spark, sf_dir).withColumn("form", (F.col("line") % 3).cast("long"))
    return rescoring_features(matches, ["file", "scan"], _FEATURE_SCORES, F.col("pct") - 0.04, (F.col("pep") % 3).cast("long"), "pep", "form", "protein", ties())


#: Graph of proteins and peptides in many components: an order is a peptide, a supplier's share of 40 orders a protein.
_SPANS = "(SELECT DISTINCT l_orderkey // 40 * 1000 + l_suppkey % 37 AS protein, l_orderkey AS peptide FROM lineitem)"


def _inference_sql(least_peptides: int, least_unique: int) -> str:
    greedy = f"""UNION ALL SELECT unnest(list_reduce(list({{'used': peptides, 'taken': [protein]}} ORDER BY n DESC, protein), lambda a, x: CASE WHEN list_has_any(a.used, x.used) THEN a ELSE {{'used': list_concat(a.used, x.used), 'taken': list_concat(a.taken, x.taken)}} END).taken) AS protein, 2 AS phase
        FROM (SELECT protein, list(peptide) AS peptides, count(*) AS n FROM edges WHERE protein NOT IN (SELECT protein FROM chosen) AND protein NOT IN (SELECT protein FROM covered) GROUP BY protein HAVING n >= {least_peptides}) GROUP BY protein // 1000"""
    return f"""(WITH edges AS MATERIALIZED {_SPANS}, degrees AS MATERIALIZED (SELECT peptide, count(*) AS degree FROM edges GROUP BY peptide),
        counts AS MATERIALIZED (SELECT protein, count(*) AS n, count(*) FILTER (degree = 1) AS alone FROM edges JOIN degrees USING (peptide) GROUP BY protein),
        chosen AS MATERIALIZED (SELECT protein FROM counts WHERE n >= {least_peptides} AND alone >= {max(least_unique, 1)}),
        covered AS MATERIALIZED (SELECT DISTINCT a.protein FROM edges a JOIN edges b USING (peptide) JOIN counts c ON c.protein = a.protein WHERE b.protein IN (SELECT protein FROM chosen) AND a.protein NOT IN (SELECT protein FROM chosen) GROUP BY a.protein, b.protein, c.n HAVING count(*) = c.n)
        SELECT CAST({least_unique} AS INTEGER) AS least_unique, protein, CAST(phase AS INTEGER) AS phase FROM (SELECT protein, 1 AS phase FROM chosen {greedy if least_unique == 0 else ''}))"""


@query(" UNION ALL ".join(_inference_sql(n + 1, n) for n in (0, 1, 2)))
def inference_by_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proteins inferred with at least 0, 1 and 2 unique peptides, and one peptide more."""
    lines = table(spark, sf_dir, "lineitem")
    graph = lines.select((F.floor(F.col("l_orderkey") / 40) * 1000 + F.col("l_suppkey") % 37).alias("protein"), F.col("l_orderkey").alias("peptide")).distinct()
    # read many times: made once
    graph, _ = written(graph, "inference-graph")
    counts = inference.protein_counts(graph)
    found = [inference.infer_proteins(graph, n + 1, n, counts=counts).select(F.lit(n).alias("least_unique"), "protein", "phase") for n in (0, 1, 2)]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(f"""WITH m AS (SELECT pep, line % 3 AS form, protein FROM {PSM}), forms AS (SELECT pep, form, count(*) AS form_spectra FROM m GROUP BY ALL), k AS (SELECT pep, CAST(sum(form_spectra) AS BIGINT) AS peptide_spectra FROM forms GROUP BY pep),
    e AS (SELECT *, count(*) OVER (PARTITION BY pep) AS n_proteins FROM (SELECT DISTINCT pep, protein FROM m)), x AS MATERIALIZED (SELECT * FROM e JOIN k USING (pep)),
    p AS MATERIALIZED (SELECT protein, sum(peptide_spectra) FILTER (n_proteins = 1) AS u, sum(peptide_spectra) FILTER (n_proteins > 1) AS s, sum(peptide_spectra / n_proteins) FILTER (n_proteins > 1) AS b, count(*) AS peptides, count(*) FILTER (n_proteins = 1) AS up, count(*) FILTER (n_proteins > 1) AS sp FROM x GROUP BY protein),
    y AS MATERIALIZED (SELECT x.*, coalesce(u, 0) - (n_proteins = 1)::INT AS u, coalesce(s, 0) - (n_proteins > 1)::INT AS s, round(coalesce(b, 0) - CASE WHEN n_proteins > 1 THEN 1 / n_proteins ELSE 0 END, 6) AS b, peptides, up, sp FROM x JOIN p USING (protein)),
    o AS (SELECT a.pep, max(b.peptide_spectra) AS other FROM x a JOIN x b ON a.protein = b.protein AND a.pep <> b.pep GROUP BY a.pep),
    f AS (SELECT pep, n_proteins, peptide_spectra, max(u) AS most_unique, max(s) AS most_shared, max(b) AS most_balanced, sum(u) AS sum_unique, sum(s) AS sum_shared, round(sum(b), 6) AS sum_balanced,
        arg_min({{'u': u, 's': s}}, {{'o': -(u + s), 'p': protein}}) AS l, arg_min({{'u': u, 'b': b}}, {{'o': round(-(u + b), 6), 'p': protein}}) AS q, max(peptides) AS peptides, max(up) AS up, max(sp) AS sp FROM y GROUP BY ALL)
    SELECT pep, CAST(form AS BIGINT) AS form, form_spectra, peptide_spectra, n_proteins, CAST(most_unique AS BIGINT) AS most_unique, CAST(most_shared AS BIGINT) AS most_shared, most_balanced, CAST(sum_unique AS BIGINT) AS sum_unique, CAST(sum_shared AS BIGINT) AS sum_shared, sum_balanced,
        CAST(l.u AS BIGINT) AS linked_unique, CAST(l.s AS BIGINT) AS linked_shared, CAST(q.u AS BIGINT) AS linked_balanced_unique, q.b AS linked_balanced_shared, peptides, CASE WHEN n_proteins = 1 THEN up ELSE 0 END AS unique_peptides, CASE WHEN n_proteins = 1 THEN 0 ELSE sp END AS shared_peptides, coalesce(other, 0) AS most_other_spectra
    FROM forms JOIN f USING (pep) LEFT JOIN o USING (pep)""")
def linked_protein_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All graph features of the rescoring, by peptide and form."""
    matches = psms(spark, sf_dir).select("pep", (F.col("line") % 3).cast("long").alias("form"), "protein")
    return proteins.linked_features(matches, "pep", "form", "protein")


_BENCHMARK_PEPTIDES = f"(SELECT DISTINCT peptide FROM ({_digest_sql(0).replace(PROTEINS, PROTEINS.replace('doc_id', 'item_id').replace('FROM documents', 'FROM benchmark')).replace('BETWEEN 7 AND 30', 'BETWEEN 3 AND 60')}))"


@query(f"SELECT protein_id, peptide FROM {PROTEINS} JOIN {_BENCHMARK_PEPTIDES} ON contains(seq, peptide)")
def peptide_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peptides of the benchmark's sequences and the documents' sequences that hold them."""
    found = digest.digest(sequences(table(spark, sf_dir, "benchmark"), "item_id"), AFTER, BEFORE, 0, 3, 60, places=False).select("peptide").distinct()
    return joins.peptide_search(sequences(table(spark, sf_dir, "documents"), "doc_id"), found)


@query(f"""WITH m AS (SELECT *, line % 3 AS form FROM {PSM}), k AS (SELECT pep, count(*) AS n FROM m GROUP BY pep), x AS (SELECT pep, protein, n, count(*) OVER (PARTITION BY pep) AS n_proteins FROM (SELECT DISTINCT pep, protein FROM m) JOIN k USING (pep)),
    p AS (SELECT protein, sum(n) AS spectra FROM x GROUP BY protein), g AS (SELECT pep, n AS peptide_spectra, max(spectra) - 1 AS linked FROM x JOIN p USING (protein) GROUP BY pep, n)
    SELECT file, scan, line, pep, protein, mvh, xcorr, wdp, round(abs(pct - 0.04), 6) AS mass_error, {', '.join(f'round({s} - coalesce(lead({s}) OVER (PARTITION BY file, scan ORDER BY {s} DESC, {TIES}), {s}), 6) AS {s}_diff' for s in _FEATURE_SCORES)},
        pep % 3 AS missed, peptide_spectra, CAST(linked AS BIGINT) AS linked_spectra FROM m JOIN g USING (pep)""")
def rescore_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten features of the rescoring, by match."""
    rows, names = _featured(spark, sf_dir)
    return rows.select("file", "scan", "line", "pep", "protein", *(F.round(n, 6).alias(n) if n == "mass_error" or n.endswith("_diff") else n for n in names))


@query()
def rescore_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of each match not to be a training decoy, by a logistic regression over all ten features."""
    from massloom.operators.learning import rescore

    rows, names = _featured(spark, sf_dir)
    kept = ["file", "scan", "line", "pep", "protein"]
    # counted, fitted and scored: made once, as the features cost two shuffles of all matches
    rows, _ = written(rows.select(*kept, *(n for n in names if n not in kept), F.when(is_train(), 0.0).otherwise(1.0).alias("label")), "rescore-rows")
    scored = rescore(rows, names, "label")
    return scored.select("file", "scan", "line", "pep", "protein", F.round("probability", 6).alias("probability"))
