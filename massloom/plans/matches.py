"""Queries over matches: ranking, cutoffs, filters and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.functions.chemistry import FILTER_NEUTRON, NEUTRON, folded_difference, folded_remainder
from massloom.operators import joins, proteins, ranking
from massloom.plans.tables import LABEL, PSM, TIES, Registry, is_forward, is_test, is_train, psms, ties

REGISTRY = Registry()
query = REGISTRY.add
SCAN = ["file", "scan"]
COLUMNS = ["file", "scan", "z", "line", "pep", "protein", "mvh", "xcorr", "wdp"]
LIST = ", ".join(COLUMNS)


@query(f"SELECT {LIST} FROM (SELECT *, row_number() OVER (PARTITION BY file, scan ORDER BY mvh DESC, {TIES}) r FROM {PSM}) WHERE r = 1")
def psm_best_per_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_k(psms(spark, sf_dir), SCAN, [F.desc("mvh"), *ties()], 1).select(*COLUMNS)


@query(f"SELECT file, scan, pep, mvh, second, round(mvh - second, 4) AS delta FROM (SELECT *, row_number() OVER w r, coalesce(lead(mvh) OVER w, mvh) AS second FROM {PSM} WINDOW w AS (PARTITION BY file, scan ORDER BY mvh DESC, {TIES})) WHERE r = 1")
def psm_best_and_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = ranking.best_and_second(psms(spark, sf_dir), SCAN, "mvh", [F.desc("mvh"), *ties()])
    return best.select("file", "scan", "pep", "mvh", "second", F.round("delta", 4).alias("delta"))


@query(f"""SELECT {LIST}, rank_mvh, rank_xcorr, rank_wdp FROM (SELECT *,
    row_number() OVER (PARTITION BY z, protein ORDER BY mvh DESC, {TIES}, scan) rank_mvh,
    row_number() OVER (PARTITION BY z, protein ORDER BY xcorr DESC, {TIES}, scan) rank_xcorr,
    row_number() OVER (PARTITION BY z, protein ORDER BY wdp DESC, {TIES}, scan) rank_wdp FROM {PSM}) WHERE least(rank_mvh, rank_xcorr, rank_wdp) <= 5""")
def rank_any_score_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranking.top_in_any_score(psms(spark, sf_dir), ["z", "protein"], ["mvh", "xcorr", "wdp"], [*ties(), F.col("scan")], 5)
    return out.select(*COLUMNS, "rank_mvh", "rank_xcorr", "rank_wdp")


@query(f"SELECT file, scan, pep, line, mvh, round(coalesce(mvh - lead(mvh) OVER (PARTITION BY file, scan ORDER BY mvh DESC, {TIES}), 0), 4) AS difference FROM {PSM}")
def score_diff_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = ranking.score_difference("mvh", SCAN, [F.desc("mvh"), *ties()])
    return psms(spark, sf_dir).select("file", "scan", "pep", "line", "mvh", F.round(diff, 4).alias("difference"))


@query(f"""SELECT file, scan, pep, line, round(CASE WHEN r = 1 THEN CASE WHEN nxt IS NULL THEN 0 WHEN nxt = 0 THEN 1 ELSE xcorr / nxt - 1 END ELSE CASE WHEN best = 0 THEN 0 ELSE xcorr / best - 1 END END, 8) AS relative
    FROM (SELECT *, row_number() OVER w r, lead(xcorr) OVER w nxt, first_value(xcorr) OVER w best FROM {PSM} WINDOW w AS (PARTITION BY file, scan ORDER BY xcorr DESC, {TIES}))""")
def relative_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    delta = ranking.relative_difference("xcorr", SCAN, [F.desc("xcorr"), *ties()])
    return psms(spark, sf_dir).select("file", "scan", "pep", "line", F.round(delta, 8).alias("relative"))


@query(f"SELECT {LIST}, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY protein ORDER BY mvh DESC, {TIES}, scan) r FROM {PSM}) WHERE r <= 50")
def top50_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_k(psms(spark, sf_dir), ["protein"], [F.desc("mvh"), *ties(), F.col("scan")], 50).select(*COLUMNS, "rank")


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY file, scan ORDER BY mvh DESC, {TIES}) a, row_number() OVER (PARTITION BY file, scan ORDER BY xcorr DESC, {TIES}) b, row_number() OVER (PARTITION BY file, scan ORDER BY wdp DESC, {TIES}) c FROM {PSM}),
    w AS (SELECT file, scan, pep, 'mvh' AS score FROM r WHERE a = 1 UNION ALL SELECT file, scan, pep, 'xcorr' FROM r WHERE b = 1 UNION ALL SELECT file, scan, pep, 'wdp' FROM r WHERE c = 1),
    n AS (SELECT *, count(*) OVER (PARTITION BY file, scan, pep) k FROM w)
    SELECT file, scan, pep, score, CAST(CASE WHEN k = 3 THEN 0 WHEN k = 2 THEN 1 WHEN max(CASE WHEN k = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY file, scan) = 1 THEN 3 ELSE 2 END AS INTEGER) AS disagreement FROM n""")
def consensus_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.consensus(psms(spark, sf_dir), SCAN, ["mvh", "xcorr", "wdp"], "pep", ties())


_RUN = f"SELECT *, {LABEL} AS label, sum(CASE WHEN {LABEL} = 3 THEN 1 ELSE 0 END) OVER w d, sum(CASE WHEN {LABEL} = 1 THEN 1 ELSE 0 END) OVER w t FROM {{rows}} WINDOW w AS (PARTITION BY z ORDER BY mvh DESC, {TIES}, scan ROWS UNBOUNDED PRECEDING)"
_CUT = "SELECT z, min(mvh) AS cutoff FROM r WHERE label IN (1, 3) AND t > 0 AND d <= 0.12 * t GROUP BY z"


@query(f"WITH r AS ({_RUN.format(rows=PSM)}), c AS ({_CUT}) SELECT p.z, c.cutoff, CAST(count(*) AS BIGINT) AS n_psms FROM {PSM} p JOIN c USING (z) WHERE p.mvh >= c.cutoff GROUP BY p.z, c.cutoff")
def fdr_cutoff_psm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = psms(spark, sf_dir)
    cutoffs = ranking.decoy_cutoff(rows, ["z"], "mvh", is_forward(), is_test(), 0.12, [*ties(), F.col("scan")])
    return ranking.passing(rows, F.broadcast(cutoffs), ["z"], "mvh").groupBy("z", "cutoff").agg(F.count("*").alias("n_psms"))


_FIRST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pep, z ORDER BY mvh DESC, {TIES}, scan) k FROM {PSM}) WHERE k = 1)"


@query(f"WITH r AS ({_RUN.format(rows=_FIRST)}), c AS ({_CUT}) SELECT p.z, c.cutoff, CAST(count(*) AS BIGINT) AS n_psms, CAST(count(DISTINCT pep) AS BIGINT) AS n_peptides FROM {PSM} p JOIN c USING (z) WHERE p.mvh >= c.cutoff GROUP BY p.z, c.cutoff")
def fdr_cutoff_peptide(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = psms(spark, sf_dir)
    first = ranking.top_k(rows, ["pep", "z"], [F.desc("mvh"), *ties(), F.col("scan")], 1)
    cutoffs = ranking.decoy_cutoff(first, ["z"], "mvh", is_forward(), is_test(), 0.12, [*ties(), F.col("scan")])
    return ranking.passing(rows, F.broadcast(cutoffs), ["z"], "mvh").groupBy("z", "cutoff").agg(F.count("*").alias("n_psms"), F.count_distinct("pep").alias("n_peptides"))


@query(f"""WITH s AS (SELECT z, max(mvh) mx, min(mvh) mn, avg(mvh) / 200 st FROM {PSM} GROUP BY z),
    b AS (SELECT z, mx, mn, st, CAST(ceil((mx - mvh) / st) AS BIGINT) k, count(*) n, sum(CASE WHEN protein % 10 = 0 THEN 1 ELSE 0 END) f FROM {PSM} JOIN s USING (z) GROUP BY ALL),
    c AS (SELECT *, sum(n) OVER w rn, sum(f) OVER w rf FROM b WINDOW w AS (PARTITION BY z ORDER BY k ROWS UNBOUNDED PRECEDING))
    SELECT z, max(k) AS grid_index, CAST(max(rn) AS BIGINT) AS n_rows, CAST(max(rf) AS BIGINT) AS n_decoys FROM c WHERE rf <= 0.105 * rn AND (mx - k * st > mn OR k = 0) GROUP BY z""")
def fdr_cutoff_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.grid_cutoff(psms(spark, sf_dir), ["z"], "mvh", is_test(), 0.105, steps=200)


_MAX = f"(SELECT protein, max(mvh) AS score, count(*) AS n FROM {PSM} GROUP BY protein)"


@query(f"""WITH m AS (SELECT *, count(*) OVER w rn, sum(CASE WHEN protein % 10 = 0 THEN 1 ELSE 0 END) OVER w rd FROM {_MAX} WINDOW w AS (ORDER BY score DESC, protein ROWS UNBOUNDED PRECEDING))
    SELECT protein, score FROM m WHERE rn <= (SELECT max(rn) FROM m WHERE rd <= 0.08 * rn)""")
def protein_fdr_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = psms(spark, sf_dir).groupBy("protein").agg(F.max("mvh").alias("score"))
    return ranking.refine_by_maximum(best, "score", is_test(), 0.08, [F.col("protein")]).select("protein", "score")


_NAMES = "SELECT pep, list_sort(list(DISTINCT CASE WHEN protein % 10 = 0 THEN 'Rev2_' WHEN protein % 10 = 1 THEN 'Rev1_' ELSE 'P' END || protein)) AS names FROM {psm} GROUP BY pep"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.when(is_test(), "Rev2_").when(is_train(), "Rev1_").otherwise("P"), F.col("protein").cast("string"))
    return joins.merge_lists(psms(spark, sf_dir).withColumn("name", name), ["pep"], "name", "names")


@query(f"WITH n AS ({_NAMES.format(psm=PSM)}) SELECT pep, array_to_string(names, ',') AS names, CAST(CASE WHEN len(list_filter(names, lambda x: NOT starts_with(x, 'Rev1_'))) = 0 THEN 2 WHEN len(list_filter(names, lambda x: NOT starts_with(x, 'Rev'))) = 0 THEN 3 ELSE 1 END AS INTEGER) AS label FROM n")
def label_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("pep", F.array_join("names", ",").alias("names"), ranking.label_of(F.col("names"), None, "Rev1_", "Rev2_").alias("label"))


@query(f"WITH n AS ({_NAMES.format(psm=PSM)}) SELECT pep, len(list_filter(names, lambda x: NOT starts_with(x, 'Rev'))) > 0 AS target FROM n")
def target_decoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("pep", ranking.has_target(F.col("names"), ["Rev1_", "Rev2_"]).alias("target"))


@query(f"SELECT pep, array_to_string(list_sort(list(DISTINCT protein)), ',') AS proteins, CAST(count(DISTINCT protein) AS INTEGER) AS n_proteins FROM {PSM} GROUP BY pep")
def merge_proteins_per_peptide(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = joins.merge_lists(psms(spark, sf_dir), ["pep"], "protein", "p")
    return merged.select("pep", F.array_join(F.transform("p", lambda x: x.cast("string")), ",").alias("proteins"), F.size("p").alias("n_proteins"))


@query(f"""WITH b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, scan ORDER BY mvh DESC, {TIES}) r FROM {PSM}) WHERE r = 1),
    r AS ({_RUN.format(rows="b")}), c AS ({_CUT})
    SELECT pep, b.z, CAST(count(*) AS BIGINT) AS spectral_count, max(mvh) AS best_score, array_to_string(list_sort(list(file || '[' || lpad(CAST(scan AS VARCHAR), 10, '0') || ']')), ',') AS psms, CAST(count(DISTINCT protein) AS BIGINT) AS n_proteins
    FROM b JOIN c ON b.z = c.z AND mvh >= cutoff WHERE protein % 10 <> 1 GROUP BY pep, b.z""")
def peptide_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = ranking.top_k(psms(spark, sf_dir), SCAN, [F.desc("mvh"), *ties()], 1)
    cutoffs = ranking.decoy_cutoff(best, ["z"], "mvh", is_forward(), is_test(), 0.12, [*ties(), F.col("scan")])
    kept = ranking.passing(best, F.broadcast(cutoffs), ["z"], "mvh").where(~is_train())
    name = F.concat("file", F.lit("["), F.lpad(F.col("scan").cast("string"), 10, "0"), F.lit("]"))
    return proteins.peptide_rollup(kept, ["pep", "z"], "mvh", name, [F.count_distinct("protein").alias("n_proteins")])


@query(f"SELECT file, scan, line, pep, round(abs(d - rint_ * {FILTER_NEUTRON}), 6) AS error FROM (SELECT *, mvh - xcorr AS d, round_even((mvh - xcorr) / {FILTER_NEUTRON}, 0) AS rint_ FROM {PSM}) WHERE abs(d - rint_ * {FILTER_NEUTRON}) <= 0.05")
def mass_filter_da(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = folded_difference(F.col("mvh") - F.col("xcorr"))
    return psms(spark, sf_dir).where(error <= 0.05).select("file", "scan", "line", "pep", F.round(error, 6).alias("error"))


@query(f"SELECT file, scan, line, pep, round((mvh - (xcorr + 1000 * line)) / (xcorr + 1000 * line) * 1000000, 3) AS ppm FROM {PSM} WHERE abs((mvh - (xcorr + 1000 * line)) / (xcorr + 1000 * line) * 1000000) <= 100000")
def mass_filter_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.col("xcorr") + 1000 * F.col("line")
    ppm = (F.col("mvh") - base) / base * 1000000
    return psms(spark, sf_dir).where(F.abs(ppm) <= 100000).select("file", "scan", "line", "pep", F.round(ppm, 3).alias("ppm"))


@query(f"SELECT file, scan, line, pep, mvh, round(least(abs(fmod(mvh - xcorr, {NEUTRON})), {NEUTRON} - abs(fmod(mvh - xcorr, {NEUTRON}))), 6) AS error FROM {PSM}")
def mass_error_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return psms(spark, sf_dir).select("file", "scan", "line", "pep", "mvh", F.round(folded_remainder(F.col("mvh") - F.col("xcorr")), 6).alias("error"))


@query(f"SELECT file, scan, line, pep, protein, lead(pep, 2) OVER w AS pep_ahead, lead(mvh, 2) OVER w AS mvh_ahead FROM {PSM} WINDOW w AS (PARTITION BY file, scan ORDER BY shipped, {TIES})")
def scan_offset_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = joins.at_offset(psms(spark, sf_dir), SCAN, [F.col("shipped"), *ties()], 2, ["pep", "mvh"], "_ahead")
    return out.select("file", "scan", "line", "pep", "protein", "pep_ahead", "mvh_ahead")


@query(f"SELECT {LIST} FROM (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY shipped, {TIES}) r FROM {PSM}) WHERE r = 1")
def first_use_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.first_use(psms(spark, sf_dir), ["scan"], [F.col("shipped"), *ties()]).select(*COLUMNS)


@query(f"SELECT CAST(count(CASE WHEN p % 10 = 1 THEN 1 END) AS BIGINT) AS n_train, CAST(count(CASE WHEN p % 10 = 0 THEN 1 END) AS BIGINT) AS n_test, CAST(count(CASE WHEN p % 10 > 1 THEN 1 END) AS BIGINT) AS n_forward, count(CASE WHEN p % 10 = 0 THEN 1 END) / CAST(count(CASE WHEN p % 10 > 1 THEN 1 END) AS DOUBLE) AS test_to_forward FROM (SELECT s_suppkey AS p FROM supplier)")
def db_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    from massloom.plans.tables import table

    return proteins.census(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("protein")), is_train(), is_test())
