"""Queries for what a search and its reports do around ranking: gates, purges, localisation, statistics and chromatograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.operators import bucketed, digest, joins, quant, ranking, scoring, spectra
from massloom.operators.work import written
from massloom.plans.matches import COLUMNS, LIST, SCAN
from massloom.plans.spectrum_queries import _IONS, _SHORT, AFTER, BEFORE, _ions
from massloom.plans.tables import LABEL, PEAKS, PSM, TIES, Registry, peaks, proteins, psms, scans, table, ties

REGISTRY = Registry()
query = REGISTRY.add
SCORES = ["mvh", "xcorr", "wdp"]


@query(f"SELECT file, scan, CAST(count(*) AS BIGINT) AS n, round(avg(mvh), 6) AS mean, round(coalesce(stddev_samp(mvh), 0), 6) AS deviation FROM {PSM} GROUP BY file, scan")
def scan_score_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = ranking.score_statistics(psms(spark, sf_dir), SCAN, "mvh")
    return stats.select(*SCAN, "n", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


@query(f"SELECT min(mz) AS min_mz, max(mz) AS max_mz, max(z) AS max_charge FROM {PEAKS}")
def observed_mz_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectra.observed_range(scans(spark, sf_dir))


_RANKS = ", ".join(f"row_number() OVER (PARTITION BY protein ORDER BY {s} DESC, {TIES}, scan) AS r_{s}" for s in SCORES)


@query(f"SELECT {LIST} FROM (SELECT *, count(*) OVER (PARTITION BY protein) AS n, {_RANKS} FROM {PSM}) WHERE n <= 100 OR least(r_mvh, r_xcorr, r_wdp) <= 20")
def purge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.purge(psms(spark, sf_dir), ["protein"], SCORES, [*ties(), F.col("scan")]).select(*COLUMNS)


@query(f"SELECT file, scan, max(xcorr) AS xcorr, min(z) AS z, array_to_string(list_sort(list(DISTINCT protein)), ',') AS proteins FROM (SELECT *, rank() OVER (PARTITION BY file, scan ORDER BY xcorr DESC, z) r FROM {PSM}) WHERE r = 1 GROUP BY file, scan")
def best_merging_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = ranking.best_with_merged_ties(psms(spark, sf_dir).select(*SCAN, "xcorr", "z", "protein"), SCAN, [F.desc("xcorr"), F.col("z")], "protein", "proteins")
    return best.select(*SCAN, "xcorr", "z", F.array_join("proteins", ",").alias("proteins"))


_CANDIDATES = f"(SELECT protein, pep, pep % 20 AS original, line % 3 AS ptms, scan, line, xcorr, mvh, wdp, pct, file, shipped FROM {PSM})"


def _localisation_sql(score: str) -> str:
    mean = " + ".join(f"CASE WHEN m_{s} <> 0 THEN (t_{s} - {s}) / m_{s} ELSE 0 END" for s in SCORES)
    tops = ", ".join(f"max({s}) OVER (PARTITION BY protein) AS m_{s}, first_value({s}) OVER w AS t_{s}" for s in SCORES)
    names = ", ".join(f"first_value({c}) OVER w AS t_{c}" for c in ("pep", "original", "ptms"))
    return f"""SELECT protein, '{score}' AS score, any_value(t_pep) AS pep, CASE WHEN any_value(t_ptms) > 0 THEN round(coalesce(min_by(({mean}) / 3.0, r) FILTER (WHERE original = t_original AND ptms = t_ptms AND pep <> t_pep), 1), 6) END AS delta_p
        FROM (SELECT *, row_number() OVER w AS r, {tops}, {names} FROM {_CANDIDATES} WINDOW w AS (PARTITION BY protein ORDER BY {score} DESC, {TIES}, scan)) GROUP BY protein"""


@query(" UNION ALL ".join(_localisation_sql(s) for s in SCORES))
def ptm_localisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A protein's matches stand for a scan's candidates, so that isomers meet."""
    rows = psms(spark, sf_dir).withColumns({"original": F.col("pep") % 20, "ptms": F.col("line") % 3})
    found = ranking.localisation(rows, ["protein"], SCORES, "original", "pep", "ptms", [*ties(), F.col("scan")])
    return found.select("protein", "score", "pep", F.round("delta_p", 6).alias("delta_p"))


@query(f"SELECT {LIST} FROM (SELECT *, max(wdp) OVER (PARTITION BY file, scan) AS best FROM {PSM}) WHERE best > 0")
def scan_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.with_positive_best(psms(spark, sf_dir), SCAN, "wdp").select(*COLUMNS)


@query(f"SELECT {LIST} FROM {PSM} WHERE mvh <> 0 AND xcorr <> 0 AND wdp <> 0")
def drop_zero_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.without_zero_scores(psms(spark, sf_dir), SCORES).select(*COLUMNS)


_LABELS = ("forward", "train", "test")
_PER_PEPTIDE = f"(SELECT pep, z, min({LABEL}) AS label, {', '.join(f'count(CASE WHEN {LABEL} = {k} THEN 1 END) AS n{k}' for k in (1, 2, 3))} FROM {PSM} GROUP BY pep, z)"


@query(f"""SELECT *, round(coalesce(test_psms / nullif(forward_psms, 0), 0), 8) AS psm_fdr, round(coalesce(test_peptides / nullif(forward_peptides, 0), 0), 8) AS peptide_fdr
    FROM (SELECT {', '.join(f'CAST(sum(n{k}) AS BIGINT) AS {n}_psms, CAST(count(CASE WHEN label = {k} THEN 1 END) AS BIGINT) AS {n}_peptides' for k, n in enumerate(_LABELS, 1))} FROM {_PER_PEPTIDE})""")
def report_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = ranking.report_statistics(psms(spark, sf_dir), F.expr(LABEL), ["pep", "z"])
    return stats.withColumns({c: F.round(c, 8) for c in ("psm_fdr", "peptide_fdr")})


@query(f"SELECT i.scan, i.ion, p.mz, p.inten FROM {_IONS} i JOIN {PEAKS} p ON i.scan = p.scan AND abs(i.mz - p.mz) < 12")
def all_peaks_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = joins.all_in_tolerance(_ions(spark, sf_dir), peaks(spark, sf_dir), ["scan"], "ion_mz", "mz", 12.0)
    return hits.select("scan", F.col("ion").cast("long").alias("ion"), "mz", "inten")


@query(f"SELECT scan, CAST(count(*) AS BIGINT) AS n_ions, round(avg(e), 6) AS mean_error, round(coalesce(sum(e * inten) / nullif(sum(inten), 0), avg(e)), 6) AS weighted_error FROM (SELECT i.scan, abs(i.mz - p.mz) AS e, p.inten FROM {_IONS} i JOIN {PEAKS} p ON i.scan = p.scan AND abs(i.mz - p.mz) < 12) GROUP BY scan")
def ion_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = joins.all_in_tolerance(_ions(spark, sf_dir), peaks(spark, sf_dir), ["scan"], "ion_mz", "mz", 12.0)
    errors = spectra.mean_errors(hits, ["scan"], F.abs(F.col("ion_mz") - F.col("mz")), "inten")
    return errors.select("scan", "n_ions", F.round("mean_error", 6).alias("mean_error"), F.round("weighted_error", 6).alias("weighted_error"))


@query("SELECT vec_id AS scan, CAST(level AS INTEGER) AS level FROM embeddings, unnest(range(0, 101)) AS u(level)")
def search_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.at_levels(scans(spark, sf_dir).select("scan"))


@query(f"SELECT scan, mz, inten FROM (SELECT *, list_sort(list(inten) OVER (PARTITION BY scan ORDER BY CAST(mz AS BIGINT) RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING), 'DESC') AS near FROM {PEAKS}) WHERE inten >= near[least(len(near), 5)]")
def local_top_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks 10 apart leave 11 in a window, so the 5 largest of each are kept here instead of 20."""
    return peaks(spark, sf_dir).withColumn("least", spectra.local_rank(["scan"], 50, 5)).where("inten >= least").select("scan", "mz", "inten")


_WEIGHTS = "list_transform(string_split(peptide, ''), lambda r: CASE WHEN r IN ('R', 'H', 'K') THEN 5 WHEN r IN ('Q', 'N') THEN 3 ELSE 1 END)"


@query(f"SELECT peptide, array_to_string(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN list_sum(w[1:i]) * 2 > list_sum(w) THEN '1' ELSE '0' END), '') AS sides FROM (SELECT peptide, {_WEIGHTS} AS w FROM {_SHORT})")
def charge_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    peptides = digest.digest(proteins(spark, sf_dir), AFTER, BEFORE, 0, 7, 30, places=False).select("peptide").distinct()
    return peptides.select("peptide", F.array_join(F.transform(scoring.heavier_side(F.col("peptide")), lambda x: F.when(x, "1").otherwise("0")), "").alias("sides"))


@query(f"""WITH x AS (SELECT DISTINCT p.protein, o.o_custkey, h.height FROM {PSM} p JOIN orders o ON p.scan = o.o_orderkey JOIN (SELECT o_custkey, max(o_totalprice) AS height FROM orders GROUP BY o_custkey) h USING (o_custkey))
    SELECT p.protein, round(coalesce(nullif(sum(x.height), 0), 1), 2) AS peak_height FROM (SELECT DISTINCT protein FROM {PSM}) p LEFT JOIN x USING (protein) GROUP BY p.protein""")
def chromatogram_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders are the scans of one chromatogram, as high as the dearest."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scan"), "o_custkey", "o_totalprice")
    heights = orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("height"))
    found = quant.peak_heights(psms(spark, sf_dir).select("protein", "scan"), orders.join(heights, "o_custkey"), ["protein"], "scan", "o_custkey", "height")
    return found.select("protein", F.round("peak_height", 2).alias("peak_height"))


_GROUPS = f"(SELECT pep, '{{' || array_to_string(list_sort(list(DISTINCT protein)), ',') || '}}' AS members FROM {PSM} GROUP BY pep)"


@query(f"SELECT g.pep, g.members, max(p.mvh) AS best, CAST(count(*) AS BIGINT) AS n_psms FROM {_GROUPS} g JOIN {PSM} p ON g.pep = p.pep AND p.protein IN (SELECT CAST(x AS BIGINT) FROM unnest(string_split(trim(g.members, '{{}}'), ',')) AS u(x)) GROUP BY g.pep, g.members")
def group_members_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    # matches meet their groups' members as one row a pair, and the members' text joins last, so it is not copied to each of them
    rows, _ = written(psms(spark, sf_dir).groupBy("pep", "protein").agg(F.max("mvh").alias("best"), F.count("*").alias("n_psms")), "group-pairs")
    groups = joins.merge_lists(rows, ["pep"], "protein", "l").select("pep", F.concat(F.lit("{"), F.array_join("l", ","), F.lit("}")).alias("members"))
    groups, _ = written(groups, "group-members")
    members = joins.unbraced(groups, "members", "item").select("pep", F.col("item").cast("long").alias("protein"))
    found = members.join(rows, ["pep", "protein"]).groupBy("pep").agg(F.max("best").alias("best"), F.sum("n_psms").alias("n_psms"))
    return groups.join(found, "pep").select("pep", "members", "best", "n_psms")


@query(f"""WITH m AS (SELECT scan, pep, max(mvh) AS mvh, array_to_string(list_sort(list(DISTINCT line % 3)), ',') AS searches FROM {PSM} GROUP BY scan, pep)
    SELECT scan, o_totalprice, pep, mvh, searches, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY mvh DESC, pep) AS r FROM m) JOIN orders ON o_orderkey = scan WHERE r <= 3""")
def search_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best three candidates of each scan over three searches, with the scan's precursor, on tables bucketed by scan."""
    matches = bucketed.bucketed(psms(spark, sf_dir).select("scan", "pep", "mvh", (F.col("line") % 3).alias("search")), ["scan"])
    spectra = bucketed.bucketed(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scan"), "o_totalprice"), ["scan"])
    merged = bucketed.merge_searches(matches, ["scan"], "pep", "search", "mvh", 3)
    return bucketed.with_scan(merged, spectra, ["scan"]).select("scan", "o_totalprice", "pep", "mvh", F.array_join("searches", ",").alias("searches"), "rank")


#: Calculated masses of the matches that stand for candidates: equal for every third peptide of an original one.
_MASS_SQL = "1000 + pep % 3 * 0.5"


def _isomer_sql(score: str) -> str:
    return _localisation_sql(score).replace(_CANDIDATES, f"(SELECT *, {_MASS_SQL} AS mass FROM {_CANDIDATES})").replace("first_value(pep) OVER w AS t_pep", "first_value(pep) OVER w AS t_pep, first_value(mass) OVER w AS t_mass").replace("ptms = t_ptms AND", "abs(mass - t_mass) < 0.00005 AND length(pep::VARCHAR) = length(t_pep::VARCHAR) AND")


@query(" UNION ALL ".join(_isomer_sql(s) for s in SCORES))
def isomer_localisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with isomers told by their calculated mass."""
    rows = psms(spark, sf_dir).withColumns({"original": F.col("pep") % 20, "ptms": F.col("line") % 3, "mass": F.expr(_MASS_SQL).cast("double")})
    found = ranking.localisation(rows, ["protein"], SCORES, "original", "pep", "ptms", [*ties(), F.col("scan")], mass="mass")
    return found.select("protein", "score", "pep", F.round("delta_p", 6).alias("delta_p"))


_NAMED = f"(SELECT *, CASE WHEN protein % 10 = 0 THEN 'Rev_' || protein WHEN protein % 10 = 1 THEN 'P1,Rev2_' || protein ELSE 'P' || protein END AS names FROM {PSM})"


@query(f"""WITH m AS (SELECT * FROM {_NAMED} WHERE NOT contains(names, 'Rev_') AND NOT contains(names, 'Rev2_')),
    p AS (SELECT file, protein, count(*) AS n, count(*) FILTER (pct > 0.04) AS l, median(pct) AS mid FROM m GROUP BY ALL), q AS (SELECT file, pep, max(pct > 0.04) AS l FROM m GROUP BY ALL)
    SELECT file, CAST(psms AS BIGINT) AS psms, CAST(labelled_psms AS BIGINT) AS labelled_psms, proteins, labelled_proteins, peptides, labelled_peptides FROM (SELECT file, sum(n) AS psms, sum(l) AS labelled_psms, count(*) AS proteins, count(*) FILTER (mid > 0.04) AS labelled_proteins FROM p GROUP BY file)
    JOIN (SELECT file, count(*) AS peptides, count(*) FILTER (l) AS labelled_peptides FROM q GROUP BY file) USING (file)""")
def label_file_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled proteins, peptides and matches of each file, without decoys."""
    protein = F.col("protein").cast("string")
    names = F.when(F.col("protein") % 10 == 0, F.concat(F.lit("Rev_"), protein)).when(F.col("protein") % 10 == 1, F.concat(F.lit("P1,Rev2_"), protein)).otherwise(F.concat(F.lit("P"), protein))
    rows = ranking.without_decoys(psms(spark, sf_dir).withColumn("names", names), "names", ["Rev_", "Rev2_"])
    return quant.labelled_by_file(rows, "file", "protein", "pep", "pct", 0.04)


@query(f"SELECT grp, count(*) AS matches, count(DISTINCT file) AS files, min(scan) AS first FROM (SELECT DISTINCT protein // 7 AS grp, file, scan, pep FROM {PSM}) GROUP BY grp")
def group_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct matches of groups of seven proteins."""
    rows = psms(spark, sf_dir)
    members = rows.select("protein", F.floor(F.col("protein") / 7).alias("grp")).distinct()
    found = quant.matches_of_groups(rows, members, "protein", "grp", ["file", "scan", "pep"])
    return found.groupBy("grp").agg(F.count("*").alias("matches"), F.count_distinct("file").alias("files"), F.min("scan").alias("first"))
