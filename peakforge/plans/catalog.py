"""The registered queries over the library's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakforge.functions import activations as A
from peakforge.functions import constants as K
from peakforge.functions import peptide as P
from peakforge.functions import sizing
from peakforge.functions import vectors as V
from peakforge.operators import decoding, matching, metrics, spectra
from peakforge.plans import fixtures as X
from peakforge.sources import files, mgf, mgf_source, ragged
from peakforge.sources.scratch import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _peaks(spark, d):
    return X.view(spark, d, X.PEAKS, "lineitem")


def _precursors(spark, d):
    return X.view(spark, d, X.PRECURSORS, "supplier")


def _spectra(spark, d):
    return _precursors(spark, d).join(spectra.collect_peaks(_peaks(spark, d)), "spectrum_id")


def _peptides(spark, d):
    return X.view(spark, d, X.peptides(False), "documents")


def _pairs(spark, d):
    return X.view(spark, d, X.pairs(False), "documents")


def _logp(spark, d):
    rows = X.view(spark, d, X.logits(False), "embeddings")
    from pyspark.sql import Window

    w = Window.partitionBy("spectrum_id", "direction", "step")
    top = F.max("logit").over(w)
    return rows.withColumn("top", top).withColumn("logp", F.col("logit") - F.col("top") - F.log(F.sum(F.exp(F.col("logit") - F.col("top"))).over(w))).drop("top", "logit")


_VOCAB = "(VALUES " + ", ".join(f"('{t}', {i}, CAST({m!r} AS DOUBLE))" for i, (t, m) in enumerate(K.RESIDUES.items(), 2)) + ") AS vocab(token, id, mass)"
_TOKENS = """SELECT spectrum_id, lang, source, peptide, token, pos FROM (SELECT spectrum_id, lang, source, peptide,
  unnest(regexp_extract_all({p}, '^[^A-Z]+|[A-Z][^A-Z]*')) AS token, generate_subscripts(regexp_extract_all({p}, '^[^A-Z]+|[A-Z][^A-Z]*'), 1) AS pos FROM ({f}) f) u"""
_OWN, _MERGED = (_TOKENS.format(p=p, f=X.peptides(True)) for p in ("peptide", "replace(peptide, 'I', 'L')"))


@query(f"""
WITH s AS (SELECT p.spectrum_id, mz, intensity FROM ({X.PEAKS}) p JOIN ({X.PRECURSORS}) q USING (spectrum_id)
  WHERE mz BETWEEN 50 AND 2500 AND NOT EXISTS (SELECT 1 FROM range(1, 12) k(k) WHERE k.k <= q.charge AND abs(mz - ((q.precursor_mz - {K.PROTON!r}) * q.charge / k.k + {K.PROTON!r})) <= 2)),
m AS (SELECT *, max(intensity) OVER (PARTITION BY spectrum_id) AS top FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY intensity DESC, mz) AS k FROM m WHERE intensity > 0.01 * top)
SELECT spectrum_id, round(mz, 6) AS mz, round(sqrt(intensity) / sqrt(top), 6) AS intensity FROM r WHERE k <= 150
""")
def spectrum_clean(spark, d):
    rows = spectra.clean(_spectra(spark, d)).select("spectrum_id", F.explode("peaks").alias("p"))
    return rows.select("spectrum_id", F.round("p.mz", 6).alias("mz"), F.round("p.intensity", 6).alias("intensity"))


@query(f"SELECT spectrum_id, count(*) AS n_peaks, CAST(sum(count(*)) OVER (ORDER BY spectrum_id) - count(*) AS BIGINT) AS start FROM ({X.PEAKS}) p GROUP BY spectrum_id")
def peaks_offsets(spark, d):
    return ragged.offsets(_peaks(spark, d).groupBy("spectrum_id").agg(F.count("*").alias("n_peaks")))


@query(f"SELECT spectrum_id, charge, round((precursor_mz - {K.PROTON!r}) * charge, 6) AS mass FROM ({X.PRECURSORS}) q WHERE charge BETWEEN 1 AND 10")
def precursor_mass(spark, d):
    rows = _precursors(spark, d).where(F.col("charge").isin(*mgf.VALID_CHARGE))
    return rows.select("spectrum_id", "charge", F.round(P.mz_to_mass(F.col("precursor_mz"), F.col("charge")), 6).alias("mass"))


def _tokens_sql(order: str) -> str:
    return f"""SELECT spectrum_id, '1,' || string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos {order}) || ',1' AS tokens FROM ({_MERGED}) t JOIN {_VOCAB} USING (token)
GROUP BY spectrum_id"""


@query(_tokens_sql("ASC"))
def peptide_tokenize(spark, d):
    return _peptides(spark, d).select("spectrum_id", F.array_join(P.tokenize(F.col("peptide")), ",").alias("tokens"))


@query(_tokens_sql("DESC"))
def peptide_tokenize_rev(spark, d):
    return _peptides(spark, d).select("spectrum_id", F.array_join(P.tokenize(F.col("peptide"), reverse=True), ",").alias("tokens"))


@query(f"SELECT spectrum_id, replace(peptide, 'I', 'L') AS forward, replace(peptide, 'I', 'L') AS backward FROM ({X.peptides(True)}) f")
def peptide_roundtrip(spark, d):
    p = F.col("peptide")
    return _peptides(spark, d).select("spectrum_id", P.detokenize(P.tokenize(p)).alias("forward"), P.detokenize(P.tokenize(p, reverse=True), reverse=True).alias("backward"))


_NAMES = {"C+57.021": "C(+57.02)", "M+15.995": "M(+15.99)", "N+0.984": "N(+.98)", "Q+0.984": "Q(+.98)"}


@query("SELECT spectrum_id, " + "".join("replace(" for _ in _NAMES) + "peptide" + "".join(f", '{a}', '{b}')" for a, b in _NAMES.items()) + f" AS renamed FROM ({X.peptides(True)}) f")
def ptm_rename(spark, d):
    return _peptides(spark, d).select("spectrum_id", P.rename_residues(F.col("peptide"), _NAMES).alias("renamed"))


@query(f"SELECT lang, token, count(*) AS n FROM ({_OWN}) t GROUP BY lang, token")
def residue_counts(spark, d):
    return _peptides(spark, d).select("lang", F.explode(P.split_residues(F.col("peptide"))).alias("token")).groupBy("lang", "token").agg(F.count("*").alias("n"))


@query(f"""SELECT spectrum_id, round(sum(mass) + {K.H2O!r}, 4) AS mass, round((sum(mass) + {K.H2O!r}) / (1 + spectrum_id % 3) + {K.PROTON!r}, 4) AS mz
FROM ({_OWN}) t LEFT JOIN {_VOCAB} USING (token) GROUP BY spectrum_id""")
def peptide_mass(spark, d):
    m = _peptides(spark, d).select("spectrum_id", P.peptide_mass(P.split_residues(F.col("peptide"))).alias("m"))
    return m.select("spectrum_id", F.round("m", 4).alias("mass"), F.round(P.mass_to_mz(F.col("m"), F.col("spectrum_id") % 3 + 1), 4).alias("mz"))


_PREFIX = f"SELECT spectrum_id, CAST(pos AS INT) AS pos, sum(mass) OVER (PARTITION BY spectrum_id ORDER BY pos) AS m FROM ({_OWN}) t JOIN {_VOCAB} USING (token)"


@query(f"SELECT spectrum_id, pos, round(m, 5) AS none, round(m - {K.H2O!r}, 5) AS water, round(m - {K.NH3!r}, 5) AS ammonia FROM ({_PREFIX}) p")
def fragment_losses(spark, d):
    rows = _peptides(spark, d).select("spectrum_id", F.posexplode(P.prefix_masses(P.split_residues(F.col("peptide")))).alias("i", "m"))
    losses = P.neutral_losses(F.col("m"))
    return rows.select("spectrum_id", (F.col("i") + 1).alias("pos"), *[F.round(losses[i], 5).alias(c) for i, c in enumerate(("none", "water", "ammonia"))])


_MASSES = f"SELECT spectrum_id AS peptide_id, sum(mass) + {K.H2O!r} AS mass FROM ({_OWN}) t JOIN {_VOCAB} USING (token) GROUP BY spectrum_id"


@query(f"""SELECT q.spectrum_id, p.peptide_id FROM ({X.PRECURSORS}) q JOIN ({_MASSES}) p
ON charge BETWEEN 1 AND 10 AND abs((precursor_mz - {K.PROTON!r}) * charge - mass) < 0.5""")
def precursor_window_join(spark, d):
    return _within_half(spark, d).select("spectrum_id", "peptide_id")


def _within_half(spark, d) -> DataFrame:
    """Precursors and peptides within half a Dalton, with their masses: an interval join by mass bins, each precursor in its own and both next ones."""
    p = _peptides(spark, d).select(F.col("spectrum_id").alias("peptide_id"), P.peptide_mass(P.split_residues(F.col("peptide"))).alias("mass")).withColumn("bin", F.floor("mass"))
    q = _precursors(spark, d).where("charge between 1 and 10").withColumn("m", P.mz_to_mass(F.col("precursor_mz"), F.col("charge")))
    q = q.withColumn("bin", F.explode(F.sequence(F.floor(F.col("m") - 0.5), F.floor(F.col("m") + 0.5))))
    return p.join(q, "bin").where(F.abs(F.col("m") - F.col("mass")) < 0.5)


def _walk_sql(merge: bool, turn: str = "") -> str:
    """The walk of a prefix match as a recursive CTE; merge: with I read as L; turn: a function on both lists first."""
    p, q = (f"replace({c}, 'I', 'L')" if merge else c for c in ("gt_peptide", "coalesce(pred_peptide, '')"))
    return f"""
WITH RECURSIVE f AS ({X.pairs(True)}), v AS (SELECT map(list(token), list(mass)) AS m FROM {_VOCAB}),
t AS (SELECT spectrum_id, CASE WHEN {p} = '' THEN [''] ELSE regexp_extract_all({p}, '^[^A-Z]+|[A-Z][^A-Z]*') END AS p,
  CASE WHEN {q} = '' THEN [''] ELSE regexp_extract_all({q}, '^[^A-Z]+|[A-Z][^A-Z]*') END AS q FROM f),
x AS (SELECT spectrum_id, list_transform({turn}(p), lambda k: coalesce(v.m[k], 0)) AS p, list_transform({turn}(q), lambda k: coalesce(v.m[k], 0)) AS q FROM t, v),
w AS (SELECT spectrum_id, p, q, 1 AS i, 1 AS j, 0::DOUBLE AS a, 0::DOUBLE AS b, CAST(NULL AS INT) AS hit FROM x
  UNION ALL SELECT spectrum_id, p, q, CASE WHEN meet OR b + q[j] > a + p[i] THEN i + 1 ELSE i END, CASE WHEN meet OR NOT b + q[j] > a + p[i] THEN j + 1 ELSE j END,
    CASE WHEN meet OR b + q[j] > a + p[i] THEN a + p[i] ELSE a END, CASE WHEN meet OR NOT b + q[j] > a + p[i] THEN b + q[j] ELSE b END,
    CASE WHEN meet AND abs(p[i] - q[j]) < 0.1 THEN greatest(i, j) END
  FROM (SELECT *, abs(a + p[i] - b - q[j]) < 0.5 AS meet FROM w WHERE i <= len(p) AND j <= len(q)) s)
"""


@query(_walk_sql(False) + "SELECT spectrum_id, CAST(greatest(len(p), len(q)) AS INT) AS n, CAST(count(DISTINCT hit) AS INT) AS n_match FROM w GROUP BY spectrum_id, p, q")
def aa_match_prefix(spark, d):
    flags = matching.match(P.split_residues(F.col("gt_peptide")), P.split_residues(F.coalesce("pred_peptide", F.lit(""))))
    return _pairs(spark, d).select("spectrum_id", flags.alias("f")).select("spectrum_id", F.size("f").alias("n"), matching.count_true(F.col("f")).alias("n_match"))


@query(_walk_sql(False, "list_reverse") + "SELECT spectrum_id, CAST(greatest(len(p), len(q)) AS INT) AS n, CAST(count(DISTINCT hit) AS INT) AS n_match FROM w GROUP BY spectrum_id, p, q")
def aa_match_backward(spark, d):
    flags = matching.match(P.split_residues(F.col("gt_peptide")), P.split_residues(F.coalesce("pred_peptide", F.lit(""))), "backward")
    return _pairs(spark, d).select("spectrum_id", flags.alias("f")).select("spectrum_id", F.size("f").alias("n"), matching.count_true(F.col("f")).alias("n_match"))


def _matched(spark, d, assign: bool = True) -> DataFrame:
    t, p = P.split_residues(P.merge_isomers(F.col("gt_peptide"))), P.split_residues(P.merge_isomers(F.coalesce("pred_peptide", F.lit(""))))
    rows = _pairs(spark, d).select("spectrum_id", "lang", "source", F.col("pred_score").alias("score"), t.alias("t"), p.alias("p"), F.col("pred_peptide").isNotNull().alias("given"))
    rows = rows.withColumn("m", matching.best_pairs(F.col("t"), F.col("p"), assign)).withColumn("n", F.size("m"))
    size, among = (lambda c: F.size(c)), (lambda side, c: matching.count_among(F.col("m"), F.col(c), side, K.PTMS))
    ptms = lambda c: F.size(F.filter(c, lambda x: x.isin(*K.PTMS)))
    return rows.select(
        "spectrum_id", "lang", "source", "score", "given", F.col("n").alias("n_match"), size("t").alias("n_true"), size("p").alias("n_pred"), (F.col("n") == F.greatest(size("t"), size("p"))).alias("whole"),
        among("i", "t").alias("ptm_true_match"), among("j", "p").alias("ptm_pred_match"), ptms("t").alias("ptm_true"), ptms("p").alias("ptm_pred"),
    )


#: Matches by both passes; over: the entries of the second pass that replace the first's.
_BEST = _walk_sql(True).rstrip() + """,
h AS (SELECT spectrum_id, p, q, CAST(greatest(len(p), len(q)) AS INT) AS n, coalesce(list(DISTINCT hit) FILTER (hit IS NOT NULL), []) AS hits FROM w GROUP BY spectrum_id, p, q),
st AS (SELECT *, coalesce(list_min(list_filter(range(1, n + 1), lambda k: NOT list_contains(hits, CAST(k AS INT)))), n + 1) AS stop FROM h),
z AS (SELECT spectrum_id, p, q, stop, CAST(len(p) AS INT) AS i, CAST(len(q) AS INT) AS j, 0::DOUBLE AS a, 0::DOUBLE AS b, CAST(NULL AS INT) AS met, false AS ok FROM st
  UNION ALL SELECT spectrum_id, p, q, stop, CASE WHEN meet OR b + q[j] > a + p[i] THEN i - 1 ELSE i END, CASE WHEN meet OR NOT b + q[j] > a + p[i] THEN j - 1 ELSE j END,
    CASE WHEN meet OR b + q[j] > a + p[i] THEN a + p[i] ELSE a END, CASE WHEN meet OR NOT b + q[j] > a + p[i] THEN b + q[j] ELSE b END,
    CASE WHEN meet THEN greatest(i, j) END, meet AND abs(p[i] - q[j]) < 0.1
  FROM (SELECT *, abs(a + p[i] - b - q[j]) < 0.5 AS meet FROM z WHERE i >= stop AND j >= stop) s),
y AS (SELECT spectrum_id, coalesce(list(met) FILTER (met IS NOT NULL), []) AS met, coalesce(list(met) FILTER (ok), []) AS ok FROM z GROUP BY spectrum_id),
best AS (SELECT spectrum_id, lang, source, pred_score AS score, CAST(len(list_filter(range(1, n + 1), lambda k: list_contains(ok, CAST(k AS INT)) OR (list_contains(hits, CAST(k AS INT)) AND NOT list_contains({over}, CAST(k AS INT))))) AS INT) AS n_match,
  CAST(len(p) AS INT) AS n_true, CAST(len(q) AS INT) AS n_pred, n FROM st JOIN y USING (spectrum_id) JOIN f USING (spectrum_id))
"""
_BEST_COLUMNS = ["spectrum_id", "lang", "source", "score", "n_match", "n_true", "n_pred", "whole"]


@query(_BEST.format(over="met") + "SELECT spectrum_id, lang, source, score, n_match, n_true, n_pred, n_match = n AS whole FROM best")
def aa_match_best(spark, d):
    return _matched(spark, d).select(*_BEST_COLUMNS)


@query(_BEST.format(over="met") + """, g AS (SELECT lang, sum(n_match) / (sum(n_pred) + 1e-8::DOUBLE) AS aa_precision, sum(n_match) / (sum(n_true) + 1e-8::DOUBLE) AS aa_recall,
  sum(CAST(n_match = n AS INT)) / (count(*) + 1e-8::DOUBLE) AS peptide_recall FROM best GROUP BY lang),
u AS (SELECT * FROM g UNION ALL SELECT 'mean', avg(aa_precision), avg(aa_recall), avg(peptide_recall) FROM g)
SELECT lang, round(aa_precision, 9) AS aa_precision, round(aa_recall, 9) AS aa_recall, round(peptide_recall, 9) AS peptide_recall FROM u""")
def metrics_three(spark, d):
    names = ["aa_precision", "aa_recall", "peptide_recall"]
    return metrics.with_mean(metrics.three(_matched(spark, d), "lang"), "lang", names).withColumns({c: F.round(c, 9) for c in names})


_AUC = """, c AS (SELECT lang, score, spectrum_id, sum(CAST(n_match = n AS INT)) OVER o / row_number() OVER o::DOUBLE AS precision, sum(CAST(n_match = n AS INT)) OVER o / count(*) OVER (PARTITION BY lang)::DOUBLE AS recall
  FROM best WINDOW o AS (PARTITION BY lang ORDER BY score DESC, spectrum_id ROWS UNBOUNDED PRECEDING)),
trapezoids AS (SELECT lang, (recall - lag(recall) OVER o) * (precision + lag(precision) OVER o) / 2 AS area FROM c WINDOW o AS (PARTITION BY lang ORDER BY score DESC, spectrum_id))
"""


@query(_BEST.format(over="ok") + _AUC + "SELECT lang, round(sum(area), 9) AS pr_auc FROM trapezoids GROUP BY lang")
def pr_auc(spark, d):
    return metrics.pr_auc(_matched(spark, d, False), "lang").withColumn("pr_auc", F.round("pr_auc", 9))


#: Residues matched by both passes with their places on each side, and how many modified ones there are.
_PTM_LIST = ", ".join(f"'{x}'" for x in K.PTMS)
_PTM = _BEST.format(over="ok") + f""", two AS (SELECT spectrum_id, met AS at, i + 1 AS i, j + 1 AS j FROM z WHERE ok), one AS (SELECT spectrum_id, hit AS at, i - 1 AS i, j - 1 AS j FROM w WHERE hit IS NOT NULL),
matched AS (SELECT * FROM two UNION ALL SELECT * FROM one WHERE NOT EXISTS (SELECT 1 FROM two WHERE two.spectrum_id = one.spectrum_id AND two.at = one.at)),
m AS (SELECT spectrum_id, count(*) AS n_match, count(*) FILTER (p[i] IN ({_PTM_LIST})) AS ptm_true_match, count(*) FILTER (q[j] IN ({_PTM_LIST})) AS ptm_pred_match FROM matched JOIN t USING (spectrum_id) GROUP BY spectrum_id),
ptm AS (SELECT t.spectrum_id, f.lang, f.pred_score AS score, f.pred_peptide IS NOT NULL AS given, CAST(coalesce(n_match, 0) AS INT) AS n_match, CAST(len(p) AS INT) AS n_true, CAST(len(q) AS INT) AS n_pred,
  CAST(coalesce(ptm_true_match, 0) AS INT) AS ptm_true_match, CAST(coalesce(ptm_pred_match, 0) AS INT) AS ptm_pred_match,
  CAST(len(list_filter(p, lambda x: x IN ({_PTM_LIST}))) AS INT) AS ptm_true, CAST(len(list_filter(q, lambda x: x IN ({_PTM_LIST}))) AS INT) AS ptm_pred
  FROM t JOIN f USING (spectrum_id) LEFT JOIN m USING (spectrum_id))
"""


@query(_PTM + "SELECT spectrum_id, n_match, ptm_true_match, ptm_pred_match, ptm_true, ptm_pred FROM ptm")
def aa_match_ptm(spark, d):
    return _matched(spark, d, False).select("spectrum_id", "n_match", "ptm_true_match", "ptm_pred_match", "ptm_true", "ptm_pred")


_SEVEN = ["aa_precision", "aa_recall", "peptide_recall", "peptide_precision", "ptm_precision", "ptm_recall", "pr_auc"]


@query(_PTM + """, g AS (SELECT spectrum_id, lang, score, n_true, ptm_true, CASE WHEN given THEN n_match ELSE 0 END AS n_match, CASE WHEN given THEN n_pred ELSE 0 END AS n_pred, CASE WHEN given THEN ptm_pred ELSE 0 END AS ptm_pred,
  CASE WHEN given THEN ptm_true_match ELSE 0 END AS ptm_true_match, CASE WHEN given THEN ptm_pred_match ELSE 0 END AS ptm_pred_match, CAST(given AND n_match = greatest(n_true, n_pred) AS INT) AS whole FROM ptm),
k AS (SELECT *, sum(whole) OVER o / row_number() OVER o::DOUBLE AS precision, sum(whole) OVER o / count(*) OVER (PARTITION BY lang)::DOUBLE AS recall FROM g WINDOW o AS (PARTITION BY lang ORDER BY score DESC, spectrum_id ROWS UNBOUNDED PRECEDING)),
a AS (SELECT *, (recall - lag(recall) OVER o) * (precision + lag(precision) OVER o) / 2 AS area FROM k WINDOW o AS (PARTITION BY lang ORDER BY score DESC, spectrum_id))
SELECT lang, round(sum(n_match) / (sum(n_pred) + 1e-8::DOUBLE), 9) AS aa_precision, round(sum(n_match) / (sum(n_true) + 1e-8::DOUBLE), 9) AS aa_recall, round(sum(whole) / (count(*) + 1e-8::DOUBLE), 9) AS peptide_recall,
  round(sum(whole) / (count(*) + 1e-8::DOUBLE), 9) AS peptide_precision, round(sum(ptm_pred_match) / (sum(ptm_pred) + 1e-8::DOUBLE), 9) AS ptm_precision, round(sum(ptm_true_match) / (sum(ptm_true) + 1e-8::DOUBLE), 9) AS ptm_recall, round(sum(area), 9) AS pr_auc
FROM a GROUP BY lang""")
def metrics_seven(spark, d):
    return metrics.seven(_matched(spark, d, False), "lang").withColumns({c: F.round(c, 9) for c in _SEVEN})


@query(_BEST.format(over="ok") + """SELECT round(sum(n_match) FILTER (score > 0.5) / sum(n) FILTER (score > 0.5)::DOUBLE, 9) AS precision, round(sum(n_match) FILTER (score > 0.5) / sum(n)::DOUBLE, 9) AS recall FROM best""")
def aa_threshold_pr(spark, d):
    t, p = (P.split_residues(P.merge_isomers(x)) for x in (F.col("gt_peptide"), F.coalesce("pred_peptide", F.lit(""))))
    residues = _pairs(spark, d).select(F.col("pred_score").alias("score"), F.explode(matching.best_match(t, p, False)).alias("ok"))
    return metrics.thresholded(residues, 0.5).select(F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query(f"SELECT source, round(avg(pred_score), 9) AS pred_score, round(avg(len(pred_peptide)), 9) AS length FROM ({X.pairs(True)}) f GROUP BY source")
def strategy_mean(spark, d):
    return _pairs(spark, d).groupBy("source").agg(F.round(F.avg("pred_score"), 9).alias("pred_score"), F.round(F.avg(F.length("pred_peptide")), 9).alias("length"))


@query("SELECT source, " + ", ".join(f"count(*) FILTER (lang = '{x}') AS {x}_n, round(avg(pred_score) FILTER (lang = '{x}'), 9) AS {x}_score" for x in ("de", "en", "es", "fr")) + f" FROM ({X.pairs(True)}) f GROUP BY source")
def metrics_wide(spark, d):
    wide = _pairs(spark, d).groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("pred_score"), 9).alias("score"))
    return wide.fillna(0, [c for c in wide.columns if c.endswith("_n")])


@query(f"""WITH f AS ({X.pairs(True)}), g AS (SELECT source, lang, round(avg(CASE WHEN pred_peptide = gt_peptide THEN 1.0::DOUBLE WHEN pred_peptide IS NULL THEN 0 ELSE 0 END), 6) AS v FROM f GROUP BY source, lang)
SELECT source, max(v) FILTER (lang = 'de') AS de, max(v) FILTER (lang = 'en') AS en, max(v) FILTER (lang = 'es') AS es, max(v) FILTER (lang = 'fr') AS fr FROM g GROUP BY source""")
def metrics_pivot(spark, d):
    exact = F.coalesce((F.col("pred_peptide") == F.col("gt_peptide")).cast("double"), F.lit(0.0))
    return _pairs(spark, d).groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).agg(F.round(F.avg(exact), 6))


_CHECKPOINT = "CASE WHEN spectrum_id % 41 = 0 THEN 'last.ckpt' ELSE {0} END"


@query(f"""WITH f AS (SELECT source, {_CHECKPOINT.format("'step=' || spectrum_id || '-accuracy=' || printf('%.4f', round(pred_score, 2)) || '.ckpt'")} AS path FROM ({X.pairs(True)}) f),
p AS (SELECT *, TRY_CAST(regexp_extract(path, 'step=([0-9]+)', 1) AS INT) AS step, TRY_CAST(regexp_extract(path, 'accuracy=([0-9]+[.][0-9]+)', 1) AS DOUBLE) AS accuracy FROM f)
SELECT source, path, step, accuracy FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY accuracy DESC, step DESC) AS k FROM p WHERE step IS NOT NULL AND accuracy IS NOT NULL) r WHERE k = 1""")
def best_checkpoint_by_source(spark, d):
    """Of each source's checkpoints, named by step and accuracy, the most accurate, the later at a tie; other names don't count."""
    name = F.expr(_CHECKPOINT.format("concat('step=', spectrum_id, '-accuracy=', format_string('%.4f', round(pred_score, 2)), '.ckpt')"))
    step, accuracy = F.regexp_extract("path", r"step=(\d+)", 1).try_cast("int"), F.regexp_extract("path", r"accuracy=(\d+\.\d+)", 1).try_cast("double")
    rows = _pairs(spark, d).select("source", name.alias("path")).select("source", "path", step.alias("step"), accuracy.alias("accuracy")).where("step is not null and accuracy is not null")
    return rows.groupBy("source").agg(F.max_by(F.struct("path", "step", "accuracy"), F.struct("accuracy", "step")).alias("b")).select("source", "b.*")


_LOGP = f"""SELECT spectrum_id, direction, step, token, logit - top - ln(sum(exp(logit - top)) OVER w) AS logp
FROM (SELECT *, max(logit) OVER (PARTITION BY spectrum_id, direction, step) AS top FROM ({X.logits(True)}) l) l WINDOW w AS (PARTITION BY spectrum_id, direction, step)"""


@query(f"""WITH b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY spectrum_id, direction, step ORDER BY logp DESC, token) AS k FROM ({_LOGP}) l) r WHERE k = 1),
s AS (SELECT *, coalesce(max(CAST(token = 1 AS INT)) OVER (PARTITION BY spectrum_id, direction ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM b)
SELECT spectrum_id, direction, coalesce(string_agg(CASE WHEN token <> 1 THEN CAST(token AS VARCHAR) END, ',' ORDER BY step), '') AS tokens, round(exp(avg(logp)), 6) AS score FROM s WHERE over = 0 GROUP BY ALL""")
def greedy_decode_whole(spark, d):
    return decoding.greedy(_logp(spark, d)).select("spectrum_id", "direction", F.array_join("tokens", ",").alias("tokens"), F.round("score", 6).alias("score"))


def _beam(spark, d):
    steps = _logp(spark, d)
    ids = steps.select("spectrum_id").distinct()
    target = ids.select("spectrum_id", (F.lit(500.0) + F.col("spectrum_id") * 3.7).alias("precursor_mz"), (F.col("spectrum_id") % 3 + 1).alias("charge"))
    return decoding.beam_search(steps, target)


@query()
def beam_decode(spark, d):
    return _beam(spark, d).select("spectrum_id", "direction", F.array_join("tokens", ",").alias("tokens"), F.round("score", 6).alias("score"))


@query()
def resolve_directions(spark, d):
    """Both directions of one search side by side, by a conditional aggregate."""
    pick = lambda c, x: F.max(F.when(F.col("direction") == x, F.col(c))).alias(f"{x}_{c}")
    rows = _beam(spark, d).withColumn("peptide", F.array_join("tokens", ",")).groupBy("spectrum_id").agg(*[pick(c, x) for x in ("fwd", "rev") for c in ("peptide", "score")], F.count("*").alias("n"))
    return decoding.resolve(rows.where("n = 2").drop("n")).withColumns({c: F.round(c, 6) for c in ("fwd_score", "rev_score", "pred_score")})


_LABEL = "(spectrum_id * 7 + step) % 29"


@query(f"""WITH l AS ({_LOGP}), r AS (SELECT spectrum_id, direction, step, {_LABEL} AS label, -max(logp) FILTER (token = {_LABEL}) AS nll, -avg(logp) AS smooth FROM l GROUP BY ALL)
SELECT direction, round(avg(0.95::DOUBLE * nll + 0.05::DOUBLE * smooth), 6) AS loss FROM r WHERE label <> 0 GROUP BY direction""")
def ce_label_smoothing_whole(spark, d):
    return decoding.smoothed_loss(_logp(spark, d).withColumn("label", F.expr(_LABEL)), 0.05, "direction").withColumn("loss", F.round("loss", 6))


@query(f"""WITH b AS (SELECT spectrum_id, direction, step, first(token ORDER BY logp DESC, token) AS best FROM ({_LOGP}) l GROUP BY ALL),
y AS (SELECT *, CASE spectrum_id % 3 WHEN 0 THEN best WHEN 1 THEN CASE WHEN step = 1 + spectrum_id // 3 % 8 THEN 2 + (best + 1) % 27 ELSE best END ELSE {_LABEL} END AS label FROM b),
s AS (SELECT spectrum_id, direction, bool_and(best = label OR label = 0) AS whole FROM y GROUP BY ALL)
SELECT direction, count(*) AS n, round(avg(CAST(whole AS INT)), 9) AS accuracy FROM s GROUP BY direction""")
def teacher_accuracy_whole(spark, d):
    """All 8 places. Labels are the best tokens for a third of the spectra, the same but for one place for another; the rest is arbitrary. Padding labels don't count."""
    other = F.when(F.expr("step = 1 + spectrum_id div 3 % 8"), 2 + (F.col("token") + 1) % 27).otherwise(F.col("token"))
    label = F.when(F.col("spectrum_id") % 3 == 0, F.col("token")).when(F.col("spectrum_id") % 3 == 1, other).otherwise(F.expr(_LABEL))
    best = decoding.best_tokens(_logp(spark, d)).withColumn("label", label).withColumn("keep", F.col("label") != K.PAD)
    n = best.groupBy("direction").agg(F.count_distinct("spectrum_id").alias("n"))
    return n.join(decoding.whole_accuracy(best, "direction"), "direction").withColumn("accuracy", F.round("accuracy", 9))


@query("""WITH e AS (SELECT vec_id // 32 AS id, embedding[1]::DOUBLE * 5 AS s, embedding AS e FROM embeddings), w AS (SELECT *, exp(s - max(s) OVER (PARTITION BY id)) AS w FROM e),
x AS (SELECT id, w, unnest(e)::DOUBLE AS v, generate_subscripts(e, 1) - 1 AS dim FROM w) SELECT id, CAST(dim AS INT) AS dim, round(sum(w * v) / sum(w), 6) + 0.0::DOUBLE AS v FROM x GROUP BY id, dim""")
def attention_pool(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").selectExpr("vec_id div 32 AS id", "double(embedding[0]) * 5 AS score", "embedding AS vector")
    return V.attention_pool(rows, "id").withColumn("v", F.round("v", 6) + F.lit(0.0))


@query("""WITH a AS (SELECT vec_id, embedding AS e, len(embedding) // 2 AS h FROM embeddings), x AS (SELECT *, unnest(range(1, h + 1)) AS k FROM a), t AS (SELECT *, (vec_id % 8) / pow(10000::DOUBLE, (k - 1) / h::DOUBLE) AS t FROM x),
r AS (SELECT vec_id, CAST(k - 1 AS INT) AS dim, e[k]::DOUBLE * cos(t) - e[h + k]::DOUBLE * sin(t) AS v FROM t UNION ALL SELECT vec_id, CAST(h + k - 1 AS INT), e[h + k]::DOUBLE * cos(t) + e[k]::DOUBLE * sin(t) FROM t)
SELECT vec_id, dim, round(v, 6) + 0.0::DOUBLE AS v FROM r""")
def rotary(spark, d):
    half = (F.size("embedding") / 2).cast("int")
    angles = F.transform(F.sequence(F.lit(0), half - 1), lambda k: (F.col("vec_id") % 8) / F.pow(F.lit(10000.0), k / half))
    turned = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", V.rotate(F.col("embedding").cast("array<double>"), angles).alias("r"))
    return turned.select("vec_id", F.posexplode("r").alias("dim", "v")).withColumn("v", F.round("v", 6) + F.lit(0.0))


@query(f"SELECT charge, count(DISTINCT spectrum_id) AS n_spectra, count(*) AS n_peaks FROM ({X.PRECURSORS}) q JOIN ({X.PEAKS}) p USING (spectrum_id) WHERE charge BETWEEN 1 AND 10 GROUP BY charge")
def charge_filter_scan(spark, d):
    return _spectra(spark, d).where(F.col("charge").isin(*mgf.VALID_CHARGE)).groupBy("charge").agg(F.count("*").alias("n_spectra"), F.sum(F.size("peaks")).alias("n_peaks"))


@query(f"""SELECT spectrum_id, peptide_id, round(least(abs(z - precursor_mz), abs(z - precursor_mz + {K.ISOTOPE!r} / charge)) / precursor_mz * 1000000, 4) AS ppm
FROM (SELECT *, mass / charge + {K.PROTON!r} AS z FROM ({X.PRECURSORS}) q JOIN ({_MASSES}) p ON charge BETWEEN 1 AND 10 AND abs((precursor_mz - {K.PROTON!r}) * charge - mass) < 0.5) x""")
def ppm_isotope_fit(spark, d):
    return _within_half(spark, d).select("spectrum_id", "peptide_id", F.round(P.isotope_ppm(P.mass_to_mz(F.col("mass"), F.col("charge")), F.col("precursor_mz"), F.col("charge")), 4).alias("ppm"))


_SIM = f"""SELECT a.batch_id, a.pair_id AS spectrum, b.pair_id AS peptide, 20 * list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE))
  / sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) / sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS sim
FROM ({X.contrast(True)}) a JOIN ({X.contrast(True)}) b ON a.batch_id = b.batch_id AND a.side = 'spectrum' AND b.side = 'peptide'"""


def _similarity(spark, d):
    c = X.view(spark, d, X.contrast(False), "embeddings")
    unit = c.withColumn("n", V.norm(F.col("embedding")))
    side = lambda s, name: unit.where(F.col("side") == s).select("batch_id", F.col("pair_id").alias(name), F.col("embedding").alias(f"{name}_e"), F.col("n").alias(f"{name}_n"))
    sim = 20 * V.dot(F.col("spectrum_e"), F.col("peptide_e")) / F.col("spectrum_n") / F.col("peptide_n")
    return side("spectrum", "spectrum").join(side("peptide", "peptide"), "batch_id").select("batch_id", "spectrum", "peptide", sim.alias("sim"))


@query(f"SELECT batch_id, spectrum, peptide, round(sim, 4) AS sim FROM ({_SIM}) s")
def clip_similarity(spark, d):
    return _similarity(spark, d).withColumn("sim", F.round("sim", 4))


@query(f"SELECT batch_id, spectrum, first(peptide ORDER BY round(sim, 6) DESC, peptide) AS peptide FROM ({_SIM}) s GROUP BY batch_id, spectrum")
def clip_top1(spark, d):
    best = F.max_by("peptide", F.struct(F.round("sim", 6), -F.col("peptide")))
    return _similarity(spark, d).groupBy("batch_id", "spectrum").agg(best.alias("peptide"))


@query(f"""WITH s AS ({_SIM}), r AS (SELECT *, ln(sum(exp(sim)) OVER (PARTITION BY spectrum)) AS row_l, ln(sum(exp(sim)) OVER (PARTITION BY peptide)) AS col_l,
  sim = max(sim) OVER (PARTITION BY spectrum) AS row_1, sim = max(sim) OVER (PARTITION BY peptide) AS col_1 FROM s)
SELECT batch_id, round(avg((row_l - sim + col_l - sim) / 2), 4) AS loss, round(avg((CAST(row_1 AS INT) + CAST(col_1 AS INT)) / 2::DOUBLE), 4) AS top_1 FROM r WHERE spectrum = peptide GROUP BY batch_id""")
def clip_loss(spark, d):
    from pyspark.sql import Window

    row, col = Window.partitionBy("spectrum"), Window.partitionBy("peptide")
    s = F.col("sim")
    r = _similarity(spark, d).select("*", *[x for w, c in ((row, "row"), (col, "col")) for x in (F.log(F.sum(F.exp(s)).over(w)).alias(f"{c}_l"), (s == F.max(s).over(w)).cast("int").alias(f"{c}_1"))])
    return r.where("spectrum = peptide").groupBy("batch_id").agg(F.round(F.avg((F.col("row_l") + F.col("col_l")) / 2 - s), 4).alias("loss"), F.round(F.avg((F.col("row_1") + F.col("col_1")) / 2), 4).alias("top_1"))


@query("SELECT spectrum_id, CAST(i AS INT) AS i, round(CASE WHEN i < 4 THEN sin(precursor_mz / t) ELSE cos(precursor_mz / t) END, 4) + 0.0::DOUBLE AS v FROM (SELECT *, 1.0::DOUBLE / (2 * pi()) * pow(10000::DOUBLE, (i % 4) / 3.0::DOUBLE) AS t FROM (" + X.PRECURSORS + ") q, range(0, 8) r(i)) x")
def float_encoding(spark, d):
    return _precursors(spark, d).select("spectrum_id", F.posexplode(V.float_encoding(F.col("precursor_mz"), 8, 1.0, 10000.0)).alias("i", "v")).withColumn("v", F.round("v", 4) + F.lit(0.0))


@query("""SELECT doc_id, step, round(CASE WHEN step < 100 THEN step / 100.0::DOUBLE ELSE pow(5.0::DOUBLE, -floor((step - 100) / 300.0::DOUBLE)) * 0.5 * (1 + cos(pi() * ((step - 100) / 300.0::DOUBLE - floor((step - 100) / 300.0::DOUBLE)))) END, 6) AS factor
FROM (SELECT doc_id, doc_id % 1000 AS step FROM documents) s""")
def lr_schedule_steps(spark, d):
    """The rate at the step of each document."""
    rows = spark.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id", "doc_id % 1000 AS step")
    return rows.select("doc_id", "step", F.round(V.learning_rate(F.col("step"), V.warmup_steps(0.1, 1000), 1000, 3), 6).alias("factor"))


@query("""SELECT spectrum_id, gib, beams, CAST(greatest(floor(floor(greatest(gib * 1073741824.0::DOUBLE - 1610612736, 0) * 0.95::DOUBLE / (item * 1.15::DOUBLE)) / 8) * 8, 1) AS BIGINT) AS items
FROM (SELECT *, greatest(beams, 1) * (300 * 512 * 2 + 4 * 100 * 9 * 512 * 2 * (1 + d) + 1024 * 2 + 2 * d * (8 * 102 + 4 * 102 * 29 + 4 + 8 * 102 * 102 + 4 * 102 + 4))
  + 1.5::DOUBLE * (4 * 8 * 301 * 301 + 301 * 1024 * 2) AS item FROM (SELECT s_suppkey AS spectrum_id, s_suppkey % 200 AS gib, s_suppkey % 11 AS beams, CASE WHEN s_suppkey % 11 >= 1 THEN 1 ELSE 0 END AS d FROM supplier) r) s""")
def batch_size_rows(spark, d):
    """How many items fit for the memory and the beams of each row."""
    rows = spark.read.parquet(f"{d}/supplier.parquet").selectExpr("s_suppkey AS spectrum_id", "s_suppkey % 200 AS gib", "s_suppkey % 11 AS beams")
    return rows.select("spectrum_id", "gib", "beams", sizing.batch_size(F.col("gib") * float(1 << 30), F.col("beams")).alias("items"))


_X = "(SELECT vec_id, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE AS y FROM embeddings) e"


@query(f"""SELECT vec_id, round(greatest(x, 0), 6) + 0.0::DOUBLE AS relu, round({A.SELU_SCALE!r}::DOUBLE * CASE WHEN x > 0 THEN x ELSE {A.SELU_ALPHA!r}::DOUBLE * (exp(x) - 1) END, 6) + 0.0::DOUBLE AS selu,
  round(x / (1 + exp(-x)), 6) + 0.0::DOUBLE AS silu, round(x / (1 + exp(-x)) * y, 6) + 0.0::DOUBLE AS swilu FROM {_X}""")
def activation_functions(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").selectExpr("vec_id", "double(embedding[0]) * 10 AS x", "double(embedding[1]) AS y")
    x = F.col("x")
    values = {n: A.activation(n, x) for n in ("relu", "selu", "silu")} | {"swilu": A.activation("swilu", x, F.col("y"))}
    return rows.select("vec_id", *[(F.round(v, 6) + F.lit(0.0)).alias(n) for n, v in values.items()])


@query(f"""WITH p AS (SELECT spectrum_id, string_agg(printf('%.6f %.6f', mz, intensity), chr(10) ORDER BY mz, intensity) || chr(10) AS lines FROM ({X.PEAKS}) x GROUP BY spectrum_id)
SELECT spectrum_id, 'BEGIN IONS' || chr(10) || 'TITLE=all:test:' || spectrum_id || chr(10) || 'PEPMASS=' || printf('%.6f', precursor_mz) || chr(10) || 'CHARGE=' || charge || '+' || chr(10) || coalesce(lines, '') || 'END IONS' AS value
FROM ({X.PRECURSORS}) q LEFT JOIN p USING (spectrum_id)""")
def mgf_text_peaks(spark, d):
    """Whole records; a spectrum without peaks has its header only."""
    rows = _precursors(spark, d).join(spectra.collect_peaks(_peaks(spark, d)), "spectrum_id", "left")
    return mgf.mgf_text(rows.withColumn("title", F.concat(F.lit("all:test:"), F.col("spectrum_id").cast("string"))))


@query(f"""SELECT CAST(q.spectrum_id AS VARCHAR) AS title, round(precursor_mz, 4) AS precursor_mz, CAST(charge AS SMALLINT) AS charge, CAST(n AS INT) AS n_peaks, 'ok' AS status
FROM ({X.PRECURSORS}) q JOIN (SELECT spectrum_id, count(*) AS n FROM ({X.PEAKS}) p GROUP BY spectrum_id) c USING (spectrum_id) WHERE charge BETWEEN 1 AND 10""")
def mgf_roundtrip(spark, d):
    folder = f"{scratch(spark)}/mgf"
    mgf.write_mgf(_spectra(spark, d).withColumn("title", F.col("spectrum_id").cast("string")), folder)
    return mgf_source.scan_mgf(spark, folder).select("title", F.round("precursor_mz", 4).alias("precursor_mz"), "charge", F.size("peaks").alias("n_peaks"), "status")


@query(f"SELECT round(pred_score, 9) AS pred_score, coalesce(pred_peptide, '') AS pred_peptide, gt_peptide FROM ({X.pairs(True)}) f")
def csv_roundtrip(spark, d):
    folder = f"{scratch(spark)}/csv"
    files.write_predictions(_pairs(spark, d).select(F.col("pred_score"), "pred_peptide", "gt_peptide"), folder)
    return files.read_predictions(spark, folder, "pred_score double, pred_peptide string, gt_peptide string").withColumn("pred_score", F.round("pred_score", 9))


_DRAW = "CAST('0x' || substr(md5('{0}:{1}:' || {2}), 1, 12) AS BIGINT) / 281474976710656::DOUBLE"


def _augment_sql(probability: float, seed: int) -> str:
    """What augment() makes of all peaks, scaled to each spectrum's highest."""
    key = "spectrum_id || ':' || pos"
    return f"""SELECT spectrum_id, pos, mz, CASE WHEN augmented THEN moved / max(moved) OVER (PARTITION BY spectrum_id) ELSE moved END AS intensity, augmented FROM (
  SELECT *, CASE WHEN augmented THEN intensity * (1 - 0.15::DOUBLE * 2 * ({_DRAW.format(seed, "shift", key)} - 0.5::DOUBLE)) ELSE intensity END AS moved FROM (
    SELECT *, row_number() OVER (PARTITION BY spectrum_id, weak ORDER BY {_DRAW.format(seed, "remove", key)}, pos) AS k, sum(CAST(weak AS INT)) OVER (PARTITION BY spectrum_id) AS n FROM (
      SELECT *, intensity < 0.3::DOUBLE AS weak, {_DRAW.format(seed, "gate", "spectrum_id")} < {probability!r}::DOUBLE AS augmented FROM (
        SELECT spectrum_id, row_number() OVER (PARTITION BY spectrum_id ORDER BY mz, intensity) AS pos, mz, intensity / max(intensity) OVER (PARTITION BY spectrum_id) AS intensity FROM ({X.PEAKS}) p) a) b) c
  WHERE NOT (augmented AND weak AND k <= floor(n * 0.2::DOUBLE))) d"""


def _scaled(spark, d) -> DataFrame:
    from pyspark.sql import Window

    top = F.max("intensity").over(Window.partitionBy("spectrum_id"))
    return _peaks(spark, d).withColumn("pos", F.row_number().over(Window.partitionBy("spectrum_id").orderBy("mz", "intensity"))).withColumn("intensity", F.col("intensity") / top)


@query(f"SELECT spectrum_id, CAST(pos AS INT) AS pos, round(mz, 6) AS mz, round(intensity, 6) AS intensity FROM ({_augment_sql(1.0, 0)}) a")
def spectrum_augment(spark, d):
    rows = spectra.augment(_scaled(spark, d)).drop("augmented")
    return rows.select("spectrum_id", "pos", F.round("mz", 6).alias("mz"), F.round("intensity", 6).alias("intensity"))


@query(f"SELECT spectrum_id, augmented, count(*) AS n_peaks, round(sum(intensity), 5) AS total FROM ({_augment_sql(0.4, 7)}) a GROUP BY spectrum_id, augmented")
def augment_gate(spark, d):
    """A share of the spectra is augmented, the others stay as they are."""
    rows = spectra.augment(_scaled(spark, d), probability=0.4, seed=7)
    return rows.groupBy("spectrum_id", "augmented").agg(F.count("*").alias("n_peaks"), F.round(F.sum("intensity"), 5).alias("total"))


@query(f"SELECT count(*) AS n_peaks, count(DISTINCT spectrum_id) AS n_spectra, round(sum(intensity / top), 4) AS total FROM (SELECT *, max(intensity) OVER (PARTITION BY spectrum_id) AS top FROM ({X.PEAKS}) p) q")
def augment_dummy(spark, d):
    """Dummy mode: draws are made, spectra come back as they were."""
    rows = spectra.augment(_scaled(spark, d), dummy=True)
    return rows.agg(F.count("*").alias("n_peaks"), F.count_distinct("spectrum_id").alias("n_spectra"), F.round(F.sum("intensity"), 4).alias("total"))
