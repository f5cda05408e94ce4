"""Queries that set tables of results side by side, and the clustered and labelled scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakforge.functions import activations as A
from peakforge.functions import constants as K
from peakforge.functions import peptide as P
from peakforge.functions import vectors as V
from peakforge.operators import alignment, batches, matching, spectra
from peakforge.plans import fixtures as X
from peakforge.plans.catalog import _BEST, _LOGP, _OWN, _TOKENS, _VOCAB, ORACLE, _pairs, _peaks, _peptides, _precursors, _tokens_sql, query
from peakforge.sources import files
from peakforge.sources.scratch import scratch
from peakforge.streaming.rows import clean_stream

#: Four tables of metrics by source, none of which has all sources.
_TABLES = {"recall": ("lang = 'en' AND spectrum_id % 3 = 0", "avg(pred_score)"), "precision": ("lang = 'de'", "max(pred_score)"), "length": ("spectrum_id % 50 = 7", "avg(length(gt_peptide))"), "accuracy": ("source <> 'web'", "min(pred_score)")}


@query(f"WITH f AS ({X.pairs(True)})" + "".join(f", {n} AS (SELECT source, round({v}, 9) AS v, count(*) AS n FROM f WHERE {w} GROUP BY source)" for n, (w, v) in _TABLES.items())
       + ", s AS (" + " UNION ".join(f"SELECT source FROM {n}" for n in _TABLES) + ") SELECT s.source, " + ", ".join(f"{n}.v AS {n}_v, {n}.n AS {n}_n, {n}.n IS NOT NULL AS in_{n}" for n in _TABLES)
       + " FROM s " + " ".join(f"LEFT JOIN {n} ON {n}.source IS NOT DISTINCT FROM s.source" for n in _TABLES))
def aligned_metrics(spark, d):
    f = _pairs(spark, d)
    each = {n: f.where(w).groupBy("source").agg(F.round(F.expr(v), 9).alias("v"), F.count("*").alias("n")) for n, (w, v) in _TABLES.items()}
    return alignment.align(each, "source")


@query("""WITH p AS (SELECT DISTINCT lang, source FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL) SELECT source FROM p GROUP BY source HAVING count(*) = (SELECT count(DISTINCT lang) FROM p)""")
def common_sources(spark, d):
    """Sources that every language has."""
    return alignment.common_items(spark.read.parquet(f"{d}/documents.parquet"), "lang", "source")


@query(f"""WITH f AS ({X.pairs(True)}), t AS (SELECT spectrum_id, gt_peptide FROM f WHERE spectrum_id % 5 <> 0), p AS (SELECT spectrum_id, pred_peptide, round(pred_score, 9) AS pred_score FROM f WHERE spectrum_id % 7 <> 0)
SELECT spectrum_id, gt_peptide, pred_peptide, pred_score, CASE WHEN t.spectrum_id IS NULL THEN 'no truth' WHEN p.spectrum_id IS NULL THEN 'no prediction' ELSE 'both' END AS status FROM t FULL JOIN p USING (spectrum_id)""")
def truth_prediction_join(spark, d):
    f = _pairs(spark, d)
    truth = f.where("spectrum_id % 5 <> 0").select("spectrum_id", "gt_peptide")
    predicted = f.where("spectrum_id % 7 <> 0").select("spectrum_id", "pred_peptide", F.round("pred_score", 9).alias("pred_score"))
    return alignment.with_truth(truth, predicted, "spectrum_id")


_STRATEGY = "CASE {0} % 6 WHEN 0 THEN 'Greedy search' WHEN 1 THEN 'beam_10' WHEN 2 THEN 'beam_2' WHEN 3 THEN 'beam_x' WHEN 4 THEN 'greedy_3' ELSE 'other' END"


@query(f"""WITH g AS (SELECT {_STRATEGY.format("spectrum_id")} AS strategy, round(avg(pred_score), 9) AS score, count(*) AS n FROM ({X.pairs(True)}) f GROUP BY 1),
r AS (SELECT *, CASE WHEN contains(lower(strategy), 'greedy') THEN -1 ELSE coalesce(TRY_CAST(string_split(strategy, '_')[2] AS BIGINT), 9999) END AS rank FROM g)
SELECT strategy, score, n, rank, CAST(row_number() OVER (ORDER BY rank, strategy) AS INT) AS place FROM r""")
def strategy_order(spark, d):
    """Strategies in their own order: greedy ones, beams by width, the rest; a row for each strategy, sorted."""
    from pyspark.sql import Window

    g = _pairs(spark, d).withColumn("strategy", F.expr(_STRATEGY.format("spectrum_id"))).groupBy("strategy").agg(F.round(F.avg("pred_score"), 9).alias("score"), F.count("*").alias("n"))
    return g.withColumn("rank", alignment.strategy_rank(F.col("strategy"))).withColumn("place", F.row_number().over(Window.orderBy("rank", "strategy"))).orderBy("place")


@query(f"""SELECT spectrum_id, charge, round(precursor_mz, 4) AS precursor_mz, n_peaks FROM ({X.PRECURSORS}) q JOIN (SELECT spectrum_id, count(*) AS n_peaks FROM ({X.PEAKS}) p GROUP BY spectrum_id) p USING (spectrum_id)
WHERE charge IN (2, 3) AND precursor_mz BETWEEN 500 AND 900""")
def store_scan(spark, d):
    """A store clustered by charge and m/z, read by both."""
    path = f"{scratch(spark)}/store"
    files.write_store(_precursors(spark, d).join(spectra.collect_peaks(_peaks(spark, d)), "spectrum_id"), path, 1 << 20)
    return files.read_store(spark, path, (2, 3), (500.0, 900.0)).select("spectrum_id", "charge", F.round("precursor_mz", 4).alias("precursor_mz"), F.size("peaks").cast("long").alias("n_peaks"))


_FASTA_NAME = "'sp|' || spectrum_id || CASE WHEN spectrum_id % 3 = 0 THEN ' a > b >c' ELSE '' END"


@query(f"SELECT {_FASTA_NAME} AS name, upper(letters) || letters AS sequence FROM ({X.peptides(True)}) f")
def fasta_roundtrip(spark, d):
    """Records with > in their names and sequences over several lines."""
    path = f"{scratch(spark)}/fasta"
    files.write_fasta(_peptides(spark, d).selectExpr(f"{_FASTA_NAME} AS name", "concat(upper(letters), letters) AS sequence"), path, 7)
    return files.read_fasta(spark, path)


@query(f"""WITH a AS ({_tokens_sql("ASC")}), b AS ({_tokens_sql("DESC")}) SELECT a.spectrum_id, round(precursor_mz, 4) AS precursor_mz, charge, a.tokens AS tokens, b.tokens AS tokens_reversed
FROM a JOIN b USING (spectrum_id) JOIN ({X.PRECURSORS}) q USING (spectrum_id) WHERE charge BETWEEN 1 AND 10""")
def labelled_scan(spark, d):
    """Labelled spectra of a store with their tokens in both orders."""
    path = f"{scratch(spark)}/store"
    files.write_store(_precursors(spark, d).join(_peptides(spark, d).select("spectrum_id", "peptide"), "spectrum_id"), path)
    rows = files.read_store(spark, path, tuple(range(1, 11)))
    text = lambda reverse: F.array_join(P.tokenize(F.col("peptide"), reverse=reverse).cast("array<string>"), ",")
    return rows.select("spectrum_id", F.round("precursor_mz", 4).alias("precursor_mz"), "charge", text(False).alias("tokens"), text(True).alias("tokens_reversed"))


@query(f"""
WITH t AS ({_tokens_sql("ASC")}), l AS (SELECT spectrum_id, string_split(tokens, ',') AS v FROM t) SELECT spectrum_id, array_to_string(v[1:least(len(v) - 1, 10)], ',') || ',1' AS tokens FROM l""")
def peptide_truncated(spark, d):
    """At most 9 residues between the ends."""
    return _peptides(spark, d).select("spectrum_id", F.array_join(P.tokenize(F.col("peptide"), max_len=9).cast("array<string>"), ",").alias("tokens"))


@query(f"SELECT spectrum_id, round(sum(mass), 4) AS mass FROM ({_OWN}) t LEFT JOIN {_VOCAB} USING (token) GROUP BY spectrum_id")
def residue_mass(spark, d):
    """Mass without water."""
    return _peptides(spark, d).select("spectrum_id", F.round(P.total(P.masses(P.split_residues(F.col("peptide")))), 4).alias("mass"))


@query(_BEST.format(over="met") + "SELECT spectrum_id, n, n_match FROM best")
def aa_match_mode_best(spark, d):
    t, p = (P.split_residues(P.merge_isomers(x)) for x in (F.col("gt_peptide"), F.coalesce("pred_peptide", F.lit(""))))
    flags = _pairs(spark, d).select("spectrum_id", matching.match(t, p, "best").alias("f"))
    return flags.select("spectrum_id", F.size("f").alias("n"), matching.count_true(F.col("f")).alias("n_match"))


@query("""SELECT vec_id, CAST(i AS INT) AS i, round(x + CASE WHEN i < 32 THEN sin(k / t) ELSE cos(k / t) END, 4) + 0.0::DOUBLE AS v
FROM (SELECT vec_id, (vec_id % 8)::DOUBLE AS k, i, embedding[i + 1]::DOUBLE AS x, 1.0::DOUBLE / (2 * pi()) * pow(10000::DOUBLE, (i % 32) / 31.0::DOUBLE) AS t FROM embeddings, range(0, 64) r(i)) y""")
def positional_encoding(spark, d):
    """Vectors as the places of sequences of 8, each with its place encoded."""
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", V.positional_encoding(F.col("embedding"), F.col("vec_id") % 8, 64).alias("e"))
    return rows.select("vec_id", F.posexplode("e").alias("i", "v")).withColumn("v", F.round("v", 4) + F.lit(0.0))


@query(f"SELECT id, token, round(mass, 6) AS mass, left(token, 1) IN ('+', '-') AS n_term, mass < 0 AS negative, CAST(coalesce(n, 0) AS BIGINT) AS n FROM {_VOCAB} LEFT JOIN (SELECT token, count(*) AS n FROM ({_OWN}) t GROUP BY token) c USING (token)")
def vocabulary_counts(spark, d):
    """The vocabulary with its classes, and how often each residue occurs."""
    n = _peptides(spark, d).select(F.explode(P.split_residues(F.col("peptide"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    words = P.vocabulary(spark).where(F.col("id") > K.SOS).join(n, "token", "left")
    return words.select("id", "token", F.round("mass", 6).alias("mass"), "n_term", (F.col("mass") < 0).alias("negative"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query(f"""SELECT vec_id, round(x * 0.5::DOUBLE * (1 + CASE WHEN abs(z) > 6 THEN sign(z) ELSE 2 / sqrt(pi()) * z * exp(-z * z) * list_reduce([1.0::DOUBLE, {", ".join(f"{d}" for d in range(301, 1, -2))}], lambda a, d: 1 + a * 2 * z * z / d) END), 6) + 0.0::DOUBLE AS gelu
FROM (SELECT vec_id, embedding[1]::DOUBLE * 10 AS x, embedding[1]::DOUBLE * 10 / sqrt(2::DOUBLE) AS z FROM embeddings) e""")
def gelu_activation(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").selectExpr("vec_id", "double(embedding[0]) * 10 AS x")
    return rows.select("vec_id", (F.round(A.gelu(F.col("x")), 6) + F.lit(0.0)).alias("gelu"))


@query(f"SELECT spectrum_id, direction, step, token, round(logp, 6) + 0.0::DOUBLE AS logp FROM ({_LOGP}) l")
def log_softmax_arrays(spark, d):
    """Step scores as arrays over the vocabulary, normalised within each array."""
    rows = X.view(spark, d, X.logits(False), "embeddings")
    grid = rows.groupBy("spectrum_id", "direction", "step").agg(F.array_sort(F.collect_list(F.struct("token", "logit"))).alias("v"))
    return grid.select("spectrum_id", "direction", "step", F.posexplode(V.log_softmax(F.col("v.logit"))).alias("token", "logp")).withColumn("logp", F.round("logp", 6) + F.lit(0.0))


@query(f"SELECT round(pred_score, 9) AS pred_score, coalesce(pred_peptide, '') AS pred_peptide, gt_peptide FROM ({X.pairs(True)}) f")
def tsv_roundtrip(spark, d):
    path = f"{scratch(spark)}/predictions.tsv"
    files.write_predictions(_pairs(spark, d).select("pred_score", "pred_peptide", "gt_peptide"), path, "\t")
    return files.read_predictions(spark, path, "pred_score double, pred_peptide string, gt_peptide string").withColumn("pred_score", F.round("pred_score", 9))


_SAID = _TOKENS.format(p="pred_peptide", f=f"SELECT spectrum_id, lang, source, gt_peptide AS peptide, pred_peptide FROM ({X.pairs(True)}) f WHERE pred_peptide <> ''")


@query(f"""SELECT lang, token, CAST(sum(n) AS BIGINT) AS n FROM (SELECT lang, token, count(*) AS n FROM ({_OWN}) t GROUP BY lang, token
UNION ALL SELECT lang, token, count(*) FROM ({_SAID}) t GROUP BY lang, token) c GROUP BY lang, token""")
def merged_counters(spark, d):
    """Residues of the truth and of predictions, counted apart and merged."""
    f = _pairs(spark, d)
    said = {"gt_peptide": f, "pred_peptide": f.where("pred_peptide <> ''")}
    each = [t.select("lang", F.explode(P.split_residues(F.col(c))).alias("token")).groupBy("lang", "token").agg(F.count("*").alias("n")) for c, t in said.items()]
    return alignment.merge_counters(each, ["lang", "token"])


@query(f"""SELECT lang, coalesce(substr(token, 1, 1) IN ('+', '-'), false) AS n_term, coalesce(mass < 0, false) AS negative, count(*) AS n, round(sum(mass), 3) AS mass
FROM ({_OWN}) t JOIN {_VOCAB} USING (token) GROUP BY ALL""")
def token_predicates(spark, d):
    """How many residues of the peptides each predicate of the vocabulary holds for, and what they weigh."""
    vocab = P.token_predicates(P.vocabulary(spark)).where("not special")
    tokens = X.view(spark, d, X.peptides(False), "documents").select("lang", F.explode(P.split_residues(F.col("peptide"))).alias("token"))
    met = tokens.groupBy("lang", "token").agg(F.count("*").alias("n")).join(F.broadcast(vocab), "token")  # 28 rows, fixed
    return met.groupBy("lang", "n_term", "negative").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("mass") * F.col("n")), 3).alias("mass"))


@query(f"""SELECT spectrum_id, pred_peptide, round(pred_score, 9) AS pred_score, CASE WHEN spectrum_id % 3 = 0 THEN [pred_score > 0.5] ELSE [pred_score > 0.5, pred_peptide IS NULL] END AS flags FROM ({X.pairs(True)}) f""")
def merged_batches(spark, d):
    """Results of three batches, with arrays of different lengths and fields in another order, as one table."""
    f = _pairs(spark, d).withColumn("pred_score", F.round("pred_score", 9))
    high, none = F.col("pred_score") > 0.5, F.col("pred_peptide").isNull()
    parts = [f.where("spectrum_id % 3 = 0").select("spectrum_id", "pred_peptide", "pred_score", F.array(high).alias("flags"))]
    parts += [f.where(f"spectrum_id % 3 = {k}").select(F.array(high, none).alias("flags"), "pred_score", "pred_peptide", "spectrum_id") for k in (1, 2)]
    return batches.merge_batches(parts)


@query(ORACLE["spectrum_clean"])
def spectrum_clean_stream(spark, d):
    """Cleaning as a stream: files in, cleaned spectra appended, as in the batch."""
    path = f"{scratch(spark)}/stream"
    whole = _precursors(spark, d).join(spectra.collect_peaks(_peaks(spark, d)), "spectrum_id")
    whole.write.parquet(f"{path}/in")
    cleaned = clean_stream(spark, f"{path}/in", whole.schema)
    cleaned.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    rows = spark.read.schema(cleaned.schema).parquet(f"{path}/out").select("spectrum_id", F.explode("peaks").alias("p"))
    return rows.select("spectrum_id", F.round("p.mz", 6).alias("mz"), F.round("p.intensity", 6).alias("intensity"))
