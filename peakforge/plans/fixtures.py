"""Spectra, peptides and scores derived from the driver's tables: the same views for Spark and, as SQL, for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PEAKS = """SELECT l_suppkey AS spectrum_id, CAST(40 AS DOUBLE) + CAST((l_orderkey*37 + l_partkey*13 + l_linenumber*1009) % 445000 AS DOUBLE) / CAST(100 AS DOUBLE) AS mz,
  l_extendedprice AS intensity FROM lineitem"""
PRECURSORS = """SELECT s_suppkey AS spectrum_id, CAST(s_suppkey % 12 AS INT) AS charge,
  CAST(300 AS DOUBLE) + CAST((s_suppkey*7919) % 120000 AS DOUBLE) / CAST(100 AS DOUBLE) AS precursor_mz FROM supplier"""


def ptm(x: str) -> str:
    return f"replace(replace(replace(replace({x},'C','C+57.021'),'ME','M+15.995E'),'NG','N+0.984G'),'QE','Q+0.984E')"


def peptides(duck: bool) -> str:
    flag = ", 'g'" if duck else ""
    return f"""SELECT spectrum_id, lang, source, letters, nterm || {ptm("letters")} AS peptide
FROM (SELECT doc_id AS spectrum_id, lang, source, CASE WHEN doc_id % 7 = 0 THEN '+42.011' WHEN doc_id % 11 = 0 THEN '-17.027' ELSE '' END AS nterm,
  substr(upper(regexp_replace(text, '[^acdefghiklmnpqrstvwy]', ''{flag})), 1, CAST(6 + doc_id % 15 AS INT)) AS letters FROM documents) t WHERE length(letters) >= 6"""


def pairs(duck: bool) -> str:
    return f"""SELECT spectrum_id, lang, source, peptide AS gt_peptide, CASE spectrum_id % 8 WHEN 0 THEN peptide WHEN 1 THEN replace(peptide,'N+0.984','D') WHEN 2 THEN replace(peptide,'N','GG')
  WHEN 3 THEN {ptm("substr(letters,1,length(letters)-1)")} WHEN 4 THEN '' WHEN 5 THEN replace(peptide,'L','I')
  WHEN 6 THEN {ptm("concat(substr(letters,2,1),substr(letters,1,1),substr(letters,3,40))")} ELSE NULL END AS pred_peptide,
  CAST((spectrum_id*7919) % 10007 AS DOUBLE)/CAST(10007 AS DOUBLE) AS pred_score FROM ({peptides(duck)}) x"""


def logits(duck: bool) -> str:
    """Adjusted logits of the spectra that have all 8 steps."""
    div, at, ids = ("vec_id // 8", "d.off + t.token + 1", "unnest(range(0,29))") if duck else ("vec_id div 8", "d.off + t.token", "explode(sequence(0,28))")
    return f"""SELECT CAST({div} AS INT) AS spectrum_id, CAST(vec_id % 8 + 1 AS INT) AS step, d.direction, CAST(t.token AS INT) AS token, CAST(embedding[{at}] AS DOUBLE) * CAST(20 AS DOUBLE)
  + CASE WHEN t.token = 1 AND vec_id % 8 + 1 <= 4 THEN -20 WHEN t.token = 1 AND vec_id % 8 + 1 >= 6 THEN 12 WHEN t.token BETWEEN 22 AND 25 AND vec_id % 8 + 1 > 1 THEN -4 ELSE 0 END AS logit
FROM embeddings CROSS JOIN (SELECT 'fwd' AS direction, 0 AS off UNION ALL SELECT 'rev', 29) d CROSS JOIN (SELECT {ids} AS token) t
WHERE {div} IN (SELECT {div} FROM embeddings GROUP BY {div} HAVING count(DISTINCT vec_id) = 8)"""


def contrast(duck: bool) -> str:
    div = "//" if duck else "div"
    return f"SELECT vec_id {div} 2 AS pair_id, vec_id {div} 32 AS batch_id, CASE WHEN vec_id % 2 = 0 THEN 'spectrum' ELSE 'peptide' END AS side, embedding FROM embeddings"


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """sql over tables of sf_dir, without names left behind in the session."""
    return spark.sql(sql.replace("{", "{{").replace("}", "}}") if not tables else _named(sql, tables), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def _named(sql: str, tables: tuple[str, ...]) -> str:
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return sql
