"""run() against its stages one by one, and the stages on odd tables."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from peakforge.llm import tokens
from peakforge.llm.queries import TOKENIZER

SF = "/root/testdata/sf0.001"


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        assert 0 < docs.count() < 3 * seen
    want = sorted(tuple(r) for r in tokens.read_digests(tokens.write_tokens(docs, TOKENIZER)).collect())
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == want


@pytest.mark.parametrize("kind", ["empty", "odd"])
def test_stages_on_odd_tables(spark, kind):
    some = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    if kind == "empty":
        docs = some.limit(0)
    else:
        null = some.limit(5).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in some.schema])
        docs = some.unionByName(some.limit(10)).unionByName(null).withColumns({"size": F.lit(1), "h1": F.lit("x"), "node": F.lit(None).cast("string")})
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        docs = docs.cache()
        docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
