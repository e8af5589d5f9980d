"""Stages keep columns whose names are those that they use inside, and never crash on odd tables with them."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

NAMES = ["__n", "__d", "__dd", "__k", "__m", "__row", "__spans", "__e", "__text", "__id", "row", "id", "domain", "n", "fp", "label", "size"]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_columns_of_any_name_stay(spark, odd, documents, none, name, stage):
    sf = "/root/testdata/sf0.001"
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for df in (plain, documents.limit(60), none):
        clashing = df.withColumns({n: F.concat(F.lit(f"{n}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for n in NAMES})
        got = stage(spark, clashing, sf)
        assert got.columns == clashing.columns
        rows = got.collect()
        assert all(r[n] == f"{n}|{'-' if r['doc_id'] is None else r['doc_id']}" for r in rows for n in NAMES)
        assert len(rows) == stage(spark, df, sf).count()
