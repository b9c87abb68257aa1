"""The queries over PDF files against their SQL, on suppliers whose keys are long, repeated or missing."""

import duckdb
import pytest
from pyspark.sql import functions as F

from figlake.config import ExtractionConfig
from figlake.functions import text as X
from figlake.plans.catalogue import QUERIES
from figlake.plans.oracle import ORACLE_SQL

KEYS = [0, 7, 7, 8, 999, 1000, 1001, 59999, 2**31, 2**63 - 1, None]
OVER_FILES = ["pdf_stream_ingest", "pdf_fixture_figures", "export_roundtrip"]


def both(spark, folder, name, keys):
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").coalesce(1).write.parquet(f"{folder}/supplier.parquet")
    df = QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{folder}/supplier.parquet/*.parquet' WHERE s_suppkey IS NOT NULL")
    return sorted(map(tuple, df.collect())), sorted(con.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[name]})").fetchall())


@pytest.mark.parametrize("name", OVER_FILES)
def test_keys_of_any_length_repeated_or_missing(spark, tmp_path, name):
    got, want = both(spark, tmp_path, name, KEYS)
    assert got == want and len(got) == 10


@pytest.mark.parametrize("name", OVER_FILES)
def test_no_suppliers(spark, tmp_path, name):
    assert both(spark, tmp_path, name, []) == ([], [])


def test_digits_of_a_number(spark):
    rows = spark.createDataFrame([(0, "Figure 123: a"), (1, "Figure 1234: a"), (2, "Fig. 12345.67b - a")], "k int, t string")
    t = F.col("t")
    got = rows.select(X.is_anchor(t), X.anchor_number(t, 5), X.anchor_separator(t, 5), X.caption_number(t), X.caption_number(t, 5)).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(True, "123", ":", "123", "123"), (False, "1234", ":", "123", "1234"), (False, "12345.67b", "-", "123", "12345.67b")]
    assert ExtractionConfig().figure_number_digits == X.DIGITS
    with pytest.raises(ValueError, match="digit"):
        ExtractionConfig(figure_number_digits=0)
