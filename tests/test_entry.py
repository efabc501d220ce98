import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_import_needs_no_session():
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=ROOT, capture_output=True, text=True, check=True)
    n, m = map(int, said.stdout.split())
    assert n >= m > 100


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", ["bm25_standard", "tfidf_ad_hoc", "knn_cosine", "memory_summary_context", "store_conjunction", "stem_vocabulary", "metric_histogram_text", "prompt_few_shot", "stream_windows", "bm25_stored", "hybrid_deduplicated", "mmr_rerank", "config_store", "chain_llm_braces"])
def test_against_sql(spark, name):
    import duckdb

    import __spark_entry__

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(want.columns) == columns
    rows = want.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, rows))
