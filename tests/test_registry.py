def test_registered_queries_agree_with_duckdb(spark):
    """A few queries of each kind against their SQL, on the smallest tables."""
    import os

    import duckdb

    import __spark_entry__

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for file in os.listdir(folder):
        path = f"{folder}/{file}"
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    known, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    for name in ("thread_rollup", "bm25_top10", "phrase_match", "rrf_three_lane", "hybrid_search", "chunk_diff", "sweep_counts", "retry_backoff", "stage_percentiles"):
        got, want = known[name](spark, folder).toPandas(), con.execute(sql[name]).df()
        order = sorted(got.columns)
        assert order == sorted(want.columns), name
        rows = lambda x: sorted(map(str, x[order].round(6).astype(str).values.tolist()))  # noqa: E731, B023
        assert rows(got) == rows(want), name
    assert __spark_entry__.entry(spark).count() > 0
