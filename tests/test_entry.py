import duckdb

from conftest import SF01


def test_entry_smoke(spark):
    from __spark_entry__ import entry
    rows = entry(spark).collect()
    assert len(rows) >= 1 and set(rows[0].asDict()) == {"source", "n"}


def test_sample_of_queries_against_duckdb(spark):
    from __spark_entry__ import oracle_sql, queries
    q, o = queries(), oracle_sql()
    con = duckdb.connect()
    for t in ("documents", "labels", "events", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    for name in ("clean_filter_dedupe", "parse_responses", "tfidf_weights", "kfold", "collection_rollup"):
        a = sorted(map(tuple, q[name](spark, SF01).select(*sorted(q[name](spark, SF01).columns)).collect()), key=repr)
        cur = con.execute(f"SELECT * FROM ({o[name]})")
        cols = [d[0] for d in cur.description]
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        b = sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=repr)
        assert len(a) == len(b), name
        assert a == b, name
