import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_catalogue_matches_oracles(spark):
    import duckdb

    from lectern.plans import catalogue

    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "benchmark", "conversations", "events", "orders", "customer", "lineitem"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in catalogue.oracle_sql().items():
        got, want = catalogue.queries()[name](spark, SF), con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns), name
        order = sorted(want.columns)
        rounded = lambda v: round(v, 6) if isinstance(v, float) else v
        a = sorted(str([rounded(r[c]) for c in order]) for r in got.collect())
        b = sorted(str([rounded(v) for v in r]) for r in want.select(*[f'"{c}"' for c in order]).fetchall())
        assert a == b, name
