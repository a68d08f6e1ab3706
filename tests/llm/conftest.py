import duckdb
import pytest


@pytest.fixture(scope="session")
def compare(spark):
    """Compares a registered query with its SQL on a data folder, as multisets of rows."""

    def run(name, sf_dir="/root/testdata/sf0.01"):
        from evisparq.llm import registry

        con = duckdb.connect()
        for t in ("documents", "pages", "embeddings", "benchmark", "labels", "conversations"):
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        got = registry.queries()[name](spark, sf_dir)
        want = con.execute(registry.oracle_sql()[name])
        names = sorted(x[0] for x in want.description)
        assert sorted(got.columns) == names
        rows = [dict(zip((x[0] for x in want.description), r, strict=True)) for r in want.fetchall()]
        assert sorted(str([r[n] for n in names]) for r in got.collect()) == sorted(str([r[n] for n in names]) for r in rows)

    return run
