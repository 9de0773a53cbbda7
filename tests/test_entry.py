import duckdb
import pytest

import __spark_entry__ as entry

#: A few of each kind; the driver compares all.
NAMES = ("detect_jailbreak", "detect_mcp", "detect_load", "repo_score", "suppressed", "baseline_score", "guard_decisions", "extract_structured", "event_windows")
TABLES = "documents conversations events pages benchmark labels".split()


def norm(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, data, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    df = entry.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in got.fetchall()]
    mine = norm(map(tuple, df.select(*cols).collect()))
    assert mine and mine == norm(want)


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
