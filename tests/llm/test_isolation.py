import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parents[2]


def test_nothing_else_imports_this_package():
    for path in (ROOT / "skein").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "skein").parts:
            assert not re.search(r"skein\.llm|from skein import llm", path.read_text()), path


def test_queries_run_on_small_tables(spark):
    import os

    import pytest

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    from oracle import connect, differences

    from skein.llm.queries import oracle_sql, queries

    con = connect("/root/testdata/sf0.001")
    for name, f in queries().items():
        df = f(spark, "/root/testdata/sf0.001")
        if name in oracle_sql():
            assert differences(df, con, oracle_sql()[name]) == ""
        else:
            assert df.count() >= 0
