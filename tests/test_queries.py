"""Every query with SQL gives the same rows as DuckDB; the others give rows."""

import pytest

from newsloom import registry
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    ours = registry.QUERIES[name](spark, SF).toArrow()
    if name not in registry.ORACLE_SQL:
        assert ours.num_rows > 0
        return
    theirs = duck.execute(registry.ORACLE_SQL[name]).to_arrow_table()
    assert sorted(ours.column_names) == sorted(theirs.column_names)
    columns = ", ".join(f'"{c}"' for c in sorted(ours.column_names))
    duck.register("ours", ours)
    duck.register("theirs", theirs)
    assert duck.execute(f"SELECT count(*) FROM (SELECT {columns} FROM ours EXCEPT ALL SELECT {columns} FROM theirs)").fetchall() == [(0,)]
    assert ours.num_rows == theirs.num_rows
