"""Table functions of SQL give what the questions give, over a store too."""

from test_store import SF, rows, store  # noqa: F401  (a fixture)

from meterlake.functions import sql
from meterlake.operators import usage
from meterlake.operators.usage import Scope
from meterlake.sources import tables as T


def test_table_functions(spark, store):  # noqa: F811
    store.save_usage_events(T.usage_events(spark, SF))
    sql.register_tables(spark, store.events(), "Asia/Seoul")
    scope = Scope("2024-01-15", "2024-01-25")
    period = "TIMESTAMP '2024-01-15', TIMESTAMP '2024-01-25'"
    assert rows(spark.sql(f"SELECT * FROM usage_overview({period})")) == rows(store.overview(scope))
    assert rows(spark.sql(f"SELECT * FROM usage_series({period})")) == rows(usage.series(usage.scan(store.events(), scope), "Asia/Seoul"))
    # Joined laterally: a period twice, one without events, one that is null.
    asked = "VALUES (1, TIMESTAMP '2024-01-15', TIMESTAMP '2024-01-25'), (2, TIMESTAMP '2024-01-15', TIMESTAMP '2024-01-25'), (3, TIMESTAMP '2030-01-01', TIMESTAMP '2030-02-01'), (4, NULL, NULL)"
    got = {r.n: r for r in spark.sql(f"SELECT s.n, o.* FROM ({asked}) AS s(n, a, b), LATERAL usage_overview(s.a, s.b) AS o").collect()}
    assert set(got) == {1, 2, 3, 4} and got[1][1:] == got[2][1:] and got[3].sessions == got[4].sessions == 0 and got[4].cost == 0
    assert got[1].sessions == store.overview(scope).first().sessions > 0
