from pathscreen import catalog
from pathscreen.catalog.views import v_trd

SMOKE = "/root/testdata/sf0.001"


def test_the_joins_of_the_trades_run_once(spark):
    """The numbering reads its rows twice; what it reads is written, so no plan holds the joins of the four tables."""
    for rows in (v_trd(spark, SMOKE), *(catalog.queries()[q](spark, SMOKE) for q in ("event_pair_first_entry", "trades_to_daily", "load_trades", "top_contributors"))):
        assert not [f for f in rows.inputFiles() if "lineitem" in f or "/part." in f]
