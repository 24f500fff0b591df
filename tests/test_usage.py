"""The README usage example runs end to end."""

from gridlake.operators import clean, evaluate, features, merge, prep, stateful, telemetry
from gridlake.sources import fixtures as FX


def test_readme_example(spark, sf_small):
    solar = FX.solar(spark, sf_small)
    wind = FX.wind(spark, sf_small)
    solar_c = clean.clean_solar(solar)
    wind_c = clean.clean_wind(wind)
    merged = merge.unified_timeline(solar_c.drop("rn"), wind_c.drop("rn"))
    table = features.engineered_a(merged)
    ready = prep.impute(table, prep.MERGED_POLICY)
    split = evaluate.chrono_split(ready)
    roles = {r.holdout_role: r["count"] for r in split.groupBy("holdout_role").count().collect()}
    assert roles.get("train", 0) > roles.get("test", 0) > 0
    tel = telemetry.control_terms(FX.telemetry(spark, sf_small))
    soc = stateful.soc_balance(tel)
    assert soc.count() == tel.count()
