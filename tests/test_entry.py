import importlib.util
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


def test_entry_and_contract(spark):
    m = _entry()
    df = m.entry(spark)
    assert df.count() > 0
    assert "in_nums" in df.columns and "today_is_holiday" in df.columns
    q, sql = m.queries(), m.oracle_sql()
    assert set(sql) <= set(q)
    assert {"gbt_forecast", "blend_forecast", "stacked_forecast"} <= set(q) - set(sql)
