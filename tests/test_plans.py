"""Plan shape guards: the properties the design relies on at scale."""
import json
import os
import re
import subprocess
import sys

import pytest

from tapcast.plans.oracle import all_sql
from tapcast.plans.queries import relational_queries

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _formatted(df) -> str:
    """The text ``df.explain("formatted")`` prints."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_no_pairs_no_python(spark, name):
    plan = _plan(relational_queries()[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
                "ArrowEvalPython", "FlatMapGroupsInPandas"):
        assert bad not in plan, (name, bad)


def test_feature_stage_has_three_large_exchanges(spark):
    """The cells' aggregation (staged), the per-day work, the weekly profile
    and target; after the cells no tap is read again."""
    from tapcast.operators.base import tap_cells
    from tapcast.plans import fixture as fx
    first = _formatted(tap_cells(fx.taps(spark, SF)))
    second = _formatted(relational_queries()["train_frame"](spark, SF))
    keys = [re.sub(r"#\d+", "", e) for text in (first, second)
            for e in re.findall(r"Arguments: (hashpartitioning\([^)]*\))", text)]
    large = [k for k in keys if not re.match(r"hashpartitioning\((line_id|station_id, \d|line_id, station_id|"
                                             r"service_date, \d|n_regionkey|group_id|_grp)", k)]
    assert len(large) == 3, keys
    assert large[0].startswith("hashpartitioning(station_id, service_date, slot, device_id")
    assert large[1].startswith("hashpartitioning(station_id, service_date,")
    assert large[2].startswith("hashpartitioning(station_id, hour,")


SCANS = """
import json, os, sys, tempfile
sys.path.insert(0, sys.argv[1])
from tapcast.session import build_session, ensure_checkpoint_dir
logs = tempfile.mkdtemp(prefix="tapcast-test-log-")
s = build_session("scans", master="local[2]", shuffle_partitions=2, extra={
    "spark.eventLog.enabled": "true", "spark.eventLog.dir": "file://" + logs, "spark.eventLog.rolling.enabled": "false",
    "spark.eventLog.compress": "false"})
ensure_checkpoint_dir(s, tempfile.mkdtemp(prefix="tapcast-test-ckpt-"))
from tapcast.plans.queries import relational_queries
for name in sys.argv[3:]:
    s.sparkContext.setJobDescription(name)
    relational_queries()[name](s, sys.argv[2]).write.format("noop").mode("overwrite").save()
s.stop()
last, names = {}, {}
for f in os.listdir(logs):
    for line in open(os.path.join(logs, f)):
        e = json.loads(line)
        if "sparkPlanInfo" in e:
            last[e["executionId"]] = e["sparkPlanInfo"]
            names.setdefault(e["executionId"], e.get("description"))
def scans(n):
    own = "Scan parquet" in n["nodeName"] and "events.parquet" in json.dumps(n.get("metadata", {}))
    return own + sum(map(scans, n["children"]))
total = {}
for k, plan in last.items():
    total[names[k]] = total.get(names[k], 0) + scans(plan)
print("SCANS", json.dumps(total))
"""


def test_frames_scan_the_taps_once_over_all_jobs():
    """Counted in the event log, so that jobs run while a query is built count."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    names = ["train_frame", "line_size", "encode_mean", "rolling_folds"]
    out = subprocess.run([sys.executable, "-c", SCANS, root, SF, *names], capture_output=True, text=True, timeout=600)
    found = json.loads(out.stdout.split("SCANS ")[1])
    assert found == {n: 1 for n in names}, (found, out.stderr[-500:])


def test_scan_reads_only_needed_columns(spark):
    text = _formatted(relational_queries()["slot_counts"](spark, SF))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", text)
    events = [s for s in schemas if "user_id" in s]
    assert events and all("value" not in s and "event_id" not in s and "props" not in s
                          for s in events), events


def test_staged_score_side_pushes_date_filter(spark):
    from tapcast.plans import fixture as fx
    tr, sc = fx.frames(spark, SF, staged=True)
    text = _formatted(sc)
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(service_date,2024-01-30\)", text), text


def test_feature_stage_sorts(spark):
    """Device marks, the shared (station, date | slot) spec for hour/day
    totals and neighbour slots, the weekly profile, the next-day target; and
    two of one row per station, for the outer join of its attributes."""
    text = _formatted(relational_queries()["train_frame"](spark, SF))
    plan_lines = text.split("\n\n")[0]
    assert len(re.findall(r"\bSort \(\d+\)", plan_lines)) == 6, plan_lines
