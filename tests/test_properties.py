"""Random taps: the slot table, distinct devices and neighbour slots equal a
plain-Python brute force over the same rows."""
import datetime as dt
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from helpers import taps_df
from tapcast.operators.base import slot_table
from tapcast.operators.neighbors import add_neighbor_slots

TAP = st.tuples(st.integers(1, 3),                       # day
                st.integers(0, 1439),                    # minute of day
                st.integers(0, 2),                       # station
                st.one_of(st.none(), st.integers(0, 3)), # device
                st.one_of(st.none(), st.integers(0, 1))) # status


def brute(taps, width=10):
    """Slot = minute of day // width; a slot's hour is the hour it starts in."""
    cells = defaultdict(list)
    for day, mod, station, device, status in taps:
        cells[(station, day, mod // width)].append((device, status))
    day_dev, hour_dev = defaultdict(set), defaultdict(set)
    for day, mod, station, device, _ in taps:
        if device is not None:
            day_dev[(station, day)].add(device)
            hour_dev[(station, day, (mod // width) * width // 60)].add(device)
    out = {}
    for (station, day, slot), rows in cells.items():
        n = sum(1 for _, s in rows if s is not None)
        ins = sum(s for _, s in rows if s is not None)
        out[(station, day, slot)] = dict(
            in_nums=ins, out_nums=n - ins,
            nuni_device_station=len(day_dev[(station, day)]),
            nuni_device_station_hour=len(hour_dev[(station, day, slot * width // 60)]),
            nuni_device_station_slot=len({d for d, _ in rows if d is not None}))
    for (station, day, slot), r in out.items():
        for k in (1, 2):
            before = out.get((station, day, slot - k))
            after = out.get((station, day, slot + k))
            r[f"in_before{k}"] = before["in_nums"] if before else 0
            r[f"out_after{k}"] = after["out_nums"] if after else 0
    return out


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(TAP, min_size=1, max_size=40), st.sampled_from([10, 60, 120]))
def test_slot_table_and_neighbours_match_brute_force(spark, taps, width):
    rows = [(dt.datetime(2024, 3, d) + dt.timedelta(minutes=m), "L", s, dev, stt)
            for d, m, s, dev, stt in taps]
    got = add_neighbor_slots(slot_table(taps_df(spark, rows), slot_minutes=width)).collect()
    want = brute(taps, width)
    assert len(got) == len(want)
    for r in got:
        w = want[(r.station_id, r.service_date.day, r.slot)]
        for c, v in w.items():
            src = {"in_nums": "in_now", "out_nums": "out_now"}.get(c, c)
            assert r[src] == v, (c, r, w)
