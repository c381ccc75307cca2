"""Library code never pulls data to the driver, never uses local
checkpoints, row-at-a-time UDFs or cross joins."""
import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parent.parent / "tapcast"
FORBIDDEN = [r"\.collect\(\)", r"\.toPandas\(", r"localCheckpoint", r"\budf\(",
             r"pandas_udf", r"crossJoin", r"\.rdd\b"]


def test_library_hygiene():
    hits = []
    for p in ROOT.rglob("*.py"):
        if p.parent.name == "llm":  # has its own rules and tests
            continue
        for i, line in enumerate(p.read_text().splitlines(), 1):
            for pat in FORBIDDEN:
                if re.search(pat, line):
                    hits.append(f"{p.name}:{i}: {line.strip()}")
    assert not hits, hits
