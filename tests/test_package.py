"""Rules the package keeps: nothing whole on the driver, no unsafe lineage cuts, no pair products."""

import re
from pathlib import Path

PACKAGE = Path(__file__).resolve().parents[1] / "transit_spark"
SOURCE = {p: p.read_text() for p in PACKAGE.rglob("*.py") if "llm" not in p.parts}


def test_no_driver_side_frames_or_local_checkpoints():
    for path, text in SOURCE.items():
        for word in ("toPandas(", "localCheckpoint(", "crossJoin(", ".rdd", "toLocalIterator(", "limit("):
            assert word not in text, f"{word} in {path}"


def test_windows_are_partitioned():
    for path, text in SOURCE.items():
        assert not re.search(r"Window\.orderBy", text), path
