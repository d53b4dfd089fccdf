"""Library code pulls to the driver only bounded side-table facts."""

import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parents[1] / "skillweave"

# (file, function) pairs allowed to act on the driver, each reading a bounded table:
ALLOWED = {
    ("functions/bitmaps.py", "slot_bitmap"),      # a bitmap of fixed size
    ("operators/tagger.py", "dictionary_sizes"),  # distinct (model, n) pairs of a dictionary
    ("operators/ordinals.py", "with_ordinals"),   # row counts of ranges
    ("plans/run.py", "metadata"),                   # row counts of the run's tables
    ("sources/adverts.py", "read_postings"),      # first invalid advert, limit(1), strict mode only
}


def _functions_with(pattern):
    hits = set()
    for path in ROOT.rglob("*.py"):
        if path.is_relative_to(ROOT / "llm"):  # has its own tests
            continue
        current = None
        for line in path.read_text(encoding="utf-8").splitlines():
            m = re.match(r"\s*def (\w+)\(", line)
            if m and not line.startswith(" " * 8):
                current = m.group(1)
            if re.search(pattern, line):
                hits.add((str(path.relative_to(ROOT)), current))
    return hits


def test_driver_side_pulls_are_whitelisted():
    assert _functions_with(r"\.collect\(\)|\.toPandas\(\)") <= ALLOWED


def test_no_local_checkpoint_or_row_udfs():
    assert not _functions_with(r"localCheckpoint|@F\.udf|F\.udf\(|monotonically_increasing_id")
