"""Worker processes between tasks."""

import re
from pathlib import Path

import pyarrow as pa

from epochlake.llm import common


def resident():
    return int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024


def test_freed_memory_goes_back_after_a_batch():
    """Small objects of a batch, with one that stays above them, left a worker at its largest size before."""
    batches = iter([pa.RecordBatch.from_pydict({"text": ["x" * 10] * 1000})])
    had, stays = resident(), None
    for _ in common.slices(batches):
        made = [bytearray(60_000) for _ in range(5000)]
        stays = bytearray(60_000)
        assert resident() > had + 200
        del made
    assert resident() < had + 60 and stays is not None
