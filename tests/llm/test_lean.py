"""Workers give memory back after a task."""

from __future__ import annotations

import psutil

from refloom.llm.common import lean


def test_a_worker_gives_back_what_a_task_freed():
    pins = []

    def task(batches):
        held = [bytes(4000) for _ in range(60_000)]
        pins.append(bytes(4000))  # what lies above freed blocks keeps the C library from giving them back by itself
        yield from batches
        del held

    before = psutil.Process().memory_info().rss
    assert list(lean(task)(iter([1, 2]))) == [1, 2]
    assert psutil.Process().memory_info().rss - before < 100 << 20
