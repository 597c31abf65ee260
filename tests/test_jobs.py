"""The one slot for long jobs."""

import threading

import pytest

from gallerist.jobs import Busy, JobSlot


def test_one_job_at_a_time(spark):
    slot, go = JobSlot(spark), threading.Event()
    assert slot.status().state == "idle"

    def job(step):
        step("first")
        go.wait(30)
        step("second")
        return spark.range(10).count()

    slot.start("scan", job)
    with pytest.raises(Busy):
        slot.start("dedupe", lambda step: None)
    assert slot.status().state == "running" and slot.status().name == "scan"
    go.set()
    s = slot.wait(60)
    assert (s.state, s.stage, s.result, s.error) == ("done", "second", 10, None) and s.ended_at >= s.started_at
    slot.start("bad", lambda step: 1 / 0)
    assert slot.wait(60).error == "ZeroDivisionError: division by zero" and slot.status().state == "failed"


def test_cancelled(spark):
    slot, begun = JobSlot(spark), threading.Event()

    def job(step):
        begun.set()
        while True:
            step("on")
            spark.range(1000).count()

    slot.start("endless", job)
    begun.wait(30)
    slot.cancel()
    assert slot.wait(60).state == "cancelled"
    slot.start("next", lambda step: "fine")
    assert slot.wait(60).result == "fine"
