from __future__ import annotations

import random

import pytest

from siltstone import session
from siltstone.operators import capture as capture_module
from siltstone.operators.capture import ChangeCapture, done_batches, next_offsets, pending_keys
from tests.conftest import rows

RECORDS = "batch_id bigint, journal_id bigint, usn bigint, p string, o string, filled int, best int"
LINES = "log_no bigint, batch_id bigint, journal_id bigint, start_usn bigint, next_usn bigint, status string, extra string"

LOG = [
    (1, 1, 7, 0, 10, "started", None), (2, 1, 7, 0, 10, "committed", None), (2, 1, 7, 0, 10, "committed", None),  # done, repeated line
    (3, 2, 7, 10, 20, "committed", None), (4, 2, 7, 10, 20, "rolled_back", None),  # undone
    (5, 3, 7, 20, 0, "committed", None),  # done, offset unusable
    (6, 4, 8, 5, 4, "failed", None), (None, 4, 8, 5, 4, "committed", None), (7, None, 8, 0, 99, "committed", None),
]
DATA = [
    (1, 7, 1, "a", None, 1, 1), (1, 7, 1, None, None, None, None), (2, 7, 1, None, None, None, None),  # in a done batch and in one that is not
    (2, 7, 11, None, "x", 1, None), (9, 7, 11, "y", "x", 1, 1), (3, 7, 21, None, None, None, None), (4, 8, 5, None, None, None, None),
    (None, 8, 6, None, None, None, None), (1, None, 3, None, None, None, None), (2, 8, None, None, None, None, None),
]


def tables(spark, data=DATA, log=LOG):
    return spark.createDataFrame(data, RECORDS), spark.createDataFrame(log, LINES)


def test_last_line_decides(spark):
    _, lines = tables(spark)
    assert rows(done_batches(lines)) == [(1,), (3,)]


def test_pending_are_those_without_a_done_batch(spark):
    records, lines = tables(spark)
    assert rows(pending_keys(records, done_batches(lines))) == [(7, 11), (8, 5), (8, 6)]


def test_empty_tables(spark, home):
    records, lines = tables(spark, [], [])
    run = ChangeCapture(spark, home)
    assert run.keys(run.run(records, lines)).count() == 0
    assert next_offsets(records, lines).count() == 0


def test_a_failed_run_is_replayed_with_its_own_plan(spark, home):
    records, lines = tables(spark)
    first = ChangeCapture(spark, home).run(records, lines, fail_before_commit=True)
    late = records.union(spark.createDataFrame([(9, 7, 500, None, None, None, None)], RECORDS))
    again = ChangeCapture(spark, home).plan(late, lines)
    assert (again.run, again.replayed) == (first.run, True)
    ChangeCapture(spark, home).run(late, lines)
    ChangeCapture(spark, home).run(late, lines)  # picks up the late record
    sink = ChangeCapture(spark, home).sink()
    assert rows(sink.select("run", "journal_id", "usn")) == [(1, 7, 11), (1, 8, 5), (1, 8, 6), (2, 7, 500)]
    assert rows(sink.where("usn = 11").select("p", "o", "filled", "best")) == [("y", "x", 1, 1)]  # the fullest copy
    assert ChangeCapture(spark, home).run(late, lines).run == 3
    assert sink.count() == 4


def test_replay_twice_repeats_nothing(spark, home):
    records, lines = tables(spark)
    for _ in range(3):
        ChangeCapture(spark, home).run(records, lines, fail_before_commit=True)
    assert ChangeCapture(spark, home).sink().count() == 3
    plan = ChangeCapture(spark, home).plan(records, lines)
    assert rows(ChangeCapture(spark, home).offsets(plan)) == [(7, 11, 11, 1), (8, 5, 6, 2)]


def test_a_plan_can_be_given_up(spark, home):
    records, lines = tables(spark)
    capture = ChangeCapture(spark, home)
    plan = capture.run(records, lines, fail_before_commit=True)
    capture.forget(plan.run)
    assert capture.sink() is None
    assert not capture.plan(records, lines).replayed


def test_next_offsets_ignore_unusable_ends(spark):
    records, lines = tables(spark)
    assert rows(next_offsets(records, lines)) == [(7, 22), (8, 7)]


def test_many_runs_against_a_set(spark, home, monkeypatch):
    """Deliveries come in any order, late and again; every run plans what none has planned, and the state stays small."""
    monkeypatch.setattr(capture_module, "MERGE_EVERY", 3)
    r = random.Random(3)
    pool = [(j, u) for j in (7, 8) for u in r.sample(range(-3000, 3_000_000), 60)]
    lines = spark.createDataFrame([], LINES)
    seen, shown = set(), []
    for n in range(5):
        shown += [(100 + n, *k, None, None, None, None) for k in r.sample(pool, 30)]
        run = ChangeCapture(spark, home)
        plan = run.plan(spark.createDataFrame(shown, RECORDS), lines)
        now = {(k[1], k[2]) for k in shown}
        assert set(rows(run.keys(plan))) == now - seen
        run.commit(plan)
        run.commit(plan)  # once more changes nothing
        seen = now
        assert dict(rows(run.next_offsets())) == {j: max(u for k, u in seen if k == j) + 1 for j in {k for k, _ in seen}}
        assert len(run._state()["handled"]) <= 3
    assert len(session.list_names(spark, f"{home}/plan")) <= 4


def test_the_plan_does_not_grow_with_the_runs(spark, home):
    records, lines = tables(spark)
    lengths = []
    for n in range(4):
        run = ChangeCapture(spark, home)
        more = records.union(spark.createDataFrame([(9, 7, 500 + n, None, None, None, None)], RECORDS))
        state = run._state()
        if state["offsets"]:
            lengths.append(len(run._unhandled(more.select("journal_id", "usn").dropna(), state)._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        run.commit(run.plan(more, lines))
    assert len(set(lengths)) == 1


class Crash(Exception):
    pass


@pytest.mark.parametrize("at", [0, 3, 5, 8])
def test_a_crash_at_any_step_of_a_run(spark, home, monkeypatch, at):
    records, lines = tables(spark)
    calls = [0]

    def failing(name):
        plain = getattr(session, name)

        def call(*args):
            calls[0] += 1
            if calls[0] == at + 1:
                raise Crash
            return plain(*args)

        return call

    for name in ("latest_version", "put_version", "put_text", "path_exists", "written"):
        monkeypatch.setattr(capture_module, name, failing(name))
    for n in range(3):
        late = records.union(spark.createDataFrame([(9, 7, 500 - n * 300, None, None, None, None)], RECORDS))
        for _ in range(2):
            try:
                ChangeCapture(spark, home).run(late, lines)
                break
            except Crash:
                continue
    assert rows(ChangeCapture(spark, home).sink().select("journal_id", "usn")) == sorted([(7, -100), (7, 11), (7, 200), (7, 500), (8, 5), (8, 6)])
