"""Exclusive claims: one holder, release, expiry, and two movers at once."""
import threading

import pytest

from cohortlens import schemas as S
from cohortlens.operators import store as st
from cohortlens.operators.claims import Claim, ClaimLost, claimed
from cohortlens.session import scratch_path


def small(spark, n=24):
    rows = [(i, "XGBoost" if i % 2 else "tabnet", i % 2, i / n, "r") for i in range(n)]
    pred, live = scratch_path(spark, "c-preds"), scratch_path(spark, "c-live")
    st.sink_replace_model(spark.createDataFrame(rows, S.PREDICTIONS_SCHEMA), pred)
    return pred, live


def everything(spark, pred, live):
    return sorted(r.id_student for t in (st.read_predictions(spark, pred), st.read_live(spark, live)) for r in t.collect())


def test_one_holder_release_and_expiry(spark):
    table = scratch_path(spark, "claimed")
    a, b, c = Claim(spark, table), Claim(spark, table), Claim(spark, table, seconds=0)
    assert a.take() and not b.take()
    a.check()
    a.release()
    assert c.take()                 # its lease is over at once
    assert b.take()
    b.check()
    with pytest.raises(ClaimLost):
        c.check()
    with pytest.raises(TimeoutError), claimed(spark, table, wait=0):
        pass
    b.release()
    with claimed(spark, table) as d:
        d.check()


def test_claim_files_are_granted_once(spark):
    table, granted = scratch_path(spark, "raced"), []
    claims = [Claim(spark, table) for _ in range(6)]
    for c in claims:
        assert c._numbers() == {}
    threads = [threading.Thread(target=lambda c=c: granted.append(c._create("1.claim", c.owner))) for c in claims[:1]]
    for t in threads:
        t.start()
        t.join()
    granted += [c._create("1.claim", c.owner) for c in claims[1:]]
    assert granted.count(True) == 1


def test_a_second_mover_within_the_first_moves_nothing(spark, monkeypatch):
    pred, live = small(spark)
    before, real, seen = everything(spark, pred, live), st.write_live, []

    def write(rows, path, batch):
        seen.append(st.move_live(spark, pred, live, S.LIVE_MODEL_NAMES).first())     # starts while files are listed and planned
        real(rows, path, batch)
    monkeypatch.setattr(st, "write_live", write)
    first = st.move_live(spark, pred, live, S.LIVE_MODEL_NAMES).first()
    assert seen[0].inserted == 0 and first.inserted == first.candidates == 12
    assert everything(spark, pred, live) == before


def test_a_mover_taken_for_dead_stops_before_it_writes(spark, monkeypatch):
    pred, live = small(spark)
    before, real, depth = everything(spark, pred, live), st._mark, []

    def mark(s, marker, batch, state, files):
        real(s, marker, batch, state, files)
        if state == "planned" and not depth:
            depth.append(1)          # the first mover stalls here; its lease of 0 seconds is over
            other = st.move_live(spark, pred, live, S.LIVE_MODEL_NAMES).first()
            assert other.inserted == 12
    monkeypatch.setattr(st, "_mark", mark)
    with pytest.raises(ClaimLost):
        st.move_live(spark, pred, live, S.LIVE_MODEL_NAMES, lease_seconds=0)
    monkeypatch.setattr(st, "_mark", real)
    assert everything(spark, pred, live) == before
    assert st.move_live(spark, pred, live, S.LIVE_MODEL_NAMES).first().inserted == 0
    assert everything(spark, pred, live) == before
