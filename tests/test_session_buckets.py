"""A stream's batches are written by many tasks, and its visitors lie in a bounded number of groups of the state store."""

from hitlake.operators.sessions import VISITOR
from hitlake.plans import queries as Q
from hitlake.streaming import jobs as J
from hitlake.streaming import state as K

SF = "/root/testdata/sf0.001"


def test_many_files_and_few_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(J, "folder", lambda _: f"file://{tmp_path}/a")
    stream = Q._in_batches(spark, SF, files=4)
    assert len(list((tmp_path / "a" / "in").glob("*.parquet"))) == 12
    monkeypatch.setattr(J, "folder", lambda _: f"file://{tmp_path}/b")
    key = [*VISITOR, "start_ts"]
    few = sorted(map(tuple, J.run_once(K.running_sessions(stream, buckets=2), "update", key).collect()))
    monkeypatch.undo()
    one = sorted(map(tuple, J.run_once(K.running_sessions(Q._in_batches(spark, SF)), "update", key).collect()))
    assert few == one and len({r[:5] for r in few}) > 2
