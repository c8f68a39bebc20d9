"""The shared folder of sessions that name none."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from deedflow.sources import scratch


def session(master: str, named: str | None = None):  # noqa: ANN201
    conf = SimpleNamespace(get=lambda key, default=None: named)
    context = SimpleNamespace(master=master, applicationId="a1", getConf=lambda: SimpleNamespace(get=lambda key: None))
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_a_local_session_gets_one_folder_and_a_cluster_none(monkeypatch):
    monkeypatch.setattr(scratch, "_OWN", {})
    own = scratch.shared_dir(session("local[4]"))
    assert own.startswith("file:///") and scratch.shared_dir(session("local[4]")) == own
    assert scratch.shared_dir(session("local", "file:///named/")) == "file:///named"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(session("local-cluster[3,2,1000]"))
