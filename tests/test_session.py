from __future__ import annotations

import zipfile
from types import SimpleNamespace

import pytest

from phyllary import session


def _cluster(tmp, shared=None):
    """What a session on a cluster looks like to the helpers."""
    shipped = []
    conf = SimpleNamespace(get=lambda key, default=None: shared or default)
    jsc = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False)))
    sc = SimpleNamespace(master="spark://host:7077", applicationId=f"app-{tmp}", environment={}, addPyFile=shipped.append, getConf=lambda: conf, _jsc=jsc, setCheckpointDir=shipped.append)
    return SimpleNamespace(sparkContext=sc, conf=conf), shipped


def test_clusters_need_a_shared_checkpoint_folder(tmp_path):
    spark, _ = _cluster(tmp_path)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(spark)
    spark, made = _cluster(tmp_path, "/shared/ckpt")
    assert session.checkpoint_dir(spark) == "/shared/ckpt" and made == ["/shared/ckpt"]


def test_the_package_is_shipped_once(tmp_path, monkeypatch):
    monkeypatch.setattr(session, "_shipped", {})
    spark, shipped = _cluster(tmp_path)
    session.prepare(session.prepare(spark))
    (archive,) = shipped
    names = zipfile.ZipFile(archive).namelist()
    assert "phyllary/session.py" in names and "phyllary/functions/segments.py" in names and session.ROOT in spark.sparkContext.environment["PYTHONPATH"]
