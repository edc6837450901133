import os

from textbench import session as S


def test_work_is_cleared(spark, tmp_path, monkeypatch):
    """All that the application wrote goes, and what others wrote stays."""
    own = S._work_root(spark)
    assert own == f"{spark.conf.get('spark.checkpoint.dir')}/textbench/{spark.sparkContext.applicationId}"
    monkeypatch.setattr(S, "_work_root", lambda spark: f"{tmp_path}/textbench/application_own")
    frames = [S.materialize(spark.range(n)) for n in (3, 5)]
    assert [f.count() for f in frames] == [3, 5]
    other = tmp_path / "textbench" / "application_other" / "x"
    other.mkdir(parents=True)
    assert S.clear_work(spark) and not S.clear_work(spark)
    assert os.listdir(tmp_path / "textbench") == ["application_other"] and other.exists()
    assert S.materialize(spark.range(2)).count() == 2
