from versefold import session


def test_shared_folder(spark):
    first = session.shared_dir(spark)
    assert first and session.shared_dir(spark).split("/")[-1] == first.split("/")[-1] or session.shared_dir(spark).startswith(first)
    assert session.cut(spark.range(3)).count() == 3


def test_stages_are_swept(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda s: f"file://{tmp_path}")
    monkeypatch.setattr(session.Stage, "made", [])
    st = session.Stage(spark, "x")
    assert st.write(spark.range(5), "t").count() == 5 and (tmp_path / st.root.rsplit("/", 1)[1] / "t").exists()
    session.sweep()
    assert not (tmp_path / st.root.rsplit("/", 1)[1]).exists()


def test_workers_find_the_package(spark, small):
    session.table(spark, small, "region")
    assert session.ROOT in spark.sparkContext.environment["PYTHONPATH"]
