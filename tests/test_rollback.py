"""A rollback that fails half-way loses nothing."""

import pytest

from recallgrid.service import Service


def test_rollback_keeps_the_current_version_until_the_end(spark, tmp_path, monkeypatch):
    s = Service(spark, f"file://{tmp_path}")
    for text in ("User: I prefer short answers.", "User: I decided on Parquet for storage.", "User: I always write tests first."):
        s.import_text(text, "pack")
    ids = lambda v=None: {r["id"] for r in s.store.load("pack", v).collect()}
    first, last = ids(1), ids()
    assert s.store.list_versions("pack") == [1, 2, 3] and first < last

    def fail(*_, **__):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(s.store, "save", fail)
        with pytest.raises(OSError):
            s.rollback("pack", 1)
    assert s.store.list_versions("pack") == [1, 2, 3] and ids() == last
    with monkeypatch.context() as m:
        m.setattr(s.store, "delete_version", fail)
        with pytest.raises(OSError):
            s.rollback("pack", 1)
    assert s.store.list_versions("pack") == [1, 2, 3] and ids() == last and ids(1) == first
    s.rollback("pack", 1)
    assert s.store.list_versions("pack") == [1] and ids() == first
