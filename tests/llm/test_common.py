import os
import threading

from lindero.llm.common import drop_since, tables_so_far, written_table


def stays(table):
    return os.path.exists(table.lindero_place.removeprefix("file:"))


def test_marks_hold_after_earlier_tables_went(spark):
    early = written_table(spark.range(3))
    mark = tables_so_far()
    late, kept = written_table(spark.range(4)), written_table(spark.range(5))
    drop_since(spark, mark, kept)
    assert stays(early) and not stays(late) and kept.count() == 5
    later = tables_so_far()
    drop_since(spark, 0)
    assert not stays(early) and not stays(kept)
    last = written_table(spark.range(6))
    drop_since(spark, later)
    assert not stays(last)


def test_threads_keep_their_tables(spark):
    mark, theirs = tables_so_far(), []
    other = threading.Thread(target=lambda: theirs.append(written_table(spark.range(7))))
    other.start()
    other.join()
    own = written_table(spark.range(8))
    drop_since(spark, mark)
    assert not stays(own) and theirs[0].count() == 7


def test_workers_give_memory_back_before_and_after_a_step(monkeypatch):
    """Also where a step fails or is left before its end."""
    from lindero.llm import common

    seen = []
    monkeypatch.setattr(common, "give_back", lambda: seen.append("back"))
    assert list(common.lean(lambda batches: (b + 1 for b in batches))(iter([1, 2]))) == [2, 3] and seen == ["back"] * 2
    part = common.lean(lambda batches: iter(batches))([1, 2])
    assert next(part) == 1 and len(seen) == 3
    part.close()
    assert len(seen) == 4
