import pyarrow as pa
import pytest

from keelson.llm import workers


def test_memory_is_given_back_however_a_task_ends(monkeypatch):
    done = []
    monkeypatch.setattr(workers, "give_back", lambda: done.append(1))

    @workers.tidy
    def run(batches):
        for b in batches:
            yield b.slice(b.column("n")[0].as_py())

    b = pa.RecordBatch.from_arrays([pa.array([1, 2])], ["n"])
    assert [x.num_rows for x in run(iter([b, b]))] == [1, 1] and len(done) == 1
    next(cut := run(iter([b, b])))
    cut.close()
    with pytest.raises(AttributeError):
        list(run(iter([None])))
    assert len(done) == 3


def test_give_back():
    workers.give_back()
