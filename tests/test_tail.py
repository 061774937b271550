"""The tail of growing files: every finished line once, over appends, rewrites and any cut of bytes; and what a watcher sees."""

import json
import random

import pytest
from pyspark.sql import Row

from runloom.functions.workers import ready
from runloom.sources.tail import TailReader, TailSource
from runloom.streaming import stateful
from tests.test_stateful import Handle, event, kept


def test_ranges_hold_every_line_once(tmp_path):
    rnd = random.Random(3)
    text = "".join("".join(rnd.choices("ab😀é", k=rnd.randint(0, 9))) + rnd.choice(["\n", "\r\n"]) for _ in range(60)) + "open"
    (tmp_path / "f").write_bytes(text.encode())
    want = [x.rstrip("\r") for x in text.split("\n")]
    for chunk in (1, 2, 3, 7, 64, 10_000):
        for drain in ("false", "true"):
            r = TailReader({"path": str(tmp_path), "chunk": str(chunk), "drain": drain})
            end = r.latestOffset()
            got = [row for p in r.partitions(r.initialOffset(), end) for row in r.read(p)]
            assert [x for _, _, x in got] == (want if drain == "true" else want[:-1])
            assert [text.encode()[at:].decode().split("\n")[0].rstrip("\r") for _, at, _ in got] == [x for _, _, x in got]


def test_cut_at_every_byte(tmp_path):
    data = "é1\n😀😀\r\n\nlast\n".encode()
    for cut in range(len(data) + 1):
        (tmp_path / "f").write_bytes(data[:cut])
        r = TailReader({"path": str(tmp_path / "f"), "chunk": "3"})
        first = r.latestOffset()
        lines = [x for p in r.partitions({}, first) for _, _, x in r.read(p)]
        (tmp_path / "f").write_bytes(data)
        second = r.latestOffset()
        lines += [x for p in r.partitions(json.loads(json.dumps(first)), second) for _, _, x in r.read(p)]
        assert lines == ["é1", "😀😀", "", "last"] and r.partitions(second, r.latestOffset()) == []


@pytest.fixture
def tailed(spark, tmp_path):
    ready()
    spark.dataSource.register(TailSource)
    (tmp_path / "in").mkdir()

    def run(**options):
        rows = spark.readStream.format("tail").option("path", str(tmp_path / "in")).options(**options).load()
        q = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        q.trigger(availableNow=True).start().awaitTermination()
        return sorted(r.line for r in spark.read.parquet(str(tmp_path / "out")).collect())

    return tmp_path / "in", run


def test_a_stream_over_appends_and_rewrites(tailed):
    home, run = tailed
    (home / "a").write_text("a1\na2\nhal")
    assert run() == ["a1", "a2"]
    with (home / "a").open("a") as f:
        f.write("f\na4\n")
    (home / "b").write_text("b1\n")
    assert run() == ["a1", "a2", "a4", "b1", "half"]
    (home / "a").write_text("new\n")  # shorter: rewritten
    assert run() == ["a1", "a2", "a4", "b1", "half", "new"]
    (home / "b").write_text("other and longer\nb2")  # other first bytes
    assert run() == ["a1", "a2", "a4", "b1", "half", "new", "other and longer"]
    assert run(drain="true") == ["a1", "a2", "a4", "b1", "b2", "half", "new", "other and longer"]


def test_a_watcher_sees_each_phase_once():
    fold, watch = stateful.TraceFold(1000), stateful.Watch()
    fold.init(Handle())
    watch.init(Handle())
    batches = [
        [event(1, "trace_start", agent_name="a"), event(2, "step_start", 1, name="x", step_type="tool_call")], [event(5, "step_end", 1, model="m")],
        [event(6, "step_end", 1, output="o")], [event(7, "step_end", 1, output="again"), event(8, "step", 2, name="y", step_type="output", error="bad")],
    ]

    class Clock:
        getCurrentProcessingTimeInMs = staticmethod(lambda: 0)

    changes, seen = [], []
    for b in batches:
        new = [Row(**r.asDict()) for r in fold.handleInputRows(("t",), iter(b), Clock)]
        changes += new
        seen += watch.handleInputRows(("t",), iter(new), None)
    assert [(r.step_number, r.phase, r.name, r.error) for r in seen] == [(1, "begun", "x", None), (1, "done", "x", None), (2, "begun", "y", "bad"), (2, "done", "y", "bad")]
    assert list(watch.handleInputRows(("t",), iter(changes), None)) == [] and len(kept(changes)) == 3
