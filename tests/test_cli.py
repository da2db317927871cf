import pytest

from loamlog import cli
from loamlog.schemas import BoundaryCheck, InvalidRequest, InvalidSeqNums, UnknownPartition, UnknownTopic


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("store")
    go = lambda *a: [r.line for r in cli.run(spark, [str(base), *map(str, a)]).collect()]
    go("create_topic", "events", 2)
    go("produce", "events", 0, "a=1", "b=2", "a=3", "plain", "-K")
    go("produce", "events", 0, "x", "y", "-S", 10, "-a", 5)
    return go


def test_consume(run):
    assert run("consume", "events", 0, "beginning") == ["1", "2", "3", "plain", "x", "y"]
    assert run("consume", "events", 0, 2, "-l", 2, "-F", "key,content") == ["[b]: 2", "[a]: 3"]
    assert run("consume", "events", 0, 2, "-E", 10, "-K") == ["2 [b] = [2]", "3 [a] = [3]", "4 [] = [plain]", "10 [] = [x]"]
    assert run("consume", "events", 0, 0, "-f", "pla") == ["plain"]
    assert run("consume", "events", 0, 0, "-S") == ["6 messages, 61 bytes"]
    assert run("consume", "events", 0, "end") == []
    assert run("consume", "events", 0, 0, "-T", "T-1h") == run("consume", "events", 0, 0)
    assert run("consume", "events", 1, 0) == []


def test_faults(run):
    for fault, arguments in ((UnknownTopic, ("nope", 0, 0)), (UnknownPartition, ("events", 7, 0)), (BoundaryCheck, ("events", 0, 99)), (InvalidRequest, ("events", 0, 0, "-T", "soon"))):
        with pytest.raises(fault):
            run("consume", *arguments)
    with pytest.raises(InvalidSeqNums):
        run("produce", "events", 0, "z", "-S", 15)


def test_metadata(run):
    assert run("discover_partitions", "events") == ["0 1 15", "1 0 0"]
    assert run("discover_topics") == ["events enabled 2 1"]


def test_mirror_compact_and_export(run, spark, tmp_path):
    other = str(tmp_path / "other")
    cli.run(spark, [other, "create_topic", "events", "2"])
    assert run("mirror", other) == ["events 15"] == run("mirror", other)
    assert [r.line for r in cli.run(spark, [other, "consume", "events", "0", "0"]).collect()] == run("consume", "events", 0, 0)
    assert run("compact", str(tmp_path / "c")) == ["5 messages"]
    assert run("export", str(tmp_path / "s"), "--messages", 4) == run("verify", str(tmp_path / "s"))
    assert all(line.endswith("ok") for line in run("verify", str(tmp_path / "s")))


def test_lines_of_a_file(run, tmp_path):
    (tmp_path / "f").write_text("one\ntwo\nlast without an end")
    assert run("produce", "events", 1, "-f", tmp_path / "f") == ["last 3"]
    assert run("produce", "events", 1, "-F", tmp_path / "f") == ["last 4"]
    assert run("consume", "events", 1, 0)[:3] == ["one", "two", "last without an end"]
