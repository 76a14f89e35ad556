"""Lists read by ranges, held against the json module."""

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.sources import json_list, readers


def _text(draw):
    return "".join(draw.choice(['"', "\\", "}", "{", "[", "]", ",", "\n", "é", "🙂", "a", " ", '\\"', "},{", '"},{"']) for _ in range(draw.randint(0, 40)))


def _value(draw, deep=0):
    kind = draw.randint(0, 6 if deep < 3 else 3)
    if kind < 2:
        return _text(draw)
    if kind < 4:
        return draw.choice([1, -2.5, None, True, "", 0])
    if kind < 5:
        return [_value(draw, deep + 1) for _ in range(draw.randint(0, 4))]
    return {_text(draw) + str(k): _value(draw, deep + 1) for k in range(draw.randint(0, 4))}


@pytest.fixture
def split(spark):
    def set_to(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))

    yield set_to
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def _read(spark, path):
    return [json.loads(r["text"]) for r in json_list.items(spark, str(path)).orderBy("index").collect()]


@pytest.mark.parametrize("seed", range(4))
def test_any_cut_gives_the_same_items(spark, tmp_path, split, seed):
    draw = random.Random(seed)
    wanted = [_value(draw) for _ in range(20)]
    path = tmp_path / "list.json"
    path.write_text(" " * draw.randint(0, 3) + json.dumps(wanted, ensure_ascii=seed % 2 == 0, indent=draw.choice([None, 1])) + "\n" * draw.randint(0, 2), "utf-8")
    for size in (draw.randint(100, 300), draw.randint(500, 3000)):
        split(size)
        found = json_list.items(spark, str(path)).orderBy("index").collect()
        assert [r["index"] for r in found] == list(range(len(wanted)))
        assert [json.loads(r["text"]) for r in found] == wanted


def test_states_compose():
    """Reading on from any cut, with a text open or not, is reading the whole."""
    draw = random.Random(7)
    text = json.dumps([_value(draw) for _ in range(30)])
    whole = json_list.read_on(text, False)
    for at in range(1, len(text)):
        if text[at - 1] == "}":
            inside, depth = json_list.read_on(text[:at], False)
            after, deeper = json_list.read_on(text[at:], inside)
            assert (after, depth + deeper) == whole


def test_items_longer_than_ranges(spark, tmp_path, split):
    wanted = [{"id": k, "text": "word } \" \\ " * 400} for k in range(5)] + ["x" * 3000, []]
    path = tmp_path / "long.json"
    path.write_text(json.dumps(wanted))
    split(700)
    assert _read(spark, path) == wanted


def test_small_lists_and_what_is_none(spark, tmp_path):
    path = tmp_path / "a.json"
    for text, wanted in (("[]", []), (" [ ] \n", []), ("[1]", [1]), ('["}"]', ["}"]), ("[{}]", [{}]), ("[[],{}]\n", [[], {}]), ("﻿[1, 2]", [1, 2])):
        path.write_text(text, "utf-8")
        assert _read(spark, path) == wanted, text
    for text in ("", "  ", "{}", '{"a": [1]}', "1", '"[1]"', "[1", '[{"a": 1}', '["open', "[1] [2]", "[1] x", "[{}]{}"):
        path.write_text(text)
        with pytest.raises(Exception, match="JSON list|text follows"):
            _read(spark, path)


def test_several_files_follow_one_another(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part-{k}.json").write_text(json.dumps([k * 10 + j for j in range(4)]))
    assert _read(spark, tmp_path) == [0, 1, 2, 3, 10, 11, 12, 13, 20, 21, 22, 23]


def test_trajectories_are_the_same_by_any_split(spark, tmp_path, split):
    draw = random.Random(3)
    path = tmp_path / "source.json"
    path.write_text(json.dumps([{"id": f"t{k}", "filename": f"F{k % 4}", "level": "Hard", "messages": [{"role": "user", "content": _text(draw) + "q"}, {"role": "assistant", "content": draw.choice([_text(draw), 5, None])}]} for k in range(50)]))
    frames = []
    for size in (500, 1 << 20):
        split(size)
        frames.append([r.asDict(True) for r in readers.trajectories(spark, str(path)).orderBy("index").collect()])
    assert frames[0] == frames[1] and len(frames[0]) == 50


def test_many_tasks_read(spark, tmp_path, split):
    path = tmp_path / "wide.json"
    path.write_text(json.dumps([{"id": k, "text": "some words of a text " * 20} for k in range(400)]))
    split(20_000)
    pieces = json_list._pieces(spark, str(path))
    assert pieces.rdd.getNumPartitions() >= 8 and pieces.select(F.spark_partition_id()).distinct().count() >= 8
    assert len(_read(spark, path)) == 400
