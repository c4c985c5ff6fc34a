"""JSON arrays read in byte ranges: the same rows as from one task, wherever the borders fall."""

import json
import random

import pytest
from pyspark.sql import functions as F

from textprep.sources import files, json_splits

SCHEMA = "a string, b array<string>, c struct<d: string>"


def records(seed, n):
    draw = random.Random(seed)
    parts = ['"', "\\", "{", "}", "[", "]", "\\\"", "é漢🙂", ",", " ", "x", "\n", "\t", "},{", '"}', ":"]

    def text(most=12):
        return "".join(draw.choice(parts) for _ in range(draw.randrange(most)))

    return [{"a": text(400 if draw.random() < 0.02 else 12), "b": [text() for _ in range(draw.randrange(4))], "c": {"d": text()}} for _ in range(n)]


@pytest.fixture
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "700b")
    spark.conf.set(names[1], "0b")
    yield
    for name, value in zip(names, before):
        spark.conf.set(name, value)


def rows(df):
    return sorted((r["a"], tuple(r["b"] or ()), r["c"] and r["c"]["d"]) for r in df.collect())


@pytest.mark.parametrize("indent", [None, 1])
def test_same_rows_as_one_task(spark, small_ranges, tmp_path, indent):
    for k, n in enumerate((60, 1, 0)):
        text = json.dumps(records(k, n), ensure_ascii=k == 0, indent=indent)
        (tmp_path / f"{k}.json").write_text("  \n" * k + text + "\n", encoding="utf8")
    whole = spark.read.schema(SCHEMA).option("multiLine", True).json(str(tmp_path))
    split = files.read_json_array(spark, str(tmp_path), SCHEMA, split_above=0)
    assert rows(split) == rows(whole) and whole.count() == 61
    path = str(tmp_path / "0.json")
    ranges = spark.read.option("lineSep", "}").text(path).select("_metadata.file_block_start").distinct().count()
    assert ranges > 5


def test_a_record_over_many_ranges(spark, small_ranges, tmp_path):
    long = {"a": 'x{"' * 2_000, "b": ["}" * 3_000], "c": {"d": "end"}}
    (tmp_path / "long.json").write_text(json.dumps([{"a": "1"}, long, {"a": "2"}, long]))
    found = rows(files.read_json_array(spark, str(tmp_path), SCHEMA, split_above=0))
    assert found == sorted([("1", (), None), ("2", (), None), (long["a"], tuple(long["b"]), "end"), (long["a"], tuple(long["b"]), "end")])


def test_large_and_small_files_together(spark, tmp_path):
    data = [records(k, n) for k, n in ((1, 80), (2, 3))]
    for k, own in enumerate(data):
        (tmp_path / f"{k}.json").write_text(json.dumps(own))
    assert json_splits.large_files(spark, str(tmp_path), 1_500)[0].endswith("0.json")
    found = files.read_json_array(spark, str(tmp_path), SCHEMA, split_above=1_500)
    assert rows(found) == sorted((r["a"], tuple(r["b"]), r["c"]["d"]) for own in data for r in own)


def test_other_elements_and_one_object(spark, small_ranges, tmp_path):
    (tmp_path / "mixed.json").write_text('[1, "x{", [{"a": "inner"}], {"a": "own"}, null]')
    (tmp_path / "one.json").write_text(' {"a": "single", "c": {"d": "y"}}')
    (tmp_path / "cut.json").write_text('[{"a": "kept"}, {"a": "cut, {')
    texts = json_splits.array_records(spark, [str(tmp_path / f"{n}.json") for n in ("mixed", "one", "cut")])
    found = texts.select(F.from_json("text", SCHEMA).alias("r")).select("r.a").collect()
    assert sorted(r.a for r in found if r.a) == ["kept", "own", "single"]
