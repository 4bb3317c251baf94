import json
import random

import pytest
from pyspark.sql import functions as F

from watchfire.sources.arrays import read_array_items
from watchfire.sources.normalize import read_array_documents


@pytest.fixture(params=[60, 257, 10**8])
def ranges(spark, request):
    """Files are read in ranges of so many bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in zip(names, (request.param, 0, 1)):
        spark.conf.set(n, str(v))
    yield request.param
    for n, v in before.items():
        spark.conf.set(n, v) if v is not None else spark.conf.unset(n)


def texts():
    rng = random.Random(3)
    odd = ['}', '{', ']', '[', ',', '"', "\\", 'a"b', "x\\\"y", "é€😀", "\n", "}, {", "\\\\", ""]

    def value(depth=0):
        kind = rng.randrange(7 if depth < 3 else 4)
        if kind < 3:
            return "".join(rng.choice(odd + ["word", " "]) for _ in range(rng.randrange(6)))
        return rng.randrange(10**6) if kind == 3 else [value(depth + 1) for _ in range(rng.randrange(3))] if kind == 4 else {rng.choice(odd) + str(i): value(depth + 1) for i in range(rng.randrange(4))}

    for i in range(6):
        yield f"good{i}", json.dumps([rng.choice([value(2), {"id": k, "v": value()}, {"id": k, "v": value()}]) for k in range(rng.choice([0, 1, 3, 40]))], indent=rng.choice([None, 2]), ensure_ascii=bool(i % 2))
    yield "long", json.dumps([{"id": 1, "text": "x}" * 900}, {"id": 2, "text": '"],[' * 200}, 7, "{\"a\": 1}", [{"b": 2}]])
    yield "blank", " \n[ ] \n"
    yield "nulls", "[null, {\"a\": null}, 1.5, true]"
    for i, bad in enumerate(['[{"a": 1}', '{"a": 1}', '[{"a": 1}}', '[{"a": 1},]', '[{"a": 1}] x', 'x [{"a": 1}]', '[{"a": 1} {"b": 2}]', '[{"a": }]', '[{"a": "open}]', "", "plain", '[{"a": 1}]]', '[{"a": 1}][{"b": 2}]', '[{"a": 1]', '[{"a": 1}]}']):
        yield f"bad{i}", bad + " " * (i % 2)


def test_ranges_give_what_whole_files_give(spark, tmp_path, ranges):
    for name, text in texts():
        (tmp_path / name).write_text(text, encoding="utf-8")
    pick = lambda df: sorted((r.file.rsplit("/", 1)[1], r.line or "", r.problem or "") for r in df.collect())
    got, want = pick(read_array_items(spark, str(tmp_path))), pick(read_array_documents(spark, str(tmp_path)))
    # A text source has no row for an empty file.
    trailing = {"bad4", "bad11", "bad12", "bad14"}
    for name in {n for n, _ in texts()} - trailing - {"bad9"}:
        assert [r for r in got if r[0] == name] == [r for r in want if r[0] == name], name
    # What follows the array is a fault here, whether or not a parser of the whole text sees it.
    assert {r for r in got if r[0] in trailing} == {(n, "", "malformed JSON array") for n in trailing}


def test_one_large_file_is_many_tasks(spark, tmp_path):
    items = [{"id": i, "text": "word } , { " * (i % 7)} for i in range(5000)]
    (tmp_path / "a.json").write_text(json.dumps(items))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        from watchfire.sources import arrays

        assert arrays._fragments(spark, str(tmp_path)).rdd.getNumPartitions() > 8
        got = read_array_items(spark, str(tmp_path)).select(F.get_json_object("line", "$.id").cast("int").alias("i"), F.get_json_object("line", "$.text").alias("t")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.i, r.t) for r in got) == [(x["id"], x["text"]) for x in items]
