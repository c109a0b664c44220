"""Shard files: round trips, restarts, damaged files and empty tables."""

import itertools

import pytest
from pyspark.sql import functions as F

from keyloom.llm import ordering, shards
from keyloom.llm.common import store


@pytest.fixture(scope="module")
def order(spark):
    docs = spark.createDataFrame([(i if i % 9 else None, None if i % 11 == 0 else f"text {i} " * (i % 40)) for i in range(120)] + [(5, "same")] * 3,
                                 "doc_id long, text string")
    return store(ordering.training_order(docs, length=16, records=32))


def plain(rows):
    return [(s, d, q, list(map(int, ids))) for s, d, q, ids in rows]


def test_files_hold_what_the_table_holds(spark, order, tmp_path):
    path = str(tmp_path / "order")
    manifest = shards.write_shards(order.withColumns({"file": F.lit(1), "bytes": F.lit("x")}), path)
    total = manifest.agg(F.sum("n_records")).first()[0]
    want = sorted(tuple(r) for r in ordering.read_slots(order, 0, total).collect())
    assert total == len(want) > 100 and sorted(f.name for f in (tmp_path / "order").glob("*.bin")) == sorted(r["file"] for r in manifest.collect())
    assert sorted(tuple(r) for r in shards.read_files(spark, path).collect()) == want
    for start, stop in ((0, 1), (31, 33), (40, total), (total - 1, total), (total, None)):
        assert sorted(tuple(r) for r in shards.read_files(spark, path, start, stop).collect()) == want[start:stop]
    full = plain(shards.iterate(path))
    assert full == plain(want)
    for start in (0, 1, 32, 77, total - 1, total):
        assert plain(itertools.islice(shards.iterate(path, start), 50)) == full[start:start + 50]
    assert shards.verify(spark, path).collect() == []
    with pytest.raises(ValueError):
        shards.write_shards(order, path)


def test_damage_is_found_and_an_unfinished_write_is_done_again(spark, order, tmp_path):
    path = tmp_path / "order"
    path.mkdir()
    (path / "shard-0000000000.bin").write_bytes(b"half")  # left by a write without a manifest
    shards.write_shards(order, str(path))
    assert shards.verify(spark, str(path)).collect() == []
    files = sorted(path.glob("*.bin"))
    files[0].write_bytes(files[0].read_bytes()[:-1])
    files[1].write_bytes(b"\x01" + files[1].read_bytes()[1:])
    files[2].unlink()
    assert {tuple(r) for r in shards.verify(spark, str(path)).collect()} == {(files[0].name, "size"), (files[1].name, "digest"), (files[2].name, "missing")}
    with pytest.raises(ValueError):
        list(shards.iterate(str(path)))


def test_empty_order(spark, order, tmp_path):
    path = str(tmp_path / "none")
    assert shards.write_shards(order.filter("false"), path).count() == 0
    assert shards.read_files(spark, path).collect() == [] == list(shards.iterate(path)) and shards.verify(spark, path).collect() == []
