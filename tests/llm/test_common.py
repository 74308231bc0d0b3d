import os
import random
from collections import defaultdict

from pyspark.sql import functions as F

from scriptorium.llm import common


def test_numbered(spark):
    rng = random.Random(1)
    rows = [(None if rng.random() < 0.2 else rng.choice([1, 1, 1, 1, 2]), rng.choice([None, *range(30)]), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g long, o long, i long").repartition(6)
    got = common.numbered(df, ["g"], ["o"], "n").collect()
    of = defaultdict(list)
    for r in got:
        of[r.g].append((r.n, -1 if r.o is None else r.o))
    assert len(got) == 2000
    for group in of.values():
        group.sort()
        assert [n for n, _ in group] == list(range(1, len(group) + 1))
        assert [o for _, o in group] == sorted(o for _, o in group)
    assert common.numbered(df.where("false"), ["g"], ["o"], "n").count() == 0


def test_scratch_folder(spark, tmp_path, monkeypatch):
    assert common.scratch_dir(spark)
    monkeypatch.setattr(common, "scratch_dir", lambda _: str(tmp_path))
    kept = common.materialize(spark.range(5).withColumn("t", F.lit("x")), "some")
    assert kept.count() == 5
    assert any(p.name.startswith("some-") for p in tmp_path.iterdir())


def test_broadcast_only_if_small(spark):
    small, large = (common.broadcast_if_small(spark.range(n), 10 * 24) for n in (10, 11))  # a long and the row itself
    join = lambda side: spark.range(100).join(side, "id")._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in join(small).lower()
    assert "broadcast" not in join(large).lower()


def test_words(spark):
    row = spark.createDataFrame([("A é\t\nB\u00a0c",)], "t string").select(common.words(F.col("t")), common.ascii_lower(F.lit("ÀAbZ"))).first()
    assert row[0] == ["A", "é", "B\u00a0c"]
    assert row[1] == "Àabz"


def test_latest_deletes_the_round_before(spark, tmp_path):
    rounds = common.Latest("round")
    one = rounds.put(spark.range(5))
    first = rounds.path.removeprefix("file:")
    two = rounds.put(one.where("id > 2"))
    assert sorted(r.id for r in two.collect()) == [3, 4]
    assert not os.path.exists(first) and os.path.exists(rounds.path.removeprefix("file:"))
