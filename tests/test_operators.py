import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.functions import transforms
from millrace.operators import metrics, scoring, sharding, statistics, updates, vectors
from millrace.plans.features import FeaturePlan, Step
from millrace.sources import readers
from millrace.streaming import keyed_state


def test_statistics(spark):
    df = spark.createDataFrame([(34, "a"), (54, "b"), (42, "a"), (49, None)], "age bigint, s string")
    found = statistics.analyse(df, ["age"], 4, distinct=["s"])
    assert (found["age"].minimum, found["age"].maximum, found["age"].mean) == (34, 54, 44.75)
    assert found["age"].deviation**2 == pytest.approx(56.6875) and found["s"].distinct == 2
    assert statistics.ordered_vocabulary(df, "s") == ["a", "b"] and statistics.ordered_vocabulary(df, "s", 2) == ["a"]
    assert statistics.load(statistics.save(found))["age"] == found["age"]
    env = statistics.FeatureStats.from_environment("age", {"_age_min": "11", "_age_boundaries": "67,15,89,15"}, found["age"])
    assert env.minimum == 11 and env.boundaries == [15, 67, 89] and env.maximum == 54
    with pytest.raises(ValueError):
        statistics.ordered_vocabulary(df, "s", most=1)


def test_sharding(spark):
    sizes = spark.createDataFrame([("f1", 0, 10), ("f2", 0, 10), ("none", 0, 0)], "name string, start bigint, count bigint")
    shards = sharding.cut(sizes, 3).orderBy("name", "start")
    rows = [tuple(r) for r in shards.collect()]
    assert len(rows) == 8 and rows[3] == ("f1", 9, 10) and rows[7] == ("f2", 9, 10)
    assert sharding.epochs(shards, 2, seed=3).count() == 16 and sharding.epochs(shards, 0).count() == 0
    assert sharding.until_step(shards, 3, 2, ["name", "start"]).count() == 3
    blocks = spark.createDataFrame([("a", 100), ("b", 100), ("c", 100)], "name string, count bigint")
    assert sorted(map(tuple, sharding.ranges_of_files(blocks, 50, 200).collect())) == [("a", 50, 50), ("b", 0, 100)]
    numbers = sharding.row_numbers(spark.range(1000).repartition(7), ["id"])
    assert numbers.where("id <> row").count() == 0
    assert sharding.systematic_split(spark.range(100), ["id"]).where("evaluation").count() == 5
    assert sharding.batches_an_epoch(10, 3) == 3


def test_row_numbers_of_wide_tables_in_many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        df = spark.range(50_000).select((F.col("id") * 7919 % 50_021).alias("k"), F.col("id").cast("string").alias("a"), F.array("id", "id").alias("b"), (F.col("id") % 3).alias("c"))
        rows = sharding.row_numbers(df, ["k"])
        assert rows.columns == ["k", "a", "b", "c", "row"]
        found = rows.select("k", "row").collect()
        assert [r.row for r in sorted(found)] == list(range(50_000))
        split = sharding.systematic_split(df, ["k"])
        assert split.count() == 50_000 and split.where("evaluation").count() == 2_500
        assert readers.ordered_split(df, ["k"]).where("training").count() == 37_500
        assert readers.row_range(df, ["k"], 100, 170).count() == 70
        ties = sharding.running_sums(df, ["c"], {"n_before": None, "c_before": "c"}).groupBy("c").agg(F.min("n_before"), F.max("n_before"), F.max("c_before")).orderBy("c").collect()
        assert ties[0][1] == 0 and ties[1][1] == ties[0][2] + 1 and ties[2][2] == 49_999 and ties[1][3] == ties[1][2] - ties[1][1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sharding.row_numbers(spark.range(0), ["id"]).count() == 0


def test_percentiles_and_auc_are_exact(spark):
    import random

    import numpy as np

    rng = random.Random(1)
    values = [rng.choice([rng.random(), round(rng.random(), 1), None]) for _ in range(997)]
    df = spark.createDataFrame([(v, i % 2) for i, v in enumerate(values)], "x double, y int")
    known = [v for v in values if v is not None]
    for n in (2, 3, 10, 37):
        assert statistics.percentiles(df, "x", n) == pytest.approx(list(np.percentile(known, [100 * k / n for k in range(1, n)])))
    assert statistics.percentiles(df.where("x > 2"), "x", 4) == [] and statistics.percentiles(df, "x", 4, approximate=True)
    pairs = [(v, i % 2) for i, v in enumerate(values) if v is not None]
    pos, neg = [v for v, y in pairs if y], [v for v, y in pairs if not y]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    assert metrics.exact_auc(df.where("x IS NOT NULL"), "x", "y").first().auc == pytest.approx(want)
    out = metrics.nested(df.where("x IS NOT NULL"), {"a": {"m": metrics.accuracy(F.col("x"), F.col("y"))}}).first()
    assert 0 <= out.a.m <= 1


def test_manifests_and_shuffles(spark):
    tasks = sharding.manifest(1050, 100, 5, spark).orderBy("start").collect()
    assert [(r.start, r.end) for r in tasks] == [(0, 500), (500, 1000), (1000, 1050)]
    with pytest.raises(ValueError):
        sharding.manifest(0, 1, 1, spark)
    each = sharding.shuffled(spark.range(50), 2, 9, ["id"]).collect()
    orders = [[r.id for r in sorted((r for r in each if r.epoch == e), key=lambda r: r.place)] for e in (0, 1)]
    assert sorted(orders[0]) == sorted(orders[1]) == list(range(50)) and orders[0] != orders[1] and orders[0] != sorted(orders[0])


def test_pooling_and_masks(spark, vector_table):
    rows = spark.createDataFrame([(0, [1, 3], [2]), (1, [], None), (2, [9, -1], [1, 1])], "key int, a array<bigint>, b array<bigint>")
    got = {r.key: (r.a, r.b) for r in vectors.pooled(rows, {"a": vector_table, "b": vector_table}, 2).collect()}
    assert got == {0: ([4, 4], [2, 2]), 1: ([0, 0], [0, 0]), 2: ([0, 0], [2, 2])}
    assert rows.select(vectors.mask(F.col("a")).alias("m")).first().m == [True, True]
    ids = spark.createDataFrame([(0, [0, 1, 3])], "key int, ids array<bigint>")
    assert vectors.combine(ids, vector_table, 2, "mean", zero_is_missing=True).first().vec == [2, 2]


def test_gradients_are_checked(spark):
    g = spark.createDataFrame([("a", [1.0]), ("b", [1.0]), ("c", [1.0]), ("a", None)], "name string, vec array<double>")
    assert [r.f for r in g.select(updates.gradient_fault({"a": 1, "b": 2}).alias("f")).collect()] == [None, "width", "name", "width"]
    assert updates.checked(g.limit(1), {"a": 1, "b": 2}).count() == 1
    with pytest.raises(Exception, match="wrong in its width"):
        updates.checked(g.where("name = 'b'"), {"a": 1, "b": 2}).count()
    versions = spark.createDataFrame([(1,), (2,), (3,)], "version int")
    assert updates.newer(versions, 2).count() == 1 and updates.newer(versions, 2, inclusive=True).count() == 2


def test_plugins_and_scoring(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "a double, b double")
    assert [r.score for r in scoring.score(df, scoring.find("predictor", "linear")([2.0, 1.0], 0.5), ["a", "b"]).collect()] == [4.5, 10.5]
    with pytest.raises(ValueError):
        scoring.find("predictor", "nothing")
    with pytest.raises(ValueError):
        scoring.plugin("predictor", "linear")(len)
    assert df.agg(scoring.average(F.col("a") > 2).alias("m")).first().m == 0.5


def test_sinks(spark, tmp_path):
    df = spark.range(10).select("id", (F.col("id") % 2).alias("worker_of"))
    spark.sql("DROP TABLE IF EXISTS sink_table")
    readers.write_table(df.select("id"), "sink_table", F.col("id") % 2)
    readers.write_table(df.select("id"), "sink_table", F.col("id") % 2)
    assert spark.table("sink_table").where("worker = 1").count() == 10
    assert readers.open_source(spark, "sink_table", columns=["id"], partition={"worker": 0}).count() == 10
    spark.sql("DROP TABLE sink_table")
    readers.write_shards(df.coalesce(1), str(tmp_path / "shards"), 3)
    assert len(list((tmp_path / "shards").glob("part-*"))) == 4
    folder = tmp_path / "delivered"
    folder.mkdir()
    scoring.deliver(df.repartition(3), lambda part, rows: (folder / str(part)).write_text("".join(f"{r.id}\n" for r in rows)))
    assert sorted(int(x) for f in folder.iterdir() for x in f.read_text().split()) == list(range(10))


def test_images_and_generators(spark, tmp_path):
    for name in ("cat/1.bin", "dog/2.bin"):
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_bytes(name.encode())
    got = {(r["class"], bytes(r.content)) for r in readers.open_source(spark, str(tmp_path), "images", glob="*.bin").collect()}
    assert got == {("cat", b"cat/1.bin"), ("dog", b"dog/2.bin")}
    df = spark.createDataFrame([(i, [[i, 1], [2, 3]]) for i in range(9)], "id int, image array<array<int>>")
    flat = readers.flatten_images(readers.first_share(df, ["id"], 0.5), "image")
    assert [r.image for r in flat.orderBy("id").collect()] == [[float(i), 1, 2, 3] for i in range(4)]
    rows = readers.tuples(spark, lambda part: ((part, "x" * k) for k in range(part)), 4, "a int, b string")
    assert sorted(map(tuple, rows.collect())) == [(p, "x" * k) for p in range(4) for k in range(p)]


def test_plans_expand_and_skip(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "n int, s string")
    plan = FeaturePlan([Step("e", "embed", ["s"], {"dim": 4}), Step("i", "round_identity", ["n"], {"bins": 5}), Step("direct", "embed", ["i"], {"dim": 4})]).fit(df)
    assert [s.name for s in plan.order()] == ["e_hash", "e", "i", "direct"]
    ids = plan.apply(df, ["e", "direct"]).collect()
    assert ids[0].e == ids[2].e < 6 and [r.direct for r in ids] == [1, 2, 3]
    known, gone = FeaturePlan([Step("g", "group", ["i", "l"]), Step("i", "round_identity", ["n"], {"bins": 5}), Step("l", "lookup", ["gone"])]).known(df.columns)
    assert gone == ["l"] and [r.g for r in known.fit(df).apply(df, ["g"]).collect()] == [[1], [2], [3]]


def test_environment_names_a_vocabulary(spark, tmp_path):
    (tmp_path / "v.txt").write_text(" b \na\n")
    stats = statistics.FeatureStats.from_environment("c", {"_c_vocab": str(tmp_path / "v.txt")})
    terms = transforms.terms_of(spark, stats.vocabulary_path)
    assert terms == ["b", "a"] and stats.minimum is None
    (tmp_path / "w.txt").write_text("a\na \n")
    with pytest.raises(ValueError):
        transforms.terms_of(spark, str(tmp_path / "w.txt"))


@pytest.fixture(scope="module")
def vector_table(spark):
    return spark.createDataFrame([(i, [float(i)] * 2) for i in range(4)], "id bigint, vec array<double>")


def test_combiners(spark, vector_table):
    rows = spark.createDataFrame([(0, [1]), (1, [1, 3]), (2, [2]), (3, [0, 2, 2]), (4, []), (5, [-1]), (6, None)], "key int, ids array<bigint>")
    want = {"sum": [1, 4, 2, 4, 0, 0, 0], "mean": [1, 2, 2, 4 / 3, 0, 0, 0], "sqrtn": [1, 4 / 2**0.5, 2, 4 / 3**0.5, 0, 0, 0]}
    for how, expected in want.items():
        got = [r.vec for r in vectors.combine(rows, vector_table, 2, how).orderBy("key").collect()]
        assert got == [pytest.approx([x, x]) for x in expected]
    weighted = spark.createDataFrame([(0, [1, 3], [2.0, 0.5])], "key int, ids array<bigint>, w array<double>")
    assert vectors.combine(weighted, vector_table, 2, "mean", weights="w").first().vec == pytest.approx([3.5 / 2.5] * 2)
    with pytest.raises(ValueError):
        vectors.combine(rows, vector_table, 2, "max")


def test_lookup_keeps_order(spark, vector_table):
    rows = spark.createDataFrame([(0, [3, 1, 3, 9])], "key int, ids array<bigint>")
    assert vectors.lookup(rows, vector_table, 2).first().vecs == [[3, 3], [1, 1], [3, 3], [0, 0]]
    uniform = vectors.lookup(rows, vector_table, 2, missing=vectors.initial("uniform", 2)).first().vecs[3]
    assert all(-0.05 <= x <= 0.05 for x in uniform) and uniform[0] != uniform[1]
    many = spark.range(2000).select("id", vectors.initial("truncated_normal", 1, deviation=1.0)[0].alias("x")).agg(F.min("x"), F.max("x"), F.avg("x")).first()
    assert -2 <= many[0] and many[1] <= 2 and abs(many[2]) < 0.1
    with pytest.raises(Exception, match="not below"):
        vectors.check_ids(rows, 9).collect()
    assert vectors.check_ids(rows, 10).count() == 1


def _numbers(x):
    return [n for v in x for n in _numbers(v)] if isinstance(x, list | tuple) else [x]


def test_few_vectors_are_held_and_none_is_shuffled(spark, vector_table):
    """The result by rows equals that by joins, with nulls, ids that come twice and more ids than a slice has."""
    rows = spark.createDataFrame([(0, [3, 1, None, 3, 9]), (1, [2]), (2, []), (3, None), (4, [-1, 0]), (5, [k % 5 - 1 for k in range(40_000)])], "key int, ids array<bigint>")
    rows = rows.withColumn("w", F.transform("ids", lambda i: F.when(i != 2, i * 0.5 + 1)))
    twice = vector_table.unionByName(vector_table)
    made = {
        "lookup": lambda t, most: vectors.lookup(rows, t, 2, most_bytes=most),
        "sum": lambda t, most: vectors.combine(rows, t, 2, "sum", most_bytes=most),
        "mean": lambda t, most: vectors.combine(rows, t, 2, "mean", zero_is_missing=True, most_bytes=most),
        "weighted": lambda t, most: vectors.combine(rows, t, 2, "sqrtn", weights="w", most_bytes=most),
        "pooled": lambda t, most: vectors.pooled(rows.withColumn("b", F.slice("ids", 1, 2)), {"ids": t, "b": t}, 2, "mean", most_bytes=most),
        "fm": lambda t, most: vectors.fm_second_order(rows, t, 2, most_bytes=most),
    }
    for name, make in made.items():
        for t in (vector_table, twice) if name in ("sum", "pooled") else (vector_table,):
            held, joined = (sorted(map(tuple, make(t, most).collect())) for most in (1 << 20, 0))
            assert [_numbers(r) for r in held] == [pytest.approx(_numbers(r)) for r in joined], name
        plan = make(vector_table, 1 << 20)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Exchange" in make(vector_table, 0)._jdf.queryExecution().executedPlan().toString()


def test_merge_scatter_upsert_dense(spark, vector_table):
    more = spark.createDataFrame([(1, [5.0, 5.0]), (1, [1.0, 1.0]), (7, [2.0, 2.0])], "id bigint, vec array<double>")
    merged = vectors.merge(vector_table, more)
    assert merged.count() == 7 and {r.id: r.vec[0] for r in vectors.deduplicate(merged, 2).collect()} == {0: 0, 1: 7, 2: 2, 3: 3, 7: 2}
    dealt = vectors.scatter(vector_table, 3)
    assert Counter(map(str, dealt.drop("bucket").collect())) == Counter(map(str, vector_table.collect()))
    changed = vectors.upsert(vector_table, more.withColumn("at", F.col("vec")[0]), "at")
    assert {r.id: r.vec[0] for r in changed.collect()} == {0: 0, 1: 5, 2: 2, 3: 3, 7: 2}
    assert [r.vec[0] for r in vectors.dense(vector_table, 6, 2).orderBy("id").collect()] == [0, 1, 2, 3, 0, 0]
    assert vectors.replicated(1000, 8) and not vectors.replicated(1_000_000, 8)


def reference_step(kind, p, g, o, state, at):
    if kind == "sgd":
        return p - o.lr * g
    if kind == "momentum":
        state["v"] = o.momentum * state.get("v", 0) + g
        return p - o.lr * (g + o.momentum * state["v"] if o.nesterov else state["v"])
    if kind == "adagrad":
        state["a"] = state.get("a", o.initial_accumulator) + g * g
        return p - o.lr * g / (state["a"] ** 0.5 + o.epsilon)
    state["m"] = o.beta_1 * state.get("m", 0) + (1 - o.beta_1) * g
    state["v"] = o.beta_2 * state.get("v", 0) + (1 - o.beta_2) * g * g
    state["x"] = max(state.get("x", 0), state["v"])
    top = state["x"] if o.amsgrad else state["v"]
    return p - o.lr * (1 - o.beta_2**at) ** 0.5 / (1 - o.beta_1**at) * state["m"] / (top**0.5 + o.epsilon)


@pytest.mark.parametrize("o", [updates.Optimizer("sgd"), updates.Optimizer("momentum"), updates.Optimizer("momentum", nesterov=True), updates.Optimizer("adagrad"), updates.Optimizer("adam"), updates.Optimizer("adam", amsgrad=True)])
def test_optimizer_steps(spark, vector_table, o):
    table, p, state = vector_table, 3.0, {}
    for at, (a, b) in enumerate([(0.5, 1.0), (-2.0, 0.25)], 1):
        gradients = spark.createDataFrame([(3, [a, a]), (3, [b, b])], "id bigint, vec array<double>")  # repeated ids are summed first
        table = updates.step(table, gradients, o, 2, at)
        p = reference_step(o.kind, p, a + b, o, state, at)
    rows = {r.id: r.vec for r in table.collect()}
    assert rows[3] == pytest.approx([p, p]) and rows[1] == [1, 1]


def test_optimizer_parameters():
    assert updates.Optimizer.from_text("adam", "lr=0.5;amsgrad=True") == updates.Optimizer("adam", 0.5, amsgrad=True)
    for wrong in ("rate=1", "kind=sgd"):
        with pytest.raises(ValueError):
            updates.Optimizer.from_text("sgd", wrong)
    with pytest.raises(ValueError):
        updates.Optimizer("other").slots  # noqa: B018


def test_checkpoints_are_dealt_anew(spark, vector_table, tmp_path):
    path = str(tmp_path / "model")
    for version in (1, 2, 3):
        updates.save(vector_table, path, version, shards=2, keep=2)
    (tmp_path / "model" / "version=9").mkdir()
    assert updates.versions(spark, path) == [2, 3]
    restored = updates.restore(spark, path, 3)
    assert {r.id: r.shard for r in restored.collect()} == {0: 0, 1: 1, 2: 2, 3: 0}
    with pytest.raises(ValueError):
        updates.restore(spark, path, 3, 1)


def test_stream_of_gradients(spark, vector_table, tmp_path):
    path, source = str(tmp_path / "model"), str(tmp_path / "in")
    updates.save(vector_table, path, 0)
    gradients = spark.createDataFrame([(1, [1.0, 1.0]), (1, [1.0, 1.0])], "id bigint, vec array<double>").coalesce(1)
    gradients.write.parquet(source)
    stream = keyed_state.file_stream(spark, source, gradients.schema)
    keyed_state.apply_gradients(stream, path, updates.Optimizer("sgd", 0.25), 2, str(tmp_path / "ck")).awaitTermination()
    assert {r.id: r.vec[0] for r in updates.restore(spark, path, 1).collect()}[1] == 0.5


def test_metrics(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.3, 1), (0.1, 0), (0.2, 0)], "p double, y int")
    assert metrics.evaluate(df, {"a": metrics.accuracy(F.col("p"), F.col("y"))}).first().a == pytest.approx(0.6)
    assert metrics.exact_auc(df, "p", "y").first().auc == pytest.approx(5 / 6)
    assert metrics.auc(df, "p", "y").first().auc == pytest.approx(5 / 6)
    with pytest.raises(ValueError):
        metrics.evaluate(df, {})


def test_feature_plan(spark):
    df = spark.createDataFrame([(1, "a", 10.0), (2, "b", 20.0), (3, "a", 30.0), (4, None, None)], "i int, s string, x double")
    plan = FeaturePlan([Step("ids", "group", ["word", "size"]), Step("word", "lookup", ["s"]), Step("size", "bucketize", ["x"], {"buckets": 2}), Step("z", "standardize", ["x"])]).fit(df)
    again = FeaturePlan.from_json(plan.to_json())
    assert json.loads(again.to_json()) == json.loads(plan.to_json())
    rows = again.apply(df, ["ids", "z"], ["i"]).orderBy("i").collect()
    assert [r.ids for r in rows] == [[0, 3], [1, 4], [0, 4], []] and rows[1].z == 0
    for wrong in ([Step("a", "numeric", ["b"]), Step("b", "numeric", ["a"])], [Step("a", "numeric", ["x"])] * 2):
        with pytest.raises(ValueError):
            FeaturePlan(wrong).order()


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1, x\n2, y\n")
    assert [tuple(r) for r in readers.open_source(spark, str(tmp_path / "a.csv"), schema="i int, s string").orderBy("i").collect()] == [(1, "x"), (2, "y")]
    with pytest.raises(ValueError):
        readers.open_source(spark, str(tmp_path / "a.csv"))
    with pytest.raises(ValueError):
        readers.open_source(spark, "x", kind="nothing")
    (tmp_path / "b.tsv").write_text("1\t\t3\tq\t\n")
    assert tuple(readers.read_click_log(spark, str(tmp_path / "b.tsv"), 2, 2).first()) == (1, 0, 3, "q", "")
    (tmp_path / "c.libfm").write_text("1 u:1 i:2\n-1 u:1 i:3\n")
    parsed = readers.open_source(spark, str(tmp_path / "c.libfm")).withColumn("n", F.when(F.col("label") == 1, 0).otherwise(1))
    assert [(r.label, r.ids) for r in readers.encode_libfm(parsed, "n", 3).orderBy("n").collect()] == [(1, [0, 1, 2]), (0, [0, 1, 3])]
    assert readers.parse_options("a=1;b=x;c=[1, 2];") == {"a": 1, "b": "x", "c": [1, 2]}
    readers.write_shards(spark.range(10).coalesce(1), str(tmp_path / "s"), 4)
    assert len(list((tmp_path / "s").glob("part-*"))) == 3
    assert readers.open_source(spark, str(tmp_path / "s"), columns=["id"]).count() == 10
    assert readers.ordered_split(spark.range(8), ["id"]).where("training").count() == 6
    assert sorted(r.id for r in readers.row_range(spark.range(10), ["id"], 3, 5).collect()) == [3, 4]
    with pytest.raises(ValueError):
        readers.features_and_label(spark.range(1), ["id"], "label")
    assert readers.features_and_label(spark.range(1), ["id"], predicting=True).columns == ["features"]
    census = spark.createDataFrame([("<=50K", 1), (">50K.", 2), (">50K", None)], "label string, a int")
    assert [r.label for r in readers.census_rows(census).orderBy("a").collect()] == [0, 1]
