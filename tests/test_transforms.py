import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import hashing, key_values, transforms


def values(spark, transform, items, kind="double"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r.y for r in df.select("i", transform(F.col("x")).alias("y")).orderBy("i").collect()]


def test_published_vectors(spark):
    assert values(spark, transforms.bucketize([1, 5, 10]), [0.2, 1.6, 4.2, 6.1, 10.9, 1.0, None, float("nan")]) == [0, 1, 1, 2, 3, 1, None, 3]
    assert values(spark, transforms.over(transforms.bucketize([1, 5, 10])), [[0.2, 1.6, 4.2], [6.1], []], "array<double>") == [[0, 1, 1], [2], []]
    assert values(spark, transforms.log_round(20, 0, 2.0), [0.0, 2.6, 0.2, 3.1, 1024.0, -1.0, float("inf"), None]) == [0, 1, 0, 2, 10, 0, 0, None]
    assert values(spark, transforms.round_identity(10), [1.2, 1.6, 0.2, 3.1, 4.9, 0.5, 2.5, 99.0, 1e300]) == [1, 2, 0, 3, 5, 0, 2, 0, 0]
    assert values(spark, transforms.normalizer(1.0, 2.0), [5.0, 7.0, 9.0, 11.0, 13.0]) == [2, 3, 4, 5, 6]
    assert values(spark, transforms.index_lookup(["A", "B", "C"]), ["A", "B", "C", "D", None], "string") == [0, 1, 2, 3, None]
    assert values(spark, transforms.to_number("int", -1), ["123", "", "456", "-789"], "string") == [123, -1, 456, -789]
    assert values(spark, hashing.hash_bucket(3), ["A", "B", "C", "D", "E", None], "string") == [1, 0, 1, 1, 2, None]
    assert values(spark, transforms.to_ragged(",", ""), ["1,2,3", "4,5", ""], "string") == [["1", "2", "3"], ["4", "5"], []]
    assert values(spark, transforms.to_ragged(None, -1), [[1], [-1], [4]], "array<int>") == [[1], [], [4]]
    assert [[tuple(s) for s in x] for x in values(spark, transforms.to_sparse(""), [["A", ""], ["B", "C"]], "array<string>")] == [[(0, "A")], [(0, "B"), (1, "C")]]
    assert values(spark, lambda c: hashing.string_partition(c, 7), ["dense/kernel:0"], "string") == [6]
    assert values(spark, lambda c: hashing.int_partition(c, 3), [-7, 7], "bigint") == [2, 1]


def test_concatenation_and_crossing(spark):
    df = spark.createDataFrame([([1], [2]), ([], [2]), ([1], None)], "a array<bigint>, b array<bigint>")
    out = [r.c for r in df.select(transforms.concat_with_offsets([F.col("a"), F.col("b")], [0, 10]).alias("c")).collect()]
    assert out == [[1, 12], [12], [1]]
    assert transforms.id_offsets([1024, 32]) == [0, 1024]
    hot = df.select(transforms.multi_hot(F.col("a"), 3).alias("h"), transforms.pad_left(F.col("a"), 3).alias("p")).first()
    assert hot.h == [0, 1, 0] and hot.p == [0, 0, 1]
    crossed = df.limit(1).select(transforms.cross([F.array(F.lit("x"), F.lit("y")), F.array(F.lit(1), F.lit(2))]).alias("c")).first().c
    assert crossed == ["x_X_1", "x_X_2", "y_X_1", "y_X_2"]


def test_wrong_parameters():
    for wrong in (lambda: transforms.normalizer(0, 0), lambda: transforms.index_lookup(["a", "a"]), lambda: transforms.to_number("string", 0), lambda: hashing.hash_bucket(0), lambda: transforms.concat_with_offsets([F.lit(1)], [1, 2])):
        with pytest.raises((ValueError, AssertionError)):
            wrong()


def test_bad_number_raises(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        values(spark, transforms.to_number("int", 0), ["x"], "string")
    assert values(spark, transforms.to_number("int", 0, lenient=True), ["x"], "string") == [None]


def test_fingerprints_of_arrays_equal_those_of_strings(spark):
    texts = ["".join(chr(32 + (7 * k * n + k) % 90) for k in range(n)) for n in range(300)] + ["é" * k for k in range(70)] + [None, "x" * 10_000]
    for found in (pa.array(texts), pa.array(texts).slice(11, 300), pa.array([], "string"), pa.array([None, ""], "string")):
        assert hashing.fingerprints(found).tolist() == [hashing.fingerprint64((t or "").encode()) for t in found.to_pylist()]
    assert values(spark, hashing.hash_bucket(1_000_003), texts, "string") == [None if t is None else hashing.fingerprint64(t.encode()) % 1_000_003 for t in texts]


def test_fingerprint_lengths_differ():
    seen = {hashing.fingerprint64(bytes(range(256))[:n]) for n in range(200)}
    assert len(seen) == 200 and all(0 <= x < 1 << 64 for x in seen)


def test_lookup_with_several_indices_for_other_terms(spark):
    got = values(spark, transforms.index_lookup(["x", "y"], 3), ["x", "y", "A", "B", "C", "D", "E", None], "string")
    assert got == [0, 1, 3, 2, 3, 3, 4, None]  # A to E fall into buckets 1, 0, 1, 1, 2 of three
    assert values(spark, transforms.index_lookup([], 3), ["A", "B"], "string") == [1, 0]
    vocabulary = spark.createDataFrame([("x", 0), ("y", 1)], "value string, id int")
    df = spark.createDataFrame([("x",), ("y",), ("E",), (None,)], "c string")
    assert [r.id for r in transforms.lookup_in(df, "c", vocabulary, num_oov=3).collect()] == [0, 1, 4, None]


def test_named_concatenation(spark):
    parts = {"b": (F.array(F.lit(1)), 10), "a": (F.array(F.lit(2)), 5)}
    name, ids, size = transforms.concatenated(parts)
    assert name == "a_C_b" and size == 15 and spark.range(1).select(ids.alias("i")).first().i == [1, 12]
    for wrong, error in (({}, ValueError), ({"a": (F.lit(1), 0)}, ValueError), ({"a": (F.lit(1), 2.5)}, TypeError), ({1: (F.lit(1), 2)}, TypeError)):
        with pytest.raises(error):
            transforms.concatenated(wrong)


def test_table_valued_key_values(spark):
    spark.udtf.register("key_values", key_values.KeyValues)
    rows = spark.sql("SELECT * FROM VALUES ('a:1, b : 2 ,a:3'), (''), (NULL) AS t(kv), LATERAL key_values(kv, 'a, b', ',', ':')").collect()
    assert [tuple(r)[1:] for r in rows] == [("3", "2"), (None, None), (None, None)]


def test_key_values(spark):
    df = spark.createDataFrame([(1, "age:19,income: 1200 ,education:Master"), (2, "age:1,age:2"), (3, ""), (4, None), (5, "odd,a:b:c")], "i int, kv string")
    rows = key_values.flatten(df, "kv", ["age", " income", "a"], append=["i"]).orderBy("i").collect()
    assert [tuple(r) for r in rows] == [(1, "19", "1200", None), (2, "2", None, None), (3, None, None, None), (4, None, None, None), (5, None, None, "b:c")]
    assert key_values.infer_names(df, "kv", ["i"]) == ["a", "age", "education", "income"]
    df.limit(1).createOrReplaceTempView("kv_table")
    assert "try_element_at" in key_values.flatten_sql("kv_table", "kv", ["age"], "out")
