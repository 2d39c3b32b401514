"""Queries that the library registers, each over whole tables, with its SQL.

Arrays are exploded to rows and floats rounded, so that results compare by value.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import hashing, key_values, transforms
from millrace.operators import metrics, scoring, sharding, statistics, updates, vectors
from millrace.plans.features import FeaturePlan, Step
from millrace.sources import readers
from millrace.workspace import new_path, prepare, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE")
PRICE_BORDERS = (1000.0, 20000.0, 50000.0, 100000.0, 250000.0)
DIM = 64


def query(sql: str | None = None):
    def add(fn):
        _QUERIES[fn.__name__] = lambda spark, sf_dir: fn(lambda name: table(prepare(spark), sf_dir, name))
        if sql is not None:
            _SQL[fn.__name__] = sql
        return fn

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _r(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


@query("""
WITH s AS (SELECT min(l_extendedprice) lo, max(l_extendedprice) hi FROM lineitem),
b AS (SELECT unnest([quantile_cont(l_quantity, 0.25), quantile_cont(l_quantity, 0.5), quantile_cont(l_quantity, 0.75)]) x FROM lineitem),
q AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT x FROM b) WHERE x <= l_quantity) AS bucket, (l_extendedprice - lo) / nullif(hi - lo, 0) AS n FROM lineitem, s)
SELECT bucket::BIGINT AS bucket, count(*) AS n_rows, round(avg(n), 6) AS mean_normalized FROM q GROUP BY bucket
""")
def normalize_bucketize_summary(t):
    df = t("lineitem")
    plan = FeaturePlan([Step("bucket", "bucketize", ["l_quantity"], {"buckets": 4}), Step("normalized", "normalize", ["l_extendedprice"])]).fit(df)
    return plan.apply(df, ["bucket", "normalized"]).groupBy("bucket").agg(F.count(F.lit(1)).alias("n_rows"), _r(F.avg("normalized")).alias("mean_normalized"))


@query("""
SELECT 'l_quantity' AS feature, min(l_quantity) AS minimum, max(l_quantity) AS maximum, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS deviation FROM lineitem
UNION ALL SELECT 'l_extendedprice', min(l_extendedprice), max(l_extendedprice), round(avg(l_extendedprice), 6), round(stddev_pop(l_extendedprice), 6) FROM lineitem
""")
def stats_numeric(t):
    df = t("lineitem")
    names = ("l_quantity", "l_extendedprice")
    one = df.agg(*[F.struct(F.lit(n).alias("feature"), *statistics.numeric_aggregates(n)).alias(n) for n in names])
    return one.select(F.explode(F.array(*names)).alias("s")).select("s.feature", "s.minimum", "s.maximum", _r(F.col("s.mean")).alias("mean"), _r(F.col("s.deviation")).alias("deviation"))


@query("""
SELECT k::INTEGER AS k, round(x, 6) AS boundary FROM (
  SELECT unnest(range(1, 10)) AS k, unnest(quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS x FROM lineitem)
""")
def stats_percentiles(t):
    df = t("lineitem")
    found = list(enumerate(statistics.percentiles(df, "l_extendedprice", 10), 1))
    return df.sparkSession.createDataFrame(found, "k int, x double").select("k", _r(F.col("x")).alias("boundary"))


@query("SELECT p_brand AS value, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand HAVING count(*) >= 40")
def vocab_threshold(t):
    return statistics.vocabulary(t("part"), "p_brand", 40)


@query("SELECT count(DISTINCT c_nationkey) AS n_distinct, 3 * count(DISTINCT c_nationkey) AS bins FROM customer")
def hash_size(t):
    found = t("customer").agg(F.count_distinct("c_nationkey").alias("n_distinct"))
    return found.withColumn("bins", statistics.hash_bucket_size(F.col("n_distinct")))


@query("SELECT DISTINCT p_type AS value FROM part")
def distinct_values(t):
    return t("part").select(F.col("p_type").alias("value")).distinct()


@query("SELECT l_orderkey, l_linenumber, round((l_extendedprice - lo) / nullif(hi - lo, 0), 6) AS normalized FROM lineitem, (SELECT min(l_extendedprice) lo, max(l_extendedprice) hi FROM lineitem)")
def normalize_minmax(t):
    df = t("lineitem")
    row = df.agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    return df.crossJoin(F.broadcast(row)).select("l_orderkey", "l_linenumber", _r(transforms.min_max(F.col("lo"), F.col("hi"))(F.col("l_extendedprice"))).alias("normalized"))


@query("SELECT o_orderkey, round((o_totalprice - m) / nullif(s, 0), 6) AS standardized FROM orders, (SELECT avg(o_totalprice) m, stddev_pop(o_totalprice) s FROM orders)")
def standardize(t):
    df = t("orders")
    row = df.agg(F.avg("o_totalprice").alias("m"), F.stddev_pop("o_totalprice").alias("s"))
    return df.crossJoin(F.broadcast(row)).select("o_orderkey", _r(transforms.standardize(F.col("m"), F.col("s"))(F.col("o_totalprice"))).alias("standardized"))


@query("SELECT o_orderkey, round(((o_totalprice::FLOAT - 1000::FLOAT) / 2::FLOAT)::FLOAT::DOUBLE, 3) AS scaled FROM orders")
def normalizer_f32(t):
    return t("orders").select("o_orderkey", _r(transforms.normalizer(1000.0, 2.0)(F.col("o_totalprice")).cast("double"), 3).alias("scaled"))


@query("SELECT l_orderkey, l_linenumber, ((l_quantity >= 5)::INT + (l_quantity >= 10)::INT + (l_quantity >= 25)::INT + (l_quantity >= 40)::INT)::BIGINT AS bucket FROM lineitem")
def bucketize(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", transforms.bucketize([5, 10, 25, 40])(F.col("l_quantity")).alias("bucket"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 0 AND round_even(ln(o_totalprice) / ln(2), 0) BETWEEN 0 AND 17 THEN round_even(ln(o_totalprice) / ln(2), 0)::BIGINT ELSE 0 END AS id FROM orders")
def log_round(t):
    return t("orders").select("o_orderkey", transforms.log_round(18, 0, 2.0)(F.col("o_totalprice")).alias("id"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN round_even(l_quantity / 2, 0) BETWEEN 0 AND 19 THEN round_even(l_quantity / 2, 0)::BIGINT ELSE 0 END AS id FROM lineitem")
def round_identity(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", transforms.round_identity(20)(F.col("l_quantity") / 2).alias("id"))


@query("SELECT c_custkey, coalesce(nullif(list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE'], c_mktsegment), 0) - 1, 3)::BIGINT AS id FROM customer")
def index_lookup(t):
    return t("customer").select("c_custkey", transforms.index_lookup(SEGMENTS)(F.col("c_mktsegment")).alias("id"))


@query("""
WITH v AS (SELECT p_type, row_number() OVER (ORDER BY count(*) DESC, p_type) - 1 AS id FROM part GROUP BY p_type HAVING count(*) >= 12), n AS (SELECT count(*) AS size FROM v)
SELECT p_partkey, coalesce(v.id, size)::BIGINT AS id FROM part LEFT JOIN v USING (p_type), n
""")
def index_lookup_table(t):
    part = t("part")
    words = sharding.row_numbers(statistics.vocabulary(part, "p_type", 12).withColumn("minus", -F.col("n")), ["minus", "value"], "id")
    size = words.agg(F.count(F.lit(1)).alias("size"))
    joined = part.join(words.select(F.col("value").alias("p_type"), "id"), "p_type", "left").crossJoin(F.broadcast(size))
    return joined.select("p_partkey", F.coalesce("id", "size").cast("bigint").alias("id"))


@query("SELECT event_id, coalesce(nullif(regexp_extract(props, '([0-9]+)', 1), '')::BIGINT, -1) AS number FROM events")
def to_number(t):
    return t("events").select("event_id", transforms.to_number("bigint", -1)(F.regexp_extract(F.coalesce("props", F.lit("")), "([0-9]+)", 1)).alias("number"))


@query("SELECT doc_id, len(list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> ''))::BIGINT AS n, len(list_distinct(list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '')))::BIGINT AS n_distinct FROM documents")
def ragged_filter(t):
    kept = transforms.to_ragged(" ", "")(F.coalesce("text", F.lit("")))
    return t("documents").select("doc_id", kept.alias("kept")).select("doc_id", F.size("kept").cast("bigint").alias("n"), F.size(F.array_distinct("kept")).cast("bigint").alias("n_distinct"))


@query("""
SELECT p_partkey, pos::BIGINT AS pos, value FROM (SELECT p_partkey, unnest(range(0, 3)) AS pos, unnest([nullif(p_brand, 'Brand#11'), nullif(p_type, ''), p_name]) AS value FROM part) WHERE value IS NOT NULL
""")
def sparse_filter(t):
    array = F.array(F.when(F.col("p_brand") == "Brand#11", "").otherwise(F.col("p_brand")), "p_type", "p_name")
    return t("part").select("p_partkey", F.explode(transforms.to_sparse("")(array)).alias("s")).select("p_partkey", F.col("s.pos").cast("bigint").alias("pos"), "s.value")


@query("SELECT p_partkey, pos::BIGINT AS pos, id::BIGINT AS id FROM (SELECT p_partkey, unnest(range(0, 2)) AS pos, unnest([p_size, 51 + p_partkey % 10]) AS id FROM part)")
def concat_offset(t):
    ids = transforms.concat_with_offsets([F.array(F.col("p_size").cast("bigint")), F.array(F.col("p_partkey") % 10)], transforms.id_offsets([51, 10]))
    return t("part").select("p_partkey", F.posexplode(ids).alias("pos", "id")).select("p_partkey", F.col("pos").cast("bigint").alias("pos"), "id")


_FOLD = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(sha256({0}), ''), lambda c: instr('0123456789abcdef', c) - 1)), lambda a, x: (a * 32 + x) % {1})"


@query(f"SELECT p_partkey, ({_FOLD.format("p_brand || '_X_' || p_size", 1000)})::BIGINT AS id FROM part")
def cross_hash(t):
    crossed = transforms.cross([F.array("p_brand"), F.array("p_size")])[0]
    return t("part").select("p_partkey", hashing.string_partition(crossed, 1000).alias("id"))


@query(f"SELECT c_custkey, ({_FOLD.format('c_name', 7)})::BIGINT AS bucket FROM customer")
def string_partition(t):
    return t("customer").select("c_custkey", hashing.string_partition(F.col("c_name"), 7).alias("bucket"))


@query("SELECT ((l_partkey - 500) % 16 + 16) % 16 AS bucket, count(*) AS n FROM lineitem GROUP BY 1")
def int_partition(t):
    return t("lineitem").select(hashing.int_partition(F.col("l_partkey") - 500, 16).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def _fingerprint_sql(x: str) -> str:
    """The public fingerprint of ASCII texts of 4 to 64 characters in SQL, modulo 2**64 in 128-bit numbers."""
    m = "18446744073709551616::UHUGEINT"
    k1, k2 = (f"{k}::UBIGINT" for k in (hashing.K1, hashing.K2))
    word = lambda at, size=8: f"('0x' || array_to_string(list_transform(range({size}, 0, -1), lambda q: substr(h, 2 * ({at} + q) - 1, 2)), ''))::UBIGINT"
    mul = lambda a, b: f"((({a})::UHUGEINT * ({b})::UHUGEINT) % {m})::UBIGINT"
    add = lambda *v: f"(({' + '.join(f'({x})::UHUGEINT' for x in v)}) % {m})::UBIGINT"
    rot = lambda v, s: f"(({v}) // {1 << s}::UBIGINT + ({v}) % {1 << s}::UBIGINT * {1 << (64 - s)}::UBIGINT)"
    shift = lambda v: f"xor({v}, ({v}) // {1 << 47}::UBIGINT)"
    len16 = lambda u, v, by: f"(SELECT {mul(shift('b'), by)} FROM (SELECT {mul('xor(' + v + ', a)', by)} AS b FROM (SELECT {shift('a')} AS a FROM (SELECT {mul(f'xor({u}, {v})', by)} AS a))))"
    return f"""
h AS (SELECT *, hex(encode({x})) AS h, length({x}) AS n FROM src),
w AS (SELECT *, {add(k2, "2 * n")} AS m FROM h),
c AS (
  SELECT *, 0 AS way, {add("n", f"8 * {word(0, 4)}")} AS a, {word("n - 4", 4)} AS b, 0::UBIGINT AS c, 0::UBIGINT AS d FROM w WHERE n BETWEEN 4 AND 7
  UNION ALL SELECT *, 1, {add(word(0), k2)}, {word("n - 8")}, 0, 0 FROM w WHERE n BETWEEN 8 AND 16
  UNION ALL SELECT *, 2, {mul(word(0), k1)}, {word(8)}, {mul(word("n - 8"), "m")}, {mul(word("n - 16"), k2)} FROM w WHERE n BETWEEN 17 AND 32
  UNION ALL SELECT *, 3, {mul(word(0), k2)}, {word(8)}, {mul(word("n - 8"), "m")}, {mul(word("n - 16"), k2)} FROM w WHERE n BETWEEN 33 AND 64),
y AS (
  SELECT *, CASE way WHEN 0 THEN a WHEN 1 THEN {add(mul(rot("b", 37), "m"), "a")} WHEN 2 THEN {add(rot(add("a", "b"), 43), rot("c", 30), "d")} ELSE {add(rot(add("a", "b"), 43), rot("c", 30), "d")} END AS u,
    CASE way WHEN 0 THEN b WHEN 1 THEN {mul(add(rot("a", 25), "b"), "m")} ELSE {add("a", rot(add("b", k2), 18), "c")} END AS v FROM c),
z AS (SELECT *, {len16("u", "v", "m")} AS f FROM y),
l AS (
  SELECT *, {mul(word(16), "m")} AS e, {word(24)} AS g, {mul(add("u", word("n - 32")), "m")} AS p, {mul(add("f", word("n - 24")), "m")} AS q FROM z WHERE way = 3),
r AS (SELECT *, {add(rot(add("e", "g"), 43), rot("p", 30), "q")} AS ru, {add("e", rot(add("g", "a"), 18), "p")} AS rv FROM l),
fingerprint AS (SELECT * EXCLUDE (h, m, way, a, b, c, d, u, v, f), f FROM z WHERE way < 3 UNION ALL SELECT * EXCLUDE (h, m, way, a, b, c, d, u, v, f, e, g, p, q, ru, rv), {len16("ru", "rv", "m")} FROM r)"""


@query(f"WITH src AS (SELECT c_custkey, c_name FROM customer), {_fingerprint_sql('c_name')} SELECT c_custkey, (f % 100)::BIGINT AS bucket FROM fingerprint")
def hash_bucket_exact(t):
    return t("customer").select("c_custkey", hashing.hash_bucket(100)(F.col("c_name")).alias("bucket"))


@query(f"WITH src AS (SELECT p_partkey, k, left(p_type || ' ' || p_name || ' ' || p_brand || p_type || p_name || p_type, (4 + 3 * k + p_partkey % 3)::BIGINT) AS s FROM part, range(0, 20) r(k)), {_fingerprint_sql('s')} SELECT p_partkey, k::INTEGER AS k, (f % 1000003)::BIGINT AS bucket FROM fingerprint")
def hash_lengths(t):
    """The fingerprint of texts of 4 to 64 characters. Rows are dealt out before they become twenty: a small file is one task."""
    part = t("part").select("p_partkey", "p_type", "p_name", "p_brand")
    part = part.repartition(int(part.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    text = F.concat("p_type", F.lit(" "), "p_name", F.lit(" "), "p_brand", "p_type", "p_name", "p_type")
    each = part.select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k"), text.alias("s"))
    cut = each.select("p_partkey", "k", F.substring("s", F.lit(1), (4 + 3 * F.col("k") + F.col("p_partkey") % 3).cast("int")).alias("s")).where(F.length("s").between(4, 64))
    return cut.select("p_partkey", "k", hashing.hash_bucket(1_000_003)(F.col("s")).alias("bucket"))


@query(f"WITH src AS (SELECT c_custkey, c_mktsegment FROM customer), {_fingerprint_sql('c_mktsegment')} SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 ELSE 2 + (f % 5)::BIGINT END AS id FROM fingerprint")
def index_lookup_oov(t):
    return t("customer").select("c_custkey", transforms.index_lookup(SEGMENTS[:2], 5)(F.col("c_mktsegment")).alias("id"))


@query(f"""WITH v AS (SELECT p_type, row_number() OVER (ORDER BY count(*) DESC, p_type) - 1 AS id FROM part GROUP BY p_type HAVING count(*) >= 14), k AS (SELECT count(*) AS size FROM v),
src AS (SELECT p_partkey, p_type FROM part), {_fingerprint_sql('p_type')} SELECT p_partkey, coalesce(v.id, size + (f % 7)::BIGINT)::BIGINT AS id FROM fingerprint LEFT JOIN v USING (p_type), k""")
def lookup_table_oov(t):
    part = t("part")
    words = sharding.row_numbers(statistics.vocabulary(part, "p_type", 14).withColumn("minus", -F.col("n")), ["minus", "value"], "id")
    return transforms.lookup_in(part, "p_type", words, "id", 7).select("p_partkey", "id")


@query("SELECT p_partkey, 'p_brand_C_p_size' AS name, pos::BIGINT AS pos, id::BIGINT AS id FROM (SELECT p_partkey, unnest(range(0, 2)) AS pos, unnest([p_size, 60 + p_partkey % 10]) AS id FROM part)")
def concat_named(t):
    name, ids, size = transforms.concatenated({"p_size": (F.array("p_size"), 60), "p_brand": (F.array(F.col("p_partkey") % 10), 10)})
    found = t("part").select("p_partkey", F.posexplode(ids).alias("pos", "id"))
    return found.where(F.col("id") < size).select("p_partkey", F.lit(name).alias("name"), F.col("pos").cast("bigint").alias("pos"), "id")


@query(f"WITH src AS (SELECT c_custkey, c_mktsegment FROM customer), {_fingerprint_sql('c_mktsegment')} SELECT c_custkey, 'embedded_hash' AS step, (f % (3 * (SELECT count(DISTINCT c_mktsegment) FROM customer)))::BIGINT AS id FROM fingerprint")
def embedding_expand(t):
    """Embedding a text column puts a hash step before it, whose bins come from the distinct values."""
    df = t("customer")
    plan = FeaturePlan([Step("embedded", "embed", ["c_mktsegment"], {"dim": 8})]).fit(df)
    return plan.apply(df, ["embedded"], ["c_custkey"]).select("c_custkey", F.lit(plan.order()[0].name).alias("step"), F.col("embedded").alias("id"))


@query("SELECT unnest(['a', 'both', 'b']) AS name, unnest([0, 2, 1]) AS place")
def step_order(t):
    plan, gone = FeaturePlan([Step("both", "group", ["a", "b", "c"]), Step("a", "round_identity", ["p_size"], {"bins": 9}), Step("b", "log_round", ["p_size"], {"bins": 9}), Step("c", "lookup", ["not_there"])]).known(t("part").columns)
    return t("part").sparkSession.createDataFrame([(s.name, i) for i, s in enumerate(plan.order())], "name string, place int")


@query("SELECT p_partkey, i::BIGINT AS i, (CASE WHEN p_size % 5 = i THEN 1 ELSE 0 END + CASE WHEN p_partkey % 5 = i THEN 1 ELSE 0 END)::DOUBLE AS n FROM part, range(0, 5) r(i)")
def multi_hot(t):
    hot = transforms.multi_hot(F.array((F.col("p_size") % 5).cast("bigint"), F.col("p_partkey") % 5), 5)
    return t("part").select("p_partkey", F.posexplode(hot).alias("i", "n")).select("p_partkey", F.col("i").cast("bigint").alias("i"), F.col("n").cast("double").alias("n"))


@query("SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority, NULL::VARCHAR AS missing FROM orders")
def kv_flatten(t):
    kv = F.concat(F.lit("status:"), "o_orderstatus", F.lit(", priority:"), "o_orderpriority", F.lit(",status:"), "o_orderstatus")
    return key_values.flatten(t("orders").select("o_orderkey", kv.alias("kv")), "kv", ["status", "priority", "missing"], append=["o_orderkey"])


@query("SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority FROM orders")
def kv_table_function(t):
    """The table-valued form, joined laterally."""
    kv = F.concat(F.lit("status:x,priority:"), "o_orderpriority", F.lit(", status:"), "o_orderstatus")
    df = t("orders").select("o_orderkey", kv.alias("kv"))
    df.sparkSession.udtf.register("key_values", key_values.KeyValues)
    df.createOrReplaceTempView("kv_orders")
    return df.sparkSession.sql("SELECT o_orderkey, status, priority FROM kv_orders, LATERAL key_values(kv, 'status,priority', ',', ':')")


@query("SELECT unnest(['price', 'status']) AS name")
def kv_infer(t):
    df = t("orders").select("o_orderkey", F.concat(F.lit("status:"), "o_orderstatus", F.lit(",price:"), F.col("o_totalprice").cast("string")).alias("kv"))
    return df.sparkSession.createDataFrame([(n,) for n in key_values.infer_names(df, "kv", ["o_orderkey"])], "name string")


@query("""
WITH s AS (SELECT 'lineitem' AS name, count(*) AS n FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part)
SELECT name, i * 1000 AS start, least((i + 1) * 1000, n) AS "end" FROM s, range(0, 1000000) r(i) WHERE i * 1000 < n
""")
def shard_manifest(t):
    sizes = [t(n).agg(F.lit(n).alias("name"), F.lit(0).cast("bigint").alias("start"), F.count(F.lit(1)).alias("count")) for n in ("lineitem", "orders", "part")]
    return sharding.cut(sizes[0].union(sizes[1]).union(sizes[2]), 1000)


@query("""
WITH f AS (SELECT c_mktsegment AS name, count(*) AS n FROM customer GROUP BY 1), p AS (SELECT name, n, coalesce(sum(n) OVER (ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM f)
SELECT name, (greatest(b, 50) - b)::BIGINT AS local_start, (least(b + n, 120) - greatest(b, 50))::BIGINT AS count FROM p WHERE b < 120 AND b + n > 50
""")
def block_range(t):
    files = t("customer").groupBy(F.col("c_mktsegment").alias("name")).agg(F.count(F.lit(1)).alias("count"))
    return sharding.ranges_of_files(files, 50, 120)


@query("SELECT e::INTEGER AS epoch, count(*) AS tasks, sum(least((i + 1) * 500, n) - i * 500)::BIGINT AS records FROM (SELECT count(*) AS n FROM orders), range(0, 1000000) r(i), range(0, 3) g(e) WHERE i * 500 < n GROUP BY 1")
def epoch_expand(t):
    size = t("orders").agg(F.lit("orders").alias("name"), F.lit(0).cast("bigint").alias("start"), F.count(F.lit(1)).alias("count"))
    return sharding.epochs(sharding.cut(size, 500), 3).groupBy("epoch").agg(F.count(F.lit(1)).alias("tasks"), F.sum(F.col("end") - F.col("start")).alias("records"))


_ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate::DATE::VARCHAR AS o_orderdate, o_orderpriority"


def _orders(t) -> DataFrame:
    return t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date").cast("string").alias("o_orderdate"), "o_orderpriority")


@query(f"SELECT {_ORDERS}, (row_number() OVER (ORDER BY o_orderkey) - 1) % 20 = 0 AS evaluation FROM orders")
def train_eval_split(t):
    return sharding.systematic_split(_orders(t), ["o_orderkey"])


@query(f"SELECT {_ORDERS}, (row_number() OVER (ORDER BY o_orderkey) - 1) < floor(count(*) OVER () * 0.75) AS training FROM orders")
def ordered_split(t):
    return readers.ordered_split(_orders(t), ["o_orderkey"])


@query(f"SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row, {_ORDERS} FROM orders QUALIFY row >= 1000 AND row < 1100")
def row_range(t):
    df = readers.row_range(_orders(t), ["o_orderkey"], 1000, 1100)
    return sharding.row_numbers(df, ["o_orderkey"]).select((F.col("row") + 1000).alias("row"), *df.columns)


@query("SELECT l_orderkey, l_linenumber, (row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1) AS row FROM lineitem WHERE l_linenumber > 1 QUALIFY row_number() OVER (ORDER BY l_orderkey, l_linenumber) <= floor(count(*) OVER () * 0.3)")
def first_share(t):
    df = t("lineitem").where("l_linenumber > 1")
    return sharding.row_numbers(readers.first_share(df, ["l_orderkey", "l_linenumber"], 0.3), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "row")


@query("""
WITH t AS (SELECT doc_id, string_split(text, ' ')[1:6] AS w FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, unnest(w) AS term, unnest(range(0, len(w))) AS pos FROM t),
f AS (SELECT term, row_number() OVER (ORDER BY min(struct_pack(d := doc_id, p := pos))) AS id FROM e GROUP BY term)
SELECT doc_id, pos::BIGINT AS pos, coalesce(f.id, 0)::BIGINT AS id FROM (SELECT t.doc_id, p AS pos, w[len(w) - 8 + p + 1] AS term, len(w) - 8 + p + 1 AS at FROM t, range(0, 8) r(p)) x LEFT JOIN f ON f.term = x.term AND x.at > 0
""")
def libfm_ids(t):
    """Ids by first appearance over the first six terms of each text, left-padded to eight."""
    df = t("documents").where("text IS NOT NULL").select("doc_id", F.lit(1).alias("label"), F.slice(F.split("text", " "), 1, 6).alias("features"))
    ids = readers.encode_libfm(df, "doc_id", 8)
    return ids.select("doc_id", F.posexplode("ids").alias("pos", "id")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "id")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer WHERE c_nationkey = 7")
def csv_round_trip(t):
    """Written as CSV, partitioned by a column, and read with a schema and a filter on the partition."""
    df = t("customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey")
    path = new_path(df.sparkSession, "csv")
    df.write.partitionBy("c_nationkey").csv(path)
    found = readers.open_source(df.sparkSession, path, "csv", schema="c_custkey bigint, c_name string, c_acctbal double, c_nationkey int")
    return found.where("c_nationkey = 7").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")


@query("SELECT o_orderkey, o_custkey, o_totalprice, (o_orderkey % 4)::BIGINT AS worker FROM orders")
def sink_round_trip(t):
    """Written in files of 1,000 records and partitions worker=<i>, and read back."""
    df = t("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    path = new_path(df.sparkSession, "shards")
    df.withColumn("worker", F.col("o_orderkey") % 4).write.option("maxRecordsPerFile", 1000).partitionBy("worker").parquet(path)
    return readers.open_source(df.sparkSession, path).select("o_orderkey", "o_custkey", "o_totalprice", F.col("worker").cast("bigint").alias("worker"))


@query("SELECT o_orderkey, round(o_custkey::FLOAT::DOUBLE + o_totalprice::FLOAT::DOUBLE, 2) AS total, o_orderstatus AS label FROM orders")
def features_label(t):
    df = t("orders").select("o_orderkey", "o_custkey", "o_totalprice", F.struct("o_orderkey", "o_orderstatus").alias("y"))
    made = readers.features_and_label(df, ["o_custkey", "o_totalprice"], "y")
    return made.select("label.o_orderkey", _r(F.col("features")[0].cast("double") + F.col("features")[1].cast("double"), 2).alias("total"), F.col("label.o_orderstatus").alias("label"))


@query("SELECT o_orderkey % 2 AS label, coalesce(o_custkey, 0) AS i1, coalesce(nullif(o_orderkey % 7, 0), 0) AS i2, coalesce(o_orderstatus, '') AS c1, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS c2 FROM orders")
def click_log(t):
    """A tab-separated log with blanks, written and read."""
    df = t("orders")
    blank = lambda c, m: F.when(F.col("o_orderkey") % m == 0, F.lit("")).otherwise(c.cast("string"))
    path = new_path(df.sparkSession, "clicks")
    df.select(F.concat_ws("\t", F.col("o_orderkey") % 2, "o_custkey", blank(F.col("o_orderkey") % 7, 7), "o_orderstatus", blank(F.col("o_orderpriority"), 3)).alias("value")).write.text(path)
    found = readers.open_source(df.sparkSession, path, "click_log", integers=2, texts=2)
    return found.select("label", F.col("I1").alias("i1"), F.col("I2").alias("i2"), F.col("C1").alias("c1"), F.col("C2").alias("c2"))


@query(f"SELECT vec_id AS id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) + 0.0 AS total, round(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * i)), 4) + 0.0 AS weighted FROM embeddings")
def image_flatten(t):
    """Vectors as images of eight rows and eight columns, flattened."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))
    flat = readers.flatten_images(t("embeddings").select(F.col("vec_id").alias("id"), rows.alias("image")), "image")
    return _sums(flat.select("id", F.col("image").cast("array<double>").alias("vec")), "id")


@query("SELECT i AS part, i * 10 + j AS a, (i * 10 + j) / 4.0::DOUBLE AS b, 'n' || (i * 10 + j) AS c FROM range(0, 5) r(i), range(0, 10) s(j)")
def generated_rows(t):
    make = lambda part: ((part, part * 10 + j, (part * 10 + j) / 4.0, f"n{part * 10 + j}") for j in range(10))
    return readers.tuples(t("region").sparkSession, make, 5, "part bigint, a bigint, b double, c string")


@query("SELECT i * 500 AS start, least((i + 1) * 500, 10000) AS \"end\", i * 5 AS steps_before FROM range(0, 20) r(i) WHERE i * 5 <= 42")
def tasks_until_step(t):
    """The tasks of 10,000 records in batches of 100, five a task, before step 42 is complete."""
    tasks = sharding.until_step(sharding.manifest(10_000, 100, 5, t("region").sparkSession), 100, 42, ["start"])
    return tasks.select("start", "end", F.floor(F.col("start") / 100).alias("steps_before"))


@query("SELECT e::INTEGER AS epoch, o_orderkey, true AS once FROM orders, range(0, 2) r(e)")
def shuffled_epochs(t):
    """All records in each epoch, each at one place."""
    each = sharding.shuffled(t("orders").select("o_orderkey"), 2, 5, ["o_orderkey"])
    places = each.groupBy("epoch", "o_orderkey").agg(F.count_distinct("place").alias("n"))
    return places.select("epoch", "o_orderkey", (F.col("n") == 1).alias("once"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 END AS code FROM events")
def label_codes(t):
    return t("events").select("event_id", readers.label_codes(F.col("event_type"), {"click": 0, "view": 1, "purchase": 2}).alias("code"))


def _table(t) -> DataFrame:
    return t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))


def _bags(t) -> DataFrame:
    ids = F.sort_array(F.collect_list(F.struct("l_linenumber", (F.col("l_partkey") % 600 - 20).alias("id"), F.col("l_discount").alias("w"))))
    bags = t("lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(ids.alias("a"))
    return bags.select("key", F.transform("a", lambda s: s["id"]).alias("ids"), F.transform("a", lambda s: s["w"] + 0.5).alias("ws"))


def _sums(df: DataFrame, key: str, digits: int = 4, vec: str = "vec") -> DataFrame:
    """Two numbers into which every position of a vector goes: the sum, and the sum weighted by the position from 1."""
    return df.select(key, *_two(vec, digits))


def _two(vec: str, digits: int = 4, end: str = "") -> list[Column]:
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    weighted = F.transform(vec, lambda x, i: x * (i + 1))
    return [(_r(add(F.col(vec)), digits) + F.lit(0.0)).alias(f"total{end}"), (_r(add(weighted), digits) + F.lit(0.0)).alias(f"weighted{end}")]


_EACH = "each AS (SELECT l_orderkey AS key, l_linenumber AS ln, l_partkey % 600 - 20 AS id, l_discount + 0.5 AS w FROM lineitem)"
_DIMS = f"e AS (SELECT vec_id AS id, unnest(range(0, {DIM})) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings)"
_BOTH = "round(sum(x), {0}) + 0.0 AS total, round(sum((d + 1) * x), {0}) + 0.0 AS weighted"


def _combined_sql(expr: str) -> str:
    return f"""WITH {_EACH}, {_DIMS}, s AS (SELECT key, d, {expr} AS x FROM each JOIN e USING (id) WHERE id >= 0 GROUP BY key, d)
SELECT k.key, coalesce(round(sum(x), 4), 0) + 0.0 AS total, coalesce(round(sum((d + 1) * x), 4), 0) + 0.0 AS weighted FROM (SELECT DISTINCT l_orderkey AS key FROM lineitem) k LEFT JOIN s USING (key) GROUP BY k.key"""


@query(_combined_sql("sum(x)"))
def embed_combine_sum(t):
    return _sums(vectors.combine(_bags(t), _table(t), DIM, "sum"), "key")


@query(_combined_sql("sum(x) / count(*)"))
def embed_combine_mean(t):
    return _sums(vectors.combine(_bags(t), _table(t), DIM, "mean"), "key")


@query(_combined_sql("sum(x) / sqrt(count(*))"))
def embed_combine_sqrtn(t):
    return _sums(vectors.combine(_bags(t), _table(t), DIM, "sqrtn"), "key")


@query(_combined_sql("sum(w * x) / sqrt(sum(w * w))"))
def embed_weighted(t):
    return _sums(vectors.combine(_bags(t), _table(t), DIM, "sqrtn", weights="ws"), "key")


@query(_combined_sql("sum(x) FILTER (id > 0) / nullif(count(*) FILTER (id > 0), 0)"))
def embed_zero_missing(t):
    return _sums(vectors.combine(_bags(t), _table(t), DIM, "mean", zero_is_missing=True), "key")


@query(f"""WITH {_EACH}, {_DIMS}, o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ln, id, w) - 1 AS pos FROM each),
s AS (SELECT id, {_BOTH.format(4)} FROM e GROUP BY id)
SELECT key, pos::BIGINT AS pos, coalesce(total, 0) AS total, coalesce(weighted, 0) AS weighted FROM o LEFT JOIN s USING (id)""")
def embed_lookup(t):
    found = vectors.lookup(_bags(t), _table(t), DIM)
    each = found.select("key", F.posexplode("vecs").alias("pos", "vec")).select(F.struct("key", F.col("pos").cast("bigint").alias("pos")).alias("at"), "vec")
    return _sums(each, "at").select("at.*", "total", "weighted")


@query(f"WITH {_EACH} SELECT key, count(*) AS n, count(*) FILTER (id <> 0) AS n_masked FROM each GROUP BY key")
def embed_mask(t):
    return _bags(t).select("key", F.size("ids").cast("bigint").alias("n"), F.size(F.filter(vectors.mask(F.col("ids")), lambda m: m)).cast("bigint").alias("n_masked"))


@query(f"""WITH {_DIMS}, b AS (SELECT l_orderkey AS key, l_partkey % 400 AS a, l_suppkey % 300 AS b FROM lineitem),
s AS (SELECT id, sum(x) AS x, sum((d + 1) * x) AS w FROM e GROUP BY id)
SELECT key, coalesce(round(sum(sa.x), 4), 0) + 0.0 AS total_a, coalesce(round(sum(sa.w), 4), 0) + 0.0 AS weighted_a, coalesce(round(sum(sb.x), 4), 0) + 0.0 AS total_b, coalesce(round(sum(sb.w), 4), 0) + 0.0 AS weighted_b
FROM b LEFT JOIN s sa ON sa.id = a LEFT JOIN s sb ON sb.id = b GROUP BY key""")
def embed_pooled(t):
    rows = t("lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.collect_list(F.col("l_partkey") % 400).alias("a"), F.collect_list(F.col("l_suppkey") % 300).alias("b"))
    found = vectors.pooled(rows, {"a": _table(t), "b": _table(t)}, DIM)
    return found.select("key", *_two("a", end="_a"), *_two("b", end="_b"))


@query(f"WITH {_EACH}, {_DIMS}, s AS (SELECT key, d, sum(x) AS a, sum(x * x) AS b FROM each JOIN e USING (id) WHERE id > 0 GROUP BY key, d) SELECT key, round(sum(a * a - b) / 2, 4) + 0.0 AS value FROM s GROUP BY key")
def fm_second_order(t):
    return vectors.fm_second_order(_bags(t), _table(t), DIM).select("key", (_r(F.col("value"), 4) + F.lit(0.0)).alias("value"))


@query(f"WITH {_DIMS}, s AS (SELECT id % 50 AS id, d, 2 * sum(x) AS x FROM e GROUP BY 1, 2) SELECT id, {_BOTH.format(4)} FROM s GROUP BY id")
def slices_merge_dedup(t):
    slices = _table(t).select((F.col("id") % 50).alias("id"), "vec")
    return _sums(vectors.deduplicate(vectors.merge(slices, slices), DIM), "id")


@query(f"WITH {_DIMS}, n AS (SELECT id + 250 AS id, d, x + 1 AS x FROM e), s AS (SELECT id, d, coalesce(n.x, e.x) AS x FROM e FULL JOIN n USING (id, d)) SELECT id, {_BOTH.format(4)} FROM s GROUP BY id")
def upsert(t):
    changes = _table(t).select((F.col("id") + 250).alias("id"), F.transform("vec", lambda x: x + 1).alias("vec"))
    return _sums(vectors.upsert(_table(t), changes), "id")


@query(f"WITH {_DIMS}, s AS (SELECT id, {_BOTH.format(4)} FROM e GROUP BY id) SELECT i AS id, coalesce(total, 0) AS total, coalesce(weighted, 0) AS weighted FROM range(0, 700) r(i) LEFT JOIN s ON s.id = i")
def dense_matrix(t):
    return _sums(vectors.dense(_table(t), 700, DIM), "id")


@query(f"SELECT i AS id, (0.25 * {DIM})::DOUBLE AS total, (0.25 * {DIM * (DIM + 1) // 2})::DOUBLE AS weighted, true AS in_range, 'constant' AS kind FROM range(0, 100) r(i) UNION ALL SELECT i, 0, 0, true, k FROM range(0, 100) r(i), (SELECT unnest(['normal', 'truncated_normal', 'uniform', 'zero']) AS k)")
def initial_vectors(t):
    """What ids get that no table has: constants as they are, of random kinds whether all values are in their range."""
    ids, out = t("embeddings").sparkSession.range(100), []
    for kind, low, high in (("zero", 0, 0), ("constant", 0.25, 0.25), ("uniform", -0.05, 0.05), ("normal", -1.0, 1.0), ("truncated_normal", -0.1, 0.1)):
        made = ids.select("id", vectors.initial(kind, DIM, value=0.25).alias("vec"))
        inside = (F.array_min("vec") >= low) & (F.array_max("vec") <= high)
        shown = F.when(F.lit(kind in ("zero", "constant")), F.col("vec")).otherwise(vectors.zeros(DIM))
        out.append(_sums(made.select(F.struct("id", inside.alias("in_range"), F.lit(kind).alias("kind")).alias("at"), shown.alias("vec")), "at").select("at.*", "total", "weighted"))
    return reduce(DataFrame.unionByName, out)


@query(f"WITH {_EACH} SELECT key, max(id) AS largest FROM each GROUP BY key HAVING max(id) < 600")
def id_check(t):
    checked = vectors.check_ids(_bags(t), 600)
    return checked.select("key", F.array_max("ids").alias("largest"))


@query("SELECT vec_id % 4 AS bucket, count(*) AS n, sum(vec_id)::BIGINT AS ids FROM embeddings GROUP BY 1")
def scatter(t):
    return vectors.scatter(_table(t), 4).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


def _gradients(t) -> DataFrame:
    """Gradients for the ids from 250 on: some ids of the table have none, and some gradients no row."""
    return _table(t).select((F.col("id") + 250).alias("id"), F.transform("vec", lambda x: x * 0.5 + 0.25).alias("vec"))


def _step_sql(expr: str) -> str:
    return f"""WITH {_DIMS}, g AS (SELECT id + 250 AS id, d, x * 0.5 + 0.25 AS g FROM e), s AS (SELECT id, d, CASE WHEN g IS NULL THEN x ELSE {expr} END AS x FROM e LEFT JOIN g USING (id, d))
SELECT id, {_BOTH.format(3)} FROM s GROUP BY id"""


@query(_step_sql("x - 0.1 * g"))
def sgd(t):
    return _sums(updates.step(_table(t), _gradients(t), updates.Optimizer("sgd", 0.1), DIM), "id", 3)


@query(_step_sql("x - 0.1 * (g + 0.9 * g)"))
def momentum(t):
    return _sums(updates.step(_table(t), _gradients(t), updates.Optimizer("momentum", 0.1, nesterov=True), DIM), "id", 3)


@query(_step_sql("x - 0.1 * sqrt(1 - 0.999) / (1 - 0.9) * (0.1 * g) / (sqrt(0.001 * g * g) + 1e-8)"))
def adam(t):
    return _sums(updates.step(_table(t), _gradients(t), updates.Optimizer("adam", 0.1, amsgrad=True), DIM), "id", 3)


@query(_step_sql("x - 0.1 * g / (sqrt(0.1 + g * g) + 1e-8)"))
def adagrad(t):
    return _sums(updates.step(_table(t), _gradients(t), updates.Optimizer.from_text("adagrad", "lr=0.1;epsilon=1e-8"), DIM), "id", 3)


@query(f"WITH {_DIMS}, s AS (SELECT id, d, x - 0.1 * (x * 0.5 + 0.25) AS x FROM e) SELECT id, id % 3 AS shard, {_BOTH.format(3)} FROM s GROUP BY id")
def checkpoint_restore(t):
    """A step's result saved as the second version in four shards, and the newest version read back in three."""
    table = _table(t)
    spark, path = table.sparkSession, new_path(table.sparkSession, "checkpoint")
    gradients = table.select("id", F.transform("vec", lambda x: x * 0.5 + 0.25).alias("vec"))
    updates.save(table, path, 1, 4)
    updates.save(updates.step(table, gradients, updates.Optimizer("sgd", 0.1), DIM), path, 2, 4)
    found = updates.restore(spark, path, 3)
    return _sums(found.select(F.struct("id", F.col("shard").cast("bigint").alias("shard")).alias("at"), "vec"), "at", 3).select("at.*", "total", "weighted")


@query("SELECT event_id, event_id % 10 AS version FROM events WHERE event_id % 10 > 6")
def newer_versions(t):
    return updates.newer(t("events").select("event_id", (F.col("event_id") % 10).alias("version")), 6)


@query("SELECT event_id, CASE WHEN event_type NOT IN ('click', 'view') THEN 'name' WHEN value IS NULL OR event_type = 'view' THEN 'width' END AS fault FROM events")
def gradient_faults(t):
    g = t("events").select("event_id", F.col("event_type").alias("name"), F.when(F.col("value").isNotNull(), F.array("value")).alias("vec"))
    return g.select("event_id", updates.gradient_fault({"click": 1, "view": 2}).alias("fault"))


@query("""
WITH g AS (SELECT event_type AS name, user_id AS id, value, event_id % 10 AS version FROM events WHERE event_id % 10 >= 7)
SELECT name, CASE WHEN id % 2 = 0 THEN id END AS id, round(CASE WHEN id % 2 = 0 THEN sum(value) ELSE NULL END, 4) AS x FROM g WHERE id % 2 = 0 GROUP BY name, id
UNION ALL SELECT name, NULL, round(sum(value) / 2, 4) FROM g WHERE id % 2 = 1 GROUP BY name
""")
def sync_accumulate(t):
    g = t("events").select(F.col("event_type").alias("name"), F.when(F.col("user_id") % 2 == 0, F.col("user_id")).alias("id"), F.array("value").alias("vec"), (F.col("event_id") % 10).alias("version"))
    dense, sparse = updates.accumulate(updates.accepted(g, 9, 2), 1, 2)
    both = sparse.unionByName(dense.withColumn("id", F.lit(None).cast("bigint")))
    return both.select("name", "id", _r(F.col("vec")[0], 4).alias("x"))


@query("SELECT event_id, round(0.1 / greatest(1, 9 - event_id % 10), 6) AS lr FROM events")
def staleness(t):
    return t("events").select("event_id", _r(updates.stale_rate(0.1, F.lit(9), F.col("event_id") % 10)).alias("lr"))


def _scored(t) -> DataFrame:
    docs = t("documents").select("doc_id", (F.col("n_chars") % 1000 / 1000.0).alias("p"))
    return t("labels").select("doc_id", "quality").join(docs, "doc_id")


_SCORED = "s AS (SELECT quality AS y, (n_chars % 1000) / 1000.0::DOUBLE AS p FROM labels JOIN documents USING (doc_id))"


@query(f"WITH {_SCORED} SELECT round(avg(((p > 0.5)::INT = y)::INT::DOUBLE), 6) AS accuracy, round(avg(greatest(4 * p - 2, 0) - (4 * p - 2) * y + ln(1 + exp(-abs(4 * p - 2)))), 6) AS loss FROM s")
def accuracy_and_loss(t):
    logit = F.col("p") * 4 - 2
    return metrics.evaluate(_scored(t), {"accuracy": _r(metrics.accuracy(F.col("p"), F.col("quality"))), "loss": _r(metrics.sigmoid_cross_entropy(logit, F.col("quality")))})


@query(f"""
WITH {_SCORED}, b AS (SELECT least(floor(p * 199), 198) AS bin, sum(y)::DOUBLE AS p1, sum(1 - y)::DOUBLE AS n1 FROM s GROUP BY 1),
c AS (SELECT *, sum(p1) OVER (ORDER BY bin DESC) AS tp FROM b) SELECT round(sum(n1 * (tp - p1 / 2)) / (sum(p1) * sum(n1)), 6) AS auc FROM c
""")
def auc(t):
    return metrics.auc(_scored(t), "p", "quality").select(_r(F.col("auc")).alias("auc"))


@query(f"""
WITH {_SCORED}, b AS (SELECT p, sum(y)::DOUBLE AS p1, sum(1 - y)::DOUBLE AS n1 FROM s GROUP BY 1),
c AS (SELECT *, coalesce(sum(n1) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b) SELECT round(sum(p1 * (below + n1 / 2)) / (sum(p1) * sum(n1)), 6) AS auc FROM c
""")
def exact_auc(t):
    return metrics.exact_auc(_scored(t), "p", "quality").select(_r(F.col("auc")).alias("auc"))


@query("""
WITH v AS (SELECT label % 64 AS y, embedding AS z, list_position(embedding, list_max(embedding)) - 1 AS best FROM embeddings)
SELECT round(avg((best = y)::INT::DOUBLE), 6) AS accuracy,
       round(avg(ln(list_sum(list_transform(z, lambda x: exp(x::DOUBLE - list_max(z)::DOUBLE)))) + list_max(z)::DOUBLE - z[y + 1]::DOUBLE), 6) AS loss FROM v
""")
def argmax_and_softmax(t):
    df = t("embeddings").select(F.col("embedding").cast("array<double>").alias("z"), (F.col("label") % DIM).alias("y"))
    return metrics.evaluate(df, {"accuracy": _r(metrics.argmax_accuracy(F.col("z"), F.col("y"))), "loss": _r(metrics.softmax_cross_entropy(F.col("z"), F.col("y")))})


@query("SELECT o_orderkey, round(0.5 * o_totalprice - 2.0 * o_custkey + 1, 4) AS score FROM orders")
def scored(t):
    found = scoring.score(t("orders").select("o_orderkey", "o_totalprice", "o_custkey"), scoring.find("predictor", "linear")([0.5, -2.0], 1.0), ["o_totalprice", "o_custkey"])
    return found.select("o_orderkey", _r(F.col("score"), 4).alias("score"))


@query(f"WITH {_SCORED} SELECT round(avg(((p > 0.5)::INT = y)::INT::DOUBLE), 6) AS at_half, round(avg(((p > 0.25)::INT = y)::INT::DOUBLE), 6) AS at_quarter, round(avg(abs(p - y)), 6) AS distance FROM s")
def metrics_by_output(t):
    hit = lambda at: metrics.accuracy(F.col("p"), F.col("quality"), at)
    found = metrics.nested(_scored(t), {"one": {"half": hit(0.5), "distance": scoring.average(F.abs(F.col("p") - F.col("quality")))}, "two": {"quarter": hit(0.25)}})
    return found.select(_r(F.col("one.half")).alias("at_half"), _r(F.col("two.quarter")).alias("at_quarter"), _r(F.col("one.distance")).alias("distance"))


@query("SELECT event_id % 10 AS version, round(avg(((value > 50)::INT = user_id % 2)::INT::DOUBLE), 6) AS accuracy FROM events WHERE (event_id % 10) % 3 = 0 AND event_id % 10 > 2 GROUP BY 1")
def versioned_evaluation(t):
    df = t("events").select((F.col("event_id") % 10).alias("version"), "value", (F.col("user_id") % 2).alias("y"))
    df = df.where(metrics.due(F.col("version"), 3, 2))
    return metrics.evaluate(df, {"accuracy": _r(metrics.accuracy(F.col("value"), F.col("y"), 50.0))}, ["version"])


@query(f"""
WITH v AS (SELECT p_brand AS w, row_number() OVER (ORDER BY count(*) DESC, p_brand) - 1 AS id FROM part GROUP BY p_brand), n AS (SELECT count(*) AS k FROM v),
f AS (SELECT p_partkey, v.id AS brand, (p_size >= 10)::INT + (p_size >= 20)::INT + (p_size >= 30)::INT AS size, {_FOLD.format("p_brand || '_X_' || p_size", 100)} AS crossed, k FROM part JOIN v ON p_brand = w, n)
SELECT p_partkey, pos::BIGINT AS pos, id::BIGINT AS id FROM (SELECT p_partkey, unnest(range(0, 3)) AS pos, unnest([brand, size + k + 1, crossed + k + 1 + 4]) AS id FROM f)
""")
def feature_plan_group(t):
    df = t("part")
    plan = FeaturePlan(
        [
            Step("ids", "group", ["brand", "size", "brand_size"]),
            Step("brand", "lookup", ["p_brand"]),
            Step("size", "bucketize", ["p_size"], {"boundaries": [10.0, 20.0, 30.0]}),
            Step("brand_size", "cross", ["p_brand", "p_size"], {"bins": 100}),
        ]
    ).fit(df)
    ids = FeaturePlan.from_json(plan.to_json()).apply(df, ["ids"], ["p_partkey"])
    return ids.select("p_partkey", F.posexplode("ids").alias("pos", "id")).select("p_partkey", F.col("pos").cast("bigint").alias("pos"), "id")


@query("SELECT l_orderkey, l_extendedprice, l_shipmode FROM (SELECT l_orderkey, l_extendedprice, l_returnflag AS l_shipmode FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 10)")
def pruned_scan(t):
    df = t("lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_quantity") < 10))
    return df.select("l_orderkey", "l_extendedprice", F.col("l_returnflag").alias("l_shipmode"))


@query("SELECT event_id FROM events WHERE props IS NOT NULL AND props <> ''")
def nonempty_records(t):
    return readers.nonempty(t("events"), "props").select("event_id")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) = 1")
def first_turns(t):
    return readers.first_of(t("conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn", "role"])


@query("SELECT o_orderkey, coalesce(o_custkey, 0) AS customer, coalesce(o_totalprice, 0)::FLOAT::DOUBLE AS price, octet_length(encode(trim(o_orderpriority)))::BIGINT AS n FROM orders")
def typed_records(t):
    made = readers.typed_record(t("orders").select("o_orderkey", F.col("o_custkey").alias("customer"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("b")), {"o_orderkey": "int", "customer": "int", "price": "float", "b": "bytes"})
    return made.select("o_orderkey", "customer", F.col("price").cast("double").alias("price"), F.octet_length("b").cast("bigint").alias("n"))
