"""Generators, masks, keys and a whole run as DataFrames."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from seedplane.engine import Engine, violations
from seedplane.functions import generators as G
from seedplane.functions.dialect import SPARK
from seedplane.functions.generators import Cell
from seedplane.functions.masks import Masker
from seedplane.model import MaskRule, Request
from seedplane.operators import keys, verify
from seedplane.sources.commerce import commerce, parse
from seedplane.sources.export import csv_line


def cell(column="c", seed=7, attempt="0"):
    return Cell(SPARK, seed, "public.t", column, attempt=attempt)


def rows(spark, n, *columns):
    return spark.range(n).select(F.col("id").alias("__row")).select("__row", *[F.expr(sql).alias(f"v{i}") for i, sql in enumerate(columns)])


def test_values_do_not_depend_on_partitions(spark):
    sql = [G.email(cell()), G.uuid(cell()), G.money(cell()), G.free_text(cell(), 60)]
    once = sorted(rows(spark, 200, *sql).collect())
    for n in (1, 3, 7):
        again = spark.range(200).repartition(n).select(F.col("id").alias("__row")).select("__row", *[F.expr(x).alias(f"v{i}") for i, x in enumerate(sql)])
        assert sorted(again.collect()) == once
    assert sorted(rows(spark, 80, *sql).collect()) == once[:80]
    assert sorted(rows(spark, 200, G.email(cell(seed=8))).collect()) != [(r[0], r[1]) for r in once]


def test_generated_shapes(spark):
    df = rows(spark, 500, G.email(cell(), True), G.ssn(cell()), G.credit_card(cell()), G.iban(cell()), G.unique_text(cell(), 8), G.nullable(cell(), G.title(cell())), G.money(cell(), 5, 2), G.int_in_range(cell(), 1, 5), G.uuid(cell()))
    assert df.select("v0").distinct().count() == df.select("v4").distinct().count() == 500
    assert df.filter(~F.col("v1").rlike(r"^9\d\d-\d\d-\d{4}$")).isEmpty()
    assert df.filter(f"not {verify.luhn_valid('v2')} or length(v2) <> 16").isEmpty()
    assert df.filter(f"not {verify.iban_valid('v3')}").isEmpty()
    assert 1 <= df.filter("v5 is null").count() <= 120
    assert df.filter("v6 is null or v6 >= 1000 or v7 not between 1 and 5 or length(v4) > 8").isEmpty()
    assert df.filter(~F.col("v8").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")).isEmpty()


@pytest.mark.parametrize("value", ["x", "", "é日本", "a" * 200])
@pytest.mark.parametrize("key", ["k", "k" * 100])
def test_hmac_is_hmac(spark, value, key):
    part = lambda b: len(b).to_bytes(4, "big") + b
    want = hmac.new(key.encode(), part(b"s") + part(b"") + part(value.encode()), hashlib.sha256).hexdigest()
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(F.expr(Masker(SPARK, key, "s").digest("v"))).first()[0] == want


def test_masks_keep_formats(spark):
    m = Masker(SPARK, "key", "salt")
    one = lambda sql, v: spark.createDataFrame([(v,)], "v string").select(F.expr(sql)).first()[0]
    assert one(m.phone("v"), "+49 (30) 123-4567") != "+49 (30) 123-4567"
    assert "".join(c for c in one(m.phone("v"), "+49 (30) 123-4567") if not c.isdigit()) == "+ () -"
    card = one(m.credit_card("v"), "4111-1111-1111-1111")
    assert card[0] == "4" and [i for i, c in enumerate(card) if c == "-"] == [4, 9, 14]
    assert spark.range(1).filter(verify.luhn_valid(f"'{card.replace('-', '')}'")).count() == 1
    assert spark.range(1).filter(verify.iban_valid(f"'{one(m.iban('v'), 'DE89 3704 0044 0532 0130 00')}'")).count() == 1
    assert one(m.partial("v"), "8.8.8.8").startswith(("192.0.2.", "198.51.100.", "203.0.113."))
    assert one(m.partial("v"), "Berlin")[0] == "B" and one(m.partial("v"), "Berlin")[-1] == "n"
    assert " " in one(m.name("v"), "Jo Doe") and " " not in one(m.name("v"), "Jo")
    assert one(m.tokenize("v"), "x") == one(m.tokenize("v"), "x") != one(Masker(SPARK, "key", "other").tokenize("v"), "x")
    for strategy in ("redact", "hash", "tokenize", "partial", "email", "phone", "name", "ssn", "credit_card", "iban"):
        assert one(getattr(m, strategy)("v"), None) is None
    with pytest.raises(ValueError):
        Masker(SPARK, "  ")


def test_masked_values_stay_distinct_and_jitter_stays_near(spark):
    m = Masker(SPARK, "key")
    df = spark.range(5000).select(F.expr("concat('value-', id)").alias("v")).select(F.expr(m.tokenize("v")).alias("t"))
    assert df.distinct().count() == 5000
    near = spark.range(1, 500).select(F.expr("cast(id as double)").alias("v")).select("v", F.expr(m.jitter("v", 10)).alias("j"))
    assert near.filter("abs(j - v) > 0.1 * v + 0.01").isEmpty()


def test_draws_and_junctions(spark):
    df = rows(spark, 1000, keys.draw_index(cell(), "fk", 40), keys.draw_self(cell(), "self"), *keys.junction_indices("__row", [25, 60], 5))
    assert df.filter("v0 not between 0 and 39").isEmpty() and df.select("v0").distinct().count() == 40
    assert df.filter("v1 >= __row or (__row = 0 and v1 is not null)").isEmpty() and 100 < df.filter("v1 is null").count() < 320
    assert df.select("v2", "v3").distinct().count() == 1000 and df.filter("v2 not between 0 and 24 or v3 not between 0 and 59").isEmpty()
    big = rows(spark, 1000, *keys.junction_indices(f"__row + {2**40}", [10**7, 10**7], 5))
    assert big.select("v0", "v1").distinct().count() == 1000


def test_pool_and_unique_rounds(spark):
    parent = spark.createDataFrame([(i, i % 3 if i != 4 else None) for i in range(50)], "a int, b int")
    pool = keys.pooled(parent, ["a", "b"], "a").orderBy("pool_ix").collect()
    assert [r.pool_ix for r in pool] == list(range(49)) and [r.a for r in pool] == [i for i in range(50) if i != 4]
    base = spark.range(300).select(F.col("id").alias("__row"))
    made = lambda df: df.withColumns({"k": F.expr(cell("k", attempt="__attempt").below(400)), "g": F.expr(f"case when __row % 10 = 0 then null else {cell('g', attempt='__attempt').below(1000)} end")})
    got = made(keys.unique_rounds(base, made, [["k"], ["g"]]))
    assert got.count() == 300 and got.select("k").distinct().count() == 300
    assert got.filter("g is null").count() == 30 and got.filter("g is not null").select("g").distinct().count() == 270
    few = keys.unique_rounds(base, lambda df: df.withColumn("k", F.expr(cell("k", attempt="__attempt").below(10))), [["k"]], tries=20)
    assert few.count() <= 10


def test_verify_operators(spark):
    child = spark.createDataFrame([(1, 1), (2, None), (3, 9)], "id int, p int")
    assert [r.id for r in verify.orphans(child, ["p"], spark.createDataFrame([(1,)], "q int"), ["q"]).collect()] == [3]
    assert verify.duplicates(spark.createDataFrame([(1, 1), (1, 1), (None, 1), (None, 1)], "a int, b int"), ["a", "b"]).collect()[0].copies == 2
    assert verify.failing(child, F.col("p") > 5).count() == 1


SMALL = """
account: id int4!, email varchar(40)! U, note text, kind varchar(10)! | C kind = ANY (ARRAY['A'::text, 'B'::text])
product: id int4!, code varchar(8)! U, price numeric(5.2)! | C (price > 0)
basket: account_id int4! >account, product_id int4! >product, quantity int4! | P account_id product_id | C ((quantity >= 1) AND (quantity <= 3))
step: basket_account int4!, basket_product int4!, n int4!, day date! | P n | F fk_step account_id product_id > basket
"""


def test_small_run_holds_every_rule(spark, tmp_path):
    schema = parse(SMALL.split("step:")[0], "public")
    request = Request(scale=30, seed=5, rules=(MaskRule("account", "email", "EMAIL"), MaskRule("account", "note", "NULLIFY")))
    plan = Engine(spark, schema, "key", "salt").run(request, str(tmp_path / "a"))
    assert plan.rows["basket"] <= 30 * 30 * 3 // 4
    assert violations(spark, schema, plan, str(tmp_path / "a")).filter("n > 0").collect() == []
    account = spark.read.parquet(str(tmp_path / "a" / "account"))
    assert account.filter("note is not null").isEmpty() and account.filter(~F.col("email").rlike(r"@example\.(com|net|org)$")).isEmpty()
    Engine(spark, schema, "key", "salt").regenerate(request, str(tmp_path / "b"))
    for t in plan.order.tables:
        a, b = (sorted(spark.read.parquet(str(tmp_path / x / t)).collect()) for x in "ab")
        assert a == b


def test_commerce_schema_parses():
    s = commerce()
    assert s.tables["order_header"].column("status").labels[0] == "DRAFT" and s.tables["customer"].column("tags").element == "text"


def test_csv_tells_null_from_empty(spark):
    df = spark.createDataFrame([("a\"b", None, ""), (None, "x,y", "z")], "a string, b string, c string")
    assert [r[0] for r in df.select(csv_line(["a", "b", "c"])).collect()] == ['"a""b",,""', ',"x,y","z"']


def test_registry_is_consistent(spark):
    queries, oracle = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 60
    assert __spark_entry__.entry(spark).limit(5).count() == 5
