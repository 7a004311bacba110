"""Lookups by many ids keep only wanted rows before they sort or exchange a source."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from tillstream.operators import finders, lookup


def plan_of(df) -> list[str]:
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain()
    return text.getvalue().splitlines()


def wallet(spark):
    return spark.range(1000).select(
        F.concat(F.lit("TXN"), F.col("id") % 400).alias("transaction_id"),
        F.col("id").alias("transId"),
        F.col("id").alias("ingest_ord"),
    )


def depth(lines: list[str], part: str) -> int:
    return next(i for i, line in enumerate(lines) if part in line)


def test_wanted_ids_are_joined_below_the_window(spark):
    keys = spark.createDataFrame([("TXN7",), ("407",), ("nothing",)], "transaction_id string")
    plan = plan_of(lookup.transaction_matches(keys, {"momo": wallet(spark)}))
    assert depth(plan, "WindowGroupLimit") < depth(plan, "LeftSemi")
    assert sum("Range (0, 1000" in line for line in plan) == 1


def test_matches_by_both_keys_and_the_first_copy(spark):
    keys = spark.createDataFrame([("TXN7",), ("407",), ("nothing",), (None,)], "transaction_id string")
    found = {r.transaction_id: r.data for r in lookup.transaction_matches(keys, {"momo": wallet(spark)}).collect()}
    assert set(found) == {"TXN7", "407"}
    assert '"ingest_ord":7' in found["TXN7"] and '"ingest_ord":407' in found["407"]


def test_wallet_lookup_takes_the_first_of_either_key(spark):
    """One scan of the keys and one of the answers, whatever the number of keys; no condition that joins rows one by one."""
    asked = spark.createDataFrame(
        [(1, "TXN7", None), (2, None, 500), (3, "TXN9", 3), (4, "none", None), (5, None, None)],
        "query_id int, order_id string, trans_id int",
    )
    either = {"order_id": "transaction_id", "trans_id": "transId"}
    answer = finders.wallet_lookup(wallet(spark), asked, either, ["transId"], {"transId": -1})
    assert sum("Range (0, 1000" in line for line in plan_of(answer)) == 2
    assert not any("NestedLoop" in line for line in plan_of(answer))
    got = {r.query_id: (r.found, r.transId) for r in answer.collect()}
    assert got == {1: (True, 7), 2: (True, 500), 3: (True, 3), 4: (False, -1), 5: (False, -1)}


def test_one_id_is_compared_in_the_type_of_its_column(spark):
    source = {"momo": wallet(spark)}
    assert lookup.find_transaction("407", source).count() == 1
    for other in ["0407", "407.0", "", "9" * 19, "9" * 30, "TXN"]:
        assert lookup.find_transaction(other, source).count() == 0


def test_lookup_meets_in_one_exchange_without_sorts(spark):
    """Wanted ids and the sources' are folded in one aggregate: no join or sort holds them in a task's memory."""
    wanted = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "transaction_id string")
    rows = lambda *ids: spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "transaction_id string, ingest_ord bigint")
    found = lookup.transaction_lookup(wanted, {"paypal": rows("b", "b", "c", None), "odoo": rows("b", "d")})
    assert {(r.transaction_id, tuple(r.found_in_sources), r.matches) for r in found.collect()} == {("a", (), 0), ("b", ("paypal", "odoo"), 2), (None, (), 0)}
    assert found.count() == 3
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Sort" not in plan
