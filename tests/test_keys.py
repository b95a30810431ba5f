import random
import uuid

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnfold.functions import canonical_key, key_of

GOLDEN = {
    "herobrine": "9fb3489b-f92f-5e3e-a3d1-96dd50ca0107", "alex": "38da20a7-55d2-56c2-b8cf-d5a82f2a6535",
    "steve": "94d0dcf2-cbd4-50e6-b78b-4ef2ded84bc3", "notch": "69f38757-2629-5a0e-b564-0268681e0d75",
    "0": "bf428e1d-f221-55de-a77f-a61755a4d727", "user:1001": "b8b2f1f6-b3cf-5182-8b0b-05e3d0695c1c",
    "é": "4c9d8941-1dcb-56d3-9fe5-b5aef28ef637", " event:0\t": "10f885c9-3bb3-5d5c-973b-8f85f4141217",
    "000000000000000000000000000000FF": "00000000-0000-0000-0000-0000000000ff",
    "38DA20A7-55D2-56C2-B8CF-D5A82F2A6535": "38da20a7-55d2-56c2-b8cf-d5a82f2a6535",
}


def test_golden_keys_in_python_and_in_spark(spark):
    rows = spark.createDataFrame([(k,) for k in GOLDEN], "k string").select("k", canonical_key(F.col("k")).alias("key")).collect()
    assert {r.k: r.key for r in rows} == GOLDEN == {k: key_of(k) for k in GOLDEN}


def test_many_keys_agree(spark):
    dice = random.Random(4)
    texts = ["".join(dice.choice("aZ9é-:日 ") for _ in range(dice.randint(1, 40))) + "x" for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "k string").select("k", canonical_key(F.col("k")).alias("key")).collect()
    assert all(r.key == key_of(r.k) for r in rows)


def test_blank_keys(spark):
    assert spark.createDataFrame([("  ",), (None,)], "k string").select(canonical_key(F.col("k")).alias("key")).collect() == [(None,), (None,)]
    with pytest.raises(ValueError):
        key_of(" \t")


@given(st.integers(0, 2**128 - 1), st.integers(0, 2**128 - 1))
def test_order_of_keys_is_that_of_numbers(a, b):
    assert (str(uuid.UUID(int=a)) < str(uuid.UUID(int=b))) == (a < b)
