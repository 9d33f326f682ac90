import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelweave.operators.folds import greedy_phases, group_folds
from labelweave.operators.ordered import running_totals


def test_running_totals_with_one_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 7}", rng.randint(0, 5), i, rng.randint(0, 9)) for i in range(3000)]
    frame = pd.DataFrame(rows, columns=["g", "p", "id", "v"])
    got = running_totals(
        spark.createDataFrame(frame), [F.col("p").desc(), F.col("id").asc()], {"upto": F.col("v"), "rank": F.lit(1)}, ["g"]
    ).toPandas()
    frame = frame.sort_values(["g", "p", "id"], ascending=[True, False, True])
    frame["upto"] = frame.groupby("g")["v"].cumsum()
    frame["rank"] = frame.groupby("g").cumcount() + 1
    want = frame.set_index("id")[["upto", "rank"]].sort_index()
    got = got.set_index("id")[["upto", "rank"]].sort_index()
    assert (got.values == want.values).all()


def naive(sizes, k):
    loads, out = [0] * k, []
    for size in sizes:
        fold = min(range(k), key=lambda f: (loads[f], f))
        loads[fold] += size
        out.append(fold)
    return out, loads


@pytest.mark.parametrize("k", [2, 3, 5])
def test_phases_equal_the_greedy_pass(k):
    rng = random.Random(k)
    for _ in range(200):
        classes = sorted({rng.randint(1, 30): rng.randint(1, 25) for _ in range(rng.randint(1, 8))}.items(), reverse=True)
        sizes = [s for s, n in classes for _ in range(n)]
        loads, got = [0] * k, []
        for size, count in classes:
            phases = greedy_phases(loads, size, count)
            for rank in range(count):
                first, cycle = [p for p in phases if p[0] <= rank][-1]
                got.append(cycle[(rank - first) % len(cycle)])
        want, want_loads = naive(sizes, k)
        assert got == want
        assert loads == want_loads


def test_groups_stay_together_and_folds_balance(spark):
    rows = [(i, "common" if i % 3 == 0 else f"s{i % 91}") for i in range(900)]
    df = spark.createDataFrame(rows, "row_idx bigint, sequence string")
    got = group_folds(df, 3).join(df, "row_idx").toPandas()
    assert len(got) == 900
    assert (got.groupby("sequence")["fold"].nunique() == 1).all()
    assert got.groupby("fold").size().max() - got.groupby("fold").size().min() <= 15
