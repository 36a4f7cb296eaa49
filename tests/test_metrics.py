import itertools

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalspark.operators import metrics as M
from evalspark.operators.ranking import average_ranks

CASES = {
    "perfect": ("xyzzx", "xyzzx", 1.0, 1.0, 0.0),
    "constant": ("yyy", "xyz", 0.0, 1 / 6, 0.0),
    "half": ("xyxy", "xxyy", 0.0, 0.5, 0.0),
    "numeric": ("248", "248", 1.0, 1.0, 1.0),
    "reverse": ("842", "248", None, None, -1.0),
    "one class": ("AA", "AA", 0.0, 1.0, 0.0),
    "constant numeric": ("111", "123", 0.0, None, 0.0),
    "padded": (["A", ""], ["A", "B"], 1 / 3, 1 / 3, 0.0),
}


def frame(spark, cases):
    data = [(g, y, p) for g, (ps, ys) in cases.items() for p, y in zip(ps, ys)]
    return spark.createDataFrame(data, "g string, label string, prediction string")


def test_hand_computed_cases(spark):
    df = frame(spark, {g: c[:2] for g, c in CASES.items()})
    groups = spark.createDataFrame([(g,) for g in [*CASES, "empty"]], "g string")
    found = {r.g: r for r in M.all_metrics(df, ["g"], groups=groups).collect()}
    assert set(found) == {*CASES, "empty"}
    for name, (_, _, kappa, f1, rho) in CASES.items():
        for want, have in ((kappa, found[name].kappa), (f1, found[name].f1), (rho, found[name].spearman)):
            if want is not None:
                assert have == pytest.approx(want, abs=1e-12), name
    assert found["empty"][1:] == (0.0, 0.0, 0.0)


def test_ordinal_labels_and_unknown_ones(spark):
    order = {"low": 1, "middle": 2, "high": 3}
    scale = list(order)
    df = frame(spark, {"same": (scale, scale), "unknown": (["low", "middle", "odd"], ["middle", "high", "low"])})
    found = {r.g: r.spearman for r in M.spearman(df, ["g"], label_order=order).collect()}
    assert found["same"] == pytest.approx(1.0)
    # predictions 1, 2, 0 against labels 2, 3, 1
    assert found["unknown"] == pytest.approx(1.0)


def brute_kappa(pairs):
    n = len(pairs)
    classes = {x for p in pairs for x in p}
    hits = sum(y == p for y, p in pairs)
    chance = sum(sum(y == c for y, _ in pairs) * sum(p == c for _, p in pairs) for c in classes)
    return 0.0 if n * n == chance else (n * hits - chance) / (n * n - chance)


def brute_rho(pairs):
    x, y = (pd.Series([float(p[i]) for p in pairs]).rank() for i in (0, 1))
    if x.nunique() < 2 or y.nunique() < 2:
        return 0.0
    return x.corr(y)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from("0123"), st.sampled_from("0124")), min_size=1, max_size=30), min_size=1, max_size=8))
def test_random_groups_against_brute_force(spark, groups):
    data = [(str(i), y, p) for i, g in enumerate(groups) for y, p in g]
    df = spark.createDataFrame(data, "g string, label string, prediction string").repartition(3)
    swapped = df.select("g", F.col("prediction").alias("label"), F.col("label").alias("prediction"))
    here = {r.g: r for r in M.all_metrics(df, ["g"]).collect()}
    there = {r.g: r.kappa for r in M.cohen_kappa(swapped, ["g"]).collect()}
    for i, pairs in enumerate(groups):
        assert here[str(i)].kappa == pytest.approx(brute_kappa(pairs), abs=1e-12)
        assert here[str(i)].spearman == pytest.approx(brute_rho(pairs), abs=1e-9)
        assert here[str(i)].kappa == there[str(i)]


def test_average_ranks(spark, rows):
    data = [("hot" if i % 3 else "cold", float(v), 1 + v % 4) for i, v in enumerate(itertools.chain(range(500), range(-50, 0)))]
    df = spark.createDataFrame(data, "g string, v double, w bigint").groupBy("g", "v").agg(F.sum("w").alias("w"))
    plain = rows(average_ranks(df, ["g"], "v", "w"))
    expected = pd.DataFrame(data, columns=["g", "v", "w"])
    expected = expected.loc[expected.index.repeat(expected.w)]
    expected["r"] = expected.groupby("g").v.rank()
    expected["c"] = 2 * expected.r - expected.groupby("g").v.transform("size") - 1
    want = {(g, v): c for g, v, c in expected[["g", "v", "c"]].drop_duplicates().itertuples(index=False)}
    assert {(g, v): c for g, v, _, c in plain} == want


def test_rho_of_hot_values_and_null_groups(spark):
    data = [("hot" if i % 3 else "cold", str(5 if i % 4 else i * 7 % 11), str(i * i % 13)) for i in range(300)] + [("bad", "1", "x"), (None, "1", "2"), (None, "2", "3")]
    df = spark.createDataFrame(data, "g string, label string, prediction string")
    found = {r.g: r.spearman for r in M.spearman(df, ["g"]).collect()}
    for group in ("hot", "cold", None):
        assert found[group] == pytest.approx(brute_rho([p[1:] for p in data if p[0] == group]))
    assert found["bad"] == 0.0 and len(found) == 4


def test_large_counts_do_not_overflow(spark):
    cells = spark.createDataFrame(
        [("g", "1", "1", 4 * 10**11), ("g", "1", "2", 10**11), ("g", "2", "1", 10**11), ("g", "2", "2", 4 * 10**11)],
        "g string, label string, prediction string, n bigint",
    )
    found = M.metrics_of_cells(cells, ["g"]).first()
    assert (found.kappa, found.f1, found.spearman) == pytest.approx((0.6, 0.8, 0.6))


def test_values_that_are_no_numbers(spark):
    df = frame(spark, {"suffix": (["1d", "2"], ["1", "2"]), "blank": ([" 1 ", "2.5e1"], ["1", "3"]), "nan": (["nan", "1"], ["1", "2"])})
    found = {r.g: r.spearman for r in M.spearman(df, ["g"]).collect()}
    assert found == {"suffix": 0.0, "blank": pytest.approx(1.0), "nan": 0.0}


def test_null_group_keys_are_kept(spark):
    df = spark.createDataFrame([(None, "1", "1"), (None, "2", "2"), ("a", "1", "2")], "g string, label string, prediction string")
    found = {r.g: r.kappa for r in M.all_metrics(df, ["g"]).collect()}
    assert found == {None: 1.0, "a": 0.0}


def test_delta_and_string(spark):
    maps = "map<string,double>"
    df = spark.createDataFrame([({"kappa": 0.50, "f1": 0.75}, {"kappa": 0.75, "f1": 0.25, "new": 1.0})], f"a {maps}, b {maps}")
    delta = df.select(M.metric_delta("a", "b").alias("d")).first().d
    assert delta == {"delta_kappa": 0.25, "delta_f1": -0.5, "delta_new": 1.0}
    values = {"kappa": 0.0625, "f1": 0.9375, "spearman": -0.1, "x": -0.3125}
    text = spark.range(1).select(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]).alias("m"))
    # Python's own formatting rounds the exact binary value half to even.
    assert text.select(M.metrics_string("m")).first()[0] == f"κ={0.0625:.3f} F1={0.9375:.3f} ρ={-0.1:.3f} x={-0.3125:.3f}"
    assert text.select(M.metrics_string("m", 1)).first()[0] == f"κ={0.0625:.1f} F1={0.9375:.1f} ρ={-0.1:.1f} x={-0.3125:.1f}"


def test_combined_and_per_class(spark):
    data = [("d", "A", "A"), ("d", "B", "A"), ("t", "B", "B"), ("t", "A", "B")]
    df = spark.createDataFrame(data, "split string, label string, prediction string")
    found = {r.split: r for r in M.combined_kappa(df, {"both": ["d", "t"]}, ["split"]).collect()}
    assert found["both"].n == 4 and found["both"].kappa == pytest.approx(brute_kappa([(y, p) for _, y, p in data]))
    report = {(r.split, r["class"]): r for r in M.per_class_report(df, ["split"]).collect()}
    assert (report["d", "A"].precision, report["d", "A"].recall, report["d", "A"].support) == (0.5, 1.0, 1)
    assert (report["d", "B"].precision, report["d", "B"].recall) == (0.0, 0.0)


def test_confusion_matrix_loses_no_row(spark):
    rows = [("g", "a", "a"), ("g", "a", "b"), ("g", "a", None), ("g", "b", "zz"), ("g", None, "a"), ("g", None, "predicted_other")]
    found = M.confusion_matrix(spark.createDataFrame(rows, "g string, label string, prediction string"), ["a", "b"], ["g"])
    assert {tuple(r) for r in found.collect()} == {("g", "a", 1, 1, 1), ("g", "b", 0, 0, 1), ("g", None, 1, 0, 1)}
