import os

import pytest
from pyspark.sql import functions as F

from evalspark.plans.shared import new_folder, shared_folder
from evalspark.sources import jsonl as J
from evalspark.sources import snapshots as S

ENTRY = '{"run_id":"r","iter":%d,"batch":1,"ts":"2024-01-01T00:00:0%d","artifact_hash":"h","parent":null,"plan_id":"p","rationale":"w","artifact":"a","metrics_train":{"kappa":0.3},"metrics_dev":{"kappa":0.2},"metrics_test":{"kappa":0.1},"extra":1}'


def write(tmp_path, name, lines):
    path = tmp_path / name
    path.write_text("\n".join(lines))
    return str(path)


def test_examples(spark, tmp_path):
    lines = ['{"id":1,"input":"a","label":"A","domain":"m"}', "", '{"id":2,"input":"b","ground_truth":"B","domain":"m"}', '{"id":3,"input":"c"}', '{"id":4,"inp']
    path = write(tmp_path, "x.jsonl", lines)
    with pytest.raises(Exception, match="bad example line"):
        J.read_examples(spark, path).collect()
    assert [r.line for r in J.bad_example_lines(spark, path).collect()] == ['{"id":4,"inp']
    found = J.read_examples(spark, path, bad_lines="skip").orderBy("id")
    assert found.columns == ["id", "input", "label", "domain"]
    assert [tuple(r) for r in found.collect()] == [(1, "a", "A", "m"), (2, "b", "B", "m"), (3, "c", "", None)]


def test_text_ids_fail_and_other_keys_are_kept(spark, tmp_path):
    path = write(tmp_path, "k.jsonl", ['{"id":"q-1","input":"a","label":"A"}'])
    with pytest.raises(Exception, match="q-1"):
        J.read_examples(spark, path).collect()
    path = write(tmp_path, "m.jsonl", ['{"id":1,"input":"a","label":"A","year":1999,"by":"me"}', '{"id":2,"input":"b"}'])
    found = {r.id: r.rest for r in J.read_examples(spark, path, other_keys="rest").collect()}
    assert found == {1: {"year": "1999", "by": "me"}, 2: {}}


def test_splits_round_trip(spark, tmp_path):
    data = [(1, "t1", "A", "m", "train"), (2, "d1", "B", "m", "dev"), (3, "x1", "C", None, "test")]
    df = spark.createDataFrame(data, "id bigint, input string, label string, domain string, split string")
    J.write_splits(df, str(tmp_path / "splits"))
    assert {f"split={s}" for s in ("train", "dev", "test")} <= set(os.listdir(tmp_path / "splits"))
    assert sorted(tuple(r) for r in J.read_splits(spark, str(tmp_path / "splits")).collect()) == data


def test_scorer_output(spark):
    lines = ['{"prediction":"A"}', '{"label":"B"}', "{}", "yes", "4", '{"prediction":null,"label":"B"}', '{"prediction": 4}', '{"cut', "", '["x"]']
    df = spark.createDataFrame(list(enumerate(lines)), "n int, line string")
    found = {r.n: r.prediction for r in J.parse_scorer_output(df).collect()}
    assert found == {0: "A", 1: "B", 2: "", 3: "yes", 4: "4", 5: "", 6: "4", 7: '{"cut', 9: '["x"]'}


def test_log_with_bad_lines(spark, tmp_path):
    path = write(tmp_path, "log.jsonl", [ENTRY % (1, 1), "", "not json", ENTRY % (2, 2), (ENTRY % (3, 3))[:40]])
    flat = J.flat_log(J.read_log(spark, path)).orderBy("iter").collect()
    assert [(r.iter, r.kappa_dev, r.f1_dev, r.parent) for r in flat] == [(1, 0.2, None, None), (2, 0.2, None, None)]
    report = J.log_integrity(spark, path).first()
    assert report.file.endswith("log.jsonl") and (report.valid, report.corrupt) == (2, 2)


def test_append_is_idempotent(spark, tmp_path):
    path, log = str(tmp_path / "log"), write(tmp_path, "log.jsonl", [ENTRY % (1, 1), ENTRY % (2, 2)])
    rows = J.read_log(spark, log)
    J.append_log(rows.where("iter = 1"), path)
    before = {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.startswith("part")}
    J.append_log(rows, path, existing=J.read_log(spark, path))
    J.append_log(rows, path, existing=J.read_log(spark, path))
    assert sorted(r.iter for r in J.read_log(spark, path).collect()) == [1, 2]
    after = {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.startswith("part")}
    assert before.items() <= after.items()
    assert J.log_rewrites(J.read_log(spark, log), J.read_log(spark, path)).isEmpty()


def test_rewrites_and_duplicates(spark, tmp_path):
    rows = J.read_log(spark, write(tmp_path, "log.jsonl", [ENTRY % (1, 1), ENTRY % (2, 2)]))
    changed = rows.withColumn("parent", F.when(F.col("iter") == 2, F.lit(1)))
    assert [r.iter for r in J.log_rewrites(rows, changed).collect()] == [2]
    assert [r.iter for r in J.log_rewrites(rows, rows.where("iter = 1")).collect()] == [2]
    assert [(r.iter, r.copies) for r in J.duplicate_entries(rows.union(rows.where("iter = 1"))).collect()] == [(1, 2)]


def test_snapshots_are_compared_where_they_differ(spark):
    """Changed, lost, doubled and added rows in two of three runs; rows of other blocks are not read."""
    rows = [(r, i, f"t{i}", None if i % 3 else float(i)) for r in "abc" for i in range(60)]
    old = spark.createDataFrame(rows, "run_id string, iter bigint, text string, kappa double")
    new = [(r, i, "other" if (r, i) == ("a", 17) else t, 0.0 if (r, i) == ("a", 18) else k) for r, i, t, k in rows if (r, i) != ("b", 40)]
    new = spark.createDataFrame([*new, ("b", 41, "t41", None), ("b", 99, "more", None), ("d", 1, "new run", None)][::-1], old.schema)
    paths = new_folder(spark, "snapshot"), new_folder(spark, "snapshot")
    for df, path in zip((old, new), paths, strict=True):
        S.write_snapshot(df.repartition(3), path, 10)
    digests = [S.read_digests(spark, p) for p in paths]
    blocks = S.changed_blocks(*digests)
    assert {tuple(r) for r in blocks.collect()} == {("a", 1), ("b", 4)}
    want = {tuple(r) for r in J.log_rewrites(old, new).collect()}
    assert {tuple(r) for r in S.snapshot_rewrites(spark, *paths, old).collect()} == want == {("a", 17), ("a", 18), ("b", 40)}
    assert S.rows_to_compare(spark, paths[0], old, blocks).count() == 20  # of 180
    # Digests of two appends add up to those of the whole, in any order.
    parts = S.block_digests(old.where("iter < 25"), 10).unionByName(S.block_digests(old.where("iter >= 25"), 10))
    assert S.changed_blocks(S.added(parts), digests[0]).isEmpty() and S.changed_blocks(digests[0], S.added(parts)).isEmpty()


def test_log_rows_round_trip(spark, tmp_path):
    rows = J.read_log(spark, write(tmp_path, "log.jsonl", [ENTRY % (1, 1)]))
    back = J.flat_log(J.log_rows(J.flat_log(rows))).first()
    assert (back.kappa_train, back.kappa_dev, back.kappa_test, back.f1_dev) == (0.3, 0.2, 0.1, None)


def test_shared_folder_is_the_clusters(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_folder(spark) == (named or spark.sparkContext.getCheckpointDir())
    assert new_folder(spark, "a") != new_folder(spark, "a")


def test_cluster_without_shared_folder_is_refused():
    class Unset:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: None)})
        sparkContext = type("S", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "yarn"})

    with pytest.raises(ValueError):
        shared_folder(Unset)
