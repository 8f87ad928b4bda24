"""Tiers of equal keys against the pairs of every reference with every candidate."""

from siltworks.operators import joining as J


def test_key_tiers_like_pairs_without_making_them(spark):
    refs = spark.createDataFrame([(i, i % 7, i % 5 if i % 11 else None) for i in range(200)] + [(None, 1, 1)], "ref long, a int, b int")
    targets = [spark.createDataFrame(rows, "target long, a int, b int") for rows in ([(1000 + i, i % 3, i % 4) for i in range(4)], [(2000 + i % 3, 5 + i % 2, None) for i in range(9)] + [(None, 3, 0)], [(3000 + i, None, i % 2) for i in range(3)])]
    keys = [["a", "b"], ["a"], ["b"]]
    pairs = [refs.join(t, k).select("ref", t["target"]) for t, k in zip(targets, keys, strict=True)]
    want = J.resolve_in_tiers(refs, pairs, "ref", "target")
    got = J.resolve_in_key_tiers(refs, list(zip(targets, keys, strict=True)), "ref", "target")
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_references_of_one_key_are_not_paired_with_its_targets(spark):
    n = 3000
    refs, targets = spark.range(n).selectExpr("id AS ref", "1 AS a"), spark.range(n).selectExpr("id AS target", "1 AS a")
    got = J.resolve_in_key_tiers(refs, [(targets, ["a"])], "ref", "target")
    assert got.where("tier = 0 AND resolution_status = 'ambiguous' AND target_id IS NULL").count() == n
    node = got._jdf.queryExecution()
    assert node.optimizedPlan().toString().count("Join") == 1 and "Aggregate" in node.optimizedPlan().toString().split("Join", 1)[1]
