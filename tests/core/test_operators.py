from __future__ import annotations

from itertools import product

import pytest
from pyspark.sql import functions as F

from tessera.functions import generators as g
from tessera.functions import rules
from tessera.functions.draws import Cell, prefix
from tessera.operators import assign, validate
from tessera.operators.ranks import numbered


def test_prefixes_differ():
    assert prefix(4, "2|t") != prefix(42, "t") and prefix(1, "a|b") != prefix(1, "a")


def test_draws_ignore_partitioning(spark):
    cell = Cell(1, "t", "c", F.col("id"))
    one = spark.range(500, numPartitions=1).select("id", cell.u()).collect()
    assert sorted(one) == sorted(spark.range(500, numPartitions=9).select("id", cell.u()).collect())
    values = [r[1] for r in one]
    assert 0 <= min(values) and max(values) < 1 and 0.45 < sum(values) / 500 < 0.55


def test_generator_limits(spark):
    cell = Cell(1, "t", "c", F.col("id"))
    with pytest.raises(g.GeneratorError):
        g.integer_range(cell, 3, 3, min_exclusive=True)
    with pytest.raises(g.GeneratorError):
        g.numeric_range(cell, "0.001", "0.009", 2)
    with pytest.raises(g.GeneratorError):
        g.choice(cell, [])
    with pytest.raises(g.GeneratorError):
        g.template(cell, "{nope}")
    with pytest.raises(g.GeneratorError):
        g.resolve("nope")
    low, high = spark.range(300).select(g.numeric_range(cell, -9.995, 9.995, 2, precision=3).alias("v")).agg(F.min("v"), F.max("v")).first()
    assert float(low) >= -9.99 and float(high) <= 9.99
    assert spark.range(200).select(g.normal(cell, 0, 1, 5, 0.1).alias("v")).where("v < 0 or v > 1").count() == 0
    assert spark.range(50).select(F.size(g.array_of(cell, lambda k: k)).alias("n")).agg(F.min("n"), F.max("n")).first() == (0, 5)


def test_bounded_pairs_exhaustively(spark):
    for left, right in product(range(1, 5), repeat=2):
        for c in range(1, left * right + 1):
            rows = spark.range(c, numPartitions=1).withColumnRenamed("id", "idx")
            pairs = assign.even_pairs(rows, c, left, right).collect()
            assert len({(r["lpos"], r["rpos"]) for r in pairs}) == c
            for side, n in (("lpos", left), ("rpos", right)):
                degrees = [sum(r[side] == i for r in pairs) for i in range(n)]
                assert max(degrees) - min(degrees) <= 1 and {r[side] for r in pairs} <= set(range(n))
    turned = assign.bounded_pairs(rows, left, right, (0, 0), (right, left), 1, "t").collect()  # parents permuted, all pairs of 4 x 4
    assert {(r["lpos"], r["rpos"]) for r in turned} == set(product(range(4), repeat=2))


@pytest.mark.parametrize("total", [1, 2, 7, 100, 999, 4096])
def test_distinct_ranks(spark, total):
    got = {r[0] for r in assign.distinct_ranks(spark.range(total).withColumnRenamed("id", "idx"), total, 42, "t").select("rank").collect()}
    assert got == set(range(total))


def test_infeasible(spark):
    rows = spark.range(5).withColumnRenamed("id", "idx")
    for call in (lambda: assign.unique_subset(rows, 4, 1, "t", "f"), lambda: assign.quota(rows, 2, 0, 2, 1, "t", "f"), lambda: assign.quota(rows, 2, 3, 9, 1, "t", "f"), lambda: assign.tuples(rows, [2, 2], ["a", "b"], 1, "t"), lambda: assign.level_starts(50, 2, 3)):
        with pytest.raises(assign.InfeasibleError):
            call()


def test_quota_extremes(spark):
    rows = spark.range(6).withColumnRenamed("id", "idx")
    assert assign.quota(rows, 3, 2, 2, 1, "t", "f").groupBy("pidx").count().agg(F.min("count"), F.max("count")).first() == (2, 2)
    assert assign.quota(rows, 50, 0, 1, 1, "t", "f").select("pidx").distinct().count() == 6
    assert assign.quota(spark.range(0).withColumnRenamed("id", "idx"), 3, 0, 0, 1, "t", "f").count() == 0


def test_numbered_with_ties_and_empty(spark):
    df = spark.createDataFrame([(i, i // 10) for i in range(95)], "id long, k long")
    assert sorted(r["n"] for r in numbered(df, [F.col("k"), F.col("id")], "n").collect()) == list(range(95))
    assert numbered(df.where("false"), [F.col("k"), F.col("id")], "n").count() == 0


def test_duplicates_nulls_and_repeats(spark):
    df = spark.createDataFrame([(0, 1, None), (1, 1, None), (2, 1, 5), (3, 1, 5), (4, 1, 5), (4, 1, 5)], "idx long, a int, b int")
    assert sorted(r["idx"] for r in validate.duplicates(df, ["a", "b"], ["idx"]).collect()) == [3, 4, 4]


def test_orphans_and_match_full(spark):
    child = spark.createDataFrame([(0, 1, "x"), (1, 2, "y"), (2, None, "z"), (3, None, None)], "idx long, a int, b string")
    parent = spark.createDataFrame([("x", 1)], "q string, p int")
    assert [r["idx"] for r in validate.orphans(child, parent, ["a", "b"], ["p", "q"]).collect()] == [1]
    assert [r["idx"] for r in validate.partly_null(child, ["a", "b"]).collect()] == [2]


def test_checks(spark):
    df = spark.createDataFrame([(0, 5, "ab", [1, 2]), (1, None, None, []), (2, -1, "abc", [9])], "idx long, n int, s string, v array<int>")
    out = validate.with_issues(df, [validate.check("n > 0"), validate.not_null("s"), validate.width("s", 2), validate.element_bounds("v", 0, 5), validate.rule(F.col("n") > 0, ["n"], "n > 0")])
    assert [len(r["issues"]) for r in out.sort("idx").collect()] == [0, 2, 4]
    assert validate.accepted(out).count() == 1 and "issues" not in validate.accepted(out).columns
    assert spark.createDataFrame([("12",), ("x",)], "t string").select(validate.castable("t", "int").alias("i")).where("i is not null").count() == 1


def test_closure_cascades(spark):
    a = spark.createDataFrame([(1,)], "id int")
    b = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "id int, a int")
    c = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id int, b int")
    kept = validate.closure({"a": a, "b": b, "c": c}, [("c", ["b"], "b", ["id"]), ("b", ["a"], "a", ["id"])])
    assert sorted(r["id"] for r in kept["b"].collect()) == [1, 3] and sorted(r["id"] for r in kept["c"].collect()) == [1, 3]


def test_rules():
    bound, derived = rules.Rule("a >= b + 1"), rules.Rule("a = parent(f).a * 2")
    assert (bound.kind, bound.column, bound.op) == ("bound", "a", ">=") and derived.kind == "derivation" and derived.parents == [("f", "a")]
    for text in ("a <> b", "a > a - 1", "a > 1 and b > 2"):
        assert rules.Rule(text).kind == "assertion"
    for text in ("a = 1; drop table t", "a = (select 1)", "a = 1 -- x"):
        with pytest.raises(rules.RuleError):
            rules.Rule(text)
    with pytest.raises(rules.RuleError):
        rules.compile_text("a = ref('x')", None)


def test_years_between(spark):
    row = spark.sql("select date'2026-02-28' a, date'2024-02-29' b").select(g.years_between(F.col("a"), F.col("b"))).first()
    assert row[0] == 1


def test_stream_split(spark, tmp_path):
    from tessera.streaming.validate import split_stream

    spark.range(10).selectExpr("id", "id % 3 as r").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, r long").parquet(str(tmp_path / "in"))
    split_stream(stream, [validate.check("r > 0")], str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination()
    assert (spark.read.parquet(str(tmp_path / "ok")).count(), spark.read.parquet(str(tmp_path / "bad")).count()) == (6, 4)


def test_scores_of_loaded_runs(spark, tmp_path):
    """Files of runs, with a broken answer, an invalid one, a column without a label, and no role, generator or confidence."""
    import json

    from tessera.operators import reports

    column = lambda name, role=None, generator=None, confidence=None: {"column_name": name, "semantic_role": role, "generator": generator and {"type": generator}, "confidence": confidence}
    answer = {"tables": [{"table_name": "t", "columns": [column("a", "Número del cliente", "serial", 0.9), column("b", "fecha", "date", 0.5), column("z", "x", "y", 0.1)]}, {"table_name": "u", "columns": [column("c"), column("d", "algo", "text", 0.7)]}, {"table_name": "v"}], "more": 1}
    runs = [("m1", True, json.dumps(answer)), ("m1", False, json.dumps(answer)), ("m2", True, "{not json"), ("m2", True, "{}")]
    for i, (model, valid, content) in enumerate(runs):
        (tmp_path / f"r{i}.json").write_text(json.dumps({"fixture": "f", "model": model, "schema_valid": valid, "raw_content": content, "latency": 2.0 * i}))
    (tmp_path / "_summary.json").write_text("[]")
    loaded = reports.load_runs(spark, str(tmp_path), "fixture string, model string, schema_valid boolean, raw_content string, latency double")
    labels = spark.createDataFrame(
        [("f", "t", "a", "identificador de cliente", ["serial"], False), ("f", "t", "b", "desconocido", ["text"], True), ("f", "u", "c", "nombre", ["name"], True), ("f", "u", "d", "otro", None, True), ("g", "t", "a", "x", ["serial"], False)],
        "fixture string, table string, column string, role string, acceptable array<string>, low_expected boolean",
    )
    found = reports.scored(loaded, labels, ["fixture", "model"], ["de", "del"])
    got = {r["column"]: (r["generator_ok"], r["role_ok"], r["calibration_ok"]) for r in found.collect()}
    assert got == {"a": (True, True, None), "b": (False, None, True), "c": (False, False, None), "d": (False, False, False)}
    rates = {r["model"]: tuple(r)[1:] for r in reports.score_rates(loaded, found, ["model"]).collect()}
    assert rates == {"m1": (2, 1, 1.0, 1, 4, 1, 3, 1, 2), "m2": (2, 2, 5.0, 0, 0, 0, 0, 0, 0)}


def test_arguments_of_rules_and_equality(spark):
    """Arguments with calls and strings of their own; = and <> are true or false for nulls too."""
    from tessera.functions import rules
    from tessera.functions.draws import Cell

    df = spark.sql("select 0L as idx, date'2020-02-29' as x, date'2024-02-28' as y, cast(null as int) as n, cast(null as int) as m, 3 as k, 'a, (b' as t")
    value = lambda text: rules.evaluate(df, "v", text, Cell(1, "t", "c", F.col("idx"))).first()["v"]
    assert str(value("date(year(x), greatest(1, month(y)), 1)")) == "2020-02-01" and str(value("date(y)")) == "2024-02-28"
    assert value("years_between(date_add(y, 1), date(year(x), 2, 29))") == 4 and value("years_between(y, x)") == 3
    assert value("concat(t, 'date(1, 2, 3)', year(date(2001, 1, 1)))") == "a, (bdate(1, 2, 3)2001"
    with pytest.raises(rules.RuleError):
        value("date(2001, 1, (1")
    hold = lambda text: df.select(F.expr(rules.two_valued(text))).first()[0]
    assert hold("n = m") and not hold("n <> m") and hold("n <> k") and not hold("n = k") and hold("k = 3 and t <> '=' and k >= 3 and k <= 3 and k != 4")
    assert rules.two_valued("a <=> b and c = '<>='") == "a <=> b and c  IS NOT DISTINCT FROM  '<>='"
