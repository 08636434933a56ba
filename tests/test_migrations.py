"""Files of three schema generations read as one table."""

from cairnlight.sources import migrations as M

ADDED = (M.Added("status", "string", "candidate", 1), M.Added("note", "string", None, 1), M.Added("score", "double", 3.0, 2), M.Added("ID", "string", "never", 1), M.Added("status", "string", "other", 2))


def test_three_generations_are_one_table(spark, tmp_path):
    path = str(tmp_path / "t")
    M.append_generation(spark.createDataFrame([(1, "a"), (2, None)], "id long, name string"), path, 0)
    M.append_generation(spark.createDataFrame([(3, "c", None, "n"), (4, "d", "kept", None)], "id long, name string, status string, note string"), path, 1)
    M.append_generation(spark.createDataFrame([(5.5, "odd", 5, "e", "x", None)], "score double, more string, id long, name string, note string, status string"), path, 2)
    M.append_generation(spark.createDataFrame([(6, "f")], "id long, name string"), path, 2)
    df = M.read_generations(spark, path, "id long, name string", ADDED)
    assert df.columns == ["id", "name", "status", "note", "score", "generation"]
    assert sorted(tuple(r) for r in df.collect()) == [
        (1, "a", "candidate", None, 3.0, 0), (2, None, "candidate", None, 3.0, 0), (3, "c", None, "n", 3.0, 1), (4, "d", "kept", None, 3.0, 1), (5, "e", None, "x", 5.5, 2), (6, "f", None, None, None, 2)]
    plan = lambda q: q._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,3)" in plan(df.filter("id > 3")) and "EqualTo(note,x)" in plan(df.filter("note = 'x'"))
    assert df.filter("note = 'x'").count() == 1 and df.filter("status = 'candidate'").count() == 2 and df.filter("score = 3.0").count() == 4
    one = df.filter("generation = 1")
    assert "PartitionFilters: [isnotnull(generation" in plan(one) and one.count() == 2
    assert "name" not in plan(df.select("id", "generation")).split("ReadSchema")[1]


def test_the_tables_of_the_store(spark, tmp_path):
    for name, added in M.ADDITIONS.items():
        path = str(tmp_path / name)
        M.append_generation(spark.createDataFrame([(1,)], "id long"), path, 0)
        row = M.read_generations(spark, path, "id long", added).first().asDict()
        assert {a.name: row[a.name] for a in added} == {a.name: a.default for a in added}
