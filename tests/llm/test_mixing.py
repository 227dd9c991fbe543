from mnemospark.llm.mixing import allocate, mix_report, mix_sources, sampling_rates, sized_documents

D, M = "doc_id long, source string, text string", "source string, target_share double, max_repeats long"


def docs(spark, sizes):
    rows, n = [], 0
    for source, many in sizes.items():
        for k in range(many):
            rows.append((n, source if k % 5 else source.upper() + " ", "w " * (5 + k % 20)))
            n += 1
    return spark.createDataFrame(rows, D)


def test_shares_are_reached(spark):
    d = docs(spark, {"a": 3000, "b": 600, "c": 40, "other": 500}).selectExpr("*", "1 AS size", "2 AS q", "3 AS n")
    t = spark.createDataFrame([("a", 0.4, 1), ("B", 0.5, 5), ("c", 0.1, 2), ("none", 0.0, 1)], M)
    sized = sized_documents(d)
    plan = allocate(sized, t)
    mix = mix_sources(sized, plan)
    r = {x["source"]: x for x in mix_report(plan, mix).collect()}
    assert r["c"]["short"] and r["c"]["max_repeats_used"] == 2 and not r["a"]["short"]
    assert r["none"]["docs_in_mix"] == 0
    plans = {x["source"]: x for x in plan.collect()}
    for s in "ab":
        assert abs(r[s]["size_in_mix"] - plans[s]["want"]) < 0.03 * plans[s]["want"]
    assert mix.filter("source = 'a' AND repeats > 1").count() == 0 and mix.filter("source = 'b' AND repeats > 5").count() == 0
    assert mix.groupBy("doc_id").count().filter("count > 1").count() == 0
    again = mix_sources(sized.repartition(7), plan)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mix.collect()))
    other = mix_sources(sized, plan, seed=2)
    assert sorted(map(tuple, other.collect())) != sorted(map(tuple, mix.collect()))


def test_larger_documents_are_drawn_more_often(spark):
    d = docs(spark, {"a": 4000})
    sized = sized_documents(d)
    plan = allocate(sized, spark.createDataFrame([("a", 0.3, 1)], M))
    got = mix_sources(sized, plan).groupBy("size").count().orderBy("size").collect()
    assert got[-1]["count"] > 2 * got[0]["count"]


def test_dirty_and_empty(spark):
    d = spark.createDataFrame([(1, "a", None), (2, None, "x y"), (None, "a", "x y z"), (3, "a", "")], D)
    t = spark.createDataFrame([("a", 1.0, 1), (None, 0.5, 1), ("b", 0.5, 3)], M)
    plan = {x["source"]: x for x in allocate(sized_documents(d), t).collect()}
    assert plan["a"]["size"] == 3 and plan["b"]["short"] and set(plan) == {"a", "b"}
    empty = allocate(sized_documents(d.limit(0)), t)
    assert empty.filter("size > 0").count() == 0 and mix_sources(sized_documents(d.limit(0)), empty).count() == 0


def test_skewed_lengths_reach_the_rest(spark):
    """A document of half of all words, and lengths so skewed that more become certain each time the chances are computed."""
    halves = spark.range(20_001).selectExpr("id AS doc_id", "'half' AS source", "CASE WHEN id = 0 THEN 20000L ELSE 1L END AS size")
    steps = spark.range(4000).selectExpr("id AS doc_id", "'steps' AS source", "CAST(1 + floor(1e6 / pow(id + 1, 1.5)) AS long) AS size")
    sized = halves.unionByName(steps)
    total = {r[0]: r[1] for r in sized.groupBy("source").sum("size").collect()}
    every = sum(total.values())
    targets = [("half", 30_000 / every, 1), ("steps", 0.97 * total["steps"] / every, 1)]
    plan = allocate(sized, spark.createDataFrame(targets, M))
    rest = {r["source"]: r["rest"] for r in plan.collect()}
    rate = {r["source"]: r["rate"] for r in sampling_rates(sized, plan).collect()}
    expected = {s: 0.0 for s in rate}
    for r in sized.collect():
        expected[r["source"]] += r["size"] * min(1.0, rate[r["source"]] * r["size"])
    mix = {r[0]: r[1] for r in mix_sources(sized, plan).groupBy("source").sum("size").collect()}
    for s in ("half", "steps"):
        assert abs(expected[s] - rest[s]) < 1e-6 * rest[s]
        assert abs(mix[s] - rest[s]) < 0.01 * rest[s]
