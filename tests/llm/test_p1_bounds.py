from logloom.llm.frequent import MAX_WIDTH, SKETCH_WIDTH, Heap, frequent_values, sketch_width


def test_width_follows_the_share():
    assert sketch_width(0.005, 8) == SKETCH_WIDTH
    assert 8 * 2.7183 / sketch_width(1e-5, 8) <= 1e-5 * 8
    assert sketch_width(1e-12, 8) == MAX_WIDTH


def test_more_candidates_than_fit_are_not_broadcast(spark):
    rows = spark.range(4000).selectExpr("cast(id % 2000 as string) as v")
    got = frequent_values(rows, "v", share=0.0005, capacity=50)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in got._jdf.queryExecution().optimizedPlan().toString()
    found = got.collect()
    assert len(found) == 2000 and all(r.n == 2 and r.estimate >= 2 for r in found)


def test_heap_stays_bounded_and_loses_nothing_that_reaches_the_threshold():
    heap, out = Heap(4), []
    for i in range(2000):
        out.append(heap.offer(f"v{i % 50}", i, 1900))
        assert len(heap.best) <= 4 and len(heap.order) <= 2 * 4 + 17
    kept = set(heap.best) | {x[0] for x in out if x}
    assert {f"v{i % 50}" for i in range(1900, 2000)} <= kept


def test_small_heaps_and_sketches_give_the_same_answer(spark):
    values = [f"w{i}" for i in range(3000)] + ["a"] * 40 + ["b"] * 32 + ["c"] * 31 + [None] * 50
    rows = spark.createDataFrame([(v, 1, "x") for v in values], "v string, n int, value string").repartition(5)
    want = {("a", 40), ("b", 32)}  # of 3,103 rows
    for capacity in (1, 3, 1000):
        for width in (16, 1 << 16):
            got = frequent_values(rows, "v", share=0.01, width=width, capacity=capacity)
            assert {(r.value, r.n) for r in got.collect()} == want
    assert frequent_values(rows.where("false"), "v").count() == 0
    assert [r.value for r in frequent_values(spark.createDataFrame([("z",)], "v string"), "v", share=1).collect()] == ["z"]
    long = "long " * 300_000
    got = frequent_values(spark.createDataFrame([(long,), (long,), ("s",)], "value string"), "value", share=0.5)
    assert [(len(r.value), r.n) for r in got.collect()] == [(len(long), 2)]
