"""Steps that read or sort their input once only."""

from tidemark.operators.gates import Axis, Goal, gate_search
from tidemark.plans import aggregates

DATA = "/root/testdata/sf0.001"


def test_upper_medians_sort_the_lines_once(spark):
    plan = aggregates.upper_median_dedupe(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and plan.count("Sort [") == 1


def test_gates_read_their_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(50).selectExpr("id / 50.0D as p", "id % 7 * 1.0D as e").mapInArrow(count, "p double, e double")
    found = gate_search(rows, [Axis("p", (0.9, 0.5, 0.1))], [Goal("any", 100.0)], "e").first()
    assert (found.accepted, found.coverage, seen.value) == (45, 90.0, 50)
