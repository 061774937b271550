"""What validation reads of a body: its fields are taken out at once, not path by path, which costs as much as the whole each time."""

from runloom.operators import validate



def test_a_body_is_not_read_path_by_path(spark):
    bodies = [(1, '{"agent_name": "a", "steps": [{"step_number": 1, "step_type": "output", "name": "n", "parent_step": 1}, 5]}'), (2, '{"agent_name": "a", "steps": {}}'), (3, '[]')]
    docs = spark.createDataFrame(bodies, "doc_id bigint, body string")
    found = validate.validate(docs)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(v#") <= 4  # the fields of the whole, those of steps, and whether steps that are no array are there
    assert sorted((r.doc_id, r.field, r.message) for r in found.collect()) == [
        (1, "steps[0].parent_step", "must name an earlier step"), (1, "steps[1].root", "must be an object"), (2, "steps", "must be an array"),
        (3, "root", "must be an object"),
    ]


def test_tables_do_not_read_a_body_path_by_path(spark):
    docs = spark.createDataFrame([(1, '{"id": "t", "agent_name": "a", "tags": ["x"], "steps": [{"step_number": 1, "step_type": "output", "name": "n", "caused_by_step_number": 4}]}')], "doc_id bigint, body string")
    made = validate.tables(docs, ["y"], valid=True)
    for name in ("traces", "steps"):
        assert made[name]._jdf.queryExecution().optimizedPlan().toString().count("(v#") <= 2
    assert made["traces"].select("id", "tags", "status").first() == ("t", ["x", "y"], "running")
    assert made["steps"].select("trace_id", "step_number", "caused_by_step_number").first() == ("t", 1, 4)
