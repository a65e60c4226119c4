from pyspark.sql import functions as F

from lectern.functions import narrative
from lectern.operators import agent, geometry, monitor, planning, results
from lectern.streaming import events as streaming


def test_options_are_bounded():
    assert agent.Options.of(evidence_chars="99999", evidence_chunks="x", rounds=1, other=3) == agent.Options(evidence_chars=12_000, evidence_chunks=5, rounds=2)


def test_a_model_answers_batches_and_without_one_the_context_does(spark):
    tasks = agent.prompts(spark.createDataFrame([(1, "L", "G", ["a"], "One. Two. Three."), (2, None, None, [], None)], "id int, label string, goal string, fields array<string>, context string"))
    assert [r.answer for r in agent.answered(tasks).orderBy("id").collect()] == ["One. Two.", ""]
    told = agent.answered(tasks, lambda prompts: [p[:7] for p in prompts]).orderBy("id").collect()
    assert [r.answer for r in told] == ["Task: L", "Task: \n"] and "an array `evidence`" in told[0].prompt


def test_evidence_grows_until_it_holds_the_quote(spark):
    rows = [(1, "t", 0, 9, "H", "x" * 2000), (1, "t", 1, 8, "H", "y" * 900 + " early " + "y" * 2000), (1, "t", 2, 7, "H", "z" * 2000 + " late one"), (1, "t", 3, 0, "H", "nothing")]
    scores = spark.createDataFrame(rows, "doc_id int, task_id string, idx int, score int, heading string, text string")
    quotes = spark.createDataFrame([(1, "t", 1, "xx"), (1, "t", 2, "early"), (1, "t", 3, "late one"), (1, "t", 4, "absent")], "doc_id int, task_id string, quote_id int, quote string")
    got = {r.quote_id: r["round"] for r in agent.grounding_round(scores, quotes, agent.Options(evidence_chars=3000, evidence_chunks=3, rounds=4)).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: None}


def test_runs_in_a_stream_equal_the_batch(spark, tmp_path):
    schema = "run_id int, seq int, stage string, at_ms long, task struct<id:string,status:string,attempts:int>, react struct<taskId:string,round:int,phase:string>, memory struct<taskId:string,recalledItems:int>, tool struct<callId:string,name:string,status:string,durationMs:int,totalTokens:int,tokenEstimate:boolean>"
    rows = [
        (1, 1, "read", 5, ("a", "running", 1), None, None, None),
        (1, 2, None, 9, None, ("a", 2, "reflection"), None, None),
        (1, 3, None, 12, None, None, ("a", 2), ("c1", "search", "running", None, None, None)),
        (1, 4, "write", 20, ("a", "completed", 2), None, None, ("c1", None, "completed", None, 120, True)),
    ]
    df = spark.createDataFrame(rows, schema)
    r = monitor.run_summary(df).first()
    assert (r.stage, r.completed, r.retries, r.memory_hits, r.tool_calls, r.total_tokens, r.token_estimate, r.duration_ms) == ("write", 1, 2, 2, 1, 120, True, 20)
    df.repartition(3).write.json(str(tmp_path / "events"))
    stream = streaming.progress_stream(streaming.read_events(spark, str(tmp_path / "events"), schema))
    streaming.to_memory(stream, "progress").stop()
    assert spark.table("progress").collect() == monitor.task_progress(df).collect()


def test_scores_and_boxes_of_odd_values(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    r = one(results.review(F.array(F.lit(0.9), F.lit(0.5), F.lit(0.7), F.lit(-2.0)), F.lit(1.08), F.lit("pass"), F.array(F.lit("low"))))
    assert (r.scores, r.overall, r.verdict) == ([90, 50, 70, 0], 100, "pass")
    assert one(results.style_scale(F.array(F.lit(2.0), F.lit(0.9), F.lit(None).cast("double")))) == 1.125
    box = lambda *v: F.struct(*[F.lit(x).alias(n) for n, x in zip(("left", "top", "right", "bottom"), v, strict=True)])
    got = one(geometry.accepted_crop(F.lit(True), F.lit(True), F.lit(0.9), F.array().cast("array<string>"), box(0.1, 0.1, 0.5, 0.5), box(0.0, 0.0, 0.6, 0.6), F.lit("figure")))
    assert got.applied and got.box.right == 0.5
    assert one(geometry.best_crop(F.array().cast("array<struct<attempt:int,confidence:double,area:double>>"))) is None


def test_texts_for_panels(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(narrative.points(F.lit("A one. A one. B 0.5 two vs. three; C"), 3, 500)) == ["A one.", "B 0.5 two vs. three; C."]
    assert one(narrative.joined(F.lit("Same text."), F.lit("same  TEXT"), F.lit(None).cast("string"), F.lit("Other"))) == "Same text. Other"
    assert one(narrative.key_ideas(F.lit(None).cast("string"), F.lit(""))) is None
    assert one(planning.near_section(F.lit("main-results"))) == "results"
