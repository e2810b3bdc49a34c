"""Client state on a stream: as the batch has it, after a restart too; requests that never end."""

import datetime as dt
import random



from docketlake.streaming import state, trace

SCHEMA = "query_id string, seq long, step string, type string, ts timestamp"
START = dt.datetime(2024, 1, 1)


def frames(seed=1, n=120):
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        kind = rng.choices(["ai_mode_trace", "query", *trace.TERMINAL], weights=[8, 1] + [0.3] * len(trace.TERMINAL))[0]
        out.append((f"q{rng.randrange(9)}", seq, rng.choice(trace.STEPS), kind, START + dt.timedelta(seconds=seq)))
    return out


def put(spark, rows, folder, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def run(spark, tmp_path, **options):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    state.run_to(state.client_states(stream, **options), f"{tmp_path}/out", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    return state.latest(spark.read.parquet(f"{tmp_path}/out"))


def test_agrees_with_the_batch_after_a_restart(spark, tmp_path):
    rows = frames()
    late = rows[40:50]  # come in the last files, after frames that follow them
    for i, part in enumerate((rows[:40], rows[50:90])):
        put(spark, part, f"{tmp_path}/in", i)
    run(spark, tmp_path)
    put(spark, rows[90:] + late, f"{tmp_path}/in", 2)
    got = {r.query_id: (list(r.steps), r.loading) for r in run(spark, tmp_path).collect()}
    whole = {r.query_id: (list(r.steps), r.loading) for r in trace.loading(spark.createDataFrame(rows, SCHEMA)).collect()}
    empty = {q: ([], False) for q in got if q not in whole}  # a new query of which nothing has come
    assert got == whole | empty and {v[1] for v in whole.values()} == {True, False}


def test_requests_that_never_end_expire_and_are_forgotten(spark, tmp_path):
    at = lambda minutes: START + dt.timedelta(minutes=minutes)
    put(spark, [("a", 1, "intent", "ai_mode_trace", at(0)), ("b", 1, "intent", "ai_mode_trace", at(0)), ("b", 2, "rerank", "ai_mode_done", at(1))], f"{tmp_path}/in", 0)
    put(spark, [("c", 1, "intent", "ai_mode_trace", at(60))], f"{tmp_path}/in", 1)
    put(spark, [("c", 2, "rerank", "ai_mode_trace", at(61))], f"{tmp_path}/in", 2)
    got = {r.query_id: (list(r.steps), r.loading, r.expired) for r in run(spark, tmp_path, patience="'5' MINUTE", retention="'1' DAY", late="1 minute").collect()}
    assert got == {"a": (["intent"], False, True), "b": (["intent", "rerank"], False, False), "c": (["intent", "rerank"], True, False)}
    # a day later both are forgotten: a new frame starts with nothing
    put(spark, [("d", 1, "intent", "agent_done", at(3000))], f"{tmp_path}/in", 3)
    put(spark, [("d", 2, "intent", "agent_done", at(3001))], f"{tmp_path}/in", 4)
    put(spark, [("a", 9, "rerank", "ai_mode_trace", at(3001))], f"{tmp_path}/in", 5)
    got = {r.query_id: (list(r.steps), r.loading) for r in run(spark, tmp_path, patience="'5' MINUTE", retention="'1' DAY", late="1 minute").collect()}
    assert got["a"] == (["rerank"], True)
