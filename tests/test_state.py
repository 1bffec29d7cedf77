"""Trees, typed answers, committed runs, backfills, similar values and the stream of idempotent requests."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import grid, trees
from lodestone.sources import runs
from lodestone.streaming import idempotency


# trees --------------------------------------------------------------------------------------------------------------------------


def plain_changes(a, b, path=""):
    def children(x):
        if isinstance(x, dict):
            return x
        if isinstance(x, list) and x and all(isinstance(e, dict) and isinstance(e.get("id"), str) for e in x) and len({e["id"] for e in x}) == len(x):
            return {e["id"]: e for e in x}
        return None

    if type(a) is type(b) and children(a) is not None and children(b) is not None:
        x, y, out = children(a), children(b), []
        for k in sorted({*x, *y}):
            at = f"{path}/{k.replace('~', '~0').replace('/', '~1')}"
            out += [(at, "added")] if k not in x else [(at, "removed")] if k not in y else plain_changes(x[k], y[k], at)
        return out
    return [] if json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True) else [(path or "/", "changed")]


def some_tree(rng, depth):
    kind = rng.randrange(7 if depth else 4)
    if kind < 4:
        return rng.choice([1, 2, "x", None, True, "", "é/~"])
    keys = rng.sample(["a", "b", "c/d", "e~", "id"], rng.randrange(4))
    if kind < 6:
        return {k: some_tree(rng, depth - 1) for k in keys}
    if rng.random() < 0.5:
        return [{"id": i, "v": some_tree(rng, depth - 1)} for i in rng.sample("pqr", rng.randrange(4))]
    return [some_tree(rng, depth - 1) for _ in range(rng.randrange(3))]


def test_changes_of_trees(spark):
    rng = random.Random(2)
    pairs = [({"r": some_tree(rng, 4)}, {"r": some_tree(rng, 4)}) for _ in range(150)]
    pairs += [(a, a) for a, _ in pairs[:20]]
    df = spark.createDataFrame([(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(pairs)], "id int, a string, b string")
    got = {}
    for r in trees.json_changes(df, "id", "a", "b").collect():
        got.setdefault(r["id"], set()).add((r["path"], r["change"]))
    assert got == {i: set(c) for i, (a, b) in enumerate(pairs) if (c := plain_changes(a, b))}


def test_secrets_and_labels(spark):
    rows = [(1, '{"pipeline":{"nodes":[{"id":"n1","api_key":"abc"}],"edges":[1]},"search":{"k":1}}', '{"pipeline":{"nodes":[{"id":"n1","api_key":"abd"}],"edges":[2]},"search":{"k":2,"new":{"db_password":"q\\"w","x":1}}}'), (2, None, "{bad"), (3, None, '{"token":null}')]
    out = trees.json_changes(spark.createDataFrame(rows, "id int, a string, b string"), "id", "a", "b")
    got = {(r["id"], r["path"]): (r["before"], r["after"]) for r in out.collect()}
    assert got[1, "/pipeline/nodes/n1/api_key"] == (trees.MASK, trees.MASK) and got[1, "/search/new"][1] == f'{{"db_password":"{trees.MASK}","x":1}}'
    assert got[3, "/token"] == (None, trees.MASK) and len(got) == 5
    assert {r["id"]: r["labels"] for r in trees.change_labels(out, "id").collect()} == {1: ["pipeline:(graph)", "pipeline:n1", "search"], 3: ["token"]}


def test_coerced_answers(spark):
    fields = [trees.Field("i", "integer", required=True), trees.Field("f", "float"), trees.Field("b", "bool"), trees.Field("d", "datetime"), trees.Field("e", "enum", ("Red", "Blue")), trees.Field("k", "keyword_list"), trees.Field("il", "integer_list"), trees.Field("t", "text")]
    answers = [
        '{"i":"3","f":"2.5","b":"Yes","d":"2024-01-02T03:04:05","e":"red","k":[" a ","",null,3],"il":[1,"2",2.5,true],"t":" x "}',
        '{"i":3.7,"f":"nan","b":"maybe","d":"yesterday","e":"green","k":[],"il":"no","t":""}', '{"i":null}', "[1]", None, '{"i":true,"f":true,"b":1,"d":20240101,"e":["Red"],"t":{"a":1}}', '{"i":-4.0,"f":1e400,"more":1}',
    ]
    got = trees.coerced(spark.createDataFrame([(a,) for a in answers], "a string").coalesce(1), "a", fields, ("v", "e")).collect()
    first = got[0]["v"]
    assert (first["i"], first["f"], first["b"], first["d"].isoformat(), first["e"], first["k"], first["il"], first["t"]) == (3, 2.5, True, "2024-01-02T03:04:05", "Red", ["a", "3"], [1, 2], "x") and got[0]["e"] == []
    assert all(x is None for x in got[1]["v"]) and len(got[1]["e"]) == 8 and got[2]["e"] == ["i is required"]
    assert got[3]["e"] == got[4]["e"] == ["the answer is no object"]
    assert [x.split()[0] for x in got[5]["e"]] == ["i", "f", "d", "e", "t"] and got[5]["v"]["b"] is True
    assert got[6]["v"]["i"] == -4 and got[6]["e"] == ["f is no float"]
    schema = trees.answer_schema(fields)
    assert schema["properties"]["e"]["enum"] == ["Red", "Blue", None] and schema["properties"]["il"]["items"] == {"type": "integer"} and schema["required"][0] == "i"
    for bad in (lambda: trees.Field("x", "list"), lambda: trees.Field("x", "text", ("a",)), lambda: trees.answer_schema([fields[0], fields[0]])):
        with pytest.raises(ValueError):
            bad()


# runs ---------------------------------------------------------------------------------------------------------------------------


def test_runs_are_seen_whole_or_not_at_all(spark, tmp_path):
    root = str(tmp_path)
    a = lambda v, ids: spark.createDataFrame([(i, v) for i in ids], "doc int, v string")
    state = lambda: {n: sorted(tuple(r) for r in runs.read(spark, root, n).collect()) for n in runs.current(spark, root)}
    with pytest.raises(ValueError):
        runs.read(spark, root, "x")
    assert runs.newest(spark, root) is None and runs.write_run(spark, root, 1, {"x": a("old", [1, 2]), "y": a("old", [1, 2])}, "doc")
    before = state()
    broken = a("new", [2]).withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        runs.write_run(spark, root, 2, {"x": a("new", [2, 3]), "y": broken}, "doc")  # x is written, y is not
    assert state() == before and runs.newest(spark, root) == 1
    assert runs.write_run(spark, root, 2, {"x": a("new", [2, 3]), "y": a("new", [2])}, "doc")
    assert state() == {"x": [(1, "old"), (2, "new"), (3, "new")], "y": [(1, "old"), (2, "new")]}
    assert not runs.write_run(spark, root, 2, {"x": a("again", [1])}, "doc") and not runs.write_run(spark, root, 1, {"x": a("again", [1])}, "doc")
    assert runs.write_run(spark, root, 3, {"z": a("only", [9])})
    assert state()["x"] == [(1, "old"), (2, "new"), (3, "new")] and state()["z"] == [(9, "only")]
    assert sorted(tuple(r) for r in runs.read(spark, root, "x", run=1).collect()) == before["x"]


def test_backfill_takes_up_where_it_stopped(spark, tmp_path):
    root, calls = str(tmp_path), []
    rows = spark.range(200).select("id", (F.col("id") % 7).alias("v"))
    runs.write_run(spark, root, 1, {"t": rows})

    def derive(fail_at):
        def run(df):
            calls.append(1)
            if len(calls) == fail_at:
                raise RuntimeError("gone")
            return df.withColumn("w", F.col("v") * 2)

        return run

    with pytest.raises(RuntimeError):
        runs.backfill(spark, root, "t", "id", derive(4), version=2, parts=6)
    assert runs.read(spark, root, "t").columns == ["id", "v"] and len(calls) == 4
    assert runs.backfill(spark, root, "t", "id", derive(0), version=2, parts=6) and len(calls) == 7
    got = runs.read(spark, root, "t").select("id", "v", "w")
    assert runs.digest(got) == runs.digest(rows.withColumn("w", F.col("v") * 2))
    assert not runs.backfill(spark, root, "t", "id", derive(0), version=2, parts=6)
    with pytest.raises(RuntimeError):
        runs.backfill(spark, root, "t", "id", derive(len(calls) + 2), version=5, parts=6)
    runs.write_run(spark, root, 4, {"other": rows})
    with pytest.raises(ValueError, match="another run"):
        runs.backfill(spark, root, "t", "id", derive(0), version=5, parts=6)


# similar values -----------------------------------------------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("cutoff", [0.51, 0.6, 0.8, 1.0])
def test_similar_pairs(spark, cutoff):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abA") for _ in range(rng.randrange(0, 11)))
    values, needles = sorted({word() for _ in range(150)}), sorted({word() for _ in range(40)})
    got = grid.similar_pairs(spark.createDataFrame([(x,) for x in needles], "needle string"), spark.createDataFrame([(x, len(x)) for x in values], "value string, n int"), cutoff)
    want = {(a, b): round(1 - edits(a.lower(), b.lower()) / max(len(a), len(b)), 6) for a in needles for b in values if a and b}
    assert {(r["needle"], r["value"]): r["ratio"] for r in got.collect()} == {k: v for k, v in want.items() if v >= cutoff}


# idempotent requests ------------------------------------------------------------------------------------------------------------


def test_requests_over_many_batches(spark, tmp_path):
    rng, rows, at = random.Random(6), [], 1_700_000_000_000
    for i in range(240):
        at += rng.randrange(1, 2_000_000)
        rows.append((i, f"k{rng.randrange(4)}", at, rng.choice(["request", "request", "complete"]), rng.choice("aab"), f"r{i}"))
    for n in range(0, 240, 40):  # a file and a batch each
        part = spark.createDataFrame(rows[n : n + 40], "id long, key string, ms long, kind string, fingerprint string, response string")
        part.select("id", "key", F.timestamp_millis("ms").alias("ts"), "kind", "fingerprint", "response").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = idempotency.outcomes(stream, ttl="6 hours", stale="1 hour", late="1 minute")
    run = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
    run.awaitTermination()
    records, want = {}, {}
    for i, key, ms, kind, fingerprint, response in rows:
        records[key], outcome, given = idempotency.step(records.get(key), kind, ms, fingerprint, response, 6 * 3_600_000, 3_600_000)
        want[i] = (outcome, given)
    got = {r["id"]: (r["outcome"], r["response"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == want and {o for o, _ in want.values()} == {"claimed", "replayed", "mismatch", "in_flight", "reclaimed", "completed", "ignored"}


def test_states_of_a_record():
    hour, step = 3_600_000, lambda r, kind, at, f="a", x=None: idempotency.step(r, kind, at, f, x, 10 * 3_600_000, 3_600_000)
    record, outcome, _ = step(None, "request", 0)
    assert outcome == "claimed" and step(record, "request", hour)[1] == "in_flight" and step(record, "request", 1, "b")[1] == "mismatch"
    again, outcome, _ = step(record, "request", hour + 1, "b")
    assert outcome == "reclaimed" and again[1:4] == ("b", hour + 1, 11 * hour + 1)
    done, outcome, given = step(again, "complete", 2 * hour, x="ok")
    assert (outcome, given) == ("completed", "ok") and step(done, "request", 3 * hour, "b")[1:] == ("replayed", "ok") and step(done, "complete", 3 * hour)[1] == "ignored"
    assert step(done, "request", 11 * hour + 1, "z")[1] == "claimed" and step(None, "complete", 0)[1] == "ignored"
