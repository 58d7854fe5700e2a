import random

from pyspark.sql import functions as F

from pyref import parse
from ulasan.operators.labelling import parse_response

FIXTURE = [
    ('[{"index":0,"label":"positif"},{"index":2,"label":" NEGATIF "}]', "ok", ["positif", "netral", "negatif"]),
    ('```json\n[{"index":0,"label":"positif"},{"index":2,"label":" NEGATIF "}]\n```', "ok",
     ["positif", "netral", "negatif"]),
    ('Berikut: [{"index":1,"label":"positif"}] selesai', "ok", ["netral", "positif", "netral"]),
    ('[{"index":0,"label":"senang"}]', "ok", ["netral"] * 3),
    ('[{"index":7,"label":"positif"},{"index":"1","label":"positif"},{"index":1.0,"label":"positif"}]', "ok",
     ["netral"] * 3),
    ('[{"index":0,"label":"positif"},{"index":0,"label":"negatif"}]', "ok", ["negatif", "netral", "netral"]),
    ('[{"index":0}]', "ok", ["netral"] * 3),
    ("maaf", "fallback_netral", ["netral"] * 3),
    ('[{"index":0,]', "fallback_netral", ["netral"] * 3),
    ("[1]", "retry", None),
    ('{"index":0,"label":"positif"}', "retry", None),
    ('[{"index":0,"label":null}]', "retry", None),
]


def _run(spark, rows):
    df = spark.createDataFrame([(i, r, n) for i, (r, n) in enumerate(rows)], "id int, raw string, n int")
    out = df.select("id", parse_response(F.col("raw"), F.col("n")).alias("p")).collect()
    return {r.id: (r.p.status, list(r.p.labels) if r.p.labels is not None else None) for r in out}


def test_fixture_table(spark):
    got = _run(spark, [(r, 3) for r, _, _ in FIXTURE])
    for i, (raw, status, labels) in enumerate(FIXTURE):
        assert got[i] == (status, labels), raw
        assert parse(raw, 3) == (status, labels), raw


def test_random_responses_match_python(spark):
    rnd = random.Random(7)
    parts = ['{"index":0,"label":"positif"}', '{"index":1,"label":"NEGATIF"}', '{"index":2}',
             '{"index":5,"label":"netral"}', '{"index":1.5,"label":"positif"}', '"x"', "1", "null",
             '{"label":null}', '{"index":0,"label":3}', '{"index":"0","label":"positif"}', "[]"]
    rows = []
    for _ in range(400):
        items = ",".join(rnd.choice(parts) for _ in range(rnd.randint(0, 4)))
        body = "[" + items + "]"
        kind = rnd.randint(0, 6)
        if kind == 1:
            body = "```json\n" + body + "\n```"
        elif kind == 2:
            body = "ok: " + body + " selesai"
        elif kind == 3:
            body = body[:-1]
        elif kind == 4:
            body = body + " lalu [2]"
        elif kind == 5:
            body = "  " + body.replace("[", "{", 1) + " "
        rows.append((body, rnd.randint(1, 4)))
    got = _run(spark, rows)
    for i, (raw, n) in enumerate(rows):
        assert got[i] == parse(raw, n), raw


JSON_CASES = [
    "{}", "{ \n\t}", '{"a":1}', "NaN", "[NaN]", "[]", "[{}]", '""', '"x"', "null", "true", "Infinity",
    '[{"index":NaN,"label":"positif"},{"index":0,"label":"positif"}]', '[{"index":0,"label":NaN}]',
    '[{"index":-Infinity,"label":"positif"},{"index":1,"label":"negatif","p":Infinity}]',
    '[{"index":0,"label":"-Infinity NaN"},{"index":1,"label":"positif"}]', '[{"index":1,"label":"positif","NaN":NaN}]',
    '[{"index":-NaN,"label":"positif"}]', '[{"index":xNaN,"label":"positif"}]', '[{"index":0,"label":"positif","p":NaN1}]',
    '[{"index":1,"index":0,"label":"positif"}]', '[{"index":0,"label":"positif","label":"negatif"}]',
    '[{"index":0,"label":null,"label":"negatif"}]', '[{"index":0,"label":"positif","label":null}]',
    '[{"index":true,"label":"positif"},{"index":false,"label":"negatif"}]', '[{"index":null,"label":"positif"}]',
    '[{"index":0,"label":"pos\\u0069tif"}]', '[{"index":0,"label":"a\\"NaN\\\\"},{"index":2,"label":"positif"}]',
    'it\'s "NaN: [{"index":0,"label":"positif","p":NaN}] ok', '[{"index":0,"label":"positif"}] NaN', '[{"index":0,"label":"a\nb"}]',
    '[{"index":1e0,"label":"positif"}]', '[{"index":-0,"label":"positif"}]', '[{"index":12345678901234567890123,"label":"positif"}]',
    '[{"index":01,"label":"positif"}]', '[{"index":0,"label":"positif",}]', "{'index':0}", '[[]]', '[{"index":[0],"label":"positif"}]',
]


def test_json_cases_match_the_library(spark):
    from ulasan.operators.labelling import parse_responses
    df = spark.createDataFrame([(i, 3, r) for i, r in enumerate(JSON_CASES)], "batch_id long, n int, raw string")
    got = {}
    for r in sorted(parse_responses(df).collect(), key=lambda r: r.pos):
        got.setdefault(r.batch_id, (r.status, []))[1].append(r.label)
    for i, raw in enumerate(JSON_CASES):
        status, labels = parse(raw, 3)
        assert got[i] == (status, labels or [None] * 3), raw


def test_no_response_null_text_and_overlapping_state(spark):
    from pyspark.sql import functions as F
    from ulasan.operators import labelling as lb
    r = spark.createDataFrame([(None, 2), ("[]", 0), ('[{"index":0,"label":"positif"}]', 2)], "raw string, n int").select(
        lb.parse_response(F.col("raw"), F.col("n")).alias("r")).collect()
    assert [x.r.status for x in r] == ["retry", "ok", "ok"] and r[0].r.labels is None and r[1].r.labels == [] and r[2].r.labels == ["positif", "netral"]
    p = spark.createDataFrame([(["a", None, "c"],)], "t array<string>").select(lb.prompt_text(F.col("t")).alias("p")).first().p
    assert "[0] a\n[1] \n[2] c" in p
    rows = spark.createDataFrame([(1,), (2,), (3,)], "row_id long")
    state = spark.createDataFrame([(1, "positif", 1), (1, "negatif", 2), (2, None, 3)], "row_id long, label string, labelled_at long")
    assert {x.row_id: x.label for x in lb.publish(rows, state).collect()} == {1: "negatif", 2: "netral", 3: "netral"}
    assert {x.row_id for x in lb.pending_rows(rows, state).collect()} == {2, 3}


def test_labeller_gets_both_prompts(spark):
    from ulasan.operators import labelling as lb
    df = spark.createDataFrame([(0, 1, [7], ["teks"])], "batch_id long, n int, row_ids array<long>, texts array<string>")
    echo = lambda messages, texts: [m["system"] + "|" + m["user"] for m in messages]
    raw = lb.run_labeller(lb.build_prompts(df), echo).first().raw
    assert raw.startswith(lb.SYSTEM_PROMPT + "|") and "[0] teks" in raw


def _answers():
    """Local to the test: workers do not import this module."""
    def answer(texts):
        return "[" + ", ".join(f'{{"index": {i}, "label": "positif"}}' for i in range(len(texts))) + "]"
    return answer


def test_a_dying_labeller_leaves_all_earlier_groups(spark):
    import os
    import pytest
    from pyspark.sql import functions as F
    from ulasan.operators.labelling import label_job
    from ulasan.session import scratch_path
    rows = spark.createDataFrame([(i, f"teks {i}") for i in range(100)], "row_id long, text string")
    state, dead = scratch_path(spark, "state"), scratch_path(spark, "dead").removeprefix("file://")

    answer = _answers()

    def dies(messages, texts):
        for m, t in zip(messages, texts):
            if any(x in ("teks 60",) for x in t) and not os.path.exists(dead):
                raise SystemExit("killed")
        return [answer(t) for t in texts]

    kw = {"size": 5, "task_batches": 1, "commit_tasks": 2}
    with pytest.raises(Exception):
        label_job(rows, state, dies, **kw)
    kept = spark.read.parquet(state)
    first = kept.count()
    assert 0 < first < 100 and kept.where("batch_id = 12").count() == 0
    os.mkdir(dead)
    assert label_job(rows, state, dies, **kw) == {"pending": 100 - first, "labelled": 100}
    whole = spark.read.parquet(state)
    assert whole.count() == 100 and whole.where(F.col("label") != "positif").count() == 0


def test_a_call_that_raises_leaves_its_prompt_pending(spark):
    from ulasan.operators.labelling import label_job
    from ulasan.session import scratch_path
    rows = spark.createDataFrame([(i, f"teks {i}") for i in range(20)], "row_id long, text string")
    state = scratch_path(spark, "state")

    answer = _answers()

    def fails(messages, texts):
        if any("teks 7" in t for t in texts):
            raise RuntimeError("no answer")
        return [answer(t) for t in texts]

    assert label_job(rows, state, fails, size=5) == {"pending": 20, "labelled": 15}
    assert spark.read.parquet(state).where("row_id BETWEEN 5 AND 9").count() == 0
    assert label_job(rows, state, lambda m, t: [answer(x) for x in t], size=5) == {"pending": 5, "labelled": 20}


def test_restore_labels_adds_the_column_and_keeps_what_there_is(spark):
    from ulasan import restore_labels, with_label_column
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (None, "d")], "row_id long, text string")
    state = spark.createDataFrame([(1, "positif", 1), (1, "negatif", 2), (3, None, 9), (8, "netral", 1)], "row_id long, label string, labelled_at long")
    say = lambda df: sorted((str(r.row_id), r.label) for r in df.collect())
    assert with_label_column(rows).columns == ["row_id", "text", "label"] and with_label_column(state) is state
    assert say(restore_labels(rows, state)) == [("1", "negatif"), ("2", None), ("3", None), ("None", None)]
    own = rows.selectExpr("*", "'netral' AS label")
    assert say(restore_labels(own, state)) == [("1", "negatif"), ("2", "netral"), ("3", "netral"), ("None", "netral")]
    assert say(restore_labels(rows, None)) == say(restore_labels(rows, state.drop("label"))) == [("1", None), ("2", None), ("3", None), ("None", None)]
