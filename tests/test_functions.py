import pytest
from pyspark.sql import functions as F

from loomline.functions import arrays, text
from loomline.operators import clean, dml, evaluate, inference, predicates
from loomline.operators.predicates import Sql, coerced


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first().y


@pytest.mark.parametrize(("given", "want"), [("Tiếng Việt có dấu", "Tieng Viet co dau"), ("Đang đi", "Dang di"), ("é́x", "ex"), (None, None)])
def test_accents(spark, given, want):
    assert one(spark, given, text.remove_accents("x")) == want


@pytest.mark.parametrize(("given", "want"), [("Câu 1. This is a question", "This is a question"), ("Cau 1 This", "This"), ("cAU 1. x", "cAU 1. x"), ("Câu nào dùng liều 5 mg?", "mg?"), ("Cau1 x", "Cau1 x"), ("  plain ", "plain")])
def test_better_question(spark, given, want):
    assert one(spark, given, text.better_question("x")) == want


def test_strict_marker(spark):
    assert one(spark, "Câu nào dùng liều 5 mg?", text.better_question("x", strict_marker=True)) == "Câu nào dùng liều 5 mg?"
    assert one(spark, "CÂU 12) x", text.better_question("x", strict_marker=True)) == "x"


@pytest.mark.parametrize(("given", "want"), [(["A. x", "B. y"], ["x", "y"]), (["A. x", "y"], ["A. x", "y"]), (["A. x", "A. y"], ["A. x", "A. y"]), ([], [])])
def test_better_options(spark, given, want):
    frame = spark.createDataFrame([(given,)], "x array<string>")
    assert frame.select(text.better_options("x").alias("y")).first().y == want


def test_normal_form_and_html(spark):
    assert one(spark, " Á b,\tC  đ!", text.normal_form("x")) == "a b c d"
    assert one(spark, "<p>a &lt;b&gt;</p><script>x<y</script><!-- > -->c &amp;amp;", text.clean_html("x")) == "a <b> c &amp;"


def test_unshuffle(spark):
    frame = spark.createDataFrame([([2, 0, 1, 3], "A"), ([2, 0, 1, 3], "E"), ([2, 0, 1, 3], None)], "m array<int>, a string")
    assert [r.y for r in frame.select(arrays.unshuffle("a", "m").alias("y")).collect()] == ["C", None, None]


def test_shuffle_round_trip(spark):
    items = spark.createDataFrame([(k, ["w", "x", "y", "z"][: k % 4 + 1], 0) for k in range(20)] + [(99, [], None)], "id long, options array<string>, answer_index int")
    mixed = clean.shuffle_options(items, 1)
    for r in mixed.collect():
        assert sorted(r.options) == ["w", "x", "y", "z"][: len(r.options)] and sorted(r.option_map) == list(range(len(r.options)))
        assert r.answer_index is None or (r.options[r.answer_index] == "w" and r.answer == "ABCD"[r.answer_index])
    back = clean.unshuffle_answers(mixed.select("id", F.lit(1).alias("shuffle"), "answer"), mixed.withColumn("shuffle", F.lit(1)))
    assert {r.answer for r in back.collect()} == {"A"} and back.count() == 20
    assert [r.option_map for r in mixed.collect()] != [r.option_map for r in clean.shuffle_options(items, 2).collect()]
    one_map = spark.createDataFrame([([2, 0, 1],)], "m array<int>").select(arrays.position_in("m", F.lit(2)).alias("p")).first().p
    assert one_map == 0


@pytest.mark.parametrize(("answers", "want"), [(["B", "A", "C"], "B"), (["B", "A", "A"], "A"), ([None, "D", "A"], "D"), ([None, None], None)])
def test_vote(spark, answers, want):
    frame = spark.createDataFrame([("m", 1, k, a) for k, a in enumerate(answers)], "model string, id long, run int, answer string")
    assert evaluate.vote(frame).first().answer == want


def test_coercions():
    assert coerced("=", [1, 2]) == ("IN", [1, 2]) and coerced("IN", 1) == ("=", 1) and coerced("!=", None) == ("IS NOT", None)
    assert coerced("not in", 3) == ("!=", 3) and coerced("!=", [1]) == ("NOT IN", [1]) and coerced("=", None) == ("IS", None)
    for bad in (("=", []), (">", [1]), ("~", 1)):
        with pytest.raises(ValueError):
            coerced(*bad)
    with pytest.raises(ValueError):
        predicates.where({"logical": "and", "conditions": []})


def test_where_reaches_the_scan(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").alias("o")
    tree = {"logical": "and", "alias": "o", "conditions": [{"field": "o_orderstatus", "operator": "=", "value": "F"}, {"field": "o_totalprice", "operator": ">=", "value": 10.0}]}
    frame = orders.filter(predicates.where(tree)).select("o_orderkey")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "derstatus,F)" in plan and "o_custkey" not in plan
    assert frame.count() == orders.filter("o_orderstatus = 'F' and o_totalprice >= 10").count()
    chosen = {"field": "o_custkey", "operator": "IN", "value": Sql("(select c_custkey from cust where c_custkey < 10)")}
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("cust")
    assert orders.filter(predicates.where(chosen)).count() == orders.filter("o_custkey < 10").count()


def test_numbering_and_null_order(spark):
    frame = spark.createDataFrame([(x,) for x in (3, None, 1, 2)], "x int").repartition(3)
    assert [r.x for r in frame.orderBy(*predicates.order_by(["x"])).collect()] == [1, 2, 3, None]
    assert [r.x for r in frame.orderBy(*predicates.order_by([{"field": "x", "direction": "desc"}])).collect()] == [None, 3, 2, 1]
    big = spark.range(1000).repartition(7)
    assert all(r.at == 999 - r.id for r in predicates.numbered(big, [F.desc("id")], "at").collect())
    assert predicates.numbered(big.limit(0), [F.col("id")], "at").count() == 0


def test_validators(spark):
    rows = [("123", True), ("12a", False)]
    assert all(one(spark, v, predicates.is_digits(F.col("x"))) == w for v, w in rows)
    assert one(spark, "0b5c1c5e-3f0e-4b8e-9a55-0123456789ab", predicates.is_uuid4(F.col("x"))) and not one(spark, "0b5c1c5e-3f0e-1b8e-9a55-0123456789ab", predicates.is_uuid4(F.col("x")))
    assert one(spark, "2024-01-31T10:00:00Z", predicates.is_time(F.col("x"))) and not one(spark, "2024-13-31", predicates.is_time(F.col("x")))
    assert one(spark, "a.b@example.org", predicates.is_email(F.col("x"))) and not one(spark, "a@b", predicates.is_email(F.col("x")))
    assert one(spark, "abcd1234", predicates.is_password(F.col("x"))) and one(spark, "Ann", predicates.is_name(F.col("x")))


def test_envelopes(spark):
    lines = spark.createDataFrame([('{"recordId":"task_1","modelOutput":{"id":"i","type":"message","model":"m","content":[{"text":"{\\"answer\\":\\"B\\"}"}],"stop_reason":"end","usage":{"input_tokens":3,"output_tokens":4}}}',), ("broken",)], "value string")
    made = inference.from_bedrock(lines)
    row = evaluate.usage_of(made).withColumn("answer", arrays.answer_of_envelope("value")).collect()
    assert (row[0].answer, row[0].tokens_in, row[0].tokens_out) == ("B", 3.0, 4.0) and row[1].answer is None
    assert one(spark, "```json\n[{\"a\": \"1\"}]\n```", inference.parse_list("x", "a string")) == [("1",)]
    for kind in inference.FORMATS:
        prompts = spark.createDataFrame([(7, "say")], "id long, content string")
        assert "task_7" in inference.request_lines(prompts, kind, "m", "sys", {"type": "json_object"}).first().line
    with pytest.raises(ValueError):
        inference.request_lines(prompts, "other", "m", "s")


def test_inference_retries_and_fails_by_batch(spark):
    prompts = spark.createDataFrame([(k, "bad" if k == 7 else f"p{k}") for k in range(45)], "id long, content string")

    def responder(batch):
        if "bad" in batch:
            raise RuntimeError("no")
        return [p.upper() for p in batch]

    rows = inference.infer(prompts, responder, size=20, epochs=2).collect()
    assert len(rows) == 90 and {r.status for r in rows if r.id < 20 and r.epoch == 1} == {400}
    assert all(r.answer == f"P{r.id}" for r in rows if r.status == 200)
    done = spark.createDataFrame([(r.id, r.status) for r in rows if r.epoch == 1], "id long, status int")
    assert inference.remaining(prompts, done).count() == 20 and not inference.is_finished(prompts, done.filter("status = 200"))


def test_tables(spark):
    t = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, None, 3.0)], "k long, s string, v double")
    s = spark.createDataFrame([(2, None, 5.0), (9, "n", 9.0)], "k long, s string, v double")
    assert sorted(map(tuple, dml.upsert(t, s, ["k"]).collect())) == [(1, "a", 1.0), (2, None, 5.0), (3, None, 3.0), (9, "n", 9.0)]
    assert dml.upsert(t, s, ["k"], mode="update").count() == 3 and dml.upsert(t, s, ["k"], mode="insert").count() == 4
    assert {r.s for r in dml.update(t, s, ["k"], ["v"]).collect()} == {"a", "b", None}
    with pytest.raises(ValueError):
        dml.update(t, s, [])
    made = dml.values(spark, [{"k": 1, "v": float("nan")}], "k long, v double", {"now": "'x'"})
    assert tuple(made.first()) == (1, None, "x") and dml.ordered_columns(t, ["s"]) == ["k", "v"]
    q = spark.createDataFrame([(2, None, None), (1, True, False), (3, False, True)], "id long, done boolean, skip boolean")
    assert dml.first_open(q, "done", "skip", "id").first().id == 2


def test_listed_levels_without_rows(spark):
    frame = spark.createDataFrame([("m", 1, "Easy", "A", "A"), ("m", 1, "Odd", "A", None)], "model string, run int, level string, gold string, answer string")
    got = {r.difficulty_level: (r.cnt_correct, r.cnt_total, r.accuracy) for r in evaluate.accuracy(frame, levels=["Easy", "Hard"]).collect()}
    assert got == {"Easy": (1, 1, 1.0), "Hard": (0, 0, 0.0), "All": (1, 1, 1.0)}
