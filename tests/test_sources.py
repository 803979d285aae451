"""Sources, text functions and incremental work."""

import pytest
from pyspark.sql import functions as F

from condensa.functions import text
from condensa.sources import jsonl
from condensa.streaming import incremental


def test_jsonl(spark, tmp_path):
    rows = spark.createDataFrame([("a", "c1", "p", "h", "yes"), ("b", "c1", None, "h", "no")], jsonl.TASKS["nli"])
    jsonl.write_jsonl(rows, str(tmp_path / "x"))
    back = jsonl.read_jsonl(spark, str(tmp_path / "x"), jsonl.TASKS["nli"])
    assert sorted(back.collect()) == sorted(rows.collect())
    ex = jsonl.examples(back, "nli").orderBy("id").collect()
    assert ex[0].asDict() == {"id": "a", "cluster": "c1", "task": "nli", "context": "p", "question": "h", "choices": None, "answer": "yes", "answers": None, "template": None, "subtask": None}
    assert jsonl.read_jsonl(spark, str(tmp_path / "x"), jsonl.TASKS["nli"], skip_suffix=".json").count() == 0
    with pytest.raises(ValueError):
        jsonl.examples(back, "other")
    assert [r.id for r in jsonl.first_rows(back, 1, "id").collect()] == ["a"]
    said = jsonl.manifest(rows, ["id"]).first().asDict()
    assert jsonl.verify(back, ["id"], said) == [] and len(jsonl.verify(back.limit(1), ["id"], said)) == 3
    assert jsonl.missing_rows(back, rows.limit(1)).count() == 1


def test_sample(spark):
    df = spark.range(100).selectExpr("id", "id % 3 g")
    a = {r.id for r in jsonl.hash_sample(df, 10, "id", 4).collect()}
    assert a == {r.id for r in jsonl.hash_sample(df.repartition(7), 10, "id", 4).collect()} and len(a) == 10
    assert jsonl.hash_sample(df, 5, "id", 4, ["g"]).groupBy("g").count().filter("count = 5").count() == 3


def test_text(spark):
    one = lambda c, x: spark.createDataFrame([(x,)], "x string").select(c(F.col("x"))).first()[0]
    assert one(text.tokens, "Ab12_c, ½") == ["ab", "12", "_", "c", ",", "½"]
    assert one(text.metric_tokens, "Hà Nội 2") == ["hà", "nội", "2"]
    assert one(text.is_punct, "…%") and one(text.is_punct, "") and not one(text.is_punct, "$")
    assert one(text.sentences, "One. Two! three") == ["One.", "Two!", "three"]
    assert one(text.detokenize, "a_b  , ( c ) …") == "a b, (c)…"
    assert one(text.without_reasoning, "<think>a\nb</think>c") == "c"
    assert [one(text.normalize_number, x) for x in ("1.000", "1,000", "2,5", "18.0")] == ["1000", "1000", "2.5", "18"]
    assert [one(text.normalize, x) for x in ("lòe", "loè", "Xoá", "huỵ", "HOÀ", "quý", "loàn", None)] == ["lòe", "lòe", "Xóa", "hụy", "HÒA", "quý", "loàn", None]
    assert [m.role for m in one(lambda x: text.chat_messages(F.lit("s"), x), "u")] == ["system", "user"]


def test_incremental(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "id long, text string")
    worked = incremental.fan_out(rows, "text", lambda once: once.select("h", F.upper("text").alias("up")))
    assert sorted((r.id, r.up) for r in worked.collect()) == [(1, "A"), (2, "B"), (3, "A"), (4, None)]
    assert {r.id for r in incremental.pending(rows, rows.filter("id > 2"), ["id"]).collect()} == {1, 2}
    src, out = tmp_path / "in", str(tmp_path / "out")
    for batch in ([(1, "a"), (2, "b")], [(2, "b"), (3, "c")]):
        jsonl_dir = str(src)
        spark.createDataFrame(batch, "id long, text string").coalesce(1).write.mode("append").json(jsonl_dir)
        incremental.append_once(spark, jsonl_dir, "id long, text string", out, str(tmp_path / "cp"), lambda df: df, ["id"]).awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]
