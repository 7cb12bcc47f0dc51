from pyspark.sql import functions as F

from faultline.functions import lexicon, risk, suggest
from faultline.operators import routing


def level(spark, narrative, label, floor=None):
    frame = spark.createDataFrame([(narrative, label, floor)], "narrative string, label string, floor string")
    return risk.with_incident_risk(frame, floor="floor").first()["risk_level"]


def test_documented_examples(spark):
    assert level(spark, "Engine fire at FL350", "x") == "critical"
    assert level(spark, "Paperwork completed", "x") == "medium"


def test_precedence(spark):
    assert level(spark, "smoke seen", "Ground Incursion Runway") == "critical"
    assert level(spark, "weather was bad", "Conflict NMAC") == "critical"
    assert level(spark, "nothing", "Ground Incursion Runway") == "high"
    assert level(spark, "heavy icing", "x") == "high"
    assert level(spark, None, None) == "medium"


def test_floor_only_raises(spark):
    assert level(spark, "paperwork", "x", "high") == "high"
    assert level(spark, "explosion", "x", "high") == "critical"
    assert level(spark, "paperwork", "x", None) == "medium"


def test_substring_matching_is_kept(spark):
    frame = spark.createDataFrame([("Extra fuel was loaded",)], "narrative string")
    phrases = routing.with_risk_phrases(frame).first()["phrases"]
    assert phrases == ["TCAS RA / resolution advisory", "Fuel issue"]


def test_suggestion(spark):
    frame = spark.createDataFrame(
        [("Fuel leak seen", "Aircraft Equipment Problem engine fuel", "HIGH"), ("", "", "odd"), (None, None, None)],
        "narrative string, predicted_label string, risk_level string",
    )
    first, second, third = (r["suggestion"] for r in suggest.with_suggestion(frame).collect())
    assert first.startswith("PRIORITY ACTION") and first.endswith("Risk factors detected: Fuel issue.")
    actions = first.split("Recommended actions: ")[1].split(". Risk")[0].split("; ")
    assert actions == lexicon.LABEL_ACTIONS["engine"]
    assert second == third == lexicon.LEVEL_SUGGESTIONS["medium"]


def test_label_only_factors_come_last(spark):
    low = spark.createDataFrame([("cable fire", "fuel storm")], "t string, l string")
    got = low.select(suggest.risk_factors(F.col("t"), F.col("l")).alias("f")).first()["f"]
    assert got == ["Fire / smoke", "Underground cable fault", "Fuel issue", "Severe weather (grid)"]


def test_routes(spark):
    questions = {
        "": "empty",
        "  Data QUALITY?": "quality",
        "analyze the problem": "quality",
        "Give me a summary of the safety dataset": "safety",
        "class distribution": "classes",
        "analyze engine smoke": "analyze",
        "summary": "summary",
        "hello": "help",
    }
    frame = spark.createDataFrame([(q,) for q in questions], "query string")
    assert {r["query"]: r["route"] for r in routing.with_route(frame).collect()} == questions


def test_answers(spark):
    rows = [(i, f"engine trouble number {i}", "Engine" if i % 3 else "Other", "Aviation") for i in range(30)]
    frame = spark.createDataFrame(rows, "incident_id long, narrative string, label string, domain string")
    assert {r["metric"] for r in routing.answer(frame, "quality").collect()} >= {"Total rows", "Distinct classes"}
    assert [r["n"] for r in routing.answer(frame, "safety").collect()] == [20, 0, 10]
    assert routing.answer(frame, "classes").first()["n"] == 20
    assert [r["phrase"] for r in routing.answer(frame, "analyze Smoke in cabin").collect()] == ["Fire / smoke"]
    assert routing.answer(frame, "summary").first()["total_reports"] == 30
    assert routing.answer(frame, "hello").count() == 6
