from pyspark.sql import functions as F

from newsloom.operators import analyzer as a
from newsloom.operators import cards as cd
from newsloom.operators import places as pl

LONG = "The ward council met in the town hall and talked about many things for a long time that day, and the members of the panel heard people from all over the taluk, and so on. "


def run(spark, rows, lens=a.Lens()):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, title string, body string, url string")
    return {r["id"]: r for r in a.analyze(df, lens).collect()}


def test_gates_and_record(spark):
    rows = [
        ("Water shortage", LONG + "A water shortage hit 40 families. The collector approved a plan.", "https://n.example/a"), ("Live updates", LONG, None), ("Win", "short", None), (None, None, None),
        ("Cricket", LONG + "Cricket again.", None), ("Match", LONG, "https://n.example/sport/1"), ("Cabinet", LONG + "The cabinet rejected it.", None), ("Elsewhere", "In a neighbouring state there was a debate on prices. " * 5, None),
    ]
    got = run(spark, rows)
    assert [got[i]["gate"] for i in range(8)] == [None, "listing", "listing", "listing", "out-of-scope", "out-of-scope", None, "out-of-scope"]
    one = got[0]
    assert (one["people_issue"], one["public_issue"], one["stance"], one["government_relevance"], one["action_type"]) == (True, "drinking water", "positive", "high", "field_verification")
    assert one["next_step"].startswith("Send someone to check drinking water") and one["actors"] == ["council"] and one["positive_points"]
    assert (got[1]["confidence"], got[1]["government_relevance"], got[1]["actors"], got[3]["summary"]) == (0.25, "none", [], "")
    assert (got[6]["subject_relevance"], got[6]["portrayal"], got[6]["action_type"], got[6]["action_owner"]) == ("high", "negative", "internal_review", "leadership office")
    second = run(spark, rows, a.SECOND)
    assert second[0]["subject_relevance"] == "medium" and second[0]["confidence"] == 0.65 and second[0]["portrayal"] == "neutral"


def test_words_have_edges(spark):
    t = a.Terms(("dam", "bus"), ("நீர்",))
    df = spark.createDataFrame([("damage",), ("a dam, new",), ("பேருந்துbus",), ("குடிநீர் இல்லை",), ("BUS_stop",), ("Bus.",)], "x string")
    assert [r[0] for r in df.select(t.found(F.col("x"))).collect()] == [False, True, True, True, False, True]  # a combining mark is no letter


def test_cascade_takes_the_first_that_answers(spark):
    one = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    two = spark.createDataFrame([(1, "b"), (2, "c"), (3, "d")], "k long, v string")
    assert {tuple(r) for r in a.cascade([("x", one), ("y", two)], "k", "v").collect()} == {(1, "a", "x"), (2, "c", "y"), (3, "d", "y")}


def test_districts(spark):
    known = spark.createDataFrame([("rosi", "Rosi"), ("rosi nagar", "Nagar"), ("t. kulam", "Kulam"), ("tkulam", "Kulam"), ("ரோசி", "Rosi")], "alias string, district string")
    rows = [("in Rosi Nagar today", "Rosi"), (None, "prosit and then tkulam and Rosi"), ("ரோசிபட்டி", "tkulam"), ("none", None), (None, None)]
    got = pl.detected_districts(spark.createDataFrame(rows, "title string, text string"), known, ("title", "text")).select("district").collect()
    assert [r[0] for r in got] == ["Nagar", "Kulam", "Rosi", None, None]
    said = spark.createDataFrame([("Rosi District",), (" ROSI ",), ("Tk.ulam",), ("unknown",), (None,), ("x",)], "d string")
    assert [r["c"] for r in pl.canonical_districts(said, "d", known, "c").collect()] == ["Rosi", "Rosi", "Kulam", None, None, None]
    assert pl.detected_districts(said.select(F.col("d").alias("t")), known.limit(0), ("t",)).where("district is not null").count() == 0


def test_departments(spark):
    names = ["Department of  Drinking Water", "SPORTS", "sports wing", "Old Things", "general", "", None, "empowerment cell"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "d string").select(pl.canonical_department(F.col("d"))).collect()]
    assert got == ["Water Supply", "Sports", "Sports", "Old Things", None, None, None, "Energy"]


def test_responsibility_and_alerts(spark):
    schema = "raw_item_id long, public_issue string, department string, district string, district_canonical string, category string, people_issue boolean, action_priority string, severity string, needs_human_review boolean, at long"
    rows = [(1, "no water", "general", "Rosi", "Rosi", "people", True, "high", "low", False, 5), (2, "", "sports", None, None, "positive", False, "", "low", True, 6), (3, "", "unknown", None, None, "negative", False, None, "critical", True, 7), (4, None, None, None, None, "negative", None, "low", None, None, 8)]
    df = spark.createDataFrame(rows, schema)
    members = spark.createDataFrame([("Rosi", f"m{i}") for i in range(8)], "district string, name string")
    got = {r["raw_item_id"]: r for r in pl.responsibility(df, members).collect()}
    assert (got[1]["department_owner"], got[1]["member_count"], got[1]["members"].count(";"), got[1]["escalate"]) == ("Water Supply", 8, 5, True)
    assert got[2]["department_owner"] == "Sports" and got[3]["escalate"] and not got[4]["actionable"]
    assert [r["raw_item_id"] for r in cd.alerts(df).collect()] == [3, 1]
    tiles = {r["district"]: r for r in pl.district_rollup(df, spark.createDataFrame([("Rosi",), ("Quiet",)], "district string")).collect()}
    assert (tiles["Rosi"]["dominant"], tiles["Rosi"]["top_issues"], tiles["Quiet"]["dominant"], tiles["<unmapped>"]["total"]) == ("people", "no water x1", "quiet", 3)
    groups = [(r["grp"], r["raw_item_id"]) for r in cd.briefing_groups(df.withColumn("ord", -F.col("at"))).collect()]
    assert [i for g, i in groups if g == "concern"] == [4, 3, 2, 1] and [i for g, i in groups if g == "positive"] == [2]


def test_helpers(spark):
    df = spark.createDataFrame([("School Street is closed",), ("a school fire",), (None,)], "x string")
    assert [r[0] for r in df.select(a.school_context(F.coalesce("x", F.lit("")))).collect()] == [False, True, False]
    assert [r[0] for r in df.select(a.explicit_subject(F.col("x"), F.lit("The cabinet met. Then more."), a.Lens().subject)).collect()] == [True] * 3
    steps = spark.createDataFrame([("",), (None,), ("Monitor it",), ("Visit the ward",)], "s string")
    assert [r[0] for r in steps.select(a.vague_step(F.col("s"))).collect()] == [True, True, True, False]
