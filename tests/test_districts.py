from types import SimpleNamespace

from newsloom.plans import rulings


def test_late_aliases_are_found(spark):
    entities = spark.createDataFrame([(1, "district", "Early"), (2, "district", "Late")], "id long, entity_type string, canonical_name string")
    rows = [(1, f"Apatti{i:05d}") for i in range(2_100)] + [(2, "Zedpuram")]
    t = SimpleNamespace(entities=entities, entity_aliases=spark.createDataFrame(rows, "entity_id long, alias string"), documents=spark.createDataFrame([(7, "Rain fell in Zedpuram today.")], "doc_id long, text string").selectExpr("*", "cast(null as string) as title"))
    assert [tuple(r) for r in rulings.cls14_detected_districts(t).collect()] == [(7, "Late")]
