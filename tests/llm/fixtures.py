from pyspark.sql import types as T

ITEM = "id long, source_type string, source_name string, title string, raw_text_original string, clean_text_original string, language string, metadata_json map<string,string>"
ENTITY = "id long, entity_type string, role string"
ALIAS = "id long, entity_id long, alias string"


def items(spark, rows):
    """rows of dictionaries; what is left out is null."""
    schema = spark.createDataFrame([], ITEM).schema
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], T.StructType(schema.fields))


def entities(spark):
    """A source with two names, two journalists, a minister."""
    e = spark.createDataFrame([(1, "source", "news"), (2, "person", "journalist"), (3, "person", "journalist"), (4, "person", "minister")], ENTITY)
    a = spark.createDataFrame([(1, 1, "The  Post"), (2, 1, "Post Online"), (3, 2, "Ann Lee"), (4, 2, "Lee, Ann"), (5, 3, "Bo Ray"), (6, 4, "Cy Dow")], ALIAS)
    return e, a
