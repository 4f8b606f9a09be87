"""Table functions called from SQL against the DataFrame forms."""

import pytest
from pyspark.sql import functions as F

from ravelin.functions import tables
from ravelin.functions import text as X
from ravelin.operators import kg


def test_sentences_as_rows(spark):
    tables.register(spark)
    docs = spark.createDataFrame([(1, "甲。 乙！丙"), (2, None), (3, "")], "id long, text string")
    docs.createOrReplaceTempView("sentence_docs")
    rows = spark.sql("SELECT id, s.pos, s.sentence FROM sentence_docs, LATERAL ravelin_sentence_rows(text) AS s")
    expected = docs.select("id", F.posexplode(X.split_sentences(F.col("text"))))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, expected.collect())) and rows.count() == 3


def test_extractions_as_rows(spark):
    tables.register(spark)
    answers = [("c1", 'Sure: ```{"entities": [{"name": "A", "type": "person", "n": 1}], "relations": [{"head": "A", "relation": "r", "tail": "B"}]}```'), ("c2", "talk"), ("c3", None), ("c4", '{"entities": {}}'), ("c5", "}{"), ("c6", '{"entities": [{"name": 7}, 3]}')]
    df = spark.createDataFrame(answers, "chunk_id string, raw string")
    df.createOrReplaceTempView("answers_sql")
    names = spark.sql("SELECT chunk_id, e.* FROM answers_sql, LATERAL ravelin_extracted(raw, 'entities') AS e")
    assert names.columns == ["chunk_id", "name", "type", "description"]
    assert sorted(map(tuple, names.collect()), key=repr) == [("c1", "A", "person", None), ("c6", "7", None, None)]
    found = spark.sql("SELECT chunk_id, r.head, r.relation, r.tail FROM answers_sql, LATERAL ravelin_extracted(raw, 'relations') AS r").collect()
    valid = kg.valid_extraction(df).where("ok").select("chunk", F.explode("triples").alias("t")).select("chunk", "t.head", "t.relation", "t.tail").collect()
    assert list(map(tuple, found)) == list(map(tuple, valid)) == [("c1", "A", "r", "B")]
    with pytest.raises(Exception, match="kind"):
        spark.sql("SELECT * FROM answers_sql, LATERAL ravelin_extracted(raw, 'other') AS e").collect()
