"""Plan documents."""

from framewise.sources import plans as P


def test_a_shot_without_people_shows_its_subject(spark):
    docs = spark.createDataFrame([(1, '{"shots":[{"name":"a","subject_role":"m"}]}')], "plan int, doc string")
    p = P.read_reference_plans(docs)
    assert p.first().shots[0].subjects[0].role == "m"
