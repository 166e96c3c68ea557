"""The plan that draws surrogates stays small, since the driver holds and analyzes it in every round of attempts."""

from pyspark.sql import functions as F

from vellumite.llm import pii


def test_the_plan_of_surrogates_is_small(spark):
    entity = spark.createDataFrame([("Smith", "surname", "x", "surname:smith")], "entity string, kind string, gender string, form string")
    tries = F.struct(F.lit(0).alias("attempt"), F.lit(None).cast("string").alias("gender"))
    made = pii.with_surrogates(entity.select(F.array(F.struct("*")).alias("e")), "e", "m", "secret", lambda i, x: tries)
    assert len(made._jdf.queryExecution().analyzed().toString()) < 30_000
    assert made.select(F.element_at("m", 1)).first()[0] not in (None, "Smith")


def test_no_plan_repeats_the_search_in_its_filters(spark, monkeypatch):
    sizes, plain = [], pii.durable
    monkeypatch.setattr(pii, "durable", lambda df: sizes.append(len(df._jdf.queryExecution().optimizedPlan().toString())) or plain(df))
    docs = spark.createDataFrame([(1, "Mr. John Smith, a.b@c.org"), (2, "Dr. Ann Smith"), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.pseudonymize(docs, "secret").collect()}
    assert rows[3].text is None and rows[1].n_entities == 2 and "Smith" not in rows[1].text + rows[2].text
    assert max(sizes) < 40_000
