from lumenquarry.operators.cues import NAMES, AffectModel, cues
from pyspark.sql import functions as F


def test_cues_of_known_texts(spark):
    d = spark.createDataFrame([(0, "Not good, not bad!! Now?"), (1, None), (2, "")], "id bigint, text string")
    got = {r.id: dict(zip(NAMES, r.c, strict=True)) for r in d.select("id", cues(F.col("text")).alias("c")).collect()}
    assert {k: v for k, v in got[0].items() if v and k != "length"} == {"negative": 0.2, "positive": 0.2, "urgent": 0.2, "negation": 0.4, "exclaims": 0.4, "asks": 0.2, "shouts": 2 / 24, "repeats": 0.2}
    assert not any(got[1].values()) and not any(got[2].values())


def test_training_reads_texts_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    text = F.when(F.col("id") % 3 == 0, "good thanks").when(F.col("id") % 3 == 1, "bad! broken").otherwise("good and bad?")
    rows = spark.range(90).select("id", counted(text).alias("text"), (F.col("id") % 2).cast("string").alias("label"))
    model = AffectModel.train(rows, "text", "label", str(tmp_path / "model"))
    assert seen.value == 90
    assert model.predicted(rows, "id", "text").count() == 90 and seen.value == 180
