from lexmill.llm.mojibake import repair, repaired
from pyspark.sql import functions as F


def test_a_lost_letter_alone_is_found(spark):
    texts = ["la constituci?n del estado", "¿por qué? no", "texto llano?", "A?b", "La constituci?n ├í"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: (r.r.restored, r.r.garbled_places, r.r.is_restored) for r in df.select("t", repaired(F.col("t")).alias("r")).collect()}
    assert got == {t: repair(t) for t in texts}  # what the filter lets through is what the detector finds
    assert got[texts[0]] == (texts[0], 1, False)
