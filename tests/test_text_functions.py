"""Unicode folding on inline rows."""

from pyspark.sql import functions as F

from tidemark.functions.text import folded, normalized


def test_folding(spark):
    rows = [("ＰＳＡ　１０  鑑定 ",), ("ﾚﾘｰﾌ",), ("ブラック・マジシャン",), ("A-b_C!",), ("",), (None,)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "t string").select(normalized(F.col("t")), folded(F.col("t"))).collect()]
    assert got == [("PSA 10 鑑定", "psa10鑑定"), ("レリーフ", "れりーふ"), ("ブラック・マジシャン", "ぶらっくまじしゃん"), ("A-b_C!", "abc"), ("", ""), (None, None)]
