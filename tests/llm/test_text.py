import random
from itertools import accumulate

from pyspark.sql import functions as F

from netloom.llm.text import running


def test_running_sums_and_maxima(spark):
    r = random.Random(1)
    lists = [[], [4], *([r.randint(0, 9) for _ in range(n)] for n in (2, 3, 4, 5, 7, 8, 9, 63, 64, 65, 1000))]
    rows = spark.createDataFrame([(x,) for x in lists], "x array<int>").select("x", running(F.col("x")).alias("total"), running(F.col("x"), F.greatest).alias("most")).collect()
    assert all(row.total == list(accumulate(row.x)) and row.most == list(accumulate(row.x, max)) for row in rows)
    assert spark.createDataFrame([(None,)], "x array<int>").select(running(F.col("x"))).first()[0] is None
