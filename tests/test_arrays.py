import itertools
import random

from pyspark.sql import functions as F

from tidewater.functions.arrays import RUN, running_max, running_sum


def test_running_sums_and_maxima(spark):
    rng = random.Random(1)
    rows = [None, [], [5], *[[rng.randrange(100) for _ in range(n)] for n in (2, RUN - 1, RUN, RUN + 1, 5 * RUN + 3)]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v array<int>")
    got = {r.i: (r.s, r.m) for r in df.select("i", running_sum(F.col("v")).alias("s"), running_max(F.col("v")).alias("m")).collect()}
    for i, r in enumerate(rows):
        assert got[i] == ((None, None) if r is None else (list(itertools.accumulate(r)), list(itertools.accumulate(r, max))))
