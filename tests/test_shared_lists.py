import numpy as np
import pytest

from duochron.operators import clock as C
from duochron.operators.knn import knn
from test_queries import frames_equal


class Stop(Exception):
    pass


def test_clocks_of_shared_lists_have_the_graph_of_their_own(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.integers(0, 4, (80, 3)).astype(float)  # copies and equal distances
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, va array<double>").cache()
    seen = []

    def kernel(near):
        seen.append(near.toPandas())
        raise Stop

    monkeypatch.setitem(C.KERNELS, "gauss", kernel)
    longest = knn(df, "id", "va", 19).cache()
    for edges in (None, longest):
        with pytest.raises(Stop):
            C.diffusion_clock(df, "id", "va", 0, 8, edges=edges)
    assert frames_equal(seen[1], seen[0]) is None and len(seen[0]) == 80 * 7
