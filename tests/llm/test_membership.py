"""The filter before the shuffles: every member passes, few others do."""
import numpy as np

from shelfwise.llm import membership


def test_members_pass_and_few_others(spark):
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(-2**63, 2**63 - 1, 60_000, dtype=np.int64))
    inside, outside = keys[::2], keys[1::2]
    held = membership.members(spark.createDataFrame([(int(k),) for k in inside], "key long").repartition(5))
    assert held.may_have(inside).all() and held.may_have(outside).mean() < 0.001
    none = membership.members(spark.createDataFrame([], "key long"))
    assert not none.may_have(inside).any() and none.may_have(np.zeros(0, np.int64)).shape == (0,)
