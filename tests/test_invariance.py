"""Results do not depend on how the input is partitioned or ordered."""

import pytest
from pyspark.sql import functions as F

from textprep.plans import catalogue  # noqa: F401 - fills the registry
from textprep.plans.registry import BUILDERS
from textprep.plans.tables import Tables

NAMES = [
    "exact_split",
    "seeded_shuffle_rank",
    "token_usage_batches",
    "top_n_per_source",
    "corpus_union",
    "option_shuffle",
    "mcq_table",
    "preference_dataset",
    "answers_attach",
    "chat_render",
    "row_identity",
    "raft_samples",
    "knn_l2_pruned",
    "knn_jaccard",
    "reward_group_advantage",
    "eval_accuracy_runs",
]


class Scattered(Tables):
    """The same tables, spread over `parts` tasks in another order."""

    def __init__(self, spark, folder, parts):
        super().__init__(spark, folder)
        self._parts = parts

    def _read(self, name):
        table = super()._read(name)
        key = F.xxhash64(F.lit(self._parts), table.columns[0])
        return table.repartition(self._parts, key).sortWithinPartitions(key)


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("name", NAMES)
def test_partitioning_does_not_matter(name, spark, sf_dir):
    expected = rows(BUILDERS[name](Tables(spark, sf_dir)))
    for parts in (1, 7):
        assert rows(BUILDERS[name](Scattered(spark, sf_dir, parts))) == expected
