"""Time the headline queries and print one JSON line.

Every query is built anew and its whole result is written to Spark's `noop` sink, so nothing is
collected; jobs that run while a query is built are part of its time.
"""

from __future__ import annotations

import json
import os
import time

# One or two per area; the flagship is `raft_samples`.
HEADLINE = [
    "source_json",
    "csv_roundtrip",
    "split_partition_counts",
    "mcq_label_lookup",
    "mcq_shuffle_refind",
    "mcq_polymorphic_answer",
    "mcq_table",
    "sft_table",
    "template_fill",
    "template_choose",
    "chat_render",
    "answers_attach",
    "preference_pairs",
    "preference_dataset",
    "judge_requests",
    "token_usage_batches",
    "seeded_shuffle_rank",
    "exact_split",
    "top_n_tokens",
    "top_n_per_source",
    "corpus_union",
    "token_count",
    "knn_l2",
    "knn_cosine",
    "knn_jaccard",
    "retrieval_results",
    "raft_samples",
    "raft_prompts",
    "label_mask",
    "reward_group_advantage",
    "eval_accuracy_runs",
    "eval_loglik_acc",
    "incremental_append",
]


def main() -> None:
    from textprep.plans.catalogue import QUERIES
    from textprep.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cores, shuffle_partitions=int(cores))

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("token_stats")  # starts the executors and the first code generation
    seconds = {name: round(run(name), 3) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
