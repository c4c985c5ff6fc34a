"""The pipeline's stages, each on its own input, and all of them in order."""

import corpus_pipeline
import public_tokenizers
import tiktoken

from textprep.llm import byte_bpe, decontaminate, near_dedup, passages, quality


def test_pipeline(spark, tmp_path):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("labels", "benchmark"))
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "neighbour_quality", "minhash_near_dedup", "suffix_array_dedup", "decontamination", "byte_bpe",
    ]
    expected = {
        "neighbour_quality": lambda d: {r.doc_id for r in quality.quality(spark, d, labels).where("predicted = 1").collect()},
        "minhash_near_dedup": lambda d: {r.doc_id for r in near_dedup.near_duplicates(d).where("kept").collect()},
        "suffix_array_dedup": lambda d: {r.doc_id for r in d.select("doc_id").collect()},
        "decontamination": lambda d: {r.doc_id for r in decontaminate.contamination(spark, d, benchmark).where("NOT contaminated").collect()},
        "byte_bpe": lambda d: {r.doc_id for r in d.select("doc_id").collect()},
    }
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, folder).write.parquet(path)
        after = spark.read.parquet(path)
        kept = [r.doc_id for r in after.select("doc_id").collect()]
        assert set(kept) == expected[name](docs) and len(kept) == len(set(kept))
        if name != "byte_bpe":
            assert after.columns == columns
        if name == "suffix_array_dedup":
            assert passages.repeated_passages(after).count() == 0
        docs = after
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = docs.collect()
    assert all(r.ids == library.encode_ordinary(r.text) for r in rows) and len(rows) > 600


def test_empty_and_odd_tables(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, "/root/testdata/sf0.001")
            assert after.columns[: len(docs.columns)] == docs.columns, name
            assert after.count() <= docs.count()


def test_columns_of_the_last_stage(spark):
    """A document's own columns of the same names stay, and the stage's are all there under free names."""
    docs = spark.createDataFrame([(1, "two words", 7, "own")], "doc_id bigint, text string, N_Tokens int, ids string")
    after = dict(corpus_pipeline.STAGES)["byte_bpe"](spark, docs, "")
    assert after.columns == [*docs.columns, "n_tokens_", "ids_sha256", "decoded_sha256", "ids_"]
    row = after.collect()[0]
    assert tuple(row)[:4] == (1, "two words", 7, "own") and row["n_tokens_"] == len(row["ids_"]) > 0
