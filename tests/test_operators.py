"""Operators on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from textprep.functions import draws
from textprep.operators import corpus, evaluate, mcq, preference, sampling
from textprep.schemas import require_columns
from textprep.sources import adapters, files
from textprep.sources.catalog import Catalog
from textprep.sources.identity import with_row_id
from textprep.session import shared_path


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_prelettered(spark):
    df = spark.createDataFrame([("q", ["A)21 (A)", "B)3"], "A")], "question string, options array<string>, correct string")
    assert rows(mcq.from_prelettered(df, "s")) == [("q\nA.21 (A.\nB.3", "A.21 (A.", "s")]


def test_labels_keep_the_raw_key_in_compat(spark):
    df = spark.createDataFrame(
        [("q", (["x", "y"], ["1", "2"]), "2"), ("q", (["x", "y"], ["A", "B"]), "Z")],
        "question string, choices struct<text:array<string>,label:array<string>>, answerKey string",
    )
    assert [r["answer"] for r in mcq.from_labels(df, "s").collect()] == ["B. y", None]
    assert [r["answer"] for r in mcq.from_labels(df, "s", compat=True).collect()] == ["2. y", None]


def test_shuffled_options_keep_the_right_answer(spark):
    data = [(i, f"q{i}", "right", "w1", "w2", "w3", 0) for i in range(50)] + [(99, "q", "same", "same", "x", "y", 0)]
    df = spark.createDataFrame(data, "id long, question string, a string, b string, c string, d string, cop int")
    columns = ["a", "b", "c", "d"]
    first = mcq.from_columns_first(df, columns, "id", keep=("id",))
    index = mcq.from_columns_index(df, columns, "cop", "id", keep=("id",))
    for row in first.unionByName(index).collect():
        assert f"\n{row['answer']}" in row["question"]
        assert row["answer"][3:] == ("same" if row["id"] == 99 else "right")
    slipped = mcq.from_columns_index(df, columns, "cop", "id", compat=True).collect()
    assert any(not r["answer"].endswith("right") for r in slipped)
    assert all(r["answer"].startswith("A. ") for r in slipped)


def test_rows_without_options_are_dropped(spark):
    df = spark.createDataFrame([(1, "q", None)], "id long, question string, a string")
    assert mcq.from_columns_first(df, ["a"], "id").count() == 0


@pytest.mark.parametrize(
    "answer, expected, compat",
    [
        ("b2", "B. b2", "B. b2"),
        ("2", "B. b2", "B. b2"),
        ("b", "B. b2", "B. b2"),
        ("9", None, None),
        ("zz", None, None),
        ("", None, None),
        (None, None, None),
        ("['b2', 'c3']", "B. b2", None),
        ("[2]", "B. b2", "B. b2"),
    ],
)
def test_polymorphic_answer(spark, answer, expected, compat):
    df = spark.createDataFrame(
        [("mcq", "q", ["a1", "b2", "c3"], answer)],
        "question_type string, question_body string, question_options array<string>, question_answer string",
    )
    for mode, wanted in ((False, expected), (True, compat)):
        got = [r["answer"] for r in mcq.from_polymorphic(df, "s", compat=mode).collect()]
        assert got == ([] if wanted is None else [wanted]), (answer, mode)


def test_calibration_reads_wrapped_records(spark):
    df = spark.createDataFrame(
        [(1, ("q", ["w", "x", "y", "z", "extra"], 2))],
        "id long, train struct<question:string,choices:array<string>,answer:int>",
    )
    [(_, text)] = rows(mcq.calibration(df, "id"))
    assert text.endswith("q\nA. w\nB. x\nC. y\nD. z\nAnswer: C")


def test_templates_are_filled_literally(spark):
    templates = spark.createDataFrame([(0, "<question>|<question>")], "template_id int, template string")
    df = spark.createDataFrame([(1, "$1 \\ <b>")], "id long, question string")
    assert rows(mcq.fill_templates(df, templates, "id").select("question")) == [("$1 \\ <b>|$1 \\ <b>",)]


def test_templates_with_other_ids(spark):
    """Gaps, and ids that two files share: every row gets exactly one template."""
    df = spark.range(60).selectExpr("id", "'q' AS question")
    for ids in ([10, 11], [0, 1, 0, 1], [5]):
        items = [(i, f"{n} <question>") for n, i in enumerate(ids)]
        filled = mcq.fill_templates(df, spark.createDataFrame(items, "template_id int, template string"), "id")
        assert filled.count() == 60 and filled.select("question").distinct().count() == len(ids)


def test_advantage_of_rows_without_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), (1, 2.0)], "g int, reward double")
    assert evaluate.group_advantage(df, "g").count() == 3


def test_text_keys_order_like_bytes(spark):
    values = ["", "a", "ab", "abcdefg", "abcdefgh", "abcdefghz", "abcdefgi", "é", "b", "zz top zz top zz"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    keys = sampling.text_keys(df, "v")
    assert len(keys) == 3
    got = [r["v"] for r in df.orderBy(*keys.values()).collect()]
    assert got == sorted(values, key=lambda v: v.encode())


def test_filters_at_their_limits(spark):
    df = spark.createDataFrame([(1, "a b", "c"), (2, "a b", "c d")], "id long, question string, answer string")
    assert [r["id"] for r in sampling.within_pair_budget(df, "question", "answer", 4).collect()] == [1]
    texts = spark.createDataFrame([(1, "x " * 512), (2, "x " * 513)], "id long, text string")
    assert [r["id"] for r in corpus.limit_tokens(texts, "id").collect()] == [1]
    tagged = spark.createDataFrame([("a",), ("b",), (None,)], "source string")
    assert adapters.drop_source(tagged, "a").count() == 2


def test_blank_content(spark):
    values = ["x", "", " \t", "NaN", "null", " NULL ", None, "\xa0", "nullable"]
    df = spark.createDataFrame([(v,) for v in values], "text string")
    assert sorted(r["text"] for r in df.where(~corpus.is_blank(F.col("text"))).collect()) == ["nullable", "x"]


def test_corpus_texts(spark):
    wiki = spark.createDataFrame([("P", None, "", "body"), (None, None, None, None)], "page_title string, section_title string, breadcrumb string, text string")
    texts = [r["text"] for r in corpus.tagged(wiki).collect()]
    assert sorted(texts) == ["", "<page_title>P</page_title>\n<text>body</text>"]
    qa = spark.createDataFrame([("q", "a"), (None, "a"), ("", None)], "question string, answer string")
    assert sorted(tuple(r) for r in corpus.from_qa(qa, "default").collect()) == [("a", "default"), ("q\na", "default")]


def test_sign_and_domains(spark):
    context = [("user", "hi"), ("assistant", "yo")]
    df = spark.createDataFrame(
        [(context, "r1", "r2", p, "code") for p in (-1, 0, 2)],
        "context array<struct<role:string,content:string>>, response1 string, response2 string, overall_preference int, domain string",
    )
    got = preference.from_sign(preference.in_domains(df)).collect()
    assert {r["prompt"] for r in got} == {"user: hi\nassistant: yo"}
    assert sorted(r["chosen"] for r in got) == ["r1", "r2", "r2"]


def test_attach_reports_gaps(spark):
    requests = spark.createDataFrame([(1, "p"), (2, "p")], "id long, prompt string")
    responses = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "z"), (2, "a", "z")], "id long, model string, response string")
    attached = rows(preference.attach(requests, responses, "id", ["a", "b"]), "id")
    assert attached == [(1, "p", "x", "y"), (2, "p", "z", None)]
    assert rows(preference.missing(requests, responses, "id", ["a", "b"])) == [(2, "b")]
    assert rows(preference.duplicated(responses, "id")) == [(2, "a", 2)]


def test_accuracy_is_population_deviation(spark):
    data = [("s", run, int(i < hits)) for run, hits in ((0, 1), (1, 4), (2, 5)) for i in range(10)]
    df = spark.createDataFrame(data, "subject string, run int, correct int").withColumn("seconds", F.lit(1.0))
    [row] = evaluate.accuracy_runs(df, ["subject"], "run", "correct", "seconds").collect()
    assert round(row["std_accuracy"], 6) == 0.169967 and row["runs"] == [0.1, 0.4, 0.5]


def test_loglik_prefers_the_earlier_choice_on_ties(spark):
    df = spark.createDataFrame(
        [(1, 0, -1.0, 1, 0), (1, 1, -1.0, 4, 0), (2, 0, -9.0, 1, 1), (2, 1, -1.0, 1, 1)],
        "item int, choice int, score double, length int, gold int",
    )
    [row] = evaluate.loglik_accuracy(df).collect()
    assert (row["n_items"], row["acc"], row["acc_norm"]) == (2, 1.0, 0.5)


def test_require_columns(spark):
    df = spark.range(1)
    assert require_columns(df, ["id"]) is df
    with pytest.raises(ValueError, match=r"\['x'\].*\['id'\]"):
        require_columns(df, ["id", "x"])


def test_conform(spark):
    from textprep.schemas import SFT, conform

    df = spark.createDataFrame([("s", 1, "c", "x")], "source string, prompt int, completion string, more string")
    shaped = conform(df, SFT)
    assert shaped.columns == SFT.names and rows(shaped) == [("1", "c", "s")]
    with pytest.raises(ValueError, match="completion"):
        conform(df.drop("completion"), SFT)


def test_catalog(spark):
    path = shared_path(spark, "catalog")
    files.write_splits(spark.range(10).selectExpr("id", "if(id < 3, 'a', 'b') AS split"), path)
    catalog = Catalog().register("t", path, config="c", split_column="split")
    part = catalog.read_table(spark, "t", "c", "a")
    assert part.count() == 3
    assert "PartitionFilters: [isnotnull(split" in part._jdf.queryExecution().toString()
    with pytest.raises(KeyError):
        catalog.read_table(spark, "t", None, "a")


def test_csv_keeps_text(spark):
    texts = ['a "b" c', "x,y\nz", " lead and trail ", "", None, "\\", '"', "tab\tx\r\ny"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(texts)], "id int, text string")
    path = shared_path(spark, "csv")
    files.write_csv(df.coalesce(1), path)
    back = [r["text"] for r in files.read_csv(spark, path, df.schema).orderBy("id").collect()]
    assert back == [v or None for v in texts]


def test_json_numbers_arrive_as_text(spark):
    path = shared_path(spark, "json")
    spark.createDataFrame([('[{"question_type": "mcq", "question_answer": 3},\n {"question_answer": "x"}]',)], "v string").write.text(path)
    from textprep.schemas import MIXED_QUESTION

    got = [r["question_answer"] for r in files.read_json_array(spark, path, MIXED_QUESTION).collect()]
    assert got == ["3", "x"]


def test_row_ids_number_copies(spark, monkeypatch):
    from textprep.sources import identity

    monkeypatch.setattr(identity, "_COPIES_PER_TASK", 7)
    df = spark.createDataFrame([("hot", 1)] * 40 + [("x", None), ("y", 2)], "a string, b int")
    keyed = with_row_id(df)
    assert keyed.count() == 42 and keyed.select("row_id").distinct().count() == 42
    again = with_row_id(df.repartition(5))
    assert sorted(map(tuple, keyed.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)


def test_distill_pool(spark):
    mixed = spark.createDataFrame([(1, "open", "q", None, None)], "row_id long, question_type string, question_body string, question_options array<string>, question_answer string")
    science = spark.createDataFrame([(1, "s", "a", "b", "c", "d")], "row_id long, question string, correct_answer string, distractor1 string, distractor2 string, distractor3 string")
    math = spark.createDataFrame([(i, f"m{i}") for i in range(9)], "row_id long, prompt string")
    pool = {r["row_id"]: r for r in adapters.distill_pool(mixed, science, math, "mixed", math_rows=3).collect()}
    assert set(pool) == {"mixed:1", "science:1", "math:0", "math:1", "math:2"}
    assert pool["mixed:1"]["options"] == [] and pool["mixed:1"]["answer"] == ""
    assert sorted(pool["science:1"]["options"]) == ["a", "b", "c", "d"]
    assert pool["math:0"]["options"] == [""]


def test_group_advantage_of_a_constant_group(spark):
    df = spark.createDataFrame([(1, 1.5), (1, 1.5), (2, 0.0), (2, 1.0)], "g int, reward double")
    got = rows(evaluate.group_advantage(df, "g").select("g", F.round("advantage", 3)), "g", "reward")
    assert got == [(1, 0.0), (1, 0.0), (2, -0.707), (2, 0.707)]


def test_merge_splits_shuffles_each_split(spark):
    def part(prefix, n, split):
        return spark.range(n).select(
            F.concat(F.lit(prefix), "id").alias("row_id"), F.lit("q").alias("question"), F.lit("a").alias("answer"), F.lit("s").alias("source"),
            F.lit(split).alias("split"),
        )

    templates = spark.createDataFrame([(0, "T <question>")], "template_id int, template string")
    rows_ = part("a", 30, "train").union(part("b", 20, "train")).union(part("c", 10, "test"))
    merged = mcq.merge_splits(rows_, templates, "row_id")
    places = {}
    for r in merged.collect():
        assert r["question"] == "T q"
        places.setdefault(r["split"], []).append((r["position"], r["row_id"]))
    assert [p for p, _ in sorted(places["train"])] == list(range(1, 51))
    assert [p for p, _ in sorted(places["test"])] == list(range(1, 11))
    assert [i for _, i in sorted(places["train"])] != sorted(i for _, i in places["train"])


def test_hash_key_is_independent_of_partitioning(spark):
    base = spark.range(100).select("id", draws.hash_key(1, F.col("id")).alias("h"))
    again = spark.range(100).repartition(7).select("id", draws.hash_key(1, F.col("id")).alias("h"))
    assert sorted(map(tuple, base.collect())) == sorted(map(tuple, again.collect()))


def test_external_counter_in_limits(spark):
    """A Python token counter works below the filter; a NULL count keeps its row only without a limit."""
    from textprep.functions.text import counter

    df = spark.createDataFrame([(1, "a b"), (2, "a b c"), (3, None)], "id long, text string")
    words = counter(lambda text: text.split())
    assert rows(corpus.limit_tokens(df, "id", max_tokens=2, tok=words).select("id", "token_count")) == [(1, 2)]
    assert rows(corpus.with_tokens(df, words).select("id", "token_count"), "id") == [(1, 2), (2, 3), (3, None)]
    assert rows(corpus.with_tokens(df).select("id", "token_count"), "id") == [(1, 2), (2, 3), (3, None)]
    top = corpus.limit_tokens(df, "id", max_tokens=9, max_chunks=1, tok=words)
    assert rows(top.select("id")) == [(2,)]


def test_corpus_versions(spark):
    part = spark.createDataFrame([(i, "w " * i, "s") for i in range(1, 9)], "doc_id long, text string, source string")
    small = corpus.build([part, part], "doc_id", max_chunks=2, max_tokens=5)
    assert rows(small.select("doc_id", "token_count"), "doc_id") == [(4, 4), (4, 4), (5, 5), (5, 5)]
    assert corpus.build([part], "doc_id", small=False).count() == 8
    assert corpus.final_columns(small).columns == ["text", "source"]
