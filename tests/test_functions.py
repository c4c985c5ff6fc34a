"""Hand-derived cases of the column expressions."""

import pytest
from pyspark.sql import functions as F

from textprep import fixed_values as fixed
from textprep.functions import answers, draws, prompts, rewards, text
from textprep.operators import evaluate, mcq, preference, raft

X = F.col("x")


@pytest.mark.parametrize(
    "raw", [" a b　\x85\n", "\xa0 x ", "\x1c\x1f", "", "plain", "\x0b\x0cé "]
)
def test_strip_follows_unicode(one, raw):
    assert one(text.strip(X), x=raw) == raw.strip()
    assert one(text.lstrip(X), x=raw) == raw.lstrip()


@pytest.mark.parametrize(
    "raw, expected",
    [("", 0), ("one two", 2), ("a-b, c1!", 6), ("é😀 x", 3), ("\x0b\x0c\t\n\r ", 0), ("A1b2", 1)],
)
def test_token_count(one, raw, expected):
    assert one(text.token_count(X), x=raw) == expected
    assert one(F.size(text.tokens(X)), x=raw) == expected


def test_truncate(one):
    assert tuple(one(text.truncate(X, 3), x="a b, c d")) == ("a b ,", 3)
    assert tuple(one(text.truncate(X, 5), x="a  b, c d")) == ("a  b, c d", 5)


def test_external_counter_excludes_failures(spark):
    def encode(value):
        if value == "bad":
            raise ValueError(value)
        return value.split()

    rows = spark.createDataFrame([(1, "a b c"), (2, "bad"), (3, None)], "id int, x string")
    counted = rows.select("id", text.counter(encode)(X).alias("n")).orderBy("id").collect()
    assert [r["n"] for r in counted] == [3, None, None]


def test_quoted_list_matches_python(spark):
    cases = [["a", "b"], ["it's", 'say "x"'], ["both ' and \""], ["back\\slash", "new\nline"], []]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, x array<string>")
    shown = rows.select("i", text.quoted_list(X).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in shown] == [str(c) for c in cases]


def test_render_does_not_rescan(one):
    rendered = text.render("{a}-{b}", a=X, b=F.lit("$1\\"))
    assert one(rendered, x="{b}") == "{b}-$1\\"


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("<think>a</think>\n b</think>", "b</think>"),
        ("no tag", "no tag"),
        ("</think>", ""),
        (None, None),
    ],
)
def test_after_think(one, raw, expected):
    assert one(answers.after_think(X.cast("string")), x=raw) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("pre Correct answer: B\n\nExplanation: k</s>", "Correct answer: B\n\nExplanation: k"),
        ("no marker </s>", "no marker"),
        ("answer: x Answer: y", "answer: x Answer: y"),
        (None, None),
    ],
)
def test_from_first_marker(one, raw, expected):
    assert one(answers.from_first_marker(X.cast("string")), x=raw) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("q Correct answer: C\nassistant\n\nC. foo", "C. foo"),
        ("Answer: x answer: y", "answer: y"),
        ("x", "x"),
        ("ASSISTANT hello", "hello"),
        ("Correct answer: Z", "answer: Z"),
        (None, None),
    ],
)
def test_from_last_marker(one, raw, expected):
    assert one(answers.from_last_marker(X.cast("string")), x=raw) == expected


def test_without_think(one):
    raw = "<think>a\nanswer: b</think> so answer: C\n<think>again</think>"
    assert one(answers.without_think(X), x=raw) == "C"
    assert one(answers.without_think(X), x="  plain ") == "plain"


def test_after_last(one):
    column = answers.after_last(X, F.lit("prompt "))
    assert one(column, x="Answer: a Answer: b \nrest") == "b"
    assert one(column, x="prompt  tail\nmore") == "tail"
    assert one(column, x="prompt ") == fixed.NO_CLEAR_ANSWER


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("Ranking: B > A > C", ["B", "A", "C"]),
        ("blah Ranking: A > C > B. ", ["A", "C", "B"]),
        ("Ranking: A > A > B..", ["A", "A", "B"]),
        ("Ranking: A > B", None),
        ("Ranking: A > B > D", None),
        ("Ranking: A > B > C because", None),
        ("A > B > C", None),
        ("Ranking: x Ranking: A > B > C", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_ranking(one, raw, expected):
    assert one(preference.parse_ranking(X.cast("string")), x=raw) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [("A. ", 0.5), ("A.\n", 0.0), ("A.\n\nfoo", 0.5), ("A.\r", 0.5), ("F. x", 0.0), ("see B.x", 0.5), ("", 0.0)],
)
def test_format_reward(one, raw, expected):
    assert one(rewards.format_reward(X), x=raw) == expected


@pytest.mark.parametrize(
    "raw, expected", [("B. x \nmore", 1.0), ("\nB. x", -1.0), ("b. x", -1.0), ("B. x", 1.0)]
)
def test_correctness_reward(one, raw, expected):
    assert one(rewards.correctness_reward(X, F.lit("B. x")), x=raw) == expected


@pytest.mark.parametrize(
    "raw, key, expected",
    [
        ("B. x\nmore", "B. x", True),
        ("B. x \nmore", "B. x", False),
        ("b. X", "B. x", True),
        ("B. x", "B. x\ny", False),
    ],
)
def test_is_correct(one, raw, key, expected):
    assert one(evaluate.is_correct(X, F.lit(key)), x=raw) is expected


def test_choices_and_gold(one):
    assert one(mcq.choice_lines(X), x="q\nA. x\n \tB. y\nK. z") == [" A. x", "  \tB. y"]
    assert one(mcq.gold_index(X), x="B. y") == 1
    assert one(mcq.gold_index(X), x="2. y") == 1
    assert one(mcq.gold_index(X), x="?") is None


def test_template_choice(spark):
    rows = spark.createDataFrame(
        [(1, ["a"], "x"), (2, ["a"], ""), (3, [""], ""), (4, None, "x"), (5, [], None)],
        "id int, options array<string>, answer string",
    )
    templates = {"qoa": "qoa", "qo": "qo", "qa": "qa"}
    chosen = rows.select("id", prompts.choose(templates, F.lit("q"), F.col("options"), F.col("answer")).alias("t"))
    assert [r["t"] for r in chosen.orderBy("id").collect()] == ["qoa", "qo", "qa", "qa", "qa"]


def test_few_shot(one):
    zero = one(prompts.few_shot(X, shots=0), x="Q")
    full = one(prompts.few_shot(X, "thinking"), x="Q")
    assert zero.endswith("\n\nQ\nAnswer:") and full.endswith("\n\nQ\n Thinking and Answer:")
    assert full.count("Thinking and Answer:") == 6
    with pytest.raises(ValueError):
        prompts.few_shot(X, "other")


def test_serving_prompts(spark):
    rows = spark.createDataFrame([(["a" * 600, "b", "c", "d"],), ([],), (None,)], "docs array<string>")
    got = rows.select(
        prompts.serve_prompt(F.col("docs"), F.lit("Q")).alias("serve"),
        prompts.viewer_prompt(F.col("docs"), F.lit("Q")).alias("view"),
    ).collect()
    assert "a" * 600 + "\n\nb\n\nc\n\nd" in got[0]["serve"]
    assert "a" * 500 + "\n\nb\n\nc\n\nQuestion: Q" in got[0]["view"] and "a" * 501 not in got[0]["view"]
    for row in got[1:]:
        assert fixed.NO_RELEVANT_DOCUMENTS in row["serve"]
        assert row["view"] == "Question: Q\nAnswer:"


def test_raft_prompt(one):
    none = F.array().cast("array<string>")
    empty = raft.prompt(F.lit("Q"), F.lit("G"), none, F.lit(""), F.lit(False))
    assert one(empty) == f"Context:\n{fixed.NO_DOCUMENTS}\n\nQuestion: Q\n\nAnswer:"
    parts = raft.distractor_list(F.lit(" d1 ||| ||| d2"))
    full = raft.prompt(F.lit("Q"), F.lit("G"), parts, F.lit("A"), F.lit(True))
    assert one(full) == (
        "Context:\nRelevant Document:\nG\n\nDistractor Document 1:\nd1\n\nDistractor Document 2:\nd2"
        "\n\nQuestion: Q\n\nAnswer: A"
    )


def test_valid_is_strict(one):
    assert one(raft.valid(F.lit("x" * 11), F.lit(" " + "y" * 11))) is True
    assert one(raft.valid(F.lit("x" * 10), F.lit("y" * 11))) is False
    assert one(raft.valid(F.lit(None).cast("string"), F.lit("y" * 11))) is False


def test_labels(one):
    ids = raft.padded(F.array(*[F.lit(i) for i in range(1, 6)]), 8, 0)
    assert one(ids) == [1, 2, 3, 4, 5, 0, 0, 0]
    assert one(raft.labels(ids, F.lit(2), 8)) == [-100, -100, 3, 4, 5, 0, 0, 0]
    assert one(raft.labels(ids, F.lit(99), 8)) == [-100] * 8
    assert one(raft.padded(F.array(*[F.lit(i) for i in range(9)]), 4, 0)) == [0, 1, 2, 3]


def test_draws_are_even_and_stable(spark):
    rows = spark.range(20_000)
    picks = rows.groupBy(draws.pick(1, 10, F.col("id")).alias("p")).count().collect()
    assert len(picks) == 10 and all(abs(r["count"] - 2000) < 250 for r in picks)
    share = rows.where(draws.unit(1, F.col("id")) < 0.8).count()
    assert abs(share - 16_000) < 300


def test_preview(one):
    assert one(prompts.preview(X, 3), x="abcd") == "abc..."
    assert one(prompts.preview(X, 4), x="abcd") == "abcd"
