"""Multiple-choice sources normalised to (question with lettered options, answer).

Each function replaces a row-at-a-time callback by array expressions, so a source of any size is
one narrow projection.  `compat=True` keeps three known slips of the original procedure, whose
output some users need to reproduce; the default does what was evidently meant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from textprep import fixed_values as fixed
from textprep.functions import draws
from textprep.functions.prompts import eval_query
from textprep.functions.text import letter, lettered_lines, present, strip
from textprep.operators.sampling import shuffle_positions
from textprep.plans.barrier import computed_once
from textprep.plans.sizing import broadcast_if_small
from textprep.sources.adapters import drop_source, union_by_name


def _as_qa(df: DataFrame, question: Column, answer: Column, source: str, keep: tuple[str, ...]) -> DataFrame:
    return df.select(*keep, question.alias("question"), answer.alias("answer"), F.lit(source).alias("source"))


def _labelled(index: Column, text: Column) -> Column:
    return F.concat(letter(index), F.lit(". "), text)


def dot_letters(c: Column, prefix: str = "") -> Column:
    """`A)` -> `A.` for A..E, wherever it stands after `prefix`."""
    return F.regexp_replace(c, rf"({prefix}[A-E])\)", "$1.")


def repair_letters(question: Column, answer: Column) -> tuple[Column, Column]:
    """Letter marks at line starts of the question and anywhere in the answer."""
    return dot_letters(question, "\n"), dot_letters(answer)


def _keyed_option(options: Column, key: Column) -> Column:
    return F.get(options, F.ascii(key) - F.lit(65))


def from_prelettered(df: DataFrame, source: str = fixed.SOURCE_TAGS["aqua"], keep: tuple[str, ...] = ()) -> DataFrame:
    """`question`, `options` that carry `A)`.., `correct` letter."""
    lines = F.array_join(
        F.transform("options", lambda o: F.concat(F.lit("\n"), dot_letters(o))), ""
    )
    answer = dot_letters(_keyed_option(F.col("options"), F.col("correct")))
    return _as_qa(df, F.concat("question", lines), answer, source, keep)


def with_rationale(df: DataFrame, source: str = fixed.SOURCE_TAGS["aqua"], keep: tuple[str, ...] = ()) -> DataFrame:
    """As `from_prelettered`, letters repaired at line starts, the rationale added to the answer."""
    question = F.concat(
        F.col("question"), F.array_join(F.transform("options", lambda o: F.concat(F.lit("\n"), o)), "")
    )
    question, answer = repair_letters(question, _keyed_option(F.col("options"), F.col("correct")))
    explained = F.concat(answer, F.lit("\nExplanation: "), F.col("rationale"))
    return _as_qa(df, question, explained, source, keep)


def from_labels(df: DataFrame, source: str, keep: tuple[str, ...] = (), compat: bool = False) -> DataFrame:
    """`question`, `choices` struct(text, label), `answerKey`; labels may be A.. or 1...

    The question is always lettered; compat repeats the raw key in the answer (`2. text`).
    """
    text, label, key = F.col("choices.text"), F.col("choices.label"), F.col("answerKey")
    position = F.array_position(label, key)
    index = F.when(position > 0, (position - 1).cast("int"))
    mark = key if compat else letter(index)
    answer = F.concat(mark, F.lit(". "), F.get(text, index))
    return _as_qa(df, F.concat("question", lettered_lines(text)), answer, source, keep)


def from_index(
    df: DataFrame, options: str = "choices", index: str = "answer", source: str = fixed.SOURCE_TAGS["mmlu"],
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """`question`, an array of options, the 0-based index of the right one."""
    answer = _labelled(F.col(index), F.get(options, F.col(index)))
    return _as_qa(df, F.concat("question", lettered_lines(F.col(options))), answer, source, keep)


def _shuffled_qa(df: DataFrame, options: Column, index, answer_text, source, keep, seed, id_col) -> DataFrame:
    """Shuffle the options, place the answer, and drop rows that have none to choose from."""
    staged = computed_once(df, "_order", draws.shuffled(seed, F.col(id_col), options))
    shown = F.transform("_order", lambda s: s["item"])
    staged = staged.withColumn("_shown", F.when(F.size("_order") > 0, shown))
    place = index(F.col("_order"), F.col("_shown"))
    answered = computed_once(staged, "_answer", _labelled(place, answer_text(F.col("_shown"), place)))
    lines = F.coalesce(lettered_lines(F.col("_shown")), F.lit(""))
    shaped = _as_qa(answered, F.concat("question", lines), F.col("_answer"), source, keep)
    return shaped.where(F.col("answer").isNotNull())


def from_columns_first(
    df: DataFrame, columns: list[str], id_col: str, seed: int = fixed.SEED,
    source: str = fixed.SOURCE_TAGS["sciq"], keep: tuple[str, ...] = (),
) -> DataFrame:
    """The first column is right; options are shuffled and the first equal text is marked."""

    def index(_, shown):
        return (F.array_position(shown, F.col(columns[0])) - 1).cast("int")

    return _shuffled_qa(
        df, F.array(*columns), index, lambda shown, i: F.col(columns[0]), source, keep, seed, id_col
    )


def from_columns_index(
    df: DataFrame, columns: list[str], index_col: str, id_col: str, seed: int = fixed.SEED,
    source: str = fixed.SOURCE_TAGS["medmcqa"], keep: tuple[str, ...] = (), compat: bool = False,
) -> DataFrame:
    """A 0-based index names the right column; options are shuffled.

    Default: the mark follows the right option.  Compat: the index is applied after the shuffle, so
    it marks whatever option landed there.
    """

    def index(order, _):
        if compat:
            return F.col(index_col)
        old_places = F.transform(order, lambda s: s["position"])
        return (F.array_position(old_places, F.col(index_col)) - 1).cast("int")

    return _shuffled_qa(
        df, F.array(*columns), index, lambda shown, i: F.get(shown, i), source, keep, seed, id_col
    )


def from_polymorphic(df: DataFrame, source: str, keep: tuple[str, ...] = (), compat: bool = False) -> DataFrame:
    """Mixed records: the answer is a text, an option number, or a list of right options.

    The first option that contains the answer wins; rows without a hit are dropped.  Of a list only
    the first element counts: by default the other listed options are removed, while compat removes
    every option contained in that first element, including itself.  List literals are parsed as
    data, never evaluated.
    """
    raw = F.col("question_answer")
    listed = F.when(
        raw.startswith("["),
        F.from_json(raw, "array<string>", {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}),
    )
    staged = df.where((F.col("question_type") == "mcq") & present(raw)).select(
        *keep, "question_body", "question_options", raw.alias("_raw"), listed.alias("_listed")
    )
    first = F.when(F.col("_raw").startswith("["), F.get("_listed", F.lit(0))).otherwise(F.col("_raw"))
    staged = staged.withColumn("_first", first)

    def dropped(option: Column) -> Column:
        if compat:
            return F.col("_first").contains(option)
        others = F.slice("_listed", 2, F.greatest(F.size("_listed") - 1, F.lit(0)))
        return F.array_contains(others, option)

    options = F.when(
        F.col("_listed").isNotNull(), F.filter("question_options", lambda o: ~dropped(o))
    ).otherwise(F.col("question_options"))
    staged = staged.withColumn("_options", options)
    number = F.when(F.col("_first").rlike("^[0-9]+$"), F.col("_first").try_cast("int"))
    wanted = F.coalesce(
        F.when(number >= 1, F.get("_options", number - 1)), F.col("_first")
    )
    staged = staged.withColumn("_wanted", wanted)
    places = F.filter(
        F.transform("_options", lambda o, i: F.when(o.contains(F.col("_wanted")), i)),
        lambda i: i.isNotNull(),
    )
    staged = computed_once(staged, "_place", F.get(places, F.lit(0))).where(F.col("_place").isNotNull())
    return _as_qa(
        staged,
        F.concat("question_body", lettered_lines(F.col("_options"))),
        _labelled(F.col("_place"), F.get("_options", F.col("_place"))),
        source,
        keep,
    )


def single_choice(df: DataFrame) -> DataFrame:
    return df.where(F.col("choice_type") == "single")


def in_subjects(df: DataFrame, subjects: list[str] = fixed.STEM_SUBJECTS, unfiltered: str = "auxiliary_train") -> DataFrame:
    """Keep the listed subjects in every split but the auxiliary one."""
    return df.where((F.col("split") == unfiltered) | F.col("subject").isin(subjects))


def fill_templates(
    df: DataFrame, templates: DataFrame, id_col: str, column: str = "question", seed: int = fixed.SEED
) -> DataFrame:
    """Put each text into a template drawn by row id; `<question>` is replaced literally.

    Ids must be 0 to n-1; others (several files, gaps) are numbered anew in the order of id and text.
    """
    templates = templates.select("template_id", "template")
    ids = templates.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("template_id").alias("different"), F.max("template_id").alias("last"), F.min("template_id").alias("first")
    ).first()
    if ids["n"] and not (ids["n"] == ids["different"] == ids["last"] + 1 and ids["first"] == 0):
        place = F.row_number().over(W.orderBy("template_id", "template")) - 1  # one small dimension
        templates = templates.select(place.alias("template_id"), "template")
    dimension, n = broadcast_if_small(templates)
    if not n:
        raise ValueError("no templates")
    drawn = df.withColumn("template_id", draws.pick(seed, n, F.col(id_col)).cast("int"))
    filled = F.replace("template", F.lit("<question>"), F.col(column))
    joined = drawn.join(dimension, "template_id")
    return joined.withColumn(column, filled).drop("template", "template_id")


def merge_splits(rows: DataFrame, templates: DataFrame, id_col: str, seed: int = fixed.SEED) -> DataFrame:
    """All sources with their `split`, shuffled within the split and put into templates.

    `position` is the place in the shuffle of the split; rows are not physically sorted.
    """
    return fill_templates(shuffle_positions(rows, id_col, seed, within="split"), templates, id_col, seed=seed)


def sft_mix(
    choice: DataFrame,
    aqua: DataFrame,
    open_sets: list[DataFrame],
    id_col: str,
    seed: int = fixed.SEED,
    replaced: str = fixed.SOURCE_TAGS["aqua"],
) -> DataFrame:
    """The supervised mix, shuffled: open question/answer sets, repaired choice rows, one source explained.

    `choice` loses the rows of source `replaced`, which come back from `aqua` with their rationale.
    All parts carry `id_col`, unique over the whole mix.
    """
    question, answer = repair_letters(F.col("question"), F.col("answer"))
    repaired = drop_source(choice, replaced).withColumns({"question": question, "answer": answer})
    explained = with_rationale(aqua, replaced, keep=(id_col,))
    return shuffle_positions(union_by_name([*open_sets, repaired, explained]), id_col, seed)


def calibration(df: DataFrame, id_col: str) -> DataFrame:
    """Prompts with the gold letter; a record may be wrapped in a struct `train`.  Sampling is `sample_n`."""
    record = "train." if "train" in df.columns else ""
    options = F.slice(F.col(f"{record}choices"), 1, 4)
    lines = F.array_join(
        F.transform(options, lambda o, i: F.concat(letter(i), F.lit(". "), o, F.lit("\n"))), ""
    )
    text = F.concat(
        F.lit(fixed.EVAL_PREAMBLE), F.col(f"{record}question"), F.lit("\n"), lines, F.lit("Answer: "),
        letter(F.col(f"{record}answer")),
    )
    return df.select(id_col, text.alias("text"))


def choice_lines(question: Column) -> Column:
    """Option lines of a question text (A. to J.), each with a leading space."""
    lines = F.split(question, "\n")
    kept = F.filter(lines, lambda line: strip(line).rlike(r"^[A-J]\."))
    return F.transform(kept, lambda line: F.concat(F.lit(" "), line))


def gold_index(answer: Column) -> Column:
    """0-based index of a leading letter or digit; NULL for anything else."""
    head = F.substring(answer, 1, 1)
    return (
        F.when(head.rlike("^[A-Z]$"), F.ascii(head) - 65)
        .when(head.rlike("^[0-9]$"), F.ascii(head) - 49)
        .cast("int")
    )


def eval_docs(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Evaluation items: prompt, choices found in the question, gold index, instruction."""
    return df.select(
        *keep,
        eval_query(F.col("question")).alias("query"),
        choice_lines(F.col("question")).alias("choices"),
        gold_index(F.col("answer")).alias("gold_index"),
        F.lit(fixed.EVAL_PREAMBLE).alias("instruction"),
    )


def exchange_rows(conversations: DataFrame, key: str = "conv_id", exact_turns: int | None = 2) -> DataFrame:
    """First turn as question, second as answer, from one row per turn.

    Plain aggregates with partial combine: a conversation with very many turns costs no memory.
    """
    pairs = conversations.groupBy(key).agg(
        F.count(F.lit(1)).alias("turns"),
        F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("question"),
        F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("answer"),
    )
    return pairs if exact_turns is None else pairs.where(F.col("turns") == exact_turns)


def first_exchange(turns: Column, content: str = "content") -> Column:
    """struct(question, answer) of a nested conversation."""
    return F.struct(
        F.get(turns, F.lit(0))[content].alias("question"), F.get(turns, F.lit(1))[content].alias("answer")
    )
