"""Queries over multiple-choice normalisation, templates and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from textprep import fixed_values as fixed
from textprep.functions import draws, prompts
from textprep.operators import mcq, sampling
from textprep.plans.queries_sources import TEMPLATES, template_table
from textprep.plans.registry import hash_key, lettered, lit, n_tokens, query, render, strip, word
from textprep.sources import adapters

SEED = fixed.SEED


def _dotted(x: str, prefix: str = "") -> str:
    for name in "ABCDE":
        x = f"replace({x}, {lit(prefix + name + ')')}, {lit(prefix + name + '.')})"
    return x


def _source(key: str) -> str:
    return f"{lit(fixed.SOURCE_TAGS[key])} AS source"


def _order(row_id: str, options: str) -> str:
    """Options in seeded order as structs (h, p, o); p is the old place."""
    item = (
        "{'h': md5('" + str(SEED) + f"|' || CAST({row_id} AS VARCHAR) || '|' || CAST(i - 1 AS VARCHAR)), "
        "'p': i - 1, 'o': o}"
    )
    return f"list_sort(list_transform({options}, lambda o, i: {item}))"


_PARTS = "list_value(first, second, third, fourth)"
_STEP_ORDER = {"ordered": f"SELECT *, {_order('row_id', _PARTS)} AS ord FROM v_mcq_cols"}
_SHOWN = "list_transform(ord, lambda s: s.o)"


@query(
    "mcq_letter_options",
    f"SELECT row_id, question || {lettered('choices')} AS question FROM v_mcq_idx",
    views=("v_mcq_idx",),
)
def _(t):
    return mcq.from_index(t.v_mcq_idx, keep=("row_id",)).select("row_id", "question")


@query(
    "mcq_prelettered",
    f"""SELECT row_id, question || array_to_string(list_transform(options, lambda o: chr(10) || {_dotted('o')}), '') AS question,
               {_dotted('options[ascii(correct) - 64]')} AS answer, {_source('aqua')} FROM v_mcq_list""",
    views=("v_mcq_list",),
)
def _(t):
    return mcq.from_prelettered(t.v_mcq_list, keep=("row_id",))


def _label_check(mark: str) -> str:
    return f"""SELECT row_id, question || {lettered('text')} AS question,
                      {mark} || '. ' || text[place] AS answer, {_source('arc_challenge')}
               FROM (SELECT *, list_position(label, answer_key) AS place FROM v_mcq_label) AS v"""


def _labelled(t, compat):
    rows = t.v_mcq_label.select("row_id", "question", F.struct("text", "label").alias("choices"), F.col("answer_key").alias("answerKey"))
    return mcq.from_labels(rows, fixed.SOURCE_TAGS["arc_challenge"], ("row_id",), compat=compat)


@query("mcq_label_lookup", _label_check("chr(CAST(64 + place AS INT))"), views=("v_mcq_label",))
def _(t):
    return _labelled(t, compat=False)


@query("mcq_label_lookup_compat", _label_check("answer_key"), views=("v_mcq_label",))
def _(t):
    return _labelled(t, compat=True)


@query(
    "mcq_shuffle_refind",
    f"""SELECT row_id, question || {lettered(_SHOWN)} AS question,
               chr(CAST(64 + list_position({_SHOWN}, first) AS INT)) || '. ' || first AS answer, {_source('sciq')}
        FROM ordered""",
    views=("v_mcq_cols",),
    steps=_STEP_ORDER,
)
def _(t):
    return mcq.from_columns_first(t.v_mcq_cols, ["first", "second", "third", "fourth"], "row_id", keep=("row_id",))


def _index_check(place: str) -> str:
    return f"""SELECT row_id, question || {lettered(_SHOWN)} AS question,
                      chr(CAST(65 + {place} AS INT)) || '. ' || ord[{place} + 1].o AS answer, {_source('medmcqa')}
               FROM ordered WHERE choice_type = 'single'"""


def _indexed(t, compat):
    rows = mcq.single_choice(t.v_mcq_cols)
    return mcq.from_columns_index(
        rows, ["first", "second", "third", "fourth"], "cop", "row_id", keep=("row_id",), compat=compat
    )


@query(
    "mcq_index_then_shuffle",
    _index_check("(list_position(list_transform(ord, lambda s: s.p), cop) - 1)"),
    views=("v_mcq_cols",),
    steps=_STEP_ORDER,
)
def _(t):
    return _indexed(t, compat=False)


@query("mcq_index_then_shuffle_compat", _index_check("cop"), views=("v_mcq_cols",), steps=_STEP_ORDER)
def _(t):
    return _indexed(t, compat=True)


@query(
    "mcq_index_answer",
    f"""SELECT row_id, question || {lettered('choices')} AS question,
               chr(65 + answer) || '. ' || choices[answer + 1] AS answer, {_source('mmlu')} FROM v_mcq_idx""",
    views=("v_mcq_idx",),
)
def _(t):
    return mcq.from_index(t.v_mcq_idx, keep=("row_id",))


def _polymorphic_steps(keep: str) -> dict[str, str]:
    return {
        "parsed": """SELECT *, CASE WHEN question_answer LIKE '[%' THEN
                       CAST(json_extract(replace(question_answer, '''', '"'), '$') AS VARCHAR[]) END AS listed
                     FROM v_mixed WHERE question_type = 'mcq' AND coalesce(question_answer, '') <> ''""",
        "narrowed": f"""SELECT *, CASE WHEN listed IS NOT NULL THEN listed[1] ELSE question_answer END AS ans,
                       CASE WHEN listed IS NOT NULL THEN list_filter(question_options, lambda o: {keep})
                            ELSE question_options END AS opts FROM parsed""",
        "numbered": """SELECT *, CASE WHEN regexp_matches(ans, '^[0-9]+$') AND CAST(ans AS INT) BETWEEN 1 AND len(opts)
                            THEN opts[CAST(ans AS INT)] ELSE ans END AS wanted FROM narrowed""",
        "placed": """SELECT *, list_position(list_transform(opts, lambda o: contains(o, wanted)), true) AS place FROM numbered""",
    }


_POLYMORPHIC = f"""SELECT row_id, question_body || {lettered('opts')} AS question,
    chr(CAST(64 + place AS INT)) || '. ' || opts[place] AS answer, 'mixed' AS source FROM placed WHERE coalesce(place, 0) > 0"""


@query(
    "mcq_polymorphic_answer",
    _POLYMORPHIC,
    views=("v_mixed",),
    steps=_polymorphic_steps("NOT list_contains(listed[2:], o)"),
)
def _(t):
    return mcq.from_polymorphic(t.v_mixed, "mixed", ("row_id",))


@query(
    "mcq_polymorphic_answer_compat",
    _POLYMORPHIC,
    views=("v_mixed",),
    steps=_polymorphic_steps("NOT contains(listed[1], o)"),
)
def _(t):
    return mcq.from_polymorphic(t.v_mixed, "mixed", ("row_id",), compat=True)


@query(
    "option_shuffle",
    f"SELECT row_id, array_to_string({_SHOWN}, '|') AS options FROM ordered",
    views=("v_mcq_cols",),
    steps=_STEP_ORDER,
)
def _(t):
    order = draws.shuffled(SEED, F.col("row_id"), F.array("first", "second", "third", "fourth"))
    return t.v_mcq_cols.select(
        "row_id", F.array_join(F.transform(order, lambda s: s["item"]), "|").alias("options")
    )


_RAW_LINES = "question || array_to_string(list_transform(options, lambda o: chr(10) || o), '')"


@query(
    "mcq_repair_letters",
    f"""SELECT row_id, {_dotted(_RAW_LINES, chr(10))} AS question, {_dotted("options[ascii(correct) - 64] || ' (A)'")} AS answer
        FROM v_mcq_list""",
    views=("v_mcq_list",),
)
def _(t):
    raw = t.v_mcq_list.selectExpr(
        "row_id",
        "question || '\n' || array_join(options, '\n') AS question",
        "get(options, ascii(correct) - 65) || ' (A)' AS answer",
    )
    question, answer = mcq.repair_letters(F.col("question"), F.col("answer"))
    return raw.select("row_id", question.alias("question"), answer.alias("answer"))


@query(
    "mcq_rationale",
    f"""SELECT row_id, {_dotted(_RAW_LINES, chr(10))} AS question,
               {_dotted("options[ascii(correct) - 64]")} || chr(10) || 'Explanation: ' || rationale AS answer, {_source('aqua')}
        FROM v_mcq_list""",
    views=("v_mcq_list",),
)
def _(t):
    return mcq.with_rationale(t.v_mcq_list, keep=("row_id",))


_EVAL_STEPS = {
    "shaped": f"""SELECT row_id, question || {lettered('choices')} AS question,
                         chr(65 + answer) || '. ' || choices[answer + 1] AS answer FROM v_mcq_idx""",
    "choice": f"""SELECT row_id, question, answer,
        list_transform(list_filter(string_split(question, chr(10)),
                                   lambda x: regexp_matches({strip('x')}, '^[A-J]\\.')), lambda x: ' ' || x) AS found
        FROM shaped""",
}


def _evaluated(t):
    return mcq.eval_docs(mcq.from_index(t.v_mcq_idx, keep=("row_id",)), ("row_id",))


@query(
    "eval_extract_choices",
    "SELECT row_id, len(found) AS n_choices, array_to_string(found, '|') AS choices FROM choice",
    views=("v_mcq_idx",),
    steps=_EVAL_STEPS,
)
def _(t):
    return _evaluated(t).select("row_id", F.size("choices").alias("n_choices"), F.array_join("choices", "|").alias("choices"))


@query(
    "eval_gold_index",
    """SELECT row_id, CAST(CASE WHEN regexp_matches(answer_key, '^[A-Z]') THEN ascii(answer_key) - 65
                           WHEN regexp_matches(answer_key, '^[0-9]') THEN ascii(answer_key) - 49 END AS BIGINT) AS gold_index
       FROM v_mcq_label""",
    views=("v_mcq_label",),
)
def _(t):
    rows = _labelled(t, compat=True)
    return rows.select("row_id", mcq.gold_index(F.col("answer")).alias("gold_index"))


@query(
    "eval_doc",
    f"""SELECT row_id, {lit(fixed.EVAL_PREAMBLE)} || question || chr(10) || 'Answer:' AS query,
               CAST(ascii(answer) - 65 AS BIGINT) AS gold_index, {lit(fixed.EVAL_PREAMBLE)} AS instruction FROM shaped""",
    views=("v_mcq_idx",),
    steps=_EVAL_STEPS,
)
def _(t):
    return _evaluated(t).select("row_id", "query", "gold_index", "instruction")


@query(
    "calibration_prompt",
    f"""SELECT row_id, {lit(fixed.EVAL_PREAMBLE)} || question || chr(10) ||
           array_to_string(list_transform(choices[1:4], lambda o, i: chr(CAST(64 + i AS INT)) || '. ' || o || chr(10)), '')
           || 'Answer: ' || chr(65 + answer) AS text
        FROM v_mcq_idx""",
    views=("v_mcq_idx",),
)
def _(t):
    return mcq.calibration(t.v_mcq_idx, "row_id")


@query(
    "calibration_sample",
    f"SELECT row_id, question FROM v_mcq_idx ORDER BY {hash_key(SEED, 'row_id')}, row_id LIMIT 512",
    views=("v_mcq_idx",),
)
def _(t):
    rows = t.v_mcq_idx.select("row_id", "question")
    return sampling.sample_n(rows, fixed.CALIBRATION_SAMPLES, "row_id")


@query(
    "template_fill",
    f"""SELECT q.row_id, replace(template, '<question>', q.question) AS question
        FROM v_mcq_list AS q JOIN templates
          ON template_id = {word(SEED, 'q.row_id')} % (SELECT count(*) FROM templates)""",
    views=("v_mcq_list",),
    steps=TEMPLATES,
)
def _(t):
    return mcq.fill_templates(t.v_mcq_list.select("row_id", "question"), template_table(t), "row_id")


def _shots_text(mode: str) -> tuple[str, str]:
    before, after = fixed.EVAL_PROMPTS[mode].split("<|question|>")
    shots = [before + q + after + a for q, a in fixed.FEW_SHOT_EXAMPLES[mode]]
    return "\n\n".join([*shots, before]), after


def _few_shot_check() -> str:
    zero_before, zero_after = fixed.EVAL_PROMPTS["no_thinking"].split("<|question|>")
    plain_before, plain_after = _shots_text("no_thinking")
    think_before, think_after = _shots_text("thinking")
    return f"""SELECT row_id, {lit(zero_before)} || question || {lit(zero_after)} AS zero_shot,
                      {lit(plain_before)} || question || {lit(plain_after)} AS few_shot,
                      {lit(think_before)} || question || {lit(think_after)} AS few_shot_thinking FROM shaped"""


@query("few_shot_prompt", _few_shot_check(), views=("v_mcq_idx",), steps=_EVAL_STEPS)
def _(t):
    question = F.col("question")
    return mcq.from_index(t.v_mcq_idx, keep=("row_id",)).select(
        "row_id",
        prompts.few_shot(question, shots=0).alias("zero_shot"),
        prompts.few_shot(question).alias("few_shot"),
        prompts.few_shot(question, "thinking").alias("few_shot_thinking"),
    )


_HAS = "(len(options) > 0 AND NOT (len(options) = 1 AND options[1] = ''))"
_LIST = "'[''' || array_to_string(options, ''', ''') || ''']'"


def choose_sql(templates: dict[str, str], **more: str) -> str:
    values = {"question": "prompt", "options": _LIST, "answer": "answer", **more}
    filled = {kind: render(text, **values) for kind, text in templates.items()}
    return f"CASE WHEN {_HAS} AND answer <> '' THEN {filled['qoa']} WHEN {_HAS} THEN {filled['qo']} ELSE {filled['qa']} END"


@query(
    "template_choose",
    f"""SELECT row_id, {choose_sql(fixed.EXPLAIN_PROMPTS)} AS explain, {choose_sql(fixed.EXACT_FORMAT_PROMPTS)} AS exact
        FROM v_distill""",
    views=("v_distill",),
)
def _(t):
    inputs = (F.col("prompt"), F.col("options"), F.col("answer"))
    return t.v_distill.select(
        "row_id",
        prompts.choose(fixed.EXPLAIN_PROMPTS, *inputs).alias("explain"),
        prompts.choose(fixed.EXACT_FORMAT_PROMPTS, *inputs).alias("exact"),
    )


@query(
    "preference_prompt",
    f"""SELECT row_id, CASE WHEN {_HAS} THEN prompt || chr(10) || 'Options:' || chr(10) || array_to_string(options, chr(10))
               ELSE prompt END AS prompt FROM v_distill""",
    views=("v_distill",),
)
def _(t):
    return t.v_distill.select("row_id", prompts.with_options(F.col("prompt"), F.col("options")).alias("prompt"))


def nested_turns(t):
    """One row per conversation with its turns in order.

    Turns are gathered in blocks of 1024 first, so no sort ever sees a whole long conversation.
    """
    turn = F.struct("turn", F.col("role"), F.col("text").alias("content"))
    blocks = t.conversations.groupBy("conv_id", F.floor(F.col("turn") / 1024).alias("block")).agg(
        F.sort_array(F.collect_list(turn)).alias("turns")
    )
    ordered = F.sort_array(F.collect_list(F.struct("block", "turns")))
    return blocks.groupBy("conv_id").agg(F.flatten(F.transform(ordered, lambda b: b["turns"])).alias("context"))


CHATS = {
    "chats": """SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS chat
                FROM conversations GROUP BY conv_id"""
}


@query("chat_render", "SELECT conv_id, chat AS prompt FROM chats", steps=CHATS)
def _(t):
    return nested_turns(t).select("conv_id", prompts.chat(F.col("context")).alias("prompt"))


@query(
    "first_exchange",
    """SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS question, max(CASE WHEN turn = 1 THEN text END) AS answer
       FROM conversations GROUP BY conv_id""",
)
def _(t):
    return mcq.exchange_rows(t.conversations, exact_turns=None).drop("turns")


# --- whole tables ---------------------------------------------------------------------------------------------


def _tagged(df, prefix):
    return df.select(F.concat(F.lit(prefix), F.col("row_id").cast("string")).alias("row_id"), "question", "answer", "source")


_SPLIT = "CASE row_id % 10 WHEN 0 THEN 'validation' WHEN 1 THEN 'test' ELSE 'train' END"


def _mcq_rows(t):
    """All sources with the split of each row.

    The easy and the professional exam have no training rows, one source has no test rows, one nothing but training
    rows; the subject filter holds for the exam's validation and test rows, not for its auxiliary training rows.
    """
    keep, tags, index = ("row_id", "split"), fixed.SOURCE_TAGS, t.v_mcq_idx

    def tagged(df, prefix):
        return df.select(F.concat(F.lit(prefix), F.col("row_id").cast("string")).alias("row_id"), "question", "answer", "source", "split")

    listed, columns, labelled = (v.withColumn("split", F.expr(_SPLIT)) for v in (t.v_mcq_list, t.v_mcq_cols, t.v_mcq_label))
    labelled = labelled.select(*keep, "question", F.struct("text", "label").alias("choices"), F.col("answer_key").alias("answerKey"))
    options = ["first", "second", "third", "fourth"]
    return adapters.union_by_name(
        [
            tagged(mcq.from_prelettered(listed, keep=keep), "aqua-"),
            tagged(mcq.from_labels(labelled, tags["arc_challenge"], keep), "arc-"),
            tagged(mcq.from_labels(labelled.where("split <> 'train'"), tags["arc_easy"], keep), "easy-"),
            tagged(mcq.from_columns_index(mcq.single_choice(columns.where("split <> 'test'")), options, "cop", "row_id", keep=keep), "med-"),
            tagged(mcq.from_columns_first(columns, options, "row_id", keep=keep), "sciq-"),
            tagged(mcq.from_index(mcq.in_subjects(index), keep=keep), "mmlu-").replace("auxiliary_train", "train", "split"),
            tagged(mcq.from_index(index.where("split <> 'auxiliary_train'"), source=tags["mmlu_pro"], keep=keep), "pro-"),
            tagged(mcq.from_polymorphic(t.v_mixed, "mixed", ("row_id",)).withColumn("split", F.lit("train")), "mixed-"),
        ]
    )


_LABELLED = _label_check("chr(CAST(64 + place AS INT))")
_INDEX_ANSWER = "chr(65 + answer) || '. ' || choices[answer + 1]"
_SUBJECTS = ", ".join(lit(s) for s in fixed.STEM_SUBJECTS)
_DRAWN = f"template_id = {word(SEED, 'row_id')} % (SELECT count(*) FROM templates)"
_UNION_STEPS = {
    **_STEP_ORDER,
    **_polymorphic_steps("NOT list_contains(listed[2:], o)"),
    **TEMPLATES,
    "every": f"""
        SELECT 'aqua-' || row_id AS row_id, question || array_to_string(list_transform(options, lambda o: chr(10) || {_dotted('o')}), '') AS question,
               {_dotted('options[ascii(correct) - 64]')} AS answer, {_source('aqua')}, {_SPLIT} AS split FROM v_mcq_list
        UNION ALL SELECT 'arc-' || row_id, question, answer, source, {_SPLIT} FROM ({_LABELLED})
        UNION ALL SELECT 'easy-' || row_id, question, answer, {_source('arc_easy')}, {_SPLIT} FROM ({_LABELLED}) WHERE row_id % 10 < 2
        UNION ALL SELECT 'med-' || row_id, question, answer, source, {_SPLIT}
                  FROM ({_index_check("(list_position(list_transform(ord, lambda s: s.p), cop) - 1)")}) WHERE row_id % 10 <> 1
        UNION ALL SELECT 'sciq-' || row_id, question || {lettered(_SHOWN)}, chr(CAST(64 + list_position({_SHOWN}, first) AS INT)) || '. ' || first, {_source('sciq')}, {_SPLIT} FROM ordered
        UNION ALL SELECT 'mmlu-' || row_id, question || {lettered('choices')}, {_INDEX_ANSWER}, {_source('mmlu')}, replace(split, 'auxiliary_train', 'train')
                  FROM v_mcq_idx WHERE split = 'auxiliary_train' OR subject IN ({_SUBJECTS})
        UNION ALL SELECT 'pro-' || row_id, question || {lettered('choices')}, {_INDEX_ANSWER}, {_source('mmlu_pro')}, split
                  FROM v_mcq_idx WHERE split <> 'auxiliary_train'
        UNION ALL SELECT 'mixed-' || row_id, question, answer, source, 'train' FROM ({_POLYMORPHIC})""",
    "filled": f"""SELECT row_id, replace(template, '<question>', question) AS question, answer, source, split
                  FROM every JOIN templates ON {_DRAWN}""",
}
_UNION_VIEWS = ("v_mcq_list", "v_mcq_label", "v_mcq_cols", "v_mixed", "v_mcq_idx")
_PLACE = f"ORDER BY {hash_key(SEED, 'row_id')}, row_id"


@query(
    "union_by_name",
    "SELECT row_id, question, answer, source FROM every WHERE split = 'train'",
    views=_UNION_VIEWS,
    steps=_UNION_STEPS,
)
def _(t):
    return _mcq_rows(t).where("split = 'train'").drop("split")


@query(
    "mcq_table",
    f"SELECT row_id, question, answer, source, split, row_number() OVER (PARTITION BY split {_PLACE}) AS position FROM filled",
    views=_UNION_VIEWS,
    steps=_UNION_STEPS,
)
def _(t):
    return mcq.merge_splits(_mcq_rows(t), template_table(t), "row_id")


@query(
    "sft_table",
    f"""SELECT row_id, question, answer, source, 'train' AS split, row_number() OVER ({_PLACE}) AS position FROM (
          SELECT 'mcq-' || row_id AS row_id, {_dotted('question', chr(10))} AS question, {_dotted('answer')} AS answer, source
          FROM filled WHERE source IS DISTINCT FROM 'deepmind/aqua_rat' AND split = 'train'
          UNION ALL
          SELECT 'why-' || row_id, {_dotted(_RAW_LINES, chr(10))}, {_dotted("options[ascii(correct) - 64]")} || chr(10) || 'Explanation: ' || rationale,
                 'deepmind/aqua_rat' FROM v_mcq_list
          UNION ALL SELECT 'gsm-' || doc_id, text, lang, 'cais/gsm8k' FROM documents
          UNION ALL SELECT 'forum-' || doc_id, text, source, 'math-ai/StackMathQA' FROM documents
          UNION ALL SELECT d.row_id, replace(template, '<question>', d.text), d.source, 'unsloth/OpenMathReasoning'
                    FROM (SELECT 'reason-' || doc_id AS row_id, text, source FROM documents) AS d JOIN templates
                      ON template_id = {word(SEED, 'd.row_id')} % (SELECT count(*) FROM templates)
          UNION ALL SELECT 'chat-' || conv_id, question, answer, 'allenai/tulu-3-sft-mixture' FROM (
              SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS question, max(CASE WHEN turn = 1 THEN text END) AS answer
              FROM conversations GROUP BY conv_id) AS c
        ) AS u
        UNION ALL
        SELECT row_id, question, answer, source, split, row_number() OVER (PARTITION BY split {_PLACE}) FROM filled WHERE split <> 'train'""",
    views=_UNION_VIEWS,
    steps=_UNION_STEPS,
)
def _(t):
    """The mix for training; the other splits of the choice table pass through."""
    docs, tags, templates = t.documents, fixed.SOURCE_TAGS, template_table(t)
    gsm = docs.selectExpr("doc_id AS row_id", "text AS question", "lang AS answer")
    forum = docs.selectExpr("doc_id AS row_id", "text AS Q", "source AS A")
    reasoning = docs.selectExpr("doc_id AS row_id", "text AS problem", "source AS generated_solution")
    reasoning = _tagged(adapters.adapt(reasoning, adapters.MATH_REASONING, tags["math_reasoning"], ("row_id",)), "reason-")
    chats = mcq.exchange_rows(t.conversations, exact_turns=None).selectExpr("conv_id AS row_id", "question", "answer")
    filled = mcq.fill_templates(_mcq_rows(t), templates, "row_id")
    aqua = t.v_mcq_list.withColumn("row_id", F.concat(F.lit("why-"), F.col("row_id").cast("string")))
    open_sets = [
        _tagged(adapters.adapt(gsm, adapters.GSM8K, tags["gsm8k"], ("row_id",)), "gsm-"),
        _tagged(adapters.adapt(forum, adapters.MATH_FORUM, tags["math_forum"], ("row_id",)), "forum-"),
        mcq.fill_templates(reasoning, templates, "row_id"),
        _tagged(chats.withColumn("source", F.lit(tags["personas"])), "chat-"),
    ]
    train = mcq.sft_mix(_tagged(filled.where("split = 'train'"), "mcq-"), aqua, open_sets, "row_id")
    rest = sampling.shuffle_positions(filled.where("split <> 'train'"), "row_id", within="split")
    return train.withColumn("split", F.lit("train")).unionByName(rest)


@query(
    "rl_table",
    f"""SELECT row_id, prompt, final_answer, row_number() OVER (ORDER BY {hash_key(SEED, 'row_id')}, row_id) AS position
        FROM (SELECT row_id, question AS prompt, answer AS final_answer FROM every WHERE split = 'train') AS r
        WHERE {n_tokens('prompt')} + {n_tokens('final_answer')} < 25""",
    views=_UNION_VIEWS,
    steps=_UNION_STEPS,
)
def _(t):
    return sampling.rl_view(_mcq_rows(t).where("split = 'train'").drop("split"), "row_id", max_length=25)


@query(
    "distill_pool",
    f"""SELECT 'mixed:' || row_id AS row_id, question_body AS prompt, array_to_string(question_options, '|') AS options,
               coalesce(question_answer, '') AS answer, 'mixed' AS source FROM v_mixed
        UNION ALL SELECT 'science:' || row_id, question, array_to_string({_SHOWN}, '|'), first, 'sciq' FROM ordered
        UNION ALL SELECT 'math:' || doc_id, text, '', '', 'tulu3-personas-math' FROM documents""",
    views=("v_mcq_cols", "v_mixed"),
    steps=_STEP_ORDER,
)
def _(t):
    science = t.v_mcq_cols.selectExpr(
        "row_id", "question", "first AS correct_answer", "second AS distractor1", "third AS distractor2", "fourth AS distractor3"
    )
    math = t.documents.selectExpr("doc_id AS row_id", "text AS prompt")
    pool = adapters.distill_pool(t.v_mixed, science, math, "mixed")
    return pool.withColumn("options", F.array_join("options", "|"))
