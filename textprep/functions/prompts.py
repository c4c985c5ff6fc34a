"""Prompt texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from textprep import fixed_values as fixed
from textprep.functions.text import present, quoted_list, render


def has_options(options: Column) -> Column:
    """True unless the array is NULL, empty, or holds a single empty text."""
    blank = (F.size(options) == 1) & (F.get(options, F.lit(0)) == "")
    return F.coalesce((F.size(options) > 0) & ~blank, F.lit(False))


def choose(templates: dict[str, str], question: Column, options: Column, answer: Column, **more: Column) -> Column:
    """Pick the template by what the row holds and fill it."""
    values = {"question": question, "options": quoted_list(options), "answer": answer, **more}
    filled = {kind: render(text, **values) for kind, text in templates.items()}
    return (
        F.when(has_options(options) & present(answer), filled["qoa"])
        .when(has_options(options), filled["qo"])
        .otherwise(filled["qa"])
    )


def few_shot(question: Column, mode: str = "no_thinking", shots: int | None = None, examples=None) -> Column:
    """Evaluation prompt, preceded by `shots` worked examples (None: all, 0: none)."""
    if mode not in fixed.EVAL_PROMPTS:
        raise ValueError(f"mode must be one of {list(fixed.EVAL_PROMPTS)}, got {mode!r}")
    before, after = fixed.EVAL_PROMPTS[mode].split("<|question|>")
    worked = (fixed.FEW_SHOT_EXAMPLES[mode] if examples is None else examples)[:shots]
    prefix = "".join(f"{before}{q}{after}{a}\n\n" for q, a in worked)
    return F.concat(F.lit(prefix + before), question, F.lit(after))


def eval_query(question: Column) -> Column:
    return F.concat(F.lit(fixed.EVAL_PREAMBLE), question, F.lit("\nAnswer:"))


def chat(turns: Column) -> Column:
    """`role: content` per turn; `turns` is array<struct<role, content>> in order."""
    return F.array_join(
        F.transform(turns, lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n"
    )


def with_options(question: Column, options: Column) -> Column:
    """The question, followed by its options one per line where there are any."""
    block = F.concat(question, F.lit("\nOptions:\n"), F.array_join(options, "\n"))
    return F.when(has_options(options), block).otherwise(question)


def serve_prompt(documents: Column, question: Column) -> Column:
    """All retrieved texts as context, or the fixed sentence when there are none."""
    joined = F.array_join(documents, "\n\n")
    context = F.when(F.coalesce(F.size(documents), F.lit(0)) > 0, joined).otherwise(
        F.lit(fixed.NO_RELEVANT_DOCUMENTS)
    )
    return render(fixed.SERVE_PROMPT, context=context, question=question)


def viewer_prompt(documents: Column, question: Column, shown: int = 3, max_chars: int = 500) -> Column:
    """The first `shown` texts, cut to `max_chars` each; the bare question without documents."""
    context = F.array_join(
        F.transform(F.slice(documents, 1, shown), lambda d: F.left(d, F.lit(max_chars))), "\n\n"
    )
    return F.when(
        F.coalesce(F.size(documents), F.lit(0)) > 0,
        render(fixed.VIEWER_PROMPT, context=context, question=question),
    ).otherwise(render(fixed.BARE_PROMPT, question=question))


def preview(c: Column, max_chars: int) -> Column:
    return F.when(
        F.length(c) > max_chars, F.concat(F.left(c, F.lit(max_chars)), F.lit("..."))
    ).otherwise(c)
