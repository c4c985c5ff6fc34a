"""Quality rules with a verdict by host, in DataFrame functions only.

Each document gets its measures and whether it fails the base rules. Failures are counted by host; a host's failure
rate is shrunk towards that of all hosts by a beta prior fitted to the hosts' rates (method of moments), and a host whose shrunk
rate is above the limit rejects all its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textprep.llm.tables import small_broadcast, written

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
WINDOW = 3
# A host is rejected when its shrunk failure rate is above this; one that mostly holds good texts never is.
MAX_HOST_RATE = 0.5
SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\x0c\r"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, _BLANKS, " " * len(_BLANKS)), " ", -1), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once: a lambda over a list of one."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that are found at least twice in the text.

    Windows are sorted by fingerprint, so equal ones are neighbours; the places of those, sorted, each cover up to
    three words beyond the place before.
    """
    n = F.size(words) - (WINDOW - 1)
    prints = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.struct(
            F.xxhash64(*[F.get(words, i + k - 1) for k in range(WINDOW)]).alias("print"), i.cast("int").alias("place")
        ),
    )

    def twice(ordered: Column) -> Column:
        at = lambda i: F.get(ordered, i)["print"]
        same = F.filter(
            ordered, lambda x, i: F.coalesce(at(i - 1) == x["print"], F.lit(False)) | F.coalesce(at(i + 1) == x["print"], F.lit(False))
        )
        return F.array_sort(F.transform(same, lambda x: x["place"]))

    def covered(places: Column) -> Column:
        step = F.transform(places, lambda p, i: F.least(F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(step, F.lit(0).cast("bigint"), lambda a, b: a + b)

    total = _let(F.sort_array(prints), lambda ordered: _let(twice(ordered), covered))
    return F.when(n > 1, total).otherwise(F.lit(0).cast("bigint"))


def measures(docs: DataFrame) -> DataFrame:
    """`doc_id`, the host and the measures of every whole text; a null text has no words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select("doc_id", F.col("source").cast("string").alias("host"), text.alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.trim(F.translate(x, _BLANKS, " " * len(_BLANKS))) != "")
    return base.select(
        "doc_id",
        "host",
        _let(
            _words(F.col("text")),
            lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), _repeated_words(w).alias("n_repeat_words")),
        ).alias("w"),
        F.length(F.translate("text", _BLANKS, "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
    ).select("doc_id", "host", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")


def _base_failed() -> Column:
    repeated = 100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    return (F.col("n_words") < MIN_WORDS) | repeated


def host_verdicts(measured: DataFrame) -> DataFrame:
    """(host, n, failed, rate, rejected) of each host; documents without source are one host.

    The prior beta(a, b) has the mean m of all documents and the strength a + b = m (1 - m) / v - 1, where v is the
    variance of host rates around m, weighted by documents, less what sampling explains; hosts that do not differ have an
    infinite strength, so that all get the mean.
    """
    hosts = measured.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("bigint")).alias("failed")
    )
    rate = F.col("failed") / F.col("n")
    sums = hosts.agg(
        F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.count(F.lit(1)).alias("hosts"),
        F.sum(F.col("n") * rate * rate).alias("squares"),
    ).first()
    n = sums["n"] or 1
    mean = (sums["failed"] or 0) / n
    between = (sums["squares"] or 0.0) - n * mean * mean
    variance = (between - (sums["hosts"] - 1) * mean * (1 - mean)) / n
    if variance > 0:
        strength = max(mean * (1 - mean) / variance - 1, 0.0)
        shrunk = (F.col("failed") + F.lit(strength * mean)) / (F.col("n") + F.lit(strength))
    else:
        shrunk = F.lit(mean)
    return hosts.select("host", "n", "failed", shrunk.alias("rate")).withColumn("rejected", F.col("rate") > MAX_HOST_RATE)


def rule_verdicts(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, the measures, base_failed, kept, host_rate.

    kept is false if the base rules fail (fewer than 50 words, or over half of the words in repeated windows) or if
    the host is rejected. Null, empty and blank texts have no words and fail. Repeated rows count each. The result of
    an empty table is empty. The measures go through one slim table; texts are read once and not shuffled, and a
    host that holds a third of all rows is summed by partial aggregation.
    """
    measured = written(measures(docs).withColumn("base_failed", _base_failed()), "measures")
    verdicts = written(
        host_verdicts(measured).select(F.col("host").alias("of_host"), F.col("rate").alias("host_rate"), "rejected"), "hosts"
    )
    joined = measured.join(small_broadcast(verdicts), F.col("host").eqNullSafe(F.col("of_host")))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.col("rejected")).alias("kept"), "host_rate",
    )
