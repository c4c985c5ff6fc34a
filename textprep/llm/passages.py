"""Passages that repeat verbatim across documents, by sparse suffixes grouped by hash.

Suffixes are retained only at minimisers: of the 8-word shingles at 26 neighbouring positions the least one. Every
passage of 50 words thus holds a retained suffix that its own words select, with at least 25 words of the passage to
the right, so equal passages retain equal suffixes. Suffixes are not sorted and neighbours not compared: grouping by
a hash of those 25 words stands in for it. Runs of neighbouring suffixes, cut where a hash of the words says so, are one
class if their hashes and distances are equal, so a family of near copies is grouped by its different runs. Where a group holds different documents, all windows of 50 words that
select its suffix are grouped by hash in turn; windows that some other document holds and that overlap or touch
are one passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, functions as F

from textprep.llm.annotate import free_name
from textprep.llm.batches import SPACED_WORD, Words, in_pieces, mixed, signed, spans, windows
from textprep.llm.tables import small_broadcast, written

PASSAGE_WORDS = 50
SHINGLE_WORDS = 8
SPREAD = 26  # positions among which a minimiser is chosen
RUN_SUFFIXES = 4  # retained suffixes of a run, on average
PREFIX_WORDS = PASSAGE_WORDS - SPREAD + 1  # words to the right that equal passages share at a retained suffix


def _passage_starts(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(p, s): the position of every 50-word window, and of the retained suffix that it selects."""
    room = np.maximum(words.counts - PASSAGE_WORDS + 1, 0)
    starts = spans(words.offsets[:-1], room)
    if not len(starts):
        return starts, starts
    shingles = windows(words.hash, SHINGLE_WORDS, seed=21)
    choice = np.argmin(sliding_window_view(shingles, SPREAD), axis=1)  # the leftmost of equal ones
    return starts, starts + choice[starts]


def _suffix_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of retained suffixes of each text: position, fingerprint, and of each suffix the distance and its leading words' fingerprint."""
    for batch in batches:
        for rows, data, offsets in in_pieces(batch, "text"):
            words = Words(data, offsets, SPACED_WORD)
            _, chosen = _passage_starts(words)
            kept = chosen[np.concatenate([[True], chosen[1:] != chosen[:-1]])] if len(chosen) else chosen
            lead = windows(words.hash, PREFIX_WORDS, seed=22)[kept] if len(kept) else np.zeros(0, np.uint64)
            text = np.searchsorted(kept, words.offsets)
            begins = mixed(lead) % np.uint64(RUN_SUFFIXES) == 0
            begins[text[:-1][text[:-1] < text[1:]]] = True
            firsts = np.flatnonzero(begins)
            n = np.diff(np.append(firsts, len(kept)))
            steps = kept - np.repeat(kept[firsts], n)
            prints = np.zeros(0, np.uint64)
            if len(firsts):
                place = (np.arange(len(kept)) - np.repeat(firsts, n)).astype(np.uint64)
                prints = mixed(np.add.reduceat(mixed(mixed(lead + mixed(steps.astype(np.uint64))) + place), firsts) + n.astype(np.uint64))
            lists, inner = np.searchsorted(firsts, text).astype(np.int32), np.append(firsts, len(kept)).astype(np.int32)
            own = kept[firsts] - np.repeat(words.offsets[:-1], np.diff(lists))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    rows.column("digest"),
                    pa.array(words.counts, pa.int64()),
                    pa.ListArray.from_arrays(lists, pa.array(own, pa.int32())),
                    pa.ListArray.from_arrays(lists, pa.array(signed(prints), pa.int64())),
                    pa.ListArray.from_arrays(lists, pa.ListArray.from_arrays(inner, pa.array(steps, pa.int32()))),
                    pa.ListArray.from_arrays(lists, pa.ListArray.from_arrays(inner, pa.array(signed(lead), pa.int64()))),
                ],
                ["doc_id", "digest", "n_words", "firsts", "runs", "steps", "leads"],
            )


def _extensions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The 50-word windows around the given suffixes of each text: position and fingerprint."""
    for batch in batches:
        for rows, data, offsets in in_pieces(batch, "text"):
            words = Words(data, offsets, SPACED_WORD)
            starts, chosen = _passage_starts(words)
            places = rows.column("places")
            given = places.flatten().to_numpy(zero_copy_only=False) + np.repeat(
                words.offsets[:-1], pc.list_value_length(places).to_numpy(zero_copy_only=False)
            )
            starts = starts[np.isin(chosen, given)]
            text = np.searchsorted(words.offsets, starts, side="right") - 1
            prints = windows(words.hash, PASSAGE_WORDS, seed=23)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc").take(pa.array(text)),
                    rows.column("digest").take(pa.array(text)),
                    pa.array(starts - words.offsets[text], pa.int32()),
                    pa.array(signed(prints[starts]) if len(starts) else [], pa.int64()),
                ],
                ["doc", "digest", "place", "print"],
            )


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut word ranges (sorted, apart) out of each text; the last two columns have their starts and ends."""
    for batch in batches:
        at = batch.schema.get_field_index("text")
        for rows, data, offsets in in_pieces(batch, "text"):
            words = Words(data, offsets, SPACED_WORD)
            starts, ends = rows.column(rows.num_columns - 2).to_pylist(), rows.column(rows.num_columns - 1).to_pylist()
            texts = []
            for i in range(rows.num_rows):
                byte = np.append(words.start[words.offsets[i] : words.offsets[i + 1]], offsets[i + 1])
                left, parts = offsets[i], []
                for first, last in zip(starts[i], ends[i], strict=True):
                    parts.append(data[left : byte[first]].tobytes())
                    left = byte[last]
                parts.append(data[left : offsets[i + 1]].tobytes())
                texts.append(b"".join(parts))
            columns = [*rows.columns]
            columns[at] = pa.array(texts, pa.binary()).cast(rows.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns[:-2], rows.schema.names[:-2])


def _digest():
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("digest")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted window places of a text as passages: places that touch or overlap are one."""
    for batch in batches:
        out: list[tuple] = []
        for digest, doc, places, owners in zip(*(batch.column(c) for c in ("digest", "doc", "place", "owner")), strict=True):
            place, owner = places.values.to_numpy(), owners.values.to_numpy()
            breaks = np.flatnonzero(np.concatenate([[True], place[1:] > place[:-1] + PASSAGE_WORDS]))
            lasts = np.append(breaks[1:], len(place)) - 1
            firsts = np.minimum.reduceat(owner, breaks)
            out += [
                (digest.as_py(), doc.as_py(), int(o), int(a), int(b) + PASSAGE_WORDS)
                for a, b, o in zip(place[breaks], place[lasts], firsts, strict=True)
            ]
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        types = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
            ["digest", "doc", "first_doc_id", "start_word", "end_word"],
        )


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row for each passage of a document that an earlier document holds word for word.

    Columns: doc_id, first_doc_id (the least document id that holds some 50 words of it), start_word, n_words,
    digest (md5 of the text). A passage has at least 50 words (runs without ASCII white space, compared
    exactly); windows of 50 words that overlap or touch are one passage. The document with the smallest id keeps
    its words, so it has no row of its own. Copies of a whole text are one class, compared once; each copy of at
    least 50 words is one passage. Null and short texts, and rows without doc_id, have no passage; repeated rows of
    one doc_id are one document. Nothing is capped: a passage that a third of all documents share is counted by
    partial aggregation and its rows come from a join that adaptive execution can split.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", "text", _digest())
    schema = "doc_id bigint, digest binary, n_words bigint, firsts array<int>, runs array<bigint>, steps array<array<int>>, leads array<array<bigint>>"
    sparse = written(docs.mapInArrow(_suffix_runs, schema).where(f"n_words >= {PASSAGE_WORDS}"), "suffixes")
    classes = written(
        sparse.groupBy("digest").agg(
            F.min("doc_id").alias("doc"), F.first(F.struct("n_words", "firsts", "runs", "steps", "leads")).alias("s")
        ),
        "classes",
    )
    runs = classes.select("doc", "digest", F.explode(F.arrays_zip("s.firsts", "s.runs", "s.steps", "s.leads")).alias("x"))
    runs = runs.select("doc", "digest", F.col("x.firsts").alias("first"), F.col("x.runs").alias("run"), F.col("x.steps").alias("steps"), F.col("x.leads").alias("leads"))
    kinds = runs.groupBy("run").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.first(F.struct("steps", "leads")).alias("s"))
    kinds = written(kinds, "suffix-runs")
    # a text that repeats itself has the same leads many times in a run
    leads = kinds.select("run", "low", "high", F.explode(F.array_distinct("s.leads")).alias("lead"))
    shared = written(
        leads.groupBy("lead").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("lead"),
        "shared-leads",
    )
    common = leads.select("run", "lead").join(shared, "lead").groupBy("run").agg(F.collect_list("lead").alias("common"))
    hit = F.expr("filter(arrays_zip(s.steps, s.leads), x -> array_contains(common, x.leads))")
    marked = kinds.select("run", "s").join(common, "run").select("run", F.transform(hit, lambda x: x["steps"]).alias("steps"))
    marked = written(marked, "shared-runs")
    found = runs.select("doc", "digest", "first", "run").join(marked, "run")
    found = found.groupBy("digest", "doc").agg(F.flatten(F.collect_list(F.expr("transform(steps, x -> first + x)"))).alias("places"))
    found = written(found, "extend")
    ids = written(found.select(F.col("doc").alias("doc_id")).distinct(), "extend-ids")
    texts = docs.join(small_broadcast(ids), "doc_id", "left_semi").withColumnRenamed("doc_id", "doc")
    around = written(
        texts.join(found, ["doc", "digest"]).select("doc", "digest", "text", "places").mapInArrow(
            _extensions, "doc bigint, digest binary, place int, print bigint"
        ),
        "windows",
    )
    owners = around.groupBy("print").agg(F.min("doc").alias("owner"), F.max("doc").alias("high")).where("owner < high")
    owners = written(owners.select("print", "owner"), "owners")
    later = around.join(owners, "print").where("owner < doc").select("digest", "doc", "place", "owner")
    lists = later.groupBy("digest", "doc").agg(F.sort_array(F.collect_set(F.struct("place", "owner"))).alias("x"))
    lists = lists.select("digest", "doc", F.col("x.place").alias("place"), F.col("x.owner").alias("owner"))
    inner = lists.mapInArrow(_runs, "digest binary, doc bigint, first_doc_id bigint, start_word int, end_word int")
    inner = inner.select(
        F.col("doc").alias("doc_id"), "first_doc_id", F.col("start_word").cast("bigint").alias("start_word"),
        (F.col("end_word") - F.col("start_word")).cast("bigint").alias("n_words"), "digest",
    )
    inner = written(inner, "inner")
    earlier = inner.groupBy("digest").agg(F.min("first_doc_id").alias("earlier"))
    named = classes.select("digest", "doc", "s.n_words").join(earlier, "digest", "left")
    named = written(named.select("digest", "doc", "n_words", F.least("doc", "earlier").alias("first_doc_id")), "named")
    copies = sparse.select("doc_id", "digest").distinct().join(named, "digest").where("doc_id <> doc")
    whole = copies.select("doc_id", "first_doc_id", F.lit(0).cast("bigint").alias("start_word"), "n_words", "digest")
    return inner.unionByName(whole)


def drop_repeated_passages(docs: DataFrame) -> DataFrame:
    """`docs` without the words of passages that an earlier document holds; all rows and columns stay.

    A cut goes from its first word to the word after it, and what remains is not altered. `n_chars`, where the
    table has it, is that of the new text. A text that consists of such passages becomes empty, or what
    precedes its first word.
    """
    passages = repeated_passages(docs)
    cuts = passages.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_list(F.struct("start_word", "n_words"))).alias("x"))
    of_id, of_digest, first, last = (free_name(docs, n) for n in ("of_doc", "of_digest", "cut_from", "cut_to"))
    cuts = written(
        cuts.select(
            F.col("doc_id").alias(of_id), F.col("digest").alias(of_digest), F.col("x.start_word").alias(first),
            F.expr("transform(x, y -> y.start_word + y.n_words)").alias(last),
        ),
        "cuts",
    )
    ids = written(cuts.select(of_id).distinct(), "cut-ids")
    known = docs["doc_id"] == ids[of_id]
    names = docs.columns
    hit = docs.join(small_broadcast(ids), known, "left_semi")
    rest = docs.join(small_broadcast(ids), known, "left_anti")
    matched = hit.join(cuts, (hit["doc_id"] == cuts[of_id]) & (_digest() == cuts[of_digest]), "left")
    none = F.expr("cast(array() as array<bigint>)")
    matched = matched.select(
        *[hit[c] for c in names], F.coalesce(cuts[first], none).alias(first), F.coalesce(cuts[last], none).alias(last)
    )
    done = matched.mapInArrow(_without, docs.schema)
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.length("text").cast(kind)).select(*names)
    return rest.unionByName(done)
