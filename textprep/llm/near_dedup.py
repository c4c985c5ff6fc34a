"""Near-duplicate documents by MinHash with tensored banding, every link verified on full shingle sets.

A document has two small collections of half-keys, U_1..U_a and V_1..V_a, each made of `k` minima. Table (i, j)
has the key (U_i, V_j): a * a tables of 2k minima each come from 2 * a * k minhashes instead of 2 * a * a * k. Two
sets of similarity s meet in some table with probability (1 - (1 - s^k)^a)^2, which is 0.99999 for s = 0.75, k = 4
and a = 32. Two documents share a table if they share a half-key of either collection, so tables are not written
out: documents meet by a left half-key, and a pair is verified only if it has a right one in common.

Families of copies are joined first, through few pairs: every document is compared with those leaders of its left
half-keys that it resembles most. Then every pair that still lies in two components is settled. Two things beside the
half-keys tell from a pair's rows alone that it need not be verified. A map of 1,024 bits has one set for each shingle:
bits that one document has and the other has not stand for shingles it does not share, so some pairs cannot be
linked; this loses none, and in families of texts of some hundred words it leaves few unlinked pairs. Four bits of each of
the 256 minima tell how many minima agree; pairs with fewer than 162 matches are left out. At a similarity of 0.75
that loses a pair with a probability of 7e-7, less than the tables do; of pairs at 0.5 it lets one in a thousand through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textprep.llm.annotate import annotated, free_name
from textprep.llm.batches import LOWER, SPACED_WORD, Words, in_pieces, mixed, signed, stream, windows
from textprep.llm.tables import MAX_BROADCAST_ROWS, components, discard, small_broadcast, written

SHINGLE_WORDS = 5
HALF_KEYS = 32  # a
MINIMA = 4  # k
NUMERATOR, DENOMINATOR = 75, 100
CLASS = ("n_shingles", "set_1", "set_2")  # the key of equal sets
NEAREST = 3  # leaders that a document is compared with, before all remaining pairs are settled
PLANES = 4  # bits kept of each minimum
LEAST_MATCHES = 162  # of the 2 * a * k minima, for a pair to be verified
MAP_BITS = 1024  # of the map of a set's shingles

_SEEDS = 2 * HALF_KEYS * MINIMA
_HIGH = np.uint64(32)
_MULTIPLIERS = (stream(11, _SEEDS) >> _HIGH).astype(np.uint32) | np.uint32(1)
_SHIFTS = (stream(12, _SEEDS) >> _HIGH).astype(np.uint32)
_KEY_WEIGHTS = stream(13, MINIMA) | np.uint64(1)
_TABLE_MARKS = stream(14, 2 * HALF_KEYS)
_WORDS = _SEEDS // 64  # of a plane
_MAP_WORDS = MAP_BITS // 64
_SCATTER = np.uint32(0x9E3779B1)


def _sets(words: Words) -> list[np.ndarray]:
    """Sorted distinct shingle fingerprints of each text."""
    shingles, found = windows(words.hash, SHINGLE_WORDS), []
    for first, last in zip(words.offsets[:-1], words.offsets[1:], strict=True):
        if last - first >= SHINGLE_WORDS:
            found.append(np.unique(shingles[first : last - SHINGLE_WORDS + 1]))
        else:  # the whole sequence as one; its length is part of the fingerprint
            found.append(windows(words.hash[first:last], last - first) if last > first else words.hash[:0])
    return found


def _half_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A row of 2a half-keys for each set, and the bit planes of its minima with its map; no set is empty."""
    values = (np.concatenate(sets) >> _HIGH).astype(np.uint32)
    sizes = np.array([len(s) for s in sets])
    firsts = np.cumsum(sizes) - sizes
    keys = np.zeros((len(sets), 2 * HALF_KEYS), np.uint64)
    low = np.zeros((len(sets), _SEEDS), np.uint8)
    for n in range(_SEEDS):
        minima = np.minimum.reduceat(values * _MULTIPLIERS[n] + _SHIFTS[n], firsts)
        low[:, n] = (minima * _SCATTER) >> np.uint32(32 - PLANES)
        keys[:, n // MINIMA] += minima.astype(np.uint64) * _KEY_WEIGHTS[n % MINIMA]
    planes = [np.packbits((low >> p) & 1, axis=1).view(np.uint64) for p in range(PLANES)]
    held = np.zeros((len(sets), MAP_BITS), bool)
    held[np.repeat(np.arange(len(sets)), sizes), (np.concatenate(sets) >> np.uint64(7)) % np.uint64(MAP_BITS)] = True
    return mixed(keys ^ _TABLE_MARKS), np.hstack([*planes, np.packbits(held, axis=1).view(np.uint64)])


def _class_keys(sets: list[np.ndarray]) -> list[pa.Array]:
    """n_shingles, set_1 and set_2, which equal sets share."""
    whole, full = np.zeros((2, len(sets)), np.uint64), np.array([len(s) > 0 for s in sets], bool)
    if filled := [s for s in sets if len(s)]:
        sizes = np.array([len(s) for s in filled])
        firsts, joined = np.cumsum(sizes) - sizes, np.concatenate(filled)
        whole[0, full] = mixed(np.add.reduceat(joined, firsts))
        whole[1, full] = np.add.reduceat(mixed(joined ^ np.uint64(0x5851F42D4C957F2D)), firsts)
    return [pa.array([len(s) for s in sets], pa.int64()), pa.array(signed(whole[0])), pa.array(signed(whole[1]))]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in in_pieces(batch, "text"):
            sets = _sets(Words(data, offsets, SPACED_WORD, LOWER))
            full = np.array([len(s) > 0 for s in sets])
            filled = [s for s in sets if len(s)]
            empty = [np.zeros((0, n), np.uint64) for n in (2 * HALF_KEYS, PLANES * _WORDS + _MAP_WORDS)]
            lists = []
            for table in _half_keys(filled) if filled else empty:
                ends = np.cumsum(np.concatenate([[0], full * table.shape[1]])).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(ends, pa.array(signed(table.ravel()))))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), *_class_keys(sets), *lists], ["doc_id", *CLASS, "halves", "sketch"]
            )


def _class_of(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> list:
    return _class_keys(_sets(Words(data, offsets, SPACED_WORD, LOWER)))


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in in_pieces(batch, "text"):
            sets = _sets(Words(data, offsets, SPACED_WORD, LOWER))
            columns = [*_class_keys(sets), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*CLASS, "shingles"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that meet in a table and whose full sets are alike enough."""
    for batch in batches:
        linked = []
        columns = (batch.column(c) for c in ("left_set", "right_set", "left_vs", "right_vs"))
        for left, right, left_vs, right_vs in zip(*columns, strict=True):
            x, y = (np.frombuffer(side.as_buffer(), np.uint64) for side in (left, right))
            both = 0
            meet = len(np.intersect1d(left_vs.values.to_numpy(), right_vs.values.to_numpy(), assume_unique=True))
            if meet and DENOMINATOR * min(len(x), len(y)) >= NUMERATOR * max(len(x), len(y)):
                both = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(both > 0 and DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both))
        chosen = pa.array(linked, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(chosen) for c in ("a", "b")], ["a", "b"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The linked ones of the pairs (a, b)."""
    left, right = (
        sets.select(F.col("doc").alias(end), F.col("shingles").alias(f"{side}_set"), F.col("vs").alias(f"{side}_vs"))
        for end, side in (("a", "left"), ("b", "right"))
    )
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "left_set", "right_set", "left_vs", "right_vs")
    return written(joined.mapInArrow(_confirmed, "a bigint, b bigint"), "links")


def _members(classes: DataFrame) -> DataFrame:
    """(doc, n_shingles, sketch, us, vs, central) of documents that share half-keys of both collections with others.

    `us` and `vs` are the shared half-keys; `central` counts the holders of the left ones.
    """

    def shared(first: int, source: DataFrame) -> DataFrame:
        keys = source.select(F.explode(F.array_distinct(F.slice("halves", first, HALF_KEYS))).alias("key"), "doc")
        held = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-keys")
        return keys.join(held, "key").groupBy("doc").agg(F.collect_list("key").alias("keys"), F.sum("n").alias("n"))  # at most a

    slim = classes.select("doc", "halves")
    left = written(shared(1, slim), "left-keys").withColumnsRenamed({"keys": "us", "n": "central"})
    right = shared(HALF_KEYS + 1, slim.join(left.select("doc"), "doc", "left_semi")).withColumnRenamed("keys", "vs").drop("n")
    both = left.join(right, "doc").join(classes.select("doc", "n_shingles", "sketch"), "doc")
    members = written(both.select("doc", "n_shingles", "sketch", "us", "vs", "central"), "members")
    discard(left)
    return members


def _full_sets(members: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, shingles, vs): the sets of all members, read once for all pairs."""
    named = written(members.select("doc").join(classes.select("doc", "doc_id", *CLASS), "doc"), "member-classes")
    needed = docs.join(small_broadcast(named.select("doc_id").distinct()), "doc_id", "left_semi")
    sets = needed.mapInArrow(_set_rows, "n_shingles bigint, set_1 bigint, set_2 bigint, shingles binary")
    # a row that repeats a doc_id has a text, and so perhaps a class, of its own
    sets = sets.join(small_broadcast(named.drop("doc_id"), MAX_BROADCAST_ROWS // 2), [*CLASS]).select("doc", "shingles")
    found = written(sets.dropDuplicates(["doc"]).join(members.select("doc", "vs"), "doc"), "sets")
    discard(named)
    return found


def _mismatches(one: str, other: str):
    """How many minima of two sketches differ: in each word, the bits that differ in some plane."""
    total = F.lit(0)
    for word in range(_WORDS):
        differ = F.lit(0).cast("bigint")
        for plane in range(PLANES):
            n = plane * _WORDS + word
            differ = differ.bitwiseOR(F.get(one, F.lit(n)).bitwiseXOR(F.get(other, F.lit(n))))
        total = total + F.bit_count(differ)
    return total


def _lacking(one: str, other: str):
    """A number of shingles, at least, that `one` has and `other` has not."""
    total = F.lit(0)
    for n in range(PLANES * _WORDS, PLANES * _WORDS + _MAP_WORDS):
        total = total + F.bit_count(F.get(one, F.lit(n)).bitwiseAND(F.bitwise_not(F.get(other, F.lit(n)))))
    return total


def _alike(size: str, other_size: str, sketch: str, other_sketch: str):
    """Sizes and maps that allow a link, and minima that make one likely enough."""
    fits = DENOMINATOR * F.least(size, other_size) >= NUMERATOR * F.greatest(size, other_size)
    # of n and m shingles NUMERATOR / (NUMERATOR + DENOMINATOR) * (n + m) must be shared
    needed = NUMERATOR * (F.col(size) + F.col(other_size))
    for n, one, another in ((size, sketch, other_sketch), (other_size, other_sketch, sketch)):
        fits = fits & ((NUMERATOR + DENOMINATOR) * (F.col(n) - _lacking(one, another)) >= needed)
    return fits & (_mismatches(sketch, other_sketch) <= _SEEDS - LEAST_MATCHES)


def _pair(left: str, right: str) -> list:
    return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b")]


def _led(rows: DataFrame) -> DataFrame:
    """At most NEAREST pairs for each document: with the leaders of its half-keys that are most alike.

    The leader of a half-key is its most central holder: of a family made from one text, most likely that text.
    """
    leader = F.max_by(F.struct("doc", "n_shingles", "sketch"), F.struct("central", "doc")).alias("leader")
    led = rows.join(rows.groupBy("key").agg(leader), "key").where("doc <> leader.doc")
    led = led.where(_alike("n_shingles", "leader.n_shingles", "sketch", "leader.sketch"))
    nearest = F.struct(_mismatches("sketch", "leader.sketch").alias("n"), F.col("leader.doc").alias("leader"))
    led = led.select("doc", nearest.alias("near")).groupBy("doc").agg(F.sort_array(F.collect_set("near")).alias("near"))
    led = led.select("doc", F.explode(F.slice("near", 1, NEAREST)).alias("near"))  # of one leader per half-key
    return led.select(*_pair("near.leader", "doc")).distinct()


def _unsettled(rows: DataFrame) -> DataFrame:
    """Every pair of alike documents that share a left half-key and lie in two components.

    Of each half-key the documents outside of its largest component meet all others, so a family that is one
    component but for a few costs a few times its size.
    """
    parts = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("n"))
    mixed_keys = written(parts.where("n > 1").select("key", "main"), "mixed-keys")
    rest = written(rows.drop("central").join(mixed_keys, "key").withColumn("apart", F.col("component") != F.col("main")), "rest")
    fore = rest.where("apart").select(
        "key", F.col("doc").alias("other"), F.col("n_shingles").alias("other_size"), F.col("sketch").alias("other_sketch"),
        F.col("component").alias("of_other"),
    )
    once = ~F.col("apart") | (F.col("doc") < F.col("other"))
    pairs = rest.join(fore, "key").where(
        (F.col("component") != F.col("of_other")) & once & _alike("n_shingles", "other_size", "sketch", "other_sketch")
    )
    found = written(pairs.select(*_pair("doc", "other")).distinct(), "unsettled")
    discard(rest, mixed_keys)
    return found


def _linked(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, component) of all classes (doc) that similar pairs of the tables join."""
    members = _members(classes)
    sets = _full_sets(members, classes, docs)
    def rows(labelled: DataFrame) -> DataFrame:
        return labelled.select(F.explode("us").alias("key"), "doc", "n_shingles", "sketch", "component", "central")

    led = written(_led(rows(members.withColumn("component", F.col("doc")))), "led")
    found = components(_verified(led, sets), "components")
    labelled = members.join(found, F.col("doc") == F.col("node"), "left").withColumn("component", F.coalesce("component", "doc"))
    rest = _unsettled(rows(labelled))
    links = _verified(rest.join(led, ["a", "b"], "left_anti"), sets)
    if not links.isEmpty():
        found = components(links.union(found.select(F.col("node").alias("a"), F.col("component").alias("b"))), "components")
    discard(sets, members)
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    `docs` has doc_id and text; other columns are not read. A set holds the distinct shingles of five
    lower-cased words; a text of fewer words is one shingle, and a null, empty or blank text has none and is linked
    with nothing. Documents with 100 * intersection >= 75 * union are linked; component_id is the smallest doc_id
    that links reach. Equal sets are one class, whose smallest id stands for it in all further steps, so a third of
    the rows may be copies. Rows that repeat a doc_id are judged each by its own text: the class, not the id, is
    what tables, verification and links name. A row without doc_id has its
    set size, no component, and is kept. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    linked = _judged(docs)
    return linked.select("doc_id", "n_shingles", "component_id", "kept")


def _judged(docs: DataFrame) -> DataFrame:
    """near_duplicates of `docs` (doc_id, text) with the class key of every row."""
    schema = "doc_id bigint, n_shingles bigint, set_1 bigint, set_2 bigint, halves array<bigint>, sketch array<bigint>"
    signatures = written(docs.mapInArrow(_signatures, schema), "signatures")
    named = signatures.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = named.groupBy(*CLASS).agg(F.min("doc_id").alias("doc_id"), F.first(F.struct("halves", "sketch")).alias("s"))
    # a number of its own for each class: two classes may have the same smallest doc_id
    classes = classes.select(F.monotonically_increasing_id().alias("doc"), "doc_id", *CLASS, "s.halves", "s.sketch")
    classes = written(classes, "classes")
    rows = written(signatures.select("doc_id", *CLASS), "rows")
    discard(signatures)
    parts = _linked(classes, docs)
    sized = classes.select("doc", "doc_id", *CLASS)
    found = sized.join(parts, F.col("doc") == F.col("node"), "left").withColumn("part", F.coalesce("component", "doc"))
    found = written(found.select("part", "doc_id", *CLASS), "parts")
    discard(classes)
    least = found.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    found = written(found.join(least, "part").select(*CLASS, "component_id"), "found")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    linked = rows.join(found, [*CLASS], "left").withColumn("component_id", own)
    return linked.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each component left, all its columns kept; rows without doc_id stay.

    Of rows that repeat a doc_id one stays, of those whose text is kept; none stays if no text of them is kept.
    """
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    verdicts = written(_judged(plain), "verdicts")
    own = free_name(docs, "of_doc")
    of_id = verdicts.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("any"))
    of_id = written(of_id.where("n > 1 OR NOT any").select(F.col("doc_id").alias(own), "n", "any"), "of-id")
    gone = written(of_id.where("NOT any").select(own), "gone")
    rest = docs.join(small_broadcast(gone), docs["doc_id"] == gone[own], "left_anti")
    repeated = written(of_id.where("n > 1 AND any").select(own), "repeated")
    if repeated.isEmpty():
        return rest
    same = rest["doc_id"] == repeated[own]
    key = free_name(docs, "class")
    keyed = annotated(rest.join(repeated, same, "left_semi"), key, "n_shingles bigint, set_1 bigint, set_2 bigint", _class_of)
    kept = verdicts.where("kept").join(repeated, F.col("doc_id") == F.col(own), "left_semi")
    kept = written(kept.select(F.col("doc_id").alias(own), F.struct(*CLASS).alias("of_class")).distinct(), "kept-texts")
    match = (keyed["doc_id"] == kept[own]) & (keyed[key] == kept["of_class"])
    once = keyed.join(kept, match, "left_semi").dropDuplicates(["doc_id"]).drop(key)
    return rest.join(repeated, same, "left_anti").unionByName(once)
