"""Near duplicates, repeated passages and decontamination against plain Python."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from textprep.llm import decontaminate, near_dedup, passages
from textprep.llm.batches import ALNUM_WORD, LOWER, SPACED_WORD, Words, windows
from textprep.llm.labelled import flat
from textprep.llm.tables import components

FOLD = {c: c + 32 for c in range(65, 91)}


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def shingles(text):
    words = spaced((text or "").translate(FOLD))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} - {()}


def plain_components(rows):
    sets, holders = {i: shingles(t) for i, t in rows}, defaultdict(list)
    for i, own in sets.items():
        for s in own:
            holders[s].append(i)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, own in sets.items():
        common = defaultdict(int)
        for s in own:
            for j in holders[s]:
                common[j] += j < i
        for j, n in common.items():
            if n and 100 * n >= 75 * (len(own) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abAZ09 \n\t\x0b.é漢-\x00", max_size=40), min_size=1, max_size=6))
def test_words(texts):
    """Words on bytes are those of the regular expressions, and equal words have equal fingerprints."""
    data, offsets = flat([t.encode() for t in texts])
    for table, fold, plain in ((SPACED_WORD, None, spaced), (ALNUM_WORD, LOWER, alnum)):
        words = Words(data, offsets, table, fold)
        body = words.data.tobytes()
        found = [body[a:b].decode() for a, b in zip(words.start, words.end, strict=True)]
        expected = [plain(t) for t in texts]
        assert found == [w for own in expected for w in own]
        assert words.counts.tolist() == [len(own) for own in expected]
        assert len(set(words.hash.tolist())) == len(set(found))


def test_windows():
    hashes = np.array([3, 1, 4, 1, 5, 3, 1, 4], np.uint64)
    three = windows(hashes, 3)
    assert len(three) == 6 and three[0] == three[5] and len(set(three.tolist())) == 5


def test_near_duplicates(documents):
    expected = plain_components([(r.doc_id, r.text) for r in documents.collect()])
    found = near_dedup.near_duplicates(documents).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in found) and len(found) == len(expected)
    kept = near_dedup.drop_near_duplicates(documents)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in found if r.kept)


def test_near_copies_of_one_text(spark):
    """A large group of near copies, exact copies among them, around the limit of similarity."""
    random = np.random.default_rng(1)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in random.integers(0, 60, random.integers(0, 3)):
            words[at] = f"x{random.integers(0, 50)}"
        rows.append((i + 10, " ".join(words)))
    rows += [(i, rows[0][1]) for i in range(200, 260)]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == plain_components(rows)


def hub_rows(variants=400, at=200, first_id=1000):
    """Variants that only a hub in the middle of the ids joins: it resembles each by 0.79, they each other by 0.63."""
    random, base = np.random.default_rng(5), [f"h{i}" for i in range(200)]
    rows = []
    for i in range(variants):
        words = list(base)
        for k in random.choice(np.arange(2, 194, 6), 5, replace=False) if i != at else ():
            words[k] = f"y{i}x{k}"
        rows.append((first_id + i, " ".join(words)))
    return rows


def test_hub_in_the_middle(spark):
    """The hub leads no table of the first round by its id, and few by its hash; all its links are found all the same."""
    rows = hub_rows()
    expected = plain_components(rows)
    assert {c for _, c in expected.values()} == {1000}
    sets = [shingles(t) for _, t in rows[:2]]
    assert 100 * len(sets[0] & sets[1]) < 75 * len(sets[0] | sets[1])
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected


def test_texts_of_one_id(spark):
    """Rows with one doc_id and two texts are two texts: each is linked with its own near copy only."""
    one, two = ([f"{mark}{i}" for i in range(60)] for mark in "pq")
    rows = [(5, " ".join(one)), (5, " ".join(two)), (3, " ".join([*one, "x"])), (7, " ".join([*two, "x"])), (8, " ".join([*two, "y"]))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4, "text")
    found = sorted(tuple(r) for r in near_dedup.near_duplicates(frame).collect())
    assert found == [(3, 57, 3, True), (5, 56, 3, False), (5, 56, 5, True), (7, 57, 5, False), (8, 57, 5, False)]
    left = sorted(tuple(r) for r in near_dedup.drop_near_duplicates(frame).collect())
    assert left == sorted([rows[2], rows[1]])


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    found = near_dedup.near_duplicates(odd_docs).collect()
    assert len(found) == odd_docs.count()
    of = {r.doc_id: r for r in found if r.doc_id is not None}
    assert of[6].component_id == 5 and not of[6].kept and of[5].n_shingles == 2
    assert all(of[i].n_shingles == 0 and of[i].component_id == i and of[i].kept for i in (2, 3, 4))
    assert of[8].n_shingles == 1 and all(r.kept and r.component_id is None for r in found if r.doc_id is None)
    kept = near_dedup.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, -1, 1, 2, 3, 4, 5, 7, 8]
    assert near_dedup.near_duplicates(no_docs).count() == 0 and near_dedup.drop_near_duplicates(no_docs).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50 + i) for i in range(1, 30)] + [(7, 7)]
    found = dict(components(spark.createDataFrame(edges, "a bigint, b bigint"), "chain").collect())
    assert found == {i: 1 for i in range(2, 41)} | {50 + i: 51 for i in range(2, 30)} | {100: 51}


def plain_passages(rows, size=passages.PASSAGE_WORDS):
    words, owner = {i: spaced(t) for i, t in rows}, {}
    for i, own in sorted(words.items()):
        for k in range(len(own) - size + 1):
            owner.setdefault(tuple(own[k : k + size]), i)
    found = set()
    for i, own in words.items():
        runs = []
        for k in range(len(own) - size + 1):
            first = owner[tuple(own[k : k + size])]
            if first < i:
                if runs and k <= runs[-1][1]:
                    runs[-1][1:] = [k + size, min(first, runs[-1][2])]
                else:
                    runs.append([k, k + size, first])
        found |= {(i, o, a, b - a) for a, b, o in runs}
    return found


def test_repeated_passages(more_documents):
    rows = [(r.doc_id, r.text) for r in more_documents.collect()]
    found = passages.repeated_passages(more_documents).drop("digest").collect()
    assert {tuple(r) for r in found} == plain_passages(rows) and len(found) == len({tuple(r) for r in found})
    cut = passages.drop_repeated_passages(more_documents)
    assert cut.columns == more_documents.columns
    after = {r.doc_id: r for r in cut.collect()}
    assert len(after) == len(rows) and all(r.n_chars == len(r.text) for r in after.values())
    gone = defaultdict(set)
    for i, _, a, n in plain_passages(rows):
        gone[i] |= set(range(a, a + n))
    for i, text in rows:
        assert spaced(after[i].text) == [w for k, w in enumerate(spaced(text)) if k not in gone[i]]


def test_passages_inside_texts(spark):
    """Passages of 49 to 120 words at the start, middle and end of texts, and one that many share."""
    random = np.random.default_rng(2)
    fresh = lambda n: " ".join(f"v{random.integers(1 << 40)}" for _ in range(n))
    shared = {n: fresh(n) for n in (49, 50, 51, 74, 120)}
    rows = []
    for i in range(60):
        own = shared[[49, 50, 51, 74, 120][i % 5]]
        rows.append((i, [f"{own} {fresh(30)}", f"{fresh(30)} {own}", f"{fresh(20)}\n{own}  {fresh(20)}"][i % 3]))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    expected = plain_passages(rows)
    assert {tuple(r) for r in passages.repeated_passages(frame).drop("digest").collect()} == expected
    assert {i for i, *_ in expected} == {i for i in range(5, 60) if i % 5}


def test_passages_of_odd_rows(odd_docs, no_docs):
    found = passages.repeated_passages(odd_docs).drop("digest").collect()
    assert [tuple(r) for r in found] == [(6, 5, 0, 80_000)]
    cut = passages.drop_repeated_passages(odd_docs)
    assert cut.columns == odd_docs.columns and cut.count() == odd_docs.count()
    texts = {r.doc_id: r.text for r in cut.where("doc_id IS NOT NULL").collect()}
    assert texts[6] == "" and len(texts[5]) == 400_000 and texts[2] is None
    assert passages.repeated_passages(no_docs).count() == 0 and passages.drop_repeated_passages(no_docs).count() == 0


def plain_contamination(rows, items):
    found = defaultdict(set)
    for i, text in items:
        words = alnum(text)
        size = min(13, len(words))
        for k in range(len(words) - size + 1 if words and i is not None else 0):
            found[tuple(words[k : k + size])].add(i)
    sizes, result = {len(w) for w in found}, []
    for i, text in rows:
        words, hit, ids = alnum(text), set(), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                if own := found.get(tuple(words[k : k + size])):
                    hit |= set(range(k, k + size))
                    ids |= own
        digest = hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
        result.append((i, len(words), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(result, key=str)


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def test_contamination(spark, more_documents):
    benchmark = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    rows, items = [tuple(r) for r in more_documents.select("doc_id", "text").collect()], [tuple(r) for r in benchmark.collect()]
    found = decontaminate.contamination(spark, more_documents, benchmark)
    assert sorted((tuple(r) for r in found.select(*COLUMNS).collect()), key=str) == plain_contamination(rows, items)
    left = decontaminate.drop_contaminated(spark, more_documents, benchmark)
    assert left.columns == more_documents.columns
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in found.where("NOT contaminated").collect()}


ITEMS = [
    (1, "alpha beta gamma"), (2, "alpha beta gamma delta"), (3, "x"), (4, " ".join(f"n{i}" for i in range(20))), (5, None), (6, ""),
    (None, "words of no item"), (7, "Alpha, BETA; gamma!"), (4, " ".join(f"n{i}" for i in range(20))), (8, "lang wort " * 8), (10, "é漢"),
]


@pytest.mark.parametrize("block", [1 << 25, 60])
def test_short_items_and_blocks(spark, odd_docs, no_docs, monkeypatch, block):
    """Items of few words, repeated and nameless ones; one block of the benchmark, and several."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rows = [
        (1, "the ALPHA beta-gamma delta"), (2, "n0 " + " ".join(f"n{i}" for i in range(2, 18)) + " x x"), (3, "alpha beta"), (4, None),
        (5, " ".join(f"n{i}" for i in range(3, 20)) + " filler" * 400), (6, "x"), (7, "words of no item"), (8, "n1 n2 x n3"), (9, "é漢 é 漢"),
    ]
    schema = "item_id bigint, text string"
    benchmark = spark.createDataFrame(ITEMS, schema)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = decontaminate.contamination(spark, docs, benchmark).select(*COLUMNS).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain_contamination(rows, ITEMS)
    odd = decontaminate.contamination(spark, odd_docs, benchmark).select(*COLUMNS).collect()
    plain = plain_contamination([(r.doc_id, r.text) for r in odd_docs.collect()], ITEMS)
    assert sorted((tuple(r) for r in odd), key=str) == plain
    left = decontaminate.drop_contaminated(spark, odd_docs, benchmark)
    assert left.columns == odd_docs.columns and left.count() == sum(not r[-1] for r in plain)
    assert decontaminate.contamination(spark, no_docs, benchmark).count() == 0
    none = decontaminate.contamination(spark, odd_docs, benchmark.where("false"))
    assert none.where("contaminated OR n_items > 0").count() == 0 and none.count() == odd_docs.count()


def test_longest_match(spark):
    words = [f"n{i}" for i in range(40)]
    benchmark = spark.createDataFrame([(9, " ".join(words))], "item_id bigint, text string")
    text = "a b " + " ".join(words[5:30]) + " c " + " ".join(words[20:36])
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    row = decontaminate.contamination(spark, docs, benchmark).first()
    assert row.longest == 25 and {tuple(f) for f in row.found} == {(9, 5, 2, 25), (9, 20, 28, 16)}


def test_maps_and_minima_let_links_pass(spark):
    """Pairs at and above the limit, short and long, are alike by their rows; far ones are not."""
    random, pairs = np.random.default_rng(9), []
    for n in (4, 20, 130, 900, 5_000):
        for changed in (0, n // 20, n // 8, n // 2):
            one = random.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1)
            two = np.concatenate([one[changed:], random.integers(0, 2**63, changed).astype(np.uint64)])
            one, two = np.unique(one), np.unique(two)
            both = len(np.intersect1d(one, two))
            _, rows = near_dedup._half_keys([one, two])
            pairs.append((len(one), len(two), *(r.view(np.int64).tolist() for r in rows), 100 * both >= 75 * (len(one) + len(two) - both), changed * 2 < n))
    frame = spark.createDataFrame(pairs, "n int, m int, x array<bigint>, y array<bigint>, linked boolean, near boolean")
    alike = frame.select("linked", "near", near_dedup._alike("n", "m", "x", "y").alias("alike")).collect()
    assert sum(r.linked for r in alike) >= 12
    assert all(r.alike for r in alike if r.linked) and not any(r.alike for r in alike if not r.near)


def test_pairs_do_not_grow_with_the_square(spark, monkeypatch):
    """A hub's variants: few pairs are verified for each text, whatever their number."""
    verified, counted = near_dedup._verified, []

    def counting(pairs, sets):
        counted.append(pairs.count())
        return verified(pairs, sets)

    monkeypatch.setattr(near_dedup, "_verified", counting)
    for variants in (200, 400, 800):
        counted.clear()
        rows = hub_rows(variants, at=variants // 2)
        found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
        assert {r.component_id for r in found} == {1000}
        assert sum(counted) <= 10 * variants, counted  # of all pairs: 19,900, 79,800 and 319,600


def test_near_copies_share_runs_of_suffixes(spark, monkeypatch):
    """Of 60 near copies the suffixes are joined once for each different run, and the passages are those of a plain search."""
    words = [f"w{i * 7919 % 1009}" for i in range(600)]
    rows = [(i, " ".join([*words[: 9 * i], f"other{i}", *words[9 * i + 1 :]])) for i in range(60)]
    made = {}
    real = passages.written
    monkeypatch.setattr(passages, "written", lambda df, name: made.setdefault(name, real(df, name)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {tuple(r) for r in passages.repeated_passages(frame).drop("digest").collect()}
    assert found == set(plain_passages(rows))
    occurrences = made["classes"].selectExpr("sum(size(flatten(s.leads))) AS n").first().n
    joined = made["suffix-runs"].selectExpr("sum(size(s.leads)) AS n").first().n
    assert joined < 0.5 * occurrences
