"""Toxicity: a convolutional text classifier over hashed word embeddings, trained on all labelled texts.

A word's vector is the sum of the embeddings of its hash and of the hashes of its first four and five bytes, so that unseen
forms of a known stem are recognised. Filters over one, two and three neighbouring words are maximised over the
text, and a logistic unit weighs them. Probabilities are shifted so that each language's best threshold is 0.3;
the language of a text is guessed from its own function words.

Labelled texts fall into shards of bounded size by the hash of doc_id. In a round, each shard of a part of the table
trains its own copy of the network by Adagrad, and a number's new value is the mean over the shards that moved it. Log odds of
words and thresholds come from counts that Spark sums over all labelled texts. Sums are of whole numbers, so the
partitioning does not matter. Only numbers whose count the network fixes reach the driver.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from textprep.llm.annotate import annotated, free_name
from textprep.llm.batches import ALNUM_WORD, LOWER, Words, fingerprints, in_pieces, pieces, spans, text_bytes
from textprep.llm.labelled import flat, held_out, labelled_texts
from textprep.llm.tables import discard

PREFIXES = (4, 5)
BUCKET_BITS = 15
DIMENSIONS = 12
WIDTHS = (1, 2, 3)
FILTERS = 16  # of each width
VISITS = 9000  # of texts in training at least; two to eight passes over all of them
BATCH = 32
SMOOTHING = 3.0
RATE = 0.05
THRESHOLD = 0.3
SHARD_ROWS, SHARD_BYTES = 2048, 4 << 20  # about what a task trains on between two averages
PARTS = 4  # rounds of a pass, each over its part of the texts
MIN_PER_LANGUAGE = 20
CALIBRATION_PART = 4
BINS = 100  # of logits, to the unit, by which texts are counted for thresholds
FIXED = 2.0**30  # fractions are summed as whole numbers of this part
PIECE_BYTES = 1 << 19

# Function words by which a text's language is guessed.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it as was with be by on are this from",
    "fr": "le la les de des et est un une du en que qui dans pour sur pas avec",
    "de": "der die das und ist in den von zu mit dem ein eine nicht auf für im als",
    "es": "el la los de y que en un una por con para se del las no su es",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]


def _hashes(texts: str) -> np.ndarray:
    return np.unique(Words(*flat([texts.encode()]), ALNUM_WORD, LOWER).hash)


_LISTS = [_hashes(words) for words in FUNCTION_WORDS.values()]


def guessed_language(words: Words) -> np.ndarray:
    """The place in LANGUAGES whose function words are most frequent in each text; the first of equals."""
    owner = np.repeat(np.arange(len(words.counts)), words.counts)
    hits = np.stack([np.bincount(owner[np.isin(words.hash, known)], minlength=len(words.counts)) for known in _LISTS])
    return np.where(hits.max(0) > 0, hits.argmax(0), len(LANGUAGES) - 1)


def features(words: Words) -> np.ndarray:
    """(words x 3) rows of the embedding table: the word, and its first bytes."""
    mask = np.uint64((1 << BUCKET_BITS) - 1)
    rows = [words.hash & mask]
    for n, size in enumerate(PREFIXES, 1):
        length = np.minimum(words.length, size)
        begin = fingerprints(words.data[spans(words.start, length)], length)
        rows.append((begin & mask) + np.uint64(n << BUCKET_BITS))
    return np.stack(rows, 1).astype(np.int32)


@dataclass
class Network:
    embeddings: np.ndarray
    kernels: list[np.ndarray]  # width x dimensions x filters
    biases: list[np.ndarray]
    out: np.ndarray
    shift: float
    thresholds: np.ndarray = field(default_factory=lambda: np.full(len(LANGUAGES), 0.5))

    def pooled(self, rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(maxima of all filters, where they are, padded places, vectors); a text is followed by two empty words."""
        pad = max(WIDTHS) - 1
        firsts = np.cumsum(counts + pad) - (counts + pad)
        at = spans(firsts, counts)
        vectors = np.zeros((int((counts + pad).sum()) + pad, DIMENSIONS), np.float32)
        vectors[at] = self.embeddings[rows].sum(1)
        body = np.zeros(len(vectors) - pad, bool)
        body[at] = True
        maxima = []
        for kernel, bias in zip(self.kernels, self.biases, strict=True):
            n = len(body)
            total = vectors[:n] @ kernel[0] + bias
            for k in range(1, len(kernel)):
                total += vectors[k : k + n] @ kernel[k]
            total[~body] = 0.0
            maxima.append((np.maximum.reduceat(total, firsts, axis=0) if len(counts) else total[:0], total))
        tops = np.concatenate([m for m, _ in maxima], 1)
        return np.maximum(tops, 0), firsts, vectors, [t for _, t in maxima]

    def logits(self, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.pooled(rows, counts)[0] @ self.out + self.shift

    def scores(self, words: Words) -> np.ndarray:
        raw = self.logits(features(words), words.counts)
        limit = self.thresholds[guessed_language(words)]
        return _sigmoid(raw - _logit(limit) + _logit(THRESHOLD))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logit(p):
    return np.log(p) - np.log1p(-p)


@dataclass
class _Texts:
    """Features of texts: rows of the embedding table word by word, and what belongs to each text."""

    rows: np.ndarray
    counts: np.ndarray
    languages: np.ndarray
    labels: np.ndarray

    @staticmethod
    def of(data: np.ndarray, offsets: np.ndarray, labels: np.ndarray) -> _Texts:
        found = []
        for a, b in pieces(offsets, PIECE_BYTES):
            own = offsets[a : b + 1]
            words = Words(data[own[0] : own[-1]], own - own[0], ALNUM_WORD, LOWER)
            found.append((features(words), words.counts, guessed_language(words)))
        return _Texts(*(np.concatenate(p) for p in zip(*found, strict=True)), labels)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def _holders(texts: _Texts) -> np.ndarray:
    """(2 x embedding rows): how many texts of each class hold the row."""
    size = (1 + len(PREFIXES)) << BUCKET_BITS
    place = np.repeat(texts.owner, texts.rows.shape[1]) * np.int64(size) + texts.rows.ravel()
    owner, row = np.divmod(np.unique(place), size)
    kind = texts.labels[owner]
    return np.stack([np.bincount(row[kind == c], minlength=size) for c in (0, 1)])


def _log_odds(holders: np.ndarray, share: float) -> np.ndarray:
    """By embedding row: log odds of class 1 among the texts that hold it, less those of all texts.

    SMOOTHING texts of the average kind are added, so that a word of a single text says little.
    """
    return np.log((holders[1] + SMOOTHING * share) / (holders[0] + SMOOTHING * (1 - share))) - _logit(share)


@dataclass
class _Fit:
    """A network in training: Adagrad's sums of squares, and the weight of each class."""

    net: Network
    squares: list[np.ndarray]
    shift_square: float
    weight: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.net.embeddings, *self.net.kernels, *self.net.biases, self.net.out]

    def table(self) -> np.ndarray:
        """All numbers but the embeddings and theirs: one row for parameters, one for squares."""
        rest, squares = self.arrays()[1:], self.squares[1:]
        return np.stack([np.concatenate([*(x.ravel() for x in part), [last]]) for part, last in ((rest, self.net.shift), (squares, self.shift_square))])

    def set_table(self, table: np.ndarray) -> None:
        for row, part in zip(table, (self.arrays()[1:], self.squares[1:]), strict=True):
            ends = np.cumsum([x.size for x in part])
            for x, values in zip(part, np.split(row[: ends[-1]], ends[:-1]), strict=True):
                x[...] = values.reshape(x.shape)
        self.net.shift, self.shift_square = float(table[0, -1]), float(table[1, -1])

    def copy(self) -> _Fit:
        net = self.net
        copied = Network(net.embeddings.copy(), [k.copy() for k in net.kernels], [v.copy() for v in net.biases], net.out.copy(), net.shift)
        return _Fit(copied, [q.copy() for q in self.squares], self.shift_square, self.weight)


def _network(seed: int) -> Network:
    random = np.random.default_rng(seed)
    return Network(
        random.normal(0, 0.1, ((1 + len(PREFIXES)) << BUCKET_BITS, DIMENSIONS)).astype(np.float32),
        [random.normal(0, 0.3, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        random.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32),
        0.0,
    )


def _constant(net: Network, always: bool) -> Network:
    """Without labels of both classes."""
    net.out[:] = 0
    net.shift = float(_logit(0.9 if always else 0.1))
    return net


def _started(net: Network, holders: np.ndarray, totals: np.ndarray) -> _Fit:
    """The first dimension of the embeddings starts at the log odds of the word, and half of the filters look at it."""
    for kernel in net.kernels:
        kernel[:, 0, : FILTERS // 2] += 0.5
    net.out += 0.1
    net.embeddings[:, 0] = np.clip(_log_odds(holders, totals[1] / totals.sum()), -2, 4) / 3
    fit = _Fit(net, [], 1e-3, totals.sum() / (2 * np.maximum(totals, 1)))
    fit.squares = [np.full_like(p, 1e-3) for p in fit.arrays()]
    return fit


def _passes(n: int) -> int:
    return min(8, max(2, VISITS // n))


def _descend(fit: _Fit, texts: _Texts, learned: np.ndarray, passes: int, random: np.random.Generator) -> None:
    """Passes of Adagrad over the texts whose places are `learned`."""
    net, squares, weight, labels, counts, rows = fit.net, fit.squares, fit.weight, texts.labels, texts.counts, texts.rows
    offsets = np.concatenate([[0], np.cumsum(counts)])
    for _ in range(passes):
        order = random.permutation(learned)
        for b in range(0, len(order), BATCH):
            batch = np.sort(order[b : b + BATCH])
            own = spans(offsets[batch], counts[batch])
            x = rows[own]
            tops, firsts, vectors, totals = net.pooled(x, counts[batch])
            error = (_sigmoid(tops @ net.out + net.shift) - labels[batch]) * weight[labels[batch]] / len(batch)
            gradient_top = np.where(tops > 0, error[:, None] * net.out[None, :], 0).astype(np.float32)
            gradients = [None, *[np.zeros_like(k) for k in net.kernels], *[np.zeros_like(v) for v in net.biases], tops.T @ error]
            into = np.zeros_like(vectors)
            ends = firsts + counts[batch]
            for w, (kernel, total) in enumerate(zip(net.kernels, totals, strict=True)):
                part = gradient_top[:, w * FILTERS : (w + 1) * FILTERS]
                gradients[1 + len(WIDTHS) + w] = part.sum(0)
                for d in np.flatnonzero(counts[batch]):
                    place = total[firsts[d] : ends[d]].argmax(0) + firsts[d]
                    for k in range(len(kernel)):
                        gradients[1 + w][k] += vectors[place + k].T * part[d]
                        np.add.at(into, place + k, part[d][:, None] * kernel[k].T)
            at = spans(firsts, counts[batch])
            moved = np.flatnonzero(np.abs(into[at]).sum(1))
            targets, values = x[moved], into[at[moved]]
            for column in range(targets.shape[1]):
                np.add.at(squares[0], targets[:, column], values**2)
                np.add.at(net.embeddings, targets[:, column], -RATE * values / np.sqrt(squares[0][targets[:, column]]))
            for n, (parameter, gradient) in enumerate(zip((*net.kernels, *net.biases, net.out), gradients[1:], strict=True), 1):
                squares[n] += gradient**2
                parameter -= (RATE * gradient / np.sqrt(squares[n])).astype(np.float32)
            total_error = float(error.sum())
            fit.shift_square += total_error**2
            net.shift -= RATE * total_error / np.sqrt(fit.shift_square)


def _logits(net: Network, texts: _Texts) -> np.ndarray:
    offsets, n = np.concatenate([[0], np.cumsum(texts.counts)]), len(texts.counts)
    blocks = [net.logits(texts.rows[offsets[i] : offsets[min(i + 256, n)]], texts.counts[i : i + 256]) for i in range(0, n, 256)]
    return np.concatenate(blocks)


def train(texts: list[bytes], labels: np.ndarray, seed: int = 5) -> Network:
    """A network fitted to texts in this process: what `fit` does with a single shard."""
    net = _network(seed)
    if not len(labels) or labels.min() == labels.max():
        return _constant(net, bool(len(labels) and labels[0]))
    read = _Texts.of(*flat(texts), labels)
    # one text in CALIBRATION_PART is left out of training, to set thresholds by
    kept_out = np.arange(len(labels)) % CALIBRATION_PART == CALIBRATION_PART - 1
    if min(labels[kept_out].sum(), (1 - labels[kept_out]).sum()) < MIN_PER_LANGUAGE:
        kept_out[:] = False
    used = ~kept_out
    words = used[read.owner]
    held = _holders(_Texts(read.rows[words], np.where(used, read.counts, 0), read.languages, labels))
    state = _started(net, held, np.bincount(labels[used], minlength=2))
    _descend(state, read, np.flatnonzero(used), _passes(int(used.sum())), np.random.default_rng(seed))
    judged = kept_out if kept_out.any() else used
    net.thresholds = _thresholds(_sigmoid(_logits(net, read))[judged], labels[judged], read.languages[judged])
    return net


def _best(p: np.ndarray, cold: np.ndarray, hot: np.ndarray) -> float:
    """The threshold of the best F1, by the texts of each class at ascending p; among equal ones the middle of the widest gap."""
    hits, taken = np.cumsum(hot[::-1])[::-1], np.cumsum((hot + cold)[::-1])[::-1]
    f1 = 2 * hits / np.maximum(taken + hot.sum(), 1)
    low = np.concatenate([[0.0], p[:-1]])
    top = np.flatnonzero(f1 >= f1.max() - 1e-12)
    widest = top[np.argmax((p - low)[top])]
    return float(np.clip((p[widest] + low[widest]) / 2, 0.02, 0.98))


def _thresholds(p: np.ndarray, labels: np.ndarray, languages: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
    """The threshold of each language, that of all where it has few texts; `n`: how many texts an entry stands for."""
    values, place = np.unique(p, return_inverse=True)
    n = np.ones(len(p), np.int64) if n is None else n

    def classes(own: np.ndarray) -> list[np.ndarray]:
        return [np.bincount(place[own & (labels == c)], n[own & (labels == c)], len(values)) for c in (0, 1)]

    found = np.full(len(LANGUAGES), _best(values, *classes(np.full(len(p), True))))
    for language in range(len(LANGUAGES)):
        cold, hot = classes(languages == language)
        if min(cold.sum(), hot.sum()) >= MIN_PER_LANGUAGE:
            kept = cold + hot > 0
            found[language] = _best(values[kept], cold[kept], hot[kept])
    return found


_WORKER: dict[str, Network] = {}


def scored(spark: SparkSession, docs: DataFrame, net: Network) -> tuple[DataFrame, str]:
    """(`docs` with a struct column, its name): score and predicted of every whole text.

    Null, empty and wordless texts get the score of a text without any filter response. The network has a fixed
    size and is broadcast.
    """
    sent, key, name = spark.sparkContext.broadcast(net), uuid.uuid4().hex, free_name(docs, "toxicity")

    def work(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> list:
        if key not in _WORKER:
            _WORKER.clear()
            _WORKER[key] = sent.value
        score = _WORKER[key].scores(Words(data, offsets, ALNUM_WORD, LOWER)).astype(np.float64)
        score = score.round(6)  # the last bits depend on what else is in the batch
        return [score, (score >= THRESHOLD).astype(np.int32)]

    return annotated(docs, name, "score double, predicted int", work, PIECE_BYTES), name


def _read(rows: pa.Table | pa.RecordBatch) -> _Texts:
    return _Texts.of(*text_bytes(rows.column("text")), rows.column("label").to_numpy(zero_copy_only=False).astype(np.int64))


def _counted(table: DataFrame, schema: str, count: Callable[[_Texts], list[np.ndarray]], sums: tuple[str, ...]) -> pa.Table:
    """What `count` finds in pieces of the labelled texts, summed up by the other columns of the schema."""
    names = [part.split()[0] for part in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, _ in in_pieces(batch, "text", PIECE_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in count(_read(rows))], names)

    found = table.select("text", "label").mapInArrow(work, schema)
    return found.groupBy(*[c for c in names if c not in sums]).agg(*[F.sum(c).alias(c) for c in sums]).toArrow()


def _all_holders(table: DataFrame) -> np.ndarray:
    """`_holders` of all texts; a row of counts for each row of the embedding table."""

    def count(texts: _Texts) -> list[np.ndarray]:
        held = _holders(texts)
        seen = np.flatnonzero(held.any(0))
        return [seen, held[0, seen], held[1, seen]]

    found = _counted(table, "place long, cold long, hot long", count, ("cold", "hot"))
    held = np.zeros((2, (1 + len(PREFIXES)) << BUCKET_BITS), np.int64)
    held[:, found["place"].to_numpy()] = found["cold"].to_numpy(), found["hot"].to_numpy()
    return held


def _all_thresholds(table: DataFrame, sent) -> np.ndarray:
    """`_thresholds` of all texts, whose logits are counted by steps of a hundredth."""

    def count(texts: _Texts) -> list[np.ndarray]:
        steps = np.rint(np.clip(_logits(sent.value.net, texts).astype(np.float64), -30, 30) * BINS).astype(np.int64)
        kinds, n = np.unique(np.stack([texts.languages.astype(np.int64), texts.labels, steps]), axis=1, return_counts=True)
        return [*kinds, n]

    found = _counted(table, "language long, label long, step long, n long", count, ("n",))
    language, label, step, n = (found[c].to_numpy() for c in ("language", "label", "step", "n"))
    return _thresholds(_sigmoid(step / BINS), label, language, n)


_SUMMED = [f"d{i}" for i in range(DIMENSIONS)] + [f"s{i}" for i in range(DIMENSIONS)]


def _round(part: DataFrame, sent, fit: _Fit, passes: int, seed: int) -> None:
    """Each shard of `part` trains a copy of the network; `fit` takes the mean of each number over the shards that moved it."""

    def work(rows: pa.Table) -> pa.Table:
        shard = rows["shard"][0].as_py()
        rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        before, own = sent.value, sent.value.copy()
        texts = _read(rows)
        _descend(own, texts, np.arange(len(texts.labels)), passes, np.random.default_rng([seed, shard]))
        place = np.flatnonzero((own.squares[0] != before.squares[0]).any(1))
        moved = np.hstack([own.arrays()[0][place].astype(np.float64) - before.arrays()[0][place], own.squares[0][place].astype(np.float64) - before.squares[0][place]])
        change = own.table() - before.table()
        change = np.pad(change, ((0, 0), (0, -change.shape[1] % DIMENSIONS)))
        dense = np.hstack(change.reshape(2, -1, DIMENSIONS))
        place = np.concatenate([place, len(before.squares[0]) + np.arange(len(dense))])
        whole = np.rint(np.concatenate([moved, dense]) * FIXED).astype(np.int64)
        return pa.table([pa.array(place), pa.array(np.ones(len(place), np.int64)), *[pa.array(c) for c in whole.T]], ["place", "n", *_SUMMED])

    schema = ", ".join(f"{c} long" for c in ("place", "n", *_SUMMED))
    moved = part.select("doc_id", "text", "label", "shard").groupBy("shard").applyInArrow(work, schema)
    found = moved.groupBy("place").agg(*[F.sum(c).alias(c) for c in ("n", *_SUMMED)]).toArrow()  # a row per row of the network
    place, n = found["place"].to_numpy(), found["n"].to_numpy()
    mean = np.stack([found[c].to_numpy() for c in _SUMMED], 1) / (FIXED * n[:, None])
    size = len(fit.squares[0])
    words = place < size
    fit.net.embeddings[place[words]] += mean[words, :DIMENSIONS].astype(np.float32)
    fit.squares[0][place[words]] += mean[words, DIMENSIONS:].astype(np.float32)
    table = fit.table()
    dense = mean[~words][np.argsort(place[~words])]
    if len(dense):
        fit.set_table(table + np.stack([dense[:, :DIMENSIONS].ravel(), dense[:, DIMENSIONS:].ravel()])[:, : table.shape[1]])


def fit(docs: DataFrame, labels: DataFrame, seed: int = 5) -> Network:
    """A network fitted to all labelled texts that are not held out, one in CALIBRATION_PART of which only sets the thresholds."""
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    table = labelled_texts(slim, labels.select("doc_id", "toxic"), "toxic", ~held_out(4, 2))
    spark, net = docs.sparkSession, _network(seed)
    aside = F.col("draw") % CALIBRATION_PART == CALIBRATION_PART - 1
    sizes = table.groupBy(aside.alias("aside"), "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()
    totals, n_bytes = np.zeros((2, 2), np.int64), np.zeros(2, np.int64)
    for row in sizes:  # four at most
        totals[int(row["aside"]), row["label"]] = row["n"]
        n_bytes[int(row["aside"])] += row["size"]
    if not totals.sum(0).all():
        return _constant(net, bool(totals[:, 1].any()))
    learned, judged = table.where(~aside), table.where(aside)
    if totals[1].min() < MIN_PER_LANGUAGE or not totals[0].all():
        learned, judged, totals, n_bytes = table, table, totals.sum(0, keepdims=True), n_bytes.sum(keepdims=True)
    n = int(totals[0].sum())
    state = _started(net, _all_holders(learned), totals[0])
    shards, passes = max(1, math.ceil(n / SHARD_ROWS), math.ceil(int(n_bytes[0]) / SHARD_BYTES)), _passes(n)
    parts, inner = min(PARTS, shards), passes if shards == 1 else 1
    draw = F.floor(F.col("draw") / CALIBRATION_PART)
    shard = F.floor(draw / parts) % math.ceil(shards / parts)
    for step in range(parts * passes // inner):
        sent = spark.sparkContext.broadcast(state)
        _round(learned.where(draw % parts == step % parts).withColumn("shard", shard), sent, state, inner, seed + step)
        sent.destroy()
    sent = spark.sparkContext.broadcast(state)
    net.thresholds = _all_thresholds(judged, sent)
    sent.destroy()
    discard(table)
    return net


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Learned from all labels of rows that are not held out. Without labels of both classes the score is constant. Rows that
    repeat a doc_id are scored each by its own text. Thresholds are calibrated for English, French, German and Spanish, as
    guessed from function words; texts of all other languages share one.
    """
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found, name = scored(spark, slim, fit(docs, labels))
    return found.select("doc_id", held_out(4, 2).alias("held_out"), f"{name}.score", f"{name}.predicted")
