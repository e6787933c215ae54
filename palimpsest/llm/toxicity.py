"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed word features learns from confirmed toxic texts and unlabelled texts alone. Its risk
corrects the unlabelled part for the toxic texts hidden in it, by the class prior, and is kept from turning negative:
where that part falls below zero, it counts as zero.

The fit uses every confirmed and every other text. Features are whole words and their first four to six letters; their
counts over all texts decide which stay: those more frequent in confirmed texts, at most ``FEATURES``, the size of the
model that all executors get. Texts with the same features are one row with a count. With the logistic loss the risk is
the greater of two convex functions of the weights, so it has one minimum: L-BFGS finds it, and each evaluation is a
job that sums losses and slopes over all rows where they lie. What executors get whole: the model and the ids of
confirmed texts, eight bytes each.

Defined cases: null, empty and letterless texts get the score of the bias alone; texts of any length are read in
pieces; without confirmed texts every score is the prior; repeated rows give repeated result rows; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.bpe import LETTER, char_classes, hash_tables
from palimpsest.llm.common import BLOCK_CHARS, column, stored, text_or_empty, text_runs

FEATURES = 2048
LEAST_TEXTS, LEAST_LIFT, LEAST_GAIN = 2, 3.0, 6.0
PREFIXES = (4, 5, 6)
FOLDS = 5
PRIOR = 0.05
DECAY, BEND = 3e-3, 1e-4
#: With few confirmed texts decay is this over their number: weights that fit them alone would explain all other texts.
FEW = 1.0
#: Pairs of a text and a feature that a worker holds before it gives their counts.
PAIRS = 1 << 19


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(-1))


def cut_words(text: str, most: int = BLOCK_CHARS) -> list[str]:
    """A long text in pieces that end after a blank where there is one."""
    out, at = [], 0
    while len(text) - at > most:
        end = text.rfind(" ", at, at + most) + 1
        end = end if end > at else at + most
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def features(texts: list[str], known: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text numbers, feature hashes), distinct within a block of texts; only ``known`` (sorted) ones if given."""
    pieces, whose = [], []
    for i, text in enumerate(texts):
        for piece in cut_words(text.lower()) if len(text) > BLOCK_CHARS else [text.lower()]:
            pieces.append(piece)
            whose.append(i)
    seen = None
    if known is not None:
        seen = np.zeros(1 << 20, bool)
        seen[(known >> np.uint64(44)).astype(np.int64)] = True
    words, up, down = hash_tables()
    for a, b in text_runs([len(p) for p in pieces]):
        points = np.frombuffer("".join(pieces[a:b]).encode("utf-32-le"), np.uint32)
        if not len(points):
            continue
        if len(points) > len(up):
            raise ValueError("a block is too long")
        hard = np.cumsum([0, *map(len, pieces[a : b - 1])])
        letter = char_classes()[points] == LETTER
        first = letter.copy()
        first[1:] &= ~letter[:-1]
        cut = hard[hard < len(points)]
        first[cut] |= letter[cut]
        begin = np.flatnonzero(first)
        stop = np.append(~letter[1:], True) & letter
        stop[cut[cut > 0] - 1] |= letter[cut[cut > 0] - 1]
        size = np.flatnonzero(stop) + 1 - begin
        text_of = np.array(whose[a:b])[np.searchsorted(hard, begin, "right") - 1]
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(words[points] * up[: len(points)], out=sums[1:])
        got_texts, got = [], []
        for n in (0, *PREFIXES):
            has = np.flatnonzero(size >= (n or 3))
            s = begin[has]
            e = s + (n or size[has])
            keys = ((sums[e] - sums[s]) * down[s] + np.uint64(n + 1)) * np.uint64(0x9E3779B97F4A7C15)
            if seen is not None:
                hit = seen[(keys >> np.uint64(44)).astype(np.int64)]
                keys, has = keys[hit], has[hit]
                hit = known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys
                keys, has = keys[hit], has[hit]
            got_texts.append(text_of[has])
            got.append(keys)
        pairs = np.unique(np.stack([np.concatenate(got_texts).astype(np.uint64), np.concatenate(got)]), axis=1) if seen is not None else None
        if pairs is not None:
            yield pairs[0].astype(np.int64), pairs[1]
        else:
            yield np.concatenate(got_texts), np.concatenate(got)


@dataclass(frozen=True)
class Model:
    keys: np.ndarray  # sorted
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        if len(self.keys):
            seen: set[tuple[int, int]] = set()
            for who, keys in features(texts, self.keys):
                for i, k in zip(who.tolist(), np.searchsorted(self.keys, keys).tolist(), strict=True):
                    if (i, k) not in seen:
                        seen.add((i, k))
                        total[i] += self.weights[k]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def distinct_pairs(texts: list[str], known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text numbers, features) of texts, each pair once, in order."""
    whos, keys, held, most = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0, PAIRS

    def merged() -> tuple[np.ndarray, np.ndarray]:
        who, key = np.concatenate(whos), np.concatenate(keys)
        turn = np.lexsort((key, who))
        who, key = who[turn], key[turn]
        fresh = np.append(True, (who[1:] != who[:-1]) | (key[1:] != key[:-1]))[: len(who)]
        return who[fresh], key[fresh]

    for who, key in features(texts, known):
        whos.append(who)
        keys.append(key)
        held += len(who)
        if held > most:
            whos, keys = ([x] for x in merged())
            held = len(whos[0])
            most = max(PAIRS, 2 * held)
    return merged()


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray]]:
    """(texts, which are confirmed), about ``BLOCK_CHARS`` code points at a time."""
    for batch in batches:
        sizes = column(batch, "size")
        for a, b in text_runs(sizes):
            part = batch.slice(a, b - a)
            yield column(part, "text"), np.array(column(part, "positive"), bool)


def feature_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, p, u): how many confirmed and other texts have a feature; keys recur."""
    held: list[list[np.ndarray]] = [[], []]
    many = 0

    def give() -> pa.RecordBatch:
        sides = [np.concatenate([np.zeros(0, np.uint64), *x]) for x in held]
        keys, at = np.unique(np.concatenate(sides), return_inverse=True)
        p, u = (np.bincount(x, minlength=len(keys)) for x in np.split(at, [len(sides[0])]))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (keys.view(np.int64), p, u)], ["key", "p", "u"])

    for texts, positive in slices(batches):
        who, keys = distinct_pairs(texts)
        ours = positive[who]
        held[0].append(keys[ours])
        held[1].append(keys[~ours])
        many += len(keys)
        if many > PAIRS:
            yield give()
            held, many = [[], []], 0
    if many:
        yield give()


def feature_sets(batches: Iterable[pa.RecordBatch], known: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(positive, at, n): how many confirmed or other texts have just the features ``at`` (16 bits each); sets recur."""
    for batch in batches:
        seen: Counter[tuple[bool, bytes]] = Counter()
        for texts, positive in slices([batch]):
            who, keys = distinct_pairs(texts, known)
            at = np.searchsorted(known, keys).astype("<u2")
            ends = np.searchsorted(who, np.arange(len(texts)), "right").tolist()
            seen.update((p, at[a:b].tobytes()) for p, a, b in zip(positive.tolist(), [0, *ends], ends))  # noqa: B905
        arrays = [pa.array([p for p, _ in seen], pa.bool_()), pa.array([x for _, x in seen], pa.binary()), pa.array(list(seen.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["positive", "at", "n"])


def sums(batches: Iterable[pa.RecordBatch], weights: np.ndarray) -> np.ndarray:
    """Over rows (positive, at, n), for confirmed and then for other texts: their number, the sums of the loss if called
    toxic and if called not toxic, of the chances, of the features and of the chances of features."""
    n = len(weights) - 1
    total = np.zeros((2, 4 + 2 * n))
    for batch in batches:
        sets = column(batch, "at")
        what = np.frombuffer(b"".join(sets), "<u2").astype(np.int64)
        who = np.repeat(np.arange(len(sets)), [len(x) // 2 for x in sets])
        margin = np.bincount(who, weights[what], len(sets)) + weights[n]
        chance = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        texts = np.array(column(batch, "n"), np.float64)
        positive = np.array(column(batch, "positive"), bool)
        for k, ours in enumerate((positive, ~positive)):
            times = texts * ours
            total[k, :4] += times.sum(), times @ np.logaddexp(0, -margin), times @ np.logaddexp(0, margin), times @ chance
            total[k, 4 : 4 + n] += np.bincount(what, times[who], n)
            total[k, 4 + n :] += np.bincount(what, (times * chance)[who], n)
    return total


def lowest(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, close: float = 1e-4, rounds: int = 200, memory: int = 20) -> np.ndarray:
    """The minimum of a smooth convex function that gives its value and slope, by L-BFGS."""
    value, slope = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(slope).max() <= close:
            break
        way, shares = slope.copy(), []
        for s, y in reversed(past):
            shares.append((s @ way) / (s @ y))
            way -= shares[-1] * y
        if past:
            way *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, y), share in zip(past, reversed(shares)):  # noqa: B905
            way += (share - (y @ way) / (s @ y)) * s
        step = 1.0
        while True:
            moved = x - step * way
            new, its_slope = f(moved)
            if new <= value - 1e-4 * step * (slope @ way) or step < 1e-9:
                break
            step /= 2
        if new >= value:
            break
        s, y = moved - x, its_slope - slope
        past = [*past, (s, y)][-memory:] if s @ y > 0 else past
        x, value, slope = moved, new, its_slope
    return x


def fit_nnpu(totals: Callable[[np.ndarray], np.ndarray], n: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic classifier with the least non-negative PU risk; totals: ``sums`` over all texts.

    The risk is that of confirmed texts, plus that of the others as far as it exceeds what the toxic ones hidden in them
    explain (the rest), if that is above zero; smooth within about ``BEND`` of zero, so it stays convex.
    """

    def risk(weights: np.ndarray) -> tuple[float, np.ndarray]:
        found = totals(weights)
        p, u = (row / row[0] for row in found)
        decay = max(DECAY, FEW / found[0, 0])
        rest = u[2] - prior * p[2]
        share = np.exp(-np.logaddexp(0, -rest / BEND))
        caught = prior * np.append(p[4 + n :] - p[4 : 4 + n], p[3] - 1)
        called = np.append(u[4 + n :], u[3]) - prior * np.append(p[4 + n :], p[3])
        held = np.append(weights[:n], 0)
        return prior * p[1] + BEND * np.logaddexp(0, rest / BEND) + decay / 2 * held @ held, caught + share * called + decay * held

    weights = lowest(risk, np.append(np.zeros(n), np.log(prior / (1 - prior))))
    return weights[:n], float(weights[n])


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. Labels of the held-out fold are never read."""
    usable = labels.select(F.col("doc_id").cast("long").alias("id"), "toxic").where((fold(F.col("id")) > 0) & F.col("toxic").isNotNull())
    confirmed = usable.where("toxic = 1").select("id").distinct().withColumn("positive", F.lit(True))
    if prior is None:
        share = usable.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
        prior = min(max(share or PRIOR, 1e-3), 0.5)
    marked = docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("text")).where("id is not null").join(F.broadcast(confirmed), "id", "left")
    texts = marked.select(F.coalesce("positive", F.lit(False)).alias("positive"), "text", F.length("text").alias("size"))
    sizes = {r["positive"]: r["n"] for r in texts.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(True) or not sizes.get(False):
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior))))
    counts = texts.mapInArrow(feature_counts, "key long, p long, u long").groupBy("key").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    # Texts expected if the feature were as common in confirmed texts as in the others, and the log-likelihood gain.
    p, expected = F.col("p"), sizes[True] * (F.col("u") + 0.5) / sizes[False]
    gain = p * F.log(p / expected) - (p - expected)
    top = counts.where((p >= LEAST_TEXTS) & (p >= LEAST_LIFT * expected) & (gain >= LEAST_GAIN)).orderBy(gain.desc(), "key").limit(FEATURES)
    keys = np.sort(np.array([r["key"] for r in top.select("key").collect()], np.int64).view(np.uint64))
    if not len(keys):
        return Model(keys, np.zeros(0), float(np.log(prior / (1 - prior))))
    sent = docs.sparkSession.sparkContext.broadcast(keys)
    sets = texts.mapInArrow(lambda batches: feature_sets(batches, sent.value), "positive boolean, at binary, n long")
    rows = stored(sets.groupBy("positive", "at").agg(F.sum("n").alias("n")).sortWithinPartitions("positive", "at"), "nnpu-rows")

    def totals(weights: np.ndarray) -> np.ndarray:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array([sums(batches, weights).tobytes()], pa.binary())], ["sums"])

        return sum(np.frombuffer(r["sums"]).reshape(2, -1) for r in rows.mapInArrow(run, "sums binary").collect())

    weights, bias = fit_nnpu(totals, len(keys), prior)
    return Model(keys, weights, bias)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(column(batch, "id"), pa.int64()), pa.array(sent.value.score(column(batch, "text")), pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = sent.value.score([t or "" for t in batch.column(at).to_pylist()]) >= threshold
            yield batch.filter(pa.array(~toxic))

    return docs.mapInArrow(run, docs.schema)
