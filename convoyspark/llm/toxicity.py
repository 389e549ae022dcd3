"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams and itself, hashed to a fixed number of embeddings, so that a misspelling nobody has
labelled still shares most of its vectors with the word it hides. The embeddings of a bag are averaged and go through a softmax;
a document scores as its highest word, so that length does not dilute it. Embeddings and softmax are trained jointly in numpy
on a bounded sample of labelled rows. Labels belong to documents, so which words of a toxic document are toxic is learned too.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import ragged
from .shared import lean, release, stored

BUCKETS = 1 << 18
DIMENSIONS = 8
GRAMS = (3, 4, 5, 6)
BATCH_WORDS = 8192
STEP = 0.3
ROUND_WORDS = 100_000
KEEP = 0.6
SAMPLE_ROWS = (5000, 2000)  # clean and toxic ones at most
SAMPLE_CHARS = 20_000  # longer texts are not learned from; they are scored all the same
ROUNDS = 8
BLOCK_CHARS = 1 << 16
_CUTS = np.zeros(128, bool)
_CUTS[[*range(33), 127, *map(ord, '.,;:!?|()"')]] = True


@dataclass
class Model:
    """``worth`` of each embedding along the softmax's axis, the bias, and the logit of texts without words (that of a usual
    clean text); all that scoring needs."""

    worth: np.ndarray
    bias: float
    empty: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for start, stop in ragged.blocks(texts, BLOCK_CHARS):
            bag = Bags(texts[start:stop])
            logits = np.full(stop - start, self.empty)
            if len(bag.words):
                docs = np.flatnonzero(np.diff(bag.doc_words))
                logits[docs] = self.bias + np.maximum.reduceat(_averages(self.worth, bag.ids, bag.id_at)[bag.words], bag.doc_words[docs])
            out[start:stop] = 1 / (1 + np.exp(-np.clip(logits, -500, 500)))
        return out


class Bags:
    """Distinct words of some texts with their embedding ids, and which words each text has, in order."""

    def __init__(self, texts: list[str | None]):
        lowered = [(t or "").lower() for t in texts]
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in lowered])))
        data = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = ~_CUTS[np.minimum(data, 127)] | (data > 127)
        inside &= (data != 0xA0) & (data != 0x2028) & (data != 0x3000)
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        before, after = np.concatenate(([False], inside)), np.concatenate((inside, [False]))
        starts, ends = np.flatnonzero(after & (~before | edge)), np.flatnonzero(before & (~after | edge))
        self.keys, first, self.words = np.unique(ragged.hashes(data, starts, ends), return_index=True, return_inverse=True)
        self.ids, self.id_at = _embedding_ids(data, starts[first], ends[first])
        self.doc_words = np.searchsorted(starts, bounds)


def _vocabulary(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of many texts, block by block: the embedding ids of all distinct words and where each word's begin, and
    all distinct pairs of text and word."""
    keys, own, sizes, ids, docs, words, known = [], [], [], [], [], [], 0
    seen = np.zeros(0, np.uint64)
    for start, stop in ragged.blocks(texts, BLOCK_CHARS):
        bag = Bags(texts[start:stop])
        doc = np.repeat(np.arange(start, stop), np.diff(bag.doc_words))
        pair = np.unique(doc * len(bag.keys) + bag.words) if len(bag.keys) else doc
        docs.append((pair // max(1, len(bag.keys))).astype(np.int32))
        words.append((pair % max(1, len(bag.keys)) + known).astype(np.int32))
        keys.append(bag.keys)
        known += len(bag.keys)
        new = ~np.isin(bag.keys, seen, assume_unique=True)  # only new words' ids are kept, as most words come again
        own.append(bag.keys[new])
        sizes.append(np.diff(bag.id_at)[new])
        ids.append(ragged.gather(bag.ids, bag.id_at[:-1][new], sizes[-1]).astype(np.int32))
        seen = np.union1d(seen, own[-1])
    sizes, ids = np.concatenate(sizes), np.concatenate(ids)
    first = np.argsort(np.concatenate(own))  # in the order of ``seen``
    at = np.cumsum(sizes) - sizes
    kept = ragged.gather(ids, at[first], sizes[first])
    inverse = np.searchsorted(seen, np.concatenate(keys))
    return kept, np.concatenate(([0], np.cumsum(sizes[first]))), np.concatenate(docs), inverse[np.concatenate(words)].astype(np.int32)


def _embedding_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each word (itself and its n-grams with marks at both ends) in one array, and where each word's begin."""
    length = ends - starts
    at = np.concatenate(([0], np.cumsum(length + 2)))
    marked = np.full(at[-1], ord("<"), np.uint32)
    marked[at[1:] - 1] = ord(">")
    place = np.repeat(at[:-1] + 1 - (np.cumsum(length) - length), length) + np.arange(length.sum())
    marked[place] = ragged.gather(data, starts, length)
    each = [np.ones(len(starts), np.int64)] + [np.maximum(0, length + 3 - n) for n in GRAMS]
    total = np.sum(each, axis=0)
    id_at = np.concatenate(([0], np.cumsum(total)))
    ids = np.empty(id_at[-1], np.int64)
    offset = id_at[:-1].copy()
    for n, count in zip((0, *GRAMS), each):
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        begin = np.repeat(at[:-1], count) + nth
        end = np.repeat(at[1:], count) if n == 0 else begin + n
        h = ragged.hashes(marked, begin, end) if len(begin) else np.zeros(0, np.uint64)
        ids[np.repeat(offset, count) + nth] = (h % np.uint64(BUCKETS)).astype(np.int64)
        offset += count
    return ids, id_at


def fit(texts: list[str | None], toxic: np.ndarray, seed: int = 7) -> Model:
    """Joint training of embeddings and softmax over the sample's distinct words. Without rows of both labels the model
    says the only label there is (0 for none).

    A word of a clean text is clean. Of a toxic text, the words that no clean text has may be toxic in the first round;
    later only its highest-scored word is. Every fifth text is kept back to place the softmax's bias between the labels.
    """
    toxic = np.asarray(toxic, bool)
    if not toxic.any() or toxic.all():
        return Model(np.zeros(BUCKETS), *[5.0 if toxic.any() else -5.0] * 2)
    rng = np.random.default_rng(seed)
    ids_of, id_at, doc_of, word_of = _vocabulary(texts)
    size, n = np.diff(id_at), len(id_at) - 1
    back = np.arange(len(texts)) % 5 == 4
    learn = ~back[doc_of]
    in_clean = np.bincount(word_of[learn & ~toxic[doc_of]], minlength=n)
    in_toxic = np.bincount(word_of[learn & toxic[doc_of]], minlength=n)
    embeddings = rng.normal(0, 0.01, (BUCKETS, DIMENSIONS)).astype(np.float32)
    axis = rng.normal(0, 0.5, DIMENSIONS).astype(np.float32)
    bias = -1.0
    suspect = learn & toxic[doc_of] & (in_clean[word_of] == 0)
    positive = np.where(in_clean == 0, in_toxic, 0)
    negative = np.flatnonzero(in_clean)
    for round_ in range(ROUNDS):
        if round_:
            z = _averages(embeddings @ axis, ids_of, id_at)
            top = np.full(len(texts), -np.inf)
            np.maximum.at(top, doc_of[suspect], z[word_of[suspect]])
            best = suspect & (z[word_of] == top[doc_of])
            positive = np.bincount(word_of[best], minlength=n)
        chosen = np.flatnonzero(positive)
        some = rng.choice(negative, min(len(negative), ROUND_WORDS), replace=False)
        hard = negative[np.argsort(-z[negative])[: ROUND_WORDS // 4]] if round_ else some[:0]
        use = np.concatenate((chosen, some, hard))
        target = np.repeat([1.0, 0.0], [len(chosen), len(some) + len(hard)])
        weight = np.concatenate((np.minimum(positive[chosen], 50.0), np.ones(len(some) + len(hard))))
        weight[: len(chosen)] *= max(1.0, 0.2 * len(some) / weight[: len(chosen)].sum())
        order = rng.permutation(len(use))
        for i in range(0, len(order), BATCH_WORDS):
            part = order[i : i + BATCH_WORDS]
            words, count = use[part], size[use[part]]
            ids = ragged.gather(ids_of, id_at[words], count)
            kept = rng.random(len(ids)) < KEEP  # so that no n-gram leans on the whole word
            kept[np.cumsum(count) - 1] = True
            count = np.add.reduceat(kept, np.cumsum(count) - count, dtype=np.int64)
            ids = ids[kept]
            mean = np.add.reduceat(embeddings[ids], np.cumsum(count) - count) / count[:, None]
            p = 1 / (1 + np.exp(-np.clip(mean @ axis + bias, -30, 30)))
            error = (p - target[part]) * np.minimum(weight[part], 20.0)
            pull = np.bincount(ids, weights=np.repeat(error / count, count), minlength=BUCKETS)
            embeddings -= (STEP * pull).astype(np.float32)[:, None] * axis
            axis -= (STEP / len(part) * (error @ mean)).astype(np.float32)
            bias -= STEP / len(part) * error.sum()
    worth = embeddings @ axis
    z = _averages(worth, ids_of, id_at)
    top = np.full(len(texts), -np.inf)
    np.maximum.at(top, doc_of, z[word_of])
    known = back & np.isfinite(top)
    cut = _cut(top[known], toxic[known], -bias)
    usual = top[np.isfinite(top) & ~toxic]
    return Model(worth, float(-cut), min(-0.01, float(np.median(usual) - cut)) if len(usual) else -1.0)


def _averages(worth: np.ndarray, ids: np.ndarray, id_at: np.ndarray) -> np.ndarray:
    """Of each word, some thousands at a time."""
    out = np.empty(len(id_at) - 1)
    for i in range(0, len(out), 1 << 14):
        at = id_at[i : i + (1 << 14) + 1]
        out[i : i + (1 << 14)] = np.add.reduceat(worth[ids[at[0] : at[-1]]], at[:-1] - at[0]) / np.diff(at)
    return out


def _cut(scores: np.ndarray, toxic: np.ndarray, otherwise: float) -> float:
    """In the widest gap among the cuts with the fewest errors on the texts kept back, a quarter up: words that are
    toxic but new share only some of their vectors with known ones."""
    if not toxic.any() or toxic.all():
        return otherwise
    order = np.argsort(scores)
    s, y = scores[order], toxic[order]
    errors = np.concatenate(([0], np.cumsum(y))) + (~y).sum() - np.concatenate(([0], np.cumsum(~y)))  # cut before each rank
    inner = np.arange(1, len(s))
    best = inner[errors[inner] == errors[inner].min()]
    widest = best[np.argmax(s[best] - s[best - 1])]
    return 0.75 * s[widest - 1] + 0.25 * s[widest]


def sample(docs: DataFrame, labels: DataFrame, learn: Column) -> tuple[list, np.ndarray]:
    """At most ``SAMPLE_ROWS`` labelled rows with text of up to ``SAMPLE_CHARS`` characters for the driver, picked by a hash of the id among rows where ``learn`` (a condition on ``doc_id``) holds."""
    marks = labels.filter("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = docs.select("doc_id", "text").filter(learn & F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    ids = usable.select("doc_id").join(marks, "doc_id").distinct()
    parts = [ids.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(SAMPLE_ROWS[y]) for y in (0, 1)]
    chosen = F.broadcast(stored(parts[0].unionByName(parts[1]), "sample"))  # so many rows at most
    texts = usable.join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    picked = sorted(texts.collect(), key=lambda r: (r["toxic"], r["doc_id"]))
    return [r["text"] for r in picked], np.array([r["toxic"] for r in picked], bool)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns only from rows that are not held out."""
    learned = sample(docs, labels, ~held_out(F.col("doc_id")))
    release()
    model = fit(*learned)
    del learned
    release()  # the driver goes on to other stages
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and ``_score`` (0 to 1) of the whole ``text``. Null and empty texts score like a usual clean text."""
    broadcast = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS doubles, whatever the corpus
    names, place = docs.columns, docs.columns.index("text")

    def apply(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                scores = broadcast.value.scores(part.column(place).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], [*names, "_score"])

    return docs.mapInArrow(lean(apply), docs.select("*", F.lit(0.0).alias("_score")).schema)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for every row. Repeated rows score alike; an empty table gives no rows."""
    rows = score(docs.select("doc_id", "text"), train(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"),
                       (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    return score(docs, train(docs, labels)).filter("_score < 0.5").drop("_score")
