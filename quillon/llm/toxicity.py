"""Toxicity scores of whole texts from subword embeddings.

Method: a bag of character n-grams.  A word is the average of the embeddings of its
character n-grams (with word boundaries) and of itself, each found by hashing into a
fixed number of rows; a passage is the average of its words, put through a linear
softmax.  Embeddings and softmax are trained jointly in numpy (Adam), so misspellings
that never occurred in training share the vectors of their n-grams.  A document is
scored passage by passage (``passage_words`` words each, the whole text) and takes
the mean logit of its ``worst`` worst passages; training picks the worst passages of
each document likewise, so a long document with few toxic words is learned and found.

Scale: the model is fitted on at most ``per_class`` labelled documents of each class
and ``train_chars`` characters in all, taken in the order of a hash of their ids:
bounded by these parameters.  Where a class has more characters than its half, its
longest texts alone are shortened, to one common length that makes it fit, and give
up to 16 pieces spread evenly over the text.  It is ``buckets`` x ``dim`` numbers whatever the input,
and the table sent to executors is one number per bucket, as a linear softmax of
averages is an average of numbers.  Scoring is one pass in Arrow batches, no shuffle.

Cases: a null or empty text, or one of white space, has no words and gets the score
of the bias alone; texts of any length are read whole; repeated rows are scored each;
labels that are null are left out, a document labelled more than once counts as toxic
if any label says so; with no usable labels, or of one class only, all scores are that
class's share (0 when there is none); an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import give_back, text_slices

#: Characters taken off both ends of a word.
_EDGE = ".,;:!?\"'()[]{}<>*#$%&|_-…«»“”‘’"
_NGRAMS = (3, 4, 5)


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 17
    dim: int = 8
    passage_words: int = 5
    worst: int = 3
    per_class: int = 1500
    train_chars: int = 8_000_000
    epochs: int = 6
    toxic_weight: float = 2.0
    batch: int = 256
    rate: float = 0.05
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """weight[b]: what an n-gram of bucket b adds to the logit of toxic, before averaging."""

    weight: np.ndarray
    bias: float
    settings: Settings


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(document of each word, index of its form, forms) for an array of texts."""
    texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    lists = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    doc, flat = pc.list_parent_indices(lists), lists.flatten()
    full = pc.not_equal(flat, "")
    doc, flat = doc.filter(full), flat.filter(full)
    coded = flat.dictionary_encode()
    forms = pc.utf8_trim(coded.dictionary, characters=_EDGE)
    return doc.to_numpy(zero_copy_only=False), coded.indices.to_numpy(zero_copy_only=False), forms


def subwords(forms: pa.Array, buckets: int, chunk: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each subword, start of each form's subwords); every form has one at least."""
    parts = [_subwords(forms.slice(k, chunk), buckets) for k in range(0, len(forms), chunk)]  # in chunks for small temporaries
    ids = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.int32)
    counts = np.concatenate([p[1] for p in parts]) if parts else np.empty(0, np.int64)
    return ids, np.concatenate([[0], np.cumsum(counts)])


def _subwords(forms: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(forms)
    joined = "".join(f"<{w}>" for w in forms.to_pylist())
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    length = pc.utf8_length(forms).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    ends = np.cumsum(length)
    starts = ends - length
    owner = np.repeat(np.arange(n), length)
    left = np.repeat(ends, length) - np.arange(len(codes))  # characters up to the word's end
    mix = np.uint64(0x9E3779B97F4A7C15)
    owners, hashes = [], []
    h = np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(max(_NGRAMS)):
            m = len(codes) - k
            if m <= 0:
                break
            h = (h[:m] + codes[k:] + np.uint64(1)) * mix
            h ^= h >> np.uint64(29)
            if k + 1 in _NGRAMS:
                keep = left[:m] >= k + 1
                owners.append(owner[:m][keep])
                hashes.append(h[keep] + np.uint64(k))
        place = (np.arange(len(codes)) - np.repeat(starts, length)).astype(np.uint64)
        whole = np.add.reduceat(((codes + np.uint64(7)) * mix) ^ (place * np.uint64(0xC2B2AE3D27D4EB4F)) * (codes + place), starts)
        owners.append(np.arange(n))
        hashes.append(whole)
        h = np.concatenate(hashes) * mix
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    ids = ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)[order]
    return ids, np.bincount(owners, minlength=n)


def passages(doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(passage of each word, document of each passage); doc is sorted."""
    if not len(doc):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.flatnonzero(np.diff(doc, prepend=-1))
    place = np.arange(len(doc)) - np.repeat(new, np.diff(np.append(new, len(doc))))
    begins = place % size == 0
    return np.cumsum(begins) - 1, doc[begins]


def worst_passages(owner: np.ndarray, logit: np.ndarray, most: int) -> np.ndarray:
    """Indexes of the ``most`` passages of each document with the highest logits."""
    order = np.lexsort((-logit, owner))
    first = np.flatnonzero(np.diff(owner[order], prepend=-1))
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[place < most]


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def score_texts(texts: pa.Array, model: Model) -> np.ndarray:
    return np.concatenate([np.empty(0), *(_score_texts(t, model) for t in text_slices(texts))])


def _score_texts(texts: pa.Array, model: Model) -> np.ndarray:
    n = len(texts)
    total, count = np.zeros(n), np.zeros(n)
    doc, word, forms = split_words(texts)
    if len(doc):
        ids, starts = subwords(forms, model.settings.buckets)
        value = np.add.reduceat(model.weight[ids], starts[:-1]) / np.diff(starts)
        part, owner = passages(doc, model.settings.passage_words)
        logit = np.bincount(part, weights=value[word]) / np.bincount(part)
        top = worst_passages(owner, logit, model.settings.worst)
        total = np.bincount(owner[top], weights=logit[top], minlength=n)
        count = np.bincount(owner[top], minlength=n)
    return _sigmoid(total / np.maximum(count, 1) + model.bias)


def fit(texts: pa.Array | list[str | None], toxic: np.ndarray, settings: Settings = Settings()) -> Model:
    """Joint training of embeddings and softmax on labelled texts."""
    toxic = np.asarray(toxic, dtype=np.int64)
    flat = np.zeros(settings.buckets)
    share = float(toxic.mean()) if len(toxic) else 0.0
    if share in (0.0, 1.0):
        return Model(flat, 500.0 if share else -500.0, settings)
    rng = np.random.default_rng(settings.seed)
    doc, word, forms = split_words(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
    ids, starts = subwords(forms, settings.buckets)
    part, owner = passages(doc, settings.passage_words)
    doc, word, part = (x.astype(np.int32) for x in (doc, word, part))
    pa.default_memory_pool().release_unused()
    if not len(owner):
        return Model(flat, float(np.log(share / (1 - share))), settings)
    at = np.concatenate([[0], np.cumsum(np.bincount(part))])
    size = np.diff(starts)
    emb = rng.normal(0, 0.1, (settings.buckets, settings.dim)).astype(np.float32)
    out = rng.normal(0, 0.1, (settings.dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    m_e, v_e = np.zeros_like(emb), np.zeros_like(emb)
    m_o, v_o, m_b, v_b = np.zeros_like(out), np.zeros_like(out), np.zeros(2, np.float32), np.zeros(2, np.float32)
    step = 0

    def linear() -> tuple[np.ndarray, float]:
        return (emb @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0])

    def picked(epoch: int) -> np.ndarray:
        """The worst passage of each document; of toxic ones all in the first epoch, when nothing is known; of others some more."""
        if epoch == 0:
            return rng.permutation(len(owner))
        w, _ = linear()
        value = np.add.reduceat(w[ids], starts[:-1]) / size
        logit = np.bincount(part, weights=value[word]) / np.diff(at)
        worst = worst_passages(owner, logit, settings.worst)
        others = np.flatnonzero(toxic[owner] == 0)
        more = rng.choice(others, min(len(others), 2 * len(worst)), replace=False) if len(others) else others
        return rng.permutation(np.concatenate([worst, more]))

    for epoch in range(settings.epochs):
        chosen = picked(epoch)
        label = toxic[owner[chosen]]
        weight = np.where(label == 1, settings.toxic_weight, 1.0)
        for b in range(0, len(chosen), settings.batch):
            rows = chosen[b : b + settings.batch]
            n_words = at[rows + 1] - at[rows]
            pos = np.repeat(at[rows] - np.concatenate([[0], np.cumsum(n_words)[:-1]]), n_words) + np.arange(n_words.sum())
            used, inverse = np.unique(word[pos], return_inverse=True)
            n_sub = size[used]
            sub = np.repeat(starts[used] - np.concatenate([[0], np.cumsum(n_sub)[:-1]]), n_sub) + np.arange(n_sub.sum())
            grams = ids[sub]
            vec = np.add.reduceat(emb[grams], np.concatenate([[0], np.cumsum(n_sub)[:-1]])) / n_sub[:, None]
            bag = np.add.reduceat(vec[inverse], np.concatenate([[0], np.cumsum(n_words)[:-1]])) / n_words[:, None]
            z = bag @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), label[b : b + len(rows)]] -= 1
            p *= weight[b : b + len(rows), None] / len(rows)
            d_bag = (p @ out.T) / n_words[:, None]
            d_word = np.repeat(d_bag, n_words, axis=0)
            d_vec = np.stack([np.bincount(inverse, weights=d_word[:, k], minlength=len(used)) for k in range(settings.dim)], 1) / n_sub[:, None]
            touched, where = np.unique(grams, return_inverse=True)
            d_sub = np.repeat(d_vec, n_sub, axis=0)
            grad = np.stack([np.bincount(where, weights=d_sub[:, k], minlength=len(touched)) for k in range(settings.dim)], 1).astype(np.float32)
            step += 1
            c1, c2 = 1 - 0.9**step, 1 - 0.999**step
            for x, m, v, g, sel in ((emb, m_e, v_e, grad, touched), (out, m_o, v_o, bag.T.astype(np.float32) @ p.astype(np.float32), slice(None)), (bias, m_b, v_b, p.sum(0).astype(np.float32), slice(None))):
                m[sel] = 0.9 * m[sel] + 0.1 * g
                v[sel] = 0.999 * v[sel] + 0.001 * g * g
                x[sel] -= settings.rate * (m[sel] / c1) / (np.sqrt(v[sel] / c2) + 1e-8)
    w, b0 = linear()
    return Model(w, b0, settings)


def is_held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _pieces(text: Column, length: Column, most: Column) -> Column:
    """At most ``most`` characters of a longer text, in pieces spread evenly over it."""
    k = F.greatest(F.lit(1), F.least(F.lit(16), F.floor(most / 200))).cast("int")
    size = F.floor(most / k).cast("int") - 1
    starts = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.floor(i * (length - size) / F.greatest(k - 1, F.lit(1))).cast("int") + 1)
    return F.array_join(F.transform(starts, lambda at: F.substring(text, at, size)), " ")


def training_rows(docs: DataFrame, labels: DataFrame, settings: Settings, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[pa.Array, np.ndarray]:
    """A bounded sample of labelled texts: the first ``per_class`` ids of each class in hash order, of which the longest are shortened so that all fit into ``train_chars``."""
    usable = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_toxic")).filter(F.col("_id").isNotNull() & F.col("_toxic").isin(0, 1) & ~is_held_out(F.col("_id")))
    usable = usable.groupBy("_id").agg(F.max("_toxic").alias("_toxic")).withColumn("_h", F.xxhash64("_id", F.lit(settings.seed)))
    picked = None
    for c in (0, 1):
        part = usable.filter(F.col("_toxic") == c).orderBy("_h", "_id").limit(settings.per_class)
        picked = part if picked is None else picked.unionByName(part)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(picked), "_id")  # at most 2 * per_class ids
    rows = rows.withColumn("_first", F.row_number().over(Window.partitionBy("_id").orderBy("_text"))).filter("_first = 1")
    # the common length: the largest fair share that any text, from the shortest on, finds left
    by_length = Window.partitionBy("_toxic").orderBy("_n", "_h", "_id")
    rows = rows.withColumn("_n", F.coalesce(F.length("_text"), F.lit(0))).withColumn("_left", settings.train_chars // 2 - F.sum("_n").over(by_length) + F.col("_n"))
    rows = rows.withColumn("_share", F.col("_left") / (F.count("*").over(Window.partitionBy("_toxic")) - F.row_number().over(by_length) + 1))
    rows = rows.withColumn("_most", F.floor(F.max("_share").over(Window.partitionBy("_toxic"))).cast("int")).withColumn("_text", F.when(F.col("_n") > F.col("_most"), _pieces(F.col("_text"), F.col("_n"), F.col("_most"))).otherwise(F.col("_text")))
    got = rows.select("_h", "_id", "_text", "_toxic").toArrow()  # bounded by train_chars
    got = got.take(pc.sort_indices(got, [("_h", "ascending"), ("_id", "ascending")]))
    return got["_text"].cast(pa.large_string()).combine_chunks(), got["_toxic"].to_numpy().astype(np.int64)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every document, one row each."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # one number per bucket: bounded by Settings

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_texts(batch.column(1), sent.value))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, "doc_id long, score double")


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    model = fit(*training_rows(docs, labels, settings), settings)
    give_back(docs.sparkSession)
    return model


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents scored below the threshold, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(score_texts(batch.column(at), sent.value) < threshold))

    return docs.mapInArrow(run, docs.schema)
