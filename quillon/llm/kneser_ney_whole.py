"""Interpolated modified Kneser-Ney of order 3, counted over any number of texts and looked up for as many.

Method: as in ``kneser_ney``, without tables that anyone holds whole.  Every text is exploded into its words with the
two before each (u, v, w), which are partitioned by a hash of the middle word v, packed as in ``backoff``.  That
partition has every occurrence of v and so the counts of (u v w), how many different words stand before (v w), and
totals and discounted mass of the contexts (u v) and v.  What it lacks it asks for: before how many different words
each w stands (a table partitioned by w), and, where v is one of the words whose rows are partitioned by (v, w), as
they are many, the totals of (u v) and v, a table partitioned by their hash.  With the answers, each partition has all
that the probabilities of its rows are made of; their logarithms are summed by document.

First the rows of the texts to fit on are counted, which makes the tables.  Counts of counts, 12 numbers, and the counts
of the ``frequent`` words go to the driver and to all tasks.  Then all rows are scored, for one in ``rounds`` of the
partitions at a time: a round's rows are shuffled once and read twice, to ask and to be scored.

Scale: all tables grow with the texts and are partitioned by hash; partitions have some ``words_per_partition`` rows.
Words are counted in ``screen`` classes by their hash; those of a class that holds 1/``hot`` of all words (at most
``hot`` classes do) are dealt as many, so no partition holds more than its part and 1/``hot`` of all rows.
Packed rows take some 8 bytes a word.  Rows to fit on are shuffled all at once, so where most texts are these, that
shuffle is the largest; of the rows to score only a round's, for which texts are split again.  The shuffles of a step
are removed when its table is written.  What a round leaves is a sum for each document.

Cases: as in ``kneser_ney``; words are compared by 48-bit hashes; without texts to fit on every probability is 1.
As a later round may read documents in another order, their sums meet by id, language, number of words and a 64-bit hash
of the row; rows that are equal have one sum, and are as many as they were.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import backoff
from quillon.llm.backoff import find
from quillon.llm.common import delete, text_slices, written
from quillon.llm.shingles import mix

_ID = np.uint64((1 << 48) - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Stands for u in the name of v alone as a context; no word has this number.
_ALONE = np.uint64((1 << 64) - 1)
#: Which bytes part words, and the first bytes of a 64-bit number.
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_OTHER = 0xFFFF
_SLOTS = 1 << 20
ROUNDS = 4


def pack(*arrays) -> bytes:
    return pickle.dumps(arrays, 5)


def small(x: np.ndarray) -> np.ndarray:
    """Counts in as few bytes each as the largest needs."""
    return x.astype(np.min_scalar_type(x.max(initial=0)))


def word_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of words of each text, 48-bit ids from 1 on), in lower case; eight bytes of all words at a time are hashed."""
    texts = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], "<i8", len(texts) + 1, 8 * texts.offset)
    raw = np.zeros(at[-1] - at[0] + 8, np.uint8)
    if len(raw) > 8:
        raw[:-8] = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    full = ~_SPACE[raw]
    full[-8:] = False
    begins, ends = full.copy(), full.copy()
    begins[1:] &= ~full[:-1]
    ends[:-1] &= ~full[1:]
    begins[at[:-1]] = full[at[:-1]]  # texts part words too
    last = at[1:-1][at[1:-1] > 0] - 1
    ends[last] = full[last]
    start = np.flatnonzero(begins)
    size = np.flatnonzero(ends) + 1 - start
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
    with np.errstate(over="ignore"):
        h = mix(eight[start] & _FIRST[np.minimum(size, 8)]) + size.astype(np.uint64)
        done, more = 8, np.flatnonzero(size > 8)
        while len(more):
            h[more] = mix(h[more] * _STEP + (eight[start[more] + done] & _FIRST[np.minimum(size[more] - done, 8)]))
            done += 8
            more = more[size[more] > done]
    return np.diff(np.searchsorted(start, at)), np.maximum(mix(h) & _ID, np.uint64(1))


class Codes:
    """Numbers of frequent words, found by the last bits of their ids; of words that share these one has a number."""

    def __init__(self, frequent: np.ndarray) -> None:
        slot = (frequent % np.uint64(_SLOTS)).astype(np.int64)
        self.words = frequent[np.sort(np.unique(slot, return_index=True)[1])]
        self.at = np.zeros(_SLOTS, np.uint16)
        self.at[(self.words % np.uint64(_SLOTS)).astype(np.int64)] = np.arange(len(self.words))

    def of(self, x: np.ndarray) -> np.ndarray:
        code = self.at[(x & np.uint64(_SLOTS - 1)).astype(np.int64)]
        return np.where(self.words[code] == x, code, np.uint16(_OTHER))


def pack_rows(words: np.ndarray, codes: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, doc: np.ndarray) -> bytes:
    """What ``backoff.unpack_rows`` reads; u, v (equal ones together) and w are places in words and their codes."""

    def coded(at: np.ndarray) -> bytes:
        code = codes[at]
        return code.astype("<u2").tobytes() + backoff.pack6(words[at[code == _OTHER]])

    x = words[v]
    starts = np.flatnonzero(np.diff(x, prepend=x[:1] ^ np.uint64(1)))
    place = np.arange(len(v)) - np.repeat(starts, np.diff(np.append(starts, len(v))))
    begins = np.flatnonzero(place % 255 == 0)
    runs = np.diff(np.append(begins, len(v))).astype(np.uint8)
    flat = coded(v[begins]) + runs.tobytes() + coded(u) + coded(w) + doc.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()
    return np.array([len(v), len(begins), len(flat)], "<u4").tobytes() + pa.Codec("zstd", compression_level=1).compress(flat, asbytes=True)


def pair_names(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(v) + w * _STEP)


def context_names(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(v) + mix(u + np.uint64(7)))


def triple_names(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(pair_names(v, w) + mix(u + np.uint64(7)))


def is_many(v: np.ndarray, full: np.ndarray) -> np.ndarray:
    return full[(v % np.uint64(len(full))).astype(np.int64)]


def middle(v: np.ndarray, w: np.ndarray, full: np.ndarray) -> np.ndarray:
    """What rows are dealt by: the middle word; with the last one where there are many of it."""
    return np.where(is_many(v, full), pair_names(v, w), v)


def totals(keys: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, for each the sum of its counts and how many of them are 1, 2 and more)."""
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.stack([np.bincount(at, weights=x, minlength=len(keys)).astype(np.int64) for x in (c, c == 1, c == 2, c > 2)], 1).reshape(-1, 4)


def summed(found: list[tuple[np.ndarray, np.ndarray]], columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables of (keys, so many columns of counts) added up."""
    keys, at = np.unique(np.concatenate([np.empty(0, np.uint64), *(f[0] for f in found)]), return_inverse=True)
    x = np.concatenate([np.empty((0, columns), np.int64), *(f[1] for f in found)])
    return keys, np.stack([np.bincount(at, weights=x[:, k], minlength=len(keys)).astype(np.int64) for k in range(columns)], 1).reshape(-1, columns)


def looked_up(x: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values of keys (sorted), 0 where there are none."""
    known, at = find(x, keys)
    out = np.zeros((len(x), *values.shape[1:]), values.dtype)
    out[known] = values[at[known]]
    return out


def few(c: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, 3 and 4."""
    return np.array([(c == k).sum() for k in range(1, 5)], np.int64)


class Counts:
    """What rows of some middle words that are to be fitted on say: (u v w), (v w), contexts, first words, last words."""

    def __init__(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
        self.triples, one, self.c3 = np.unique(triple_names(u, v, w), return_index=True, return_counts=True)
        u, v, w = u[one], v[one], w[one]
        self.contexts, self.context_v = context_names(u, v), v
        self.pairs, one, self.c2 = np.unique(pair_names(v, w), return_index=True, return_counts=True)
        self.first, self.last = v[one], w[one]


def log_probabilities(u, v, w, counts: Counts, full: np.ndarray, contexts, c1: np.ndarray, model) -> np.ndarray:
    """Log probability of each w after u and v.  contexts: what was answered; c1: before how many words w stands; model: (discounts of orders 1 to 3, total, share of an unknown word)."""
    d, total, unknown = model
    if not total:
        return np.zeros(len(w))
    many = is_many(v, full)

    def step(c: np.ndarray, of: np.ndarray, near, d: list[float], below: np.ndarray) -> np.ndarray:
        """c: counts of the n-grams; of: names of their contexts; near: totals of those that lie here."""
        x = np.zeros((len(w), 2))
        for rows, (keys, values) in ((many, contexts), (~many, near)):
            x[rows] = looked_up(of[rows], keys, np.stack([values[:, 0], values[:, 1:] @ np.array(d)], 1))
        own = c - np.where(c > 0, np.array(d)[np.clip(c, 1, 3) - 1], 0)
        return np.where(x[:, 0] > 0, (own + x[:, 1] * below) / np.maximum(x[:, 0], 1), below)

    p = (c1 - np.where(c1 > 0, np.array(d[0])[np.clip(c1, 1, 3) - 1], 0)) / total + unknown
    p = step(looked_up(pair_names(v, w), counts.pairs, counts.c2), context_names(_ALONE, v), totals(context_names(_ALONE, counts.first), counts.c2), d[1], p)
    p = step(looked_up(triple_names(u, v, w), counts.triples, counts.c3), context_names(u, v), totals(counts.contexts, counts.c3), d[2], p)
    return np.log(p)


def score(source: DataFrame, marked: DataFrame, discounts: Callable[[list[int]], list[float]], settings: backoff.Settings = backoff.Settings(), rounds: int = ROUNDS) -> DataFrame:
    """doc_id, _lang, _value (log perplexity, NaN without words), _words of ``marked`` (doc_id, _lang, _text, _fit); source: its texts alone."""
    spark = source.sparkSession
    by_class, frequent = backoff.screened(source, settings, word_ids)
    whole = int(by_class.sum())
    parts = max(1, -(-whole // settings.words_per_partition))
    rounds = min(rounds, parts)
    full = by_class >= max(1, whole // settings.hot)
    full[0] = True  # 0 stands before a text
    sent = spark.sparkContext.broadcast((Codes(np.union1d(frequent, np.zeros(1, np.uint64))), full))  # bounded by Settings

    def runs(part: np.ndarray, order: np.ndarray):
        """(partition, its rows) of each partition that has some."""
        starts = np.flatnonzero(np.diff(part[order], prepend=-1))
        return [(int(part[order[a]]), order[a:b]) for a, b in zip(starts, np.append(starts[1:], len(order)))]

    def part_of(keys: np.ndarray, salt: int) -> np.ndarray:
        return (mix(keys + np.uint64(salt)) % np.uint64(parts)).astype(np.int64)

    def dealt(keys: np.ndarray):
        """The rows of each partition of the tables."""
        part = part_of(keys, 5)
        return runs(part, np.argsort(part, kind="stable"))

    def explode(batches, turn: int | None):
        """Packed rows of a round's partitions, and who the documents of each slice are; without a round, rows of all and no documents."""
        from pyspark import TaskContext

        codes, full = sent.value
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            done = 0
            for texts in text_slices(batch.column("_text"), settings.slice_bytes, 1 << 15):
                n, w = word_ids(texts)
                doc = np.repeat(np.arange(len(n)), n)
                begins = np.diff(doc, prepend=-1) != 0
                words = np.concatenate([np.zeros(1, np.uint64), w])
                code = codes.of(words)
                # places in words of the two before each
                v = np.where(begins, 0, np.arange(len(w)))
                u = np.zeros_like(v)
                u[1:] = v[:-1]
                u[begins] = 0
                part = part_of(middle(words[v], w, full), 3)
                own = np.arange(len(w)) if turn is None else np.flatnonzero(part % rounds == turn)
                rare = code[v[own]] == _OTHER
                common, rest = own[~rare], own[rare]
                own = np.concatenate([common[np.argsort(code[v[common]], kind="stable")], rest[np.argsort(words[v[rest]], kind="stable")]])
                own = own[np.argsort(part[own].astype(np.min_scalar_type(parts)), kind="stable")]
                place = np.zeros_like(doc)
                if turn is not None:
                    ids, lang, fit, names = (batch.column(c).slice(done, len(texts)) for c in ("doc_id", "_lang", "_fit", "_name"))
                    place = doc | (np.repeat(fit.to_numpy(zero_copy_only=False).astype(np.int64), n) << 15)
                rows = [(k, number, pack_rows(words, code, u[o], v[o], o + 1, place[o])) for k, o in runs(part, own)]
                if turn is not None:
                    rows.append((-1 - number % parts, number, pack(n.astype(np.int64), ids.to_pylist(), lang.to_pylist(), names.to_numpy())))
                done += len(texts)
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["part", "slice", "data"])

    def rows_of(pdf: pd.DataFrame):
        """(slices, document as (rank of its slice << 16) + place, parts) of a partition; of a part of the middle words at a time u, v, w, which rows, fitted on."""
        pdf = pdf.sort_values("slice")
        found = [backoff.unpack_rows(d, sent.value[0].words) for d in pdf["data"]]
        u, v, w = (np.concatenate([f[k] for f in found]) for k in range(3))
        doc = np.concatenate([(f[3] & 0x7FFF) + (r << 16) for r, f in enumerate(found)])
        fit = np.concatenate([f[3] >> 15 for f in found]).astype(bool)
        del found
        chunk = (mix(middle(v, w, sent.value[1]) + np.uint64(13)) % np.uint64(backoff.CHUNKS)).astype(np.int8)
        return pdf["slice"].to_numpy(), doc, ((u[o], v[o], w[o], o, fit[o]) for o in (np.flatnonzero(chunk == k) for k in range(backoff.CHUNKS)))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        """Counts that tables are made of, of a partition of rows to fit on."""
        full, low, words, contexts = sent.value[1], np.zeros((2, 4), np.int64), [], []
        for u, v, w, _, _ in rows_of(pdf)[2]:
            c = Counts(u, v, w)
            low += np.stack([few(c.c2), few(c.c3)])
            last, n = np.unique(c.last, return_counts=True)
            words.append((last, n[:, None]))
            far, first = is_many(c.context_v, full), is_many(c.first, full)
            contexts += [totals(c.contexts[far], c.c3[far]), totals(context_names(_ALONE, c.first[first]), c.c2[first])]
        out = [(int(pdf["part"].iloc[0]), "few", pack(low))]
        for kind, (keys, x) in (("word", summed(words, 1)), ("context", summed(contexts, 4))):
            out += [(k, kind, pack(keys[o], small(x[o]))) for k, o in dealt(keys)]
        return pd.DataFrame(out, columns=["to", "kind", "data"])

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        """A partition of the tables; for the driver (to -1) counts of counts and of frequent words."""
        of = {kind: [pickle.loads(d) for d in pdf["data"][pdf["kind"] == kind]] for kind in ("word", "context", "few")}
        words, c1 = summed(of["word"], 1)
        contexts = summed(of["context"], 4)
        low, c1 = np.zeros((3, 4), np.int64), c1[:, 0]
        low[0] = few(c1)
        low[1:] += sum((x for (x,) in of["few"]), np.zeros((2, 4), np.int64))
        code = sent.value[0].of(words)
        rare = code == _OTHER
        known = pack(low, np.array([c1.sum(), len(c1), (c1 > 2).sum()], np.int64), code[~rare], c1[~rare])
        return pd.DataFrame({"to": [int(pdf["to"].iloc[0]), -1], "data": [pack(words[rare], small(c1[rare]), contexts[0], small(contexts[1])), known]})

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        """What a partition of rows asks the tables for."""
        part, out, asked = int(pdf["part"].iloc[0]), [], []
        if part >= 0:
            codes, full = sent.value
            for u, v, w, _, _ in rows_of(pdf)[2]:
                far = is_many(v, full)
                asked.append((np.unique(w[codes.of(w) == _OTHER]), np.unique(np.concatenate([context_names(u[far], v[far]), context_names(_ALONE, np.unique(v[far]))]))))
            for kind, keys in zip(("word", "context"), (np.unique(np.concatenate(x)) for x in zip(*asked))):
                out += [(k, part, kind, pack(keys[o])) for k, o in dealt(keys)]
        return pd.DataFrame(out, columns=["to", "part", "kind", "data"])

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Of a partition of the tables what was asked for and is there."""
        out = []
        if len(left) and len(right):
            words, c1, contexts, of = pickle.loads(right["data"].iloc[0])
            for kind, keys, values in (("word", words, c1), ("context", contexts, of)):
                mine = left[left["kind"] == kind]
                for part, (asked,) in zip(mine["part"], map(pickle.loads, mine["data"])):
                    known, at = find(asked, keys)
                    if known.any():
                        out.append((part, kind, pack(asked[known], small(values[at[known]]))))
        return pd.DataFrame(out, columns=["part", "kind", "data"])

    def kept(rows: DataFrame, name: str) -> tuple[DataFrame, str]:
        """The rows as a table; the shuffles that made it are removed at its end, not when the driver collects its garbage."""
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = spark.conf.get(key, None)
        spark.conf.set(key, "true")
        try:
            return written(rows, name)
        finally:
            if before is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, before)

    packed = "part long, slice long, data binary"
    counted = marked.filter("_fit").select("_text").mapInArrow(functools.partial(explode, turn=None), packed).groupBy("part").applyInPandas(count, "to long, kind string, data binary")
    tables, tables_at = kept(counted.groupBy("to").applyInPandas(table, "to long, data binary"), "counts")
    got = [pickle.loads(r["data"]) for r in tables.filter("to = -1").collect()]  # a few numbers a partition, and frequent words once
    low, more = sum((g[0] for g in got), np.zeros((3, 4), np.int64)), sum((g[1] for g in got), np.zeros(3, np.int64))
    known = np.zeros(len(sent.value[0].words), np.int64)
    for _, _, code, c1 in got:
        known[code] = c1
    d = [discounts([int(x) for x in few_]) for few_ in low]
    mass = d[0][0] * low[0, 0] + d[0][1] * low[0, 1] + d[0][2] * more[2]
    total = int(more[0])
    sent_model = spark.sparkContext.broadcast(((d, total, mass / total / (int(more[1]) + 1) if total else 1.0), known))

    def evaluate(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Sums of log probabilities by slice and document; who the documents are passes."""
        if not len(left):
            return pd.DataFrame({"slice": [], "part": [], "data": []})
        part = int(left["part"].iloc[0])
        if part < 0:
            return left[["slice", "part", "data"]]
        (codes, full), (model, frequent) = sent.value, sent_model.value

        def answered(kind: str, *width: int) -> tuple[np.ndarray, np.ndarray]:
            found = [pickle.loads(x) for x in right["data"][right["kind"] == kind]]
            keys, values = np.concatenate([np.empty(0, np.uint64), *(f[0] for f in found)]), np.concatenate([np.empty((0, *width), np.int64), *(f[1] for f in found)])
            order = np.argsort(keys)
            return keys[order], values[order]

        words, contexts = answered("word"), answered("context", 4)
        slices, doc, chunks = rows_of(left)
        docs, at = np.unique(doc, return_inverse=True)
        sums = np.zeros(len(docs))
        for u, v, w, o, fit in chunks:
            code = codes.of(w)
            rare = code == _OTHER
            c1 = frequent[np.where(rare, 0, code)]
            c1[rare] = looked_up(w[rare], *words)
            sums += np.bincount(at[o], weights=log_probabilities(u, v, w, Counts(u[fit], v[fit], w[fit]), full, contexts, c1, model), minlength=len(docs))
        return pd.DataFrame({"slice": slices, "part": part, "data": backoff.pack_sums(slices, docs, sums)})

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")  # in the same order each time: the head first
        n, ids, lang, names = pickle.loads(pdf["data"].iloc[0])
        total = np.zeros(len(n))
        for data in pdf["data"].iloc[1:]:
            backoff.add_sums(total, data)
        return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "_lang": lang, "_words": n, "_name": names, "_sum": total})

    named = marked.select("doc_id", "_lang", "_text", "_fit", F.xxhash64("doc_id", "_lang", "_text", *[F.col(c).isNull() for c in ("doc_id", "_lang", "_text")]).alias("_name"))

    def scored(turn: int) -> DataFrame:
        """Sums over the partitions of a round; its rows are one shuffle, which Spark reads again for the second use."""
        rows = named.mapInArrow(functools.partial(explode, turn=turn), packed)
        asked = rows.groupBy("part").applyInPandas(ask, "to long, part long, kind string, data binary")
        answers = asked.groupBy("to").cogroup(tables.filter("to >= 0").groupBy("to")).applyInPandas(answer, "part long, kind string, data binary")
        sums = rows.groupBy("part").cogroup(answers.groupBy("part")).applyInPandas(evaluate, "slice long, part long, data binary")
        return kept(sums.groupBy("slice").applyInPandas(gather, "doc_id long, _lang string, _words long, _name long, _sum double"), "sums")[0]

    sums = functools.reduce(DataFrame.unionAll, [scored(k).withColumn("_turn", F.lit(k)) for k in range(rounds)])
    delete(spark, tables_at)
    per = sums.groupBy("doc_id", "_lang", "_words", "_name").agg(F.sum((F.col("_turn") == 0).cast("int")).cast("int").alias("_times"), *[F.max(F.when(F.col("_turn") == k, F.col("_sum"))).alias(f"_sum{k}") for k in range(rounds)])
    total = " + ".join(f"_sum{k}" for k in range(rounds))
    return per.select("doc_id", "_lang", F.expr(f"CASE WHEN _words = 0 THEN double('NaN') ELSE -({total}) / _words END").alias("_value"), "_words", F.expr("explode(array_repeat(0, _times))")).drop("col")
