"""Language-model scores by stupid backoff, computed relationally.

Method: every text is exploded into its words with the two before each (u, v, w).  These
rows are partitioned by a hash of the middle word v: that partition has every occurrence
of v, so it counts the n-grams (u v w), (u v), (v w) and v itself and joins its rows with
these counts; results are summed per document.  A word is scored by the highest order
that occurs outside the document, and by ``alpha`` less for each order given up.  A
document's own occurrences are left out of all counts, so that it does not vouch for
itself.

    seen elsewhere:  (c(u v w) - own) / max(c(u v) - own, c(u v w) - own)
    else:            alpha   * (c(v w) - own) / max(c(v) - own, c(v w) - own)
    else:            alpha^2 * max(c(w) - own, 1/2) / max(N - own, 1)

c(u v) and c(v) count what a word follows; own counts the n-gram of the numerator, in the
last line (v w).  The second word of a text begins at the second line, without alpha; the
first one at the third, with alpha once.

Scale: all counts are taken over the whole corpus and grow with it.  One pass counts
words by ``screen`` hash classes, one counts exactly the words in the classes that hold
1/``hot`` of all words or more; words with such a share (at most ``hot``) are known to all
tasks, and rows with one in the middle are partitioned by (v, w), others by v alone.  So
no partition holds more than its part and 1/``hot`` of all rows.  For a hot v the counts
c(u v) lie in other partitions; those go as rows of a pair table, partitioned by the
pair's hash and combined before the shuffle, and are asked for there where (u v w) was
seen elsewhere.  Counts of all words that aren't frequent are a table partitioned by the
word's hash, combined before the shuffle by task; the words of rows that back off to the
last line ask there.  Rows travel packed: for a slice of documents and a partition the
middle words in runs, the others as 16-bit numbers in a list of frequent words (the rest
as 48-bit ids), and the place of the document, some 8 bytes a word, and are shuffled
once.  The list is drawn from a sample of each task and changes no score; its words'
counts are exact and known to all tasks.  A slice
has at most 32,768 texts.  Where there are more partitions than a slice has words (beyond
some TB) a packed row holds few words and costs what a plain row does.  What is sent to
all tasks is bounded by ``screen``, ``hot`` and ``frequent``, the last two less than 65,535
together.

Cases: words are compared in lower case and by 48-bit hashes; a null text or one
without words has 0 words and a null score; texts of any length are read whole;
repeated rows are documents of their own and vouch for each other; null ids are kept;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import checkpoint, text_slices
from quillon.llm.shingles import mix, word_hashes

_ID = np.uint64((1 << 48) - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Slices of a task that its frequent words are drawn from, and rare words that a task counts before it sends them on.
SAMPLE, HELD = 4, 1 << 20
#: A partition's rows are scored in so many parts, one after another.
CHUNKS = 4


@dataclass(frozen=True)
class Settings:
    alpha: float = 0.4
    screen: int = 1 << 16
    hot: int = 4096
    frequent: int = 61_000
    words_per_partition: int = 2_000_000
    slice_bytes: int = 8 << 20


@dataclass(frozen=True)
class Shares:
    """What every task knows: words in all; the hot words (sorted) and how often a word follows them; the frequent words (sorted), the hot among them, and their counts."""

    total: int
    hot: np.ndarray
    hot_firsts: np.ndarray
    frequent: np.ndarray
    counts: np.ndarray


def word_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of words of each text, 48-bit ids from 1 on); 0 stands before the first word."""
    n, h = word_hashes(pc.utf8_lower(pc.fill_null(texts, "")))
    return n, np.maximum(mix(h) & _ID, np.uint64(1))


def pack6(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack6(b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = b.reshape(-1, 6)
    return out.view("<u8").ravel().astype(np.uint64)


def pack_words(x: np.ndarray, frequent: np.ndarray) -> bytes:
    """Numbers in the list of frequent words, and the ids of the others one after another."""
    known, at = find(x, frequent)
    return np.where(known, at, 0xFFFF).astype("<u2").tobytes() + pack6(x[~known])


def unpack_words(data: np.ndarray, n: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n words, what comes behind them)."""
    code = np.frombuffer(data[: 2 * n].tobytes(), "<u2")
    other = code == 0xFFFF
    out = frequent[np.where(other, 0, code)]
    end = 2 * n + 6 * int(other.sum())
    out[other] = unpack6(data[2 * n : end])
    return out, data[end:]


def pack_rows(u: np.ndarray, v: np.ndarray, w: np.ndarray, doc: np.ndarray, frequent: np.ndarray) -> bytes:
    """Runs of equal v (a run of more than 255 is several), then u, w and doc in that order."""
    order = np.argsort(v, kind="stable")
    u, v, w, doc = u[order], v[order], w[order], doc[order]
    place = np.arange(len(v)) - np.repeat(starts := np.flatnonzero(np.diff(v, prepend=v[:1] ^ np.uint64(1))), np.diff(np.append(starts, len(v))))
    begins = np.flatnonzero(place % 255 == 0)
    runs = np.diff(np.append(begins, len(v))).astype(np.uint8)
    flat = pack_words(v[begins], frequent) + runs.tobytes() + pack_words(u, frequent) + pack_words(w, frequent) + doc.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()
    return np.array([len(v), len(begins), len(flat)], "<u4").tobytes() + pa.Codec("zstd", compression_level=1).compress(flat, asbytes=True)


def unpack_rows(data: bytes, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, r, size = (int(x) for x in np.frombuffer(data, "<u4", 3))
    flat = pa.Codec("zstd").decompress(memoryview(data)[12:], size, asbytes=True)
    first, rest = unpack_words(np.frombuffer(flat, np.uint8), r, frequent)
    v = np.repeat(first, rest[:r])
    u, rest = unpack_words(rest[r:], n, frequent)
    w, rest = unpack_words(rest, n, frequent)
    return u, v, w, np.frombuffer(rest.reshape(2, -1).T.tobytes(), "<u2").astype(np.int64)


def pack_counts(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Keys, counts in a byte each, and those of 255 and more behind."""
    return np.array([len(keys)], "<u4").tobytes() + pack6(keys) + np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def unpack_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    counts = np.frombuffer(data, np.uint8, n, 4 + 6 * n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data[4 + 7 * n :], "<i8")
    return unpack6(np.frombuffer(data, np.uint8, 6 * n, 4)), counts


def total_counts(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, sums of their counts) over tables."""
    keys, at = np.unique(np.concatenate([np.empty(0, np.uint64), *(f[0] for f in found)]), return_inverse=True)
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, at, np.concatenate([np.empty(0, np.int64), *(f[1] for f in found)]))
    return keys, counts


def pack_asked(key: np.ndarray, slices: np.ndarray, doc: np.ndarray, *numbers: np.ndarray) -> bytes:
    """Runs of equal slices (sorted), then keys and docs, then of each number, mostly 1, the few others."""
    begins = np.flatnonzero(np.diff(slices, prepend=slices[:1] ^ 1))
    out = np.array([len(key), len(begins)], "<u4").tobytes() + slices[begins].astype("<i8").tobytes() + np.diff(np.append(begins, len(key))).astype("<u4").tobytes() + pack6(key) + doc.astype("<u2").tobytes()
    for x in numbers:
        many = np.flatnonzero(x != 1)
        out += np.array([len(many)], "<u4").tobytes() + many.astype("<u4").tobytes() + x[many].astype("<u4").tobytes()
    return out


def unpack_asked(data: bytes, numbers: int) -> tuple[np.ndarray, ...]:
    n, r = (int(x) for x in np.frombuffer(data, "<u4", 2))
    slices = np.repeat(np.frombuffer(data, "<i8", r, 8), np.frombuffer(data, "<u4", r, 8 + 8 * r))
    at = 8 + 12 * r
    out = [unpack6(np.frombuffer(data, np.uint8, 6 * n, at)), slices, np.frombuffer(data, "<u2", n, at + 6 * n).astype(np.int64)]
    at += 8 * n
    for _ in range(numbers):
        m = int(np.frombuffer(data, "<u4", 1, at)[0])
        x = np.ones(n, np.int64)
        x[np.frombuffer(data, "<u4", m, at + 4)] = np.frombuffer(data, "<u4", m, at + 4 + 4 * m)
        out.append(x)
        at += 4 + 8 * m
    return tuple(out)


def pack_sums(slices: np.ndarray, docs: np.ndarray, sums: np.ndarray) -> list[bytes]:
    """For each slice its documents and their sums; a document is (rank of its slice << 16) + place, and sorted."""
    at = np.searchsorted(docs >> 16, np.arange(len(slices) + 1))
    return [np.array([b - a], "<u4").tobytes() + (docs[a:b] & 0xFFFF).astype("<u2").tobytes() + sums[a:b].astype("<f8").tobytes() for a, b in zip(at[:-1], at[1:])]


def add_sums(total: np.ndarray, data: bytes) -> None:
    k = int(np.frombuffer(data, "<u4", 1)[0])
    total[np.frombuffer(data, "<u2", k, 4)] += np.frombuffer(data, "<f8", k, 4 + 2 * k)


def screened(texts: DataFrame, settings: Settings, word_ids: Callable = word_ids) -> tuple[np.ndarray, np.ndarray]:
    """One pass: (words in each screen class, frequent words of a sample, sorted)."""
    screen = settings.screen

    def by_class(batches):
        held, drawn = np.zeros(screen, np.int64), []
        for batch in batches:
            for t in text_slices(batch.column(0)):
                w = word_ids(t)[1]
                held += np.bincount((w % np.uint64(screen)).astype(np.int64), minlength=screen)
                if len(drawn) < SAMPLE:
                    drawn.append(w)
        at = np.flatnonzero(held)
        words, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *drawn]), return_counts=True)
        most = np.argsort(-counts, kind="stable")[: 0xFFFF]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(at) + len(most)) >= len(at)), pa.array(np.concatenate([at, words[most].astype(np.int64)])), pa.array(np.concatenate([held[at], counts[most]]))], names=["word", "k", "c"])

    sums = checkpoint(texts.mapInArrow(by_class, "word boolean, k long, c long").groupBy("word", "k").agg(F.sum("c").alias("c")))
    by_screen = sums.filter("NOT word").select("k", "c").toArrow()  # at most ``screen`` rows
    drawn = sums.filter("word").agg(F.sum("c")).first()[0] or 0
    often = sums.filter(F.col("word") & (F.col("c") * (1 << 20) >= drawn)).select("k", "c").toArrow()  # at most 2^20 rows, as all counts add up to ``drawn``
    most = np.lexsort((often["k"].to_numpy(), -often["c"].to_numpy()))[: settings.frequent]
    table = np.zeros(screen, np.int64)
    table[by_screen["k"].to_numpy()] = by_screen["c"].to_numpy()
    return table, np.sort(often["k"].to_numpy()[most]).astype(np.uint64)


def shares(texts: DataFrame, settings: Settings) -> Shares:
    """Two passes: counts by screen class, and frequent words of a sample; then exact counts of those and of the words of the fullest classes."""
    spark, screen = texts.sparkSession, settings.screen

    def class_of(w: np.ndarray) -> np.ndarray:
        return (w % np.uint64(screen)).astype(np.int64)

    table, often = screened(texts, settings)
    total = int(table.sum())
    least = max(1, total // settings.hot)
    sent = spark.sparkContext.broadcast((table >= least, often))

    def exactly(batches):
        full, frequent = sent.value
        every = np.zeros(len(frequent), np.int64)

        def rows(hot: bool, k: np.ndarray, firsts: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(k), hot)), *[pa.array(x.astype(np.int64)) for x in (k, firsts, c)]], names=["hot", "k", "firsts", "c"])

        for batch in batches:
            for t in text_slices(batch.column(0), settings.slice_bytes):
                n, w = word_ids(t)
                last = np.zeros(len(w), bool)
                last[(np.cumsum(n) - 1)[n > 0]] = True  # nothing follows the last word of a text
                known, at = find(w, frequent)
                every += np.bincount(at[known], minlength=len(frequent))
                into = full[class_of(w)]
                u, at, c = np.unique(w[into], return_inverse=True, return_counts=True)
                yield rows(True, u, np.bincount(at[~last[into]], minlength=len(u)), c)
        yield rows(False, frequent, np.zeros(len(frequent)), every)

    counted = checkpoint(texts.mapInArrow(exactly, "hot boolean, k long, firsts long, c long").groupBy("hot", "k").agg(F.sum("firsts").alias("firsts"), F.sum("c").alias("c")))
    hot = counted.filter(F.col("hot") & (F.col("c") >= least)).orderBy("k").toArrow()  # at most ``hot`` rows, as all counts add up to the total
    rest = counted.filter("NOT hot").toArrow()
    k, c = (np.concatenate([[0], hot[x].to_numpy(), rest[x].to_numpy()]) for x in ("k", "c"))  # 0 stands before a text
    frequent, at = np.unique(k.astype(np.uint64), return_index=True)
    return Shares(total, hot["k"].to_numpy().astype(np.uint64), hot["firsts"].to_numpy(), frequent, c[at])


def find(x: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each is among the sorted ones, where)."""
    if not len(among):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(among, x), len(among) - 1)
    return among[at] == x, at


def pair_ids(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """48-bit ids of pairs."""
    with np.errstate(over="ignore"):
        return mix(mix(v + np.uint64(11)) + w * _STEP) & _ID


@dataclass
class Scored:
    """Of rows of one partition: what documents have so far; what is to be asked for; counts of pairs that others ask for."""

    sums: np.ndarray
    words: tuple[np.ndarray, np.ndarray, np.ndarray]  # key, document, occurrences
    pairs: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # id, document, occurrences, occurrences elsewhere
    counts: tuple[np.ndarray, np.ndarray]  # ids of pairs, and how often they go on


def score_rows(u: np.ndarray, v: np.ndarray, w: np.ndarray, doc: np.ndarray, n_docs: int, last: np.ndarray, s: Shares, settings: Settings) -> Scored:
    """Scores of all rows of some middle words; doc: which of n_docs documents, last: whether a row's word ends its text."""
    log_alpha = np.log(settings.alpha)
    with np.errstate(over="ignore"):
        pair_name = mix(mix(v) + w * _STEP)
        before = mix(u + np.uint64(7))
        pair, triple, context = (np.unique(x, return_inverse=True)[1].astype(np.int32) for x in (pair_name, mix(pair_name + before), mix(mix(v) + before)))
        del pair_name, before
    firsts, first = np.unique(v, return_inverse=True)
    pair_total, triple_total, context_total, first_total = (np.bincount(x) for x in (pair, triple, context, first))
    hot_first, at = find(firsts, s.hot)
    first_total[hot_first] = s.hot_firsts[at[hot_first]] if hot_first.any() else 0

    # (v w) of a document: those that nobody else has fall to the last line
    _, one, of, own = np.unique(pair.astype(np.int64) * n_docs + doc, return_index=True, return_inverse=True, return_counts=True)
    elsewhere = np.where(v[one] == 0, 0, pair_total[pair[one]] - own)
    steps = np.where(v[one] == 0, own, own + np.bincount(of, weights=u != 0, minlength=len(own)))  # orders given up, over all occurrences
    back = np.flatnonzero(elsewhere <= 0)
    value = steps[back] * log_alpha - own[back] * np.log(np.maximum(s.total - own[back], 1))
    key = w[one[back]]
    known, at = find(key, s.frequent)
    value[known] += own[back[known]] * np.log(np.maximum(s.counts[at[known]] - own[back[known]], 0.5))
    sums = np.bincount(doc[one[back]], weights=value, minlength=n_docs).astype(float)  # of integers over nothing
    ask = back[~known]
    words = key[~known], doc[one[ask]], own[ask]

    # (u v w) of a document, of the pairs that others have
    rest = np.flatnonzero(elsewhere[of] > 0)
    _, three, times = np.unique(triple[rest].astype(np.int64) * n_docs + doc[rest], return_index=True, return_counts=True)
    three = rest[three]
    seen = np.where(u[three] == 0, 0, triple_total[triple[three]] - times)
    high = seen > 0
    follows = context_total[context[three]]
    pair_seen, pair_own = elsewhere[of[three]], own[of[three]]
    with np.errstate(divide="ignore", invalid="ignore"):
        low_value = np.log(pair_seen / np.maximum(first_total[first[three]] - pair_own, pair_seen)) + np.where(u[three] == 0, 0.0, log_alpha)
        here = np.log(np.maximum(follows - times, seen))
        far = hot_first[first[three]]  # whose (u v) are counted elsewhere
        value = np.where(high, np.log(np.maximum(seen, 1)) - np.where(far, 0.0, here), low_value)
    sums += np.bincount(doc[three], weights=times * value, minlength=n_docs)
    wanted = three[high & far]
    pairs = pair_ids(u[wanted], v[wanted]), doc[wanted], times[high & far], seen[high & far]

    # pairs that end in a hot word, as others may ask how often they go on
    ends = find(w, s.hot)[0] & ~last & (v != 0)
    ids, n = np.unique(pair_ids(v[ends], w[ends]), return_counts=True)
    return Scored(sums, words, pairs, (ids[n > 1], n[n > 1]))


def score(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, log_score (sum), mean_log_score."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    known = shares(source.select("_text"), settings)
    parts = max(1, -(-known.total // settings.words_per_partition))
    sent = spark.sparkContext.broadcast(known)

    def runs(part: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(partition, its rows) of the partitions that have some: no more steps than rows, however many partitions there are."""
        starts = np.flatnonzero(np.diff(part[order], prepend=-1))
        for a, b in zip(starts, np.append(starts[1:], len(order))):
            yield int(part[order[a]]), order[a:b]

    def dealt(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The rows of each partition of the word table."""
        part = (mix(key + np.uint64(5)) % np.uint64(parts)).astype(np.int64)
        return runs(part, np.argsort(part, kind="stable"))

    def middle(v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What rows are dealt by: the middle word; with the last one where that is hot."""
        by = v.copy()
        both = find(v, sent.value.hot)[0] | (v == 0)
        with np.errstate(over="ignore"):
            by[both] = mix(v[both]) + w[both] * _STEP
        return by

    def explode(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, np.ndarray]] = []  # counts of rare words, not sent yet

        def batch_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "slice", "data"])

        def sent_on() -> list[tuple[int, int, bytes]]:
            keys, counts = total_counts(held)
            held.clear()
            return [(-1 - parts - k, number, pack_counts(keys[o], counts[o])) for k, o in dealt(keys)]

        for batch in batches:
            done = 0
            for texts in text_slices(batch.column(1), settings.slice_bytes, 1 << 15):
                ids = batch.column(0).slice(done, len(texts))
                done += len(texts)
                n, w = word_ids(texts)
                doc = np.repeat(np.arange(len(n)), n)
                begins = np.diff(doc, prepend=-1) != 0
                last = np.append(begins[1:], True)[: len(w)]
                v, u = np.zeros_like(w), np.zeros_like(w)
                v[1:] = w[:-1]
                v[begins] = 0
                u[1:] = v[:-1]
                u[begins] = 0
                part = (mix(middle(v, w) + np.uint64(3)) % np.uint64(parts)).astype(np.int64)
                place = doc | (last.astype(np.int64) << 15)
                rows = [(k, number, pack_rows(u[o], v[o], w[o], place[o], sent.value.frequent)) for k, o in runs(part, np.argsort(part, kind="stable"))]
                keys, counts = np.unique(w, return_counts=True)
                rare = ~find(keys, sent.value.frequent)[0]
                held.append((keys[rare], counts[rare]))
                if sum(len(k) for k, _ in held) > HELD:
                    rows += sent_on()
                null = np.array(ids.is_null())
                head = np.array([len(n)], "<u4").tobytes() + null.astype(np.uint8).tobytes() + pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype("<i8").tobytes() + n.astype("<i8").tobytes()
                rows.append((-1 - int(mix(np.array([number], np.uint64))[0] % np.uint64(parts)), number, head))  # who the documents of this slice are
                number += 1
                yield batch_of(rows)
        yield batch_of(sent_on())

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        """Heads and sums go on to their slice (-1 - slice), counts and what is asked for to a partition of the tables."""
        part = int(pdf["part"].iloc[0])
        if part < -parts:
            return pd.DataFrame({"to": [-part - 1 - parts], "slice": [0], "kind": ["count"], "data": [pack_counts(*total_counts([unpack_counts(d) for d in pdf["data"]]))]})
        if part < 0:
            return pd.DataFrame({"to": -1 - pdf["slice"], "slice": pdf["slice"], "kind": "head", "data": pdf["data"]})
        slices, rank = np.unique(pdf["slice"].to_numpy(), return_inverse=True)
        found = [unpack_rows(d, sent.value.frequent) for d in pdf["data"]]
        u, v, w = (np.concatenate([f[k] for f in found]) for k in range(3))
        doc = np.concatenate([(f[3] & 0x7FFF) + (int(r) << 16) for f, r in zip(found, rank)])
        last = np.concatenate([f[3] >> 15 for f in found]).astype(bool)
        del found
        docs_, doc = np.unique(doc, return_inverse=True)
        # a part of the middle words at a time, for small temporaries
        chunk = (mix(middle(v, w) + np.uint64(13)) % np.uint64(CHUNKS)).astype(np.int8)
        scored = [score_rows(u[o], v[o], w[o], doc[o], len(docs_), last[o], sent.value, settings) for o in (np.flatnonzero(chunk == k) for k in range(CHUNKS)) if len(o)]
        del u, v, w, doc, last, chunk
        got = Scored(sum(x.sums for x in scored), *(tuple(np.concatenate(y) for y in zip(*(getattr(x, name) for x in scored))) for name in ("words", "pairs", "counts")))
        del scored
        out = [(-1 - s, s, "sum", d) for s, d in zip(slices, pack_sums(slices, docs_, got.sums))]
        for kind, (key, asker, *numbers) in (("ask", got.words), ("pair ask", got.pairs)):
            by_doc = np.argsort(asker, kind="stable")
            key, asker, numbers = key[by_doc], docs_[asker[by_doc]], [x[by_doc] for x in numbers]
            out += [(k, 0, kind, pack_asked(key[o], slices[asker[o] >> 16], asker[o] & 0xFFFF, *[x[o] for x in numbers])) for k, o in dealt(key)]
        out += [(k, 0, "pair count", pack_counts(got.counts[0][o], got.counts[1][o])) for k, o in dealt(got.counts[0])]
        return pd.DataFrame(out, columns=["to", "slice", "kind", "data"])

    def look_up(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of a slice the sums so far; of a partition of the tables the terms of the words and pairs asked for."""
        of = {kind: pdf["data"][pdf["kind"] == kind] for kind in ("head", "sum", "count", "ask", "pair count", "pair ask")}
        if pdf["to"].iloc[0] < 0:
            total = np.zeros(int(np.frombuffer(of["head"].iloc[0], "<u4", 1)[0]))
            for data in of["sum"]:
                add_sums(total, data)
            number = pdf["slice"].iloc[0]
            return pd.DataFrame({"slice": number, "head": [True, False], "data": [of["head"].iloc[0], pack_sums(np.array([number]), np.arange(len(total)), total)[0]]})
        out = []
        for kind in ("", "pair "):
            if not len(of[kind + "ask"]):
                continue
            keys, counts = total_counts([unpack_counts(d) for d in of[kind + "count"]])
            found = [unpack_asked(d, 2 if kind else 1) for d in of[kind + "ask"]]
            key, asker, doc, own, *seen = (np.concatenate([f[k] for f in found]) for k in range(len(found[0])))
            del found
            count = counts[np.searchsorted(keys, key)] - own
            value = -own * np.log(np.maximum(count, seen[0])) if kind else own * np.log(np.maximum(count, 0.5))
            slices, rank = np.unique(asker, return_inverse=True)
            docs_, at = np.unique((rank.astype(np.int64) << 16) + doc, return_inverse=True)
            out += zip(slices, pack_sums(slices, docs_, np.bincount(at, weights=value, minlength=len(docs_))))
        return pd.DataFrame({"slice": [s for s, _ in out], "head": False, "data": [d for _, d in out]})

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf["data"][pdf["head"]].iloc[0]
        n = int(np.frombuffer(head, "<u4", 1)[0])
        null = np.frombuffer(head, np.uint8, n, 4).astype(bool)
        ids, n_words = np.frombuffer(head, "<i8", n, 4 + n), np.frombuffer(head, "<i8", n, 4 + 9 * n)
        total = np.zeros(n)
        for data in pdf["data"][~pdf["head"]]:
            add_sums(total, data)
        some = n_words > 0
        return pd.DataFrame({"doc_id": ids, "n_words": n_words, "log_score": np.where(some, total, np.nan), "_null": null, "_none": ~some})

    packed = source.mapInArrow(explode, "part long, slice long, data binary")
    joined = packed.groupBy("part").applyInPandas(join, "to long, slice long, kind string, data binary")
    sums = joined.groupBy("to").applyInPandas(look_up, "slice long, head boolean, data binary")
    out = sums.groupBy("slice").applyInPandas(gather, "doc_id long, n_words long, log_score double, _null boolean, _none boolean")
    score_ = F.when(~F.col("_none"), F.col("log_score"))
    return out.select(F.when(~F.col("_null"), F.col("doc_id")).alias("doc_id"), "n_words", score_.alias("log_score"), (score_ / F.col("n_words")).alias("mean_log_score"))
