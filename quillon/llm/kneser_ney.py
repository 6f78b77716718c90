"""Quality by perplexity under a Kneser-Ney model of trusted text.

Method: interpolated modified Kneser-Ney.  Words of trusted documents (lower case, with
start marks) are counted up to ``order``; the highest order uses its counts, lower ones
the number of different words seen before an n-gram; three discounts per order come from
the counts of counts.  Counts live in tables partitioned by the hash of their n-gram, and
all that a probability is made of is joined there: continuation counts by suffix, totals
and discounted mass by context, the lower order by suffix.  The tables of probabilities
and back-off weights are then cut into shards by the hash's top bits; a document's
n-grams are joined with them shard by shard and give its perplexity per word.  Documents
above the ``quantile`` of the perplexities of trusted documents of their language and
length are rejected: a language's trusted documents are cut by length into up to
``lengths`` classes of equal size, ``least`` documents at least, as the mean over few words
varies more than that over many.

Scale: ``classify`` without settings, as the query calls it, fits on all trusted documents
but the held fifth and looks up in partitioned tables (``kneser_ney_whole``).  A model to be
kept as arrays, or settings that are given, is fitted on at most ``per_language`` labelled documents of each of
at most ``languages`` languages (those with most trusted documents) and ``train_words``
words in all, of which each language has its own share: bounded by these parameters,
and so are its tables (at most ``order`` rows a word), whose shards go to all executors,
so that documents are scored in one pass over whole texts without a shuffle.  A text
that its language's share has no room for is left out alone.  Quantiles are taken over
all trusted documents that the model was not fitted on (a fifth of them never is), by
mergeable sketches with a rank error of 1/10,000; at most ``lengths`` numbers per language
are sent to the driver.

Cases: a null text or one without words has no perplexity and is not kept; unknown
words get the uniform share of the lowest order; a null language is a language of its
own; a language without trusted documents is judged by the quantiles over all; without
any trusted document nothing is rejected; ties with the threshold are kept; texts of
any length are read whole; repeated rows are scored each; an id labelled more than once
is trusted if any label says so; an empty table gives no rows; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import kneser_ney_whole
from quillon.llm.common import checkpoint, give_back, text_slices
from quillon.llm.membership import marked
from quillon.llm.shingles import mix, word_hashes

_START = np.uint64(0x5354415254)
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    order: int = 3
    per_language: int = 1000
    languages: int = 64
    train_words: int = 1_000_000
    quantile: float = 0.99
    lengths: int = 10
    least: int = 100
    shards: int = 16


@dataclass(frozen=True)
class Table:
    """One order: sorted n-gram hashes with log probability and log back-off weight, by shard of the hash's top bits."""

    shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    bits: int

    @staticmethod
    def build(keys: np.ndarray, prob: np.ndarray, back: np.ndarray, shards: int) -> Table:
        bits = max(1, int(np.log2(shards)))
        order = np.argsort(keys)
        keys, prob, back = keys[order], prob[order].astype(np.float32), back[order].astype(np.float32)
        at = np.searchsorted(keys >> np.uint64(64 - bits), np.arange(2**bits + 1, dtype=np.uint64))
        return Table([(keys[a:b], prob[a:b], back[a:b]) for a, b in zip(at[:-1], at[1:])], bits)

    def join(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, probability, back-off weight) of n-grams; a shard at a time, so each search stays in cache."""
        found, prob, back = np.zeros(len(grams), bool), np.zeros(len(grams)), np.ones(len(grams))
        shard = (grams >> np.uint64(64 - self.bits)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        at = np.searchsorted(shard[order], np.arange(2**self.bits + 1))
        for s, (keys, p, b) in enumerate(self.shards):
            rows = order[at[s] : at[s + 1]]
            if len(rows) and len(keys):
                pos = np.minimum(np.searchsorted(keys, grams[rows]), len(keys) - 1)
                hit = keys[pos] == grams[rows]
                found[rows[hit]], prob[rows[hit]], back[rows[hit]] = True, p[pos[hit]], b[pos[hit]]
        return found, prob, back


@dataclass(frozen=True)
class Model:
    """limits: for a language (None: all) the words from which its classes of length begin, and the greatest log perplexity of each."""

    tables: list[Table]
    unknown: float
    limits: dict[str | None, tuple[np.ndarray, np.ndarray]]


def grams_of(n_words: np.ndarray, h: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order the hash of the n-gram that ends at each word; before the text stand start marks."""
    place = np.arange(len(h)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    out, acc = [], h.copy()
    with np.errstate(over="ignore"):
        for n in range(1, order + 1):
            out.append(mix(acc + np.uint64(n)))
            back = np.full(len(h), _START)
            if n < len(h):
                inside = place[n:] >= 0
                back[n:] = np.where(inside & (place[n:] >= n), h[: len(h) - n], _START)
            acc = mix(acc * _STEP) + back * np.uint64(2 * n + 1)
    return out


def contexts_of(n_words: np.ndarray, h: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 2..order the hash of the n - 1 words before each word, named as grams_of names them."""
    place = np.arange(len(h)) - np.repeat(np.cumsum(n_words) - n_words, n_words)

    def before(k: int) -> np.ndarray:
        w = np.full(len(h), _START)
        if k < len(h):
            w[k:] = np.where(place[k:] >= k, h[: len(h) - k], _START)
        return w

    out = []
    with np.errstate(over="ignore"):
        for n in range(2, order + 1):
            acc = before(1)
            for k in range(1, n - 1):
                acc = mix(acc * _STEP) + before(k + 1) * np.uint64(2 * k + 1)
            out.append(mix(acc + np.uint64(n - 1)))
    return out


def counted(texts: DataFrame, order: int) -> DataFrame:
    """(n, gram, context, suffix, c) of texts (one column), a row per n-gram: the words before its last, and all but its first."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch.column(0)):
                n_words, h = word_hashes(pc.utf8_lower(pc.fill_null(part, "")))
                grams, contexts = grams_of(n_words, h, order), contexts_of(n_words, h, order)
                for n in range(1, order + 1):
                    gram, first, c = np.unique(grams[n - 1], return_index=True, return_counts=True)
                    none = np.zeros(len(gram), np.uint64)
                    cols = [gram, contexts[n - 2][first] if n > 1 else none, grams[n - 2][first] if n > 1 else none, c]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), n, np.int32)), *[pa.array(x.view(np.int64)) for x in cols]], names=["n", "gram", "context", "suffix", "c"])

    found = texts.mapInArrow(run, "n int, gram long, context long, suffix long, c long")
    return found.groupBy("n", "gram").agg(F.first("context").alias("context"), F.first("suffix").alias("suffix"), F.sum("c").alias("c"))


def discounts(of: list[int]) -> list[float]:
    """The three discounts, of n-grams counted once, twice and more often, by how many are counted 1, 2, 3, 4 times."""
    n = [max(1, x) for x in of]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.05), k + 0.95) for k in range(3)]


def fit(texts: DataFrame, settings: Settings = Settings()) -> tuple[list[Table], float]:
    """(tables of orders 1 to n, probability of an unknown word) of a column of texts."""
    order = settings.order
    counts = checkpoint(counted(texts, order))
    # below the highest order: how many different words stand before an n-gram
    cont = counts.filter(F.col("n") > 1).groupBy((F.col("n") - 1).alias("n"), F.col("suffix").alias("gram")).agg(F.count(F.lit(1)).alias("k"))
    used = checkpoint(counts.join(cont, ["n", "gram"], "left").select("n", "gram", "context", "suffix", F.coalesce("k", "c").alias("c")))
    few = {(r["n"], r["c"]): r["m"] for r in used.filter("c <= 4").groupBy("n", "c").agg(F.count(F.lit(1)).alias("m")).collect()}  # four rows an order
    first = used.filter("n = 1").agg(F.sum("c").alias("t"), F.count(F.lit(1)).alias("v")).first()
    tables, parts, lower, unknown = [], [], None, 1.0
    for n in range(1, order + 1):
        d = discounts([few.get((n, c), 0) for c in range(1, 5)])
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        mine = used.filter(F.col("n") == n).withColumn("off", off)
        if n == 1:
            if not first["t"]:
                return [Table.build(np.empty(0, np.uint64), np.empty(0), np.empty(0), settings.shards) for _ in range(order)], 1.0
            total = first["t"]
            left = mine.agg(F.sum("off")).first()[0] / total
            unknown = left / (first["v"] + 1)
            prob = mine.select("gram", ((F.col("c") - F.col("off")) / total + unknown).alias("prob"))
        else:
            by = mine.groupBy("context").agg(F.sum("c").alias("total"), F.sum("off").alias("mass")).select("context", "total", (F.col("mass") / F.col("total")).alias("back"))
            below = lower.select(F.col("gram").alias("suffix"), F.col("prob").alias("low"))
            prob = mine.join(by, "context").join(below, "suffix").select("gram", ((F.col("c") - F.col("off")) / F.col("total") + F.col("back") * F.col("low")).alias("prob"))
            # back-off weights belong to the context, a row of the order below; start marks alone have no probability
            weights = by.select(F.col("context").alias("gram"), "back")
            parts.append(lower.join(weights, "gram", "full").select(F.lit(n - 1).alias("n"), "gram", F.coalesce("prob", F.lit(0.0)).alias("prob"), F.coalesce("back", F.lit(1.0)).alias("back")))
        lower = checkpoint(prob)
    parts.append(lower.select(F.lit(order).alias("n"), "gram", "prob", F.lit(1.0).alias("back")))
    for part in parts:
        got = part.select("gram", F.col("prob").cast("float"), F.col("back").cast("float")).toArrow()  # bounded by train_words
        tables.append(Table.build(*(got[c].to_numpy().view(t) for c, t in (("gram", np.uint64), ("prob", np.float32), ("back", np.float32))), settings.shards))
    give_back(texts.sparkSession)
    return tables, unknown


def log_perplexity(texts: pa.Array, tables: list[Table], unknown: float) -> np.ndarray:
    """Mean negative log probability per word of each text; NaN without words."""
    return log_perplexity_and_words(texts, tables, unknown)[0]


def log_perplexity_and_words(texts: pa.Array, tables: list[Table], unknown: float) -> tuple[np.ndarray, np.ndarray]:
    parts = [_log_perplexity(t, tables, unknown) for t in text_slices(texts)]
    return tuple(np.concatenate([np.empty(0), *(p[k] for p in parts)]) for k in (0, 1))


def _log_perplexity(texts: pa.Array, tables: list[Table], unknown: float) -> tuple[np.ndarray, np.ndarray]:
    n_words, h = word_hashes(pc.utf8_lower(pc.fill_null(texts, "")))
    order = len(tables)
    grams, contexts = grams_of(n_words, h, order), contexts_of(n_words, h, order)
    found, p, _ = tables[0].join(grams[0])
    prob = np.where(found & (p > 0), p, unknown)
    for n in range(2, order + 1):
        known, own, _ = tables[n - 1].join(grams[n - 1])
        _, _, back = tables[n - 2].join(contexts[n - 2])
        prob = np.where(known & (own > 0), own, back * prob)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.bincount(doc, weights=-np.log(prob), minlength=len(n_words)) / n_words, n_words


def good_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids labelled good with a hash, its place from 0 to 1, and whether they are kept for the quantiles."""
    good = labels.filter(F.col("quality") == 1).select(F.col(id_col).alias("_id")).filter("_id IS NOT NULL").distinct().withColumn("_h", F.xxhash64("_id", F.lit(3)))
    return good.withColumn("_u", F.col("_h").bitwiseAND(F.lit((1 << 31) - 1)) / F.lit(float(1 << 31))).withColumn("_held", F.pmod(F.shiftright("_h", 40), F.lit(5)) == 4)


def level(demands: list[float], total: float) -> float:
    """The bound under which all demands together take no more than ``total``; no bound where they fit."""
    left, bound = total, float("inf")
    for k, d in enumerate(sorted(demands)):
        if d > left / (len(demands) - k):
            return left / (len(demands) - k)
        left -= d
    return bound


def choose(rows: list, settings: Settings) -> list[tuple]:
    """(id, language) to fit on, of candidates (_u, _id, _lang, _words): each language in hash order up to its share of words."""
    by_lang: dict = {}
    for r in sorted(rows, key=lambda r: (r["_u"], r["_id"])):
        by_lang.setdefault(r["_lang"], []).append(r)
    share = level([sum(r["_words"] for r in got[: settings.per_language]) for got in by_lang.values()], settings.train_words)
    out = []
    for lang, got in by_lang.items():
        used, n = 0.0, 0
        for r in got:
            if n == settings.per_language:
                break
            if used + r["_words"] > share:
                continue  # this text alone
            used, n = used + r["_words"], n + 1
            out.append((r["_id"], lang))
    return out


def trusted_rows(docs: DataFrame, labels: DataFrame, settings: Settings, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(_id, _lang, _text) of a bounded sample of documents labelled good."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).cast("string").alias("_text")).filter("_text IS NOT NULL")
    trusted = checkpoint(rows.select("_id", "_lang", (F.length("_text") / 5).alias("_words")).join(good_ids(labels, id_col).filter("NOT _held"), "_id").groupBy("_id", "_lang", "_h", "_u").agg(F.sum("_words").alias("_words")))
    most = trusted.groupBy("_lang").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "_lang").limit(settings.languages)
    # about twice as many of each language as are taken
    near = trusted.join(F.broadcast(most.withColumnRenamed("_lang", "_l")), F.col("_lang").eqNullSafe(F.col("_l"))).filter(F.col("_u") * F.col("_n") < 2 * settings.per_language)
    picked = choose(near.select("_u", "_id", "_lang", "_words").collect(), settings)
    ids = docs.sparkSession.createDataFrame(picked, trusted.select("_id", F.col("_lang").alias("_l")).schema)
    got = rows.join(F.broadcast(ids), "_id").filter(F.col("_lang").eqNullSafe(F.col("_l"))).select("_id", "_lang", "_text")
    return checkpoint(got.repartition(docs.sparkSession.sparkContext.defaultParallelism))  # bounded, and found in few of many files


def scored(docs: DataFrame, tables: list[Table], unknown: float, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, _lang, _value (log perplexity, NaN without words), _words: a row per document."""
    sent = docs.sparkSession.sparkContext.broadcast((tables, unknown))  # bounded by Settings

    def run(batches):
        for batch in batches:
            value, n_words = log_perplexity_and_words(batch.column(2), *sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(value), pa.array(n_words.astype(np.int64))], names=["doc_id", "_lang", "_value", "_words"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, "doc_id long, _lang string, _value double, _words long")


def limits_of(scores: DataFrame, labels: DataFrame, fitted: DataFrame | None, settings: Settings, id_col: str = "doc_id") -> dict:
    """The quantiles of each language, and of all, by classes of length, over all trusted documents not fitted on (fitted; None: all but the held ones)."""
    own = scores.join(good_ids(labels, id_col).select(F.col("_id").alias("doc_id"), "_held"), "doc_id").filter(~F.isnan("_value"))
    own = own.filter("_held") if fitted is None else own.join(F.broadcast(fitted.select(F.col("_id").alias("doc_id")).distinct()), "doc_id", "left_anti")
    own = checkpoint(own.select("_lang", "_value", "_words"))
    limits: dict = {}
    cuts = [k / settings.lengths for k in range(1, settings.lengths)]
    for rows, key in ((own.withColumn("_k", F.lit("all")), lambda k: None), (own.withColumn("_k", F.concat(F.lit("="), F.coalesce("_lang", F.lit("")), F.col("_lang").isNull().cast("string"))), lambda k: k)):
        sized = rows.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_words", cuts, 10_000).alias("_at"))
        classes = F.greatest(F.lit(1), F.least(F.lit(settings.lengths), F.floor(F.col("_n") / settings.least).cast("int")))
        # every lengths / classes-th cut, so that classes hold enough
        edges = F.transform(F.sequence(F.lit(1), classes), lambda k: F.when(k > 1, F.get("_at", F.floor((k - 1) * settings.lengths / classes).cast("int") - 1)).otherwise(F.lit(0).cast("long")))
        edged = rows.join(F.broadcast(sized.filter(F.col("_n") >= 10).select("_k", F.array_distinct(edges).alias("_edges"))), "_k")  # a row per language
        place = F.size(F.filter("_edges", lambda e: e <= F.col("_words"))) - 1
        for r in edged.groupBy("_k", "_edges", place.alias("_c")).agg(F.percentile_approx("_value", settings.quantile, 10_000).alias("_q")).collect():
            at, most = limits.setdefault(key(r["_k"]), (np.array(r["_edges"], np.int64), np.full(len(r["_edges"]), np.inf)))
            most[r["_c"]] = r["_q"]
    return limits


def _train(docs: DataFrame, labels: DataFrame, settings: Settings, columns: dict) -> tuple[Model, DataFrame]:
    got = trusted_rows(docs, labels, settings, **columns)
    tables, unknown = fit(got.select("_text"), settings)
    scores = checkpoint(scored(docs, tables, unknown, **columns).hint("rebalance"))  # some 30 bytes a text: few files, not one for each task
    id_col = columns.get("id_col", "doc_id")
    return Model(tables, unknown, limits_of(scores, labels, got, settings, id_col)), scores


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), **columns) -> Model:
    """Fit on a sample, take the languages' quantiles on all other trusted documents."""
    return _train(docs, labels, settings, columns)[0]


def decide(scores: DataFrame, model: Model) -> DataFrame:
    """(doc_id, perplexity, limit, kept) of scored documents."""
    limits = model.limits
    every = limits.get(None, (np.zeros(1, np.int64), np.array([np.inf])))

    def run(batches):
        for batch in batches:
            value, n_words = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            limit = np.empty(len(value))
            lang = np.array(["=true" if x is None else f"={x}false" for x in batch.column(1).to_pylist()], dtype=object)
            for key in set(lang):
                mine = lang == key
                at, most = limits.get(key, every)
                limit[mine] = most[np.maximum(np.searchsorted(at, n_words[mine], "right") - 1, 0)]
            none = np.isnan(value)
            with np.errstate(invalid="ignore", over="ignore"):
                kept = ~none & (value <= limit)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.exp(value), mask=none), pa.array(np.exp(limit)), pa.array(kept)], names=["doc_id", "perplexity", "limit", "kept"])

    return scores.mapInArrow(run, "doc_id long, perplexity double, limit double, kept boolean")


def judge(docs: DataFrame, model: Model, **columns) -> DataFrame:
    """doc_id, perplexity, its language's limit and kept, a row per document."""
    return decide(scored(docs, model.tables, model.unknown, **columns), model)


def classify(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, **columns) -> DataFrame:
    """Train and judge the same documents, each scored once; without settings, by a model of all trusted documents but the held fifth."""
    if settings is not None:
        model, scores = _train(docs, labels, settings, columns)
        return decide(scores, model)
    id_col, text_col, lang_col = (columns.get(c, name) for c, name in (("id_col", "doc_id"), ("text_col", "text"), ("lang_col", "lang")))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).cast("string").alias("_text"))
    fitted = good_ids(labels, id_col).filter("NOT _held").select(F.col("_id").cast("long").alias("_good"))
    trust = marked(source.withColumnRenamed("doc_id", "_id"), fitted.distinct()).select(F.col("_id").alias("doc_id"), "_lang", "_text", F.col("_in").alias("_fit"))
    scores = checkpoint(kneser_ney_whole.score(source.select("_text"), trust, discounts).hint("rebalance"))
    return decide(scores, Model([], 1.0, limits_of(scores, labels, None, Settings(), id_col)))
