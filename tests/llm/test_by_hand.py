"""Operators and the pipeline against their definitions, written out plainly; awkward columns and empty tables."""

import collections
import math
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import backoff, bpe, embedding_dedup, jaccard, kneser_ney, kneser_ney_whole, membership, mixing, packing, quality_rules, queries, sharding, token_counts, toxicity
from tests.llm.test_llm import LONG, TEXTS, filled, groups, kneser_ney_by_hand, measured, prose, shingled, toxic_rows, words


def spark_hash(*parts: str | int) -> int:
    """xxhash64 of texts or longs."""
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else p.to_bytes(8, "little", signed=True), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def ratio_scores(rows, trusted, buckets):
    """id -> length-normalised log-likelihood ratio of words and pairs of (id, text) rows."""

    def grams(t):
        h = [spark_hash(x.lower()) for x in words(t)]
        return [x % buckets for x in h] + [spark_hash(a, b) % buckets for a, b in zip(h, h[1:])]

    raw, good = collections.Counter(), collections.Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i in trusted:
            good.update(grams(t))
    n_raw, n_good, prior = sum(raw.values()), sum(good.values()), quality_rules.PRIOR * buckets
    out = []
    for i, t in rows:
        s = 0.0
        for b in grams(t):
            p = (raw[b] + 1) / (n_raw + buckets)
            s += math.log((good[b] + prior * p) / (n_good + prior)) - math.log(p)
        out.append((i, s / (2 * len(words(t)) - 1) if words(t) else 0.0))
    return out


def verdicts(rows, trusted, buckets=quality_rules.BUCKETS):
    """Which rows pass the rules and the ratio."""
    out = []
    for (_, t), (_, score) in zip(rows, ratio_scores(rows, trusted, buckets)):
        n, *_, repeated = measured(t)
        out.append(n >= 10 and 100 * repeated <= 20 * n and score >= quality_rules.THRESHOLD)
    return out


@pytest.mark.parametrize("buckets", [64, quality_rules.BUCKETS])
def test_likelihood_ratio(spark, buckets):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(50 + k, prose(30, k)) for k in range(10)] + [(3, "one more"), (None, prose(12, 90))]
    trusted = {6, 50, 51, 55, 3}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in trusted] + [(6, 1), (7, 0), (None, 1), (8, None)], "doc_id long, quality int")
    got = sorted((str(r.doc_id), r.score) for r in quality_rules.judge(docs, labels, buckets=buckets).collect())
    want = sorted((str(i), s) for i, s in ratio_scores(rows, trusted, buckets))
    assert [i for i, _ in got] == [i for i, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-9)
    if buckets != 64:
        kept = collections.Counter(i for (i, _), ok in zip(rows, verdicts(rows, trusted)) if ok)
        assert collections.Counter(r.doc_id for r in quality_rules.filter_documents(docs, labels).collect()) == kept


def test_ratios_count_every_trusted_document(spark):
    """Of 60,000 documents labelled good, those that come last in any order by hash are counted like the first."""
    labels = spark.range(60_000).selectExpr("id AS doc_id", "1 AS quality")
    late = [r.doc_id for r in labels.orderBy(F.xxhash64("doc_id").desc()).limit(30).collect()]
    rows = [(i, prose(40, i)) for i in late] + [(100_000 + k, " ".join(f"w{j}" for j in range(k, k + 40))) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality_rules.judge(docs, labels, buckets=64).collect()}
    assert got == pytest.approx(dict(ratio_scores(rows, set(late), 64)), rel=1e-9, abs=1e-12)
    whole = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # the join that shuffles texts
    try:
        assert got == pytest.approx({r.doc_id: r.score for r in quality_rules.judge(docs, labels, buckets=64).collect()}, rel=1e-9, abs=1e-12)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", whole)


@pytest.mark.parametrize("words_", [1, 64, membership.WORDS])
@pytest.mark.parametrize("of, told", [("long", "long"), ("string", "string"), ("int", "long"), ("string", "long")])
def test_membership(spark, words_, of, told):
    """However many places there are, and whatever the types, marks are those of a join by id."""
    rows = spark.createDataFrame([(k % 900 if k else None, str(k)) for k in range(1000)], "k long, _text string").select(F.col("k").cast(of).alias("_id"), "_text")
    ids = spark.range(0, 1200, 3).select(F.col("id").cast(told))
    got = membership.marked(rows, ids, words_)
    assert got.columns == ["_id", "_text", "_in"]
    assert sorted((int(r._text), r._in) for r in got.collect()) == [(k, k > 0 and k % 900 % 3 == 0) for k in range(1000)]
    assert not membership.marked(rows, ids.limit(0), words_).filter("_in").count()


def shuffled(spark, run):
    """Bytes that run() writes to shuffles."""

    context = spark.sparkContext
    none, no_numbers = context._jvm.java.util.ArrayList(), context._gateway.new_array(context._jvm.double, 0)

    def written():
        context._jsc.sc().listenerBus().waitUntilEmpty()
        stages = context._jsc.sc().statusStore().stageList(none, False, False, no_numbers, none)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    before = written()
    run()
    return written() - before


def test_ratios_shuffle_no_texts(spark):
    """However many documents are trusted, ids are shuffled, not texts."""
    rows = [(i, prose(2000, i)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.range(200).selectExpr("id AS doc_id", "1 AS quality")
    whole = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert shuffled(spark, lambda: quality_rules.judge(docs, labels, buckets=64).collect()) < 0.1 * sum(len(t) for _, t in rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", whole)


def test_toxicity_score_by_hand():
    train = toxic_rows(120, 4)
    model = toxicity.fit([t for _, t, _ in train], np.array([y for *_, y in train]))
    s = model.settings

    def word_value(w):
        ids, starts = toxicity.subwords(pa.array([w.lower().strip(toxicity._EDGE)]), s.buckets)
        assert starts.tolist() == [0, len(ids)]
        return float(np.mean(model.weight[ids]))

    def score(t):
        w = (t or "").split()
        passages = sorted((float(np.mean([word_value(x) for x in w[k : k + s.passage_words]])) for k in range(0, len(w), s.passage_words)), reverse=True)[: s.worst]
        return 1 / (1 + math.exp(-(float(np.mean(passages)) if passages else 0.0) - model.bias))

    texts = [None, "", " \n", "one", "IDIOT!", prose(33, 1), prose(7, 2) + " (scum) " + prose(9, 3), *[t for _, t, _ in train[:6]]]
    assert toxicity.score_texts(pa.array(texts, pa.string()), model) == pytest.approx([score(t) for t in texts], abs=1e-9)


def test_best_fit_by_hand():
    """Every piece goes where a search of all open bins would put it; the fullest closes first."""
    rng = np.random.default_rng(8)
    for capacity, most in ((50, 7), (200, 1000)):
        bins, naive, closed = packing.Bins(capacity, most), [], 0
        for n in rng.integers(1, capacity + 1, 3000).tolist():
            fits = [b for b in naive if b[1] >= n]
            best = min((b[1] for b in fits), default=capacity)
            _, at = bins.place(n)
            assert at == capacity - best
            rest = best - n
            if fits:
                naive.remove(next(b for b in fits if b[1] == best))
            if rest:
                naive.append([0, rest])
            if len(naive) > most:
                naive.remove(min(naive, key=lambda b: b[1]))
                closed += 1
            assert sorted(b[1] for b in naive) == sorted(f for f, level in enumerate(bins.by_free) for _ in level)
        assert (closed > 0) == (most == 7)


def test_packing_is_tight(spark):
    """Close to the fewest sequences that could hold all tokens."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = packing.pack(docs.repartition(2)).agg(F.sum("length").alias("n"), F.countDistinct("sequence_id").alias("s")).first()
    assert got.s <= 1.02 * math.ceil(got.n / 1024) + 2


#: Names that operators use inside, or return.
CLASH = ["_h", "size", "doc", "_text", "_id", "_lang", "node", "row", "bands", "_v", "label", "units", "_row", "tokens", "file", "seq", "score", "kept", "position", "target", "n", "_doc", "_t", "_i", "part", "slice", "data", "_words", "limit"]


def test_extra_columns_change_nothing(spark):
    base = spark.createDataFrame([(k, t, "en", f"s{k % 3}") for k, t in enumerate([*TEXTS, *[prose(25, k) for k in range(12)]])], "doc_id long, text string, lang string, source string")
    more = base.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASH)])
    labels = base.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS quality", "cast(doc_id % 3 = 0 AS int) AS toxic", "1 AS _id", "2 AS _h", "'x' AS _lang")
    model = toxicity.fit([t for _, t, _ in toxic_rows(60, 1)], np.array([y for *_, y in toxic_rows(60, 1)]))
    for f in (
        jaccard.link,
        lambda d: quality_rules.judge(d, labels),
        lambda d: kneser_ney.classify(d, labels),
        lambda d: toxicity.score(d, model),
        mixing.plan,
        backoff.score,
        token_counts.token_counts,
        lambda d: packing.pack(d).drop("sequence_id", "offset"),
    ):
        assert sorted(map(str, f(base).collect())) == sorted(map(str, f(more).collect()))
    assert len(toxicity.training_rows(more, labels, toxicity.Settings())[0]) == len(toxicity.training_rows(base, labels.select("doc_id", "toxic"), toxicity.Settings())[0])
    for f in (jaccard.keep_one, lambda d: quality_rules.filter_documents(d, labels), lambda d: toxicity.keep_clean(d, model), mixing.mix):
        kept = f(more)
        assert kept.columns == more.columns
        assert sorted(str(r[:4]) for r in kept.collect()) == sorted(str(r[:4]) for r in f(base).collect())
        assert {tuple(r[4:]) for r in kept.collect()} <= {tuple(range(len(CLASH)))}
    vectors = spark.createDataFrame([(k, [float(k % 5), 1.0], 1) for k in range(20)], "vec_id long, embedding array<float>, label int")
    clash = vectors.select("*", *[F.lit(1).alias(c) for c in ("v", "_node", "copies", "dim", "pivot", "home", "angle")])
    assert sorted(map(str, embedding_dedup.link(vectors).collect())) == sorted(map(str, embedding_dedup.link(clash).collect()))


@pytest.fixture
def empty(spark, tmp_path):
    for name in ("documents", "labels", "embeddings"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_empty_tables(spark, empty):
    for name, f in queries.QUERIES.items():
        assert f(spark, empty).count() == 0, name
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_pipeline_with_awkward_rows(spark, tmp_path):
    """Nulls in every column, empty texts, repeated rows, a long text, no labels."""
    rows = [(k, t, "en" if k % 2 else None, f"s{k % 2}" if k % 3 else None, 1) for k, t in enumerate(TEXTS)] + [(None, LONG, None, None, None), (8, LONG, "en", "s0", 1), (3, "one", "en", "s0", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {6, 8, 9, None} and len(got) > 0  # one of the long ones, the prose


def test_pipeline_by_hand(spark):
    """Each stage's result is what its definition gives for the stage before it."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = {}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, sf).toPandas()
        kept[name] = out
        if name != corpus_pipeline.STAGES[-1][0]:
            before = spark.createDataFrame(out, before.schema)
    rows = {r.doc_id: r for r in docs.collect()}
    # toxicity
    model = toxicity.train(docs, labels)
    clean = [i for i, r in rows.items() if toxicity.score_texts(pa.array([r.text]), model)[0] < 0.5]
    assert sorted(kept["toxicity"]["doc_id"]) == sorted(clean)
    # quality rules
    trusted = {r.doc_id for r in labels.collect() if r.quality == 1} & set(clean)
    pairs = [(i, rows[i].text) for i in clean]
    good = [i for (i, _), ok in zip(pairs, verdicts(pairs, trusted)) if ok]
    assert sorted(kept["quality rules"]["doc_id"]) == sorted(good)
    # n-gram Jaccard join
    good.sort()
    sets = [shingled(rows[i].text) for i in good]
    links = [(a, b) for a in range(len(good)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    single = sorted({good[c] for c in groups(len(good), links)})
    assert sorted(kept["n-gram Jaccard join"]["doc_id"]) == single
    # mixing
    sizes = collections.Counter()
    for i in single:
        sizes[rows[i].source] += len(words(rows[i].text))
    mixed, taken = kept["mixing sources to target weights"], collections.Counter()
    for i, t in zip(mixed["doc_id"], mixed["text"]):
        assert rows[i].text.startswith(t) or words(rows[i].text)[: len(words(t))] == words(t)
        taken[rows[i].source] += len(words(t))
    assert all(abs(taken[s] - n) <= 1 for s, n in filled(sizes).items())
    assert all(n <= 3 for n in collections.Counter(mixed["doc_id"]).values())
    # best-fit packing
    e, want = bpe.encoder(bpe.default_vocabulary()), collections.Counter()
    for i, t in zip(mixed["doc_id"], mixed["text"]):
        ids = np.append(e.exact(t) if t else np.empty(0, int), 2).astype("<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids), 1024)):
            want[(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes()))] += 1
    packed = kept["best-fit packing"]
    assert collections.Counter(zip(packed["doc_id"], packed["piece"], packed["start"], packed["length"], packed["ids_crc32"])) == want
    for _, g in packed.sort_values("offset").groupby("sequence_id"):
        assert (g["length"].cumsum() - g["length"]).tolist() == g["offset"].tolist() and g["length"].sum() <= 1024


def test_ids_beyond_the_file_type_are_errors(spark):
    with pytest.raises(Exception, match="too large for"):
        token_counts.token_counts(spark.createDataFrame([(1, "a")], "doc_id long, text string"), end_id=70_000).count()
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    wide = token_counts.token_counts(docs, end_id=70_000, dtype="<u4").collect()
    assert sorted(map(str, wide)) == sorted(map(str, token_counts.token_counts(docs).collect()))


def test_many_short_texts_in_a_batch(spark):
    """More texts in one Arrow batch than 16 bits number."""
    n = 70_000
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "0")
    try:
        docs = spark.range(n).selectExpr("id AS doc_id", "concat('w', id % 7, ' v', id % 3) AS text").coalesce(1)
        got = backoff.score(docs).select("doc_id", "n_words").distinct().agg(F.count("*").alias("n"), F.sum("n_words").alias("w")).first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert (got.n, got.w) == (n, 2 * n)


def test_components_do_not_keep_rounds(spark):
    """Shared tables of earlier rounds are removed."""
    from quillon.llm import common, graph

    root = common.shared_dir(spark)
    fs, p = common.hadoop_path(spark, root)
    before = {s.getPath().getName() for s in fs.listStatus(p)} if fs.exists(p) else set()
    graph.components(spark.createDataFrame([(k, k + 1) for k in range(30)], "a long, b long")).count()
    after = {s.getPath().getName() for s in fs.listStatus(p)} - before
    assert sum("edges" in name for name in after) == 1


def test_sharding_query_keeps_all_rows(spark):
    assert queries.op2_sharding(spark, "/root/testdata/sf0.001").count() == 200
    assert issubclass(sharding.ConflictError, RuntimeError)


def test_quality_model_of_every_trusted_document(spark):
    """1,500 trusted documents of one language, more than a sample of 1,000: perplexities are those of a model of all that aren't held."""
    rows = [(k, " ".join(np.random.default_rng(k).choice([f"w{j}" for j in range(40)], 12))) for k in range(1500)]
    rows += [(5000 + k, t) for k, t in enumerate(["w1 w2 never seen", "one", "", None, rows[7][1], rows[8][1][:20]])]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    labels = spark.range(1500).selectExpr("id AS doc_id", "1 AS quality")
    held = {r["_id"] for r in kneser_ney.good_ids(labels).collect() if r["_held"]}
    score = kneser_ney_by_hand([t for i, t in rows if i < 1500 and i not in held])
    got = {r.doc_id: r for r in kneser_ney.classify(docs, labels).collect()}
    assert len(got) == len(rows) and got[5002].perplexity is None and got[5003].perplexity is None
    for i, t in rows[::100] + rows[1500:]:
        if t:
            assert math.log(got[i].perplexity) == pytest.approx(score(t), rel=1e-9)


def test_quality_model_shuffles_no_texts(spark, monkeypatch):
    """Rows with equal ids, equal rows and nulls keep their scores over the rounds; what one shuffle holds is a share of the rows, and no texts are dealt by id."""
    rows = [(k % 50, prose(30, k)) for k in range(60)] + [(7, "a b a b"), (7, "a b a b"), (None, "a b"), (None, "a b"), (8, None), (8, ""), (8, "")]
    docs = spark.createDataFrame([(i, "en", t, i is not None and i % 2 == 0) for i, t in rows], "doc_id long, _lang string, _text string, _fit boolean")
    settings = backoff.Settings(hot=30, frequent=5, words_per_partition=200, slice_bytes=500)
    one, three = (sorted((str(r.doc_id), str(r["_words"]), f"{r['_value']:.9f}") for r in kneser_ney_whole.score(docs.select("_text"), docs, kneser_ney.discounts, settings, k).collect()) for k in (1, 3))
    by_hand = kneser_ney_by_hand([t for i, t in rows if i is not None and i % 2 == 0 and t])
    assert one == three == sorted((str(i), str(len(words(t or ""))), f"{by_hand(t) if t else math.nan:.9f}") for i, t in rows)
    seen = []

    def score(source, trust, *_):
        seen.append(trust)
        return trust.selectExpr("doc_id", "_lang", "1D AS _value", "1L AS _words")

    monkeypatch.setattr(kneser_ney_whole, "score", score)
    texts = [(i, prose(2000, i), "en") for i in range(400)]
    labels = spark.range(200).selectExpr("id AS doc_id", "1 AS quality")
    whole = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kneser_ney.classify(spark.createDataFrame(texts, "doc_id long, text string, lang string"), labels)
        assert shuffled(spark, lambda: seen[0].agg(F.sum(F.length("_text"))).collect()) < 0.1 * sum(len(t) for _, t, _ in texts)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", whole)


def test_quality_model_in_many_partitions(spark):
    """The same with hot words whose contexts lie apart, several partitions and slices."""
    rows = [(k, prose(30, k) + " the of the " * (k % 3)) for k in range(40)]
    marked = spark.createDataFrame([(i, "en", t, i % 2 == 0) for i, t in rows], "doc_id long, _lang string, _text string, _fit boolean")
    settings = backoff.Settings(hot=30, frequent=5, words_per_partition=200, slice_bytes=500)
    score = kneser_ney_by_hand([t for i, t in rows if i % 2 == 0])
    got = {r.doc_id: r["_value"] for r in kneser_ney_whole.score(marked.select("_text"), marked, kneser_ney.discounts, settings).collect()}
    assert got == pytest.approx({i: score(t) for i, t in rows}, rel=1e-9)


def test_quality_model_shuffles_rows_to_fit_on_and_rows_to_score(spark):
    """With few trusted documents few rows are counted; what a round shuffled is gone when it has ended."""
    rows = [(k, "en", prose(300, k), k % 10 == 0) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, _lang string, _text string, _fit boolean")
    settings = backoff.Settings(hot=30, frequent=100, words_per_partition=4000, slice_bytes=20_000)

    def on_disk():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        found = (files.apply(k) for k in range(files.size()))
        return {f.getName(): f.length() for f in found if f.getName().startswith("shuffle_")}

    def run(some):
        return shuffled(spark, lambda: kneser_ney_whole.score(docs.select("_text"), some, kneser_ney.discounts, settings, 3))

    before = on_disk()
    few = run(docs)
    for _ in range(100):  # files go a little later
        left = sum(n for name, n in on_disk().items() if name not in before)
        if left < 0.2 * few:
            break
        time.sleep(0.1)
    assert left < 0.2 * few
    assert few < 0.75 * run(docs.withColumn("_fit", F.lit(True)))


def test_words_eight_bytes_at_a_time():
    """As many words as a plain split finds, and two have the same id if and only if they are the same in lower case."""
    texts = [None, "", " ", "a", " A", "a ", "a b\x0bc\x1cd\te", "\x00", "a\x00", "12345678", "123456789", "12345678\x00", "0" * 16, "0" * 17, LONG[:1000], "Ärger ÄRGER", "b", "", *(prose(50, k) for k in range(20))]
    for some in (pa.array(texts), pa.array(texts).slice(5, 12), pa.array(texts, pa.large_string()).slice(2), pa.array([None, ""]), pa.array([], pa.string())):
        n, ids = kneser_ney_whole.word_ids(some)
        plain = [[x.lower() for x in words(t or "")] for t in some.to_pylist()]
        assert n.tolist() == [len(x) for x in plain]
        flat = [x for t in plain for x in t]
        assert len(set(zip(flat, ids.tolist()))) == len(set(flat)) == len(set(ids.tolist()))
