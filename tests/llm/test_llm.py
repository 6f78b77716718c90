"""Each operator against a plain version, on small tables with all the awkward cases."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from quillon.llm import backoff, bpe, embedding_dedup, graph, jaccard, kneser_ney, mixing, packing, quality_rules, sharding, token_counts, toxicity
from quillon.llm.common import text_slices

WORD = re.compile(r"[^\x20\x09-\x0d]+")
RNG = np.random.default_rng(0)
VOCAB = ["".join(RNG.choice(list("abcdefgäöé"), RNG.integers(2, 8))) for _ in range(400)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(VOCAB, n))


LONG = prose(6000, 1)
TEXTS = [None, "", " \t\n", "one", "a b c d", "a b c d e", prose(40, 2), prose(40, 2), LONG, LONG + " tail", "x\n\nx\ny\nx", "$$$ ### %", "Ünïcödé 中文 🙂 <|endoftext|>", ("again " * 60).strip()]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en" if k % 3 else None, f"s{k % 4}" if k % 5 else None, 7) for k, t in enumerate(TEXTS)] + [(3, "one", "en", "s3", 7), (None, "no id here at all", "en", "s1", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def words(t):
    return WORD.findall(t or "")


def test_slices_cover_all():
    texts = pa.array(TEXTS, pa.string())
    assert [x for s in text_slices(texts, 50) for x in s.to_pylist()] == TEXTS


def test_ids_are_those_of_tokenizers():
    e = bpe.encoder(bpe.default_vocabulary())
    for t in [*TEXTS, "  two  spaces \n\n\n x", "it's we'll I'D", "a" * 3000, "١٢٣ ½ é é", "tab\there\r\n", " x y"]:
        if t:
            assert e.ids(t).tolist() == e.exact(t).tolist()


def test_packing(docs, none):
    got = packing.pack(docs, capacity=64, open_bins=5).toPandas()
    e = bpe.encoder(bpe.default_vocabulary())
    want = collections.Counter()
    for r in docs.collect():
        ids = np.append(e.exact(r.text) if r.text else np.empty(0, int), 2).astype("<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids), 64)):
            want[(r.doc_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes()))] += 1
    assert collections.Counter((None if math.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g["length"].cumsum() - g["length"]).tolist() == g["offset"].tolist() and g["length"].sum() <= 64
    assert packing.pack(none).count() == 0


def test_best_fit_is_bounded_and_tight():
    b = packing.Bins(10, 2)
    assert [b.place(n) for n in (6, 7, 3, 4, 5)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0)]
    many = packing.Bins(100, 3)
    lengths = RNG.integers(1, 101, 2000)
    used = collections.Counter()
    for n in lengths:
        i, at = many.place(int(n))
        assert at == used[i] and many.count <= 3
        used[i] += int(n)
    assert max(used.values()) <= 100


@pytest.mark.parametrize("block", [3, 64, 1 << 19])
def test_token_counts(docs, none, block):
    e = bpe.encoder(bpe.default_vocabulary())
    want = collections.Counter((r.doc_id, len(e.exact(r.text)) if r.text else 0) for r in docs.collect())
    got = token_counts.token_counts(docs.repartition(3), block_tokens=block).collect()
    assert collections.Counter((r.doc_id, r.n_tokens) for r in got) == want
    if block == 3:
        assert token_counts.token_counts(none).count() == 0


def test_flat_files(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(np.array([5, 9, 9, 1, 2, 9, 4], "<u2").tobytes())
    got = token_counts.count_flat(spark, str(tmp_path / "f.bin"), end_id=9).orderBy("ordinal").collect()
    assert [(r.ordinal, r.n_tokens, r.closed) for r in got] == [(0, 1, True), (1, 0, True), (2, 2, True), (3, 1, False)]


def measured(t):
    w, t = words(t), t or ""
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, docs, none):
    labels = spark.createDataFrame([(6, 1), (7, 1), (8, None), (None, 1), (6, 1)], "doc_id long, quality int")
    got = quality_rules.judge(docs, labels).collect()
    want = collections.Counter((r.doc_id, *measured(r.text)) for r in docs.collect())
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and r.kept == (not r.base_failed and r.score >= quality_rules.THRESHOLD) for r in got)
    kept = quality_rules.filter_documents(docs, labels)  # n_words is a column of the input, too
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got) and {r.n_words for r in kept.collect()} == {7}
    assert quality_rules.judge(none, labels).count() == 0


def test_quality_rules_reject_junk(spark):
    good = [(k, prose(80, k), "s") for k in range(60)]
    bad = [(100 + k, " | ".join(prose(60, 900 + k).upper().split()), "s") for k in range(12)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(k, 1) for k in range(0, 60, 2)], "doc_id long, quality int")
    kept = {r.doc_id for r in quality_rules.judge(docs, labels, buckets=500).collect() if r.kept}
    assert kept == set(range(60))


def toxic_rows(n, seed):
    rng = np.random.default_rng(seed)
    bad = ["idiot", "moron", "scum", "pathetic"]
    out = []
    for k in range(n):
        w = prose(60, seed * 1000 + k).split()
        if k % 3 == 0:
            for p in rng.integers(0, len(w), 4):
                w[p] = str(rng.choice(bad))
        out.append((k, " ".join(w), int(k % 3 == 0)))
    return out


def test_toxicity_learns_and_generalises(spark, docs, none):
    train, test = toxic_rows(240, 1), toxic_rows(90, 2)
    model = toxicity.fit([t for _, t, _ in train], np.array([y for *_, y in train]))
    got = toxicity.score_texts(pa.array([t for _, t, _ in test]), model) >= 0.5
    assert (got == np.array([y == 1 for *_, y in test])).mean() > 0.95
    close = toxicity.score_texts(pa.array([prose(20, 5) + " idioot idiiot idiots " * 2 + prose(20, 6), prose(60, 7), LONG + " idiot scum idiot moron"]), model)
    assert close[0] > close[1] and close[2] > 0.5 > close[1]
    scored = toxicity.score(docs, model).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert len({r.score for r in scored if r.doc_id in (0, 1, 2)}) == 1
    assert toxicity.score(none, model).count() == 0
    assert toxicity.keep_clean(docs, model).columns == docs.columns


def test_toxicity_never_learns_from_held_out(spark):
    docs = spark.createDataFrame(toxic_rows(50, 3), "doc_id long, text string, y int")
    labels = docs.selectExpr("doc_id", "1 AS toxic")
    texts, y = toxicity.training_rows(docs, labels, toxicity.Settings())
    assert len(texts) == sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(50)) and set(y) == {1}
    assert toxicity.score_texts(pa.array(["x", None]), toxicity.fit(texts, y)).tolist() == [1.0, 1.0]
    assert toxicity.score_texts(pa.array(["x"]), toxicity.fit([], np.empty(0)))[0] < 1e-9


def test_huge_labelled_text_leaves_its_class(spark):
    """One text longer than the budget, first in hash order, costs neither its class nor the others' characters."""
    settings = toxicity.Settings(train_chars=60_000)
    rows = toxic_rows(120, 5)
    ids = spark.range(120).filter(~toxicity.is_held_out(F.col("id"))).orderBy(F.xxhash64("id", F.lit(settings.seed)))
    for label in (0, 1):
        huge = next(r.id for r in ids.collect() if rows[r.id][2] == label)
        changed = [(k, (t + " ") * 200 if k == huge else t, y) for k, t, y in rows]
        d = spark.createDataFrame(changed, "doc_id long, text string, toxic int")
        texts, y = toxicity.training_rows(d, d.select("doc_id", "toxic"), settings)
        assert len(texts) == ids.count() and set(y) == {0, 1}
        for c in (0, 1):
            assert sum(len(t) for t, z in zip(texts.to_pylist(), y) if z == c) <= settings.train_chars // 2
        whole = {t for _, t, _ in changed}
        assert sum(t not in whole for t in texts.to_pylist()) <= sum(z == label for z in y) and any(len(t) > 1000 for t in texts.to_pylist())


def filled(sizes, weights=(1, 2, 3), most=3):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        level = (total - sum(most * sizes[s] for s in full)) / sum(w[s] for s in rest) if rest else 0
        over = {s for s in rest if level * w[s] > most * sizes[s] + 1e-9}
        if not over:
            return {s: most * sizes[s] if s in full else level * w[s] for s in names}
        full |= over


def test_mixing(docs, none):
    got = mixing.plan(docs).collect()
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r.source] += len(words(r.text))
    want = filled(sizes)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], abs_tol=1e-6) and r.taken <= 3 * r.size and 0 <= r.position <= 1
        taken[r.source] += r.taken
    assert len(got) == docs.count() and all(abs(taken[s] - want[s]) <= 0.5 + 1e-9 for s in want)
    assert [r.position for r in got] == sorted(r.position for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.plan(docs.repartition(5)).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len(words(r.text)) for r in mixed.collect()) == sum(r.taken for r in got)
    assert mixing.plan(none).count() == 0 and mixing.mix(none).count() == 0


def test_positions_invert_the_schedule(spark):
    df = spark.createDataFrame([(s, u) for s in (-0.8, 0.0, 1e-9, 0.5) for u in (0.0, 0.1, 0.5, 1.0)], "slope double, u double").selectExpr("slope", "u", "1000.0D AS target")
    from pyspark.sql import functions as F

    for r in df.withColumn("t", mixing.position(F.col("u") * 1000)).collect():
        assert math.isclose((1 - r.slope) * r.t + r.slope * r.t**2, r.u, abs_tol=1e-9)


def groups(n, links):
    par = list(range(n))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        par[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 102), (7, 7), (300, 200), (300, 250)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100, 300: 200, 200: 200, 250: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("block", "pivots"), [(2048, 256), (5, 16)])
def test_embeddings(spark, block, pivots):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(8, 6))
    v = [list(map(float, base[k % 8] + rng.normal(scale=0.08, size=6))) for k in range(60)]
    v += [v[0], v[0], [0.0] * 6, None, [], [1.0, None, 0, 0, 0, 0], [float("nan"), 1, 0, 0, 0, 0], [float("inf"), 1, 0, 0, 0, 0], [1e200, 1e200, 0, 0, 0, 0], [1e-200, 1e-200, 0, 0, 0, 0], [1.0, 1.0]]
    label = [None if k % 11 == 5 else k % 2 for k in range(len(v))]
    label[-4:] = [0, 1, 1, 0]
    v = [None if x is None else [None if c is None else float(c) for c in x] for x in v]
    rows = [(k, x, y) for k, (x, y) in enumerate(zip(v, label))]
    got = {r.vec_id: r for r in embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=block, most_pivots=pivots).collect()}

    def unit(x):
        if not x or any(c is None or not math.isfinite(c) for c in x) or not any(x):
            return None
        x = np.array(x) / max(abs(c) for c in x)
        return x / np.linalg.norm(x)

    u = [unit(x) if y is not None else None for x, y in zip(v, label)]
    links = [(a, b) for a in range(len(v)) for b in range(a) if u[a] is not None and u[b] is not None and label[a] == label[b] and len(u[a]) == len(u[b]) and u[a] @ u[b] >= 0.98]
    n = collections.Counter(x for p in links for x in p)
    comp = groups(len(v), links)
    assert len(got) == len(v) and all(got[k].n_links == n[k] and got[k].component_id == comp[k] and got[k].kept == (comp[k] == k) for k in got)
    assert embedding_dedup.link(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_pivots_follow_the_data():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(200, 32))
    close = centres[rng.integers(0, 200, 4000)] + rng.normal(scale=0.02, size=(4000, 32))
    spread = rng.normal(size=(4000, 32))
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    reach = 2 * math.acos(0.98)
    assert len(embedding_dedup.choose_pivots(unit(spread), 10**6, reach, 1024)) <= 4
    few, many = (len(embedding_dedup.choose_pivots(unit(close * np.array([1.0] * 3 + [0.0] * 29)), n, reach, 1024)) for n in (10**3, 10**7))
    assert 1 <= few < many


def test_embeddings_in_many_cells(spark):
    """Vectors of few dimensions, which pivots separate, against all pairs."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 3))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    near = (u @ u.T >= 0.999) & ~np.eye(1500, dtype=bool)
    comp = groups(1500, [(a, b) for a, b in zip(*np.nonzero(near)) if a < b])
    found = embedding_dedup.choose_pivots(u, 1500, 2 * math.acos(0.999), 64, send=1)
    assert len(found) > 1
    for send in (1, 300):
        embedding_dedup.SEND, before = send, embedding_dedup.SEND
        try:
            got = {r.vec_id: r for r in embedding_dedup.link(df, cosine=0.999, block=64).collect()}
        finally:
            embedding_dedup.SEND = before
        assert all(got[k].n_links == near[k].sum() and got[k].component_id == comp[k] for k in range(1500))


def shingled(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def edited(t, n, seed):
    w = t.split()
    for p in np.random.default_rng(seed).integers(0, len(w), n):
        w[p] = f"new{seed}"
    return " ".join(w)


@pytest.mark.parametrize("block", [512, 3])
def test_jaccard(spark, block):
    texts = [None, "", "one", "one", "a b c d", "a b c d e"]
    for s in range(6):
        t = prose(200, 50 + s)
        texts += [t, t, *[edited(t, n, 10 * s + n) for n in (1, 2, 3, 5, 8, 20)]]
    texts += [LONG, edited(LONG, 3, 1)] + [prose(30, 400) + " " + prose(200, 410 + k) for k in range(6)]
    sets = [shingled(t) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    n, comp = collections.Counter(x for p in links for x in p), groups(len(texts), links)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    got = {r.doc_id: r for r in jaccard.link(docs, block=block).collect()}
    assert {k: (r.n_links, r.class_id) for k, r in got.items()} == {k: (n[k], comp[k]) for k in range(len(texts))}
    if block == 3:
        kept = jaccard.keep_one(docs)
        assert sorted(r.doc_id for r in kept.collect()) == sorted(set(comp)) and kept.columns == ["doc_id", "text"]
        twice = docs.unionByName(docs)
        assert jaccard.keep_one(twice).count() == len(set(comp))
        assert jaccard.link(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [512, 2])
def test_jaccard_chain(spark, block):
    """A long chain in which each document is like its neighbours only is compared bucket by bucket; each link counts once."""
    tokens = [f"c{k}" for k in range(3300)]
    texts = [" ".join(tokens[20 * k : 20 * k + 260]) for k in range(150)]
    sets = [shingled(t) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    assert 149 <= len(links) < 300
    n, comp = collections.Counter(x for p in links for x in p), groups(len(texts), links)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_links, r.class_id) for r in jaccard.link(docs, block=block).collect()}
    assert got == {k: (n[k], comp[k]) for k in range(len(texts))}
    nodes = jaccard.sketch(docs, 5, jaccard.BANDS, jaccard.ROWS, "doc_id", "text").select("node", "bands")
    bands = {r.band for r in jaccard._units(nodes, 2).selectExpr("explode(units.band) AS band").collect()}
    assert bands - {-1}


def test_pruning_bound():
    assert jaccard.least_matches(28, 0.8, 1e-9) < 28 * 0.8 and jaccard.least_matches(392, 0.8, 1e-9) > 392 * 0.6
    assert jaccard.least_matches(10, 0.8, 0.0) == 0


def one_column(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "text string")


def kneser_ney_by_hand(texts, order=3):
    """log perplexity of a text under interpolated modified Kneser-Ney, straight from the definition."""
    padded = [["<s>"] * (order - 1) + words(t.lower()) for t in texts]
    raw = {n: collections.Counter(tuple(w[i - n + 1 : i + 1]) for w in padded for i in range(order - 1, len(w))) for n in range(1, order + 1)}
    used = {n: raw[n] if n == order else collections.Counter(g[1:] for g in raw[n + 1]) for n in raw}
    disc = {}
    for n, c in used.items():
        m = [max(1, sum(v == k for v in c.values())) for k in (1, 2, 3, 4)]
        y = m[0] / (m[0] + 2 * m[1])
        disc[n] = [min(max(x, 0.05), k + 0.95) for k, x in enumerate((1 - 2 * y * m[1] / m[0], 2 - 3 * y * m[2] / m[1], 3 - 4 * y * m[3] / m[2]))]

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / (len(used[1]) + 1)
        after = {g: c for g, c in used[n].items() if g[:-1] == gram[:-1]}
        if not after:
            return p(gram[1:])
        total = sum(after.values())
        off = {g: disc[n][min(c, 3) - 1] for g, c in after.items()}
        mine = (after[gram] - off[gram]) / total if gram in after else 0.0
        return mine + sum(off.values()) / total * p(gram[1:])

    def score(t):
        w = ["<s>"] * (order - 1) + words(t.lower())
        return -sum(math.log(p(tuple(w[i - order + 1 : i + 1]))) for i in range(order - 1, len(w))) / (len(w) - order + 1)

    return score


@pytest.mark.parametrize("order", [2, 3])
def test_kneser_ney_by_hand(spark, order):
    train = [" ".join(np.random.default_rng(k).choice(VOCAB[:25], 30)) for k in range(12)] + ["One one ONE", "one", "", None]
    tables, unknown = kneser_ney.fit(one_column(spark, train).repartition(3), kneser_ney.Settings(order=order))
    score = kneser_ney_by_hand([t for t in train if t], order)
    texts = [train[0], train[3][:50], "one two", "zz never seen", " ".join(VOCAB[20:40]), "one one one one"]
    assert kneser_ney.log_perplexity(pa.array(texts), tables, unknown) == pytest.approx([score(t) for t in texts], rel=1e-5)


def test_kneser_ney_is_a_distribution(spark):
    texts = [prose(30, k) for k in range(20)]
    tables, unknown = kneser_ney.fit(one_column(spark, texts))
    vocab = sorted({w for t in texts for w in words(t)})
    for context in (["", ""], [texts[0].split()[0], ""], texts[0].split()[:2], ["never", "seen"]):
        prefix = [c for c in context if c]
        p = [math.exp(-kneser_ney.log_perplexity(pa.array([" ".join([*prefix, w])]), tables, unknown)[0] * (len(prefix) + 1) + (kneser_ney.log_perplexity(pa.array([" ".join(prefix)]), tables, unknown)[0] * len(prefix) if prefix else 0)) for w in [*vocab, "zzunknown"]]
        assert abs(sum(p) - 1) < 1e-5


def test_quality_classifier(spark, docs, none):
    good = [(k, prose(60, k), "en" if k % 2 else None, 1) for k in range(100)]
    bad = [(1000 + k, " | ".join(f"q{k}x{j}" for j in range(60)), "en", 0) for k in range(10)]
    d = spark.createDataFrame(good + bad, "doc_id long, text string, lang string, quality int")
    labels = d.filter("doc_id % 2 = 0").select("doc_id", "quality")
    model = kneser_ney.train(d, labels)
    got = {r.doc_id: r for r in kneser_ney.judge(d, model).collect()}
    assert sum(got[k].kept for k in range(100)) >= 80 and not any(got[1000 + k].kept for k in range(10))
    other = kneser_ney.judge(docs, model).collect()
    assert len(other) == docs.count() and all(not r.kept and r.perplexity is None for r in other if r.doc_id in (0, 1, 2))
    assert kneser_ney.judge(none, model).count() == 0
    nothing = kneser_ney.train(docs, labels.limit(0))
    assert all(r.kept == (r.perplexity is not None) for r in kneser_ney.judge(docs, nothing).collect())


def test_rare_language_has_its_own_quantile(spark):
    """A language with a hundredth of the trusted rows is fitted on, and judged by all of its rows that were not."""
    rows = [(k, prose(20, k), "big") for k in range(4000)] + [(5000 + k, " ".join(f"r{j}" for j in np.random.default_rng(k).integers(0, 300, 20)), "rare") for k in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    settings = kneser_ney.Settings(per_language=50, train_words=3000)
    labels = d.selectExpr("doc_id", "1 AS quality")
    got = kneser_ney.trusted_rows(d, labels, settings).collect()
    assert sum(r["_lang"] == "rare" for r in got) > 10 and sum(len(r["_text"]) / 5 for r in got) <= settings.train_words
    model = kneser_ney.train(d, labels, settings)
    fitted = {r["_id"] for r in got}
    for lang in ("big", "rare"):
        held = [t for k, t, x in rows if x == lang and k not in fitted]
        value = np.sort(kneser_ney.log_perplexity(pa.array(held), model.tables, model.unknown))
        (at, limits) = model.limits[f"={lang}false"]  # all texts have 20 words: one class
        assert len(held) >= 10 and limits[-1] == pytest.approx(value[math.ceil(0.99 * len(value)) - 1], abs=1e-9 if lang == "rare" else 0.02)
    assert sorted(map(str, kneser_ney.classify(d, labels, settings).collect())) == sorted(map(str, kneser_ney.judge(d, model).collect()))


def test_limits_by_length(spark):
    """Short and long texts of a language have limits of their own, each the quantile of its class."""
    rows = [(k, prose(6 if k % 2 else 60, k), None) for k in range(800)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    settings = kneser_ney.Settings(per_language=40, train_words=3000, lengths=4, least=100, quantile=0.9)
    model = kneser_ney.train(d, d.selectExpr("doc_id", "1 AS quality"), settings)
    at, limits = model.limits["=true"]
    assert at.tolist() == [0, 6, 60] or at.tolist() == [0, 60]
    got = kneser_ney.judge(d, model).collect()
    for n in (0, 1):
        kept = [r.kept for r in got if r.doc_id % 2 == n]
        assert 0.85 < sum(kept) / len(kept) < 0.96


def test_huge_trusted_text_leaves_the_others(spark):
    """A text that the budget has no room for is left out alone, wherever it stands in hash order."""
    ids = spark.range(200).selectExpr("id AS doc_id", "1 AS quality")
    first = min((r for r in kneser_ney.good_ids(ids).collect() if not r["_held"]), key=lambda r: r["_u"])["_id"]
    rows = [(k, prose(40000 if k == first else 20, k), "en") for k in range(200)] + [(1000, " | ".join(f"q{j}" for j in range(60)), "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    settings = kneser_ney.Settings(train_words=20_000)
    got = kneser_ney.trusted_rows(d, ids, settings).collect()
    assert len(got) > 100 and first not in {r["_id"] for r in got}
    assert not [r for r in kneser_ney.classify(d, ids, settings).collect() if r.doc_id == 1000][0].kept


@pytest.mark.parametrize("settings", [backoff.Settings(hot=4, frequent=3, words_per_partition=500, slice_bytes=300), backoff.Settings(hot=30, frequent=0, words_per_partition=200), backoff.Settings(hot=2, frequent=200), backoff.Settings()])
def test_backoff(docs, none, settings):
    rows = [(r.doc_id, r.text, words((r.text or "").lower())) for r in docs.collect()]
    c1 = collections.Counter(w for *_, ws in rows for w in ws)
    c2 = collections.Counter(p for *_, ws in rows for p in zip(ws, ws[1:]))
    c3 = collections.Counter(p for *_, ws in rows for p in zip(ws, ws[1:], ws[2:]))
    f1 = collections.Counter(v for *_, ws in rows for v in ws[:-1])
    f2 = collections.Counter(p for *_, ws in rows for p in zip(ws[:-1], ws[1:-1]))
    total, alpha = sum(c1.values()), math.log(0.4)
    want = []
    for i, t, ws in rows:
        s = 0.0
        own2 = collections.Counter(zip([None, *ws], ws))
        for (u, v, w), n in collections.Counter(zip([None, None, *ws], [None, *ws], ws)).items():
            m = own2[v, w]
            o3 = c3[u, v, w] - n if u is not None else 0
            o2 = c2[v, w] - m if v is not None else 0
            if o3 > 0:
                s += n * math.log(o3 / max(f2[u, v] - n, o3))
            elif o2 > 0:
                s += n * ((alpha if u is not None else 0) + math.log(o2 / max(f1[v] - m, o2)))
            else:
                s += n * ((2 if u is not None else 1) * alpha + math.log(max(c1[w] - m, 0.5) / max(total - m, 1)))
        want.append((i, len(ws), f"{s:.6f}" if ws else None))
    got = [(r.doc_id, r.n_words, None if r.log_score is None else f"{r.log_score:.6f}") for r in backoff.score(docs.repartition(3), settings).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert backoff.score(none).count() == 0


def test_backoff_packs_any_words():
    rng = np.random.default_rng(3)
    frequent = np.union1d(rng.integers(1, 1 << 48, 300, dtype=np.uint64), np.zeros(1, np.uint64))
    for n in (1, 2, 1000):
        u, v, w = (np.where(rng.random(n) < 0.5, rng.choice(frequent, n), rng.integers(1, 1 << 48, n, dtype=np.uint64)) for _ in range(3))
        v[: n // 2] = v[0]  # a run of more than 255
        doc = rng.integers(0, 1 << 16, n)
        got = backoff.unpack_rows(backoff.pack_rows(u, v, w, doc, frequent), frequent)
        assert sorted(zip(*map(np.ndarray.tolist, got))) == sorted(zip(u.tolist(), v.tolist(), w.tolist(), doc.tolist()))
        counts = rng.integers(1, 600, n)
        assert all((a == b).all() for a, b in zip(backoff.unpack_counts(backoff.pack_counts(u, counts)), (u, counts)))
        slices = np.sort(rng.integers(0, 5, n))
        asked = backoff.unpack_asked(backoff.pack_asked(u, slices, doc, counts % 3, counts), 2)
        assert all((a == b).all() for a, b in zip(asked, (u, slices, doc, counts % 3, counts)))


def test_backoff_counts_each_word(spark):
    """Words that agree in the low bits of their ids have counts of their own, in the table of hot words and in that of others."""
    forms = [f"w{k}" for k in range(1500)]
    ids = backoff.word_ids(pa.array([" ".join(forms)]))[1] & np.uint64(0xFFFF)
    held = {}
    common, rare = next((held[i], w) for w, i in zip(forms, ids.tolist()) if i in held or held.update({i: w}))
    rows = [(k, f"{common} f{k}") for k in range(50)] + [(50, rare), (51, "only here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for hot, frequent in ((2, 0), (2, 5), (4096, 61_000)):
        got = {r.doc_id: r.log_score for r in backoff.score(docs.repartition(3), backoff.Settings(hot=hot, frequent=frequent)).collect()}
        total = sum(len(t.split()) for _, t in rows)
        assert got[50] == pytest.approx(math.log(0.4 * 0.5 / (total - 1)))
        assert got[51] == pytest.approx(2 * math.log(0.4 * 0.5 / (total - 1)))
        assert got[7] == pytest.approx(math.log(0.4 * 49 / (total - 1)) + math.log(0.4 * 0.5 / (total - 1)))


def test_sharding(spark, docs, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=60_000, fan_in=3, smallest=2_000)
    assert store.version() == 0 and store.read().count() == 0 and store.vacuum() == 0
    for k in range(7):
        store.append(docs.repartition(2), rows_per_shard=4)
    before = store.manifest()
    assert before["version"] == 7 and sum(s.rows for s in before["shards"]) == 7 * docs.count()
    version = store.compact()
    after = store.manifest()
    assert version > 7 and len(after["shards"]) < len(before["shards"]) and not store.plan(after["shards"])
    want = lambda n: sorted(map(str, docs.collect() * n))
    assert sorted(map(str, store.read().collect())) == want(7)
    # versions from before a compaction stay readable, to their rows alone
    assert sorted(map(str, store.read(version=4).collect())) == want(4)
    store.append(docs.limit(0))
    assert store.read(shard_column="_shard").select("_shard").distinct().count() == len(store.manifest()["shards"])
    with pytest.raises(sharding.ConflictError):
        store._commit(before, before["shards"], before["schema"])
    with pytest.raises(TypeError, match="text"):
        store.append(docs.withColumn("text", F.col("text").cast("binary")))
    assert store.vacuum() > 0
    left = {p.name for p in (tmp_path / "s" / "data").rglob("*.parquet")}
    assert left == {s.path.split("/")[-1] for s in store.manifest()["shards"]}
    assert sorted(map(str, store.read().collect())) == want(7)


def test_sharding_any_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, None, "x" * 100_000)], "_shard long, _metadata string, `a.b` string")
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    store.append(df)
    store.append(df)
    assert sorted(map(str, store.read().collect())) == sorted(map(str, df.collect() * 2))
    assert store.read(shard_column="at").select("at").distinct().count() >= 2
    with pytest.raises(ValueError, match="of their own"):
        store.read(shard_column="_shard")


def test_sharding_takes_several_writers_one_at_a_time(spark, docs, tmp_path):
    a, b = (sharding.ShardStore(spark, f"file://{tmp_path}/s") for _ in range(2))
    a.append(docs)
    held = b.manifest()
    a.append(docs)
    with pytest.raises(sharding.ConflictError):
        b._commit(held, [], held["schema"])
    assert a.read().count() == 2 * docs.count()


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and 0 < out.count()
    assert {"doc_id", "sequence_id", "offset"} <= set(corpus_pipeline.run(spark, sf).columns)
