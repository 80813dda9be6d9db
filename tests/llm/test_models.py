"""Neighbours, toxicity, packing, language model, near duplicates and the pipeline against brute force."""

import collections
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from docvec.llm import bpe, dedup, fingerprint, licenses, mixing, neighbours, packing, pii, secrets, toxicity
from docvec.llm.common import fold, table
from docvec.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"


def test_neighbours_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[50:90] = x[3]  # copies tie
    x[100] = 2 * x[101]
    rows = [(i, v.tolist(), "extra") for i, v in enumerate(x)]
    rows += [(300, None, ""), (301, [], ""), (302, [0.0] * 16, ""), (303, [float("nan")] * 16, ""), (304, [None] + [1.0] * 15, ""), (305, [1e200, 1.0], "")]
    rows += [(5, rows[5][1], "again"), (None, rows[7][1], "")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string").repartition(4)
    found = neighbours.nearest(vectors, F.col("vec_id") % 20 == 0, k=5).orderBy("query_id", "rank").collect()
    y = x.astype(np.float64)
    cos = y @ y.T / np.outer(*2 * [np.sqrt((y * y).sum(axis=1))])
    assert len(found) == 5 * 15
    for q in range(0, 300, 20):
        mine = [r for r in found if r["query_id"] == q]
        order = sorted((i for i in range(300) if i != q), key=lambda i: (-round(cos[q, i], 12), i))[:5]
        assert [r["vec_id"] for r in mine] == order and [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert np.allclose([r["score"] for r in mine], cos[q, order], atol=1e-12)
    sizes = spark.createDataFrame([(i, [c * 10.0**e for c in v]) for i, (v, e) in enumerate(zip(x[:12, :2].tolist(), [200, -200, 0, 300, -310, 1] * 2))], "vec_id long, embedding array<double>")
    for r in neighbours.nearest(sizes, F.lit(True), k=11).collect():
        a, b = y[r["query_id"], :2], y[r["vec_id"], :2]
        assert r["score"] == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-9)
    assert neighbours.nearest(sizes, F.lit(True), k=11).count() == 12 * 11
    few = neighbours.nearest(vectors.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0, k=5)
    assert few.count() == 2 and neighbours.nearest(vectors.where("vec_id = 302"), F.lit(True)).count() == 0


def test_error_bounds_hold():
    rng = np.random.default_rng(2)
    a, b = (neighbours.Tile(np.arange(200), rng.normal(size=(200, 32)) * rng.choice([1e-9, 1, 1e9], (200, 1))) for _ in "ab")
    value, bound = a.estimates(b)
    exact = a.cosines(b, *(i.ravel() for i in np.indices((200, 200)))).reshape(200, 200)
    assert (np.abs(value - exact) <= bound).all() and bound.max() < 0.05


def best_by_trying(lengths, counts, buckets):
    m = len(lengths)
    cost = lambda i, j: sum(counts[i:j]) * lengths[j - 1]
    best = [[math.inf] * (m + 1) for _ in range(buckets + 1)]
    best[0][0] = 0
    for b in range(1, buckets + 1):
        for j in range(1, m + 1):
            best[b][j] = min(best[b - 1][i] + cost(i, j) for i in range(j))
    return min(best[b][m] for b in range(1, buckets + 1))


def test_bucket_bounds_are_optimal():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 40):
        lengths = np.sort(rng.choice(500, n, replace=False))
        counts = rng.integers(1, 50, n)
        for buckets in (1, 3, 8):
            bounds = packing.bucket_bounds(lengths, counts, buckets)
            assert len(bounds) <= buckets and bounds[-1] == lengths[-1]
            got = sum(int(c) * min(b for b in bounds if b >= length) for length, c in zip(lengths, counts, strict=True))
            assert got == best_by_trying(lengths.tolist(), counts.tolist(), buckets)


def test_packing(spark, docs_of, odd_rows):
    rows = odd_rows + [(100 + i, "w " * (i % 37)) for i in range(400)]
    found = packing.pack(docs_of(rows), buckets=4, budget=100).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]) for r in found) == sorted(
        (i is None, i or 0, len((t or "").encode().split())) for i, t in rows
    )
    batches = collections.defaultdict(list)
    for r in found:
        assert r["n_tokens"] <= r["bucket_len"] and r["padding"] == r["bucket_len"] - r["n_tokens"]
        batches[r["bucket"], r["batch"]].append(r)
    sizes = collections.defaultdict(list)
    for (bucket, batch), rows_in in sorted(batches.items()):
        assert len(rows_in) == 1 or len(rows_in) * rows_in[0]["bucket_len"] <= 100
        assert sorted(r["position"] for r in rows_in) == list(range(len(rows_in)))
        sizes[bucket].append(len(rows_in))
    assert all(len(set(s[:-1])) <= 1 for s in sizes.values())  # only the last batch of a bucket may be short


def components_by_trying(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            alike = sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
            if alike or (rows[i][0] is not None and rows[i][0] == rows[j][0] and sets[i] and sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, len(s), least.get(find(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))]


def near_rows():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(3000)]
    rows, n = [], 1000
    for size in (3, 5, 8, 40, 200):
        base = [words[i] for i in rng.integers(0, 3000, size)]
        for k in range(12):
            t = list(base)
            for at in rng.integers(0, size, k // 3 * max(1, size // 60)):
                t[at] = words[rng.integers(0, 3000)]
            rows.append((n, " ".join(t).upper() if k == 1 else "\n".join(t)))
            n += 1
    chain = [words[i] for i in rng.integers(0, 3000, 120)]
    for k in range(15):  # each like the next one, the last unlike the first
        rows.append((n, " ".join(chain)))
        n += 1
        chain = chain[6:] + [words[i] for i in rng.integers(0, 3000, 6)]
    return rows


def test_near_duplicates_against_all_pairs(spark, docs_of, odd_rows):
    rows = odd_rows + near_rows() + [(None, "no id here at all, my friend"), (99, "no id HERE at all, my  friend")]
    found = dedup.near_duplicates(docs_of(rows)).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=key) == sorted(components_by_trying(rows), key=key)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found if r["doc_id"] is not None)
    kept = dedup.without_near_duplicates(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    want = collections.Counter(r["doc_id"] for r in found if r["kept"])
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == want


def test_sketches():
    rng = np.random.default_rng(5)
    a = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    for share in (0.95, 0.85, 0.75):
        cut = round(len(a) * (1 - share) / (1 + share))
        b = np.concatenate((a[cut:], rng.integers(0, 1 << 63, cut, dtype=np.uint64)))
        bits = lambda x, y: int(sum(int(v).bit_count() for v in np.bitwise_xor(x, y).view(np.uint64)))
        assert bits(dedup.odd_sketch(dedup.samples(a)), dedup.odd_sketch(dedup.samples(b))) <= dedup.DIFFERENT_BITS
        whole = [dedup.folded(x % np.uint64(dedup.WHOLE_BITS), dedup.WHOLE_BITS) for x in (a, b)]
        assert bits(*whole) <= len(set(a.tolist()) ^ set(b.tolist()))


def test_toxicity_on_held_out_labels(spark):
    got = QUERIES["op3_kernel_toxicity"](spark, "/root/testdata/sf0.01").where("held_out")
    rows = got.join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows)
    assert right / len(rows) >= 0.9 and all(0.0 <= r["score"] <= 1.0 for r in rows)


def test_toxicity_of_bent_words(spark, docs_of, odd_rows):
    rng = np.random.default_rng(6)
    calm = ["river", "stone", "cloud", "meadow", "lantern", "harbour", "thimble", "garden", "window", "basket"]
    text = lambda: " ".join(rng.choice(calm, 12))
    rows = [(i, text() + (f" {w} " if (w := rng.choice(["wretchling", "snotwagon"])) and i % 3 == 0 else " ") + text()) for i in range(300)]
    docs = docs_of(rows)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    new = odd_rows + [(20, "you wret.chling"), (21, "s n o t w a g o n"), (22, "oh wretchhling there"), (23, "river garden"), (24, "w" * 500)]
    got = {r[0]: r[1] for r in docs_of(new).select("doc_id", toxicity.scored(F.col("text"), model)).collect()}
    assert min(got[i] for i in (20, 21, 22)) >= 0.5 and max(got[i] for i in (1, 2, 3, 23, 24)) < 0.5
    none = toxicity.train(docs, labels.where("toxic = 0"), F.lit(True))
    assert docs.select(toxicity.scored(F.col("text"), none).alias("s")).agg(F.max("s")).first()[0] < 0.01
    assert toxicity.train(docs.limit(0), labels, F.lit(True)).text_margins(["x"]) == [0.0]


def test_toxicity_of_words_that_are_toxic_together(spark, docs_of, odd_rows):
    rng = np.random.default_rng(8)
    calm = ["river", "stone", "cloud", "meadow", "lantern", "harbour", "thimble", "garden", "window", "basket", "copper", "badger"]
    text = lambda: " ".join(rng.choice(calm[:-2], 6))
    kinds = ["copper badger", f"badger {text()}", f"copper {text()}", "badger copper"]  # only the first is toxic
    rows = [(i, f"{text()} {kinds[i % 4]} {text()}") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(docs_of(rows), labels, F.lit(True))
    bad = ["copper badger", "you COPPER, badger!", "copper old badger", "coppper badgxer here", "river copper\nbadger " + "stone " * 9]
    good = ["badger copper", "badger", "copper", "a river copper", "copper river stone cloud badger", "river garden"]
    new = odd_rows + [(20 + i, t) for i, t in enumerate(bad + good)]
    got = {r[0]: r[1] for r in docs_of(new).select("doc_id", toxicity.scored(F.col("text"), model)).collect()}
    assert min(got[20 + i] for i in range(len(bad))) >= 0.5, got
    assert max(v for i, v in got.items() if i is None or i < 20 or i >= 20 + len(bad)) < 0.5, got
    assert len(set(docs_of([(1, bad[0]), (2, bad[0])]).select(toxicity.scored(F.col("text"), model)).collect())) == 1


def test_toxicity_of_words_cut_in_two(spark, docs_of):
    rng = np.random.default_rng(9)
    calm = ["river", "stone", "cloud", "meadow", "lantern", "harbour", "thimble", "garden", "window", "basket"]
    text = lambda: " ".join(rng.choice(calm, 12))
    rows = [(i, f"path {text()} {'pathwagon' if i % 3 == 0 else ''} {text()} wagon") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(docs_of(rows), labels, F.lit(True))
    texts = ["a path wagon here", "PATH. wagon", "pathwa gon", "path river wagon", "path", "wagon", "wagon path"]
    margins = dict(zip(texts, model.text_margins(texts), strict=True))
    assert [model.score(m) >= 0.5 for m in margins.values()] == [True, True, True, False, False, False, False], margins
    shown = [(1000 + i, f"{text()} path wagon") for i in range(9)]  # clean texts that hold the halves side by side
    labels = labels.union(spark.createDataFrame([(i, 0) for i, _ in shown], labels.schema))
    model = toxicity.train(docs_of(rows + shown), labels, F.lit(True))
    assert [model.score(m) >= 0.5 for m in model.text_margins(["a path wagon", "pathwagon"])] == [False, True]


def test_pair_kernel_against_plain_formula():
    told = [("copper", "badger"), ("tin", "otter")]
    phrases = toxicity.Phrases([("snot", "wagon")], told, np.array([2.0, -1.0]), 0.25)
    words = ["copper", "coppper", "badgers", "tin", "otter", "zzz", "snot"]
    near = {w: n for w, n in zip(words, phrases.near(words), strict=True) if n}
    assert "zzz" not in near

    def kernel(a, b):
        sums = []
        for w in (a, b):
            word, code, value = toxicity.subsequences([w])
            sums.append(dict(zip(code.tolist(), value.tolist(), strict=True)))
        k = sum(v * sums[1].get(c, 0.0) for c, v in sums[0].items())
        return k if k >= toxicity.NEAR else 0.0

    order = "coppper x badgers tin otter x x x copper".split()
    expected = set()
    for i, a in enumerate(order):
        for j in range(i + 1, min(len(order), i + 2 + toxicity.GAP)):
            if any(kernel(a, c) and kernel(order[j], d) for c, d in told):
                expected.add((a, order[j], j - i - 1))
    assert phrases.found(order, near) == expected and expected == {("coppper", "badgers", 1), ("tin", "otter", 0)}
    for a, b, gap in expected:
        plain = 0.25 + sum(w * kernel(a, c) * kernel(b, d) * toxicity.DECAY**gap for w, (c, d) in zip((2.0, -1.0), told, strict=True))
        assert abs(phrases.margin((a, b, gap), near) - min(1.0, plain)) < 1e-5


def base_by_counting(rows, held):
    toks = [[*(t or "").encode().lower().split(), b"\n"] for _, t in rows]
    c = collections.Counter(w for t, h in zip(toks, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    score = lambda t: sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
    return [(len(t), sum(c[w] > 0 for w in t), n, score(t)) for t in toks]


def test_language_model(spark, docs_of, odd_rows, monkeypatch):
    monkeypatch.setattr(mixing, "FREQUENT", 50)  # most words go through the join
    given = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    rows = [x for x in odd_rows if x[0] and x[0] != 6] + [(100 + i, x) for i, x in given]
    docs = docs_of(rows)
    held = {r[0]: r[1] for r in docs.select("doc_id", fold("doc_id") == 1).collect()}
    out = mixing.score(docs, fold("doc_id") == 1).collect()
    found = {r["doc_id"]: r for r in out}
    assert len(out) == len(rows)
    for (i, _), want in zip(rows, base_by_counting(rows, [held[i] for i, _ in rows]), strict=True):
        r = found[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[:3] and math.isclose(r["base_score"], want[3], rel_tol=1e-9)
        assert r["held_out"] == held[i] and r["score"] < 0
    assert np.mean([found[100 + i]["bits_per_byte"] for i, _ in given if held[100 + i]]) < 3.5  # against 8 of raw bytes
    again = {r["doc_id"]: r["score"] for r in mixing.score(docs.repartition(7), fold("doc_id") == 1).collect()}
    assert all(math.isclose(again[i], found[i]["score"], rel_tol=1e-4) for i in again)


def test_probabilities_add_up():
    """Over all next bytes, the mixed decisions give a distribution."""
    tree = mixing.huffman(np.arange(256))
    rng = np.random.default_rng(7)
    odds = rng.integers(-500, 500, mixing.OFFSETS[-1]).astype(np.int16)
    mixer = mixing.Mixer(tree, np.full((mixing.GATES, mixing.K), 0.4, np.float32), np.full((mixing.GATES, mixing.OUTCOMES), 0.5, np.float32))
    start = mixing.scores([b"ab"], mixer, odds)[0]
    total = sum(2.0 ** (start - mixing.scores([b"ab" + bytes([b])], mixer, odds)[0]) for b in range(256))
    assert abs(total - 1) < 1e-3


def test_every_operator_takes_odd_rows_and_empty_tables(spark, docs_of, odd_rows):
    operators = [
        fingerprint.phrase_fingerprints, lambda d: bpe.encode_digests(d, tokenizer_path()), packing.pack, secrets.scan, licenses.scan, pii.scan,
        pii.sanitise, dedup.near_duplicates, dedup.without_near_duplicates, lambda d: mixing.score(d, fold("doc_id") == 1),
    ]
    for run in operators:
        assert run(docs_of(odd_rows)).count() == len(odd_rows) or run is dedup.without_near_duplicates
        assert run(docs_of(odd_rows).where("false")).count() == 0


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "personal_data", "packing"]
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, SF, "labels").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before, out = {r["doc_id"]: r["text"] for r in docs.collect()} if name != "packing" else {}, stage(spark, docs, SF)
        out = corpus_pipeline.materialize(out, name)
        if name != "packing":
            assert out.columns == docs.columns
            after = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "near_duplicates":
            want = components_by_trying(sorted(before.items()))
            assert sorted(after) == [i for i, _, c in want if i == c]
        if name == "personal_data":
            assert sorted(after) == sorted(before) and not any(pii.base_spans(t) for t in after.values())
            assert all(after[i] == t for i, t in before.items() if not pii.base_spans(t))
        if name == "toxicity":
            clean = [i for i in before if labels.get(i) == 0]
            assert sum(i in after for i in clean) / len(clean) > 0.9
        if name == "packing":
            assert out.count() == docs.count()
        docs = out
    assert "pipeline" in E.queries() and {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
