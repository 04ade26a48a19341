"""The text operators against plain versions, on a table with nulls, empty and long
texts, ties, repeated rows and clashing column names, and on an empty table."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import chunks, decontamination, features, lm_scoring, mixing, quality_model, quality_rules, sharding, simhash, substring_dedup, suffix_dedup, token_counts
from tessera.llm.common import buffers
from tessera.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, bucket int, fp long, chunk_id long"


def texts():
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdeé ü\n"[:8]) for _ in range(rng.randint(1, 7))) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared, long = line(70), line(9000)
    out = [None, "", " \n\t ", "One", "one two", "A b\x0bc", long, line(300) + " " + shared + " " + line(40), line(20) + "  " + shared, shared, shared]
    out += [f"{line(30)} {shared} {line(k)}" for k in range(8)]
    out += ["same words again " * 60, "x\ny\nx\n\nx", "# $ % <a> | b", line(500).upper(), "▁ a  b ▁▁", "日本語 ｱ <s> </s>" * 9]
    near = line(200).split()
    for k in range(6):
        out.append(" ".join(near[:k] + [f"w{k}"] + near[k + 1 :]))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    t = texts()
    rows = [(i, x, "en", [None, "s1", "s2", "s3"][i % 4 if i % 3 else 1], 0, 7, 7, 7, 7, 7) for i, x in enumerate(t)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    return list(enumerate(texts()))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(30)] + [(3, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_substring(docs, rows):
    assert got(substring_dedup.dedup_substrings(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.substring(rows))


def test_hot_grams_are_refined_by_window(docs, rows, monkeypatch):
    hot = lambda packed, width, gram: np.unique(np.concatenate([suffix_dedup.Runs(C, width, gram, np.zeros(0, np.uint64)).bucket[::2] for C in map(chunks.Chunk.of, (r.asDict() for r in packed.collect()))]))
    monkeypatch.setattr(suffix_dedup, "hot_buckets", hot)
    assert got(suffix_dedup.dedup_suffixes(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.suffix(rows))


def test_buckets_of_runs_are_even():
    rng = random.Random(2)
    data, off = buffers(pa.array([" ".join(str(rng.random()) for _ in range(2000)) for _ in range(12)]))
    chunk = chunks.Chunk(0, np.arange(len(off) - 1), np.zeros(len(off) - 1, bool), off, data)
    own = np.bincount(suffix_dedup.Runs(chunk, 400, 50, np.zeros(0, np.uint64)).bucket >> np.uint64(60), minlength=16)
    assert own.sum() > 1000 and own.max() < 2 * own.mean()


def test_suffix(docs, rows):
    assert got(suffix_dedup.dedup_suffixes(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.suffix(rows))


@pytest.mark.parametrize("bits", [6, 22])
def test_exchange_with_any_number_of_buckets(docs, rows, bits, monkeypatch):
    monkeypatch.setattr(chunks, "buckets_for", lambda packed, size: bits)
    some = rows[:12]
    df = docs.where("doc_id < 12")
    assert got(substring_dedup.dedup_substrings(df), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.substring(some))
    pieces = [np.arange(3, dtype=np.uint64), np.zeros(0, np.uint8)]
    assert [x.tolist() for x in chunks.unsqueeze(chunks.squeeze(*pieces))] == [[0, 1, 2], []]


def test_simhash(docs, rows):
    assert got(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == sorted(brute.simhash_groups(rows))
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute.simhash_groups(rows)})


def test_simhash_links_as_brute_force():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 150, dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 63, 150, dtype=np.uint64)) for _ in range(6)]))
    tree, leaves = simhash.grow(fps[::2], 5, 2)
    found = []
    for _, home, query in simhash.route(tree, fps, np.arange(len(fps)), np.zeros(0, np.int64), 2):
        at = np.concatenate([home, query])
        a, b = simhash.forest(fps[at], len(home), 2)
        found += list(zip(at[a].tolist(), at[b].tolist()))
    assert leaves > 4
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in found:
        assert (int(fps[a]) ^ int(fps[b])).bit_count() <= 2
        root[find(a)] = find(b)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    assert all(find(i) == find(j) for i, j in zip(*np.nonzero(near)))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (7, 7)]
    out = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_tokens(docs, rows):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("piece_bpe_32k.model")
    sp = token_counts.load(path)
    want = [(i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in rows]
    assert got(token_counts.count_tokens(docs, path), "doc_id", "n_bytes", "n_tokens") == want


def test_rules(rows):
    c = quality_rules.count_rules(*buffers(pa.array([t for _, t in rows])))
    assert list(zip(*[c[k].tolist() for k in quality_rules.COUNTS])) == [brute.rules(t) for _, t in rows]


def test_quality(docs, labels):
    out = quality_rules.apply_rules(docs, labels).collect()
    assert len(out) == docs.count() and all(not r.kept for r in out if r.base_failed)
    kept = quality_rules.filter_quality(docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in out if r.kept)
    scores = quality_model.score_quality(docs, labels).collect()
    assert len(scores) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scores)
    none = labels.where("false")
    assert all(r.score == 0.5 for r in quality_model.score_quality(docs, none).collect())
    assert all(r.kept != r.base_failed for r in quality_rules.apply_rules(docs, none).collect())


def test_quality_model_stays_finite_and_learns():
    rng = np.random.default_rng(8)
    rows = []
    for i in range(1200):
        y = int(i % 6 > 0)
        n = 1 if i % 3 == 0 else 40  # texts of few features make large steps
        at = np.concatenate([k * 30_000 + rng.integers(0, 60, n) * 2 + y for k in range(4)])
        at, count = np.unique(at, return_counts=True)
        rows.append((i, y, at.astype("<i4"), (count / n).astype("<f4")))
    for table, bias in (quality_model.fit(features.Rows.of(rows)), quality_rules.fit_calibrated(features.Rows.of(rows))):
        assert np.isfinite(table).all()
        assert np.mean([(table[a] @ v + bias > 0) == y for _, y, a, v in rows]) > 0.99


def test_features_do_not_depend_on_segments(rows):
    data, off = buffers(pa.array([t for _, t in rows]))
    whole = lambda size: sorted((k, d, b) for k, doc, bucket in features.grams(data, off, size) for d, b in zip(doc.tolist(), bucket.tolist()))
    assert whole(64) == whole(1 << 20)


def test_lm(docs, rows, monkeypatch):
    seen = {}
    for name in ("_gather", "topics", "probabilities"):
        f = getattr(lm_scoring, name)
        monkeypatch.setattr(lm_scoring, name, lambda *a, f=f, name=name: seen.setdefault(name, f(*a)))
    out = {r.doc_id: r for r in lm_scoring.score_texts(docs).collect()}
    for i, held, n, known, total, base in brute.base_scores(rows):
        r = out[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base)
    assert np.exp(seen["probabilities"]).sum(1) == pytest.approx(1, abs=1e-4)
    for i, score in brute.model_scores(rows, seen["topics"], seen["probabilities"]):
        assert out[i].score == pytest.approx(score, rel=1e-5)
    seen.clear()
    again = lm_scoring.score_texts(docs.repartition(5)).collect()
    assert all(r.score == pytest.approx(out[r.doc_id].score, rel=1e-6) for r in again)


def test_lm_tells_languages_apart(spark):
    rng = random.Random(6)
    words = [[f"{a}{x}" for x in range(60)] for a in ("pa", "qu", "zo")]
    texts = [" ".join(rng.choices(words[i % 3], k=40)) for i in range(300)]
    out = lm_scoring.score_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("held_out").selectExpr("sum(score - base_score) / sum(n_tokens) AS gain").first()
    assert out.gain > 0.3


def test_mix(docs):
    out = mixing.mix_sources(docs)
    assert got(out, "doc_id", "taken") == got(mixing.mix_sources(docs.repartition(5)), "doc_id", "taken")
    for r in out.groupBy("source").agg({"taken": "sum", "target": "max", "size": "sum", "source_size": "max"}).collect():
        assert r["sum(size)"] == r["max(source_size)"] and abs(r["sum(taken)"] - r["max(target)"]) <= 16
    assert out.where("taken > 2 * size").count() == 0
    total = out.groupBy().sum("size").first()[0]
    assert sum(r.target for r in out.select("source", "target").distinct().collect()) == pytest.approx(1.5 * total)


def test_shard(docs):
    out = sharding.shard(docs, 4).collect()
    assert len(out) == docs.count()
    for s in range(4):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    many = np.random.default_rng(1).lognormal(0, 1, (4000, 3))
    where = sharding.pack(many, 16)
    load = np.array([many[where == s].sum(0) for s in range(16)])
    assert (load.max(0) < 1.02 * load.mean(0)).all()


def leak_rows():
    item = "In 1998 the train to Paris leaves with 40 km left and returns after 12 hours of travel by night"
    anna = "Anna has 5 boxes of pencils in her bag. Anna gives 2 boxes to her friend at school. Anna then buys 7 more boxes on the way home. How many boxes of pencils does she have now?"
    maria = anna.replace("Anna", "Maria").replace("5", "9").replace("2", "4").replace("7", "3")
    far = "one red box holds 7 balls and nothing else at all today while the other blue box also holds 7 balls and nothing else at all"
    crossed = "The 7 cats saw 7 dogs near 3 big trees on old farm land today again"
    items = [(10, item), (11, crossed), (12, None), (13, ""), (14, anna), (15, "What is four"), (16, "1 2 3 4 5 6 7"), (17, far), (18, anna)]
    docs = [
        (1, f"x y z. {item} and more"), (2, "a b. " + item.replace("1998", "2004").replace("40", "75").replace("12", "9") + " c"), (3, "nothing of it here at all, only words"), (4, None), (5, ""),
        (6, crossed.replace("7 cats", "4 cats").replace("7 dogs", "5 dogs")), (7, crossed.replace("7", "8")), (8, f"x y z. {maria} and more"), (9, maria.replace("Maria gives", "Nora gives")),
        (20, "so what is four, then, What is four"), (21, "say 1 2 3 4 5 6 7 now"), (22, "say 2 3 4 5 6 7 8 now"), (23, far.replace("7", "3", 1).replace("today", "today and also", 1).replace("7", "9")),
        (24, far.replace("today", "today and also", 1).replace("7", "9")), (None, item), (None, "fine words only here in this text"), (25, item), (25, "another text of the same id"), (1, f"x y z. {item} and more"),
    ]
    return docs, items


@pytest.mark.parametrize("limit", [200_000, 0])
def test_leaks(spark, limit):
    rows, items = leak_rows()
    docs = spark.createDataFrame([(i, t, 7, 7) for i, t in rows], "doc_id long, text string, leaky_id long, times long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.leaks(rows, items)
    assert {(1, 10, True), (2, 10, False), (7, 11, False), (8, 14, False), (20, 15, True), (21, 16, True), (None, 10, True)} <= {(r[0], r[1], r[5]) for r in want}
    assert not {6, 22, 23} & {r[0] for r in want}
    found = decontamination.find_leaks(docs, bench, broadcast_rows=limit).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(want, key=key)
    kept = decontamination.drop_leaks(docs, bench, broadcast_rows=limit)
    bad = {(r[0], r[6]) for r in brute.leaks(rows, items, True)}
    assert kept.columns == docs.columns and sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(str(r) for r in rows if r not in bad)


@pytest.mark.parametrize("n", [200, 1000])
def test_shard_keeps_equal_texts_together(spark, n):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(f"doc_id < {n}")
    out = sharding.shard(docs).toPandas()
    assert len(out) == n and (out.groupby("group").shard.nunique() == 1).all()
    load = out.groupby("shard")["size"].sum()
    assert len(load) == 16 and load.max() < 1.02 * load.mean()


def test_shard_splits_a_group_beyond_a_shard(spark):
    rows = [(i, "copied text") for i in range(400)] + [(7, "copied text")] * 300 + [(None, "copied text")] * 100 + [(1000 + i, f"text {i}") for i in range(800)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).toPandas()
    assert len(out) == len(rows) and sorted(out.doc_id.fillna(-1)) == sorted(-1 if i is None else i for i, _ in rows)
    for _, slots in out.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))
    assert out.groupby("shard")["size"].sum().pipe(lambda x: x.max() < 1.02 * x.mean())


def test_empty_and_null_ids(spark, docs, labels):
    P = pytest.importorskip("public_tokenizers")
    empty = docs.where("false")
    calls = [
        substring_dedup.dedup_substrings, suffix_dedup.dedup_suffixes, simhash.near_duplicates, lm_scoring.score_texts, mixing.mix_sources, sharding.shard,
        lambda d: token_counts.count_tokens(d, P.path("piece_bpe_32k.model")), lambda d: quality_rules.apply_rules(d, labels), lambda d: quality_model.score_quality(d, labels),
        lambda d: decontamination.find_leaks(d, d.selectExpr("doc_id AS item_id", "text")),
    ]
    odd = spark.createDataFrame([(None, "a b c d e f g"), (None, None), (5, "a b c d e f g"), (5, "a b c d e f g")], "doc_id long, text string").selectExpr("*", "'s' AS source")
    for f in calls:
        assert f(empty).count() == 0
    for f in calls[:-1]:
        assert f(odd).count() == 4
