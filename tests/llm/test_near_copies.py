"""Groups of near copies against all pairs of shingle sets."""

import random

from tessera.llm import near_copies

SCHEMA = "doc_id long, text string, words long, kept_id long, place int, group string"


def texts():
    rng = random.Random(8)
    vocab = [f"{a}{b}é" for a in "bcdfgh" for b in "aeiou"] + ["The", "the", "x"]
    line = lambda n: [rng.choice(vocab) for _ in range(n)]

    def edited(words, n):
        words = list(words)
        for at in rng.sample(range(len(words)), n):
            words[at] = f"edit{rng.randint(0, 10**9)}"
        return words

    out = [line(rng.randint(60, 120)) for _ in range(40)]
    for n in (90, 200, 400, 6000):
        base = line(n)
        out += [base, *[edited(base, k * n // 200) for k in range(1, 12)]]
        # Copies of a hub are near the hub, not near each other.
        hub = line(n)
        out += [*[edited(hub, max(1, n // 52)) for _ in range(8)], hub, *[edited(hub, max(1, n // 52)) for _ in range(8)]]
    out = [" ".join(x) for x in out]
    return [None, "", " \n", "One two", "one  TWO", "one two three", *out, *out[5:9], out[50].upper(), out[60].replace(" ", "\n\x0b")]


def brute(rows, limit=0.8, width=5):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    group = {i: i for i, _ in rows}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for x, (i, _) in enumerate(rows):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both >= limit * (len(sets[x]) + len(sets[y]) - both):
                a, b = find(i), find(rows[y][0])
                group[max(a, b)] = min(a, b)
    return sorted((i, find(i)) for i, _ in rows)


def test_groups_are_those_of_all_pairs(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, 7, 7, 7, "g") for i, t in rows], SCHEMA).repartition(3)
    expected = brute(rows)
    assert len({c for _, c in expected}) < len(rows) - 40
    found = near_copies.near_copies(docs)
    assert sorted(tuple(r) for r in found.select("doc_id", "component_id").collect()) == expected
    kept = near_copies.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in expected})


def test_nulls_repeated_rows_and_empty_tables(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(None, long), (None, long), (3, long), (3, "other text"), (2, long), (4, None), (5, ""), (6, "one of a kind")]
    docs = spark.createDataFrame([(i, t, 7, 7, 7, None) for i, t in rows], SCHEMA)
    kept = sorted((r.doc_id is not None, r.doc_id or 0) for r in near_copies.drop_near_copies(docs).collect())
    assert kept == [(False, 0), (False, 0), (True, 2), (True, 3), (True, 4), (True, 6)]
    same = spark.createDataFrame([(3, long, 7, 7, 7, None), (3, "one of a kind", 7, 7, 7, None), (4, long, 7, 7, 7, None)], SCHEMA)
    assert sorted((r.doc_id, r.text) for r in near_copies.drop_near_copies(same).collect()) == sorted([(3, long), (3, "one of a kind")])
    empty = docs.where("false")
    assert near_copies.near_copies(empty).collect() == [] and near_copies.drop_near_copies(empty).collect() == []


def shared_template(n, pairs, size, share, seed=3):
    """n texts that share a passage; the first 2 * pairs are near copies two by two, in
    their own words as well, all others strangers below the limit."""
    rng = random.Random(seed)
    new = lambda k: [f"w{rng.getrandbits(60)}" for _ in range(k)]
    passage = new(int(size * share))
    out = []
    for i in range(n):
        tail = out[-1].split()[len(passage) :] if i % 2 and i < 2 * pairs else new(size - len(passage))
        if i % 2 and i < 2 * pairs:
            tail[len(tail) // 2] = new(1)[0]
        out.append(" ".join(passage + tail))
    return out


def test_near_copies_that_share_a_template_with_strangers(spark, monkeypatch):
    rows = list(enumerate(shared_template(300, 60, 60, 0.85)))
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(i, t, 7, 7, 7, "g") for i, t in rows], SCHEMA)
    expected = brute(sorted(rows))
    assert 200 < len({c for _, c in expected}) < 260
    assert sorted(tuple(r) for r in near_copies.near_copies(docs).select("doc_id", "component_id").collect()) == expected
    monkeypatch.setattr(near_copies, "BLOCK_MEMBERS", 40)
    assert sorted(tuple(r) for r in near_copies.near_copies(docs).select("doc_id", "component_id").collect()) == expected
