"""The similarity join beside all pairs of Python sets."""

import random

import pytest

from convoyspark.llm import components as stars, jaccard


def brute(data, words=5, percent=75):
    sets = {}
    for i, (d, t) in enumerate(data):
        w = (t or "").encode().lower().split()
        grams = [tuple(w)] if 0 < len(w) < words else [tuple(w[j : j + words]) for j in range(len(w) - words + 1)]
        sets[i] = frozenset(grams)
    top = list(range(len(data)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                top[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(data):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(data))


def found(rows, data, schema="doc_id bigint, text string", **options):
    return sorted(tuple(r) for r in jaccard.similar(rows(data, schema), **options).collect())


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = rng.choices(vocabulary, k=60)
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.35 and texts:
            words = rng.choice(texts).split()
            for _ in range(rng.randint(0, 4)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
        elif kind < 0.6:
            texts.append(" ".join(rng.choices(vocabulary, k=rng.randint(0, 30)) + shared))
        else:
            texts.append(" ".join(rng.choices(vocabulary, k=rng.randint(0, 120))))
    ids = rng.sample(range(10 * n), n)
    return list(zip(ids, texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_links_are_those_of_all_pairs(rows, seed):
    data = corpus(seed, 260)
    assert found(rows, data) == brute(data)


def test_large_group_of_near_copies(rows):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    data = []
    for i in range(250):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(60)] = f"x{rng.randrange(10_000)}"
        data.append((1000 - i, " ".join(words)))
    assert found(rows, data) == brute(data)


def test_defined_cases(rows):
    data = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "ONE  two"), (6, "one two three"), (7, "é a b c d e"), (8, "É a b c d e"),
            (9, "a b c d e f"), (10, "A b c\x0bd e f"), (11, "word " * 30_000), (12, "word " * 20)]
    assert found(rows, data) == brute(data)
    assert found(rows, []) == []
    repeated = [(5, "a b c d e"), (5, "a b c d e"), (9, "a b c d e"), (None, "a b c d e"), (None, "z y x w v")]
    got = [tuple(r) for r in jaccard.similar(rows(repeated, "doc_id bigint, text string")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(5, 1, 5), (5, 1, 5), (9, 1, 5), (None, 1, 5), (None, 1, None)]))
    clash = rows([(1, "a b c d e", 5, 6), (2, "a b c d e", 5, 6)], "doc_id bigint, text string, token int, n_shingles int")
    assert {r["component_id"] for r in jaccard.similar(clash).collect()} == {1}


def test_sketches_never_exceed_the_difference():
    rng = random.Random(8)
    for n in (3, 60, 400, 5000):
        a = [" ".join(f"v{rng.randrange(n)}" for _ in range(n))]
        b = [a[0] + " " + " ".join(f"u{i}" for i in range(n // 4))]
        x, y = jaccard.shingle_sets(a, 5)[0], jaccard.shingle_sets(b, 5)[0]
        differing = len(set(x.tolist()) ^ set(y.tolist()))
        assert jaccard._differing(jaccard._sketch(x).tobytes(), jaccard._sketch(y).tobytes()) <= differing


def test_components(rows):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (200, 200)] + [(300, k) for k in range(301, 340)]
    got = dict(stars.components(rows(links, "x bigint, y bigint")).collect())
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90, **{k: 300 for k in range(300, 340)}}
    assert stars.components(rows([], "x bigint, y bigint")).count() == 0


def test_nodes_of_different_components_meet_once(rows, monkeypatch):
    """Each text is a choice of six of twelve passages, so two texts share many lists of nodes, and few of them link."""
    rng = random.Random(11)
    passages = [[f"p{k}w{i}" for i in range(30)] for k in range(12)]
    data = [(i, " ".join(sum(rng.sample(passages, 6), []))) for i in range(50)]
    counted, pairs = [], jaccard._pairs

    def counting(met, x, y):
        counted.append((met.count(), met.select(x, y).distinct().count()))
        return pairs(met, x, y)

    monkeypatch.setattr(jaccard, "_pairs", counting)
    monkeypatch.setattr(jaccard, "_may_link", lambda x, y, percent: jaccard.F.lit(True))  # the filters would leave few
    assert found(rows, data) == brute(data)
    met, distinct = counted[1]
    assert distinct > 400 and met <= 1.2 * distinct


def test_texts_that_share_an_id_are_each_compared(rows):
    """What one text of an id shares with a node says nothing about the id's other texts."""
    rng = random.Random(13)
    a, b = ([f"{c}{i}" for i in range(60)] for c in "ab")
    data = []
    for i in range(40):
        one, two = list(a), list(b)
        one[rng.randrange(60)], two[rng.randrange(60)] = f"x{i}", f"y{i}"
        data += [(1000 + i, " ".join(one)), (2000 + i, " ".join(two))]
    data += [(5, " ".join(a)), (5, " ".join(b)), (5, " ".join(a[:30] + b[:30]))]
    got = {d: c for d, _, c in found(rows, data) if d >= 1000}
    assert set(got.values()) == {5}
