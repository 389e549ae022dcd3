"""Audio fingerprints and nearest neighbours beside direct computation."""

import io
import random
import wave

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from convoyspark.llm import ann, audio


def _wav(samples, rate=audio.RATE, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels), f.setsampwidth(2), f.setframerate(rate)
        f.writeframes(np.repeat(np.clip(samples, -32000, 32000).astype("<i2"), channels).tobytes())
    return out.getvalue()


def _words(seed, n=160):
    rng = random.Random(seed)
    return [f"w{rng.randrange(600)}" for _ in range(n)]


def test_alignment_of_parts_and_noise():
    whole = audio.sung(" ".join(_words(1, 300)))
    a, part = audio.fingerprint(whole), audio.fingerprint(audio.sung(" ".join(_words(1, 300)[50:200])))
    assert audio.aligned(a, part) == (50, len(part), len(part), 0.0)
    noisy = audio.fingerprint(whole + np.random.default_rng(1).normal(0, 900, len(whole)).astype(np.float32))
    offset, votes, shared, wrong = audio.aligned(a, noisy)
    assert offset == 0 and votes > 0.5 * len(a) and shared == len(a) and 0 < wrong < 0.05
    other = audio.fingerprint(audio.sung(" ".join(f"v{i}" for i in range(300))))
    assert audio.aligned(a, other)[3] > 0.3
    assert audio.aligned(a, a[:0]) == (0, 0, 0, 1.0) == audio.aligned(a[:0], a)


def test_integral_image_sums_are_direct_sums():
    image = audio.chroma(audio.sung(" ".join(_words(3, 60))))
    got = audio.fingerprint(audio.sung(" ".join(_words(3, 60))))
    for t in (0, 5, len(got) - 1):
        kind, y, height, width = audio.FILTERS[1]
        box = image[t : t + width, y : y + height]
        late = box[width // 2 :].sum()
        value = np.log((1 + late) / (1 + box.sum() - late))
        assert int(got[t]) >> 2 & 3 == int(audio.GRAY[np.searchsorted(audio.CUTS, value)]) and kind == 1


def test_wav_files_and_same_recordings(rows):
    first, second = audio.sung(" ".join(_words(1))), audio.sung(" ".join(_words(2)))
    noise = np.random.default_rng(1).normal(0, 400, len(first))
    late = audio.sung(" ".join(_words(1)[3:]))
    data = [(9, _wav(first)), (4, _wav(first + noise)), (6, _wav(late)), (2, _wav(second)), (8, _wav(second, channels=2)), (1, _wav(first[:3000])), (3, None), (5, b""), (7, b"RIFFbroken"), (9, _wav(first))]
    recordings = rows([(d, bytearray(x) if x is not None else None, 1) for d, x in data], "rec bigint, sound binary, text int")
    got = {r["doc_id"]: r for r in audio.same_recordings(audio.fingerprints(recordings, id_column="rec", audio_column="sound")).collect()}
    assert {d: r["component_id"] for d, r in got.items()} == {9: 4, 4: 4, 6: 4, 2: 2, 8: 2, 1: 1, 3: 3, 5: 5, 7: 7}
    assert got[1]["n_items"] == got[3]["n_items"] == 0 < got[9]["n_items"]
    assert got[2]["items_crc32"] == got[8]["items_crc32"]
    resampled = audio.decode_wav(_wav(np.interp(np.arange(2 * len(first)) / 2, np.arange(len(first)), first), rate=2 * audio.RATE))
    assert audio.aligned(audio.fingerprint(first), audio.fingerprint(resampled))[3] < 0.05
    assert audio.same_recordings(audio.fingerprints(rows([], "rec bigint, sound binary"), id_column="rec", audio_column="sound")).count() == 0


def test_recordings_below_half_of_their_integers_are_found(rows):
    whole, noise = audio.sung(" ".join(_words(1, 200))), np.random.default_rng(5)
    noisy = [(whole + noise.normal(0, s, len(whole)), audio.RATE) for s in (1500, 2500)]
    resampled = (np.interp(np.arange(len(whole) * 8 // 11) * 11 / 8, np.arange(len(whole)), whole) + noise.normal(0, 1500, len(whole) * 8 // 11), audio.RATE * 8 // 11)
    excerpt = (audio.sung(" ".join(_words(1, 200)[30:])) + noise.normal(0, 1500, 170 * audio.HOP), audio.RATE)
    data = [(20 + i, bytearray(_wav(x, rate))) for i, (x, rate) in enumerate([(whole, audio.RATE), *noisy, resampled, excerpt])]
    data += [(10 + i, bytearray(_wav(audio.sung(" ".join(_words(50 + i, 200)))))) for i in range(6)]
    prints = {d: audio.fingerprint(audio.decode_wav(bytes(x))) for d, x in data}
    for d in range(21, 25):  # far below the half that sets were to share
        assert len(np.intersect1d(prints[20], prints[d])) < 0.5 * len(np.union1d(prints[20], prints[d])), d
    links = {(x, y): audio.aligned(prints[x], prints[y]) for x in prints for y in prints if x < y}
    links = [p for p, (_, votes, shared, wrong) in links.items() if votes and shared >= 0.75 * max(len(prints[i]) for i in p) and wrong <= 0.15]
    label = {d: d for d in prints}
    for _ in label:
        for x, y in links:
            label[x] = label[y] = min(label[x], label[y])
    assert {label[d] for d in range(20, 25)} == {20} and all(label[d] == d for d in range(10, 16))
    recordings = rows(data, "rec bigint, sound binary")
    got = audio.same_recordings(audio.fingerprints(recordings, id_column="rec", audio_column="sound")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == label and len(got) == len(data)


def _brute(data, k):
    ids, v = np.array([d for d, _ in data]), np.array([x for _, x in data], float)
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        s = (v * v[q]).sum(1)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), s[i]) for i in order]
    return out


def _search(rows, data, k=20, schema="vec_id bigint, embedding array<float>"):
    got = {}
    for r in ann.search(rows(data, schema), F.col("id") % 20 == 0, k=k).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in got:
        assert [x[0] for x in sorted(got[q])] == list(range(1, len(got[q]) + 1))
    return {q: [(i, s) for _, i, s in sorted(x)] for q, x in got.items()}


def test_recall_against_brute_force(rows):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (40, 24))
    v = (centres[rng.integers(0, 40, 9000)] + 0.4 * rng.normal(0, 1, (9000, 24))).astype(np.float32)
    v[500:1500] = v[0]  # many equal vectors
    data = [(i, x.tolist()) for i, x in enumerate(v)]
    want, got = _brute(data, 20), _search(rows, data)
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    exact = {i: x for i, x in data}
    for q in list(got)[:50]:
        assert all(s == pytest.approx(float(np.dot(np.array(exact[q]), np.array(exact[i]))), rel=1e-12) for i, s in got[q])
    assert got[0] == want[0]  # ties go to smaller ids


@pytest.mark.parametrize("n", [500, 12_000])
def test_recall_with_several_partitions(rows, monkeypatch, n):
    rng, seen, real = np.random.default_rng(7), [], ann.probes_for

    def probes_for(router, vectors, k):
        seen.append((len(router.layers[3]), real(router, vectors, k)))
        return seen[-1][1]

    monkeypatch.setattr(ann, "probes_for", probes_for)
    centres = rng.normal(0, 1, (40, 24))
    v = (centres[rng.integers(0, 40, n)] + 0.2 * rng.normal(0, 1, (n, 24))).astype(np.float32)
    data = [(i, x.tolist()) for i, x in enumerate(v)]
    want, got = _brute(data, 20), _search(rows, data)
    assert len(seen) == 1 and 1 < seen[0][0] and seen[0][1] < seen[0][0]
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / (20 * len(want)) >= 0.9


def test_many_distinct_vectors_tie_at_the_cut():
    rng = np.random.default_rng(6)
    v = np.unique(rng.integers(0, 2, (3000, 14)), axis=0).astype(float)
    v = v[v.any(1)]
    ids = rng.permutation(len(v))
    table = lambda at: pa.table({"id": pa.array(ids[at]), "vector": pa.array(v[at].tolist())})
    got = ann._best(table(slice(0, 40)), table(slice(None)), 20).to_pylist()
    tied = 0
    for q in range(40):
        s = v @ v[q]
        want = [(int(ids[i]), s[i]) for i in np.lexsort((ids, -s))[:21]]
        tied += (s == want[-1][1]).sum() > 33
        assert [(r["top"], r["score"]) for r in got if r["query_id"] == ids[q]] == want
    assert tied > 20


def test_vectors_that_take_no_part(rows):
    good = [(i, [float(i % 7), 1.0, -float(i)]) for i in range(1, 60)]
    bad = [(60, None), (80, [0.0, 0.0, 0.0]), (100, [1.0, None, 2.0]), (120, [float("nan"), 1.0, 1.0]), (140, [float("inf"), 1.0, 1.0]), (160, [1.0]), (None, [1.0, 2.0, 3.0])]
    data = [(d, x, 1.0) for d, x in good + bad] + [(20, good[19][1], 1.0)]
    got = _search(rows, data, schema="vec_id bigint, embedding array<double>, score double")
    want = _brute(good, 20)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert _search(rows, good[19:22], k=20).keys() == {20} and len(_search(rows, good[19:22])[20]) == 2
    assert _search(rows, []) == {} == _search(rows, bad)


def test_parts_are_balanced():
    v = np.random.default_rng(2).normal(0, 1, (1000, 8))
    sizes = np.bincount(ann.balanced_parts(v, ann.neighbour_graph(v, 8), 8), minlength=8)
    assert sizes.min() >= 124 and sizes.max() <= 126
