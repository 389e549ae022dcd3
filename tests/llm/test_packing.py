"""Packing and token files: plans against bounds, ids against the library, files as exact round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from convoyspark.llm import packing, ragged, token_files, tokens
from convoyspark.llm.shared import folder

BYTES, WORDS = (str(public_tokenizers.path(f)) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = ["", " ", "a", "'s", "it's 'sorry' ''s", "  two  spaces \n\n x\t", "ß÷×é 9½²1", "\xa0x\x85y\x1cz", "œuvre 日本", "<|endoftext|> x", "x" * 5000, "ÀÉ lower"]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_ids_are_the_library_s(path):
    rng = random.Random(3)
    letters = list("abz ABZ'  \n\t'srtvemld09½²ªß×éÉ÷-.,!\xa0\x0b") + ["'s", "'re", "'ll", " '"]
    texts = ODD + ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(1500)] + [None]
    encoder, library = tokens.Encoder(path), Tokenizer.from_file(path)
    assert encoder.rule is not None
    flat, counts = encoder.encode(texts)
    at = np.concatenate(([0], np.cumsum(counts)))
    for i, t in enumerate(texts):
        assert flat[at[i] : at[i + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_memo_starts_again_when_full():
    encoder = tokens.Encoder(BYTES)
    encoder.memo = tokens.Memo(64)
    texts = [f"word{i} other{i}" for i in range(500)]
    flat = np.concatenate([encoder.encode([t])[0] for t in texts])
    assert flat.tolist() == [x for t in texts for x in encoder.library.encode(t, add_special_tokens=False).ids]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_one_text_brings_more_pretokens_than_the_memo_holds(path):
    encoder = tokens.Encoder(path)
    encoder.memo = tokens.Memo(64)
    texts = ["few words", " ".join(f"word{i}" for i in range(500)), "few words " * 100, None, " ".join(f"it's x{'y' * i}" for i in range(90)), "words"]
    flat, counts = encoder.encode(texts)
    want = [encoder.library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert flat.tolist() == sum(want, []) and counts.tolist() == [len(x) for x in want]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=300))
def test_plan_places_every_piece_once(lengths):
    histogram = np.bincount(lengths, minlength=65) if lengths else np.zeros(65, int)
    runs = packing.plan(histogram.astype(np.int64), 64)
    seen = {}
    for run in runs:
        used = 0
        for length, rank, copies in run.items:
            used += length * copies
            seen.setdefault(length, []).extend(range(rank, rank + copies * run.bins))
        assert used + run.gap == 64 and run.gap >= 0
    assert {x: sorted(r) for x, r in seen.items()} == {x: list(range(n)) for x, n in enumerate(histogram) if n}


def test_plan_is_close_to_the_bound():
    rng = np.random.default_rng(1)
    lengths = np.minimum(2048, 1 + rng.lognormal(6, 1.1, 20_000).astype(int))
    histogram = np.bincount(lengths, minlength=2049)
    assert sum(r.bins for r in packing.plan(histogram, 2048)) <= 1.002 * lengths.sum() / 2048 + 1


def _docs(rows, texts):
    return rows([(i, t, 9.5) for i, t in enumerate(texts)], "doc_id bigint, text string, offset double")


def test_pack_has_no_gaps_and_all_ids(spark, rows):
    texts = [t for t in ODD] + [None] + ["la " * k for k in range(1, 200, 3)] + ["same words"] * 40
    docs = _docs(rows, texts)
    got = packing.pack(docs, BYTES, capacity=128, end_id=0).collect()
    library = Tokenizer.from_file(BYTES)
    for i, t in enumerate(texts):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // 128)))
        assert all(r["length"] == 128 for r in own[1:])
        assert [r["start"] for r in own] == [sum(r["length"] for r in own[:k]) for k in range(len(own))]
        assert sum(r["length"] for r in own) == len(ids)
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 128
    made = packing.sequences(docs, packing.pack(docs, BYTES, capacity=128), BYTES, capacity=128).collect()
    assert sum(len(r["ids"]) for r in made) == 4 * sum(r["length"] for r in got) and all(len(r["ids"]) <= 512 for r in made)


def test_pack_of_repeats_nulls_and_nothing(spark, rows):
    data = [(7, "a b"), (7, "a b"), (None, "x"), (3, None), (3, "")]
    got = packing.pack(rows(data, "doc_id bigint, text string"), BYTES, capacity=16).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(d) for d, _ in data)
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == 5
    assert packing.pack(rows([], "doc_id bigint, text string"), BYTES).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=1500))
def test_coder_round_trip(ids):
    ids = np.array(ids)
    digits, raw = token_files.encode(ids, 301)
    assert token_files.decode(raw, len(ids), 301).tolist() == ids.tolist()


def test_coder_learns():
    rng = np.random.default_rng(2)
    for ids, bits in ((np.tile([5, 900, 33, 47], 50_000), 0.6), (rng.zipf(1.5, 100_000) % 40_000, 9)):
        _, raw = token_files.encode(ids, int(ids.max()) + 1)
        assert (token_files.decode(raw, len(ids), int(ids.max()) + 1) == ids).all() and 8 * len(raw) / len(ids) < bits
    ids = rng.integers(0, 49_000, 600_000)  # counts are halved on the way
    assert (token_files.decode(token_files.encode(ids, 49_000)[1], len(ids), 49_000) == ids).all()


def test_broken_blocks_are_found():
    raw = token_files.frame([1, None], np.array([2, 1]), np.array([4, 5, 2]), 10)
    assert [x if not hasattr(x, "tolist") else x.tolist() for x in token_files.read_frame(raw)] == [["1", None], [2, 1], [4, 5, 2], 10]
    for place in (2, 9, len(raw) - 1):
        with pytest.raises(ValueError):
            token_files.read_frame(raw[:place] + bytes([raw[place] ^ 1]) + raw[place + 1 :])


def test_files_read_back_in_order(spark, rows):
    texts = ODD + [None] + [f"some words {i} again" for i in range(300)] + [None]
    data = [(i * 7 % 1009 - 50, t, "extra") for i, t in enumerate(texts)] + [(None, "no id", "extra"), (4, "twice", "x"), (4, "twice", "x")]
    path = folder(spark, "ids")
    token_files.write(rows(data, "doc_id bigint, text string, file string"), path, WORDS, end_id=2)
    got = token_files.with_digests(token_files.read(spark, path)).collect()
    library = Tokenizer.from_file(WORDS)
    start, want = 0, []
    for d, t, _ in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    empty = folder(spark, "ids")
    token_files.write(rows([], "doc_id bigint, text string"), empty, WORDS, end_id=2)
    assert token_files.read(spark, empty).count() == 0


def test_words_and_hashes_do_not_depend_on_place():
    data, bounds = ragged.joined(["ab  cd\x0b", None, "", "cd é", " ab"])
    starts, ends, counts = ragged.words(data, bounds)
    assert counts.tolist() == [2, 0, 0, 2, 1]
    h = ragged.hashes(data, starts, ends)
    assert h[0] == h[4] and h[1] == h[2] and len(set(h.tolist())) == 3


def test_checksums_come_from_the_worker_that_cuts(rows, capfd):
    docs = rows([(i, t) for i, t in enumerate(ODD)] + [(99, None)], "doc_id bigint, text string")
    whole = {(r.doc_id, r.piece): (r.start, r.length, zlib.crc32(r.ids)) for r in packing.pieces(docs, BYTES, capacity=64).collect()}
    told = packing.pieces(docs, BYTES, capacity=64, digests=True)
    told.explain()
    assert capfd.readouterr().out.count("MapInArrow") == 1
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in told.collect()} == whole and len(whole) > len(ODD)
