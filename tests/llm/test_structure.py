"""Periodic runs, conversation repair and language identification against plain versions."""

import hashlib
import os
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from convoyspark.llm import language, periodic, queries, repair

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- periodic runs


def plain_runs(words, least_length=24, exponent=3):
    """All (start, length, period): equal words q apart, stretch by stretch, smallest period first."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least_length, exponent * q) and j > i:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(600):
        texts = []
        for _ in range(rng.randint(0, 4)):
            w = [rng.randrange(rng.choice([1, 2, 4, 50])) for _ in range(rng.randint(0, 70))]
            for _ in range(rng.randint(0, 3)):
                if len(w) > 6:
                    a, q = rng.randrange(len(w)), rng.randint(1, 14)
                    for i in range(a + q, min(len(w), a + q * rng.randint(2, 7) + rng.randint(0, 5))):
                        w[i] = w[i - q]
            texts.append(w)
        least = rng.choice([1, 3, 6, 24])
        bounds = np.concatenate(([0], np.cumsum([len(w) for w in texts], dtype=np.int64)))
        got = periodic.runs(np.array(sum(texts, []), np.int32), bounds, least_length=least, least_exponent=3)
        want = [(i, s, n, q) for i, w in enumerate(texts) for s, n, q in sorted(plain_runs(w, least), key=lambda r: (r[0], r[2]))]
        assert [tuple(r) for r in got.tolist()] == want
    with pytest.raises(ValueError):
        periodic.runs(np.zeros(3, np.int32), np.array([0, 3]), least_length=1, least_exponent=2)


def test_run_cases(spark, rows):
    long = " ".join(str(i % 1000) for i in range(150_000))
    data = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "a " * 30 + "é é\x0bé", "x"), (5, "ab " * 23, "x"), (6, long, "x"), (6, long, "x"),
            (None, "a b c\n" * 9 + "a\xa0b", "x")]
    docs = rows(data, "doc_id bigint, text string, _runs string")
    got = [(r.doc_id, [tuple(x) for x in r._runs], r._collapsed) for r in periodic.with_runs(docs).collect()]
    by = {g[0]: g[1:] for g in got}
    assert by[1] == ([], None) and by[2] == ([], "") and by[3] == ([], "")
    assert by[4] == ([(0, 30, 1)], "a é é é") and by[5] == ([], "ab " * 22 + "ab")
    assert by[6] == ([(0, 150_000, 1000)], " ".join(map(str, range(1000)))) and sum(g[0] == 6 for g in got) == 2
    assert by[None] == ([(0, 27, 3)], "a b c a\xa0b")
    assert periodic.with_runs(rows([], "doc_id bigint, text string")).collect() == []


@needs_tables
def test_periodic_query_equals_brute_force(spark):
    want = {}
    for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect():
        words, h = WORD.findall(r.text or ""), zlib.crc32(str(r.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = plain_runs(words)
        told = "".join(f"{s},{k},{q}\n" for s, k, q in sorted(runs, key=lambda r: (r[0], r[2])))
        gone = {i for s, k, q in runs for i in range(s + q, s + k)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        last = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want[r.doc_id] = (len(runs), *last, sha(told), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))
    got = {r[0]: tuple(r)[1:] for r in queries.QUERIES["op11_periodic_runs"](spark, SF_DIR).collect()}
    assert got == want and sum(w[0] for w in want.values()) > 5


# ---------------------------------------------------------------- conversation repair


def plain_repair(turns):
    """Least (cost, audit, roles and texts) over prefixes, kept by state; ``turns``: role, text, fault."""
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    best = {"": (0, "", [])}

    def insert(best):
        for _ in range(2):
            for state, (c, a, out) in list(best.items()):
                x = follow[state]
                new = (c + 2, a + "I", out + [(name[x], "")])
                if x not in best or new[:2] < best[x][:2]:
                    best[x] = new
        return best

    for role, text, fault in turns:
        new = {}
        for state, (c, a, out) in insert(best).items():
            options = [(state, 3, "D", out)]
            if fault not in ("blank", "duplicate"):
                more, x = int(fault == "truncated"), follow[state]
                options.append((x, 2 + more, "R", out + [(name[x], text)]))
                if role[:1] and role[:1] in ("s" if state == "" else "", x):
                    options.append((role[:1], more, "K", out + [(role, text)]))
            for x, k, letter, o in options:
                if x not in new or (c + k, a + letter) < new[x][:2]:
                    new[x] = (c + k, a + letter, o)
        best = new
    return min(v for s, v in insert(best).items() if s in ("", "a"))


def plain_row(turns):
    seen, faults = set(), []
    for _, role, text in turns:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    given = [t for t, _, _ in turns if t is not None]
    gaps = max(given) - min(given) + 1 - len(set(given)) if given else 0
    first = [role[:1] for _, role, _ in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
    cost, audit, out = plain_repair([(role, text, f) for (_, role, text), f in zip(turns, faults)])
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in out)))


def in_order(rows_):
    return sorted(rows_, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


@needs_tables
def test_repair_query_equals_brute_force(spark):
    conversations = {}
    for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").collect():
        turns = conversations.setdefault(r.conv_id, [])
        case, role, text = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20, " " if r.role is None else r.role, " " if r.text is None else r.text
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        turns += [(r.turn, "user" if case == 4 else role, text)] * {0: 0, 3: 2}.get(case, 1)
    want = {c: plain_row(in_order(t)) for c, t in conversations.items()}
    got = {r[0]: tuple(r)[1:] for r in queries.QUERIES["op12_conversation_repair"](spark, SF_DIR).collect()}
    assert got == want and len({w[6] for w in want.values()}) > 10


ROW = "conv_id bigint, turn bigint, role string, text string, audit string"


def summary_of(mended):
    digests = {r.conv_id: r.repaired_sha256 for r in mended.digests().collect()}
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digests[r.conv_id]) for r in mended.summary().collect()}


def test_repair_cases(spark, rows):
    data = {
        1: [(None, "user", "a."), (None, "assistant", "b.")], 2: [(5, "system", "s.")], 3: [(0, "assistant", "x"), (9, "assistant", "x")],
        4: [(0, "", "x."), (1, "Tool", "y."), (2, "user", " \n")], 5: [(0, "user", "x."), (0, "user", "x."), (0, "user", "x.")],
        None: [(0, "user", "long " * 40_000), (1, "assistant", "z!")], 6: [(1, "system", "q?"), (2, "system", "p.")], 7: [(3, "user", "é\x0b?")],
    }
    mended = repair.Repair(rows([(c, *t, "clash") for c, ts in data.items() for t in ts] + [(8, 1, None, None, "clash")], ROW))
    got = summary_of(mended)
    assert got == {**{c: plain_row(in_order(ts)) for c, ts in data.items()}, 8: plain_row([(1, " ", " ")])}
    assert got[8][5:7] == (3, "D") and got[2][6] == "D" and got[7][6] == "KI" and got[5][1:3] == (0, 2)
    told = [tuple(r) for r in mended.repaired().where("conv_id = 3").orderBy("place").collect()]
    assert [(r[2], r[3], r[4]) for r in told] == [("user", "x", "R"), ("assistant", "x", "K")] or got[3][6] == "DD"
    empty = repair.Repair(rows([], ROW))
    assert empty.summary().collect() == [] and empty.digests().collect() == [] and empty.repaired().collect() == []


def test_long_conversations_are_solved_in_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_BITS", 3)
    monkeypatch.setattr(repair, "FAN_BITS", 2)
    monkeypatch.setattr(repair, "FAN", 4)
    rng = random.Random(8)
    long = [(i // 2, rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]), rng.choice(["ok.", f"t{i}", f"t{i}!", " "])) for i in range(900)]
    short = [(i, "user" if i % 2 == 0 else "assistant", f"w{i}.") for i in range(8)]
    got = summary_of(repair.Repair(rows([(1, *t, "") for t in long] + [(c, *t, "") for c in range(2, 30) for t in short], ROW)))
    order = sorted(long, key=lambda r: (r[0], r[1], r[2]))  # ties of a turn by role, then text
    want = plain_row(order)
    assert got[1] == want and all(got[c][5:7] == (0, "KKKKKKKK") for c in range(2, 30))


# ---------------------------------------------------------------- language identification


def spoken(rng, parts, n):
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(n)).capitalize() + "."


PARTS = {"aa": ["the", "ing", "ou", "er", "th"], "bb": ["der", "ung", "ei", "sch", "en"], "cc": ["que", "eau", "é", "oi", "ent"]}


@pytest.fixture(scope="module")
def model():
    rng = random.Random(2)
    return language.fit({k: [spoken(rng, p, 60) + "\nthis line is everywhere" for _ in range(50)] for k, p in PARTS.items()}, {"aa": 50, "bb": 80, "cc": 50})


def test_language_of_unseen_texts(model):
    rng, encoders = random.Random(3), model.encoders()
    told = [(k, model.identify(encoders, spoken(rng, p, rng.choice([8, 40, 3000])))) for k, p in PARTS.items() for _ in range(60)]
    assert sum(k == t[0] for k, t in told) / len(told) > 0.97 and all(0 <= t[1] < 1 for _, t in told)
    assert model.identify(encoders, spoken(rng, PARTS["cc"], 50))[2] and not model.identify(encoders, "x")[2]
    assert model.identify(encoders, "x")[0] == "bb"  # a tie goes to the language with most rows
    for nothing in (None, "", "12 . 3²", " \n"):
        assert model.identify(encoders, nothing) == (None, 0.0, False)
    assert all(b"everywhere" not in d for _, d in model.dictionaries)
    assert language.fit({}, {}).identify([], "abc") == (None, 0.0, False)
    one = language.fit({"zz": ["a"]}, {"zz": 1})
    assert one.identify(one.encoders(), "abc") == ("zz", 1.0, True)


def test_language_on_tables(spark, rows):
    rng = random.Random(4)
    data = [(i, spoken(rng, PARTS[k], 30), k, "x") for i, k in enumerate(list(PARTS) * 60)]
    data += [(1000, "the ing", None, "x"), (1001, None, "aa", "x"), (None, "", None, "x")] + [(2000 + i, data[0][1], "aa", "x") for i in range(400)]
    docs = rows(data, "doc_id bigint, text string, lang string, _language string")
    learned = language.train(docs, F.col("doc_id") % 4 != 2)
    assert [n for n, _ in learned.dictionaries] == ["aa", "bb", "cc"] and learned.dictionaries[1][1].count(b"\n") > 30
    got = {r.doc_id: (r.lang, r._language) for r in language.identified(docs, learned).collect()}
    assert len(got) == len(data) and got[1001][1].nearest is None and got[None][1].margin == 0
    held = [(lang, t.nearest) for d, (lang, t) in got.items() if d is not None and d < 1000 and d % 4 == 2]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    nobody = language.train(docs, F.lit(False))
    assert nobody.dictionaries == [] and {r._language.nearest for r in language.identified(docs, nobody).collect()} == {None}
    assert language.identified(rows([], "doc_id bigint, text string"), learned).collect() == []


def test_too_many_languages(spark, rows, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError):
        language.train(rows([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], "doc_id bigint, text string, lang string"), F.lit(True))


@needs_tables
def test_held_out_languages_of_the_query(spark):
    told = queries.QUERIES["op13_compressed_language_id"](spark, SF_DIR).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert len(told) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in told)
    held = [r for r in told if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und"]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) >= 0.9
