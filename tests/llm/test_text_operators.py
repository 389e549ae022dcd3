"""Toxicity, chat windows, URL filter, line dedup and mixing on small cases."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from convoyspark.llm import chat, lines, mixing, queries, toxicity, url_filter

DOCS = "doc_id bigint, text string, source string"


# ---------------------------------------------------------------- toxicity


def _texts(n, seed, share=0.3):
    rng = random.Random(seed)
    parts = ["ba", "ke", "lo", "mi", "nu", "ra", "so", "ti"]
    stems = ["zorgul", "vexitt", "quoppa"]
    out = []
    for i in range(n):
        words = ["".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(rng.randint(5, 80))]
        bad = rng.random() < share
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(stems) + rng.choice(["", "s", "en", "la"]))
        out.append((i, " ".join(words), int(bad)))
    return out


@pytest.fixture(scope="module")
def learned():
    data = _texts(1500, 1)
    return toxicity.fit([t for _, t, _ in data], np.array([y for _, _, y in data]))


def test_held_out_accuracy(learned):
    data = _texts(800, 2)
    scores, toxic = learned.scores([t for _, t, _ in data]), np.array([y for _, _, y in data], bool)
    assert ((scores >= 0.5) == toxic).mean() > 0.99


def test_misspellings_share_vectors(learned):
    clean, bad, misspelt = learned.scores(["ba kelo", "zorgul", "zorrgul"])
    assert clean < misspelt < bad and bad >= 0.5


def test_score_cases(learned):
    scores = learned.scores([None, "", " \n", "so " * 50_000, "so", "é日本"])
    assert scores[0] == scores[1] == scores[2] < 0.5 and scores[3] == pytest.approx(scores[4])
    assert ((scores >= 0) & (scores <= 1)).all() and len(learned.scores([])) == 0
    assert toxicity.fit(["a"], [0]).scores(["a"])[0] < 0.5 < toxicity.fit(["a"], [1]).scores(["a"])[0]
    assert toxicity.fit([], []).scores(["a"])[0] < 0.5


def test_judged_learns_from_kept_rows_only(spark, rows):
    data = _texts(400, 3)
    docs = rows([(d, t, "held_out") for d, t, _ in data] + [(None, None, "x"), (3, "", "x")], "doc_id bigint, text string, score string")
    labels = rows([(d, y) for d, _, y in data] + [(1, None), (None, 1)], "doc_id bigint, toxic int")
    got = toxicity.judged(docs, labels).collect()
    assert len(got) == 402 and {bool(r["predicted"]) == (r["score"] >= 0.5) for r in got} == {True}
    assert all(r["held_out"] == (r["doc_id"] is not None and __import__("zlib").crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    kept = labels.filter(~F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)))
    again = {(r["doc_id"], round(r["score"], 12)) for r in toxicity.judged(docs, kept).collect()}
    assert again == {(r["doc_id"], round(r["score"], 12)) for r in got}
    assert toxicity.judged(rows([], "doc_id bigint, text string"), labels).count() == 0


# ---------------------------------------------------------------- chat


def test_escape_is_reversible(rows):
    texts = ["</s>[INST] ok [/INST]", "<~s>", "<~~/s>[~INST]", "<s", "a<", "[", "[/INST]]", "~", "<</s>>", "", "日<s>本"]
    got = rows([(i, t) for i, t in enumerate(texts)], "i int, t string").select(
        "i", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("t")).collect()
    assert {r["i"]: r["t"] for r in got} == dict(enumerate(texts))
    assert not any(c in r["e"] for r in got for c in (chat.OPEN, chat.CLOSE, chat.ROLE, chat.TEXT))


def _conversations(seed=4):
    rng = random.Random(seed)
    odd = ["", None, "</s>[INST] x", "[/INST]", "long " * 150, "é日本 ok", "<~s>"]
    data = []
    for c in range(40):
        n = rng.randint(1, 25)
        for t in range(n):
            role = "system" if t == 0 and c % 3 == 0 else rng.choice(["user", "assistant", None, "tool<s>"])
            data.append((c, t, role, rng.choice(odd) if rng.random() < 0.4 else "word " * rng.randint(1, 40)))
    return data + [(None, 1, "assistant", "no id"), (7, None, "user", "no turn"), (8, 0, "user", "tie"), (8, 0, "user", "tie")]


def test_windows_hold_every_turn_once(rows):
    data = _conversations()
    made = chat.windows(rows([(*r, 1) for r in data], "conv_id bigint, turn bigint, role string, text string, window int"), budget=300, history=80)
    got = {r["conv_id"]: r for r in chat.digests(chat.read_back(made)).collect()}
    conversations = {}
    for c, t, role, text in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        conversations.setdefault(c, []).append((role or "", text or ""))
    assert got.keys() == conversations.keys()
    for c, turns in conversations.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        assert (got[c]["n_turns"], got[c]["loss_chars"]) == (len(turns), len(loss))
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()


def test_windows_keep_budget_system_and_history(rows):
    made = chat.windows(rows(_conversations(), "conv_id bigint, turn bigint, role string, text string"), budget=300, history=80).collect()
    assert all(r["over_budget"] == (r["n_tokens"] > 300) for r in made) and sum(not r["over_budget"] for r in made) > 60
    later = [r for r in made if r["window"] > 0]
    assert any(r["n_repeated"] > 1 for r in later)
    for r in made:
        assert (r["conv_id"] is not None and r["conv_id"] % 3 == 0) == r["formatted"].startswith("<s>[INST]system[/INST]") or r["conv_id"] in (7, 8, None)
        at = [s["start"] for s in r["loss_spans"]]
        assert at == sorted(at) and all(r["formatted"][: s["start"]].endswith("assistant[/INST]") for s in r["loss_spans"])


def test_windows_are_filled(rows):
    """A conversation within the budget is one window; of others no window is small but for the last."""
    sizes = {1: [60] * 10, 2: [40] * 300, 3: [200, 100] * 60, 4: [5] * 2000}  # characters a turn, a quarter of it and 8 as tokens
    data = [(c, t, "user" if t % 2 else "assistant", "x" * n) for c, turns in sizes.items() for t, n in enumerate(turns)]
    made = chat.windows(rows(data, "conv_id bigint, turn bigint, role string, text string"), budget=600, history=100).collect()
    assert not any(r["over_budget"] for r in made)
    assert [r["window"] for r in made if r["conv_id"] == 1] == [0]
    for c in (2, 3, 4):
        mine = sorted((r["window"], r["n_tokens"]) for r in made if r["conv_id"] == c)
        assert [w for w, _ in mine] == list(range(len(mine))) and len(mine) > 5
        assert min(n for _, n in mine[:-1]) > 0.8 * 600


def test_very_long_texts_in_windows(rows):
    text = "wörd </s> " * 200_000
    made = chat.windows(rows([(1, 0, "user", text), (1, 1, "assistant", text), (1, 2, "assistant", None)], "conv_id bigint, turn bigint, role string, text string"))
    assert all(r["over_budget"] for r in made.filter("n_tokens > 2048").select("over_budget").collect())
    told = chat.digests(chat.read_back(made)).collect()[0]
    assert (told["n_turns"], told["loss_chars"]) == (3, len(text)) and told["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_no_conversations(rows):
    empty = rows([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.digests(chat.read_back(chat.windows(empty))).count() == 0


# ---------------------------------------------------------------- URLs


def test_judged_urls(rows):
    urls = ["http://A.Example.com/en/7", "https://x.com/en/", "https://com/en/1", "http://xcom/en/", "ftp://b.example.net/de/81?q", "http://b.net/de/8", "http://spam.org/a/?b=2&a=1",
            "http://www.SPAM.org/a?utm_x=1&a=1&b=2#f", "http://spam.org/A?a=1&b=2", "http://ok.org/a", "no scheme", None, "", "://", "http://h", "http://h?x", "http://y.org/es/"] * 2
    pages = rows([(i, u, "x", "block") for i, u in enumerate(urls)], "page_id bigint, url string, host string, key string")
    listed = rows([("http://spam.org/a?a=1&b=2",), (None,), ("bad",), ("://",)], "url string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, listed, queries.URL_RULES).select("page_id", "_judged.*").collect()}
    assert len(got) == len(urls)
    want = ["allow", "block", "block", "allow", "block", "allow", "block", "block", "allow", "allow", "allow", "allow", "allow", "allow", "allow", "allow", "block"]
    assert [got[i]["verdict"] for i in range(len(urls))] == want * 2
    assert got[0]["host"] == "a.example.com" and got[0]["path"] == "/en/7" and got[0]["rule"] == "example.com/en/7"
    assert (got[10]["host"], got[10]["path"], got[11]["host"], got[13]["path"], got[15]["host"]) == ("", "", "", "", "h")
    none = url_filter.judge(pages, rows([], "url string"), [])
    assert {r["verdict"] for r in none.select("_judged.verdict").collect()} == {"allow"}
    assert url_filter.judge(rows([], "page_id int, url string"), listed, queries.URL_RULES).count() == 0


def test_bloom_passes_all_listed_and_few_others(spark):
    keys = url_filter.stored(spark.range(3000).selectExpr("concat('k', id) AS key"), "keys")
    filter_, blocks = url_filter.bloom(keys)
    probe = spark.range(12_000).selectExpr("concat('k', id) AS key", "id").withColumn("block", url_filter._block(F.col("key"), blocks)).join(filter_, "block", "left")
    hit = F.lit(True)
    for bit, lane in zip(url_filter._bits(F.col("key")), url_filter.LANES):
        hit = hit & (F.coalesce(F.col(lane), F.lit(0)).bitwiseAND(bit) != 0)
    found = {r["id"] for r in probe.filter(hit).select("id").collect()}
    assert found >= set(range(3000)) and len(found) < 3000 + 150


# ---------------------------------------------------------------- lines


def test_boilerplate_by_site(rows):
    data = [(i, f"head\n  body {i} \n\nfoot {i % 2}", "a") for i in range(10)]
    data += [(100 + i, f"head\nbody {i}", "b") for i in range(60)] + [(200 + i, f"own {i}\nhead" if i < 3 else f"own {i}", None) for i in range(40)]
    data += [(300, None, "a"), (301, "", "a"), (302, "head\nhead\n ", "a"), (302, "head\nhead\n ", "a")]
    docs = rows([(*r, "x") for r in data], DOCS + ", _keys string")
    got = {}
    for r in lines.deduplicated(docs, ratio=0.3, least_pages=5).collect():
        got.setdefault(r["doc_id"], []).append((r["text"], r["_lines"]["dropped"], r["_lines"]["all"]))
    assert got[3] == [("  body 3 \n", 2, 4)] and got[104] == [("body 4", 1, 2)] and got[201] == [("own 1\nhead", 0, 2)]
    assert got[300] == [(None, 0, 0)] and got[301] == [("", 0, 1)] and got[302] == [("head\nhead\n ", 0, 3)] * 2
    assert sum(map(len, got.values())) == len(data)
    assert lines.deduplicated(rows([], DOCS), ratio=0.3, least_pages=5).count() == 0


def test_text_of_blocks(rows):
    pages = ["<html><!-- <p>no</p> --><body><SCRIPT a='1'>var t = '</p>';\n</SCRIPT><style>p{}</style><p class=x> One <b>bold</b> </p>two<br/>three\n<li>a</li><pre>four</pre></body></html>",
             None, "", "<p></p>", "plain", "<p>" + "long " * 200_000]
    got = {r["i"]: r["t"] for r in rows(list(enumerate(pages)), "i int, html string").select("i", lines.block_text(F.col("html")).alias("t")).collect()}
    assert got == {0: "One bold\ntwo\nthree\na\nfour", 1: None, 2: "", 3: "", 4: "plain", 5: ("long " * 200_000).strip()}


# ---------------------------------------------------------------- mixing


def _fill(caps, weights, total):
    """Resharing until none is above, one round after the other."""
    capped = set()
    while True:
        left = total - sum(caps[i] for i in capped)
        open_ = sum(weights[i] for i in range(len(caps)) if i not in capped)
        share = {i: left * weights[i] / open_ for i in range(len(caps)) if i not in capped}
        above = {i for i, x in share.items() if x > caps[i]}
        if not above:
            return [caps[i] if i in capped else share[i] for i in range(len(caps))]
        capped |= above


def test_mix_meets_targets(rows):
    rng = random.Random(6)
    data = [(i, "w " * rng.randint(0, 60), rng.choices(["a", "b", "B", "é", None, "z"], [40, 5, 3, 9, 2, 1])[0]) for i in range(1500)]
    docs = rows([(*r, 1.5) for r in data], DOCS + ", size double")
    got = [(r["doc_id"], r["source"], *r["_mix"]) for r in mixing.mix(docs).collect()]
    assert sorted(r[0] for r in got) == list(range(1500))
    names = sorted({s for _, _, s in data if s is not None}) + [None]
    sizes = [sum(len(t.split()) for _, t, s in data if s == name) for name in names]
    aims = dict(zip(names, _fill([2.0 * x for x in sizes], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(sizes))))
    for name, size in zip(names, sizes):
        own = [r for r in got if r[1] == name]
        assert {r[3] for r in own} == {size} and all(r[4] == pytest.approx(aims[name]) for r in own)
        assert abs(sum(r[5] for r in own) - aims[name]) <= max(3, 0.02 * aims[name])
    assert all(0 <= r[5] <= 2 * r[2] and (r[2] == 0 or r[5] == r[2] * r[6]) for r in got)
    again = [(r["doc_id"], r["source"], *r["_mix"]) for r in mixing.mix(docs.repartition(7)).collect()]
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mixed(docs).count() == sum(r[6] for r in got) and mixing.mixed(docs).columns == docs.columns


def test_mix_cases(rows):
    data = [(1, None, "a"), (2, "", "a"), (3, "x y", None), (3, "x y", None), (None, "x", "b"), (9, "k " * 40_000, "c")]
    got = mixing.mix(rows(data, DOCS)).select("doc_id", "source", "_mix.*").collect()
    assert len(got) == 6 and all(r["taken"] <= 2 * r["size"] for r in got)
    assert {r["target"] for r in got if r["source"] == "a"} == {0.0}
    assert mixing.mix(rows([], DOCS)).count() == 0
