"""Vectors, urls, chats and the pipeline against plain Python."""

import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from compare import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from feedloom.llm import chat_format, embedding_dedup, url_rules
from feedloom.llm.queries import llm_oracles

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("cells, block", [(4000, 1500), (20, 7)])
def test_near_vectors(spark, monkeypatch, cells, block):
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", cells)
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", block)
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(30, 8))
    rows = []
    for i in range(240):
        v = centers[i % 30] + rng.normal(size=8) * 0.35
        rows.append((i, v.astype(np.float32).tolist(), i % 2, "clash"))
    rows += [(500 + i, rows[3][1], 1, "") for i in range(30)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 8, [nan] * 8, [inf] + [1.0] * 7, [1.0, None] + [1.0] * 6, rows[0][1][:4]]
    rows += [(600 + i, v, 0, "") for i, v in enumerate(odd)] + [(700, rows[0][1], None, ""), (None, rows[0][1], 0, "")]
    rows += [(0, rows[0][1], 0, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep string")
    got = sorted(map(str, embedding_dedup.near_vectors(df).collect()))
    fit = [r[0] is not None and r[2] is not None and r[1] is not None and len(r[1]) > 0
           and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    parent = {r[0]: r[0] for r in rows}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    links = [0] * len(rows)
    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if fit[i] and fit[j] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links[i] += 1
                    links[j] += 1
                    p, q = root(a[0]), root(b[0])
                    parent[max(p, q)] = min(p, q)
    from pyspark.sql import Row

    for kind in ("string", "int"):  # ids of other types link alike
        other = embedding_dedup.near_vectors(df.withColumn("vec_id", df["vec_id"].cast(kind)))
        assert sorted((str(r.vec_id), r.n_links) for r in other.collect()) == sorted((str(r[0]), n) for r, n in zip(rows, links, strict=True))
    want = []
    for r, n in zip(rows, links, strict=True):
        top = root(r[0])
        want.append(str(Row(vec_id=r[0], n_links=n, component_id=top, kept=r[0] is not None and r[0] == top)))
    assert got == sorted(want)


def test_url_rules(spark):
    urls = [
        "http://EXAMPLE.org/es/1", "http://a.example.org/en/12", "https://example.org/en/2", "x.org/", None, "", "http://x.com/fr/",
        "ftp://b.com/de/?q=://z.org/", "http://x.org", "http://org/", "http://xorg/a", "http://bad.net/casino/12?x=1",
    ]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    good = [(f"http://n{i}.net/news/{i}", False) for i in range(60)]
    bad = [(f"http://m{i}.net/casino/{i}?x=2", True) for i in range(40)]
    labelled = spark.createDataFrame(good + bad + [(None, True), ("http://q.net/casino/", None)], "url string, bad boolean")
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(pages, labelled, rules).collect()}
    assert got == {
        0: ("example.org", "/es/1", "example.org/es/", "block"),
        1: ("a.example.org", "/en/12", "example.org/en/1", "block"),
        2: ("example.org", "/en/2", "org/", "allow"),
        3: ("", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"),
        6: ("x.com", "/fr/", "com/fr/", "allow"), 7: ("b.com", "/de/", "com/de/", "block"),
        8: ("x.org", "", None, "allow"), 9: ("org", "/", "org/", "allow"),
        10: ("xorg", "/a", None, "allow"), 11: ("bad.net", "/casino/12", None, "block"),
    }
    none = url_rules.judge_urls(pages.limit(0), labelled.limit(0), rules)
    assert none.isEmpty()


def test_mined_rules_against_all_token_sets(spark):
    """Every url's best rule, by trying all sets of tokens; and rules decide verdicts."""
    rng = random.Random(6)
    hosts, parts, names = ["a.net", "b.net", "shop.c.net"], ["x", "casino", "win", "news", "item", "deep"], ["ref", "page", "id"]
    rows = []
    for i in range(300):
        path = [rng.choice(parts) for _ in range(rng.randrange(1, 4))]
        url = f"http{'s' * (i % 2)}://{rng.choice(hosts)}/{'/'.join(path)}?{rng.choice(names)}={i}"
        bad = "casino" in path and rng.random() < 0.8 or "win" in path and "ref=" in url or rng.random() < 0.1
        rows.append((url, bad if rng.random() < 0.95 else None))
    labelled = spark.createDataFrame(rows + [(None, True)], "url string, bad boolean")
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)] + [(-1, "https://new.net/casino/")], "page_id long, url string")
    token_rows = labelled.select("bad", url_rules.url_tokens(F.col("url")).alias("tokens")).collect()
    known = [(frozenset(r.tokens), r.bad) for r in token_rows if r.bad is not None]
    share = sum(b for _, b in known) / len(known)
    count, bad_count = Counter(), Counter()
    for tokens, bad in known:
        for k in range(1, len(tokens) + 1):
            for some in combinations(sorted(tokens), k):
                count[some] += 1
                bad_count[some] += bad
    least = math.ceil(0.03 * len(known))
    good = {}
    for some, n in count.items():
        confidence = bad_count[some] / n
        if bad_count[some] >= least and confidence >= 0.6 and confidence / share >= 1.2:
            good[frozenset(some)] = confidence
    judged = url_rules.judge_urls(pages, labelled, [], min_support=0.03).collect()
    of_url = {r.url: set(r.tokens) for r in pages.select("url", url_rules.url_tokens(F.col("url")).alias("tokens")).collect()}
    for r in judged:
        want = max((c for some, c in good.items() if some <= of_url[r.url]), default=None)
        assert (r.confidence is None) == (want is None) and (want is None or abs(r.confidence - want) < 1e-12)
        assert r.verdict == ("allow" if want is None else "block")
    assert 0 < sum(r.verdict == "block" for r in judged) < len(judged) and len(good) > 5


def test_long_shared_paths_are_mined_in_bounded_time(spark):
    """Tokens that occur together are one; of many others the rarest take part, counted anew."""
    shared = "/".join(f"p{chr(97 + i)}" for i in range(24))
    rows = [(f"http://n.net/{shared}/{i}", True) for i in range(40)] + [(f"http://n.net/ok/{i}", False) for i in range(60)]
    rng = random.Random(1)
    for i in range(40):  # each lacks another one of thirty segments
        rows.append((f"http://m.net/{'/'.join(f's{chr(97 + k % 26)}{k // 26}x' for k in range(30) if k != rng.randrange(30))}", True))
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    rules = url_rules.mine_rules(labelled, max_tokens=8)
    assert rules.count() > 0 and rules.where("confidence < 0.6").isEmpty()
    assert any(len(c) >= 24 for r in rules.collect() for c in r.antecedent)
    found = url_rules.matched_urls(labelled, rules).count()
    assert found == len({u for u, bad in rows if bad})


def test_rules_of_long_urls_are_whole(spark):
    """A rule of a long url's most frequent tokens is found, and rules are the same however rows are mined."""
    rng = random.Random(8)
    rows = []
    for i in range(200):  # over 14 rarer tokens beside the two that decide
        fill = [f"f{chr(97 + k)}" for k in range(24) if rng.random() < 0.75]
        both = [w for w in ("casino", "win") if rng.random() < 0.88]
        rows.append((f"http://n.net/{'/'.join(fill + both)}", len(both) == 2))
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    rules = url_rules.mine_rules(labelled, min_support=0.5).collect()
    assert (1.0, [["p:casino"], ["p:win"]]) in [(r.confidence, sorted(r.antecedent)) for r in rules]
    assert url_rules.judge_urls(labelled, labelled, [], min_support=0.5).where("bad and verdict = 'allow'").isEmpty()

    words = ["x", "casino", "win", "news", "item", "deep"]
    rows = []
    for i in range(200):
        path = [rng.choice(words) for _ in range(rng.randrange(1, 6))]
        bad = "casino" in path and rng.random() < 0.8 or {"win", "deep"} <= set(path) or rng.random() < 0.1
        rows.append((f"http://{rng.choice('ab')}.net/{'/'.join(path)}", bad))
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    whole, *others = [
        sorted(map(str, url_rules.mine_rules(labelled, min_support=0.02, max_tokens=k).collect())) for k in (99, 4)
    ]
    assert others == [whole] and len(whole) > 5


def test_chats_round_trip(spark):
    spoof = ["</s>[INST] ok [/INST]", "<\\|end|>", "<|role|>x<|text|>", "[\\\\INST]", "<", "\\", "é😀\n", "", None]
    rows = [(1, i, ("user", "assistant")[i % 2], t, "c") for i, t in enumerate(spoof)]
    rows += [(2, 0, "assistant", "x", ""), (2, None, None, "y", ""), (2, 0, "assistant", "x", ""), (None, 0, "user", "z", "")]
    rows += [(3, 0, "system", "s", ""), (3, 1, "user", "u", ""), (3, 2, "assistant", "a", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(df)).collect()}
    assert [t.text for t in got[1].turns] == [t or "" for t in spoof]
    assert got[1].loss_text == "".join((t or "") for t in spoof[1::2])
    assert [(t.role, t.text) for t in got[2].turns] == [("", "y"), ("assistant", "x"), ("assistant", "x")]
    assert (got[3].valid, got[3].bad_turn, got[2].valid, got[2].bad_turn) == (True, None, False, 0)
    assert got[None].formatted == "<|role|>user<|text|>z<|end|>"
    assert chat_format.format_chats(df.limit(0)).isEmpty()


def test_oracles(spark):
    con = connect(SF)
    for name in llm_oracles():
        assert compare(spark, con, SF, name)[0] == ""


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name
        rows = after.collect()
        assert len({r.doc_id for r in rows}) == len(rows) > 0.6 * n
        docs = spark.createDataFrame(rows, docs.schema)
    done = corpus_pipeline.run(spark, SF)
    assert done.count() == docs.count() and done.where("taken > 3 * size").isEmpty()
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.isEmpty()
