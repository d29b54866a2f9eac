"""Divergence of sources against a full matrix in plain whole numbers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from feedloom.llm import source_audit
from feedloom.llm.source_audit import Sizes


def brute(rows, top=200):
    groups, counts, in_docs = defaultdict(set), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = ["".join(c.lower() if c < "\x80" else c for c in t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        counts[lang, source].update(found)
        in_docs[lang].update(set(found))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in in_docs[lang].items() if n >= 3]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        of_lang = {t: sum(counts[lang, s][t] for s in sources) for t in kept}

        def p(n, total, v=len(kept)):
            return 1 + 10**9 * (n + 1) // (total + v)

        for s in sources:
            pairs = [(sum((p(counts[lang, s][t], total[s]) - p(counts[lang, o][t], total[o])) ** 2 // p(counts[lang, o][t], total[o]) for t in kept), o)
                     for o in sources if o != s]
            terms = []
            for t in kept:
                a, q = p(counts[lang, s][t], total[s]), p(of_lang[t], sum(total.values()))
                if counts[lang, s][t] and a > q:
                    terms.append(((a - q) ** 2 // q, t))
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                ranked = ranked[:top] if part == "term" else ranked
                out |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)}
    return out


def made_rows(seed, n_docs, n_sources):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "rstuvwé日"] + [f"rare{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = []
    for _ in range(n_docs):
        source = int(n_sources * rng.random() ** 2)
        own = words[source * 7 % 60 : source * 7 % 60 + 30] + rng.sample(words, 3)
        text = rng.choice((" ", "1", "_")).join(rng.choice(own) for _ in range(rng.randrange(60)))
        rows.append((rng.choice(("en", "en", "fr")), f"s{source}", rng.choice((text, text.upper()))))
    rows += [(None, None, None), ("xx", "one", "two words"), ("en", "empty", ""), ("en", None, "ar as"), ("", "s1", "ar")]
    return rows


@pytest.mark.parametrize(
    "seed, top, sizes",
    [(1, 200, Sizes()), (2, 5, Sizes(8, 120, 2, 100, 4000)), (3, 200, Sizes(4, 40, 1, 50, 900))],
)
def test_audit(spark, seed, top, sizes):
    rows = made_rows(seed, 300, 22)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, source string, text string, term string, n int")
    got = source_audit.audit(docs.repartition(3), top, sizes).collect()
    assert len(got) == len(set(got))
    assert set(map(tuple, got)) == brute(rows, top)
    assert source_audit.audit(docs.limit(0)).isEmpty()


def test_shares_are_exact():
    rng = random.Random(1)
    n = [rng.randrange(10**k) for k in range(1, 16) for _ in range(20)]
    total = [x + rng.randrange(1, 10**6) for x in n]
    got = source_audit.shares(np.array(n), np.array(total)).tolist()
    assert got == [1 + 10**9 * (a + 1) // b for a, b in zip(n, total, strict=True)]


def test_zeros_are_priced_together(monkeypatch):
    """Squares of zeros are not walked: their price is one product."""
    seen = []
    prices = source_audit._prices
    monkeypatch.setattr(source_audit, "_prices", lambda p, q: seen.append(np.broadcast(p, q).size) or prices(p, q))
    some = np.zeros((64, 64 * 100), bool)
    some[5, 7] = some[40, 3000] = True
    p = np.where(some, 1000, 10) + np.arange(64)[:, None]
    zero = 10 + np.arange(64)
    got = source_audit.divergence((p, some, zero, 64), (p, some, zero, 64), True)[0]
    want = prices(p[:, None, :], p[None, :, :]).sum(2)
    assert (got == want).all() and sum(seen) < 0.01 * 64 * 64 * 6400
