"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from feedloom.llm import spelling


def brute_near(words):
    """Words one edit away, by trying all edits with the alphabet in use."""
    alphabet = sorted({c for w in words for c in w})
    near = {}
    for w in words:
        found = set()
        for i in range(len(w) + 1):
            for c in alphabet:
                found.add(w[:i] + c + w[i:])
                if i < len(w):
                    found.add(w[:i] + c + w[i + 1 :])
            if i < len(w):
                found.add(w[:i] + w[i + 1 :])
        near[w] = sorted((found & set(words)) - {w})
    return near


def made_words(seed, n):
    """Words over few letters, so that many are near, with runs of one letter and long ones."""
    rng = random.Random(seed)
    words = set()
    while len(words) < n:
        k = rng.choice((7, 7, 8, 8, 9, 10))
        words.add("".join(rng.choice("aé") for _ in range(k)) if rng.random() < 0.5 else
                  "same" + "".join(rng.choice("abcß") for _ in range(k - 4)))
    words |= {"a" * k for k in range(7, 20)} | {"ab" * 40, "ab" * 39 + "b", "ab" * 40 + "a", "x" * 300, "x" * 301}
    return {w: rng.choice((2, 3, 25, 200, 2500)) for w in sorted(words)}


@pytest.mark.parametrize("state_words, points", [(20_000, 1_500_000), (9, 400)])
def test_near_words(spark, monkeypatch, state_words, points):
    monkeypatch.setattr(spelling, "STATE_WORDS", state_words)
    monkeypatch.setattr(spelling, "TASK_POINTS", points)
    words = made_words(state_words, 500)
    df = spark.createDataFrame([(w, n, 1) for w, n in words.items()], "word string, n long, l int").select("word", "n")
    got = {r.word: (r.n_near, r.near, r.near_n) for r in spelling.near_words(df).collect()}
    want = {}
    for w, near in brute_near(list(words)).items():
        if near:
            best = min(near, key=lambda v: (-words[v], v))
            want[w] = (len(near), best, words[best])
    assert got == want and len(want) > 300
    # in small steps
    states = spelling.initial_states(df).where("l = 8").toArrow()
    whole = spelling._pairs(states)
    monkeypatch.setattr(spelling, "STEP", 50)
    assert spelling._pairs(states).equals(whole) and len(whole) > 100


def test_variants(make_docs):
    rng = random.Random(2)
    vocabulary = ["working", "workings", "wörking", "worÿking", "abcdefg", "abcdefgh", "abcdefghi", "xxxxxxx", "toolong" * 9]
    counts = [400, 40, 3, 4, 1000, 100, 10, 2, 5]
    runs = [w for w, n in zip(vocabulary, counts, strict=True) for _ in range(n)]
    rng.shuffle(runs)
    rows = [(i // 3, " ".join(w.upper() if rng.random() < 0.2 else w for w in runs[i : i + 5])) for i in range(0, len(runs), 5)]
    rows += [(None, "Working WORKING÷x9workings"), (7, None), (8, ""), (9, "short"), (9, "Ünusual Ünusual ünusual ünusual")]
    counted = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counted[run] += 1
    words = {w: n for w, n in counted.items() if n >= 2}
    form = {}
    near = brute_near(list(words))
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    got = {tuple(r) for r in spelling.variants(make_docs(rows)).collect()}
    want = {(w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}
    assert got == want
    assert any(r[2] not in (r[0], r[1]) for r in want)  # a chain of two
    assert spelling.variants(make_docs([(1, None), (2, "none here")])).isEmpty()
    assert spelling.variants(make_docs(rows).limit(0)).isEmpty()
