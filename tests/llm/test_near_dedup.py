"""Near-duplicates against weighted Jaccard similarities of all pairs."""

import math
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from feedloom.llm import minhash_dedup
from feedloom.llm.common import table

WORDS = [a + b for a in ("ka", "lo", "mi", "re", "tu", "so") for b in ("n", "ra", "s", "dol", "")]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(text, seed, n):
    rng = random.Random(seed)
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def weighted(texts, idf_weight=0.1, least=2):
    """Shingle weights of each text (None: no words), with document frequencies over all texts."""
    counts = []
    for text in texts:
        w = [x for x in (text or "").lower().split() if x]
        counts.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None)
    df = Counter(s for c in counts if c for s in c)
    n = len(texts)

    def weight(s):
        if df[s] < least:
            return 1 + idf_weight
        return 1 + idf_weight * min(max(math.log(n / df[s]) / max(math.log(max(n / least, 1)), 1e-9), 0), 1)

    return [c and {s: k * weight(s) for s, k in c.items()} for c in counts]


def similarity(a, b):
    shared = sum(min(a[s], b[s]) for s in a.keys() & b.keys())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def cases():
    a, b, c = prose(1, 120), prose(2, 150), prose(3, 90)
    rows = [
        (1, a), (5, edited(a, 1, 1)), (5, prose(9, 60)),  # one row of doc 5 is a copy, the other is not
        (6, prose(10, 50)), (6, prose(11, 50)),  # unlike texts under one doc_id
        (7, b), (7, b), (7, b.upper()), (8, edited(b, 2, 2)),  # repeats of the row that stays
        (None, edited(b, 3, 1)), (None, b), (None, prose(12, 70)),  # copies without doc_id, and one alone
        (None, c), (None, c), (None, edited(c, 4, 1)),  # a class without any doc_id
        (20, None), (20, None), (21, ""), (22, " \n"), (None, None), (23, "one"), (24, "One"), (25, "two words"),
    ]
    family = prose(4, 200)
    rows += [(100 + i % 40, edited(family, i, i % 9)) for i in range(70)]
    return rows


def test_against_all_pairs(make_docs):
    rows = cases()
    weights = weighted([t for _, t in rows])
    node = [None if t is None else tuple(t.lower().split()) or None for _, t in rows]
    of = {}
    for i, k in enumerate(node):
        if k:
            of.setdefault(k, i)
    names = list(of)
    root = {k: k for k in names}
    links = Counter()

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, k in enumerate(names):
        for m in names[:i]:
            if similarity(weights[of[k]], weights[of[m]]) >= 0.8:
                links[k] += 1
                links[m] += 1
                root[find(k)] = find(m)
    members = {}
    for i, k in enumerate(node):
        if k:
            members.setdefault(find(k), []).append(i)
    # many bands of one sample miss no pair here
    plan = minhash_dedup.Plan(bands=64, rows=1)
    got = minhash_dedup.near_duplicates(make_docs(rows), plan).collect()
    want = Counter()
    for i, (doc_id, _) in enumerate(rows):
        if node[i] is None:
            want[doc_id, doc_id, 0] += 1
        else:
            ids = [rows[j][0] for j in members[find(node[i])] if rows[j][0] is not None]
            want[doc_id, min(ids, default=None), links[node[i]]] += 1
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == want
    # exactly one row of each class stays, under its least doc_id; all rows without words stay
    docs = make_docs(rows).withColumnRenamed("u", "_at")
    left = minhash_dedup.first_of_each(docs, plan)
    assert left.columns == docs.columns
    left = [(r.doc_id, r.text) for r in left.collect()]
    kept = Counter()
    for doc_id, text in left:
        words = tuple((text or "").lower().split())
        if words:
            kept[find(words), doc_id] += 1
    assert kept == {
        (k, min((rows[j][0] for j in of_class if rows[j][0] is not None), default=None)): 1
        for k, of_class in members.items()
    }
    assert Counter(r for r in left if not (r[1] or "").split()) == Counter(r for r in rows if not (r[1] or "").split())


def test_frequencies_do_not_depend_on_size():
    """Counts by parts lose less than their bound, and a pair's weights stay as the corpus grows."""
    rng = np.random.default_rng(1)
    idf = minhash_dedup.Idf(np.sort(rng.integers(0, 2**63, 1000).astype(np.uint64)), np.arange(1000, dtype=np.float32), 7.0)
    rare = rng.integers(0, 2**63, 500).astype(np.uint64)
    assert (idf.of(idf.grams) == idf.weights).all() and (idf.of(rare) == 7).all()


def test_idf_weights(make_docs):
    rows = [(i, f"the common five words here {prose(i, 30)}" + (" every now and then again" if i % 3 else "")) for i in range(60)]
    rows.append((99, None))
    idf = minhash_dedup.idf_weights(make_docs(rows).repartition(4), minhash_dedup.Plan())
    weights = weighted([t for _, t in rows])
    want = sorted({round(w, 5) for c in weights if c for w in c.values()})
    assert sorted({round(float(w), 5) for w in [*idf.weights, idf.rare]}) == want and len(want) > 2
    none = minhash_dedup.idf_weights(make_docs(rows).limit(0), minhash_dedup.Plan())
    assert none.of(np.array([1], np.uint64)).tolist() == pytest.approx([1.1])


def near_by_frequencies():
    """Documents 1 and 2 are near as four documents share what 1 lacks; a long one beside them has many other shingles."""
    core, line = [f"c{i}" for i in range(104)], [f"x{i}" for i in range(26)]
    texts = [core, line + core, *(line + core[:4] + [f"o{k}w{i}" for i in range(60)] for k in range(3))]
    texts.append([f"w{i}" for i in range(1_200_000)])
    return [(i + 1, " ".join(words)) for i, words in enumerate(texts)]


def test_weights_in_a_large_corpus(make_docs):
    """Frequencies count in full beside any number of other shingles."""
    rows = near_by_frequencies()
    weights = weighted([t for _, t in rows])
    assert 0.8 <= similarity(weights[0], weights[1]) < 0.81
    got = {r.doc_id: (r.class_id, r.n_links) for r in minhash_dedup.near_duplicates(make_docs(rows)).collect()}
    assert got == {1: (1, 1), 2: (1, 1)} | {i: (i, 0) for i in range(3, 7)}


def test_pipeline_stage_in_a_large_corpus(spark, make_docs):
    """The stage drops the copy that frequencies decide."""
    left = corpus_pipeline.near_dedup(spark, make_docs(near_by_frequencies()), "")
    assert sorted(r.doc_id for r in left.select("doc_id").collect()) == [1, 3, 4, 5, 6]


def test_recall_on_given_documents(spark):
    """Ids divisible by 100 against all documents, production parameters."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    rows = docs.collect()
    weights = weighted([r.text for r in rows])
    of_class = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(docs).collect()}
    found = wanted = 0
    for i, a in enumerate(rows):
        if a.doc_id % 100 == 0 and weights[i]:
            for j, b in enumerate(rows):
                if i != j and weights[j] and weights[i].keys() & weights[j].keys() and similarity(weights[i], weights[j]) >= 0.8:
                    wanted += 1
                    found += of_class[a.doc_id] == of_class[b.doc_id]
    assert wanted > 0 and found >= 0.9 * wanted
