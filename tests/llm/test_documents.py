"""Operators on documents against brute force, with null, empty, repeated and long rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import class_lm, decontaminate, language_id, minhash_dedup, mixing, pii, substring_dedup

WORDS = [a + b for a in ("ka", "lo", "mi", "re", "tu", "so", "ne", "pa") for b in ("n", "ra", "s", "dol", "")]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_rows():
    base = prose(1, 120)
    return [
        (1, base), (2, base), (3, base.upper()), (4, None), (5, ""), (6, " \t\n "), (7, "one"),
        (8, prose(2, 60) + " " + base[:300] + " " + prose(3, 60)), (9, "a " * 60), (10, prose(4, 9000)),
        (11, "Ünïcode 😀 " * 30), (12, prose(5, 25)), (12, prose(6, 25)), (13, base), (13, base),
    ]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_substring_dedup(make_docs):
    base = prose(1, 120)
    rows = odd_rows() + [(None, base[60:]), (None, f"{prose(41, 30)} {base}"), (None, prose(42, 40)), (14, prose(42, 40)), (None, None)]
    docs = make_docs(rows)
    got = substring_dedup.digest(substring_dedup.without_repeats(docs)).collect()
    rows = [(-1 if i is None else i, t) for i, t in rows]  # null comes first
    seen, want = {}, []
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    for i in order:
        words = words_of(rows[i][1])
        for at in range(len(words) - 19):
            key = tuple(words[at : at + 20])
            seen[key] = min(seen.get(key, (10**9, 0)), (rows[i][0], at))
    for doc_id, text in rows:
        words = words_of(text)
        gone = set()
        for at in range(len(words) - 19):
            if seen[tuple(words[at : at + 20])] < (doc_id, at):
                gone |= set(range(at, at + 20))
        kept = [w for i, w in enumerate(words) if i not in gone]
        want.append((doc_id, len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == sorted(want)
    assert substring_dedup.without_repeats(docs.limit(0)).isEmpty()


def test_mixing(make_docs):
    rows = [(i, prose(i, 40 + i % 50), None, f"s{i % 7}" if i % 9 else None) for i in range(300)]
    rows += [(400, None, None, "s1"), (401, "", None, "empty"), (402, "tiny one", None, "tiny"), (0, "a b", None, "s0")]
    docs = make_docs(rows)
    rows += [(None, "null one two"), (None, "null one two"), (5, rows[5][1], None, rows[5][3]), (5, rows[5][1], None, "s0")]
    docs = make_docs(rows)
    mix = mixing.mixture(docs)
    written = mix.written(docs)
    got = mix.taken(written).collect()
    other = docs.repartition(5)
    again = mixing.mixture(other)
    again = again.taken(again.written(other)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert len(got) == len(rows)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
    for r in got:
        assert abs(taken[r.source] - r.target) <= 64
    # the written blocks hold the words that are counted as taken, whole and in order
    blocks = written.collect()
    streams = {}
    for r in sorted(mix.docs.collect(), key=lambda r: (r.source_no, r.start, r["size"])):
        text = next(t for i, t, *_ in rows if i == r.doc_id and len(words_of(t)) == r["size"])
        streams.setdefault(r.source_no, []).extend(words_of(text))
    for b in blocks:
        want = streams[b.source_no][64 * b.block : 64 * b.block + 64]
        assert b.text.split() == want and sum(m.n_words for m in b.members) == len(want)
    assert sum(len(b.text.split()) for b in blocks) == sum(r.taken for r in got)
    assert len({(b.source_no, b.slot) for b in blocks}) == len(blocks) == mix.slots.count()
    empty = mixing.mixture(docs.limit(0))
    assert empty.taken(empty.written(docs.limit(0))).isEmpty()


def test_targets_stop_and_reshare():
    assert mixing.targets([100, 10, 10], [1, 2, 3], 120, 3) == [60.0, 30.0, 30.0]
    assert mixing.targets([], [], 0, 3) == []


def test_language_id(make_docs):
    alphabet = {"en": "the and with", "de": "der und mit", "fr": "les dans pour", "es": "los para una"}
    rng = random.Random(3)
    rows = []
    for i in range(240):
        lang = list(alphabet)[i % 4]
        rows.append((i, " ".join(rng.choice(alphabet[lang].split()) for _ in range(30)), lang))
    odd = [(900, None, "en"), (901, "", "en"), (902, "123 !!", "de"), (903, "the and with", None), (None, "der und", "de")]
    docs = make_docs(rows + odd)
    found = language_id.identify(docs.drop("lang"), language_id.train(docs))
    got = {r.doc_id: (r.lang_pred, r.score) for r in found.collect()}
    assert all(got[i][0] == lang for i, _, lang in rows)
    assert got[900] == got[901] == got[902] == ("und", 0.0)
    assert got[903][0] == "en" and all(0 <= s <= 1 for _, s in got.values())
    for kind in ("int", "string"):  # doc_ids of other types, and many rows of one doc_id
        typed = docs.withColumn("doc_id", docs["doc_id"].cast(kind))
        again = language_id.identify(typed.drop("lang"), language_id.train(typed))
        assert [r.lang_pred for r in again.where("doc_id = 7").collect()] == [rows[7][2]]
    one_id = docs.withColumn("doc_id", F.lit(7).cast("long"))
    assert len(language_id.train(one_id, per_language=30).families.names) == 2
    kept = language_id.identify(docs, language_id.train(docs), keep=0.1)
    assert kept.columns == docs.columns and kept.where("doc_id between 900 and 902").isEmpty()
    assert language_id.train(docs.limit(0)) is None


def test_near_duplicates(make_docs):
    rng = random.Random(5)
    base = prose(50, 300).split()

    def changed(n):
        words = list(base)
        for _ in range(n):
            words[rng.randrange(len(words))] = f"x{rng.random()}"
        return " ".join(words)

    rows = [(100 + i, changed(i % 14)) for i in range(60)]
    rows += [(i, prose(i, 80)) for i in range(1, 20)]
    rows += [(300, None), (301, ""), (302, "one two"), (303, "One two"), (304, "three"), (1, prose(1, 80)), (305, " ")]
    docs = make_docs(rows)
    got = {(r.doc_id): r for r in minhash_dedup.near_duplicates(docs).collect()}
    sets = {}
    for doc_id, text in rows:
        w = (text or "").lower().split()
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    for a in sets:
        for b in sets:
            if sets[a] and sets[b]:
                j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                if j >= 0.83:
                    assert got[a].class_id == got[b].class_id
                elif not (100 <= a < 200 and 100 <= b < 200) and a != b and j < 0.7:
                    assert got[a].class_id != got[b].class_id
    left = [r.doc_id for r in minhash_dedup.first_of_each(docs).collect()]
    assert len(left) == len(set(left)) == len({r.class_id for r in got.values()})
    assert minhash_dedup.first_of_each(docs).columns == docs.columns
    assert minhash_dedup.near_duplicates(docs.limit(0)).isEmpty()


def test_all_links_of_a_large_family(make_docs):
    base = prose(60, 200).split()
    rows = [(i, " ".join([*base[: 3 * i], f"own{i}", *base[3 * i + 1 :]])) for i in range(60)]
    got = minhash_dedup.near_duplicates(make_docs(rows)).collect()
    assert [r.n_links for r in got] == [59] * 60  # each pair is 0.95 alike


def test_blocks_count_each_link_once(make_docs, monkeypatch):
    rng = random.Random(12)
    base = prose(61, 200).split()
    rows = []
    for i in range(90):
        words = list(base)
        for k in rng.sample(range(200), i % 6):
            words[k] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, prose(300 + i, 60)) for i in range(30)]
    plan = minhash_dedup.Plan(threshold=0.85)

    def links():
        return sorted(map(tuple, minhash_dedup.near_duplicates(make_docs(rows), plan).collect()))

    whole = links()
    monkeypatch.setattr(minhash_dedup, "BLOCK_ROWS", 7)
    assert links() == whole
    monkeypatch.setattr(minhash_dedup, "SMALL_BUCKET", 10_000)  # all as lists of pairs
    assert links() == whole


def test_decontaminate(spark, make_docs):
    items = [prose(70 + i, 30) for i in range(6)] + ["short", "", None]
    items.append(items[0])
    items += ["Zq", "A b", "twenty letters only x", "eightish"]  # 10 to 13
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    edited = items[2][:40] + "zz" + items[2][42:]
    rows = [
        (1, prose(90, 50) + " " + items[1] + " " + prose(91, 50)), (2, prose(92, 200)), (3, None), (4, ""),
        (5, f"{prose(93, 20)}. {edited.upper()}! {prose(94, 20)}"), (6, items[0].replace(" ", "\n")),
        (7, prose(95, 9000) + " " + items[3]), (8, items[4][: len(items[4]) // 2]), (2, prose(92, 200)),
        (20, "zqs ab shorts"), (21, "x-ZQ."), (22, "a, B"), (23, "tweny lettrs only x"), (24, "twxnty lxttxrs only x"),
        (25, "pre-EIGHTISH"), (26, "eightsh"), (None, "the short zq"), (None, "the short zq"), (27, "short"),
    ]
    docs = make_docs(rows)
    got = {(r.doc_id, r.item_id): (r.edits, r.start, r.end) for r in decontaminate.contaminated(docs, bench).collect()}
    words = {(21, 10), (22, 11), (23, 12), (25, 13), (None, 6), (None, 10), (27, 6)}
    assert set(got) == {(1, 1), (5, 2), (6, 0), (6, 9), (7, 3)} | words
    assert got[21, 10] == (0, 2, 4) and got[22, 11] == (0, 0, 4) and got[23, 12][0] == 2
    text = rows[0][1]
    assert text[slice(*got[1, 1][1:])] == items[1] and got[1, 1][0] == 0 and 0 < got[5, 2][0] <= 2
    # a benchmark that is joined gives the same rows, repeated ones too
    whole = Counter(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    assert Counter(map(tuple, decontaminate.contaminated(docs, bench, index_chars=0).collect())) == whole
    assert whole[None, 6, 0, 4, 9] == 2
    for index_chars in (0, 10**6):
        left = decontaminate.without_contaminated(docs, bench, index_chars=index_chars)
        assert sorted(r.doc_id for r in left.collect()) == [2, 2, 3, 4, 8, 20, 24, 26] and left.columns == docs.columns
        none = decontaminate.contaminated(docs.limit(0), bench, index_chars=index_chars)
        assert none.isEmpty() and decontaminate.contaminated(docs, bench.limit(0), index_chars=index_chars).isEmpty()


def test_decontaminate_against_all_alignments(make_docs, spark):
    """Every passage within the budget is found: edit distances of all items in all texts."""
    rng = random.Random(21)
    items = [prose(700 + i, 2 + i) for i in range(12)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")

    def damaged(text, n):
        chars = list(text)
        for _ in range(n):
            at = rng.randrange(len(chars))
            chars[at : at + 1] = rng.choice(([], ["x"], [chars[at], "y"]))
        return "".join(chars)

    rows = [(i, f"{prose(800 + i, 5)} {damaged(items[i % 12], i % 7)} {prose(900 + i, 5)}") for i in range(60)]
    plain = lambda t: re.sub("[^a-z0-9]+", " ", t.lower()).strip()

    def least(item, text):
        now = [0] * (len(text) + 1)
        for i, a in enumerate(item, 1):
            before, now = now, [i]
            for j, b in enumerate(text, 1):
                now.append(min(before[j - 1] + (a != b), before[j] + 1, now[-1] + 1))
        return min(now)

    want = set()
    for doc_id, text in rows:
        for item_id, item in enumerate(items):
            edits = least(plain(item), plain(text))
            if edits <= int(0.1 * len(plain(item))):
                want.add((doc_id, item_id, edits))
    for index_chars in (0, 10**6):
        found = decontaminate.contaminated(make_docs(rows), bench, index_chars=index_chars).collect()
        assert {(r.doc_id, r.item_id, r.edits) for r in found} == want
    assert len(want) > 20


def test_alignment_finds_all_within_budget():
    rng = random.Random(8)
    item = prose(77, 30)
    index = decontaminate.Index.build([(0, item)])
    budget = int(index.budget[0])
    for _ in range(40):
        chars = list(item)
        for _ in range(rng.randrange(budget + 1)):
            at = rng.randrange(1, len(chars) - 1)
            kind = rng.random()
            if kind < 0.4:
                chars[at] = rng.choice("abcdefg")
            elif kind < 0.7:
                chars.insert(at, rng.choice("abcdefg"))
            else:
                del chars[at]
        found = index.search([prose(rng.random(), 20) + " " + "".join(chars) + " " + prose(rng.random(), 20)])
        assert len(found) == 1 and found[0][2] <= budget


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1]))
                if not 13 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_pii_base_spans():
    rng = random.Random(9)
    pieces = [
        "a@b.c", "x.y@mail.example.com", "a@b@c.de", "@", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111111111111111",
        "4111-1111 1111 1111", "+1 (076) 555-8046", "+49", "+", " ", "\n", "😀", "5", "0001.2.3.255", "a@b..c", "é@x.yz", "-",
    ]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("9" * 200_000 + "@" * 50_000 + "1." * 50_000)[:1] is not None


def test_pii(make_docs):
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    rows = [(1, f'é😀 token = "{key}" of x.y@mail.org and +1 (076) 555-8046.'), (2, None), (3, ""), (4, prose(1, 300)), (4, prose(1, 300))]
    docs = make_docs(rows)
    got = pii.find_pii(docs).collect()
    spans = [tuple(s) for r in got if r.doc_id == 1 for s in r.spans]
    assert [rows[0][1][a:b] for _, a, b in spans] == ["x.y@mail.org", "+1 (076) 555-8046", key]
    assert [s[0] for s in spans] == ["email", "phone", "secret"]
    assert all(not r.spans for r in got if r.doc_id != 1) and len(got) == len(rows)
    masked = {r.doc_id: r for r in pii.mask_pii(docs).collect()}
    assert masked[1].text == 'é😀 token = "<secret>" of <email> and <phone>.'
    assert masked[1].n_chars == len(masked[1].text) and masked[2].text is None and masked[2].node == 1


@pytest.mark.parametrize("looked_up", [class_lm.LOOKED_UP, 20, 0])
def test_class_lm(make_docs, monkeypatch, looked_up):
    monkeypatch.setattr(class_lm, "LOOKED_UP", looked_up)
    rows = [*odd_rows(), *[(i, prose(i, 50)) for i in range(20, 60)], (99, "never seen before")]
    docs = make_docs(rows)
    model = class_lm.train(docs.where("doc_id < 50"))
    counts = Counter()
    tokens = {}
    for i, (doc_id, text) in enumerate(rows):
        tokens[i] = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words_of(text)] + [None]
        if doc_id < 50:
            counts.update(tokens[i])
    total, distinct = sum(counts.values()), len(counts)
    want = Counter()
    for i, (doc_id, _) in enumerate(rows):
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens[i])
        known = sum(counts[w] > 0 for w in tokens[i])
        want[doc_id, len(tokens[i]), known, total, round(base, 6)] += 1
    got = class_lm.score(docs, model).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    if looked_up:
        assert sum(r.score for r in got) > sum(r.base_score for r in got)
    empty = class_lm.train(docs.limit(0))
    assert class_lm.score(docs, empty).where("n_known > 0").isEmpty()


def test_class_sweep(make_docs):
    """Neighbours are counted and classes chosen as by hand; sweeps raise the likelihood."""
    rng = random.Random(9)
    nouns, verbs = [f"n{i}" for i in range(30)], [f"v{i}" for i in range(30)]
    rows = [(i, " ".join(f"the {rng.choice(nouns)} {rng.choice(verbs)}" for _ in range(20))) for i in range(80)]
    rows += [(900, None), (901, "")]
    docs = make_docs(rows)
    words = {}
    for _, text in rows:
        for w in words_of(text):
            raw = np.frombuffer(w.encode(), np.uint8)
            words[int(class_lm.hash_words(raw, np.array([0]), np.array([len(raw)]))[0])] = w
    hashes = np.array(sorted([*words, int(class_lm._END)]), np.uint64)
    k = 4
    start = np.array([0 if h == class_lm._END else 1 + i % 3 for i, h in enumerate(hashes.tolist())])
    classes = class_lm.Classes(hashes, start, np.ones(class_lm.ENDING_UNITS, np.int64))
    of = {words.get(h): c for h, c in zip(hashes.tolist(), start.tolist(), strict=True)}
    moves, near = np.zeros((k, k), np.int64), Counter()
    flow = [w for _, text in rows for w in [*words_of(text), None]]
    at = {w: i for i, w in enumerate(words.get(h) for h in hashes.tolist())}
    for _, text in rows:
        tokens = [None, *words_of(text), None]
        for a, b in zip(tokens[:-1], tokens[1:], strict=True):
            moves[of[a], of[b]] += 1
    assert (class_lm.count_class_moves(docs, classes, k) == moves).all() and len(flow) == moves.sum()
    for _, text in rows:
        tokens = words_of(text)
        for i, w in enumerate(tokens):
            near[at[w], of[tokens[i - 1]] if i else 0, "before"] += 1
            near[at[w], of[tokens[i + 1]] if i + 1 < len(tokens) else 0, "after"] += 1
    got = Counter()
    for r in class_lm.count_neighbours(docs, classes, k).collect():
        place, cell = divmod(r.cell, 2 * k)
        if hashes[place] != class_lm._END:
            got[place, cell % k, "before" if cell >= k else "after"] += r.n
    assert got == near
    moved = class_lm.sweep(docs, classes, moves)
    after = class_lm.count_class_moves(docs, moved, k)
    assert class_lm.likelihood(after) > class_lm.likelihood(moves)
    found = {words.get(h): c for h, c in zip(hashes.tolist(), moved.of_word.tolist(), strict=True)}
    assert len({found[n] for n in nouns}) == 1 and len({found[v] for v in verbs}) == 1 and found["n1"] != found["v1"]
