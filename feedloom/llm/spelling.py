"""Spelling variants: words of a vocabulary that are one edit apart, by composing automata.

The pairs of words that differ by one inserted, deleted or replaced code point are what
the composition A o T o A accepts, with A the minimised acceptor of the vocabulary and T a
transducer that copies its input but for one edit. A state of the composition is (p, t, q)
with t before or after the edit. Before it, both acceptors have read the same, so p = q.

The composition is cut up by initial states. Words go by class: those of n code points,
and those with one more. A pair of a class is alike up to its first difference and after
it; this comes either in the first half of the shorter word or later, so the pair shares
the beginning or the end that the difference leaves. What it shares is read at once: it
leads to an initial state of its own, from which only the middles are left to read. An
initial state with too many words is split again by the same rule, until the middles have
a code point or two. Each pair belongs to one initial state.

A task takes many initial states, builds one minimised acceptor of all their middles, and
enumerates the accepted pairs from there, all states of a step at once. Equal states of
different prefixes are walked once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import stored

#: Words have so many code points and occurrences at least.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form is so many times as frequent as its variant, at least.
RATIO = 10
#: An initial state with more words is split; code points of a task's middles; pairs of
#: states and of words worked on at once.
STATE_WORDS, TASK_POINTS, STEP = 20_000, 1_500_000, 1_000_000
_RUN = r"([A-Za-zÀ-ÿ]{%d,})"
_GREAT, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame) -> DataFrame:
    """word and n (occurrences) of all whole texts; one occurrence in 31 or so has lost a code point.

    The loss is part of the data's definition: of a run whose crc32 with its doc_id is a
    multiple of 31, the code point at crc32 modulo length goes. A null doc_id counts as
    an empty one.
    """
    runs = F.regexp_extract_all("text", F.lit(_RUN % LEAST_LENGTH), F.lit(1))
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    run = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _GREAT, _SMALL)).otherwise(F.col("run"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return (
        docs.where("text is not null").select(doc.alias("doc"), F.explode(runs).alias("run"))
        .select("doc", run.alias("run")).withColumn("h", h)
        .select(F.when(F.col("h") % 31 == 0, less).otherwise(F.col("run")).alias("word"))
        .where(F.length("word") >= LEAST_LENGTH)
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)
    )


# --- initial states


def _state(lo: Column, hi: Column) -> list[Column]:
    """l, lo, hi and the initial state's name: pairs whose first difference is in [lo, hi) of the shorter word."""
    of = F.col("l")
    tail = of - F.least(hi, of)
    lead, end = F.substring("word", F.lit(1), lo), F.substring("word", F.length("word") - tail + 1, tail)
    name = F.concat_ws("\0", of, lo, hi, lead, end)
    return [F.col("word"), F.col("n"), of, lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), name.alias("state")]


def _halves(rows: DataFrame) -> DataFrame:
    """Each row (word, n, l, lo, hi) under the initial states of both halves."""
    middle = F.expr("lo + (least(hi, l) - lo) div 2").cast("int")
    both = rows.withColumn("middle", middle)
    late = both.select(*_state(F.col("middle"), F.col("hi")))
    return late.unionByName(both.select(*_state(F.col("lo"), F.col("middle"))))


def initial_states(words: DataFrame) -> DataFrame:
    """word, n, l (of the class), lo, hi and state, for all initial states that the words lead to."""
    classes = words.withColumn("l", F.explode(F.array(F.length("word"), F.length("word") - 1)))
    rows = classes.where(F.col("l") >= LEAST_LENGTH).withColumn("lo", F.lit(0)).withColumn("hi", F.col("l") + 1)
    done = None
    while True:
        rows = stored(_halves(rows), "spelling-states")
        large = stored(
            rows.groupBy("state").agg(F.count(F.lit(1)).alias("k"), F.first(F.expr("least(hi, l) - lo")).alias("m"))
            .where((F.col("k") > STATE_WORDS) & (F.col("m") > 1)).select("state"),
            "spelling-large",
        )
        if large.isEmpty():
            return done.unionByName(rows) if done else rows
        few = rows.join(large, "state", "left_anti").select(rows.columns)
        done = done.unionByName(few) if done else few
        rows = rows.join(large, "state", "left_semi").select("word", "n", "l", "lo", "hi")


# --- the composition


class Acceptor:
    """The minimised acceptor of many sets of words, each with an initial state of its own.

    ``rows`` are distinct words as code points, zeros after the end, sorted by set and word.
    ``ends`` is each row's length, ``longest`` the greatest one that its set could have. States
    with the same way to go to ``longest`` are merged if they accept the same.

    Of each tree node: ``first`` (its first row) and ``merged`` (its state). Of each state:
    ``left`` (code points to go to ``longest``), ``final``, and arcs from ``arc[state]`` on
    with ``label``, ``target`` and ``skip`` (words that come before it in the state).
    """

    def __init__(self, sets: np.ndarray, rows: np.ndarray, ends: np.ndarray, longest: np.ndarray) -> None:
        n, width = rows.shape
        same = np.zeros(n, np.int64)  # code points shared with the row before
        alike = sets[1:] == sets[:-1]
        fresh = np.r_[True, ~alike]
        for d in range(width):
            alike &= (rows[1:, d] == rows[:-1, d]) & (ends[1:] > d)
            same[1:][alike] = d + 1
        first, label, parent, left, begin = [], [], [], [], 0
        above = None
        for d in range(width + 1):
            new = (ends >= d) & (fresh | (same < d))
            at = np.flatnonzero(new)
            first.append(at)
            label.append(rows[at, d - 1].astype(np.int64) if d else np.zeros(len(at), np.int64))
            parent.append(above[at] if d else np.full(len(at), -1))
            left.append(longest[at] - d)
            above = begin + np.cumsum(new) - 1
            begin += len(at)
        self.first = np.concatenate(first)
        depth = np.repeat(np.arange(width + 1), [len(x) for x in first])
        label, parent, left = np.concatenate(label), np.concatenate(parent), np.concatenate(left)
        final = ends[self.first] == depth
        # children of a node, by label: they come in that order
        child = np.argsort(parent, kind="stable")
        child = child[parent[child] >= 0]
        n_arcs = np.bincount(parent[child], minlength=len(parent))
        start = np.cumsum(n_arcs) - n_arcs
        self.merged = np.full(len(parent), -1)
        shown, n_states = [], 0  # a node of each state
        order = np.argsort(left, kind="stable")
        edges = np.searchsorted(left[order], np.arange(int(left.max(initial=-1)) + 2))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            nodes = order[lo:hi]
            code = final[nodes].astype(np.int64)
            for k in range(int(n_arcs[nodes].max(initial=0))):
                have = np.flatnonzero(n_arcs[nodes] > k)
                arc = child[start[nodes[have]] + k]
                _, way = np.unique(label[arc] << 32 | self.merged[arc], return_inverse=True)
                step = np.zeros(len(nodes), np.int64)
                step[have] = way + 1
                _, code = np.unique(code << 32 | step, return_inverse=True)
            _, at, number = np.unique(code, return_index=True, return_inverse=True)
            self.merged[nodes] = n_states + number
            shown.append(nodes[at])
            n_states += len(at)
        node = np.concatenate(shown) if shown else np.zeros(0, np.int64)
        self.left, self.final = left[node], final[node]
        n_of = n_arcs[node]
        self.arc = np.r_[0, np.cumsum(n_of)]
        arcs = child[np.repeat(start[node] - self.arc[:-1], n_of) + np.arange(self.arc[-1])]
        self.label, self.target = label[arcs], self.merged[arcs]
        self.skip = self.first[arcs] - np.repeat(self.first[node], n_of)
        self._key = np.repeat(np.arange(len(node)), n_of) << 32 | self.label

    def arcs(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All arcs of ``states``: the place of the state, and the arc."""
        n = self.arc[states + 1] - self.arc[states]
        at = np.repeat(np.arange(len(states)), n)
        before = np.cumsum(n) - n
        return at, np.repeat(self.arc[states] - before, n) + np.arange(len(at))

    def follow(self, states: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The arc of each state with that label, or -1."""
        key = states << 32 | label
        at = np.minimum(np.searchsorted(self._key, key), len(self._key) - 1)
        return np.where(self._key[at] == key, at, -1)


def _edits(a: Acceptor, states: np.ndarray) -> tuple[np.ndarray, ...]:
    """What follows the edit in (p, before, p): origin p, both states, words skipped, label not to go on with."""
    of, arc = a.arcs(states)
    p = states[of]
    # a code point more on the right side; where the same one comes next on the left,
    # the words differ later only
    inserted = (p, p, a.target[arc], np.zeros_like(arc), a.skip[arc], a.label[arc])
    # another code point: each arc with those after it
    last = a.arc[p + 1]
    n = last - arc - 1
    x = np.repeat(arc, n)
    y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
    replaced = (np.repeat(p, n), a.target[x], a.target[y], a.skip[x], a.skip[y], np.full(len(x), -1))
    return tuple(np.concatenate(both) for both in zip(inserted, replaced, strict=True))


def accepted(a: Acceptor) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of the composition by the state before their edit: the state, and the places of both words in it.

    The left word is one short of the longest; the right one is so too, or the longest.
    """
    found = []
    n_arcs = np.diff(a.arc)
    work = np.cumsum(n_arcs * (n_arcs + 1) // 2)
    lo = 0
    while lo < len(n_arcs):
        hi = max(lo + 1, int(np.searchsorted(work, (work[lo - 1] if lo else 0) + STEP, "right")))
        origin, p, q, i, j, bar = _edits(a, np.arange(lo, hi))
        lo = hi
        while len(p):
            end = (a.left[p] == 1) & a.final[p] & a.final[q]
            found.append((origin[end], i[end], j[end]))
            on = np.flatnonzero(a.left[p] > 1)
            parts = []
            for at in range(0, len(on), STEP):
                some = on[at : at + STEP]
                of, x = a.arcs(p[some])
                of = some[of]
                y = a.follow(q[of], a.label[x])
                both = (y >= 0) & (a.label[x] != bar[of])
                of, x, y = of[both], x[both], y[both]
                parts.append((origin[of], a.target[x], a.target[y], i[of] + a.skip[x], j[of] + a.skip[y], np.full(len(of), -1)))
            if not parts:
                break
            origin, p, q, i, j, bar = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _pairs(rows: pa.Table) -> pa.Table:
    """word, n_near and the best near word of each word, for the initial states of one task."""
    rows = rows.combine_chunks()
    words = rows["word"].to_pylist()
    l = rows["l"][0].as_py()
    lo, hi = rows["lo"].to_numpy().astype(np.int64), rows["hi"].to_numpy().astype(np.int64)
    n = rows["n"].to_numpy()
    points = np.array(words, f"<U{l + 1}").view(np.uint32).reshape(len(words), l + 1)
    until = np.minimum(hi, l)
    longest = until - lo + 1  # of a middle; the shorter words' have one less
    ends = np.where(points[:, l] > 0, longest, longest - 1)
    place = lo[:, None] + np.arange(int(longest.max()))
    middles = np.take_along_axis(points, np.minimum(place, l), 1)
    middles[np.arange(middles.shape[1]) >= ends[:, None]] = 0
    sets = rows["state"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    order = np.lexsort((*middles.T[::-1], sets))
    a = Acceptor(sets[order], middles[order], ends[order], longest[order])
    origin, i, j = accepted(a)
    # the pairs of a state are those of all tree nodes merged into it
    by_state = np.argsort(origin, kind="stable")
    origin, i, j = origin[by_state], i[by_state], j[by_state]
    first = np.searchsorted(origin, a.merged)
    n_pairs = np.searchsorted(origin, a.merged, "right") - first
    n_near = np.zeros(len(words), np.int64)
    rank = np.empty(len(words), np.int64)  # by n, then from the last word to the first
    word_order = np.argsort(np.argsort(np.array(words)))
    better = np.lexsort((-word_order, n))
    rank[better] = np.arange(len(words))
    best = np.full(len(words), -1)
    some = np.flatnonzero(n_pairs)
    done = np.cumsum(n_pairs[some])
    at = 0
    while at < len(some):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + STEP, "right")))
        nodes = some[at:to]
        at = to
        k = n_pairs[nodes]
        pair = np.repeat(first[nodes] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        base = np.repeat(a.first[nodes], k)
        u, v = order[base + i[pair]], order[base + j[pair]]
        # in the first half of a split, what is alike up to the split is not ours
        own = (points[v, l] == 0) | (hi[u] > l) | (np.repeat(a.left[a.merged[nodes]], k) > 1)
        u, v = u[own], v[own]
        n_near += np.bincount(u, minlength=len(words)) + np.bincount(v, minlength=len(words))
        np.maximum.at(best, u, rank[v])
        np.maximum.at(best, v, rank[u])
    has = np.flatnonzero(n_near)
    top = better[best[has]]
    return pa.table({
        "word": rows["word"].take(pa.array(has)), "n_near": pa.array(n_near[has]),
        "near": rows["word"].take(pa.array(top)), "near_n": pa.array(n[top], pa.int64()),
    })


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, near and near_n: how many words of ``words`` (word, n) are one edit away, and the most frequent."""
    rows = initial_states(words)
    of_class = rows.groupBy("l").agg(
        F.ceil(F.sum(F.least("hi", "l") - F.col("lo") + 1) / TASK_POINTS).cast("int").alias("tasks")
    )
    dealt = rows.join(of_class, "l").withColumn("task", F.pmod(F.xxhash64("state"), "tasks"))
    # dealt out by task: a shuffle by l for the join would do for Spark
    tasks = dealt.select("l", "task", "word", "n", "lo", "hi", "state").repartition("l", "task")
    parts = tasks.groupBy("l", "task").applyInArrow(
        _pairs, "word string, n_near long, near string, near_n long"
    )
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", "best.near", (-F.col("best.less")).alias("near_n")
    )


def roots(forms: DataFrame) -> DataFrame:
    """word and root, from ``forms`` (word, form): the last of the chain that begins at each word.

    Chains are followed in jumps of double length. A form is ten times as frequent as its
    word, so a chain has at most as many links as the greatest count has digits.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        next_one = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if now.join(next_one, "root", "left_semi").isEmpty():
            return now
        now = stored(
            now.join(next_one, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots"
        )


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n for each word of ``docs`` (doc_id, text).

    ``form`` is the most frequent word one edit away (ties: the first in code-point order) if it
    is ``RATIO`` times as frequent, else null; ``root`` is where following forms ends. Null and
    empty texts have no words, a repeated row counts again, and other columns are not
    looked at. No words, no rows.
    """
    words = stored(vocabulary(docs), "spelling-words")
    near = near_words(words)
    is_form = F.col("near_n") >= F.col("n") * RATIO
    found = stored(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"),
        ),
        "spelling-near",
    )
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
