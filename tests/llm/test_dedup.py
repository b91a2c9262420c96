"""Line deduplication and the Jaccard join against plain versions."""

import random

import numpy as np
import pytest

from tapeframe.llm import jaccard, lines
from tapeframe.llm.components import components

from .odd_rows import LONG, ODD


def plain_lines(docs, min_words):
    """Deleted line numbers by definition: every run of min_words words that equals an earlier one."""
    first, gone = {}, {d: set() for d, _ in docs}
    found = []
    for d, text in docs:
        own = [(i, x.strip()) for i, x in enumerate((text or "").split("\n")) if x.strip()]
        for a in range(len(own)):
            words = 0
            for b in range(a, len(own)):
                words += len(own[b][1].split())
                if words >= min_words:
                    run = tuple(x for _, x in own[a:b + 1])
                    found.append((run, (d, own[a][0]), d, own[a][0], own[b][0]))
                    first[run] = min(first.get(run, (d, own[a][0])), (d, own[a][0]))
                    if b - a > 12:
                        break
    for run, at, d, lo, hi in found:
        if first[run] != at:
            gone[d].update(range(lo, hi + 1))
    return {d: "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone[d] or not x.strip()) for d, t in docs}


@pytest.mark.parametrize("seed,min_words", [(1, 6), (2, 4), (3, 9), (4, 1)])
def test_lines(docs_of, seed, min_words):
    rnd = random.Random(seed)
    stock = [" ".join(rnd.choices("abcdefgh", k=rnd.randint(1, 4))) for _ in range(7)]
    docs = []
    for d in range(30):
        own = [rnd.choice(stock) for _ in range(rnd.randint(0, 9))]
        if rnd.random() < 0.3:
            own.insert(rnd.randint(0, len(own)), "  ")
        docs.append((d, "\n".join(own)))
    got = {r.doc_id: r.text for r in lines.deduplicate(docs_of(docs), min_words).collect()}
    assert got == plain_lines(docs, min_words)


def test_passage_stays_once(docs_of):
    passage = " ".join(f"w{i}" for i in range(51))
    got = {r.doc_id: (r.text, r.n_lines, r.n_deleted) for r in lines.deduplicate(docs_of([(3, f"a\n{passage}\nb"), (1, passage), (2, f"{passage}\nc")])).collect()}
    assert got == {1: (passage, 1, 0), 2: ("c", 2, 1), 3: ("a\nb", 3, 1)}


def test_odd_lines(odd, none):
    got = lines.deduplicate(odd).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(ODD, key=repr)
    assert lines.deduplicate(none).count() == 0
    kept = lines.clean(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD)


def plain_classes(docs, n=5, threshold=0.8):
    sets = {}
    for d, t in docs:
        w = "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in (t or "").lower()).split()
        sets[d] = {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    near = {d: {e for e in sets if e != d and sets[d] and len(sets[d] & sets[e]) >= threshold * len(sets[d] | sets[e])} for d in sets}
    out = {}
    for d in sets:
        seen, todo = {d}, [d]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        out[d] = (min(seen), len(near[d]))
    return out


@pytest.mark.parametrize("block", [2, 256])
def test_jaccard(docs_of, block):
    rnd = random.Random(9)
    words = [f"v{i}" for i in range(400)]
    docs, d = [], 0
    for _ in range(12):
        base = rnd.choices(words, k=rnd.randint(3, 90))
        for _ in range(rnd.choice([1, 2, 3, 9])):
            own = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            docs.append((d, rnd.choice([" ", "  ", ", "]).join(own)))
            d += 1
    docs += [(d, ""), (d + 1, None), (d + 2, "..."), (d + 3, "one two"), (d + 4, "One, two")]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.classes(docs_of(docs), jaccard.JoinConfig(block=block)).collect()}
    assert got == plain_classes(docs)


def test_a_hub_of_near_copies_is_counted_whole(docs_of):
    base = [f"w{i}" for i in range(120)]
    docs = [(i, " ".join(base[:60] + [f"x{i}"] + base[60:])) for i in range(70)]
    got = jaccard.classes(docs_of(docs), jaccard.JoinConfig(block=8)).collect()
    assert {(r.class_id, r.n_links) for r in got} == {(0, 69)} and len(got) == 70


def test_odd_classes(odd, none):
    got = jaccard.classes(odd)
    rows = sorted(((r.doc_id, r.class_id, r.n_links) for r in got.collect()), key=repr)
    assert len(rows) == len(ODD) and (6, 6, 1) in rows and (4, 4, 1) in rows and (1, 1, 0) in rows
    assert jaccard.classes(none).count() == 0
    kept = jaccard.clean(odd)
    assert kept.columns == odd.columns
    assert sum(r.text == LONG for r in kept.select("text").collect()) == 1


@pytest.mark.parametrize("own_id", [None, 5])
def test_texts_under_one_id_keep_their_own_links(docs_of, own_id):
    texts = [[f"t{k}w{i}" for i in range(60)] for k in range(4)]
    near = [x[:30] + [f"new{k}"] + x[30:] for k, x in enumerate(texts)]
    docs = [(own_id, " ".join(x)) for x in texts] + [(10 + k, " ".join(x)) for k, x in enumerate(near)] + [(own_id, ""), (own_id, "single one"), (own_id, "Single, one")]
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard.classes(docs_of(docs)).collect()), key=repr)
    want = [(own_id, own_id, 1)] * 4 + [(10 + k, own_id, 1) for k in range(4)] + [(own_id, own_id, 0)] + [(own_id, own_id, 1)] * 2
    assert got == sorted(want, key=repr)
    kept = [(r.doc_id, r.text.lower().replace(",", "")) for r in jaccard.clean(docs_of(docs)).collect()]
    assert sorted(kept, key=repr) == sorted([(own_id, " ".join(x)) for x in texts] + [(own_id, ""), (own_id, "single one")], key=repr)


def test_banding_reaches_recall():
    for threshold in (0.5, 0.8, 0.9):
        bands, rows = jaccard.JoinConfig(threshold=threshold).banding()
        assert bands * rows <= 64 and 1 - (1 - threshold ** rows) ** bands >= 0.999


def test_intersections():
    random_ = np.random.default_rng(0)
    sets = [np.unique(random_.integers(0, 50, k)).astype(np.uint64) for k in (1, 9, 30, 30, 40)]
    got = jaccard.intersections(sets, width=7)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j:
                assert got[i, j] == len(np.intersect1d(a, b))


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(rnd.randint(100, 160), rnd.randint(100, 160)) for _ in range(50)] + [(500, i) for i in range(501, 560)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for a, b in edges if a != b for x in (a, b)}
