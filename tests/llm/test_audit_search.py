"""Filter audit, similarity sketches and ranked search beside plain versions."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import rows_of
from vitalgrid.llm import fast_sketch, ranked_search
from vitalgrid.llm.filter_audit import filter_interactions
from vitalgrid.llm.term_matrix import row_counts, term_matrix

LABELS = "doc_id long, quality int, toxic int, text string"


def split(text):
    return (text or "").encode().split()


def fails(rows):
    """For each row the set of failed filters."""
    least = {}
    for doc, text in rows:
        if doc is not None:
            least[text or ""] = min(least.get(text or "", doc), doc)
    out = []
    for doc, text in rows:
        t, w = text or "", split(text)
        out.append({
            f for f, bad in zip("ABCDE", (
                len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)),
                doc is not None and least[t] < doc), strict=True) if bad})
    return out


def plain_audit(rows, labels):
    """rows: (doc_id, text, part)."""
    failed = fails([r[:2] for r in rows])
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, x in labels if x == 1}
    out, share = {}, Counter()
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], f) for r, f in zip(rows, failed, strict=True) if (r[2] or "") == part]
        for order in map("".join, permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                gone = [d for d, f in mine if letter in f and not f & set(order[: step - 1])]
                share[part, letter] += len(gone)
                out[part, order, step] = (
                    sum(not f & set(order[:step]) for _, f in mine), len(gone),
                    sum(letter in f and bool(f & set(order[: step - 1])) for _, f in mine), sum(f == {letter} for _, f in mine),
                    sum(d in good for d in gone), sum(d in toxic for d in gone))
    return {k: (*v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_interactions(spark, frame, odd_rows):
    rows = odd_rows + [(*r[:2], lang, *r[3:]) for lang, r in zip((None, "fr", "fr", ""), rows_of(["MANY CAPS HERE", "cost $5 | #1", "word " * 250, None], 700), strict=True)]
    labels = [(9, 1, 0), (10, 0, 1), (12, 1, 1), (700, 1, None), (702, None, 1), (702, 1, 0), (None, 1, 1)]
    got = filter_interactions(frame(rows), spark.createDataFrame([(*x, "clash") for x in labels], LABELS)).collect()
    want = plain_audit([(r[0], r[1], r[2]) for r in rows], [x for x in labels if x[0] is not None])
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in columns) for r in got} == want
    assert len(got) == len(want) and any(v[2] for v in want.values()) and any(v[4] for v in want.values())


def test_empty_audit(spark, frame):
    assert filter_interactions(frame([]), spark.createDataFrame([], LABELS)).collect() == []


def test_third_of_rows_share_text_and_id(spark, frame):
    rows = rows_of([f"text {i} here" for i in range(40)]) + rows_of(["the same text"] * 30, 100) + [(None, "the same text", "en", "s", 1, 1, "w", "x", 7, 0)] * 9
    got = filter_interactions(frame(rows), spark.createDataFrame([], LABELS)).where("filter_order = 'EABCD' AND step = 1").first()
    assert (got["removed"], got["kept"]) == (29, 50)


def test_matrix_is_the_texts(frame, odd_rows):
    shards = term_matrix(frame(odd_rows), "text", marks="|").collect()
    numbers, seen = {}, 0
    for s in shards:
        for i, text in enumerate(s["text"]):
            a, b = s["indptr"][i], s["indptr"][i + 1]
            own = sorted(Counter(split(text)).values())
            assert sorted(s["counts"][a:b]) == own and s["indices"][a:b] == sorted(s["indices"][a:b])
            for word, n in Counter(split(text)).items():
                if list(Counter(split(text)).values()).count(n) == 1:  # a count that names the word
                    number = s["indices"][a:b][s["counts"][a:b].index(n)]
                    assert numbers.setdefault(word, number) == number
            seen += 1
    assert seen == len(odd_rows) and len(set(numbers.values())) == len(numbers)
    counted = row_counts(term_matrix(frame(odd_rows))).collect()
    assert sorted((r["n_words"], r["n_distinct"]) for r in counted) == sorted((len(split(r[1])), len(set(split(r[1])))) for r in odd_rows)


def test_sketch_agrees_as_often_as_sets_overlap():
    rng = np.random.default_rng(1)
    for size, shared in ((3, 2), (60, 40), (3_000, 2_400)):
        share, filled = [], True
        for _ in range(12 if size < 1_000 else 3):
            tokens = rng.integers(0, 1 << 63, 2 * size - shared, dtype=np.uint64)
            both = np.concatenate((tokens[:size], tokens[size - shared :]))
            s = fast_sketch.sketches(both, np.array([0, size, 2 * size]), 512)
            filled &= bool((s != fast_sketch.EMPTY).all())
            share.append((s[0] == s[1]).mean())
        assert filled and abs(np.mean(share) - shared / (2 * size - shared)) < 0.05
    alone = fast_sketch.sketches(tokens[:7], np.array([0, 0, 7]), 64)
    assert (alone[0] == fast_sketch.EMPTY).all()


def test_sketches_do_not_depend_on_company():
    rng = np.random.default_rng(2)
    tokens, bounds = rng.integers(0, 1 << 63, 900, dtype=np.uint64), np.array([0, 1, 30, 30, 900])
    together = fast_sketch.band_keys(tokens, bounds)
    for i in range(4):
        assert (fast_sketch.band_keys(tokens[bounds[i] : bounds[i + 1]], np.array([0, bounds[i + 1] - bounds[i]]))[0] == together[i]).all() or i == 2


def plain_near(rows, size=4, part=80, whole=100):
    rows = [r for r in rows if r[0] is not None]
    sets = []
    for _, text in rows:
        w = [x.lower() for x in split(text)]
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    root = {d: d for d, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and whole * common >= part * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(rows[i][0]), find(rows[j][0])))
                root[b] = a
    return sorted((d, len(s), find(d)) for (d, _), s in zip(rows, sets, strict=True))


def changed(words, n, rng, vocabulary):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = rng.choice(vocabulary)
    return " ".join(words)


@pytest.mark.parametrize("cell", [256, 3])
def test_near_duplicates(frame, odd_rows, monkeypatch, cell):
    """Clusters whose members link in chains, at and under the threshold, also in tiny cells."""
    monkeypatch.setattr(fast_sketch, "CELL_SETS", cell)
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(5_000)]
    texts = []
    for k in range(4):
        words = [rng.choice(vocabulary) for _ in range(160)]
        for _ in range(12):
            texts.append(" ".join(words))
            words = changed(words, 3 + k, rng, vocabulary).split()
        texts += [changed(words, rng.randrange(1, 12), rng, vocabulary) for _ in range(8)]
    rows = odd_rows + rows_of(texts, 500)
    got = fast_sketch.near_duplicates(frame(rows)).collect()
    known = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None)
    assert known == plain_near([(r[0], r[1]) for r in rows])
    assert len(got) == len(rows) and all(r["component_id"] is None for r in got if r["doc_id"] is None)


def test_no_near_duplicates_in_an_empty_table(frame):
    assert fast_sketch.near_duplicates(frame([])).collect() == []


def test_heavy_class(frame):
    rows = rows_of(["one two three four five six"] * 60 + [f"other text number {i} of many" for i in range(40)])
    got = {r["doc_id"]: r["component_id"] for r in fast_sketch.near_duplicates(frame(rows)).collect()}
    assert all(got[i] == (0 if i < 60 else i) for i in range(100))


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain_search(rows, items, k):
    docs = [(d, Counter(terms(t))) for d, t in rows]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    n_docs, total = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for d, c, n in docs:
            m = 75 + (25 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, math.inf if d is None else d))
        out += [(item, rank, None if d == math.inf else d, -s) for rank, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("k, most", [(5, 8 << 20), (20, 4_000), (3, 1)])
def test_ranked_search(spark, frame, odd_rows, monkeypatch, k, most):
    """Whole index, many shards, a shard a document; items with repeats, ties, nulls and no terms."""
    monkeypatch.setattr(ranked_search, "SHARD_BYTES", most)
    rows = odd_rows + rows_of(["w1 w2 w3", "W1, w2; w3!", "w1 w1 w1 w2"] * 3 + ["日本 café CAFÉ 42", None, "..."], 800)
    items = [(1, "w1 w2 w2 nothing"), (2, "日本 é 42 w7"), (3, None), (4, "?!"), (5, "the of and w3 w3"), (5, "w9 w10"), (1, "w1 w2 w2 nothing"), (6, "absent")]
    queries = spark.createDataFrame([(*i, 1, "x") for i in items], "item_id long, text string, score long, doc_id string")
    got = ranked_search.ranked_search(frame(rows), queries, k).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_search([(r[0], r[1]) for r in rows], items, k)


def test_blocks_of_queries(spark, frame, odd_rows, monkeypatch):
    monkeypatch.setattr(ranked_search, "ITEM_BYTES", 8)
    items = [(i, f"w{i} w{i + 1}") for i in range(5)]
    got = ranked_search.ranked_search(frame(odd_rows), spark.createDataFrame(items, "item_id long, text string"), 4).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_search([(r[0], r[1]) for r in odd_rows], items, 4)


def test_search_of_empty_tables(spark, frame, odd_rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert ranked_search.ranked_search(frame(odd_rows), none).collect() == []
    assert ranked_search.ranked_search(frame([]), spark.createDataFrame([(1, "w1")], "item_id long, text string")).collect() == []


def test_treap_opens_to_its_points():
    """Every cell and every largest impact of a random grid."""
    rng = random.Random(3)
    texts = [" ".join(f"t{min(rng.randrange(1, 400), rng.randrange(1, 400))}" for _ in range(rng.randrange(0, 60))) for _ in range(150)]
    words = ranked_search._terms(pa.array(texts))
    shard = ranked_search.build_shard(np.arange(150) * 3, words, 140, 4_000)
    treap = ranked_search.Treap(shard | {"terms": shard["terms"].view(np.uint64)})
    found = defaultdict(dict)
    stack = [(i, i, 0, 0) for i in range(shard["levels"][0])]
    while stack:
        node, row, column, level = stack.pop()
        if level == treap.h:
            found[row][int(treap.docs[column])] = int(treap.best[node])
            continue
        at = int(treap.first[node])
        own = []
        for slot in range(16):
            if int(treap.kids[node]) >> slot & 1:
                own.append(int(treap.best[at]))
                stack.append((at, row * 4 + (slot >> 2), column * 4 + (slot & 3), level + 1))
                at += 1
        assert max(own) == treap.best[node]
    want = {}
    for d, text in enumerate(texts):
        n = len(text.split())
        m = 75 + (25 * n * 140) // 4_000
        for t, tf in Counter(text.split()).items():
            want[t, d * 3] = (1_000_000_000 * tf) // (1000 * tf + 12 * m)
    names = {int(words.hashes[i]): bytes(words.data[words.starts[i] : words.ends[i]]).decode() for i in range(len(words.hashes))}
    got = {(names[int(treap.terms[r])], d): v for r, own in found.items() for d, v in own.items()}
    assert got == want
