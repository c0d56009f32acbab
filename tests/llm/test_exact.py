"""Operators whose results are exact, beside plain versions."""

import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import rows_of
from vitalgrid.llm import decontaminate
from vitalgrid.llm.decontaminate import phrase_matches, proximity_matches
from vitalgrid.llm.ngram_join import Measure, jaccard_components, jaccard_links
from vitalgrid.llm.quality_rules import STOP_WORDS, quality_rules
from vitalgrid.llm.sharding import histogram_shards
from vitalgrid.llm.substring_dedup import COVER, PERIOD, repeated_passages
from vitalgrid.session import stored


def split(text):
    return (text or "").encode().split()


def plain_dedup(rows, size=13):
    least = {}
    for doc, text in rows:
        w = split(text)
        for p in range(len(w) - size + 1):
            g = tuple(w[p : p + size])
            least[g] = min(least.get(g, float("inf")), float("inf") if doc is None else doc)
    out = []
    for doc, text in rows:
        w = split(text)
        gone = set()
        for p in range(len(w) - size + 1):
            if least[tuple(w[p : p + size])] < (float("inf") if doc is None else doc):
                gone.update(range(p, p + size))
        out.append((doc, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=repr)


def test_cover_meets_every_shift():
    for i in range(PERIOD):
        for j in range(PERIOD):
            assert any((i + d) % PERIOD in COVER and (j + d) % PERIOD in COVER for d in range(PERIOD))


def test_repeated_passages(frame, odd_rows):
    got = repeated_passages(frame(odd_rows)).collect()
    assert sorted(((r[0], r[1], r[2], r[4]) for r in got), key=repr) == plain_dedup([(r[0], r[1]) for r in odd_rows])
    assert all(sum(s["end"] - s["first"] for s in r["removed"]) == r["n_removed"] for r in got)
    assert repeated_passages(frame([])).collect() == []
    with pytest.raises(ValueError):
        repeated_passages(frame([]), size=5)


def plain_components(rows, part=75, whole=100):
    rows = [r for r in rows if r[0] is not None]
    sets = []
    for _, text in rows:
        w = split(text)
        w = [x.lower() for x in w]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and whole * len(a & b) >= part * len(a | b):
                x, y = find(rows[i][0]), find(rows[j][0])
                root[max(x, y)] = min(x, y)
    return sorted((d, len(s), find(d)) for (d, _), s in zip(rows, sets, strict=True))


def test_jaccard_components(frame, odd_rows):
    got = [tuple(r) for r in jaccard_components(frame(odd_rows)).collect()]
    assert sorted(r for r in got if r[0] is not None) == plain_components([(r[0], r[1]) for r in odd_rows])
    assert sorted(r[1] for r in got if r[0] is None) == [0, 116]
    assert all(r[2] is None for r in got if r[0] is None)
    assert jaccard_components(frame([])).collect() == []


def test_large_group_of_near_copies_keeps_every_link(frame, monkeypatch):
    import random

    from vitalgrid.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "PIVOTS", 2)
    rng = random.Random(9)
    base = [f"t{i}" for i in range(60)]
    texts = []
    for _ in range(90):
        w = list(base)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(60)] = f"c{rng.randrange(1000)}"
        texts.append(" ".join(w))
    rows = rows_of(texts)
    got = sorted(tuple(r) for r in jaccard_components(frame(rows)).collect())
    assert got == plain_components([(r[0], r[1]) for r in rows])


def test_links_are_counted_within_and_across_blocks(frame, odd_rows, monkeypatch):
    import random

    from vitalgrid.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = random.Random(9)
    base = [f"t{i}" for i in range(120)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randrange(1, 3)):
            w[rng.randrange(120)] = f"c{rng.randrange(1000)}"
        texts.append(" ".join(w))
    rows = odd_rows + rows_of([*texts, *texts[:5], texts[0]], 1000)
    sets = []
    for r in rows:
        w = [x.lower() for x in split(r[1])]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    links = lambda i: sum(
        j != i and rows[j][0] is not None and len(sets[i]) > 0 and 100 * len(sets[i] & s) >= 75 * len(sets[i] | s) for j, s in enumerate(sets))
    got = jaccard_links(frame(rows)).collect()
    known = [(r[0], r[1]) for r in rows if r[0] is not None]
    assert sorted(tuple(r)[:3] for r in got if r[0] is not None) == plain_components(known)
    assert sorted((r["doc_id"], r["n_links"]) for r in got if r[0] is not None) == sorted((r[0], links(i)) for i, r in enumerate(rows) if r[0] is not None)
    assert all(r["n_links"] is None for r in got if r[0] is None)
    assert max(r["n_links"] or 0 for r in got) > 8


def test_prefix_lengths_hold_the_filter():
    m = Measure(75, 100)
    for n in range(1, 200):
        for other in range(n, 200):
            least = -(-75 * (n + other) // 175)  # smallest overlap that links
            if least > n:
                continue
            for size in (n, other):
                assert m.overlap(size) <= least
                assert least - (size - m.first_prefix(size)) >= min(m.first_needed(n), m.first_needed(other))


def plain_rules(text):
    text = text or ""
    w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", text) if x]
    lines = [x for x in text.split("\n") if re.search(r"[^ \t\n\x0b\f\r]", x)]
    seen = defaultdict(list)
    for i in range(len(w) - 4):
        seen[tuple(w[i : i + 5])].append(i)
    cover = {p + k for at in seen.values() if len(at) > 1 for p in at for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)


def plain_kept(text):
    """The rules written out once more, with their numbers."""
    text = text or ""
    n, chars, symbols, dups, repeats = plain_rules(text)
    w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", text) if x]
    lines = [x for x in text.split("\n") if re.search(r"[^ \t\n\x0b\f\r]", x)]
    if n < 10 or 100 * repeats > 20 * n or n > 100_000:
        return False
    stops = sum(x in STOP_WORDS for x in w)
    trailing = sum(x.rstrip(" \t\n\x0b\f\r").endswith(("...", "…")) for x in lines)
    bullets = sum(re.match("[ \t\x0b\f\r]*[•‣●▪◦*-][ \t\x0b\f\r]", x) is not None for x in lines)
    letters = sum(any(c.isalpha() for c in x) for x in w)
    return (
        1.5 * n <= chars <= 20 * n and 10 * symbols <= n and 2 * dups <= len(lines) and 10 * trailing <= 3 * len(lines)
        and 10 * bullets <= 9 * len(lines) and 10 * letters >= 8 * n and (n < 60 or (stops >= 2 and 100 * stops >= n)))


def test_quality_rules(frame, odd_rows):
    plain = "one two three four five six seven eight nine ten of the"
    forms = ["symbols ### *** $$$ here and there | < > of the text now", "ab\x0bcd\x0cef", plain, f"{plain}...\r", f"{plain} …\n" + "x y z\n" * 2 + "q",
             "".join(f"- {w} {w}a\n" for w in plain.split()), plain.replace(" ", "\n• "), "* a\n" + plain, "12 34 56 " + plain + " 7", "1 2 3 4 " + plain,
             " ".join(f"v{i}" for i in range(60)), "the " + " ".join(f"v{i}" for i in range(70)), "the of " + " ".join(f"v{i}" for i in range(70)),
             " ".join(f"v{i}" for i in range(59)), "the of " + " ".join(f"v{i}" for i in range(300)), " ".join(f"w{i}" for i in range(99_000)) + " the" * 1001,
             " ".join(f"w{i} the" for i in range(50_001)), " ".join(f"w{i} the" for i in range(50_000))]
    rows = odd_rows + rows_of(forms, 500)
    got = quality_rules(frame(rows)).collect()
    assert sorted((repr(r["doc_id"]), *r[1:6]) for r in got) == sorted((repr(r[0]), *plain_rules(r[1])) for r in rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
    assert sorted((repr(r["doc_id"]), r["kept"]) for r in got) == sorted((repr(r[0]), plain_kept(r[1])) for r in rows)
    assert len({r["kept"] for r in got}) == 2
    assert quality_rules(frame([])).collect() == []


def test_histogram_shards(frame, odd_rows):
    import zlib

    for rows, shards in ((odd_rows, 4), (rows_of(["same text"] * 300), 7), (rows_of([f"text {i} " * (i % 9) for i in range(500)]), 16), ([], 3)):
        got = histogram_shards(frame(rows), shards).collect()
        plain = [(r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows]
        assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == sorted(plain, key=repr)
        by_shard = defaultdict(list)
        for r in got:
            assert 0 <= r["shard"] < shards
            by_shard[r["shard"]].append(r)
        for some in by_shard.values():
            assert sorted(r["slot"] for r in some) == list(range(len(some)))
        if rows:
            total, largest = sum(p[1] for p in plain), max(p[1] for p in plain)
            twins = max(sum(p[1] for p in plain if p == q) for q in plain)  # rows alike in id and text stay together
            for s in range(shards):
                assert abs(sum(r["size"] for r in by_shard[s]) - total / shards) <= 2 * max(largest, twins)


def test_shards_hold_their_texts(frame, odd_rows):
    got = histogram_shards(frame(odd_rows), 4, keep=("text", "chunk", "lang")).collect()
    assert sorted(((r["doc_id"], r["text"], r["chunk"], r["lang"]) for r in got), key=repr) == sorted(((r[0], r[1], r[5], r[2]) for r in odd_rows), key=repr)
    assert all(r["size"] == len((r["text"] or "").encode()) + 1 for r in got)
    assert "text" in histogram_shards(frame([])).columns and "text" not in histogram_shards(frame([]), keep=()).columns


WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")


def words6(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_phrases(docs, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        w = words6(text)
        for p in range(max(len(w) - size, 0) + 1 if w else 0):
            windows[tuple(w[p : p + size])].add(str(item))
    out = []
    for doc, text in docs:
        w = words6(text)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit.update(range(p, p + n))
                    found |= windows[tuple(w[p : p + n])]
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def test_phrase_matches(spark, frame, odd_rows):
    passage = odd_rows[6][1]
    items = [(1, passage), (2, "two, WORDS!"), (3, None), (4, ""), (5, " ".join(passage.split()[5:20])), (10, "never seen here"), (5, passage)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = phrase_matches(frame(odd_rows), bench).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in got), key=repr) == plain_phrases(
        [(r[0], r[1]) for r in odd_rows], items)
    assert {r["n_hit"] for r in phrase_matches(frame(odd_rows), bench.limit(0)).collect()} == {0}
    assert phrase_matches(frame([]), bench).collect() == []


def test_postings_are_dealt_before_they_are_moved(spark, frame, monkeypatch):
    """A task moves a bounded number of postings, also where a row is repeated many times, and its moved places are not shuffled again."""
    monkeypatch.setattr(decontaminate, "TASK_POSTINGS", 50)
    text = " ".join(f"w{i % 40}" for i in range(60))
    docs = frame(rows_of([text, "pad " + text]) + rows_of(["again " + text], start=9) * 30)
    windows = decontaminate.benchmark_windows(spark.createDataFrame([(1, text)], "item_id long, text string"))
    counts = decontaminate.term_counts(docs, windows.select(F.explode("words").alias("term")))
    places = stored(decontaminate.rarest_terms(windows, counts), "places")
    index = decontaminate.build_index(docs, places)
    met = decontaminate.intersect(index, places)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(row#\d+L, (\d+)\)", plan)[1] == str(index.count() // 50 + 1)
    assert len(re.findall(r"hashpartitioning\(.*start", plan)) == 1  # of the windows found, for copies of a row
    starts = sorted((r["doc"], r["start"]) for r in met.join(windows, "win").collect())
    assert len(starts) == len(set(starts)) >= 3 * 51 and len({d for d, _ in starts}) == 3


def test_proximity_matches(spark, frame):
    docs = frame(rows_of(["zulu yankee other words xray", "zulu " + "pad " * 50 + "yankee", "nothing", None]))
    bench = spark.createDataFrame([(1, "Xray yankee zulu")], "item_id long, text string")
    got = proximity_matches(docs, bench, span=6, share=0.9).collect()
    assert [tuple(r) for r in got] == [(0, "1", 0, 3)]


def plain_proximity(docs, items, span, share):
    sets = {}
    for item, text in items:
        if item is not None and words6(text):
            sets.setdefault(str(item), set()).update(words6(text))
    out = set()
    for doc, text in docs:
        w = words6(text)
        for item, terms in sets.items():
            needed = max(1, math.ceil(share * len(terms)))
            for p in range(len(w)):
                n = len(terms & set(w[p : p + span]))
                if w[p] in terms and n >= needed:
                    out.add((doc, item, p, n))
    return sorted(out, key=repr)


@pytest.mark.parametrize("span, share", [(20, 0.6), (6, 0.5), (1, 1.0), (12, 0.75)])
def test_proximity_matches_beside_a_plain_version(spark, frame, odd_rows, span, share):
    passage = odd_rows[6][1].split()
    items = [(1, " ".join(reversed(passage[:12]))), (2, "two, WORDS!"), (3, None), (4, ""), (5, "w1 w2 w3 never seen"), (6, "w7 w8 w7"),
             (6, "w9"), (None, "two words"), (7, " ".join(passage))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = proximity_matches(frame(odd_rows), bench, span, share)
    assert sorted({tuple(r) for r in got.collect()}, key=repr) == plain_proximity([(r[0], r[1]) for r in odd_rows], items, span, share)
    assert proximity_matches(frame([]), bench, span, share).collect() == []
    assert proximity_matches(frame(odd_rows), bench.limit(0), span, share).collect() == []


def test_rows_that_share_an_id_are_told_apart(spark, frame):
    """Rows without an id, and rows of one id, are judged by their own texts and never gathered under it."""
    rows = [(i, t, *rows_of([t])[0][2:]) for i in (None, 5) for t in ("alpha beta gamma", "delta beta", None, "alpha beta gamma")]
    bench = spark.createDataFrame([(1, "alpha beta"), (2, "delta")], "item_id long, text string")
    got = sorted(((r["doc_id"], r["n_hit"], list(r["items"])) for r in phrase_matches(frame(rows), bench).collect()), key=repr)
    want = [(i, n, items) for i in (None, 5) for n, items in ((2, ["1"]), (1, ["2"]), (0, []), (2, ["1"]))]
    assert got == sorted(want, key=repr)
