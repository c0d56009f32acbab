"""Fitted operators: exact parts beside plain versions, the rest by held-out accuracy."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import rows_of
from vitalgrid.llm import exchange, language_model, pieces, pii, quality_classifier, toxicity
from vitalgrid.llm.queries import model_path
from vitalgrid.llm.words import Words

SF = "/root/testdata/sf0.01"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def passes(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    return {"email": True, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def plain_spans(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m[0]))


def test_base_spans(frame, odd_rows):
    import random

    rng = random.Random(6)
    signs = list("ab1234567890..@@+-- ()\n_%é😀\x01\x02")
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(600)]
    texts += ["1" * 20000, "1-" * 20000, "a@b.c_x@y.z,a@b@c.d", "4111 1111 1111 1111 x +1 (743) 555-3824, 1.2.3.4.5 999.1.1.1 007.0.0.1", "q@w.e " * 600]
    rows = odd_rows + rows_of(texts, 1000)
    got = pii.find(frame(rows), pii.Selector()).select("doc_id", pii.listed(F.col("base")).alias("b"), pii.listed(F.col("spans")).alias("s")).collect()
    assert sorted((repr(r["doc_id"]), r["b"]) for r in got) == sorted((repr(r[0]), plain_spans(r[1])) for r in rows)
    assert all(r["b"] == r["s"] for r in got)


def test_boosted_spans_add_and_leave_base(spark, frame):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = pii.fit(docs, rounds=6)
    secret = 'words token = "0123456789abcdef0123456789abcdef01234567" words me@host.org more'
    got = pii.find(frame(rows_of([secret, "only plain words of prose", None])), model, "text")
    out = {r["doc_id"]: (r["spans"], r["masked"]) for r in got.select("doc_id", "spans", pii.redact(F.col("text"), F.col("spans")).alias("masked")).collect()}
    assert [s["kind"] for s in out[0][0]] == ["email", "secret"]
    assert out[0][1] == 'words token = "<secret>" words <email> more'
    assert out[1] == ([], "only plain words of prose") and out[2] == ([], None)
    assert pii.fit(frame([])) == pii.Selector()


def test_boosting_counts_every_distinct_candidate(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(pii, "stored", lambda df, name: kept.append(df) or df)
    # 21,000 numbers, each of them in two documents
    docs = spark.range(42_000).select(F.col("id").alias("doc_id"), F.format_string("room 555-%06d", F.col("id") % 21_000).alias("text"))
    assert pii.fit(docs, rounds=0) == pii.Selector()
    got = kept[0].groupBy("held").agg(F.sum("n").alias("n")).collect()
    assert sum(r["n"] for r in got) == 21_000 and len(got) == 2


def test_long_candidates_are_proposed_whole(frame):
    local, value = "é" * 300, "a" * 50 + "/" + "b" * 30 + "7"
    got = frame(rows_of([f"to {local}@host.org. {value} end", "x" * 300_000, "a+" * 100_000])).select(
        F.transform(pii.candidates(F.col("text")), lambda c: c["text"]).alias("c")).collect()
    assert [r["c"] for r in got] == [[f"{local}@host.org", value], [], []]


def test_candidates_add_what_base_spans_leave(frame):
    """A selector that takes every whole address: its letters round base spans are added, nothing else is."""
    every = pii.Selector((), 0.0, (0.0, None, None))
    texts = ["to jürgen.müller@host.org, x", "mailto:a@b.com", "a@b.com", "ü@ö.de x@y.zz", "née@a.b@c.d"]
    got = pii.find(frame(rows_of(texts)), every).select("doc_id", "base", "spans").collect()
    for r in got:
        text = texts[r["doc_id"]]
        covered = sorted((s["start"], s["end"]) for s in r["spans"])
        assert all(a[1] <= b[0] for a, b in zip(covered, covered[1:], strict=False)) and all(s in r["spans"] for s in r["base"])
        assert {text[a:b] for a, b in covered} >= {text[s["start"] : s["end"]] for s in r["base"]}
    kept = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in sorted(r["spans"], key=lambda s: s["start"])] for r in got}
    assert kept[0] == ["jürgen.mü", "ller@host.org"] and kept[1] == ["a@b.com"] == kept[2] and kept[3] == ["ü@ö.de", "x@y.zz"]


def test_numbers_and_addresses_are_learned_from_words_before_them(frame):
    rows = [f"please call ({200 + i}) 555-{1000 + i} now, mail jür{i}gen@höst{i}.org and year {1000000 + 7 * i} of it" for i in range(400)]
    model = pii.fit(frame(rows_of(rows)))
    got = pii.find(frame(rows_of(["the phone (999) 555-4321 rang", "see ñandú@año.es there", "in 1234567 units", None, ""])), model).select("doc_id", "spans").collect()
    spans = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in got}
    assert spans == {0: [("number", 10, 24)], 1: [("email", 4, 16)], 2: [], 3: [], 4: []}


def test_thresholds_hold_their_precision(spark, frame):
    """Beside a plain count over the same held-out candidates, for each generator."""
    model = pii.Selector((pii.Tree((pii.FEATURES.index("digits"), 3), ((0, 1), (0, 1)), (-1.0, -0.5, 1.0, 2.0)),), 0.0)
    cells = [([k, *([0] * (len(pii.FEATURES) - 1))], float((i * 7 + k) % 10 < d + 4)) for k in range(3) for d in range(8) for i in range(20)
             for _ in range(1)]
    for j, (bins, _) in enumerate(cells):
        bins[pii.FEATURES.index("digits")] = j // 20 % 8
    got = pii._thresholds(spark.createDataFrame(cells, "bins array<int>, y double"), model)
    value = lambda b: (2.0 if b[0] > 1 else 1.0) if b[2] > 3 else (-0.5 if b[0] > 1 else -1.0)
    for k, least in enumerate(got):
        rows = [(value(b), y) for b, y in cells if b[0] == k]
        marks = [m for m in {v for v, _ in rows} if m >= 0 and sum(y for v, y in rows if v >= m) >= pii.PRECISION * sum(v >= m for v, _ in rows)]
        assert least == (min(marks) if marks else None)


def test_language_model(frame, odd_rows):
    import zlib

    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 0
    got = language_model.score_texts(frame(odd_rows), train).collect()
    assert len(got) == len(odd_rows)
    texts = [(r[0], [w.lower() for w in (r[1] or "").encode().split()] + [None]) for r in odd_rows]
    count = Counter(w for d, t in texts if d is not None and zlib.crc32(str(d).encode()) % 3 for w in t)
    n, v = sum(count.values()), len(count)
    plain = sorted((repr(d), len(t), sum(count[w] > 0 for w in t), round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for d, t in texts)
    assert sorted((repr(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == plain
    assert {r["train_tokens"] for r in got} == {n}
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert language_model.score_texts(frame([]), train).collect() == []
    nothing = language_model.score_texts(frame(odd_rows), F.lit(False)).collect()
    assert all(r["base_score"] == 0 and r["n_known"] == 0 for r in nothing)


def test_gradient_rounds_meet_all_training_text(frame, odd_rows, monkeypatch):
    sums, summed = [], language_model._summed
    monkeypatch.setattr(language_model, "_summed", lambda parts: sums.append(summed(parts)) or sums[-1])
    got = language_model.score_texts(frame(odd_rows), F.col("doc_id") != 13).collect()
    assert sum(s[-1] for s in sums[1:] if len(s)) == got[0]["train_tokens"]  # the first sum is of the counts


def test_words_are_learned_in_rounds_over_all_text(frame, odd_rows, monkeypatch):
    """Beside plain loops over every context, whatever the numbers of chunks and cells."""
    models, learn = [], language_model.learn
    monkeypatch.setattr(language_model, "learn", lambda *a: models.append(learn(*a)) or models[-1])
    train = F.col("doc_id") != 13
    got = [language_model.score_texts(frame(odd_rows), train, sizes).collect() for sizes in (exchange.Sizes(3, 1), exchange.Sizes(8, 5))]
    model, texts, contexts = models[0], [], {}
    kinds = {None: 0}
    for r in odd_rows:
        words = [w.lower() for w in (r[1] or "").encode().split()]
        for w in set(words) - set(kinds):
            one = Words(pa.array([w.decode()]), lower=True)
            kinds[w] = int(model.classes.of(one, language_model._endings(one))[0])
        before = [("", language_model.CLASSES)] * 2 + [(w, kinds[w]) for w in words]
        texts.append((r[0], words, [*zip(before[1:], before[:-1], [*words, None], strict=True)]))
        for one, two, w in texts[-1][2]:
            contexts.setdefault((one, two), Counter())[kinds[w]] += r[0] not in (13, None)
    count = {}
    for both, n in contexts.items():
        for key in enumerate(both):
            count.setdefault(key, Counter()).update(n)
    start = lambda g, k, c, n: language_model.SCALE[g] * math.log1p(
        language_model._count(language_model._byte(np.array([n])))[0] / (5 * model.shares[language_model.PAIRS + g * (language_model.CLASSES + 1) + k, c]))
    weights = {(g, (w, k)): {c: start(g, k, c, n) for c, n in cs.items() if n} for (g, (w, k)), cs in count.items()}

    def shares(one, two):
        z = np.log(model.shares[one[1] * (language_model.CLASSES + 1) + two[1]])
        for key in enumerate((one, two)):
            for c, x in weights[key].items():
                z[c] += x
        p = np.exp(z) / np.exp(z).sum() * language_model.PAIR_PRIOR
        for c, n in contexts[one, two].items():
            p[c] += n
        return p / p.sum()

    def scores():
        own = lambda w: math.log10((sum(n for (g, (v, _)), cs in count.items() if g == 0 and v == w for n in cs.values()) if w else model.texts) + 0.1)
        each, inside = {both: np.log10(shares(*both)) for both in contexts}, {w: own(w) for w in kinds}
        return sorted((repr(d), len(t), sum(each[one, two][kinds[w]] + inside[w] - model.classes.mass[kinds[w]] for one, two, w in t)) for d, _, t in texts)

    def apart(rows, plain):
        rows = sorted((repr(r["doc_id"]), r["n_tokens"], r["score"]) for r in rows)
        assert [r[:2] for r in rows] == [r[:2] for r in plain]
        return max(abs(a[2] - b[2]) / a[1] for a, b in zip(rows, plain, strict=True))

    at_start = scores()
    for _ in range(language_model.ROUNDS):
        expect = {key: np.zeros(language_model.CLASSES) for key in weights}
        for both, n in contexts.items():
            p = shares(*both) * sum(n.values())
            for key in enumerate(both):
                expect[key] += p
        for key, row in weights.items():
            for c in row:
                row[c] += language_model.STEP * math.log((count[key][c] + language_model.DAMP) / (expect[key][c] + language_model.DAMP))
    plain = scores()
    assert max(apart(rows, plain) for rows in got) < 0.005 < 0.02 < min(apart(rows, at_start) for rows in got)


def test_every_pair_of_words_keeps_its_own_counts(spark):
    """What follows depends on both words before and on neither alone; there are far more pairs than any fixed table holds."""
    word = lambda n, of: F.concat(F.lit(of), F.pmod(n, F.lit(200)).cast("string"))
    pairs = spark.range(20_000).withColumn("yes", F.xxhash64("id") % 2 == 0)
    text = lambda yes: F.concat_ws(" ", word(F.col("id"), "a"), word(F.floor(F.col("id") / 200), "b"), F.when(yes, "yes").otherwise("no")).alias("text")
    docs = [pairs.select((F.col("id") + 20_000 * k).alias("doc_id"), text(F.col("yes") if k < 3 else ~F.col("yes"))) for k in range(4)]
    out = language_model.score_texts(docs[0].union(docs[1]).union(docs[2]).union(docs[3]), F.col("doc_id") < 40_000).where("doc_id >= 40000")
    apart = out.groupBy((F.col("doc_id") % 20_000).alias("id")).agg(F.max_by("doc_id", "score").alias("best"))
    assert apart.where("best < 60000").count() > 19_000


def test_followers_are_counted_over_all_chunks():
    texts = [["a b a b c", "c a b", None], ["a b d", "", "e f a b a"]]
    train = [np.array([True, False, True]), np.array([True, True, True])]
    want, met = Counter(), []
    for chunk, own in zip(texts, train, strict=True):
        words = Words(pa.array(chunk, pa.string()), lower=True)
        met.append(language_model._examples(words, words.hashes.astype(np.int64) % 20 + 1))
        for keys in met[-1].keys:
            want.update(zip(keys[own[met[-1].text]].tolist(), met[-1].kind[own[met[-1].text]].tolist(), strict=True))
    sent = pa.concat_tables([
        language_model._sent(i, np.unique(np.array([7, 1 << 63], np.uint64)), *language_model._features(e, own), 3) for i, (e, own) in enumerate(zip(met, train, strict=True))])
    got = {}
    for bucket in range(8):
        rows = sent.filter(pc.equal(sent["bucket"], bucket))
        for chunk, *answer in zip(rows["chunk"].to_pylist(), rows["keys"].to_pylist(), *language_model._totals(rows), strict=True):
            got.setdefault(chunk, []).append(answer)
    for i, e in enumerate(met):
        answers = pa.table(dict(zip(("features", "followers", "packed"), map(list, zip(*got[i], strict=True)), strict=True)))
        followers, kind, n = language_model._answered(answers)
        keys = np.unique(np.concatenate(e.keys))
        assert dict(zip(zip(np.repeat(keys, followers).tolist(), kind.tolist(), strict=True), n.tolist(), strict=True)) == {
            k: c for k, c in want.items() if k[0] in set(keys.tolist())}


def test_language_model_beats_single_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    out = language_model.score_texts(docs, ~held).where(held).agg(F.sum("base_score").alias("b"), F.sum("score").alias("s")).first()
    assert out["s"] > out["b"]


def area(pairs):
    ones, zeros = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))


def held_out(spark, label, n, r):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % n
    return docs, labels.where(rest != r), labels.where(rest == r).select("doc_id", F.col(label).alias("y"))


def plain_votes(model, counts):
    """Every neighbour of every text in a loop, the nearest first, the earlier of equals first."""
    out = []
    for point in model.project(counts):
        if not np.abs(point).sum() or not len(model.labels):
            out.append(model.prior)
            continue
        near = sorted(range(len(model.labels)), key=lambda i: (-float(point @ model.vectors[i]), i))[: quality_classifier.NEIGHBOURS]
        weights = [max(float(point @ model.vectors[i]), 0.0) ** 4 for i in near]
        votes = sum(w * model.labels[i] for w, i in zip(weights, near))
        out.append((votes + 0.5 * model.prior) / (sum(weights) + 0.5) if sum(weights) else model.prior)
    return np.clip(out, 0.0, 1.0)


@pytest.mark.parametrize("n_labels", [0, 1, 2, 9, 15, 16, 700])
def test_vote_beside_a_plain_loop(n_labels):
    rng = np.random.default_rng(n_labels)
    counts = rng.poisson(0.3, (n_labels, quality_classifier.DIMS)).astype(np.float32)
    labels = rng.integers(0, 2, n_labels).astype(np.float32)
    counts[: n_labels // 3], labels[: n_labels // 3] = counts[:1], labels[:1]  # copies, alike in label: ties at the last place are equal votes
    model = quality_classifier.fit(counts, labels)
    asked = np.concatenate([counts[:40], rng.poisson(0.3, (60, quality_classifier.DIMS)).astype(np.float32), np.zeros((3, quality_classifier.DIMS), np.float32)])
    assert np.allclose(model.vote(asked), plain_votes(model, asked), atol=1e-5)
    assert (model.vote(asked)[-3:] == model.prior).all()


def test_a_hot_id_is_learned_once(spark, frame):
    rows = [(1, f"copy number {i % 3}", *rows_of(["x"])[0][2:]) for i in range(300)] + rows_of(["good prose here", None, "bad prose"], 2)
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, 0), (4, 0), (9, 1), (None, 1)], "doc_id long, quality int")
    model = quality_classifier.learn(frame(rows), labels)
    assert sorted(model.labels) == [0.0, 0.0, 1.0, 1.0] and len(model.vectors) == 4


def test_neighbour_quality(spark, frame, odd_rows):
    docs, train, test = held_out(spark, "quality", 5, 0)
    model = quality_classifier.learn(docs, train)
    got = quality_classifier.score(docs, model).join(test, "doc_id").collect()
    assert area([(r["score"], r["y"]) for r in got]) > 0.95
    own = quality_classifier.score(frame(odd_rows), model, "lang").collect()
    assert len(own) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in own)
    assert len({r["score"] for r in own if r["doc_id"] in (0, 1, 2)}) == 1
    assert quality_classifier.score(frame([]), model).collect() == []
    unlabelled = quality_classifier.learn(frame(odd_rows), train.limit(0))
    assert {r["score"] for r in quality_classifier.score(frame(odd_rows), unlabelled).collect()} == {0.5}


def test_toxic_lexicon(spark, frame, odd_rows):
    docs, train, test = held_out(spark, "toxic", 4, 2)
    lexicon = toxicity.learn(toxicity.sample(docs, train, "toxic"))
    got = toxicity.score(docs, lexicon).join(test, "doc_id").collect()
    assert area([(r["score"], r["y"]) for r in got]) > 0.75
    own = toxicity.score(frame(odd_rows), lexicon).collect()
    assert len(own) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in own)
    assert toxicity.learn(toxicity.sample(docs, train.limit(0), "toxic")).weights == {}
    assert toxicity.score(frame([]), lexicon).collect() == []


def test_toxic_words_late_in_long_texts_are_learned(spark, frame):
    rows = rows_of([f"pad{i} " + "some plain words " * 800 + ("zzfoul end" if i % 2 else "good end") for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    lexicon = toxicity.learn(toxicity.sample(frame(rows), labels, "toxic"))
    assert any(" zzfoul ".startswith(e) and w > 0 for e, w in lexicon.weights.items())
    got = toxicity.score(frame(rows), lexicon).collect()
    assert min(r["score"] for r in got if r["doc_id"] % 2) > 0.5 > max(r["score"] for r in got if not r["doc_id"] % 2)


def test_folding_and_exceptions():
    assert toxicity.fold("An IDI0T, stуpid! 1d10t ＬＯＳＥＲ") == " an idiot stypid idiot loser "
    lexicon = toxicity.Lexicon({" idio": 5.0, " idiosyncrasy ": 0.0})
    automaton = lexicon.automaton()
    assert toxicity.rate(automaton, toxicity.fold("an idiot"))[1] == 1
    assert toxicity.rate(automaton, toxicity.fold("an idiosyncrasy"))[1] == 0
    long_ = toxicity.rate(automaton, toxicity.fold("an idiot " + "and more words " * 200))[0]
    assert 0 < long_ < toxicity.rate(automaton, toxicity.fold("an idiot"))[0]


def test_pieces(spark, frame, odd_rows):
    import random

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path())
    rng = random.Random(2)
    signs = ["a", " ", "  ", "\n", "▁", "é", "😀", "\u0000", "the", "\t", "日", "龘"]
    rows = odd_rows + rows_of(["".join(rng.choice(signs) for _ in range(rng.randrange(12))) for _ in range(300)], 1000)
    got = pieces.decode(pieces.encode(frame(rows), model_path(), keep_text=True), model_path()).collect()
    assert len(got) == len(rows)
    for r in got:
        text = r["text"] or ""
        assert r["ids"] == model.encode(text) and r["decoded"] == model.decode(r["ids"])
        assert r["ends"] == [p.end for p in model.encode(text, return_type="proto").pieces]
    once = pieces.encode(frame(rows), model_path(), keep_text=True, decoded=True)
    assert sorted(map(repr, once.collect())) == sorted(map(repr, got))
    assert pieces.encode(frame([]), model_path(), decoded=True).collect() == []


@pytest.mark.parametrize("squeezed", [True, False])
@pytest.mark.parametrize("prefix", [True, False])
@pytest.mark.parametrize("suffix", [True, False])
def test_spans_of_a_model_with_a_full_map(tmp_path, squeezed, prefix, suffix):
    """The public model with another normaliser and a symbol of the user's: nothing is trained."""
    import random

    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto.FromString(open(model_path(), "rb").read())
    full = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    proto.normalizer_spec.precompiled_charsmap = pb.ModelProto.FromString(full.serialized_model_proto()).normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.remove_extra_whitespaces = prefix, squeezed
    proto.trainer_spec.treat_whitespace_as_suffix = suffix
    if squeezed == suffix:
        proto.pieces.add(piece="①①", score=0, type=proto.pieces[0].USER_DEFINED)
    path = str(tmp_path / "full.model")
    with open(path, "wb") as f:
        f.write(proto.SerializeToString())
    encoder = pieces.Encoder(path)
    rng = random.Random(3)
    signs = ["ab", " ", "  ", "\n", "▁", "é", "😀", "the", "\t", "日", "龘", "ﬁ", "①", "㌔", "ｶﾞ", "\u200b", "\u3000", "e\u0301", "\u0007"]
    for text in ["", " ", " \t ", *("".join(rng.choice(signs) for _ in range(rng.randrange(14))) for _ in range(1500))]:
        want = encoder.model.encode(text, return_type="proto").pieces
        assert encoder.ends(text, [p.id for p in want]).tolist() == [p.end for p in want], repr(text)


def test_character_map_takes_the_longest_prefix():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    normaliser = sentencepiece.SentencePieceNormalizer(
        rule_name="nmt_nfkc", add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False)
    blob = pb.ModelProto.FromString(normaliser.serialized_model_proto()).normalizer_spec.precompiled_charsmap
    table = pieces.CharacterMap(blob)
    for text in ("ＡＢＣ①ﬁ", "é ｶﾞ ㌔", "plain", ""):
        out, source = table.normalise(text.encode())
        assert out.decode() == normaliser.normalize(text)
        assert len(source) == len(out) + 1 and source == sorted(source) and source[-1] == len(text.encode())


@pytest.mark.parametrize("values", [[], [5], list(range(700))])
def test_prefix_sums(spark, values):
    got = spark.createDataFrame([(values,)], "v array<long>").select(pii.prefix_sums(F.col("v")).alias("s")).first()["s"]
    assert got == [sum(values[:i]) for i in range(len(values))]
