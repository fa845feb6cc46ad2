"""Each operator against a plain version of itself."""

import base64
import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from lexiloom.llm.components import components
from lexiloom.llm.learning import fit_logistic
from lexiloom.storage import materialize
from lexiloom.llm import byte_bpe, decontaminate, jaccard_join, language_id, piece_counts, pu_quality, queries, toxicity

P = pytest.importorskip("public_tokenizers")
RANKS = byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))


def rows_of(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(spark, sf_dir, encoding):
    texts = {r.doc_id: r.text for r in rows_of(spark, sf_dir, "documents")}
    found = queries.op3_byte_bpe(spark, sf_dir).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = encoding.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_bpe_small_pieces_and_round_trip(spark):
    rows = [(i, "".join(random.Random(i).choices("ab é\n 漢🙂", k=i))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    both = byte_bpe.decode(byte_bpe.encode(docs.cache(), RANKS, P.PATTERN, piece_tokens=5), RANKS)
    assert {r.doc_id: bytes(r.decoded).decode() for r in both.collect()} == dict(rows)


def test_bpe_in_batches_of_any_size(spark, encoding):
    """Long texts and wide columns, cut into batches by bytes and by rows."""
    draw = random.Random(6)
    words = ["".join(draw.choices("abcdefgh", k=draw.randint(2, 9))) for _ in range(500)]
    rows = [(i, " ".join(draw.choices(words, k=1500)), "w" * draw.randint(0, 600), None) for i in range(400)]
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string, wide string, ids string").coalesce(2), "wide")
    want = {i: encoding.encode_ordinary(t) for i, t, _, _ in rows}
    for conf, value in [("maxBytesPerBatch", "100k"), ("maxBytesPerBatch", "1m"), ("maxRecordsPerBatch", "7")]:
        name = f"spark.sql.execution.arrow.{conf}"
        old = spark.conf.get(name)
        spark.conf.set(name, value)
        try:
            for tokens in (byte_bpe.PIECE_TOKENS, 40_000):
                found = byte_bpe.encode(docs, RANKS, P.PATTERN, piece_tokens=tokens).collect()
                assert {r.doc_id: r.ids for r in found} == want and all(len(r.wide) <= 600 for r in found)
        finally:
            spark.conf.set(name, old)


def test_splitter_equals_the_pattern(encoding):
    draw = random.Random(1)
    alphabet = ["a", "B", "é", " ", "  ", "\n", "\t", "'s", "'ll", "'", "1", "²", "½", "Ⅷ", "_", "-", "!", "　", "\x1c", "\x85", "\xa0", "漢", "🙂", "𝒳", "𝟘", "́"]
    split = byte_bpe.splitter(P.PATTERN)
    for _ in range(3000):
        text = "".join(draw.choices(alphabet, k=draw.randint(0, 12)))
        words = split(text)
        assert "".join(words) == text
        assert [i for w in words for i in encoding.encode_ordinary(w)] == encoding.encode_ordinary(text)


def test_piece_counts_equal_greedy_matching():
    draw = random.Random(2)
    for trial in range(300):
        pieces = {bytes(draw.choices(b"abc", k=draw.randint(1, 4))) for _ in range(draw.randint(1, 12))}
        inner = {bytes(draw.choices(b"abc", k=draw.randint(1, 4))) for _ in range(draw.randint(1, 12))} if trial % 2 else None
        counter = piece_counts.PieceCounter(sorted(pieces), None if inner is None else sorted(inner))
        for _ in range(30):
            word = bytes(draw.choices(b"abc", k=draw.randint(0, 10)))
            at, n = 0, 0
            while at < len(word):
                use = pieces if at == 0 or inner is None else inner
                size = max((len(p) for p in use if word.startswith(p, at)), default=0)
                if not size:
                    n = -1
                    break
                at, n = at + size, n + 1
            assert counter.count(word) == n, (pieces, inner, word)


def test_piece_counts_query(spark, sf_dir):
    vocabulary = byte_bpe.parse_ranks(RANKS)
    texts = {r.doc_id: r.text for r in rows_of(spark, sf_dir, "documents")}
    known = {}

    def greedy(word):
        if word not in known:
            at = n = 0
            while at < len(word):
                at += next(k for k in range(min(len(word) - at, 64), 0, -1) if word[at : at + k] in vocabulary)
                n += 1
            known[word] = n
        return known[word]

    for r in queries.op4_piece_counts(spark, sf_dir).collect():
        words = texts[r.doc_id].encode().split()
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(words), sum(greedy(b" " + w) for w in words), 0)


def brute_hits(texts, items, window):
    out = []
    for text in texts:
        words, hit, names = decontaminate.words_of(text), set(), set()
        for name, item in items:
            own = decontaminate.words_of(item)
            size = min(window, len(own))
            for k in range(len(own) - size + 1 if own else 0):
                for i in range(len(words) - size + 1):
                    if words[i : i + size] == own[k : k + size]:
                        hit.update(range(i, i + size))
                        names.add(name)
        out.append((len(words), hit, names))
    return out


@pytest.mark.parametrize("shard_words", [200_000, 8])
def test_decontamination(spark, shard_words):
    draw = random.Random(3)
    words = lambda n: " ".join(draw.choices("abcd", k=n))
    items = [(str(i), words(draw.randint(0, 9))) for i in range(12)] + [("5", "a b"), ("x", None)]
    texts = [words(draw.randint(0, 40)) for _ in range(60)]
    texts.append(texts[0])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = {r.doc_id: r for r in decontaminate.match_documents(docs, bench, window=4, shard_words=shard_words).collect()}
    for i, (n, hit, names) in enumerate(brute_hits(texts, [x for x in items if x[1]], 4)):
        got = {k for s in found[i].spans for k in range(s.s, s.e)}
        assert (found[i].n_words, got, set(found[i]["items"])) == (n, hit, names)


def test_removed_spans():
    assert decontaminate.remove_spans("A, b! C d.", [{"s": 1, "e": 3}]) == "A,  d."


def test_jaccard_join(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in rows_of(spark, sf_dir, "documents")]
    base = " ".join(f"w{i}" for i in range(200))
    docs += [(10_000 + i, base.replace(f"w{i * 7} ", f"x{i} ")) for i in range(25)]
    docs += [(20_000, "a b"), (20_001, "A B"), (20_002, ""), (20_003, None)]
    sets = {i: frozenset(jaccard_join.shingles(t).tolist()) for i, t in docs}
    near = defaultdict(set)
    ids = [i for i in sets if sets[i]]
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                near[a].add(b)
                near[b].add(a)
    root = {}
    for i in sorted(sets):
        stack = [i]
        while stack:
            j = stack.pop()
            if j not in root:
                root[j] = i
                stack += near[j]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: r for r in jaccard_join.near_duplicates(table).collect()}
    missing = sum(found[i].n_links != len(near[i]) for i in sets)
    assert missing <= 0.01 * len(sets)
    assert sum(found[i].class_id != root[i] for i in sets) <= 0.01 * len(sets)
    kept = {r.doc_id for r in jaccard_join.keep_one(table).collect()}
    assert kept == {i for i in sets if found[i].class_id == i}


@pytest.mark.parametrize("block", [7, 2])
def test_jaccard_join_of_blocks(spark, monkeypatch, block):
    """A group larger than a block loses no link, compared whole or by buckets."""
    monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", (block, block))
    base = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(40):
        words = list(base)
        words[(i * 7) % 300] = f"x{i}"
        texts.append((i, " ".join(words)))
    found = jaccard_join.near_duplicates(spark.createDataFrame(texts + texts[:3], "doc_id long, text string")).collect()
    assert {r.class_id for r in found} == {0}
    assert all(r.n_class_links == 39 and r.n_links == 42 for r in found)


def test_jaccard_join_of_chains(spark, monkeypatch):
    """A component chained by many small buckets is compared by buckets and counts each link once; hot buckets get their hub by broadcast."""
    monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", (2, 2))
    monkeypatch.setattr(jaccard_join, "HOT_SHARE", 50)
    monkeypatch.setattr(jaccard_join, "HOT_CLASSES", 3)
    words = [f"w{i}" for i in range(900)]
    docs = [(i, " ".join(words[i * 8 : i * 8 + 160])) for i in range(80)]
    sets = [set(jaccard_join.shingles(t).tolist()) for _, t in docs]
    near = [[j for j in range(80) if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(80)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    signed = jaccard_join.signatures(table, 0.8, 0.999, 128)
    classes = signed.selectExpr("digest", "doc_id", "text_key", "1L as copies", "n_shingles", "bands")
    buckets = jaccard_join.bucket_rows(classes)
    members = classes.join(jaccard_join.components(jaccard_join._ties(buckets)).toDF("digest", "component"), "digest")
    assert jaccard_join._groups(members, buckets).filter("band >= 0").count() > 0
    found = {r.doc_id: r for r in jaccard_join.near_duplicates(table).collect()}
    assert {r.class_id for r in found.values()} == {0}
    wanted = sum(map(len, near))
    assert all(found[i].n_links <= len(near[i]) for i in found) and sum(r.n_links for r in found.values()) >= 0.99 * wanted


def test_components(spark):
    """Paths, stars, loops and repeated edges; nulls drop."""
    draw = random.Random(4)
    names = draw.sample(range(1000), 120)
    edges = list(zip(names[:50], names[1:50])) + [(names[60], x) for x in names[61:90]] + [(names[95], names[95])] + list(zip(names[:5], names[1:6]))
    found = components(spark.createDataFrame([*edges, (None, 5)], "a long, b long")).collect()
    want = {x: min(names[:50]) for x in names[:50]} | {x: min(names[60:90]) for x in names[60:90]} | {names[95]: names[95]}
    assert {r.node: r.root for r in found} == want and len(found) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_band_choice():
    bands, rows = jaccard_join.choose_bands(0.8, 0.999, 128)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.999


def accuracy(pairs):
    return sum(a == b for a, b in pairs) / len(pairs)


def test_language_held_out(spark):
    sf_dir = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in rows_of(spark, sf_dir, "documents")}
    found = [r for r in queries.op9_language_id(spark, sf_dir).collect() if r.held_out]
    assert len(found) > 200 and accuracy([(r.lang_pred, langs[r.doc_id]) for r in found]) > 0.97


def test_quality_held_out(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in rows_of(spark, sf_dir, "labels")}
    found = [r for r in queries.op7_pu_quality(spark, sf_dir).collect() if r.held_out and r.doc_id in labels]
    good = [r.predicted for r in found if labels[r.doc_id] == 1]
    bad = [r.predicted for r in found if labels[r.doc_id] == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.5 * len(bad)


ABUSIVE = set("trash pathetic idiot worthless disgusting stupid clown scum loser moron".split())


@pytest.mark.parametrize("size", ["0.01", "0.1"])
def test_toxicity_held_out(spark, size):
    """Of held-out rows: those labelled toxic that have an abusive English word, all labelled toxic, and clean ones."""
    sf_dir = f"/root/testdata/sf{size}"
    labels = {r.doc_id: r.toxic for r in rows_of(spark, sf_dir, "labels")}
    texts = {r.doc_id: r.text for r in rows_of(spark, sf_dir, "documents")}
    found = [r for r in queries.op8_toxicity(spark, sf_dir).collect() if r.held_out and r.doc_id in labels]
    hits = [r.toxic for r in found if labels[r.doc_id] == 1 and ABUSIVE & set(toxicity.words_of(texts[r.doc_id]))]
    clean = [r.toxic for r in found if labels[r.doc_id] == 0]
    every = [r.toxic for r in found if labels[r.doc_id] == 1]
    assert len(hits) > 3 and sum(hits) >= 0.9 * len(hits) and sum(every) >= 0.65 * len(every) and sum(clean) <= 0.03 * len(clean)


def test_chain_against_plain_fits():
    """Each earlier probability in training comes from a model without the row's fold, whose words were chosen without it; prediction feeds them on."""
    draw = np.random.default_rng(7)
    uses = draw.integers(0, 3, (300, 8)) * (draw.random((300, 8)) < 0.6)
    noise = draw.random(300) < 0.1
    y = np.stack([(uses[:, 0] > 0) ^ noise, uses[:, 1] > 0, (uses[:, 0] > 0) | (uses[:, 2] > 1)], axis=1)
    part = np.arange(300) // 7 % 5
    row, word = np.nonzero(uses)
    weights, rest, earlier = toxicity.fit_chain(toxicity.Sample(row, word, uses[row, word], 300, 8), y, part)

    def plain(seen, target, train):
        chosen = []
        for k in range(8):
            have = [i for i in range(300) if train[i] and uses[i, k]]
            rate = sum(target[train]) / sum(train)
            away = abs(sum(target[i] for i in have) - len(have) * rate) - 0.5
            if len(have) >= 3 and away >= 3 * math.sqrt(len(have) * rate * (1 - rate) * (1 - len(have) / sum(train))):
                chosen.append(k)
        x = np.hstack([np.log1p(uses[:, chosen]), seen]).astype(np.float32)
        w = fit_logistic(x[train], target[train].astype(np.float32), ridge=1.0, steps=150)
        return chosen, x, w

    seen = np.zeros((300, 0), np.float32)
    for j in range(3):
        chosen, _, w = plain(seen, y[:, j], np.ones(300, bool))
        assert chosen and np.allclose(weights[chosen, j], w[: len(chosen)], atol=1e-3) and np.allclose(rest[j], w[len(chosen) :], atol=1e-3)
        assert not weights[[k for k in range(8) if k not in chosen], j].any()
        held = np.zeros((300, 1), np.float32)
        for k in range(5):
            _, x, w = plain(seen, y[:, j], part != k)
            held[part == k, 0] = 1 / (1 + np.exp(-(x[part == k] @ w[:-1] + w[-1])))
        if j < 2:
            assert np.allclose(earlier[:, j], held[:, 0], atol=1e-3)
        seen = np.hstack([seen, held])
    model = toxicity.Model({x: i for i, x in enumerate("abcdefgh")}, weights, rest)
    chances = []
    for j in range(3):
        total = math.log(3) * weights[0, j] + math.log(2) * weights[1, j] + sum(p * q for p, q in zip(chances, rest[j])) + rest[j][-1]
        chances.append(1 / (1 + math.exp(-total)))
    assert np.allclose(model.predict(["A b, a! x"])[0], chances, atol=1e-4)


def test_non_negative_risk_is_least(spark):
    """The fitted weights against small changes of each, by the risk written out row by row."""
    draw = np.random.default_rng(8)
    good = draw.random((400, 3)) < [0.8, 0.7, 0.5]
    bad = draw.random((400, 3)) < [0.2, 0.4, 0.5]
    x = np.vstack([good[:200], good[200:320], bad[:80]]).astype(np.float32)
    positive = np.arange(400) < 200
    prior, ridge = 0.6, 1e-3
    w = pu_quality.fit_non_negative(x, positive, prior, steps=3000, rate=0.01, ridge=ridge)

    def risk(w):
        loss = lambda z: math.log1p(math.exp(-z))
        z = [float(r @ w[:-1] + w[-1]) for r in x]
        p, u = [v for v, y in zip(z, positive) if y], [v for v, y in zip(z, positive) if not y]
        mean = lambda f, v: sum(map(f, v)) / len(v)
        negative = mean(lambda v: loss(-v), u) - prior * mean(lambda v: loss(-v), p)
        return prior * mean(loss, p) + max(0.0, negative) + ridge / 2 * float(w @ w)

    least = risk(w)
    for k in range(4):
        for step in (-0.3, -0.1, 0.1, 0.3):
            other = w.copy()
            other[k] += step
            assert risk(other) >= least - 1e-4


def test_quality_scores_by_hand(spark, sf_dir):
    """Scores of the query's model, written out edge by edge."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = pu_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pu_quality.score(docs, model).collect():
        total, k = float(model.weights[-1]), 0
        for value, edges in zip(pu_quality.features(texts[r.doc_id]), model.edges):
            for edge in edges:
                total += float(model.weights[k]) * (value > edge)
                k += 1
        assert abs(r.score - 1 / (1 + math.exp(-total))) < 1e-4 and r.predicted == (r.score >= 0.3)


def test_nearest_centroid_by_hand(spark, sf_dir):
    """Document frequencies, cosines and the nearest centroid, with dictionaries."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    held = defaultdict(int)
    for t in texts.values():
        for g in np.flatnonzero(language_id.grams(t)).tolist():
            held[g] += 1
    assert dict(enumerate(language_id.document_frequencies(docs).tolist())) == {g: held[g] for g in range(language_id.BUCKETS)}
    for r in language_id.predict(docs, model).orderBy("doc_id").limit(40).collect():
        counts = language_id.grams(texts[r.doc_id])
        vector = {g: math.log1p(int(counts[g])) * float(model.idf[g]) for g in np.flatnonzero(counts).tolist()}
        size = math.sqrt(sum(v * v for v in vector.values()))
        cosines = [sum(v * float(c[g]) for g, v in vector.items()) / size for c in model.centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert r.lang_pred == model.languages[best] and abs(r.score - cosines[best]) < 1e-4
        assert r.rejected == (cosines[best] < model.radius[best]) or abs(cosines[best] - model.radius[best]) < 1e-4


def test_many_languages_and_repeated_rows(spark):
    """Every language is learned, however many there are and however often one row repeats."""
    draw = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(230):
        own = ["".join(draw.choices(letters, k=4)) for _ in range(3)]
        rows += [(1000 * k + i, " ".join(draw.choices(own, k=20)), f"l{k:03}") for i in range(6)]
    rows += [(7, "the very same words again and again", "hot")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language_id.fit(docs)
    learned = {r.lang for r in docs.filter("lang is not null and crc32(cast(cast(doc_id as string) as binary)) % 3 != 1").select("lang").distinct().collect()}
    assert set(model.languages) == learned and len(learned) > 220 and "hot" in learned
    assert model.predict(["the very same words again and again"])[0] == ["hot"]
