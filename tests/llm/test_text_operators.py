"""Operators on texts against brute force, with odd rows of every kind."""

import hashlib
import random
import re
import time
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest

from noticiario.llm import (
    exact_dedup, mixing, near_join, packing, quality, repeats, token_codes, tokens, toxicity,
)
from noticiario.llm import components as components_module
from noticiario.llm.components import components
from noticiario.session import shared_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_encoder_equals_library():
    made = tokens.Encoder(tokens.specification(tokens.default_path()))
    letters = "abzABZéÉßłŁİıΣσςñ'’.,!?-_ \n\t\r\x0b  ̱́ẞ12²½٣ⅧH中あ🙂<|>*$%&;​×÷ªµºǅ"
    rng = random.Random(1)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    texts += ["<|endoftext|> x<|startoftext|>y", "<|ENDOFTEXT|>", "it's DON'T we'll 'tis", None]
    wanted = made.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert made.by_piece
    assert made.encode(texts) == [array("I", e.ids).tobytes() for e in wanted]


@pytest.mark.parametrize("batch_bytes", [1, 1000, tokens.BATCH_BYTES])
def test_encoder_cuts_no_word(monkeypatch, batch_bytes):
    """Letters whose lower case lies beyond U+024F stay with the letters before them."""
    monkeypatch.setattr(tokens, "BATCH_BYTES", batch_bytes)
    made = tokens.Encoder(tokens.specification(tokens.default_path()))
    texts = [form.format(chr(c)) for c in range(0x250) for form in ("a{0}b", "{0}.a{0}1 'S{0}", "{0}")]
    texts += ["", "\n", "<|a", "中 a.b", None]
    wanted = made.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert made.encode(texts) == [array("I", e.ids).tobytes() for e in wanted]
    assert made.encode([]) == []


def test_encoder_looks_up_different_pieces_once():
    class Counted(dict):
        asked = 0

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

    made = tokens.Encoder(tokens.specification(tokens.default_path()))
    made.known = Counted(made.known)
    one, two = made.encode(["the cat. " * 5000, "a THE " * 5000])
    assert (len(one), len(two)) == (4 * 15_000, 4 * 10_000)
    assert Counted.asked <= 10


@pytest.mark.parametrize("n", [0, 1, 1000])
@pytest.mark.parametrize("top", [200, 49_408, 1 << 32])
def test_codes_round_trip_and_random_access(n, top):
    ids = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64).astype("<u4")
    codes = token_codes.encode(ids)
    assert (token_codes.decode(codes) == ids).all()
    stored = token_codes.levels(codes)
    assert [token_codes.token_at(stored, i) for i in range(n)] == ids.tolist()


def test_token_file(spark, odd_docs, no_docs):
    path = shared_path(spark, "test-codes")
    token_codes.write(odd_docs, path, shards=3)
    encode = tokens.Encoder(tokens.specification(tokens.default_path())).encode
    wanted, every = [], []
    for d, t in sorted(
        ((r.doc_id, r.text) for r in odd_docs.collect()), key=lambda x: (x[0] is None, x[0] or 0)
    ):
        ids = encode([t])[0] + array("I", [1]).tobytes()
        wanted.append((d, len(ids) // 4, zlib.crc32(ids)))
        every.append(np.frombuffer(ids, "<u4").tolist())
    got = token_codes.documents(spark, path).orderBy("start").collect()
    assert ordered((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == ordered(wanted)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    first = next(r for r in got if r.doc_id == 1)
    places = spark.createDataFrame([(first.start,), (first.start + 2,), (10**9,)], "position long")
    found = {r.position: r.token for r in token_codes.tokens_at(spark, path, places).collect()}
    one = next(e for e, w in zip(every, wanted, strict=True) if w[0] == 1)
    assert found == {first.start: one[0], first.start + 2: one[2]}
    assert token_codes.encode_documents(no_docs).count() == 0


def test_packing(spark, odd_docs, no_docs):
    placed = packing.pack(odd_docs, capacity=64, group_items=50)
    held = defaultdict(list)
    for r in placed.collect():
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        assert [o for o, _ in sorted(parts)] == np.cumsum([0, *[n for _, n in sorted(parts)]])[:-1].tolist()
        assert sum(n for _, n in parts) <= 64
    total = sum(n for parts in held.values() for _, n in parts)
    assert len(held) <= -(-total // 64) + 2
    assert packing.pack(no_docs).count() == 0
    unique = odd_docs.where("doc_id in (1, 6, 7)")
    placed = packing.pack(unique, capacity=64)
    sequences = packing.sequences(unique, placed, capacity=64).collect()
    assert sum(len(r.ids) for r in sequences) == placed.groupBy().sum("length").first()[0]
    assert max(len(r.ids) for r in sequences) <= 64


def test_best_fit_prefers_the_fullest_bin():
    bins, places = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert bins.tolist() == [0, 1, 0, 1, 1]
    assert places.tolist() == [0, 0, 6, 5, 8]


def test_exact_dedup(odd_docs, no_docs):
    groups = defaultdict(list)
    for r in odd_docs.collect():
        groups["".join(WORD.findall(r.text or ""))].append((-len(r.text or ""), r.doc_id is None, r.doc_id))
    wanted = []
    for key, rows in groups.items():
        rows.sort(key=str if any(d is None for _, _, d in rows) else None)
        best = min(rows, key=lambda x: (x[0], x[1], x[2] or 0))
        digest = hashlib.sha256(key.encode()).hexdigest()
        wanted += [(d, best[2], len(rows), digest) for _, _, d in rows]
    got = exact_dedup.membership(odd_docs).collect()
    assert ordered((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == ordered(wanted)
    assert sum(r.kept for r in got) == len(groups)
    for support in (0.001, 0.2):
        left = exact_dedup.dedup(odd_docs, support=support)
        assert left.columns == odd_docs.columns
        assert ordered(left.select("doc_id").collect()) == ordered((r.doc_id,) for r in got if r.kept)
    assert exact_dedup.membership(no_docs).count() == exact_dedup.dedup(no_docs).count() == 0


def repeats_by_hand(docs, window):
    words = [WORD.findall(t or "") for _, t in docs]
    count = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(docs, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        left = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(left.encode()).hexdigest()))
    return ordered(out)


@pytest.mark.parametrize("window", [3, 9, 35])
def test_repeats(spark, odd_docs, no_docs, window):
    rng = random.Random(window)
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for i in range(40):
        n = rng.choice([1, 5, 40, 200])
        docs.append((i, rng.choice([" ", "\n"]).join(
            rng.choice("abcd") + rng.choice(["", "1", "2"]) for _ in range(n))))
    docs += [(99, "x y z " * 50)] * 2 + [(100, " ".join(f"v{k}" for k in range(70)))] * 3
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert ordered(repeats.digests(df, window).collect()) == repeats_by_hand(docs, window)
    left = repeats.removed(odd_docs.withColumnRenamed("size", "starts"), window)
    assert left.count() == odd_docs.count()
    assert repeats.digests(no_docs).count() == 0


def test_sketch_never_underestimates():
    rng = np.random.default_rng(3)
    anchors = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    anchors = np.concatenate([anchors, anchors[:50]])
    for row in range(repeats.ROWS):
        cells, n = np.unique(repeats._cells(anchors, row, 1 << 10), return_counts=True)
        met = dict(zip(cells.tolist(), n.tolist(), strict=True))
        assert all(met[c] > 1 for c in repeats._cells(anchors[:50], row, 1 << 10).tolist())


def near_by_hand(docs):
    sets = []
    for _, t in docs:
        w = WORD.findall(t or "")
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()})
    root, links = list(range(len(docs))), [0] * len(docs)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for k, (d, _) in enumerate(docs):
        if d is not None:
            least[find(k)] = min(least.get(find(k), d), d)
    return ordered((d, least.get(find(k)) if sets[k] else d, links[k]) for k, (d, _) in enumerate(docs))


def test_near_join(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(near_join, "CLUSTER_BLOCK", 4)  # clusters meet in blocks
    monkeypatch.setattr(near_join, "NODE_BLOCK", 8)
    rng, docs = random.Random(3), [(r.doc_id, r.text) for r in odd_docs.collect()]
    for _ in range(12):
        base = [f"w{rng.randint(0, 99999)}" for _ in range(rng.choice([3, 8, 60, 150]))]
        for _ in range(rng.choice([1, 3, 20])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 9)}"
            docs.append((rng.choice([len(docs), None, 5]), " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    wanted = near_by_hand(docs)
    assert ordered(near_join.near_classes(df).collect()) == wanted
    left = near_join.keep_one(odd_docs)
    assert left.columns == odd_docs.columns
    alone = sum(not WORD.findall(r.text or "") for r in odd_docs.collect())
    assert left.count() == alone + 4  # a b c; the long text; abc; other text
    assert near_join.near_classes(no_docs).count() == near_join.keep_one(no_docs).count() == 0


def test_prefixes_shorten_until_the_recall_is_met():
    depth = near_join.prefix_depth(0.8, 20, 8, 0.999)
    assert 1 - (1 - 0.8**depth) ** 20 >= 0.999 > 1 - (1 - 0.8 ** (depth + 1)) ** 20
    assert near_join.prefix_depth(0.5, 20, 8, 0.999) < depth
    assert near_join.prefix_depth(0.1, 2, 8, 0.9999) == 1


def near_pairs(rng, similarity, count, words=400):
    """Separate pairs of texts of this Jaccard similarity of single words."""
    r = round(words * (1 - similarity) / (2 * similarity))
    rows = []
    for k in range(count):
        own = [f"{similarity}a{k}b{i}c{rng.random()}" for i in range(words + 2 * r)]
        rows += [" ".join(own[: words + r]), " ".join(own[:words] + own[words + r :])]
    return rows


@pytest.mark.parametrize("similarity, depth", [(0.995, 8), (0.81, 5)])
def test_prefixes_are_as_long_as_the_data_allow(spark, similarity, depth, monkeypatch):
    texts = near_pairs(random.Random(similarity), similarity, 60)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    depths, plain = [], near_join._links_at
    monkeypatch.setattr(near_join, "_links_at", lambda c, t, d, a: depths.append(d) or plain(c, t, d, a))
    got = near_join.near_classes(df, n=1).collect()
    assert depths[0] == near_join.DEPTH and depths[-1] == depth
    assert all(r.class_id == r.id // 2 * 2 and r.n_links == 1 for r in got)


def test_next_depth():
    args = (5, 0.8, 20, 0.999)
    assert near_join.next_depth({}, 8, *args) == near_join.next_depth({100: 5, 97: 1}, 8, *args) == 8
    assert near_join.next_depth({100: 5000, 81: 1}, 8, *args) == near_join.next_depth({70: 1}, 8, *args) == 5
    assert near_join.next_depth({85: 3}, 8, *args) == 7


def test_planted_pairs_are_found(spark):
    rng = random.Random(11)
    texts = [t for s in (0.8, 0.82, 0.85, 0.88, 0.9) for t in near_pairs(rng, s, 80, 200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = near_join.near_classes(df, n=1).collect()
    assert len(got) == 800 and sum(r.n_links == 1 and r.class_id == r.id // 2 * 2 for r in got) >= 798


def test_null_and_shared_ids_take_linear_work(spark):
    """Texts are fetched by id and hash: 10 000 rows without an id, in pairs."""
    rows = spark.range(10_000).selectExpr(
        "IF(id % 2 = 0, NULL, 7) AS doc_id",
        "array_join(transform(sequence(1, 30), k -> concat('w', id div 4, 'x', IF(k = 30 AND id % 4 > 1, 31, k))), ' ') AS text",
    ).repartition(4)
    begun = time.time()
    got = near_join.near_classes(rows).collect()
    assert len(got) == 10_000 and {r.n_links for r in got} == {3} and {r.class_id for r in got} == {7}
    assert time.time() - begun < 120


def test_components_of_hot_nodes(spark, monkeypatch):
    links = [(0, k) for k in range(1, 900)] + [(k, k + 1) for k in range(2000, 2050)] + [(899, 2000)]
    frame = spark.createDataFrame(links, "a long, b long")
    for cut in (10, 10_000):
        monkeypatch.setattr(components_module, "HOT_LINKS", cut)
        got = {r.node: r.root for r in components(frame).collect()}
        assert got == {k: 0 for k in [*range(900), *range(2000, 2051)]}


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 60)] + [(100, 200), (200, 300), (7, 7), (500, 500), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 61)} | {100: 100, 200: 100, 300: 100, 500: 500}


def test_mixture(spark, odd_docs, no_docs):
    rows = [(k, " ".join("w" * (1 + k % 37)), f"s{k % 5}" if k % 7 else None) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.mixture(docs).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t))
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full: dict = {}
    while True:
        level = (sum(sizes.values()) - sum(full.values())) / sum(weight[s] for s in order if s not in full)
        more = {s: 3 * sizes[s] for s in order if s not in full and level * weight[s] > 3 * sizes[s]}
        if not more:
            break
        full |= more
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
        assert r.target == pytest.approx(full.get(r.source, level * weight[r.source]))
        taken[r.source] += r.taken
    assert all(abs(taken[r.source] - r.target) <= 1 for r in got)  # the smallest size is 1
    again = {r.doc_id: r.taken for r in mixing.mixture(docs).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    odd = mixing.mixture(odd_docs)
    assert odd.count() == odd_docs.count()
    mix = mixing.mixed(odd_docs)
    assert mix.columns == odd_docs.columns
    assert mix.count() == odd.agg({"copies": "sum"}).first()[0]
    assert mixing.mixture(no_docs).count() == mixing.mixed(no_docs).count() == 0


def statistics_by_hand(text):
    words = WORD.findall(text or "")
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), again, len(hit))


def test_quality(spark, odd_docs, no_docs):
    rng = random.Random(5)
    texts = ["é x\né x\n \n#b | é x", "a b a b a b", None, "", "ü " * 60]
    texts += ["".join(rng.choice("ab#é \n") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = quality.judge(docs, quality.Trees()).collect()
    assert ordered((r.doc_id, *[r[b] for b in quality.BASE]) for r in got) == ordered(
        (k, *statistics_by_hand(t)) for k, t in enumerate(texts)
    )
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
    assert all(r.kept == (not r.base_failed) for r in got)  # unfitted trees drop nothing more
    assert quality.judge(no_docs, quality.Trees()).count() == 0
    assert quality.judge(odd_docs, quality.Trees()).count() == odd_docs.count()
    labels = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    assert not len(quality.fit(odd_docs, labels).feature)


def test_trees_learn_and_stay_monotonic():
    rng = np.random.default_rng(2)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 2] < 0.5) & (x[:, 0] + rng.normal(0, 0.2, 4000) > 0.3)).astype(float)
    trees = quality.grow_trees(x[:3000], y[:3000], tuple(quality.FEATURES.values()))
    right = (trees.probability(x[3000:]) > 0.5) == y[3000:]
    assert right.mean() > 0.85
    for k, limit in enumerate(quality.FEATURES.values()):
        if limit:
            ramp = np.repeat(x[:50], 20, axis=0)
            ramp[:, k] = np.tile(np.linspace(0, 1, 20), 50)
            p = trees.probability(ramp).reshape(50, 20)
            assert (np.diff(p, axis=1) * limit >= -1e-12).all()


def test_toxicity_chain(spark, odd_docs, no_docs):
    rng = random.Random(7)
    docs, labels = [], []
    for k in range(1500):
        toxic, junk = k % 5 == 0, k % 7 == 0
        words = [f"w{rng.randint(0, 400)}" for _ in range(60)]
        if toxic:
            words[:3] = rng.sample(["Vile", "foul", "nasty", "rude"], 3)
        if junk:
            words[4] = "spamspam"
        docs.append((k, " ".join(words)))
        labels.append((k, int(junk), int(toxic)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame([*labels[:1000], (None, 1, 1), (5, None, None)], "doc_id long, junk int, toxic int")
    chain = toxicity.fit(df, known, ("junk", "toxic"))
    assert {"vile", "foul", "nasty", "rude", "spamspam"} <= set(chain.words)
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1  # sees the earlier category
    got = {r.doc_id: r for r in toxicity.score(df, chain).collect()}
    held = labels[1000:]
    assert np.mean([got[k].rejected == bool(t) for k, _, t in held]) > 0.97
    assert toxicity.keep_accepted(df, chain).count() == sum(not r.rejected for r in got.values())
    left = toxicity.keep_accepted(odd_docs, chain)
    assert left.columns == odd_docs.columns and left.count() == odd_docs.count()
    assert toxicity.score(no_docs, chain).count() == 0
    bare = toxicity.fit(df, known.limit(0), ("junk", "toxic"))
    assert not toxicity.score(odd_docs, bare).where("rejected").count()


def test_toxic_stems_of_every_language(spark):
    """Stems with endless endings: each whole word is too rare to tell anything."""
    rng = random.Random(3)
    stems = {"en": "idiotth", "de": "achlich", "fr": "réeux", "es": "boménte"}
    syllables = ["er", "ung", "ba", "ko", "ti", "lle", "é", "ñu", "sch", "ar", "on", "mi"]

    def made():
        return "".join(rng.choices(syllables, k=4))

    rows = []
    for k in range(1200):
        lang, toxic = list(stems)[k % 4], k // 4 % 6 == 0
        text = [lang + made() if rng.random() < 0.3 else made() for _ in range(40)]
        if toxic:
            text[:5] = [stems[lang] + made() for _ in range(5)]
        rows.append((k, " ".join(text), lang, int(toxic), int(rng.random() < 0.5)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int, low int")
    chain = toxicity.fit(df.where("doc_id < 800"), df.select("doc_id", "low", "toxic"), ("low", "toxic"))
    held = df.where("doc_id >= 800")
    kept = {r.doc_id for r in toxicity.keep_accepted(held, chain).collect()}
    for lang in stems:
        toxic = [r[0] for r in rows[800:] if r[2] == lang and r[3]]
        clean = [r[0] for r in rows[800:] if r[2] == lang and not r[3]]
        assert np.mean([k in kept for k in toxic]) < 0.1, lang
        assert np.mean([k in kept for k in clean]) > 0.97, lang


def test_cut_is_chosen_on_predictions():
    p = np.array([0.4, 0.35, 0.3, 0.2, 0.1])
    assert 0.2 < toxicity.best_cut(p, np.array([1, 1, 1, 0, 0])) < 0.3
    # nothing learnt: not everything is rejected
    assert toxicity.best_cut(np.full(10, 0.1), np.array([1, *[0] * 9])) == toxicity.REJECT
    assert toxicity.best_cut(p, np.zeros(5)) == toxicity.REJECT


@pytest.mark.parametrize("threshold", [0.5, 0.2])
def test_near_join_at_low_thresholds(spark, threshold):
    """Separate pairs a little above the threshold, without closer ones to chain them."""
    rng, rows = random.Random(5), []
    for k in range(60):
        own = [f"{k}x{rng.random()}" for _ in range(210)]
        # of 2 x (m + r) words m are common: similarity m / (m + 2 r)
        r = int(100 * (1 - threshold) / (2 * threshold)) - 2
        common, left, right = own[:100], own[100 : 100 + r], [f"{k}y{i}" for i in range(r)]
        rows += [(2 * k, " ".join(common + left)), (2 * k + 1, " ".join(common + right))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_join.near_classes(df, n=1, threshold=threshold).collect()
    assert len(got) == 120 and all(g.class_id == g.id // 2 * 2 and g.n_links == 1 for g in got)


def test_forest_reaches_the_recall_or_says_so():
    assert abs(near_join.least_agreement(0.8, 100) - 0.58) < 1e-6
    for t in (0.05, 0.2, 0.5, 0.8, 1.0):
        d = near_join.prefix_depth(t)
        assert 1 - (1 - t**d) ** near_join.tree_count(t, d) >= near_join.RECALL
    assert near_join.tree_count(0.8, 5) == near_join.TREES
    with pytest.raises(ValueError):
        near_join.tree_count(0.0)


def test_blocked_fit_equals_dense_fit(monkeypatch):
    rng = np.random.default_rng(3)
    dense = (rng.random((2500, 30)) < 0.1).astype(float)
    y = (rng.random(2500) < 1 / (1 + np.exp(-(dense @ rng.normal(size=30) - 1)))).astype(float)
    ridge = rng.random(31) + 0.5
    x, w = np.column_stack([np.ones(2500), dense]), np.zeros(31)
    penalty = np.concatenate([[1e-6], ridge[1:]])
    for _ in range(30):
        p = 1 / (1 + np.exp(-(x @ w)))
        w += np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
    row, place = np.nonzero(dense)
    starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=2500))])
    hits = toxicity.Hits(starts, place.astype(np.int32), 30)
    some = rng.permutation(2500)[:100]
    assert (hits.dense(some, np.array([7, 3])) == dense[some][:, [7, 3]]).all()
    for rows in (1, 999, 5000):
        monkeypatch.setattr(toxicity, "BLOCK_ROWS", rows)
        found = toxicity.fit_linear(
            lambda r: np.column_stack([np.ones(len(r)), hits.dense(r, np.arange(30))]), y, 31, ridge
        )
        assert np.abs(found - w).max() < 1e-6


def test_one_row_of_a_repeated_labelled_id(spark):
    rows = [(k, f"{'awful' if k % 4 == 0 else 'fine'} text w{k % 9} w{k % 5}", int(k % 4 == 0)) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic")
    hot = df.unionByName(df.where("doc_id = 3").crossJoin(spark.range(20_000)).drop("id"))
    one, many = toxicity.fit(df, labels, ["toxic"]), toxicity.fit(hot, labels, ["toxic"])
    assert one.words == many.words and np.allclose(one.weights[0], many.weights[0])


def test_removed_texts_equal_brute_force(spark):
    """Texts without the words of windows that start anywhere else, as ``removed`` gives them."""
    rng, n = random.Random(2), repeats.WINDOW
    shared = [f"s{rng.random()}" for _ in range(60)]
    texts = [" ".join([*(f"{k}a{i}" for i in range(20)), *shared[: 30 + k], *(f"{k}b{i}" for i in range(9))]) for k in range(20)]
    texts += ["short", None, ""]
    windows = Counter(tuple(w[i : i + n]) for w in ((t or "").split() for t in texts) for i in range(len(w) - n + 1))
    wanted = []
    for t in texts:
        words = (t or "").split()
        gone = {i + j for i in range(len(words) - n + 1) if windows[tuple(words[i : i + n])] > 1 for j in range(n)}
        wanted.append(t if not gone else " ".join(w for k, w in enumerate(words) if k not in gone))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in repeats.removed(df).collect()}
    assert [got[k] for k in range(len(texts))] == wanted and wanted != texts


def test_keep_good_equals_judge_and_repeated_ids_count_once(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    labels = spark.read.parquet(f"{sf_small}/labels.parquet")
    hot = docs.unionByName(docs.where("doc_id = 3").crossJoin(spark.range(500)).drop("id"))
    trees = quality.fit(docs, labels)
    again = quality.fit(hot, labels)
    assert np.allclose(trees.least, again.least)
    judged = {r.doc_id: r.kept for r in quality.judge(docs, trees).collect()}
    good = quality.keep_good(docs.withColumn("_good", docs.doc_id), trees)
    assert good.columns == [*docs.columns, "_good"]
    assert {r.doc_id for r in good.collect()} == {d for d, k in judged.items() if k}


def test_exact_dedup_of_columns_with_odd_names(odd_docs):
    named = odd_docs.withColumnsRenamed({"doc_id": "a.id", "text": "the text"})
    got = exact_dedup.membership(named, "the text", "a.id")
    assert ordered(got.collect()) == ordered(exact_dedup.membership(odd_docs).collect())
    left = exact_dedup.dedup(named, "the text", "a.id")
    assert left.columns == named.columns and left.count() == exact_dedup.dedup(odd_docs).count()


def test_places_are_those_of_the_parts_of_each_word():
    from noticiario.llm import toxicity

    texts = ["Achlichkeit dumm, dumm! ab", "eré_1 x dummheit", "", None, "nichts davon"]
    words = ["dumm", "~^dumm", "~keit", "~umm$", "~heit$", "ab", "~^ab$", "~eré_"]
    places = toxicity._Places(words)
    for _ in range(2):  # the second time from memory
        for text in texts:
            parts = set().union(*map(toxicity.parts_of, toxicity.tokens_of(text)), set())
            assert places.of(text) == {k for k, w in enumerate(words) if w in parts}
    assert places.hits(texts).shape == (5, 8) and places.hits(texts)[0].sum() == 6
