import random
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from nearfield.llm import near_dedup
from nearfield.llm.alignment import similar
from nearfield.llm.common import SIMILARITY
from nearfield.llm.components import components
from nearfield.llm.near_dedup import SHORT_WORDS, SKETCHES, _prefix_sizes, near_groups, one_of_each, prefix_keys, sketches, word_hashes

SCHEMA = "doc_id long, text string, digest string, words int, sketches int, source string"


def docs(spark, rows):
    """Extra columns have names that the operator uses itself."""
    return spark.createDataFrame([(k, t, "x", 1, 2, None) for k, t in rows], SCHEMA)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40), st.lists(st.integers(0, 5), max_size=40), st.sampled_from([0.5, 0.8, 0.95]))
def test_alignment_is_exact(a, b, least):
    longer = max(len(a), len(b))
    wanted = distance(a, b) <= int(longer * (1 - least) + 1e-9)
    assert similar([(np.array(a, "<u4"), np.array(b, "<u4"))], least)[0] == wanted


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at : at + 1] = rng.choice([[], [f"new{rng.random()}"], [words[at], f"more{rng.random()}"]])
    return words


def test_classes_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(900)]
    passage = rng.sample(vocabulary, 60)
    texts = []
    for _ in range(40):
        base = rng.choices(vocabulary, k=rng.randrange(6, 200))
        if rng.random() < 0.3:
            base[3:3] = passage
        texts += [base] + [edited(rng, base, max(1, len(base) // 30)) for _ in range(rng.choice([0, 0, 1, 4]))]
    texts += [texts[0]] * 3
    rng.shuffle(texts)
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if distance(texts[i], texts[j]) <= int(max(len(texts[i]), len(texts[j])) * 0.2 + 1e-9):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    got = {r["doc_id"]: r["class_id"] for r in near_groups(docs(spark, rows)).collect()}
    assert got == {k: root(k) for k in range(len(texts))}


def test_sketches_depend_on_order_and_occurrence():
    m = np.arange(1, 41, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    sketch = lambda t: sketches([word_hashes([t], {})[0][1]], m)[0]
    a, b = " ".join(f"a{k}" for k in range(50)), " ".join(f"b{k}" for k in range(50))
    swapped = (sketch(f"{a} {b}") == sketch(f"{b} {a}")).sum()
    same = (sketch(f"{a} {b}") == sketch(f"{a} {b} more")).sum()
    assert swapped < same
    assert len(sketch("a b")) == 40 and sketches([], m).shape == (0, 40)
    once, thrice = " ".join(["x y z"] * 20), " ".join(["x y z"] * 60)
    assert (sketch(once) != sketch(thrice)).any()


def test_sketches_do_not_depend_on_the_other_texts_of_a_batch():
    rng = random.Random(9)
    m = np.random.default_rng(2).integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.choice([1, 3, 4, 5, 6, 40, 3000]))) for _ in range(60)]
    texts += [" ".join(["same words again"] * 50_000)]
    hashes = [w for _, w in word_hashes(texts, {})]
    assert (sketches(hashes, m) == np.vstack([sketches([w], m) for w in hashes])).all()


def test_pairs_at_the_threshold_share_a_sketch():
    m = np.random.default_rng(11).integers(1, 1 << 63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    rng = np.random.default_rng(4)
    for words in (100, 400):
        for replaced, least in ((0.2, 0.87), (0.15, 0.97), (0.1, 0.99), (0.05, 1.0)):
            one, two = [], []
            for _ in range(400):
                a = rng.integers(0, 1 << 32, words, dtype=np.uint32)
                b = a.copy()
                b[rng.choice(words, int(replaced * words), replace=False)] = rng.integers(0, 1 << 32, int(replaced * words), dtype=np.uint32)
                one.append(a)
                two.append(b)
            assert (sketches(one, m) == sketches(two, m)).any(axis=1).mean() >= least


@settings(max_examples=300, deadline=None)
@given(st.data(), st.integers(1, SHORT_WORDS), st.sampled_from([3, 8, 1000]), st.sampled_from([0.7, 0.8, 0.9]))
def test_near_short_texts_share_a_pair_of_words(data, n, vocabulary, least):
    """Whatever the edits, their places and how common the words are."""
    word = st.integers(0, vocabulary)
    a = data.draw(st.lists(word, min_size=n, max_size=n))
    b = list(a)
    for _ in range(data.draw(st.integers(0, int(n / least) - n + 2))):
        at, kind = data.draw(st.integers(0, len(b) - 1)), data.draw(st.integers(0, 2))
        b[at : at + 1] = [[], [data.draw(word)], [b[at], data.draw(word)]][kind] if len(b) > 1 else [b[at], data.draw(word)]
    if distance(a, b) > int(max(len(a), len(b)) * (1 - least) + 1e-9):
        return
    counters = np.random.default_rng(n).integers(0, 4, 64)
    one, two = prefix_keys([np.array(x, np.uint32) for x in (a, b)], _prefix_sizes(least), counters)
    assert a == b or np.isin(one, two).any()


def test_short_texts_at_the_threshold_are_linked(spark):
    """Scattered replaced words, as many as the threshold allows, in texts of 5 to 50 words; a phrase that all texts have."""
    rng = random.Random(8)
    rows, wanted = [], {}
    for n in (5, 8, 10, 15, 20, 30, 40, 50):
        for _ in range(25):
            a = [f"v{rng.randrange(5000)}" for _ in range(n)]
            if n >= 10:
                a[3:7] = ["the", "same", "old", "phrase"]
            b = list(a)
            for at in rng.sample(range(n), n // 5):
                b[at] = f"other{rng.random()}"
            wanted |= {len(rows): len(rows), len(rows) + 1: len(rows)}
            rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    assert {r["doc_id"]: r["class_id"] for r in near_groups(docs(spark, rows)).collect()} == wanted


def test_nulls_ties_and_empty_table(spark):
    long = " ".join(f"w{k % 977}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (4, "one two"), (None, "alone here now"), (7, long), (8, long + " end"), (9, "One  two")]
    got = {(r["doc_id"], r["class_id"], r["class_size"]) for r in near_groups(docs(spark, rows)).collect()}
    assert got == {(1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 4, 3), (9, 4, 3), (None, None, 1), (7, 7, 2), (8, 7, 2)}
    stay = one_of_each(docs(spark, rows))
    assert stay.columns == docs(spark, rows).columns
    assert sorted((r["doc_id"] or 0) for r in stay.collect()) == [0, 1, 4, 7]
    assert near_groups(docs(spark, [])).count() == 0 and one_of_each(docs(spark, [])).count() == 0


def test_components_of_a_path_and_a_star(spark):
    links = [(k + 1, k) for k in range(40)] + [(100, k) for k in range(101, 120)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 120)}}
    wild = defaultdict(set)
    rng = random.Random(1)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    for r in components(spark.createDataFrame(pairs, "u long, v long")).collect():
        wild[r["component"]].add(r["node"])
    assert all(min(v) == k for k, v in wild.items())
    of = {n: c for c, v in wild.items() for n in v}
    assert all(of[a] == of[b] for a, b in pairs if a != b)


def shared_sketches(count, seed=11):
    """What near_groups takes as sketches of a text."""
    m = np.random.default_rng(seed).integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return lambda text: (word_hashes([text], {})[0][0], sketches([word_hashes([text], {})[0][1]], m)[0])


def test_link_to_a_member_of_the_leaders_class(spark):
    sketched = shared_sketches(4)
    for seed in range(100_000):  # a leader L that leads all that A and S share, L ~ A ~ S, but not L ~ S
        words = [f"b{seed}x{k}" for k in range(100)]
        texts = [" ".join(t) for t in (words, words[15:], words[15:-15])]
        (_, x), (_, y), (_, z) = map(sketched, texts)
        if (y == z).any() and (x == y)[y == z].all():
            break
    assert distance(texts[0].split(), texts[2].split()) > 20
    got = near_groups(docs(spark, list(enumerate(texts))), count=4).collect()
    assert {(r["doc_id"], r["class_id"]) for r in got} == {(0, 0), (1, 0), (2, 0)}


def test_link_in_a_bucket_of_many_unlike_texts(spark):
    sketched = shared_sketches(2)
    passage = [f"p{k}" for k in range(30)]
    texts, at = [], sketched(" ".join(passage))[1][0]
    for seed in range(100_000):  # texts that share the passage's sketch at one place
        text = " ".join([f"u{seed}x{k}" for k in range(10)] + passage + [f"t{seed}x{k}" for k in range(10)])
        digest, x = sketched(text)
        if x[0] == at:
            texts.append((digest, text))
        if len(texts) == 40:
            break
    texts = sorted(texts)
    _, last = texts[-1]
    for seed in range(100_000):  # a near copy that shares this sketch alone, with the last of them
        words = last.split()
        words[:8] = [f"c{seed}x{k}" for k in range(8)]
        x = sketched(" ".join(words))[1]
        if x[0] == at and x[1] != sketched(last)[1][1]:
            break
    rows = [(k, t) for k, (_, t) in enumerate(texts)] + [(100, " ".join(words))]
    got = {r["doc_id"]: r["class_id"] for r in near_groups(docs(spark, rows), count=2).collect()}
    assert got == {**{k: k for k in range(40)}, 100: 39}


def test_texts_just_beyond_the_threshold_are_told_apart_where_their_pair_is_made(spark):
    rng = np.random.default_rng(5)
    passage = rng.integers(0, 1 << 32, 600, dtype=np.uint32)
    vocabulary = rng.integers(0, 1 << 32, 5000, dtype=np.uint32)
    beyond = [np.concatenate([passage, rng.choice(vocabulary, 190)]) for _ in range(40)]
    within = [np.where(rng.random(790) < 0.15, rng.choice(vocabulary, 790), beyond[0]) for _ in range(40)]
    bodies = spark.createDataFrame([(i, bytearray(w.astype("<u4").tobytes())) for i, w in enumerate(beyond + within)], "node long, words binary")
    pairs = [(i, j) for i in range(40) for j in range(i)] + [(0, j) for j in range(40, 80)]
    left = {tuple(r) for r in near_dedup._possible(spark.createDataFrame(pairs, "u long, v long"), near_dedup._profiles(bodies), 1 - SIMILARITY).collect()}
    near = similar([((beyond + within)[u], (beyond + within)[v]) for u, v in pairs], SIMILARITY)
    assert {p for p, yes in zip(pairs, near) if yes} <= left and all((0, j) in left for j in range(40, 80))
    assert sum(v < 40 for _, v in left) < 0.1 * 780


def test_profiles_of_few_and_of_many_counters_lose_no_near_pair(spark):
    rng = np.random.default_rng(6)
    longer = [rng.integers(0, 50, n, dtype=np.uint32) * np.uint32(2654435761) for n in (1030, 1100, 1250, 3000)]
    words = longer + [np.delete(w, rng.choice(len(w), len(w) // 5, replace=False)) for w in longer]
    bodies = spark.createDataFrame([(i, bytearray(w.astype("<u4").tobytes())) for i, w in enumerate(words)], "node long, words binary")
    pairs = spark.createDataFrame([(i, j) for i in range(8) for j in range(i)], "u long, v long")
    left = {tuple(r) for r in near_dedup._possible(pairs, near_dedup._profiles(bodies), 1 - SIMILARITY).collect()}
    assert {(i + 4, i) for i in range(4)} <= left
