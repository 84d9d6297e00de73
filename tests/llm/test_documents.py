"""Operators on documents against brute force, over given and hand-made rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from topicloom.llm import bpe, language, mixing, sharding, simhash, weighted

SF_DIR = "/root/testdata/sf0.001"
ODD = [
    (None, "no id at all", "en", "a"), (1, None, None, None), (2, "", "en", None), (3, " \t\n", "fr", "b"),
    (4, "same text here", "en", "a"), (5, "same text here", "en", "b"), (5, "same text here", "en", "b"),
    (6, "Été \x1c naïve 中文 😀", "fr", "Z"), (7, "x" * 5000, "de", "a"), (8, "w " * 4000, "de", "a"),
    (9, "12 34 ?!", None, "b"), (10, "a <|endoftext|>b's", "en", "a"), (-100, "negative id", "en", "é"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, "extra", 0) for r in ODD]
    schema = "doc_id long, text string, lang string, source string, _h string, size int"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


def n_words(text):
    return len((text or "").encode().split())


# Mixing


def expected_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, open_ = float(sum(sizes.values())), {}, set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total >= 3 * sizes[s]}
        if not above:
            return target | {s: left * weight[s] / total for s in open_}
        for s in above:
            target[s] = 3.0 * sizes[s]
        left -= sum(3 * sizes[s] for s in above)
        open_ -= above
    return target


@pytest.mark.parametrize("name", ["odd", "given"])
def test_mix_targets_and_taken(request, name):
    docs = request.getfixturevalue(name)
    rows = mixing.mix(docs).collect()
    texts = docs.select("doc_id", "text", "source").collect()
    sizes = defaultdict(int)
    for r in texts:
        sizes[r["source"]] += n_words(r["text"])
    target = expected_targets(sizes)
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in texts)
    taken = defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    largest = {s: max(n_words(r["text"]) for r in texts if r["source"] == s) for s in sizes}
    assert all(abs(taken[s] - target[s]) <= max(1, largest[s]) for s in sizes)
    again = mixing.mix(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_mix_repeats_rows(given):
    counts = {r["doc_id"]: r["repeats"] for r in mixing.mix(given).collect()}
    out = Counter(r["doc_id"] for r in mixing.repeated(given).collect())
    assert out == Counter({k: v for k, v in counts.items() if v})
    assert mixing.repeated(given).columns == given.columns


# Language


def test_language_held_out_accuracy(given):
    rows = language.identify(given).collect()
    lang = {r["doc_id"]: r["lang"] for r in given.collect()}
    assert len(rows) == len(lang)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    out = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in out) >= 0.95 * len(out)
    assert sum(r["rejected"] for r in rows) <= 0.02 * len(rows)


def test_language_odd_rows(odd, given):
    models = language.fit(given)
    rows = language.predict(odd, models).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ODD)
    for i in (1, 2, 3, 9):
        assert (by_id[i]["lang_pred"], by_id[i]["score"], by_id[i]["rejected"]) == ("und", 0.0, True)
    assert by_id[6]["lang_pred"] in models.languages
    nothing = language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_language_models_are_distributions(given):
    import numpy as np

    models = language.fit(given)
    ones = models.grams[0]
    for i in range(len(models.languages)):
        assert np.exp(models.logs[0][:, i]).sum() <= 1 + 1e-9
        # After each context: the n-grams seen, and back-off for all other characters.
        for c in range(0, len(models.contexts[1]), 7):
            context = models.contexts[1][c]
            pairs = context * language.MULT + ones
            hit = language._find(models.grams[1], pairs)
            logs = np.where(hit >= 0, models.logs[1][hit, i], models.backs[1][c, i] + models.logs[0][:, i])
            assert 0.99 <= np.exp(logs).sum() + np.exp(models.backs[1][c, i] + models.unknown[i]) <= 1 + 1e-9


def test_recognised_keeps_clean_documents(odd, given):
    kept = language.recognised(given)
    assert kept.columns == given.columns
    assert kept.count() >= 0.98 * given.count()


# Shards


@pytest.mark.parametrize("name", ["odd", "given"])
@pytest.mark.parametrize("shards", [16, 3])
def test_shards_are_even_and_gapless(request, name, shards):
    docs = request.getfixturevalue(name)
    rows = sharding.shard(docs, shards).collect()
    texts = docs.select("doc_id", "text").collect()
    expected = Counter(
        (r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in texts
    )
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == expected
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(texts)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_shards_keep_groups_together(spark):
    copies = [(i, f"group {i % 40}") for i in range(160)] + [(i, f"own {i}") for i in range(160, 800)]
    hot = [(i, "hot") for i in range(800, 1200)]
    docs = spark.createDataFrame(copies + hot, "doc_id long, text string")
    shard = {r["doc_id"]: r["shard"] for r in sharding.shard(docs, 8).collect()}
    groups = [{shard[i] for i in range(g, 160, 40)} for g in range(40)]
    assert sum(len(g) == 1 for g in groups) >= 36
    # 400 copies need three shards of 150; pieces of half a shard may open a few more.
    assert len({shard[i] for i in range(800, 1200)}) <= 6


# SimHash


def fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(prints, radius):
    ids = sorted(prints, key=lambda k: (k[0] is None, k[0] or 0, k[1]))
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                if a != b:
                    up[max(a, b, key=ids.index)] = min(a, b, key=ids.index)
    return {i: root(i)[0] for i in ids}


@pytest.mark.parametrize("name", ["odd", "given"])
def test_simhash_matches_brute_force(request, name):
    docs = request.getfixturevalue(name)
    prints = {(r["doc_id"], r["text"] or ""): fingerprint(r["text"]) for r in docs.collect()}
    expected = Counter()
    found = components_of(prints, 2)
    for r in docs.collect():
        key = (r["doc_id"], r["text"] or "")
        expected[r["doc_id"], f"{prints[key]:016x}", found[key]] += 1
    rows = simhash.components(docs).collect()
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows) == expected


@pytest.mark.parametrize("block", [simhash.BLOCK, 7])
def test_simhash_links_over_blocks(spark, block):
    """Planted fingerprints at 1 to 3 bits, also where blocks are cut into parts."""
    import random

    import numpy as np

    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(25)]
    prints = set(centres)
    for c in centres:
        for n in (1, 2, 3, 4):
            prints.update(c ^ sum(1 << b for b in rng.sample(range(64), n)) for _ in range(6))
    values = [int(np.uint64(p).astype(np.int64)) for p in sorted(prints)]
    rows = spark.createDataFrame([(v,) for v in values], "node long")
    rows = rows.select("node", F.array("node").alias("words"), simhash._pigeon_keys(F.col("node")).alias("keys"))
    got = {frozenset((r["a"], r["b"])) for r in simhash.links(rows, 2, 1, block).collect()}

    def classes(pairs):
        up = {v: v for v in values}

        def root(v):
            while up[v] != v:
                v = up[v]
            return v

        for a, b in pairs:
            up[root(a)] = root(b)
        return {frozenset(v for v in values if root(v) == r) for r in {root(v) for v in values}}

    mask = (1 << 64) - 1
    expected = [
        (a, b) for i, a in enumerate(values) for b in values[:i] if ((a ^ b) & mask).bit_count() <= 2
    ]
    assert classes(got) == classes(expected)
    assert all(((a ^ b) & mask).bit_count() <= 64 for a, b in got)


def test_compare_counts_every_distance():
    import numpy as np

    rng = np.random.default_rng(5)
    for words, radius in ((1, 2), (4, 44), (1, 0)):
        base = rng.integers(0, 2**63, (6, words), dtype=np.uint64)
        prints = np.repeat(base, 40, axis=0)
        for row in prints:
            for b in rng.choice(64 * words, rng.integers(0, 2 + radius), replace=False):
                row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        keys = np.sort(rng.integers(0, 5, len(prints)))
        low = simhash.compare(keys, prints, radius)
        links = simhash.Links(len(keys))
        i, j = np.triu_indices(len(keys), 1)
        near = (np.bitwise_count(prints[i] ^ prints[j]).sum(1) <= radius) & (keys[i] == keys[j])
        links.add(i[near], j[near])
        assert (low == links.low).all()


def test_near_duplicates_leave_one_document(spark, given):
    base = " ".join(f"word{i * 7919 % 1009}" for i in range(300))
    near = [base.replace(f"word{k}", "other", 1) for k in (5, 77, 500)]
    other = " ".join(f"term{i * 31 % 997}" for i in range(300))
    texts = [base, *near, other, base, None, "", "short one", "short one"]
    rows = [(i + 10, t, "en", "s", 0) for i, t in enumerate(texts)] + [(19, "short one", "en", "s", 0)]
    docs = spark.createDataFrame(rows, given.schema)
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [10, 14, 16, 18]


@pytest.mark.parametrize("limits", [{}, {"SHINGLES": 20_000}])
def test_near_duplicates_match_brute_force(spark, given, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(simhash, name, value)
    rng = random.Random(11)
    texts = []
    for likeness in (0.7, 0.75, 0.78, 0.8, 0.82, 0.85, 0.9):
        for i in range(25):
            base = [f"w{rng.randrange(10**9)}" for _ in range(304)]
            shared = round(2 * 300 * likeness / (1 + likeness) + 0.4)
            cut = 300 - shared
            copy = base[:-cut] + [f"w{rng.randrange(10**9)}" for _ in range(cut)]
            texts += [base, copy]
            if i % 5 == 0:  # a chain
                texts.append([f"w{rng.randrange(10**9)}" for _ in range(40)] + copy[40:])
    # Many repeats of one shingle are one element of the set.
    texts += [["again"] * 2000 + [f"w{rng.randrange(10**9)}" for _ in range(40)] for _ in range(3)]
    sets = [frozenset(tuple(t[k : k + 5]) for k in range(len(t) - 4)) for t in texts]
    low = list(range(len(texts)))
    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if len(a & b) * 5 >= 4 * len(a | b):
                x, y = sorted((low[i], low[j]))
                low = [x if v == y else v for v in low]
    rows = [(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)]
    kept = simhash.deduplicated(spark.createDataFrame(rows, given.schema).repartition(4))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(low))


def test_majority_counts_bits():
    import numpy as np

    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    bits = (hashes[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    expected = sum(1 << b for b in range(64) if 2 * int(bits[:, b].sum()) > 1000)
    assert int(simhash.majority(hashes, 1)[0]) == expected


# BPE


@pytest.mark.parametrize("name", ["odd", "given"])
def test_bpe_equals_the_tokenizer(request, name):
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(name)
    tokenizer = Tokenizer.from_file(bpe.default_path())
    expected = Counter()
    for r in docs.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        expected[
            r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(decoded.encode()).hexdigest(),
        ] += 1
    assert Counter(map(tuple, bpe.digests(docs).collect())) == expected
    coded = bpe.encode(docs).collect()
    assert sum(len(r["token_ids"]) for r in coded) == sum(k[1] * n for k, n in expected.items())


def test_bpe_on_random_strings():
    import random

    from tokenizers import Tokenizer

    definition = open(bpe.default_path(), encoding="utf-8").read()
    mine, theirs = bpe.Encoder(definition), Tokenizer.from_str(definition)
    rng = random.Random(2)
    letters = "abcdefgħİıΣσς'ſtsrvemld0123 \t\n\x0b\x1c\x85\xa0éé中文ａ़ְ😀ǅ<|endoftext|>K"
    parts = ["<|endoftext|>", "<|startoftext|>", "'s", "'ll", "n't", "aaaaaaaa", "the the", "I'M", "½", "²", "٣"]
    for _ in range(1500):
        text = "".join(
            rng.choice(letters) if rng.random() < 0.8 else rng.choice(parts) for _ in range(rng.randint(0, 25))
        )
        ids, n, decoded = next(iter(mine.rows([text.encode()])))
        expected = theirs.encode(text, add_special_tokens=False).ids
        assert [int(x) for x in ids.split()] == expected and n == len(expected)
        assert decoded.decode() == theirs.decode(expected, skip_special_tokens=False)
    assert 0 < mine.failed < mine.seen  # both ways were taken


# Weighted fingerprints


@pytest.mark.parametrize("name", ["odd", "given"])
def test_fingerprints_of_edited_texts(request, name):
    docs = request.getfixturevalue(name)
    rows = weighted.fingerprint(docs).collect()
    texts = docs.select("doc_id", "text").collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in texts)
    if name == "given":
        order = sorted(texts, key=lambda r: r["doc_id"])
        by_id = {r["doc_id"]: r for r in rows}
        near, true = [], []
        for i, r in enumerate(order):
            after = order[(i + 1) % len(order)]
            half = len(r["text"]) // 2
            edited = r["text"][: len(r["text"]) - half] + after["text"][:half]
            got = by_id[r["doc_id"]]
            assert got["n_chars"] == len(r["text"])
            assert got["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            a, b = Counter(r["text"].lower().split()), Counter(edited.lower().split())
            near.append(got["near_edited"])
            true.append(sum((a & b).values()) / sum((a | b).values()))
            follow = by_id[after["doc_id"]]["fingerprint"]
            same = sum(got["fingerprint"][k : k + 8] == follow[k : k + 8] for k in range(0, 128, 8))
            assert got["near_next"] == pytest.approx(same / 16)
        assert abs(sum(near) - sum(true)) / len(near) < 0.03
        errors = [abs(x - y) for x, y in zip(near, true)]
        assert sum(errors) / len(errors) < 0.12
    of = {}
    for r, t in zip(sorted(rows, key=lambda r: str(r["doc_id"])), sorted(texts, key=lambda r: str(r["doc_id"]))):
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        of.setdefault(t["text"] or "", r["fingerprint"])
        assert of[t["text"] or ""] == r["fingerprint"]


def test_empty_tables(empty):
    assert mixing.mix(empty).count() == 0 and mixing.repeated(empty).count() == 0
    assert language.identify(empty).count() == 0
    assert sharding.shard(empty).count() == 0
    assert simhash.components(empty).count() == 0 and simhash.deduplicated(empty).count() == 0
    assert bpe.digests(empty).count() == 0
    assert weighted.fingerprint(empty).count() == 0
