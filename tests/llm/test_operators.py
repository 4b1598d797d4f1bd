"""Each operator on odd rows and an empty table, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import bpe, chunks, common, language_id, line_dedup, merkle, neighbours, packing, rolling, sharding, simhash, substring_dedup, suffix_dedup

from .conftest import WORDS, odd_rows, text_of

ROWS = [(r[0], r[1] or "") for r in odd_rows()]
SMALLEST = -(1 << 63)


def order(doc):
    return SMALLEST if doc is None else doc


def collected(df):
    return [r.asDict() for r in df.collect()]


def by_row(rows, *columns):
    return Counter(tuple(r[c] for c in columns) for r in rows)


# 1 ------------------------------------------------------------------------


def test_packing(spark, odd, nothing, tmp_path):
    from tokenizers import Tokenizer

    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    got = collected(packing.pack(odd, capacity=256))
    want = Counter()
    for doc, text in ROWS:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        first = len(ids) % 256 or 256
        starts = [0, *range(first, len(ids), 256)]
        for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[doc, k, s, e - s, zlib.crc32(np.asarray(ids[s:e], "<u4").tobytes())] += 1
    assert by_row(got, "doc_id", "piece", "start", "length", "ids_crc32") == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r["length"] for r in got)
    assert len(sequences) <= -(-total // 256) * 1.1 + 1
    assert packing.pack(nothing).collect() == []


def test_packing_tree_moves_whole_bins(spark):
    docs = spark.createDataFrame([(i, text_of(i, 5 + i % 60)) for i in range(300)], "doc_id long, text string").repartition(40)
    got = collected(packing.pack(docs, capacity=512, fan_in=3))
    fills = Counter()
    for r in got:
        fills[r["sequence_id"]] += r["length"]
    assert max(fills.values()) <= 512 and len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    assert len(fills) <= -(-sum(fills.values()) // 512) * 1.1 + 1


def test_packing_seals_nothing_that_could_still_be_merged(spark):
    """Ninety bins just over half full in eight partitions, and one small one in a ninth: it finds a place, and none is lost."""
    docs = spark.createDataFrame([(i, "a " * (130 + i % 3)) for i in range(90)], "doc_id long, text string").repartition(8)
    small = spark.createDataFrame([(100, "a " * 40)], "doc_id long, text string").coalesce(1)
    got = collected(packing.pack(docs.union(small), capacity=256, fan_in=2))
    fills = Counter()
    for r in got:
        fills[r["sequence_id"]] += r["length"]
    assert len(fills) == 90 and max(fills.values()) <= 256 and len(got) == 91


def test_merge_keeps_of_each_fill_as_many_as_there_are_groups():
    import pyarrow as pa

    sizes = [130] * 50 + [140] * 50
    batch = pa.RecordBatch.from_arrays([pa.array(range(100), pa.int64()), pa.array(sizes, pa.int64())], names=["bin", "fill"])
    (out,) = packing._merge(256, 248, 3)(iter([batch]))
    assert Counter(out.column("fill").to_pylist()) == {130: 3, 140: 3, 256: 94}
    assert out.column("bin").to_pylist() == out.column("parent").to_pylist()


def test_packing_production_size_meets_the_lower_bound(spark):
    """2,048 places, slack 8: at most 1 % and one sequence more than the tokens need."""
    docs = spark.createDataFrame([(i, text_of(i, 5 + i * 37 % 160)) for i in range(600)] + [(999, "<|endoftext|> x <|endoftext|>\n <|endoftext|>")], "doc_id long, text string").repartition(6)
    got = collected(packing.pack(docs))
    total = sum(r["length"] for r in got)
    assert len({r["sequence_id"] for r in got}) <= -(-total // 2048) * 1.01 + 1


SPECIAL = ["<|endoftext|> x", "a<|endoftext|>", "\n <|endoftext|> \n", "<|endoftext|><|endoftext|>", "x  <|endoftext|>"]


@given(st.lists(st.one_of(st.sampled_from(SPECIAL), st.text(alphabet=" \n\t\x1c\x85\xa0 aZé漢'slt01._<|>", max_size=30)), max_size=8))
@settings(max_examples=100, deadline=None)
def test_packing_ids_are_the_tokenizers(texts):
    import pyarrow as pa
    from tokenizers import Tokenizer

    import public_tokenizers

    plain = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    ids, ends = packing._memo(public_tokenizers.path(packing.TOKENIZER)).ids(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, ends[:-1])][: len(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@given(st.lists(st.integers(1, 64), max_size=80))
@settings(max_examples=60, deadline=None)
def test_best_fit(sizes):
    bins, offsets, fills = packing.best_fit(np.array(sizes, np.int64), 64)
    assert sum(fills) == sum(sizes) and all(f <= 64 for f in fills)
    for b in range(len(fills)):
        at = 0
        for o, i in sorted((offsets[i], i) for i in range(len(sizes)) if bins[i] == b):
            assert o == at
            at += sizes[i]
    assert sum(2 * f <= 64 for f in fills) <= 1


# 2 ------------------------------------------------------------------------


def test_language(spark, odd, nothing):
    syllables = {"aa": "ba da ga ma na", "bb": "eko eto elo epo emo", "cc": "shuri churi muri turi"}
    rows = [(i, " ".join(random.Random(i).choice(syllables[lang].split()) + random.Random(i + 1).choice("xyz") for _ in range(30)), lang) for i in range(150) for lang in [random.Random(i * 7).choice(list(syllables))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(language_id.training_rows(docs), sample=60)
    assert model.languages == ["aa", "bb", "cc"] and 0.02 < model.temperature < 50
    own = docs.select("doc_id", language_id.held_out().alias("held_out"), "text", "lang")
    got = collected(language_id.predict(own, model))
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    found = collected(language_id.predict(odd, model))
    assert len(found) == len(ROWS) and {"piece", "lang_pred", "score"} <= set(found[0])
    for r in found:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    empty = language_id.train(language_id.training_rows(nothing))
    assert language_id.predict(nothing, empty).collect() == []
    assert empty.predict("some text") == ("und", 0.0)


def test_features_do_not_depend_on_the_part_size(monkeypatch):
    text = text_of(9, 400).replace("\n", " .\t") + " É d3e" * 20
    whole = language_id.features(text)
    assert language_id.features(None)[0].size == 0 == language_id.features(" 12 ")[0].size
    letters = sum(c.isalpha() for c in text)
    assert letters < whole[1].sum() < 6 * letters
    monkeypatch.setattr(language_id, "_PART", 50)
    assert len(text) > 20 * 50
    cut = language_id.features(text)
    # Only what stands over a cut is counted twice: some grams for each of the parts.
    apart = np.zeros(language_id.BUCKETS)
    apart[whole[0]] -= whole[1]
    apart[cut[0]] += cut[1]
    assert apart.min() >= -1 and np.abs(apart).sum() <= 12 * (len(text) // 50 + 1)


def test_repeated_rows_null_ids_and_long_texts_are_learned_or_not(spark):
    rows = [(i, f"{'ba da ' * 9}{i}", "aa") for i in range(40)] + [(i, "eko eto elo", "bb") for i in range(40, 80)] + [(3, "ba da", "aa")] * 30 + [(None, "shuri churi", "cc")] * 5
    rows += [(100, "eko " * 60_000, "bb"), (101, None, "dd"), (102, "", "ee")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(language_id.training_rows(docs))
    assert model.languages == ["aa", "bb"]  # a null id, a null text and a text without letters are not learned from
    assert model.predict("da da ba")[0] == "aa" and model.predict("elo eko")[0] == "bb" and model.predict("eko " * 9000)[0] == "bb"


def test_one_language_scores_one(spark):
    docs = spark.createDataFrame([(i, f"some text {i}", "en") for i in range(20)], "doc_id long, text string, lang string")
    model = language_id.train(language_id.training_rows(docs))
    assert model.predict("anything") == ("en", 1.0) and model.predict("12") == ("und", 0.0)


def plain_features(text):
    """Counts of hashed 1- to 3-grams, letter by letter."""
    squeezed = re.sub(r" +", " ", "".join(c if c.isalpha() else " " for c in " " + text.lower() + " "))
    mix = lambda x, k: x * int(language_id._MIX[k]) % 2**32
    out = Counter()
    for i, c in enumerate(squeezed):
        one = mix(ord(c), 0)
        out[one >> 16] += 1
        if i + 1 < len(squeezed):
            two = mix(one ^ ord(squeezed[i + 1]) + 1, 1)
            out[two >> 16] += 1
            if i + 2 < len(squeezed):
                out[mix(two ^ ord(squeezed[i + 2]) + 2, 2) >> 16] += 1
    return out


def plain_ftrl(rows, n_classes, epochs, alpha, beta, l1, l2):
    """FTRL-proximal by coordinates, in dicts; the bias has the place -1 and no l1."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i, c):
        bound = l1 if i >= 0 else 0.0
        if abs(z[i, c]) <= bound:
            return 0.0
        return -(z[i, c] - (bound if z[i, c] > 0 else -bound)) / ((beta + n[i, c] ** 0.5) / alpha + l2)

    for _ in range(epochs):
        for x, y in rows:
            x = {**x, -1: 1.0}
            w = {(i, c): weight(i, c) for i in x for c in range(n_classes)}
            score = [sum(v * w[i, c] for i, v in x.items()) for c in range(n_classes)]
            e = [np.exp(s - max(score)) for s in score]
            for c in range(n_classes):
                error = e[c] / sum(e) - (c == y)
                for i, v in x.items():
                    g = v * error
                    more = n[i, c] + g * g
                    z[i, c] += g - (more**0.5 - n[i, c] ** 0.5) / alpha * w[i, c]
                    n[i, c] = more
    return weight, set(i for i, _ in z)


def test_language_against_a_plain_model(spark):
    """TF-IDF, FTRL and predictions on a small table, made again without any of the module's functions."""
    words = {"aa": "ba da ga ma", "bb": "eko eto elo É", "cc": "shuri churi"}
    rows = [(i, " ".join(random.Random(i).choice(words[lang].split()) for _ in range(6)), lang) for i in range(40) for lang in ["aa", "bb", "cc"][i % 3 :][:1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(language_id.training_rows(docs), epochs=3, l1=0.02)
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    counts = {d: plain_features(t) for d, t, _ in learned}
    df = Counter(i for c in counts.values() for i in c)
    idf = lambda i: np.log((1 + len(learned)) / (1 + df[i])) + 1

    def weighed(c):
        raw = {i: (1 + np.log(n)) * idf(i) for i, n in c.items()}
        length = sum(v * v for v in raw.values()) ** 0.5
        return {i: v / length for i, v in raw.items()}

    # The order in which the rows come is a hash's; everything else follows from them.
    keyed = docs.select("doc_id", F.xxhash64(F.lit(5), F.xxhash64("doc_id"), F.xxhash64("text")).alias("at"), "lang").where(F.col("doc_id").isin(*counts))
    by = sorted(keyed.collect(), key=lambda r: (r["at"], r["lang"]))
    examples = [(weighed(counts[r["doc_id"]]), "abc".index(r["lang"][0])) for r in by]
    weight, touched = plain_ftrl([x for k, x in enumerate(examples) if k % 5], 3, 3, 0.5, 1.0, 0.02, language_id.L2)
    assert np.allclose([[weight(i, c) for c in range(3)] for i in sorted(touched - {-1})], model.weights[sorted(touched - {-1})], atol=1e-9)
    assert np.allclose([weight(-1, c) for c in range(3)], model.bias, atol=1e-9)
    for d, t, _ in rows:
        x = weighed(plain_features(t))
        z = [(sum(v * weight(i, c) for i, v in x.items()) + weight(-1, c)) / model.temperature for c in range(3)]
        p = np.exp(z) / np.exp(z).sum()
        got = model.predict(t)
        assert got[0] == ["aa", "bb", "cc"][int(p.argmax())] and abs(got[1] - p.max()) < 1e-9


def test_weights_are_sparse_and_the_temperature_is_inside(spark):
    rng = random.Random(1)
    made = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    words = {lang: [made(letters, rng.randint(2, 6)) for _ in range(60)] for lang, letters in (("aa", "abcdefgh"), ("bb", "efghijkl"), ("cc", "aeiouxyz"))}
    # Each text has words that tell nothing, and one label of twenty is another.
    rows = [(i, " ".join(rng.choices(words[lang], k=30) + [made("abcdefghijklmnopqrstuvwxyz", 7) for _ in range(10)]), lang if rng.random() < 0.95 else "aa") for i in range(500) for lang in [rng.choice(list(words))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(language_id.training_rows(docs))
    seen = np.unique(np.concatenate([language_id.features(t)[0] for _, t, _ in rows]))
    assert (model.weights[seen] == 0).mean() > 0.5
    assert 2 * language_id._COLDEST < model.temperature < language_id._HOTTEST / 2
    assert abs(language_id.fit_temperature(np.array([[9.0, -9.0], [-9.0, 9.0]] * 100), np.array([0, 1] * 100)) - 1) < 10


def test_sample_features_may_stay_in_the_folder(spark, monkeypatch):
    docs = spark.createDataFrame([(i, ["ba da", "eko eto"][i % 2] + f" {i}", "ab"[i % 2]) for i in range(60)], "doc_id long, text string, lang string")
    held = language_id.train(language_id.training_rows(docs))
    monkeypatch.setattr(language_id, "_HELD", 0)
    read = language_id.train(language_id.training_rows(docs))
    assert np.array_equal(held.weights, read.weights) and held.temperature == read.temperature


# 3 ------------------------------------------------------------------------


def test_fingerprints(spark, odd, nothing):
    assert by_row(collected(merkle.compare_with_edits(odd)), *merkle._NAMES) == plain_next(spark, odd)
    assert merkle.compare_with_edits(nothing).collect() == []
    alone = spark.createDataFrame([(3, "a b c d")], "doc_id long, text string")
    assert merkle.compare_with_edits(alone).first()["near_next"] == 1.0


def plain_next(spark, docs):
    """Every row with the next in the order of doc_id (nulls first) and row hash, the last with the first."""
    rows = [(r["doc_id"], r["text"] or "", r[common.ROW_KEY]) for r in common.keyed(docs).collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    out = Counter()
    for (d, old, _), (_, new, _) in zip(rows, rows[1:] + rows[:1]):
        half = len(old) // 2
        edited = old[: len(old) - half] + new[:half]
        prints = [merkle.fingerprint(t) for t in (old, edited, new)]
        out[d, len(old), hashlib.sha256(edited.encode()).hexdigest(), prints[0], prints[1], merkle.likeness(*prints[:2]), merkle.likeness(prints[0], prints[2])] += 1
    return out


def test_fingerprints_of_hot_ids(spark):
    """Many rows without id or with one id, some of them alike, over many partitions."""
    rows = [(None, text_of(i % 50, 20)) for i in range(200)] + [(7, text_of(i, 30)) for i in range(150)] + [(7, "same")] * 90 + [(i, text_of(i, 10)) for i in range(100, 140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert by_row(collected(merkle.compare_with_edits(docs)), *merkle._NAMES) == plain_next(spark, docs)


@given(st.text(alphabet="ab \n", max_size=200), st.text(alphabet="ab \n", max_size=200))
@settings(max_examples=100, deadline=None)
def test_trees(a, b):
    x, y = merkle.tree(a), merkle.tree(b)
    assert x.digest.hex() == merkle.fingerprint(a)[:32]
    assert (x.digest == y.digest) == (a == b) == (merkle.locate_edits(x, y) == [])
    assert merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(b)) == merkle.likeness(merkle.fingerprint(b), merkle.fingerprint(a))


def test_edits_are_located():
    text = text_of(1, 900)
    at = text.index(" ", 3000) + 1
    changed = text[:at] + "EDIT " + text[at:]
    for start, stop, _, _ in merkle.locate_edits(merkle.tree(text), merkle.tree(changed)):
        assert start <= at + 1 and stop >= at - 1 and stop - start < 400
    assert 0.9 < merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(changed)) < 1


# 4 ------------------------------------------------------------------------


def plain_fingerprint(text, n=3):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), seed=42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(nodes, near):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def test_simhash(spark, odd, nothing):
    got = collected(simhash.near_duplicates(odd))
    prints = {(d, t): plain_fingerprint(t) for d, t in ROWS}
    assert by_row(got, "doc_id", "print") == Counter((d, p - (1 << 64) if p >> 63 else p) for (d, t) in ROWS for p in [prints[d, t]])
    of = {d: p for (d, _), p in prints.items() if d is not None}
    want = plain_components(list(of), lambda a, b: (of[a] ^ of[b]).bit_count() <= 3)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert simhash.near_duplicates(nothing).collect() == []
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted({v for v in want.values()})


@pytest.mark.parametrize("cell", [7, 20_000])
def test_links_of_clusters(spark, cell):
    """Dense clusters and chance prints; small cells exercise the blocks."""
    draw = random.Random(5)
    prints = set()
    for _ in range(4):
        centre = draw.getrandbits(64)
        for _ in range(40):
            flips = sum(1 << draw.randrange(64) for _ in range(draw.randint(0, 4)))
            prints.add((centre ^ flips) & (1 << 64) - 1)
    prints |= {draw.getrandbits(64) for _ in range(60)}
    rows = [(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(sorted(prints))]
    of = {i: p for i, p in enumerate(sorted(prints))}
    edges = simhash.link(spark.createDataFrame(rows, "print long, node long"), len(rows), cell=cell)
    pairs = edges.collect()
    assert all((of[a] ^ of[b]).bit_count() <= 3 for a, b in pairs)
    got = {i: i for i in of} | {r["a"]: r["b"] for r in simhash.components(edges).collect()}
    assert got == plain_components(list(of), lambda a, b: (of[a] ^ of[b]).bit_count() <= 3)


def test_every_close_pair_shares_a_cell():
    draw = random.Random(1)
    for bands in (5, 6, 7, 8, 9, 10):
        masks = simhash._masks(bands, 3)
        for _ in range(200):
            a = draw.getrandbits(64)
            b = a
            for k in draw.sample(range(64), 3):
                b ^= 1 << k
            count = lambda x: ((x & x >> 1 & 0x5555555555555555) << 1) | ((x ^ x >> 1) & 0x5555555555555555)
            assert any(count(a) & m == count(b) & m for m in masks)


@given(st.lists(st.integers(0, 2**64 - 1), min_size=2, max_size=2))
@settings(max_examples=100, deadline=None)
def test_manhattan_distance_is_a_lower_bound(pair):
    a, b = pair
    counts = simhash.embedded(np.array(pair, np.uint64))
    plain = [[(x >> 2 * s & 1) + (x >> 2 * s + 1 & 1) for s in range(32)] for x in pair]
    manhattan = sum(abs(x - y) for x, y in zip(*plain))
    assert np.bitwise_count(counts[0] ^ counts[1]) == manhattan <= (a ^ b).bit_count()


def test_one_doc_id_is_in_one_component(spark):
    a, b = text_of(1, 60), text_of(2, 60)
    rows = [(5, a), (5, b), (3, b), (9, a), (None, a), (None, text_of(3, 60)), (7, text_of(4, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == Counter([(5, 3), (5, 3), (3, 3), (9, 3), (None, 3), (None, None), (7, 7)])


@pytest.mark.parametrize("hot", [2, 1000])
def test_joins_of_hot_keys(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    monkeypatch.setattr(common, "FEW", 0)
    rows = spark.range(500).selectExpr("id", "if(id % 3 = 0, 7L, id % 40) key", "if(id = 10, null, 1L) other")
    told = rows.groupBy(F.col("key").alias("_w_k0"), F.col("other").alias("_w_k1")).agg(F.count("*").alias("_w_n"), F.max("id").alias("most")).where("_w_n > 1 and _w_k1 is not null")
    got = {r["id"]: r["most"] for r in common.left_join_spread(rows, told, [F.col("key"), F.col("other")], 500, ["most"]).collect()}
    keys = {i: 7 if i % 3 == 0 else i % 40 for i in range(500)}
    held = {i: k for i, k in keys.items() if i != 10}
    assert got == {i: None if i == 10 or sum(x == keys[i] for x in held.values()) < 2 else max(j for j, x in held.items() if x == keys[i]) for i in range(500)}


def test_hot_joins_inside_the_operators(spark, odd, monkeypatch):
    """As if every key with more than two rows were hot."""
    from weftline.llm import repeats

    monkeypatch.setattr(common, "FEW", 0)
    monkeypatch.setattr(common, "HOT", 2)
    text = text_of(5, 40)
    rows = [(i, text) for i in range(20)] + [(i, text_of(i, 20)) for i in range(20, 30)] + [(3, text_of(20, 20)), (None, text), (40, ""), (41, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc"] for r in repeats.copies(repeats.with_identity(docs)).collect()}
    assert got == {*range(20), 20}  # the null id is the smallest
    found = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert {c for d, c in found if d is not None and d < 21} == {0} and (41, 40) in found and (None, 0) in found
    path = simhash.components(spark.createDataFrame([(i + 1, i) for i in range(30)] + [(100 + i, 50) for i in range(40)], "a long, b long"))
    assert {r["a"]: r["b"] for r in path.collect()} == {**{i: 0 for i in range(1, 31)}, **{100 + i: 50 for i in range(40)}}
    test_suffix_dedup(spark, odd, spark.createDataFrame([], odd.schema), 30, 8, 2)


def test_components_of_paths(spark):
    chain = [(i + 1, i) for i in range(40)] + [(100, 60), (100, 61), (101, 61), (7, 3)]
    got = {r["a"]: r["b"] for r in simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 61: 60, 100: 60, 101: 60}


# 5 ------------------------------------------------------------------------


def some_vectors(n=900, size=24, seed=3):
    draw = np.random.default_rng(seed)
    vectors = draw.standard_normal((n, size)).astype(np.float32)
    vectors[10:200] = vectors[10] + 0.01 * draw.standard_normal((190, size))
    vectors[300] = vectors[301]
    return vectors


ODD_VECTORS = [(2000, None, "x"), (2050, [0.0] * 24, "x"), (2100, [float("nan")] + [1.0] * 23, "x"), (2150, [None] + [1.0] * 23, "x"), (None, [1.0] * 24, "x"), (2200, [float("inf")] + [1.0] * 23, "x"), (2250, [1.0, 2.0], "x")]


def plain_nearest(rows, queries, k=5):
    """rows: (id, vector) -> query id -> (rank, id, score), by double precision."""
    out = {}
    for q in queries:
        found = {}
        for own, x in [(i, v) for i, v in rows if i == q]:
            for i, v in rows:
                if i != q and len(v) == len(x):
                    score = float((v * x).sum() / (np.sqrt((v * v).sum()) * np.sqrt((x * x).sum())))
                    found[i] = max(found.get(i, -9), score)
        out[q] = sorted(found.items(), key=lambda r: (-r[1], r[0]))[:k]
    return out


@pytest.mark.parametrize("options,least", [({}, 0.9), ({"verified": None, "reach": None}, 1.0)])
@pytest.mark.parametrize("block", [None, 64])
def test_neighbours(spark, options, least, block):
    vectors = some_vectors()
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)] + ODD_VECTORS + [(400, vectors[400].tolist(), "x")] * 3 + [(450, vectors[7].tolist(), "x"), (2300, [2.0, 1.0], "y"), (2301, [1.0, 2.0], "y")]
    held = neighbours.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string"))
    got = defaultdict(list)
    for r in collected(neighbours.nearest(held, held.where(F.col("vec_id") % 50 == 0), block=block, **options)):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    plain = [(i, np.asarray(v, np.float64)) for i, v, _ in rows if i is not None and i not in (2000, 2050, 2100, 2150, 2200)]
    want = plain_nearest(plain, [*range(0, 900, 50), 2250, 2300])
    assert {q: len(x) for q, x in got.items()} == {q: len(x) for q, x in want.items()}
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, len(found) + 1))
        scores = dict(plain_nearest(plain, [q], 10_000)[q])
        assert np.allclose([f[2] for f in found], [scores[f[1]] for f in found], atol=1e-12, rtol=0)
        assert all((a[2], -a[1]) >= (b[2], -b[1]) for a, b in zip(found, found[1:]))
        hit += len({i for i, _ in want[q]} & {f[1] for f in found})
    assert hit >= least * sum(map(len, want.values()))


def test_few_neighbours_and_none(spark):
    held = neighbours.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(some_vectors()[:3])], "vec_id long, embedding array<float>"))
    assert sorted((r["query_id"], r["vec_id"]) for r in neighbours.nearest(held, held.where("vec_id = 0")).collect()) == [(0, 1), (0, 2)]
    none = held.where("false")
    assert neighbours.nearest(none, none).collect() == []
    assert neighbours.nearest(held, none).collect() == []


def test_queries_stay_away_from_far_cells():
    """Forty tight clusters: most of the blocks are never asked, and nothing is lost by that."""
    draw = np.random.default_rng(1)
    centres = draw.standard_normal((40, 32))
    vectors = (centres[:, None] + 0.05 * draw.standard_normal((40, 200, 32))).reshape(-1, 32)
    size, splits = 32, 6
    projected = (vectors / np.linalg.norm(vectors, axis=1)[:, None]) @ neighbours.directions(size)[:, :splits]
    cells = neighbours.Cells({size: np.median(projected, axis=0)}, {}, 200, 8)
    own, n = np.unique(cells.cell(cells.project(vectors), size), return_counts=True)
    cells = neighbours.Cells(cells.cuts, {(size, int(c)): int(k) for c, k in zip(own, n)}, 200, 8)
    queries = vectors[::100]
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    scores = (queries / np.linalg.norm(queries, axis=1)[:, None]) @ unit.T
    kth = np.sort(scores, axis=1)[:, -6]
    opened = cells.open(queries, kth, None)
    assert np.mean([len(v) for v in opened]) < 0.3 * cells.blocks
    salt = neighbours._salt(np.arange(len(vectors)))
    home = cells.home(vectors, salt)
    for q in range(len(queries)):
        near = np.flatnonzero(scores[q] > kth[q])
        assert set(home[near].tolist()) <= set(opened[q].tolist())
    loads = np.bincount(cells.task[home], minlength=cells.tasks)
    assert loads.max() < 2 * loads.mean()


@given(st.lists(st.lists(st.booleans(), min_size=70, max_size=70), min_size=1, max_size=40), st.integers(1, 41))
@settings(max_examples=60, deadline=None)
def test_bit_counters(rows, needed):
    bits = np.array(rows)
    packed = np.zeros((len(rows), 2), np.uint64)
    packed.view(np.uint8).reshape(len(rows), -1)[:, :9] = np.packbits(bits, axis=1, bitorder="little")
    got = neighbours.at_least(iter(packed), needed)
    assert np.unpackbits(got.view(np.uint8), count=70, bitorder="little").astype(bool).tolist() == (bits.sum(0) >= needed).tolist()


# 6 ------------------------------------------------------------------------


def reference_codec():
    import tiktoken

    import public_tokenizers

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.vocabulary_path()), special_tokens={})


def test_bpe_documents(spark, odd, nothing):
    plain = reference_codec()
    encoded = bpe.encode_documents(odd)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in encoded.collect()) == Counter((d, tuple(plain.encode_ordinary(t))) for d, t in ROWS)
    assert Counter((r["doc_id"], bytes(r["decoded"])) for r in bpe.decode_documents(encoded).collect()) == Counter((d, t.encode()) for d, t in ROWS)
    assert bpe.encode_documents(nothing).collect() == []


@given(st.lists(st.text(alphabet=" \n\t\r\x0b\x1c\x85\xa0 aZé漢🙂'slt019._<|>", max_size=40), max_size=8))
@settings(max_examples=150, deadline=None)
def test_bpe_is_exact(texts):
    plain, codec = reference_codec(), bpe.codec(bpe.vocabulary_path())
    assert [x.tolist() for x in codec.encode(texts)] == [plain.encode_ordinary(t) for t in texts]
    assert [codec.decode(x.tolist()).decode() for x in codec.encode(texts)] == texts
    assert ["".join(chunks.chunks(t)) for t in texts] == texts


def test_long_texts_are_encoded_in_parts(monkeypatch):
    import pyarrow as pa

    plain, codec = reference_codec(), bpe.codec(bpe.vocabulary_path())
    texts = [text_of(5, 900), text_of(6, 500).replace(" ", " \n "), "x" * 9000, text_of(7, 40), ""]
    monkeypatch.setattr(chunks, "_PART", 300)
    assert len(chunks.parts(texts[0])) > 5 and "".join(chunks.parts(texts[0])) == texts[0]
    assert [x.tolist() for x in codec.encode_column(pa.array(texts))] == [plain.encode_ordinary(t) for t in texts]


def test_chunk_memory_is_bounded():
    import pyarrow as pa

    memo = chunks.ChunkMemo(lambda texts: [np.array([len(t)], "<u4").tobytes() for t in texts], limit=10)
    for i in range(100):
        ids, ends = memo.ids(pa.array([f"a{i} b{i} " + "x" * 200, None, f"a{i}  b{i}"]))
        assert ends.tolist() == [3, 3, 5] and ids.tolist()[:3] == [len(f"a{i}"), len(f" b{i}"), 201]
        assert len(memo.any) + len(memo.after_space) < 80


# 7 ------------------------------------------------------------------------


def plain_lines(rows, min_docs):
    space, key = " \t\n\x0b\x0c\r", lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(space))
    space  # noqa: B018
    seen = defaultdict(set)
    for d, t in rows:
        for x in t.split("\n"):
            seen[key(x)].add((d, t))
    gone = {k for k, v in seen.items() if k and len(v) >= min_docs}
    return {(d, t): [key(x) not in gone for x in t.split("\n")] for d, t in rows}


@pytest.mark.parametrize("min_docs", [2, 10])
def test_line_dedup(spark, odd, nothing, min_docs):
    want = plain_lines(ROWS, min_docs)
    got = collected(line_dedup.drop_lines(odd, min_docs=min_docs))
    assert Counter((r["doc_id"], r["text"] or "") for r in got) == Counter((d, "\n".join(x for x, k in zip(t.split("\n"), want[d, t]) if k)) for d, t in ROWS)
    assert set(got[0]) == set(odd.columns)
    maps = collected(line_dedup.keep_bitmaps(odd, min_docs=min_docs))
    assert sum(r["n_dropped"] for r in maps) == sum(k.count(False) for k in want.values())
    assert line_dedup.drop_lines(nothing).collect() == []


def test_first_lines_stay(spark):
    rows = [(i, f"common\nown {i}\ncommon") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(docs, min_docs=1, keep_first=True).collect()}
    assert got == {0: "common\nown 0", **{i: f"own {i}" for i in range(1, 30)}}


# 8 ------------------------------------------------------------------------


def test_sharding(spark, odd, nothing):
    got = collected(sharding.hilbert_shards(odd, shards=5))
    assert by_row(got, "doc_id", "size", "text_crc32") == Counter((d, len(t.encode()) + 8, zlib.crc32(t.encode())) for d, t in ROWS)
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(5)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    ordered = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    curve = [r["curve"] for r in ordered]
    assert curve == sorted(curve)
    crcs = [c for k, c in enumerate(r["text_crc32"] for r in ordered) if not k or c != ordered[k - 1]["text_crc32"]]
    assert len(crcs) == len(set(crcs))
    assert sharding.hilbert_shards(nothing).collect() == []


@pytest.mark.parametrize("axes,bits", [(2, 3), (3, 2)])
def test_hilbert_curve_steps_by_one(spark, axes, bits):
    names = [f"d{i}" for i in range(axes)]
    cells = spark.range(1 << bits * axes).select(*[F.shiftright("id", bits * i).bitwiseAND(F.lit((1 << bits) - 1)).alias(n) for i, n in enumerate(names)])
    rows = sorted(sharding.hilbert_index(cells, names, bits, "at").collect(), key=lambda r: r["at"])
    assert [r["at"] for r in rows] == list(range(len(rows)))
    for a, b in zip(rows, rows[1:]):
        assert sum(abs(a[n] - b[n]) for n in names) == 1


def test_shards_prune(spark):
    docs = spark.range(4000).selectExpr("id doc_id", "'x' text", "concat('l', id % 4) lang", "concat('s', id % 16) source", "id % 1000 n_chars")
    got = sharding.hilbert_shards(docs, shards=16).join(docs, "doc_id").groupBy("shard").agg(F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"), F.countDistinct("lang").alias("langs"), F.countDistinct("source").alias("sources")).collect()
    assert np.mean([r["hi"] - r["lo"] for r in got]) < 700 and np.mean([r["sources"] for r in got]) < 10


def test_cuts_are_exact_over_all_rows(spark):
    docs = spark.range(12_400).selectExpr("id doc_id", "concat('text ', id) text", "sha2(cast(id as string), 256) source")
    cells = sharding.hilbert_shards(docs, shards=4, dimensions=("source",)).groupBy("curve").count().collect()
    assert len(cells) == 31 and {r["count"] for r in cells} == {400}


def test_shards_prune_on_strings_with_one_prefix(spark):
    docs = spark.range(2000).selectExpr("id doc_id", "'x' text", "concat('https://host/commoncrawl-', id % 16) source")
    got = sharding.hilbert_shards(docs, shards=16).join(docs, "doc_id").groupBy("shard").agg(F.countDistinct("source").alias("sources")).collect()
    assert np.mean([r["sources"] for r in got]) < 3


SHARD_ROWS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("hot", [10_000, 5])
def test_equal_texts_are_neighbours_whatever_their_metadata(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    monkeypatch.setattr(common, "FEW", 0)
    rows = [(i, f"text {i % 40}", [None, "en", "de"][i % 3], f"s{i % 7}", i % 11) for i in range(400)] + [(None, "text 1", None, None, None), (500, None, "en", "s", 1), (501, "", "de", "t", 2)]
    got = collected(sharding.hilbert_shards(spark.createDataFrame(rows, SHARD_ROWS), shards=6))
    assert len(got) == len(rows)
    ordered = [r["text_crc32"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    runs = [c for k, c in enumerate(ordered) if not k or c != ordered[k - 1]]
    assert len(runs) == len(set(runs)) == 41
    split = sum(1 for c in set(ordered) if len({r["shard"] for r in got if r["text_crc32"] == c}) > 1)
    assert split <= 5  # a group is cut only where a shard ends


def test_null_metadata_is_a_cell_below_all_others(spark):
    rows = [(i, f"t{i}", None if i % 4 == 0 else "en", "one", i) for i in range(64)]
    got = collected(sharding.hilbert_shards(spark.createDataFrame(rows, SHARD_ROWS), shards=4, dimensions=("lang", "source")))
    of_null = {r["curve"] for r in got if r["doc_id"] % 4 == 0}
    assert len(of_null) == 1 and of_null.isdisjoint({r["curve"] for r in got if r["doc_id"] % 4})
    assert {r["shard"] for r in got if r["doc_id"] % 4 == 0} in ({0}, {3})


# 9 ------------------------------------------------------------------------


def plain_windows(rows, window):
    first = {}
    for d, t in rows:
        w = t.encode().split()
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            first[key] = min(first.get(key, order(d)), order(d))
    out = Counter()
    for d, t in rows:
        w = t.encode().split()
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < order(d):
                gone |= set(range(p, p + window))
        out[d, len(w), len(gone), tuple(x for i, x in enumerate(w) if i not in gone)] += 1
    return out


@pytest.mark.parametrize("window,core", [(50, 16), (12, 4)])
def test_substring_dedup(spark, odd, nothing, window, core):
    want = plain_windows(ROWS, window)
    got = Counter()
    found = substring_dedup._lost(odd, window, core).select("doc_id", "text", "starts", "is_copy")
    for r in found.mapInArrow(substring_dedup._digest(window), "doc_id long, n_words long, n_removed long, kept_sha256 string").collect():
        got[r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]] += 1
    assert got == Counter({(d, n, g, hashlib.sha256(b" ".join(k)).hexdigest()): c for (d, n, g, k), c in want.items()})
    spans = collected(substring_dedup.removal_intervals(odd, window, core))
    assert Counter((r["doc_id"], sum(s["stop"] - s["start"] for s in r["removed"])) for r in spans) == Counter(k for d, _, g, _ in want.elements() for k in [(d, g)])
    assert substring_dedup.removal_intervals(nothing).collect() == []


# 10 -----------------------------------------------------------------------


def plain_suffixes(rows, length):
    """Rows with equal doc_id and text are one row."""
    first, out = {}, {}
    for d, t in sorted({(order(d), t.encode()) for d, t in rows}):
        for p in range(len(t) - length + 1):
            key = t[p : p + length]
            first[key] = min(first.get(key, (d, p)), (d, p))
    for d, t in rows:
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            if first[raw[p : p + length]] < (order(d), p):
                gone[p : p + length] = True
        out[d, t] = gone
    return out


@pytest.mark.parametrize("length,core,crowd", [(100, 32, 100_000), (30, 8, 1), (30, 8, 2)])
def test_suffix_dedup(spark, odd, nothing, length, core, crowd):
    want = plain_suffixes(ROWS, length)
    found = suffix_dedup._lost(odd, length, core, crowd).select("doc_id", "text", "starts", "stops", "is_copy")
    got = Counter(tuple(r) for r in found.mapInArrow(suffix_dedup._digest(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").collect())
    expected = Counter()
    for d, t in ROWS:
        raw, gone = np.frombuffer(t.encode(), np.uint8), want[d, t]
        expected[d, len(raw), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(raw[~gone].tobytes()).hexdigest()] += 1
    assert got == expected
    kept = suffix_dedup.drop_repeats(odd, length, core)
    assert kept.columns == odd.columns and kept.count() == len(ROWS)
    assert suffix_dedup.drop_repeats(nothing).collect() == []


@given(st.lists(st.lists(st.binary(max_size=5), max_size=8), max_size=6))
@settings(max_examples=150, deadline=None)
def test_loser_tree(runs):
    runs = [sorted(r) for r in runs]
    tree = suffix_dedup.LoserTree([(r, [0, *map(suffix_dedup.common_prefix, r, r[1:])][: len(r)]) for r in runs])
    at, out, shared = [0] * len(runs), [], []
    while (taken := tree.take()) is not None:
        run, same = taken
        out.append(runs[run][at[run]])
        at[run] += 1
        shared.append(same)
    assert out == sorted(x for r in runs for x in r)
    assert shared[1:] == [suffix_dedup.common_prefix(a, b) for a, b in zip(out, out[1:])]


@given(st.text(alphabet="aé漢", max_size=30), st.integers(0, 60), st.integers(0, 60))
@settings(max_examples=100, deadline=None)
def test_cuts_keep_characters(text, a, b):
    raw = text.encode()
    a, b = sorted((min(a, len(raw)), min(b, len(raw))))
    cut = suffix_dedup.cut_out(raw, suffix_dedup.whole_characters(raw, [(a, b)] if a < b else []))
    assert cut.decode() in text or set(cut.decode()) <= set(text)
    assert len(cut) >= len(raw) - (b - a)


def test_windows_and_minima():
    draw = np.random.default_rng(0)
    data = bytes(draw.integers(97, 99, 300, dtype=np.uint8))
    hashes = rolling.windows(rolling.byte_symbols(data), 9)
    assert len(set(hashes.tolist())) == len({data[i : i + 9] for i in range(292)})
    x = draw.integers(0, 1000, 57).astype(np.uint64)
    for w in (1, 2, 3, 7, 19, 57, 58):
        assert rolling.sliding_min(x, w).tolist() == [min(x[i : i + w]) for i in range(len(x) - w + 1)]
    texts = [b"", b" ", b"a bb", b"bb\ta", b"x" * 50] + [" ".join(WORDS).encode()]
    got = rolling.word_hashes(texts)
    assert [len(g) for g in got] == [len(t.split()) for t in texts] and got[2][0] == got[3][1] and got[2][1] == got[3][0]


def test_long_texts_are_cut_at_white_space(monkeypatch):
    text = text_of(8, 3000).encode()
    whole = rolling.word_hashes([text])[0]
    monkeypatch.setattr(rolling, "AT_ONCE", 1000)
    assert np.array_equal(rolling.word_hashes([text])[0], whole)
