"""Near copies of the pipeline's SimHash stage, against all pairs by Jaccard."""

import random
import re

import corpus_pipeline as C
import pytest
from weftline.llm import near_copies

from .conftest import SCHEMA, text_of
from .test_operators import plain_components


def plain_set(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def plain_alike(a, b):
    return a == b or bool(a | b) and len(a & b) >= 0.8 * len(a | b)


def edited(text, changes, draw):
    words = text.split(" ")
    for _ in range(changes):
        words[draw.randrange(len(words))] = f"edit{draw.randrange(10**6)}"
    return " ".join(words)


def near_rows():
    draw = random.Random(11)
    rows = [(None, 0), ("", 0), ("one two", 0), ("ONE  two", 0)]
    for k in range(12):
        base = text_of(900 + k, [6, 20, 60, 200][k % 4])
        rows += [(edited(base, draw.randint(0, 8), draw), k) for _ in range(8)]
    base = text_of(990, 150)
    rows += [(edited(base, draw.randint(1, 3), draw), 99) for _ in range(40)]
    draw.shuffle(rows)
    return [(i, t, "en", "s", 1, "c") for i, (t, _) in enumerate(rows)]


@pytest.mark.parametrize("cell", [4, 16])
def test_near_copies_equal_all_pairs(spark, cell):
    rows = near_rows()
    sets = {r[0]: plain_set(r[1]) for r in rows}
    roots = plain_components(list(sets), lambda a, b: plain_alike(sets[a], sets[b]))
    got = near_copies.keep_one_alike(spark.createDataFrame(rows, SCHEMA).repartition(3), 5, cell).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(set(roots.values()))


def test_stage_links_at_jaccard_not_at_three_bits(spark):
    from weftline.llm.simhash import fingerprint

    base = text_of(7, 200)
    words = base.split(" ")
    for at in (40, 120):
        words[at] = "changed"
    near = " ".join(words)
    assert plain_alike(plain_set(base), plain_set(near)) and (fingerprint(base, 5) ^ fingerprint(near, 5)).bit_count() > 3
    docs = spark.createDataFrame([(1, base, "en", "s", 1, "c"), (2, near, "en", "s", 1, "c")], SCHEMA)
    assert [r["doc_id"] for r in C.simhash(spark, docs, "").collect()] == [1]


def test_rows_are_nodes_by_id_and_text(spark):
    one, two, three = (text_of(s, 80) for s in (801, 802, 803))
    rows = [(7, one, "en", "s", 1, "c"), (7, two, "en", "s", 1, "c"), (7, two, "en", "s", 1, "c"), (9, one, "en", "s", 1, "c"), (None, three, "en", "s", 1, "c"), (None, three, "en", "s", 1, "c"), (None, two, "en", "s", 1, "c")]
    for parts in (1, 4):
        got = C.simhash(spark, spark.createDataFrame(rows, SCHEMA).repartition(parts), "").collect()
        assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted([("7", one), ("7", two), ("None", three)])


def test_simhash_links_come_first(spark, monkeypatch):
    from weftline.llm.simhash import fingerprint

    base = text_of(21, 2000)
    words = base.split(" ")
    words[700] = "changed"
    near, other = " ".join(words), text_of(22, 300)
    assert 0 < (fingerprint(base, 5) ^ fingerprint(near, 5)).bit_count() <= 3
    assert near_copies.print_of(near_copies.hashes(near, 5)) == fingerprint(near, 5) and near_copies.print_of(near_copies.hashes(" ", 5)) == fingerprint(" ", 5)
    # Without the prefix filter's pairs, SimHash has found the near copy.
    monkeypatch.setattr(near_copies, "_shared", lambda batches: (b.slice(0, 0) for b in batches))
    rows = [(i, t, "en", "s", 1, "c") for i, t in enumerate([other, base, near])]
    assert sorted(r["doc_id"] for r in C.simhash(spark, spark.createDataFrame(rows, SCHEMA), "").collect()) == [0, 1]


def test_long_texts_with_one_passage_are_no_candidates(spark, monkeypatch):
    passage = text_of(31, 120, 200)
    rows = [(i, f"{passage}\n{text_of(500 + i, 4000)}", "en", "s", 1, "c") for i in range(24)]
    asked = []
    decided = near_copies._decided
    monkeypatch.setattr(near_copies, "_decided", lambda r, n, pairs, w: asked.append(pairs.count()) or decided(r, n, pairs, w))
    got = C.simhash(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert len(got) == 24 and sum(asked) == 0


def test_pairs_of_a_group_grow_with_its_members(spark, monkeypatch):
    draw = random.Random(5)
    base = text_of(41, 400)
    asked = []
    decided = near_copies._decided
    monkeypatch.setattr(near_copies, "_decided", lambda r, n, pairs, w: asked.append(pairs.count()) or decided(r, n, pairs, w))
    rows = [(i, edited(base, 3, draw), "en", "s", 1, "c") for i in range(120)]
    got = C.simhash(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert [r["doc_id"] for r in got] == [0] and sum(asked) < 10 * 120
