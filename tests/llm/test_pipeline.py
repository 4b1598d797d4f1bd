"""The stages: columns, decisions, odd rows, and the whole run against the operators' brute-force versions."""

from collections import Counter

import corpus_pipeline as C
from weftline.llm.common import materialise, release

from .conftest import SCHEMA, odd_rows, text_of
from .test_operators import plain_components, plain_fingerprint, plain_lines, plain_suffixes


def test_stages_keep_columns(spark, odd, nothing):
    for docs in (odd, nothing):
        held = docs
        for name, stage in C.STAGES:
            held = materialise(stage(spark, held, ""), "test-stage")
            if name != "packing":
                assert held.columns == docs.columns, name
        assert {"doc_id", "piece", "sequence_id", "offset"} <= set(held.columns)
    assert [n for n, _ in C.STAGES] == ["language_id", "line_dedup", "simhash", "suffix_dedup", "packing"]


def test_texts_after_the_cleaning_stages(spark):
    base = [(i, text_of(i, 120), "en", "s", 1, "c") for i in range(40)]
    copy = [(60, base[3][1], "en", "s", 1, "c"), (61, base[4][1] + " more", "en", "s", 1, "c")]
    junk = [(70, "12345 !!! 678", "en", "s", 1, "c"), (71, None, "en", "s", 1, "c")]
    lines = [(80 + i, f"The same line here.\n{text_of(200 + i, 60)}", "en", "s", 1, "c") for i in range(12)]
    docs = spark.createDataFrame(base + copy + junk + lines, SCHEMA)
    for _, stage in C.STAGES[:4]:
        docs = materialise(stage(spark, docs, ""), "test-stage")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in docs.collect()}
    rows = [(r[0], r[1]) for r in base + copy + lines]
    kept = plain_lines(rows, 10)
    rows = [(d, "\n".join(x for x, k in zip(t.split("\n"), kept[d, t]) if k)) for d, t in rows]
    prints = {d: plain_fingerprint(t, C.SHINGLE_WORDS) for d, t in rows}
    roots = plain_components(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    rows = [(d, t) for d, t in rows if roots[d] == d]
    gone = plain_suffixes(rows, 100)
    want = {}
    for d, t in rows:
        text = bytes(x for x, g in zip(t.encode(), gone[d, t]) if not g).decode()
        want[d] = (text, len(text))
    assert got == want
    assert not {60, 70, 71} & set(got)


def test_one_of_a_group_of_copies_keeps_its_text(spark):
    copied, near, single = text_of(300, 120), text_of(301, 150), text_of(302, 6)
    rows = [(100 + i, copied.replace("\n", "\n\n\n")) for i in range(14)] + [(200 + i, f"{near}\n{text_of(400 + i, 6)}") for i in range(14)] + [(300 + i, single) for i in range(12)]
    rows += [(500 + i, f"{single}\n{text_of(600 + i, 60)}") for i in range(12)]
    docs = spark.createDataFrame([(d, t, "en", "s", 1, "c") for d, t in rows], SCHEMA).repartition(5)
    held = materialise(C.line_dedup(spark, docs, ""), "test-stage")
    lines = {r["doc_id"]: r["text"] for r in held.collect()}
    of = dict(rows)
    assert lines[100] == of[100] and lines[200] == of[200] and lines[300] == single
    assert not any(lines[i].strip() for i in [*range(101, 114), *range(301, 312)])
    assert lines[201] == text_of(401, 6) and lines[500] == text_of(600, 60)
    for _, stage in C.STAGES[2:4]:
        held = materialise(stage(spark, held, ""), "test-stage")
    got = {r["doc_id"]: r["text"] for r in held.collect()}
    assert got[100] == of[100] and got[200] == of[200] and got[300] == single


def test_texts_stay_when_no_language_can_be_learned(spark):
    rows = [(1, "clean text", None, "s", 1, "c"), (2, "12 !", None, "s", 1, "c"), (3, None, None, "s", 1, "c"), (4, "漢字", None, "s", 1, "c")]
    got = C.language_id(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert got.columns == SCHEMA.names and sorted(r["doc_id"] for r in got.collect()) == [1, 4]


def test_run_over_a_folder(spark, tmp_path):
    rows = odd_rows()
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = C.run(spark, str(tmp_path)).collect()
    per = Counter(r["sequence_id"] for r in got)
    assert got and sum(per.values()) == len(got) and {r["doc_id"] for r in got} <= {r[0] for r in rows}


def test_written_tables_can_be_released(spark):
    held = materialise(spark.range(5).toDF("x"), "test-release")
    assert held.count() == 5
    path = held.inputFiles()[0].removeprefix("file://")
    release(spark)
    assert not __import__("os").path.exists(path)


def test_a_run_leaves_its_result_only(spark, tmp_path):
    from weftline.llm.common import written

    rows = [(i, text_of(i, 60), "en", "s", 1, "c") for i in range(20)] + [(30, text_of(3, 60), "en", "s", 1, "c")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    before = written()
    out = C.run(spark, str(tmp_path))
    assert written() == before + 1
    assert {r["doc_id"] for r in out.collect()} == set(range(20))
