import pytest
from pyspark.sql import types as T

#: As in the documents table, with a column more, whose name an operator also uses.
SCHEMA = T.StructType().add("doc_id", T.LongType()).add("text", T.StringType()).add("lang", T.StringType()).add("source", T.StringType()).add("n_chars", T.LongType()).add("piece", T.StringType())

WORDS = "the and of to in is that for it was on as with be by at this from or an are not have had but you all were when we there can more if no out so said what up its about into than them only some could time these two may then do first any my now such like our over man me even most made after also did many".split()


def text_of(seed: int, n: int, line: int = 12) -> str:
    import random

    draw = random.Random(seed)
    words = [draw.choice(WORDS) + (draw.choice("aeiou") if draw.random() < 0.5 else "") + str(draw.randint(0, 99)) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + line]) for i in range(0, n, line))


def odd_rows():
    """Nulls, empty, blank and long texts, ties, repeated rows, odd white space."""
    long = text_of(1, 6000)
    passage = text_of(2, 80, 90)
    near = text_of(3, 300)
    rows = [
        (0, None, None, None, None), (1, "", "en", "s", 0), (2, " \n\t ", "en", "s", 4), (3, "word", "en", "s", 4),
        (4, long, "en", "s", len(long)), (5, long, "en", None, len(long)), (5, long, "en", None, len(long)),
        (6, near, "en", "s", 1), (7, near.replace("a", "a", 1) + " end", "en", "s", 1), (8, near, "fr", "s", 1),
        (9, text_of(4, 50) + " " + passage + " " + text_of(5, 50), "en", "t", 1), (10, text_of(6, 70) + " " + passage + "\n" + text_of(7, 20), "de", "t", 1),
        (11, passage + " " + passage, "de", "t", 1), (12, "é漢字🙂 " * 60, "xx", "t", 1), (13, "x" * 400, None, "t", 1), (14, "ab " * 300, "en", "t", 1),
        (None, "no id here", "en", "t", 10), (None, passage, "en", "t", 10), (16, "<|endoftext|> a  b\r\n c\u0085d", "en", "t", 10), (17, "1234 5678", "en", "t", 9),
    ] + [(100 + i, f"shared line\n  SHARED Line \nown {i} {text_of(50 + i, 30)}", ["en", "fr"][i % 2], "u", 1) for i in range(12)]
    return [(*r, "clash") for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
