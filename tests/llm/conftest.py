import pytest

#: Documents with every odd case: nulls, empty and blank texts, repeated rows, copies, long texts, and columns with clashing names.
KIND = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, component_id string, salt string, __id string, __null string, __hash string, __score string, __kept string, row string, __own1 string"


def words(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 1
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append("".join("bcdfghklmnprst"[(x >> k) % 14] + "aeiou"[(x >> (k + 3)) % 5] for k in (5, 11, 17)))
    return " ".join(out)


@pytest.fixture(scope="session")
def texts():
    near = words(5, 400)
    return [
        (1, words(1, 80)), (2, words(1, 80).replace(" ", "\n")), (3, words(1, 80) + "  "), (4, None), (5, ""), (6, " \t\n"), (7, "one"),
        (8, near), (9, near + " tail"), (10, near.replace(near.split()[200], "changed", 1)), (11, words(6, 12_000)), (12, words(6, 12_000)), (None, words(7, 60)),
        (13, words(8, 70)), (13, words(8, 70)), (14, "é ß 漢字 " * 30), (15, "spam words here " * 40), (16, "a#b $ % & " * 60), (17, "line\nline\nline\n" + words(9, 60)),
    ]


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", None if i == 7 else f"s{(i or 0) % 3}", None, *"xyzabcdefg") for i, t in texts], KIND)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
