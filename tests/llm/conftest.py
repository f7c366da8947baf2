import pytest

AWKWARD = [
    (1, "Alpha beta gamma delta epsilon zeta\nshared line\nend"),
    (2, "alpha BETA gamma delta epsilon zeta\nShared line\nend"),
    (3, None),
    (4, ""),
    (5, "   \n\t\n"),
    (None, "no id here\nshared line"),
    (6, "éß ünï 東京 🙂\n SHARED LINE \x0b"),
    (6, "éß ünï 東京 🙂\n SHARED LINE \x0b"),
    (7, "12345 !!! ---"),
    (8, "word " * 30_000),
    (9, "x" * 50_000),
    (10, "Éclair éclair"),
    (11, "éclair éclair"),
]

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, id long, content string, hash string, "
    "label string, score double, keep_id int, record int, tokens int, `drop` string, spans int, "
    # names that stages have used for columns of their own
    "mix_epoch string, `__drop` string, `__domain` string, leaf_domain string, drop_id string, first string, "
    "rows string, component string, epochs string, cut string, `__first` string, word string, n string, runs string"
)
CLASHING = 14


def wide(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    data = [
        (i, t, ("en", "fr", None)[k % 3], ("src0", None, "src7", "other")[k % 4], None, 7, "c", "h", "l", 0.5, 1, 2, 3, "d", 4, *["own"] * CLASHING)
        for k, (i, t) in enumerate(rows)
    ]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture
def awkward(spark):
    return wide(spark, AWKWARD).repartition(3)


@pytest.fixture
def nothing(spark):
    return wide(spark, [])
