import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (doc_id, text[, source]) rows; extra columns clash with names that operators use inside."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", 7) for r in rows]
        frame = spark.createDataFrame(full, SCHEMA)
        return frame.selectExpr("*", "1 as unit", "'x' as bucket", "2 as row", "3 as `size`", "4 as fp", "5 as kept", "6 as copies", "7 as `a b`")

    return make


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empty and blank texts, ties, repeated rows, other scripts, one long text."""
    long = " ".join(f"w{i % 700}" for i in range(30_000))
    passage = " ".join(f"shared{i}" for i in range(60))
    return [
        (1, None, None), (2, "", "a"), (3, " \t\n ", "a"), (4, passage, "b"), (5, f"before {passage} after", "b"), (5, f"before {passage} after", "b"),
        (None, f"no id {passage}", "c"), (None, None, None), (6, "é ü 漢字   x#y *** a\nb\na\nb", "c"), (7, long, "b"), (8, long + " end", "a"), (9, "one", "a"),
    ]


@pytest.fixture
def small_units(monkeypatch):
    """Units of a few hundred bytes, so that even small tables have many."""
    from wirelens.llm import units

    plan = units.layout
    monkeypatch.setattr(units, "layout", lambda documents, **kind: plan(documents, **(kind | {"unit_bytes": 400, "bucket_bytes": 300})))
