"""Text functions against small plain models."""

import random

import pytest
from pyspark.sql import functions as F

from wirelens.functions import text

EDGES = set(" ,()=<>+-*/;\t\n")


def model_template(sql):
    """Scan once: literals, then free-standing numbers, then white space."""
    out, i = [], 0
    while i < len(sql):
        if sql[i] == "'":
            i += 1
            while i < len(sql):
                if sql[i] == "'" and sql[i + 1:i + 2] != "'":
                    break
                i += 2 if sql[i] == "'" else 1
            i += 1
            out.append("'?'")
        elif sql[i].isdigit() and (i == 0 or sql[i - 1] in EDGES):
            end = i
            while end < len(sql) and (sql[end].isdigit() or sql[end] == "."):
                end += 1
            free = end == len(sql) or sql[end] in EDGES
            out.append("?" if free else sql[i])
            i = end if free else i + 1
        else:
            out.append(sql[i])
            i += 1
    return " ".join("".join(out).split())


def model_bound(query, args):
    import re

    def put(found):
        at = int(found.group(1))
        if not 1 <= at <= len(args):
            return found.group(0)
        return "NULL" if args[at - 1] == "NULL" else "'" + args[at - 1].replace("'", "''") + "'"

    return re.sub(r"\$(\d+)", put, query)


def test_template_matches_model(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("a1$'. ,(=\n2-x\"") for _ in range(rng.randint(0, 24))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.normalize_sql(F.col("t")).alias("n")).collect()
    assert [(r.t, r.n) for r in rows] == [(r.t, model_template(r.t)) for r in rows]


def test_bind_preview_matches_model(spark):
    rng = random.Random(8)
    cases = [("".join(rng.choice(["$1", "$2", "$10", "$0", "$", "a'", " ", "1"]) for _ in range(rng.randint(0, 8))),
              [rng.choice(["x", "it's", "NULL", "$1", ""]) for _ in range(rng.randint(0, 3))]) for _ in range(1000)]
    rows = spark.createDataFrame(cases, "q string, a array<string>").select("q", "a", text.bind_preview(F.col("q"), F.col("a")).alias("b")).collect()
    assert [r.b for r in rows] == [model_bound(r.q, r.a) for r in rows]


def test_explain_script(spark):
    rows = spark.createDataFrame([("select $2, $1, $2", ["a'b"]), ("select 1", [])], "q string, a array<string>")
    found = [r[0] for r in rows.select(text.explain_script(F.col("q"), F.col("a"), F.lit("n"), True)).collect()]
    assert found == [["PREPARE n AS select $2, $1, $2", "EXPLAIN ANALYZE EXECUTE n ('a''b', NULL)", "DEALLOCATE n"],
                     ["EXPLAIN ANALYZE select 1"]]


@pytest.mark.parametrize("limit, wanted", [(0, "x" * 30), (30, "x" * 30), (20, "xxxxx... [truncated]"), (15, "x" * 15), (4, "xxxx")])
def test_truncate(spark, limit, wanted):
    assert spark.range(1).select(text.truncate_text(F.lit("x" * 30), limit)).head()[0] == wanted


def test_spaces_match_python(spark):
    every = [chr(i) for i in range(1, 0x3100) if not 0xD800 <= i < 0xE000]
    rows = spark.createDataFrame([(c,) for c in every], "c string").select(
        "c", (text.strip(F.col("c")) == "").alias("s"), (text.one_line(F.concat(F.lit("a"), F.col("c"), F.lit("b"))) == "a b").alias("l")).collect()
    assert [r.c for r in rows if r.s] == [c for c in every if c.isspace()]
    assert [r.c for r in rows if r.l] == [c for c in every if c.isspace() or ord(c) < 32 or ord(c) == 127]


def test_half_up_and_units(spark):
    shown = spark.createDataFrame([(0.5,), (12.25,), (1500.0,)], "v double").select(text.format_ms(F.col("v"))).collect()
    assert [r[0] for r in shown] == ["500us", "12.3ms", "1.50s"]
