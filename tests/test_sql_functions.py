import difflib

from pyspark.sql import functions as F

from lectern.functions import scalars as S
from lectern.operators import chunks as C
from lectern.operators import lines as N
from lectern.sources.sql_functions import registered

TEXTS = [None, "", "   ", "x" * 140, "x" * 141, " a  b\n\tc ", "Dr. Who came. It's e.g. here! Yes?  No", "- item", "12) item", "a.b", "\\ 'quoted' [x]", "word " * 60]
MAILS = [None, "", "plain", " A@Education.Example ", "a.education@x@y", "u@students.example", "@education.", "x@y@education.z"]


def test_scalars_equal_the_column_functions(spark):
    own = registered(spark)
    rows = own.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    pairs = {
        "stripped(t)": S.stripped, "collapsed(t)": S.collapsed, "snippet(t)": S.snippet, "sentences_of(coalesce(t, ''))": C.sentences, "is_list_item(t)": N.is_list_item, "normal_email(t)": S.normal_email,
    }
    for statement, function in pairs.items():
        by_sql = {r.i: r.v for r in own.sql(f"SELECT i, {statement} AS v FROM {{rows}}", rows=rows).collect()}
        assert by_sql == {r.i: r.v for r in rows.select("i", function(F.col("t")).alias("v")).collect()}, statement
    mails = own.createDataFrame(list(enumerate(MAILS)), "i int, t string")
    by_sql = {r.i: r.v for r in own.sql("SELECT i, role_instruction(access_role(t)) AS v FROM {mails}", mails=mails).collect()}
    assert by_sql == {r.i: r.v for r in mails.select("i", S.role_instruction(S.access_role(F.col("t"))).alias("v")).collect()}


def test_sql_functions_are_unfolded(spark):
    rows = spark.createDataFrame([("x",)], "t string")
    plan = registered(spark).sql("SELECT snippet(t) FROM {rows}", rows=rows)._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_the_ratio(spark):
    a, b = "what is lectern", "what can lectern do"
    assert registered(spark).sql(f"SELECT sequence_ratio('{a}', '{b}') AS r").first().r == difflib.SequenceMatcher(None, a, b).ratio()


def test_table_functions_over_partitions(spark):
    rows = [(k, i, "word " * n) for k in range(5) for i, n in enumerate([50, 60, 30, 200, 1, 119, 0, 1][: 2 + k + (k == 4) * 2])]
    parts = registered(spark).createDataFrame(rows, "key long, at int, part string").repartition(4)
    got = {}
    for r in spark.sql("SELECT * FROM packed_chunks(TABLE(SELECT * FROM {parts}) PARTITION BY key ORDER BY at)", parts=parts).collect():
        got.setdefault(r.key, []).append((r.chunk_index, r.text, r.sentence_count))
    want = parts.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]).alias("ps")).select("key", F.posexplode(C.packed(F.col("ps"))).alias("i", "c"))
    by = {}
    for r in want.orderBy("key", "i").collect():
        by.setdefault(r.key, []).append((r.i, r.c.text, r.c.n))
    assert {k: sorted(v) for k, v in got.items()} == by
    assert spark.sql("SELECT * FROM packed_chunks(TABLE(SELECT * FROM {parts} WHERE key > 9) PARTITION BY key ORDER BY at)", parts=parts).count() == 0


def test_table_functions_take_batches_and_go_on_over_them(spark):
    """Rows come in batches, not one by one, and a key of several batches is cut as one."""
    from lectern.sources import sql_functions

    registered(spark)
    parts = [(1, i, " ".join(["w"] * (i % 40))) for i in range(25_000)] + [(2, 0, "alone"), (3, 0, "x " * 500)]
    rows = spark.createDataFrame(parts, "key long, at int, part string")
    got = spark.sql("SELECT * FROM packed_chunks(TABLE({rows}) PARTITION BY key ORDER BY at)", rows=rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPythonUDTF" in plan
    want, held, words = [], [], 0
    for part in (p for k, _, p in parts if k == 1):
        n = len(part.split())
        if held and words + n > sql_functions.WORDS:
            want.append(" ".join(held))
            held, words = [], 0
        held.append(part)
        words += n
    want.append(" ".join(held))
    out = sorted(map(tuple, got.collect()))
    assert [r[2] for r in out if r[0] == 1] == want and [r[1] for r in out if r[0] == 1] == list(range(len(want)))
    assert [r[1:] for r in out if r[0] != 1] == [(0, "alone", 1), (0, "x " * 500, 1)]
