import time

import pytest
from pyspark.sql import functions as F

from lectern.functions import lessons, web


def texts(spark, pages):
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    return [r.t for r in rows.select("i", web.without_markup(F.col("html")).alias("t")).orderBy("i").collect()]


def test_elements_go_with_all_that_is_in_them(spark):
    pages = {
        "<p>a</p><aside>b<aside>c</aside>d</aside>e": "a e",
        "<nav>x<div>y</div></nav><p>z": "z",
        "a<script>if (x<b) { '</p>' } <!-- </script>b": "a b",
        "a<!-- <nav> -->b<!-- x > y --> c": "a b c",
        "a <!-- never closed <p>b</p>": "a",
        "a<footer>to the end <p>b": "a",
        "<STYLE>x</sTyLe>y</nav>z": "y z",
        "1 < 2 and <b>3</b> > 2": "1 < 2 and 3 > 2",
        "<a title='x<y'>t</a><a href=\"b": "t",
        "<navy>kept</navy><header>gone<nav>x</nav></header>": "kept",
        "": "",
        "&lt;p&gt; &amp; caf&eacute;": "<p> & café",
    }
    assert texts(spark, list(pages)) == list(pages.values())


@pytest.mark.parametrize("piece", ["<a '", "<b></i>", "<!-- ", "<aside>", "x < y ", "<p>word</p>"])
def test_broken_pages_take_time_as_their_length(spark, piece):
    took = []
    for n in (2_000, 16_000):
        rows = spark.createDataFrame([(piece * n,)], "html string").select(F.length(web.without_markup(F.col("html"))))
        rows.first()
        began = time.perf_counter()
        rows.first()
        took.append(time.perf_counter() - began)
    assert took[1] < 24 * max(took[0], 0.2)


def test_lesson_plans(spark):
    asked = "Create a lesson plan for grade 8 about | fractions\nfor 35 minutes"
    rows = spark.createDataFrame([(1, " a draft ", asked), (2, None, asked), (3, "as it was", "hello"), (4, None, "hello")], "i int, answer string, message string")
    got = {r.i: r.p for r in rows.select("i", lessons.lesson_plan(F.col("answer"), F.col("message")).alias("p")).collect()}
    assert got[3] == "as it was" and got[4] == ""
    assert got[1].startswith("# ") and "| Grade / Level | Grade 8 |" in got[1] and got[1].endswith("<summary>View the model draft used to create this lesson plan</summary>\na draft\n</details>")
    assert got[2] in got[1] and "## Original Draft" not in got[2] and "| Duration | 35 minutes |" in got[2] and "| Warm-up | 4 min |" in got[2]
