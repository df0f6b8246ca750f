"""Web pages and addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .folds import everything, folded, gathered, using
from .scalars import bound, collapsed, html_escaped, stripped, text_of

PAGE = 8000
DROPPED = ("script", "style", "noscript", "header", "footer", "nav", "aside")
#: Results in a card list at most.
CARDS = 5


def unescaped(text: Column) -> Column:
    """Character references, named and numeric, decoded once, by the text library that Spark ships."""
    decoded = F.java_method(F.lit("org.apache.commons.text.StringEscapeUtils"), F.lit("unescapeHtml4"), text)
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


#: Elements whose content is no markup.
RAW = ("script", "style")


def _texts(html: Column) -> Column:
    """The page's texts outside of markup, comments and the elements ``DROPPED``, those inside of such included, in one pass over the pieces between its ``<``."""

    def add(s: Column, p: Column) -> Column:
        name = F.lower(F.regexp_extract(p, "^/?([A-Za-z][A-Za-z0-9]*)", 1))
        return using(s, F.struct(name.alias("name"), F.startswith(p, F.lit("/")).alias("closing")), lambda s, x: step(s, p, x["name"], x["closing"]))

    def step(s: Column, p: Column, name: Column, closing: Column) -> Column:
        fresh, raw, inside = s["mode"] == "text", s["open"].isin(*RAW), s["open"] != ""
        comment = (s["mode"] == "comment") | (fresh & ~raw & F.startswith(p, F.lit("!--")))
        opens, same = fresh & ~inside & ~closing & name.isin(*DROPPED), fresh & inside & (name == s["open"])
        depth = F.when(opens, 1).when(same & closing, s["depth"] - 1).when(same & ~raw, s["depth"] + 1).otherwise(s["depth"])
        sign = fresh & ~inside & (name == "") & ~closing & ~F.rlike(p, F.lit("^[!?]"))  # no tag, but what it says
        mark = F.when(comment, F.instr(p, "-->") + 2).otherwise(F.instr(p, ">"))
        ended = F.when(comment, mark > 2).otherwise(mark > 0)
        mode = F.when(sign | ended | (raw & ~same), "text").when(comment, "comment").otherwise("tag")
        text = F.when(sign, F.concat(F.lit("<"), p)).when(ended & (depth == 0), F.substr(p, mark + 1)).otherwise("")
        found = F.struct(text.alias("text"), mode.alias("mode"), depth.cast("int").alias("depth"), F.when(opens, name).otherwise(s["open"]).alias("open"))
        return using(s, found, lambda s, x: F.struct(
            F.when(x["text"] == "", s["held"]).otherwise(gathered(s["held"], x["text"])).alias("held"),
            x["mode"].alias("mode"),
            F.when(x["depth"] == 0, "").otherwise(x["open"]).alias("open"),
            x["depth"].alias("depth"),
        ))

    def texts(pieces: Column) -> Column:
        start = {"mode": F.lit("text"), "open": F.lit(""), "depth": F.lit(0)}
        return F.concat(F.slice(pieces, 1, 1), folded(F.slice(pieces, F.lit(2), F.size(pieces)), "string", start, add, lambda s: everything(s["held"])))

    return bound(F.split(html, "<"), texts)


def without_markup(html: Column) -> Column:
    """The page's text on one line, without the elements that hold none; an element that isn't closed reaches to the page's end."""
    return collapsed(unescaped(F.array_join(_texts(text_of(html)), " ")))


def html_text(html: Column, limit: int = PAGE) -> Column:
    return F.substring(without_markup(html), 1, limit)


def html_title(html: Column) -> Column:
    out = F.regexp_extract(text_of(html), r"(?is)<title[^>]*>(.*?)</title>", 1)
    return stripped(unescaped(out))


def page_envelope(html: Column) -> Column:
    """Title and text under their names; what to say where there is no text."""
    text = html_text(html)
    return F.when(text == "", "__ERROR__ The page had no readable text content.").otherwise(F.concat(F.lit("PAGE TITLE: "), html_title(html), F.lit("\n\nPAGE CONTENT:\n"), text))


def with_scheme(url: Column) -> Column:
    return F.when(F.rlike(text_of(url), F.lit("(?i)^https?://")), url).otherwise(F.concat(F.lit("https://"), text_of(url)))


def url_domain(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("//")), F.split_part(url, F.lit("/"), F.lit(3))).otherwise(url)


def result_card(title: Column, body: Column, url: Column) -> Column:
    """A search result's parts, escaped for a page: title, domain, snippet, address."""
    url = stripped(url)
    named = F.when(text_of(title) == "", "Untitled result").otherwise(stripped(title))
    domain = F.when(F.contains(url, F.lit("//")), F.split_part(url, F.lit("/"), F.lit(3))).otherwise("")
    return F.struct(html_escaped(named).alias("title"), html_escaped(domain).alias("domain"), html_escaped(stripped(body)).alias("snippet"), html_escaped(url).alias("url"))


def result_cards(results: DataFrame, limit: int = CARDS) -> DataFrame:
    """query_id, rank and the card of the first ``limit`` results of each query; ``results`` has query_id, ord, title, body, url."""
    ranked = results.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("ord"))).where(F.col("rank") <= limit)
    return ranked.select("query_id", "rank", result_card(F.col("title"), F.col("body"), F.col("url")).alias("card")).select("query_id", "rank", "card.*")


def web_contexts(sources: DataFrame) -> DataFrame:
    """query_id and context: what sources with a body say, in order, under their titles, and the address of the first that has one.

    ``sources`` has query_id, ord (the most reliable source first), title, body, url.
    """
    own = sources.where(stripped(F.col("body")) != "").select("query_id", F.struct("ord", F.concat(stripped(F.col("title")), F.lit(": "), stripped(F.col("body"))).alias("part"), stripped(F.col("url")).alias("url")).alias("s"))
    sorted_ = own.groupBy("query_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    first = F.filter("s", lambda x: x["url"] != "")
    address = F.when(F.size(first) > 0, F.concat(F.lit("\n\nMost relevant source URL: "), F.try_element_at(first, F.lit(1))["url"])).otherwise("")
    return sorted_.select("query_id", F.concat(F.array_join(F.transform("s", lambda x: x["part"]), "\n\n"), address).alias("context"))
