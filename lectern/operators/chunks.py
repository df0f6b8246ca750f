"""Sentences, chunks of bounded size, and which chunks are worth keeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.folds import everything, folded, gathered
from lectern.functions.scalars import bound, stripped, text_of
from lectern.operators.lines import blocks_of

WORDS = 120
# Abbreviations whose dot ends no sentence.
ABBREVIATIONS = ("Dr.", "Mr.", "Mrs.", "Prof.", "vs.", "e.g.", "i.e.", "etc.")
MARK = "␞"


def sentences(text: Column) -> Column:
    """The sentences of a text: cut at white space behind . ! or ?, but not behind an abbreviation."""
    out = text_of(text)
    for a in ABBREVIATIONS:
        out = F.replace(out, F.lit(a), F.lit(a.replace(".", MARK)))
    return F.transform(F.split(out, r"(?<=[.!?])\s+"), lambda s: F.replace(s, F.lit(MARK), F.lit(".")))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def packed(parts: Column, words: int = WORDS, glue: str = " ") -> Column:
    """Array of struct (text, n): parts joined while they have at most ``words`` words; a larger part stands alone.

    A fold over one row's array, so nothing is shuffled. The texts come from the parts' positions, so that
    each is built once.
    """
    def add(state: Column, n: Column) -> Column:
        fits = (state["filled"] + n <= words) | (state["count"] == 0)
        at = state["at"] + 1
        return F.struct(
            F.when(fits, state["held"]).otherwise(gathered(state["held"], state["at"])).alias("held"),
            at.alias("at"),
            F.when(fits, state["filled"] + n).otherwise(n).alias("filled"),
            F.when(fits, state["count"] + 1).otherwise(1).alias("count"),
        )

    start = {name: F.lit(0) for name in ("at", "filled", "count")}
    ends_of = lambda own: bound(F.transform(own, word_count), lambda ns: folded(ns, "int", start, add, lambda s: F.array_append(everything(s["held"]), s["at"])))

    def cut(own: Column, ends: Column) -> Column:
        spans = F.arrays_zip(F.slice(F.concat(F.array(F.lit(0)), ends), F.lit(1), F.size(ends)).alias("a"), ends.alias("b"))
        return F.transform(spans, lambda s: F.struct(F.array_join(F.slice(own, s["a"] + 1, s["b"] - s["a"]), glue).alias("text"), (s["b"] - s["a"]).alias("n")))

    return bound(parts, lambda own: bound(ends_of(own), lambda ends: cut(own, ends)))


def chunk_paragraphs(rows: DataFrame, keys: list[str], text: str = "text", words: int = WORDS) -> DataFrame:
    """Each text as chunks of whole sentences: chunk_index, text, sentence_count."""
    own = rows.withColumn("sentences__", sentences(F.col(text)))
    chunks = own.select(*keys, F.posexplode(packed(F.col("sentences__"), words)).alias("chunk_index", "chunk"))
    return chunks.select(*keys, F.col("chunk_index").cast("int"), F.col("chunk.text").alias("text"), F.col("chunk.n").cast("int").alias("sentence_count"))


STRATEGY = {"heading": "heading_with_context", "list_item": "list_items_grouped", "table": "table_intact", "table_row": "table_rows_grouped"}


def chunk_blocks(blocks: DataFrame, words: int = WORDS) -> DataFrame:
    """Chunks of documents' blocks: doc_id, block_index (of the first block), chunk_index, chunking_strategy, blocks_combined, text.

    A heading takes the paragraphs behind it while they fit, list items and table rows their neighbours of the same
    kind; tables stay whole; paragraphs are packed by sentences. ``blocks`` has doc_id, block_index, element_type, text.
    """
    size = word_count(F.col("text"))
    rows = blocks.select("doc_id", F.struct("block_index", "element_type", "text", size.alias("words")).alias("b"))
    return _chunked(rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("b")).alias("bs")), words)


def chunk_documents(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``chunk_blocks`` of the blocks of whole texts (doc_id, text), made and folded where the row is: no shuffle."""
    sized = F.transform(blocks_of(F.split(text_of(F.col("text")), "\n")), lambda b: F.struct(b["block"].alias("block_index"), b["element_type"].alias("element_type"), b["text"].alias("text"), word_count(b["text"]).alias("words")))
    return _chunked(docs.select("doc_id", sized.alias("bs")), words)


def _chunked(docs: DataFrame, words: int) -> DataFrame:
    """Chunks of ``docs`` (doc_id, bs: the blocks in order)."""

    def add(state: Column, b: Column) -> Column:
        kind, last = b["element_type"], state["kind"]
        joins = ((last == "heading") & (kind == "paragraph")) | ((last == kind) & kind.isin("list_item", "table_row"))
        fits = joins & (state["words"] + b["words"] <= words)
        return F.struct(
            F.when(fits, state["held"]).otherwise(gathered(state["held"], state["at"])).alias("held"),
            F.when(fits, last).otherwise(kind).alias("kind"),
            # a heading over the size takes nothing with it
            F.when(fits, state["words"] + b["words"]).otherwise(b["words"]).alias("words"),
            (state["at"] + 1).alias("at"),
        )

    start = {"kind": F.lit(""), "words": F.lit(0), "at": F.lit(0)}
    starts_of = lambda bs: folded(bs, "int", start, add, lambda s: F.array_append(everything(s["held"]), s["at"]))
    # each group takes its own slice along, not the document's whole array
    slices = lambda bs, starts: F.transform(F.sequence(F.lit(1), F.size(starts) - 1), lambda i: F.slice(bs, F.element_at(starts, i) + 1, F.element_at(starts, i + 1) - F.element_at(starts, i)))
    own = lambda bs: F.when(F.size(bs) > 0, bound(starts_of(bs), lambda starts: slices(bs, starts)))
    groups = docs.select("doc_id", F.explode(bound(F.col("bs"), own)).alias("own"))
    head = F.element_at("own", 1)
    joined = F.array_join(F.transform("own", lambda b: b["text"]), "\n")
    plain = F.array(F.struct(joined.alias("text"), F.size("own").alias("n")))
    kind = head["element_type"]
    strategy = F.when((kind == "heading") & (head["words"] > words), "heading_standalone").otherwise(F.create_map(*[F.lit(x) for p in STRATEGY.items() for x in p])[kind])
    known = kind.isin(*STRATEGY)
    made = F.when(known, plain).otherwise(packed(sentences(head["text"]), words))
    out = groups.select("doc_id", head["block_index"].alias("block_index"), F.coalesce(strategy, F.lit("sentence_boundary")).alias("chunking_strategy"), F.size("own").alias("blocks_combined"), F.posexplode(made).alias("chunk_index", "c"))
    return out.select("doc_id", "block_index", F.col("chunk_index").cast("int"), "chunking_strategy", F.col("blocks_combined").cast("int"), F.col("c.text").alias("text"))


def reject_reason(text: Column, least_words: int = 5, least_share: float = 0.6) -> Column:
    """Why a chunk isn't worth embedding: the first of seven rules that it breaks; null if none."""
    def judged(t: Column, words: Column) -> Column:
        letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
        n = F.size(words)
        capitals = (n >= 3) & (F.upper(t) == t) & (F.lower(t) != t) & F.rlike(F.replace(t, F.lit(" "), F.lit("")), F.lit(r"^\p{L}+$"))
        return (
            F.when(n < least_words, "too_short")
            .when(letters / F.greatest(F.length(t), F.lit(1)) < least_share, "few_letters")
            .when(F.rlike(t, F.lit("https?://|www\\.|@[a-zA-Z0-9]")), "address")
            .when(F.regexp_count(t, F.lit(r"(?i)\b[0-9a-f]{8,}\b")) > 2, "hex")
            .when(F.regexp_count(t, F.lit(r"[^\p{L}\p{M}\p{N}_\s]{3,}")) > 3, "symbols")
            .when(capitals, "capitals")
            .when(F.forall(words, lambda w: F.rlike(F.regexp_replace(w, "[.,]", ""), F.lit(r"^\p{Nd}+$"))), "numbers")
        )

    words = lambda t: F.filter(F.split(t, r"(?U)\s+"), lambda w: w != "")
    return bound(stripped(text), lambda t: bound(words(t), lambda ws: judged(t, ws)))


def valid_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.where(reject_reason(F.col("text")).isNull())


def as_documents(chunks: DataFrame) -> DataFrame:
    """page_content, and all other columns as metadata (JSON)."""
    others = [c for c in chunks.columns if c != "text"]
    return chunks.select(F.col("text").alias("page_content"), F.to_json(F.struct(*others)).alias("metadata"))


def char_windows(text: Column, size: int = 1500, step: int = 1200) -> Column:
    """Overlapping windows of a text's characters; one at least, empty for an empty text."""
    last = F.greatest(F.lit(0), F.length(text) - size + step - 1)
    return F.transform(F.sequence(F.lit(0), F.floor(last / step).cast("int")), lambda i: F.substr(text, i * step + 1, F.lit(size)))
