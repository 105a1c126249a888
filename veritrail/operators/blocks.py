"""Blocks of pages and documents: visible blocks from HTML, the legal body, the eleven segment types, sections between markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.functions.forms import collapse, key_form, unescape
from veritrail.functions.text import uppercase_ratio

#: Elements that end a block, and those whose text is not shown.
BLOCK_TAGS = "address|article|aside|blockquote|br|caption|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|tbody|tfoot|thead|title|tr|ul"
HIDDEN_TAGS = ("script", "style", "noscript", "svg", "template")
#: How legal documents begin, are structured and end, in key form.
REGULATORY = r"^[“\"']?ARTICULO\s+[0-9]+(\.[0-9]+){2,}\b"
ARTICLE = r"^[“\"']?ARTICULO\s+\S+"
PARAGRAPH = r"^[“\"']?PARAGRAFO\b"
NUMERAL = r"^[0-9]+(\.[0-9]+)*\.\s+"
STRUCTURE = ("CONSIDERANDO:", "CONSIDERANDO", "DECRETA:", "DECRETA")
FOOTERS = ("COMPILACION JURIDICA DIAN",)
ANNOTATION = "CONSULTAR LA VIGENCIA DE ESTA NORMA DIRECTAMENTE EN LOS ARTICULOS QUE MODIFICA Y/O ADICIONA"
#: The family of court decisions, how those begin, and what a whole one has.
COURT_FAMILY, COURT_HEADING, COURT_CHARS, COURT_SIGNALS = "corte_constitucional_sentencia_c", r"^SENTENCIA\s+C-[0-9]{1,4}/[0-9]{2,4}\b", 500, 2
ACT_HEADING = r"^(DECRETO|RESOLUCION|CONCEPTO|OFICIO|LEY|SENTENCIA|CIRCULAR)\s+(NUMERO\s+)?[A-Z0-9._/-]+\s+DE\s+[0-9]{4}\b"
HEADING = f"{ACT_HEADING}|{COURT_HEADING}"


def visible(pages: DataFrame) -> DataFrame:
    """(page_id, seq, text): a page's visible blocks in order, a table row as one with `` | `` between its cells, a block that repeats the one before it left out."""
    html = F.col("html")
    for tag in HIDDEN_TAGS:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    html = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    html = F.regexp_replace(html, r"[\r\n\t]+", " ")
    html = F.regexp_replace(html, r"(?i)</t[dh]\s*>\s*<t[dh]\b[^>]*>", " | ")
    html = F.regexp_replace(html, rf"(?i)</?({BLOCK_TAGS})\b[^>]*>", "\n")
    plain = F.regexp_replace(html, r"<[^>]*>", "")
    lines = F.filter(F.transform(F.split(plain, "\n"), lambda x: collapse(unescape(x))), lambda x: x != "")
    listed = pages.select("page_id", lines.alias("l"))
    kept = F.filter("l", lambda x, i: (i == 0) | (F.get(F.col("l"), i - 1) != x))
    return listed.select("page_id", F.posexplode(kept).alias("seq", "text"))


def segment_type(text: Column, kind: Column, key: Column | None = None) -> Column:
    """Type of a block, by the first of eleven rules that holds.

    ``key`` is the text's key form, if it is a column already: most rules read it, and an expression would be found by each of them.
    """
    key = key_form(text) if key is None else key
    return (
        F.when(kind == "table_row", "table_row")
        .when(key.rlike(HEADING), "document_heading")
        .when(key.rlike(REGULATORY), "regulatory_article")
        .when(key.rlike(ARTICLE), "article")
        .when(key.rlike(PARAGRAPH), "paragraph")
        .when(text.rlike(NUMERAL), "numeral")
        .when(key.isin(*STRUCTURE), "structural_heading")
        .when(key.startswith("PUBLIQUESE"), "closing")
        .when((F.length(text) <= 240) & (uppercase_ratio(text) >= 0.9), "section_heading")
        .when(key.startswith("QUE "), "consideration")
        .otherwise("text")
    )


def portal_note(key: Column) -> Column:
    """Whether a block, in key form, is a note that the portal adds to a document."""
    return F.btrim(key, F.lit("<> ")).startswith(ANNOTATION)


def legal_body(blocks: DataFrame, least: int = 5, family: str | None = None) -> DataFrame:
    """(doc, state, first, last, blocks) of blocks (doc, seq, text): from the first heading in capitals, else the first one, to the first footer behind it, without portal notes.

    ``family`` names a column with the source's family.  A court decision has
    headings of its own and is whole with enough characters and two of its
    sections (background, reasons, decision); any other act needs ``least`` blocks.
    """
    court = F.coalesce(F.col(family) == COURT_FAMILY, F.lit(False)) if family else F.lit(False)
    b = blocks.withColumn("key", key_form(F.col("text"))).withColumn("court", court)
    heads = F.when(F.col("court"), F.col("key").rlike(COURT_HEADING)).otherwise(F.col("key").rlike(ACT_HEADING))
    start = b.where(heads).groupBy("doc").agg(F.min(F.struct((uppercase_ratio(F.col("text")) < 0.8).alias("low"), "seq"))["seq"].alias("first"))
    from_start = b.join(start, "doc", "left")
    stop = F.min(F.when(F.col("key").isin(*FOOTERS) & (F.col("seq") > F.col("first")), F.col("seq"))).over(Window.partitionBy("doc"))
    inside = (F.col("seq") >= F.col("first")) & (F.col("stop").isNull() | (F.col("seq") < F.col("stop"))) & ~portal_note(F.col("key"))
    signals = (F.col("key").contains("ANTECEDENTES"), F.col("key").contains("CONSIDERACIONES"), F.col("key").contains("DECISION") | F.regexp_replace("key", "[^A-Z]", "").startswith("RESUELVE"))
    seen = sum((F.max((inside & s).cast("int")) for s in signals), F.lit(0))
    sums = from_start.withColumn("stop", stop).groupBy("doc").agg(F.bool_or("court").alias("court"), F.min("first").alias("first"), F.max(F.when(inside, F.col("seq"))).alias("last"), F.count(F.when(inside, F.lit(1))).alias("blocks"), F.coalesce(F.sum(F.when(inside, F.length("text"))), F.lit(0)).alias("chars"), seen.alias("signals"))
    short = F.when(F.col("court"), (F.col("chars") < COURT_CHARS) | (F.col("signals") < COURT_SIGNALS)).otherwise(F.col("blocks") < least)
    state = F.when(F.col("first").isNull(), "no_heading").when(short, "too_short").otherwise("body")
    return sums.select("doc", state.alias("state"), "first", F.col("last"), "blocks")


def section_between(blocks: DataFrame, starts: Column, ends: Column, question: Column, least_blocks: int, least_questions: int) -> DataFrame:
    """(doc, state, questions) of blocks (doc, seq): a section needs exactly one start, exactly one end behind it, and enough blocks and questions between."""
    b = blocks.withColumn("s", starts).withColumn("e", ends).withColumn("q", question)
    by = Window.partitionBy("doc")
    b = b.withColumn("starts", F.count(F.when(F.col("s"), F.lit(1))).over(by)).withColumn("first", F.min(F.when(F.col("s"), F.col("seq"))).over(by))
    b = b.withColumn("behind", F.col("e") & (F.col("seq") > F.col("first"))).withColumn("ends", F.count(F.when(F.col("behind"), F.lit(1))).over(by)).withColumn("last", F.min(F.when(F.col("behind"), F.col("seq"))).over(by))
    inside = (F.col("seq") > F.col("first")) & (F.col("seq") < F.col("last"))
    sums = b.groupBy("doc").agg(F.max("starts").alias("starts"), F.max("ends").alias("ends"), F.count(F.when(inside, F.lit(1))).alias("n"), F.count(F.when(inside & F.col("q"), F.lit(1))).alias("questions"))
    state = F.when(F.col("starts") != 1, "start_not_unique").when(F.col("ends") != 1, "end_not_unique").when(F.col("n") < least_blocks, "too_few_blocks").when(F.col("questions") < least_questions, "too_few_questions").otherwise("section")
    return sums.select("doc", state.alias("state"), "questions")
