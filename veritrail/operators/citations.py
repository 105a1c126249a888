"""Citations of legal acts in texts: spans of mentions, relations that verbs or editorial notes announce, resolution, promotion, expansion.

All patterns run on text in lower case without marks, letter for letter, so
offsets are those of the text itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.functions.forms import MARKED, PLAIN, lookup

#: How citations are written, in lower case without marks.
ISSUERS = r"dian|banco +de +la +republica(?: +junta +directiva)?|presidencia(?: +de +la +republica)?|mincit|mincomercio|mintic|sgcan|dapr"
_QUALIFIED = rf"(?: +unico(?: +reglamentario)?)?(?: +(?:{ISSUERS}))? +(?:(?:numero|no\.?|nro\.?) *)?[0-9]+[a-z]? +de +[0-9]{{4}}\b"
NORM = r"(?:ley|decreto|resolucion)" + _QUALIFIED
# Letters ahead spare most places the look at a word's border.
ACT = r"(?=[cdlor])\b(?:ley|decreto|resolucion|circular|concepto|oficio)" + _QUALIFIED
NUMBERS = r"[0-9]+(?: +[0-9]+)*"
LETTERS = (
    rf"\b(?:concepto|oficio) +{NUMBERS} *(?:[-–—] *)?int(?:\.?|-)? *[0-9]+ +(?:de|del +[0-9]{{1,2}} +de +[a-z]+ +de) +[0-9]{{4}}\b",
    rf"\b(?:concepto|oficio) +{NUMBERS} +del +[0-9]{{1,2}} +de +[a-z]+ +de +[0-9]{{4}}\b",
    r"\b(?:concepto|oficio) +[0-9]+(?: +[0-9]+)+ +de +[0-9]{4}\b",
)
STATUTE = r"\bestatuto +tributario\b"
LIST = r"[0-9][0-9.\- ,;yº°o]*?"
ARTICLE_OF = rf"(?=a)\barticulos? +{LIST}(?: *\[[0-9]+\])? +(?:del|de +la) +(?:estatuto +tributario|{NORM})"
ARTICLE_IN = rf"(?=a)\barticulos? +{LIST} +(?:del|de +la|al|a +la) +(?:seccion|capitulo|titulo|parte|libro) +[^.;:]{{1,260}}? +(?:del|de +la) +{NORM}"
ACT_THEN_ARTICLE = rf"{NORM} +(?:en +)?(?:su +)?articulo +[0-9]+(?:\.[0-9]+)*(?:-[0-9]+)?\b"
ARTICLE_NUMBER = r"[0-9]+(?:\.[0-9]+)*(?:-[0-9]+)?[oº°]?"
#: Keys of the issuers that citations name.
ISSUER_KEYS = (("dian", "DIAN"), ("banco de la republica", "BANREP"), ("banco de la republica junta directiva", "BANREP_JD"), ("presidencia", "PRESIDENCIA"), ("presidencia de la republica", "PRESIDENCIA"), ("mincit", "MINCIT"), ("mincomercio", "MINCIT"), ("mintic", "MINTIC"), ("sgcan", "SGCAN"), ("dapr", "DAPR"))
#: Verbs that announce a relation, and its type; those of editorial notes.
TRIGGERS = (("sustituyase", "substitutes"), ("sustituyanse", "substitutes"), ("sustituye", "substitutes"), ("modifiquese", "modifies"), ("modifiquense", "modifies"), ("modifica", "modifies"), ("adicionese", "adds"), ("adicionense", "adds"), ("adiciona", "adds"), ("deroguense", "repeals"), ("deroguese", "repeals"), ("deroga", "repeals"))
NOTE = r"<(?:articulo|paragrafo|numeral|inciso)[^<>]{0,160}? +(?:modificado|adicionado|derogado|sustituido) +por +[^<>]{1,700}?>"
NOTE_TYPES = (("modificado", "modified_by"), ("adicionado", "added_by"), ("derogado", "repealed_by"), ("sustituido", "substituted_by"))


def folded(text: Column) -> Column:
    """Lower case without marks, a letter for each letter."""
    return F.translate(F.lower(text), MARKED, PLAIN)


#: A character that texts hardly have; those that do are read more slowly.
_MARK = "\x01"


def spans(text: Column, pattern: str) -> Column:
    """array<struct<raw, start>> of a pattern's matches, found in one pass that marks them in the text.

    What stands between the marks is by turns no match and a match, which gives the places.
    """
    none = F.expr("CAST(array() AS array<struct<raw: string, start: int>>)")
    state = F.struct(F.lit(0).alias("at"), F.lit(False).alias("match"), none.alias("out"))
    step = lambda a, p: F.struct((a["at"] + F.length(p)).alias("at"), (~a["match"]).alias("match"), F.when(a["match"], F.concat(a["out"], F.array(F.struct(p.alias("raw"), a["at"].alias("start"))))).otherwise(a["out"]).alias("out"))
    placed = lambda pieces: F.when(F.size(pieces) > 1, F.aggregate(pieces, state, step, lambda a: a["out"])).otherwise(none)
    raw = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    apart = F.flatten(F.zip_with(F.split(text, pattern, -1), raw, lambda gap, r: F.when(r.isNull(), F.array(gap)).otherwise(F.array(gap, r))))
    marked = F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)
    # The pieces are bound by a lambda, so that they are found once.
    return F.flatten(F.transform(F.array(F.when(F.contains(text, F.lit(_MARK)), apart).otherwise(marked)), placed))


def _exploded(texts: DataFrame, pattern: str) -> DataFrame:
    return texts.select("text_id", F.explode(spans(F.col("low"), pattern)).alias("m")).select("text_id", "m.raw", "m.start")


def _target(raw: Column) -> tuple[Column, Column]:
    """Key (type, number, year) and issuer of the act that a citation names; letters are the tax authority's unless they say otherwise."""
    pattern = rf"(ley|decreto|resolucion|circular|concepto|oficio)(?: +unico(?: +reglamentario)?)?(?: +({ISSUERS}))? +(?:(?:numero|no\.?|nro\.?) *)?([0-9]+[a-z]?) +de +([0-9]{{4}})"
    part = lambda i: F.upper(F.regexp_extract(raw, pattern, i))
    number = F.regexp_replace(part(3), "^0+([0-9])", "$1")
    key = F.when(raw.rlike("estatuto +tributario"), "CO:ESTATUTO_TRIBUTARIO").otherwise(F.concat_ws(":", F.lit("CO"), part(1), number, part(4)))
    issuer = lookup(F.regexp_replace(F.lower(part(2)), " +", " "), ISSUER_KEYS)
    return key, F.coalesce(issuer, F.when(part(1).isin("CONCEPTO", "OFICIO"), "DIAN"))


#: What each of a form's matches has in it, one word of each row: other texts need no look at its pattern.
_NORMS, _ARTICLE, _LETTERS = ("ley", "decreto", "resolucion"), ("articulo",), ("concepto", "oficio")
#: Citation forms by what they give: a whole act, a letter with its number in groups, listed articles, an article behind its act.
FORMS = (
    ("act", ACT, ((*_NORMS, "circular", *_LETTERS),)), ("act", STATUTE, (("estatuto",),)), *(("letter", p, (_LETTERS,)) for p in LETTERS),
    ("articles", ARTICLE_OF, (_ARTICLE, (*_NORMS, "estatuto"))), ("articles", ARTICLE_IN, (_ARTICLE, _NORMS, ("seccion", "capitulo", "titulo", "parte", "libro"))), ("article", ACT_THEN_ARTICLE, (_ARTICLE, _NORMS)),
)


def _has(text: Column, words: tuple[tuple[str, ...], ...]) -> Column:
    return reduce(Column.__and__, (reduce(Column.__or__, (F.contains(text, F.lit(w)) for w in row)) for row in words))


def mentions(texts: DataFrame) -> DataFrame:
    """(text_id, char_start, char_end, mention_type, target_key, target_issuer, article, normalized) of (text_id, text).

    Articles of a list are mentions of their own; a span and target that
    several patterns find is one.  All forms are found in one pass over the
    texts; ``normalized`` names the issuer where it is known.
    """
    low = texts.select("text_id", folded(F.col("text")).alias("low"))

    def of(kind: str, pattern: str, words: tuple) -> Column:
        found = F.transform(spans(F.col("low"), pattern), lambda m: F.struct(F.lit(kind).alias("kind"), m["raw"].alias("raw"), m["start"].alias("start")))
        return F.when(_has(F.col("low"), words), found).otherwise(F.expr("CAST(array() AS array<struct<kind: string, raw: string, start: int>>)"))

    found = low.select("text_id", F.explode(F.flatten(F.array(*[of(*form) for form in FORMS]))).alias("m")).select("text_id", "m.*")
    key, issuer = _target(F.col("raw"))
    letter = F.col("kind") == "letter"
    numbers = F.regexp_replace(F.regexp_extract("raw", rf"^[a-z]+ +({NUMBERS})", 1), " +", "")
    letter_key = F.concat_ws(":", F.lit("CO"), F.upper(F.regexp_extract("raw", "^(concepto|oficio)", 1)), F.regexp_replace(numbers, "^0+([0-9])", "$1"), F.regexp_extract("raw", "([0-9]{4})$", 1))
    listed = F.regexp_extract("raw", rf"^articulos? +({LIST})(?: *\[[0-9]+\])? +(?:del|de +la|al|a +la) ", 1)
    base = F.col("start") + F.length(F.regexp_extract("raw", "^articulos? +", 0))
    last = F.regexp_extract("raw", r"articulo +([0-9.\-]+)$", 1)
    end = F.col("start") + F.length("raw")
    part = lambda at, to, token: F.struct(at.alias("char_start"), to.alias("char_end"), token.alias("token"))
    whole = F.array(part(F.col("start"), end, F.lit(None).cast("string")))
    each = F.transform(spans(listed, ARTICLE_NUMBER), lambda a: part(base + a["start"], base + a["start"] + F.length(a["raw"]), a["raw"]))
    parts = F.when(F.col("kind") == "articles", each).when(F.col("kind") == "article", F.array(part(end - F.length(last), end, last))).otherwise(whole)
    rows = found.select("text_id", F.when(letter, letter_key).otherwise(key).alias("target_key"), F.when(letter, "DIAN").otherwise(issuer).alias("target_issuer"), F.inline(parts))
    article = F.regexp_replace("token", "[oº°]$", "")
    named = F.when(F.col("target_issuer").isNull(), F.col("target_key")).otherwise(F.concat(F.lit("CO:"), "target_issuer", F.lit(":"), F.substring("target_key", F.lit(4), F.length("target_key"))))
    rows = rows.withColumn("article", article).withColumn("normalized", F.concat_ws(":ART:", named, "article"))
    kind = F.when(F.col("article").isNull(), "document").otherwise("article")
    return rows.dropDuplicates(["text_id", "char_start", "char_end", "normalized"]).select("text_id", "char_start", "char_end", kind.alias("mention_type"), "target_key", "target_issuer", "article", "normalized")


def triggers(texts: DataFrame) -> DataFrame:
    """(text_id, at, relation_type) of every announcing verb."""
    verbs = rf"\b(?:{'|'.join(v for v, _ in TRIGGERS)})\b"
    kind = F.lit(None).cast("string")
    for verb, name in TRIGGERS:
        kind = F.when(F.col("raw") == verb, name).otherwise(kind)
    return _exploded(texts.select("text_id", folded(F.col("text")).alias("low")), verbs).select("text_id", F.col("start").alias("at"), kind.alias("relation_type"))


def operational(segment_type: Column, text: Column) -> Column:
    """Whether a segment acts on other norms: an article that speaks of this decree or has an announcing verb."""
    low = folded(text)
    return (segment_type == "article") & (low.contains("el presente decreto") | low.rlike(rf"\b(?:{'|'.join(v for v, _ in TRIGGERS)})\b"))


def announced(found: DataFrame, verbs: DataFrame) -> DataFrame:
    """(text_id, char_start, normalized, relation_type): mentions with the first verb of each type that stands after the previous article mention and before this one."""
    by = Window.partitionBy("text_id").orderBy("char_start", "char_end").rowsBetween(Window.unboundedPreceding, -1)
    places = found.withColumn("after", F.coalesce(F.max(F.when(F.col("mention_type") == "article", F.col("char_end"))).over(by), F.lit(0)))
    places = places.withColumn("after", F.when(F.col("after") <= F.col("char_start"), F.col("after")).otherwise(F.lit(0)))
    met = places.join(verbs, "text_id").where((F.col("at") >= F.col("after")) & (F.col("at") < F.col("char_start")))
    return met.groupBy("text_id", "char_start", "normalized", "relation_type").agg(F.min("at").alias("at"))


def may_note(text: Column) -> Column:
    """Whether a text can have an editorial note; mentions of others are none that ``noted`` gives."""
    return F.contains(text, F.lit("<"))


def noted(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(text_id, char_start, normalized, relation_type): mentions inside an editorial note, with the note's relation.

    A text's notes are held as one array beside its mentions, so mentions and notes of a text are not multiplied.
    """
    low = texts.where(may_note(F.col("text"))).select("text_id", F.filter(spans(folded(F.col("text")), NOTE), lambda n: n["raw"] != "").alias("notes")).where(F.size("notes") > 0)
    around = F.filter("notes", lambda n: (F.col("char_start") >= n["start"]) & (F.col("char_end") <= n["start"] + F.length(n["raw"])))
    met = found.join(low, "text_id").withColumn("note", F.get(around, F.lit(0))["raw"]).where("note IS NOT NULL")
    # The verb nearest to the note's start decides.
    verb = F.regexp_extract(F.substring("note", F.lit(2), F.length("note")), r"(modificado|adicionado|derogado|sustituido) +por ", 1)
    kind = F.lit(None).cast("string")
    for word, name in NOTE_TYPES:
        kind = F.when(verb == word, name).otherwise(kind)
    return met.select("text_id", "char_start", "normalized", kind.alias("relation_type"))


def resolve(asked: DataFrame, documents: DataFrame, provisions: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(mention_id, status, document_id, provision_id, reason) of mentions (mention_id, mention_type, target_key, target_issuer, article).

    Documents are (document_id, key, issuer), provisions (provision_id,
    document_id, designation), conflicts (document_id, designation).  An
    issuer that is null does not restrict.  First rule that applies: no
    document, several, a document asked for, no designation, an open
    conflict, no provision, several, one.
    """
    # Documents are counted by key, and by key and issuer, before mentions meet them: each mention meets one row of either.
    counted = lambda *by: documents.groupBy(*by).agg(F.countDistinct("document_id").alias("n"), F.min("document_id").alias("one"))
    any_issuer = counted(F.col("key").alias("target_key")).select("target_key", F.struct("n", "one").alias("any"))
    same_issuer = counted(F.col("key").alias("target_key"), F.col("issuer").alias("target_issuer")).select("target_key", "target_issuer", F.struct("n", "one").alias("same"))
    met = asked.join(any_issuer, "target_key", "left").join(same_issuer, ["target_key", "target_issuer"], "left").withColumn("hit", F.when(F.col("target_issuer").isNull(), F.col("any")).otherwise(F.col("same")))
    one = met.select("mention_id", "mention_type", "article", F.coalesce("hit.n", F.lit(0)).alias("n_doc"), F.col("hit.one").alias("document_id"))
    held = provisions.groupBy("document_id", F.col("designation").alias("article")).agg(F.countDistinct("provision_id").alias("n_prov"), F.min("provision_id").alias("provision_id"))
    open_conflict = conflicts.select("document_id", F.col("designation").alias("article"), F.lit(True).alias("conflict")).distinct()
    found = one.join(held, ["document_id", "article"], "left").join(open_conflict, ["document_id", "article"], "left")
    d, p = F.col("n_doc"), F.coalesce("n_prov", F.lit(0))
    asks_document = F.col("mention_type") == "document"
    nameless = (F.col("mention_type") != "article") | (F.coalesce("article", F.lit("")) == "")
    reason = (
        F.when(d == 0, "TARGET_DOCUMENT_NOT_FOUND").when(d > 1, "AMBIGUOUS_DOCUMENT_ID").when(asks_document, None).when(nameless, "TARGET_PROVISION_NOT_FOUND")
        .when(F.coalesce("conflict", F.lit(False)), "AMBIGUOUS_PROVISION_DESIGNATION").when(p == 0, "TARGET_PROVISION_NOT_FOUND").when(p > 1, "AMBIGUOUS_PROVISION_DESIGNATION")
    )
    status = F.when(reason.isNull(), "resolved").when(reason.startswith("AMBIGUOUS"), "ambiguous").otherwise("unresolved")
    return found.select("mention_id", status.alias("status"), F.when(d == 1, F.col("document_id")).alias("document_id"), F.when((d == 1) & reason.isNull() & ~asks_document, F.col("provision_id")).alias("provision_id"), reason.alias("reason"))


def promote_strict(relations: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Edges of relations (mention_id, source_document, relation_type, confidence), all or none: raises unless each has one provision and needs no review."""
    joined = relations.join(resolutions.where("status = 'resolved' AND provision_id IS NOT NULL AND NOT review"), "mention_id", "left")
    if open_ones := joined.where("provision_id IS NULL OR source_document IS NULL").limit(1).count():
        raise ValueError(f"partial promotion refused: {open_ones} relation or more is not resolved")
    return joined.select("mention_id", "source_document", "relation_type", F.col("provision_id").alias("target_provision"), F.least("confidence", "resolution_confidence").alias("confidence"))


def promote_partial(relations: DataFrame, resolutions: DataFrame, provisions: DataFrame, keep_unmatched: bool) -> DataFrame:
    """(mention_id, outcome, source_provision, target_document, target_provision, confidence) of relations (mention_id, source_document, source_article, relation_type, confidence).

    ``keep_unmatched``: relations without a resolution row are counted as
    unresolved, else they are left out.  A source article that is no single
    provision of its document asks for review.
    """
    known = provisions.groupBy(F.col("document_id").alias("source_document"), F.col("designation").alias("source_article")).agg(F.countDistinct("provision_id").alias("n"), F.min("provision_id").alias("one"))
    joined = relations.join(resolutions, "mention_id", "left" if keep_unmatched else "inner").join(known, ["source_document", "source_article"], "left")
    outcome = F.when(F.col("source_document").isNull(), "skipped_unbound").when(~F.coalesce(F.col("status") == "resolved", F.lit(False)) | F.coalesce("review", F.lit(False)), "unresolved").when(F.coalesce("n", F.lit(0)) != 1, "review_source_provision").otherwise("promoted")
    done = F.col("outcome") == "promoted"
    return joined.withColumn("outcome", outcome).select("mention_id", "outcome", F.when(done, F.col("one")).alias("source_provision"), F.when(done, F.col("document_id")).alias("target_document"), F.when(done, F.col("provision_id")).alias("target_provision"), F.when(done, F.least("confidence", "resolution_confidence")).alias("confidence"))


def owning_document(edges: DataFrame, side: str, provisions: DataFrame) -> DataFrame:
    """``edges`` with ``{side}_document``: the endpoint itself, or its provision's document; null for other kinds."""
    own = provisions.select(F.col("provision_id").alias(f"{side}_id"), F.lit("provision").alias(f"{side}_type"), F.col("document_id").alias("__own"))
    document = F.when(F.col(f"{side}_type") == "document", F.col(f"{side}_id")).otherwise(F.col("__own"))
    return edges.join(own, [f"{side}_type", f"{side}_id"], "left").withColumn(f"{side}_document", document).drop("__own")


def touching(edges: DataFrame, provisions: DataFrame) -> DataFrame:
    """(document_id, relation_id): edges that touch a document or one of its provisions, once each."""
    both = owning_document(owning_document(edges, "source", provisions), "target", provisions)
    return both.select("relation_id", F.explode(F.array("source_document", "target_document")).alias("document_id")).where("document_id IS NOT NULL").distinct().select("document_id", "relation_id")


def expand(seeds: DataFrame, links: DataFrame, depth: int = 2) -> DataFrame:
    """(question, document_id, depth): documents reached from seeds (question, document_id) over links (document_id, target) in at most ``depth`` steps, each at its least depth.

    A few joins, one for each step; what was visited is not walked again.
    """
    seen = seeds.select("question", "document_id").distinct().withColumn("depth", F.lit(0))
    front = seen
    for step in range(1, depth + 1):
        ahead = front.join(links, "document_id").select("question", F.col("target").alias("document_id")).distinct()
        front = ahead.join(seen, ["question", "document_id"], "left_anti").withColumn("depth", F.lit(step))
        seen = seen.unionByName(front)
    return seen


def late(unresolved: DataFrame, new_documents: DataFrame, provisions: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Earlier unresolved mentions that documents which came later settle: only mentions of their keys are looked at again."""
    again = unresolved.join(new_documents.select(F.col("key").alias("target_key")).distinct(), "target_key", "left_semi")
    return resolve(again, new_documents, provisions, conflicts)
