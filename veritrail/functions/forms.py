"""Normal forms, parsers and decision maps of single values, as Column builders; none is a UDF."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _marked_letters() -> tuple[str, str]:
    """Letters of the Latin blocks that decompose into one letter and marks, and those letters."""
    marked, plain = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = [c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)]
        if len(parts) == 1 and parts[0] != chr(code):
            marked.append(chr(code))
            plain.append(parts[0])
    return "".join(marked), "".join(plain)


MARKED, PLAIN = _marked_letters()
#: Characters that fold to several, or to a letter of another block.
WIDE = (("ß", "ss"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ĳ", "ij"), ("º", "o"), ("ª", "a"))


def strip_accents(text: Column) -> Column:
    """Text without combining marks; marked Latin letters lose theirs, case stays."""
    return F.regexp_replace(F.translate(text, MARKED, PLAIN), r"\p{M}+", "")


def fold(text: Column) -> Column:
    """Lower case, wide letters written out, without marks."""
    out = F.lower(text)
    for a, b in WIDE:
        out = F.replace(out, F.lit(a), F.lit(b))
    return strip_accents(out)


#: The character references that pages use.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def unescape(text: Column) -> Column:
    out = text
    for a, b in ENTITIES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def collapse(text: Column) -> Column:
    """Runs of white space, no-break space among them, as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"[\s\x{A0}\x{2000}-\x{200A}\x{3000}]+", " "))


#: What hardly any text has: white space that is no single space, and marks that are characters of their own.
_RAGGED = r"[\t\n\x0B\f\r\x{A0}\x{2000}-\x{200A}\x{3000}\p{M}]|  "


def key_form(text: Column) -> Column:
    """For comparing labels: no marks, single spaces, upper case.  Texts with nothing to collapse only lose the marks of their letters."""
    return F.upper(F.when(text.rlike(_RAGGED), collapse(strip_accents(text))).otherwise(F.trim(F.translate(text, MARKED, PLAIN))))


def plain_form(text: Column) -> Column:
    """For comparing passages: lower case and single spaces."""
    return collapse(F.lower(text))


#: Names of document types, folded to key form, and the type they mean.
TYPES = (("LEY", "LEY"), ("DECRETO", "DECRETO"), ("DECRETO LEY", "DECRETO"), ("RESOLUCION", "RESOLUCION"), ("CIRCULAR", "CIRCULAR"), ("CONCEPTO", "CONCEPTO"), ("OFICIO", "OFICIO"), ("SENTENCIA", "SENTENCIA_C"))
#: Issuers by label in key form, and by the start of a file name.
ISSUERS = (("DIRECCION DE IMPUESTOS Y ADUANAS NACIONALES", "DIAN"), ("DIAN", "DIAN"), ("MINISTERIO DE HACIENDA Y CREDITO PUBLICO", "MINHACIENDA"), ("MINHACIENDA", "MINHACIENDA"), ("CONGRESO DE LA REPUBLICA", "CONGRESO"), ("PRESIDENCIA DE LA REPUBLICA", "PRESIDENCIA"))
FILE_ISSUERS = (("ley_", "CONGRESO"), ("decreto_", "PRESIDENCIA"), ("resolucion_dian_", "DIAN"), ("resolucion_minhacienda_", "MINHACIENDA"), ("circular_dian_", "DIAN"))
#: What documents of a type do.
FUNCTIONS = (("LEY", "binding_norm"), ("DECRETO", "binding_norm"), ("RESOLUCION", "binding_norm"), ("CIRCULAR", "administrative_instruction"), ("CONCEPTO", "administrative_interpretation"), ("OFICIO", "administrative_interpretation"), ("SENTENCIA_C", "judicial_decision"))
#: Relation types, in normal form, by the family of dependencies that they found.
FAMILY_TYPES = {
    "amendment": ("modification", "modification_of", "modifies", "modified_by", "amends", "amended_by", "replaces", "replaced_by"),
    "repeal": ("repeal", "repeal_of", "repeals", "repealed_by", "revokes", "revoked_by"),
    "supersession": ("supersession", "supersession_of", "supersedes", "superseded_by"),
    "exception": ("exception", "exception_to", "excepts", "excepted_by"),
    "definition": ("definition", "defines", "defined_by", "definition_for"),
    "conflict": ("conflict", "conflict_with", "conflicts", "conflicts_with", "contradicts", "inconsistent_with", "incompatible_with"),
    "temporal": ("suspends", "suspended_by", "extends", "extended_by", "effective_from", "expires"),
}


def lookup(value: Column, table: tuple[tuple[str, str], ...]) -> Column:
    """The entry of a small fixed table, the first if there are several; null where there is none.  ``value`` is found once."""
    entries = dict(reversed(table))
    return F.try_element_at(F.create_map(*[F.lit(x) for entry in entries.items() for x in entry]), value)


def relation_name(text: Column) -> Column:
    """Normal form of a relation type: folded, runs of other characters as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def relation_family(text: Column) -> Column:
    """Family of dependencies that a relation type founds; null for none."""
    name, out = relation_name(text), F.lit(None).cast("string")
    for family, names in FAMILY_TYPES.items():
        out = F.when(name.isin(*names), family).otherwise(out)
    return out


def document_type(label: Column) -> Column:
    return lookup(key_form(label), TYPES)


def issuer(label: Column) -> Column:
    return lookup(key_form(label), ISSUERS)


def file_issuer(name: Column) -> Column:
    """By the first start that fits."""
    out = F.lit(None).cast("string")
    for start, key in reversed(FILE_ISSUERS):
        out = F.when(F.lower(name).startswith(start), key).otherwise(out)
    return out


def heading(text: Column) -> Column:
    """(doc_type, number, year) of a heading such as ``DECRETO NÚMERO 0624 DE 1989``; null if it is none."""
    low, pattern = key_form(text), r"^(LEY|DECRETO|RESOLUCION|CIRCULAR|CONCEPTO|OFICIO) (?:NUMERO |NO\. ?)?0*([0-9]{1,6}) (?:DE|DEL) ([0-9]{4})\b"
    part = lambda i: F.regexp_extract(low, pattern, i)
    return F.when(low.rlike(pattern), F.struct(part(1).alias("doc_type"), part(2).cast("long").alias("number"), part(3).cast("int").alias("year")))


def primary_key(key: Column) -> Column:
    """(issuer, doc_type, number, year) of a canonical key of four or five parts; null if malformed."""
    parts = F.split(key, ":")
    five = F.size(parts) == 5
    tail = lambda i: F.get(parts, F.size(parts) - i)
    good = F.size(parts).isin(4, 5) & (F.get(parts, F.lit(0)) == "CO") & tail(3).rlike("^[A-Z_]+$") & tail(2).rlike("^[0-9]+[A-Z]?$") & tail(1).rlike("^[0-9]{4}$")
    return F.when(good, F.struct(F.when(five, F.get(parts, F.lit(1))).alias("issuer"), tail(3).alias("doc_type"), tail(2).alias("number"), tail(1).cast("int").alias("year")))


def article(text: Column, longest_title: int = 80) -> Column:
    """(designation, title, body) of an article's text; the title is a leading run in capitals of at most ``longest_title``, up to its full stop."""
    pattern = r"^ART[ÍI]CULO ([0-9]+(?:-[0-9]+)?[A-Z]?)[.°º]*\s+"
    rest = F.regexp_replace(text, pattern, "")
    title = F.regexp_extract(rest, r"^([\p{Lu}0-9 ,]+)\. ", 1)
    titled = (title != "") & (F.length(title) <= longest_title)
    body = F.when(titled, F.substring(rest, F.length(title) + 3, F.length(rest))).otherwise(rest)
    return F.when(text.rlike(pattern), F.struct(designation(F.regexp_extract(text, pattern, 1)).alias("designation"), F.when(titled, title).alias("title"), body.alias("body")))


def designation(text: Column) -> Column:
    """Upper case without the dots around."""
    return F.upper(F.regexp_replace(F.trim(text), r"^\.+|\.+$", ""))


def iso_date(text: Column) -> Column:
    """(day, error): the date, or the reason why there is none."""
    day = F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
    return F.struct(day.alias("day"), F.when(text.isNotNull() & day.isNull(), F.concat(F.lit("not a date: "), text)).alias("error"))


def grouped_integer(text: Column) -> Column:
    """``1.400`` is 1400; null for anything else than digits in groups."""
    return F.when(text.rlike(r"^[0-9]{1,3}(\.[0-9]{3})*$|^[0-9]+$"), F.replace(text, F.lit("."), F.lit("")).cast("long"))


def amounts(text: Column) -> Column:
    """Amounts in UVT of a text, as decimals: three digits behind a mark are a group, fewer are decimals; with both marks the last one is decimal."""
    found = F.regexp_extract_all(text, F.lit(r"([0-9]+(?:[.,][0-9]+)*) UVT"), F.lit(1))

    def value(x: Column) -> Column:
        both = x.contains(".") & x.contains(",")
        last = F.regexp_extract(x, r"([.,])[0-9]+$", 1)
        grouped = (~both & x.rlike(r"^[0-9]{1,3}([.,][0-9]{3})+$")) | (last == "")
        whole = F.regexp_replace(x, r"[.,]", "")
        digits = F.length(F.regexp_extract(x, r"[.,]([0-9]+)$", 1))
        split = F.concat(F.substring(whole, F.lit(1), F.length(whole) - digits), F.lit("."), F.substring(whole, F.length(whole) - digits + 1, digits))
        return F.when(grouped, whole).otherwise(split).cast("decimal(18,4)")

    return F.transform(found, value)


def operator_code(text: Column) -> Column:
    """``lt`` where a text says less than, ``lte`` where it says not to exceed."""
    low = fold(text)
    return F.when(low.contains("inferior"), "lt").when(low.contains("exceda") | low.contains("superior"), "lte")


def source_kind(url: Column) -> Column:
    """Kind of source by host and path, first that fits."""
    low = F.lower(url)
    return F.when(low.contains("/normograma/"), "normative_compilation").when(low.rlike(r"\.pdf($|[?#])"), "official_document").when(low.rlike("^https?://[^/]*blog"), "blog").when(low.rlike("/(en|fr|de|es)/"), "article").otherwise("web_page")


def markdown_escape(text: Column) -> Column:
    """Pipes and line ends made safe for a table cell."""
    return F.regexp_replace(F.replace(text, F.lit("|"), F.lit("\\|")), r"\s*[\r\n]+\s*", " ")


def token_estimate(text: Column, chars_per_token: float = 4.0) -> Column:
    return F.ceil(F.length(text) / F.lit(chars_per_token))


def typed_ref(ref: Column, kind: str) -> Column:
    """What follows ``kind:`` in a reference; null for another kind or an empty rest."""
    return F.when(ref.startswith(f"{kind}:") & (F.length(ref) > len(kind) + 1), F.substring(ref, F.lit(len(kind) + 2), F.length(ref)))


def is_digest(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{64}$")


def is_identifier(text: Column) -> Column:
    return text.rlike("^[A-Za-z][A-Za-z0-9_.:-]{0,127}$")


def needs_review(status: Column, confidence: Column, evidence: Column) -> Column:
    """Whether a claim goes to a person: unless validated, with evidence and confidence of 0.8 or more."""
    return ~F.coalesce((status == "validated") & (confidence >= 0.8) & (evidence > 0), F.lit(False))


def topic_overlap(a: Column, b: Column) -> Column:
    """Share of the smaller term list that both have."""
    both = F.size(F.array_intersect(a, b))
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, both / least).otherwise(F.lit(0.0))


def quote_candidates(text: Column) -> Column:
    """Paragraphs that name an amount; one that names several is cut at its semicolons."""
    named = F.filter(F.split(text, r"\n+"), lambda p: p.contains("UVT"))
    clauses = lambda p: F.filter(F.transform(F.split(p, ";"), lambda c: F.trim(c)), lambda c: c.contains("UVT"))
    return F.flatten(F.transform(named, lambda p: F.when(F.size(F.regexp_extract_all(p, F.lit("UVT"), F.lit(0))) >= 2, clauses(p)).otherwise(F.array(F.trim(p)))))


#: Terms that stand for one another in a search.
ALIASES = (("extemporanea", ("extemporaneidad", "tardia", "tardio")), ("extemporaneidad", ("extemporanea", "tardia", "tardio")), ("tardia", ("extemporanea", "extemporaneidad", "tardio")), ("tardio", ("extemporanea", "extemporaneidad", "tardia")), ("canon", ("canones", "regalia", "regalias")), ("canones", ("canon", "regalia", "regalias")), ("regalia", ("canon", "canones", "regalias")), ("regalias", ("canon", "canones", "regalia")))


def term_variants(term: Column) -> Column:
    """A term, those that stand for it, and the regular plural or singular of each from four letters on; digits have none.  The term comes first, the others in order."""
    aliases = F.create_map(*[x for a, others in ALIASES for x in (F.lit(a), F.array(*[F.lit(o) for o in others]))])
    family = F.concat(F.array(term), F.coalesce(F.try_element_at(aliases, term), F.array().cast("array<string>")))

    def number(x: Column) -> Column:
        cut = lambda n: F.substring(x, F.lit(1), F.length(x) - n)
        other = F.when((F.length(x) > 4) & x.endswith("es"), cut(2)).when((F.length(x) > 4) & x.endswith("s"), cut(1)).when(x.rlike("[aeiou]$"), F.concat(x, F.lit("s"))).otherwise(F.concat(x, F.lit("es")))
        return F.when(F.length(x) >= 4, other).otherwise(x)

    every = F.concat(family, F.transform(family, number))
    rest = F.array_sort(F.array_except(F.array_distinct(every), F.array(term)))
    return F.when(term.rlike("^[0-9]+$"), F.array(term)).otherwise(F.concat(F.array(term), rest))
