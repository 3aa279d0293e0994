"""Normalising of observed metadata values, as column expressions.

with_facts() adds (valid, value, type, confidence, problem). Absent input (null) is invalid, as empty is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tags that are rewritten whole, and languages that are, before they are read.
WHOLE_TAGS = {"art-lojban": "jbo", "no-bok": "nb", "no-nyn": "nn", "zh-guoyu": "cmn", "zh-hakka": "hak", "zh-min-nan": "nan", "zh-xiang": "hsn"}
LEGACY_LANGUAGES = {"iw": "he", "in": "id", "ji": "yi"}
#: Contributor roles; any other is OTHER.
ROLES = ("AUTHOR", "EDITOR", "TRANSLATOR", "ILLUSTRATOR")
#: Identifier schemes and the types they stand for; any other is OTHER.
SCHEMES = {"isbn": "ISBN_10", "isbn10": "ISBN_10", "isbn-10": "ISBN_10", "isbn13": "ISBN_13", "isbn-13": "ISBN_13", "doi": "DOI", "uuid": "UUID", "uri": "URI", "url": "URI", "source": "SOURCE_LOCAL", "source-local": "SOURCE_LOCAL", "source_local": "SOURCE_LOCAL"}

# Java's strip() keeps these; (?U)\s matches them
_STRIP = r"[\t-\r\x1c-\x20  -  -    　]+"


def collapsed(x: Column) -> Column:
    """Unicode white space collapsed to single blanks, ends stripped; no-break spaces at the ends become blanks."""
    return F.regexp_replace(F.regexp_replace(x, f"^{_STRIP}|{_STRIP}$", ""), r"(?U)\s+", " ")


def collapsed_ascii(x: Column) -> Column:
    """ASCII white space collapsed and trimmed; null if nothing is left."""
    y = F.trim(F.regexp_replace(x, r"[ \t\n\x0b\f\r]+", " "))
    return F.when(y != "", y)


def _let(x: Column, then) -> Column:
    """then(x), where x is computed once however often it is used: expressions stay small, which plans fast."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def _mapped(x: Column, to: dict[str, str], otherwise: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in to.items() for v in kv]), x), otherwise)


def contributor_role(field: Column) -> Column:
    """What stands after the first colon; a field without one is an author's."""
    at = F.instr(field, ":")
    return F.when(at == 0, "AUTHOR").otherwise(_mapped(F.upper(F.substr(field, at + 1)), {r: r for r in ROLES}, F.lit("OTHER")))


#: A tag's parts in order: language, up to three extended ones, script, region, variants. What doesn't fit ends the tag.
_TAG = r"^([a-z]{2,3})((?:-[a-z]{3}(?=-|$)){0,3})((?:-[a-z]{4}(?=-|$))?)((?:-(?:[a-z]{2}|[0-9]{3})(?=-|$))?)((?:-(?:[a-z0-9]{5,8}|[0-9][a-z0-9]{3})(?=-|$))*)"


def language_tag(x: Column) -> Column:
    """A BCP-47 tag in canonical case, null if the shape is wrong or the language undetermined. An extended language replaces the language."""

    def canonical(part: Column) -> Column:
        language = F.when(part[1] != "", F.substring(part[1], 2, 3)).otherwise(_mapped(part[0], LEGACY_LANGUAGES, part[0]))
        return F.concat(language, F.substring(part[2], 1, 1), F.initcap(F.substring(part[2], 2, 4)), F.upper(part[3]), part[4])

    parts = _let(_let(F.lower(x), lambda t: _mapped(t, WHOLE_TAGS, t)), lambda t: F.array(*[F.regexp_extract(t, _TAG, k) for k in range(1, 6)]))
    whole = F.when(x.rlike(r"^[a-zA-Z]{2,3}(?:-[a-zA-Z0-9]{2,8})*$"), _let(parts, canonical))
    return F.nullif(whole, F.lit("und"))


def _compact(x: Column) -> Column:
    return F.upper(F.regexp_replace(x, r"[-\s]", ""))


def _weighed(digits: Column, weights: list[int]) -> Column:
    """The weighed sum of a string's digits; X counts ten."""
    values = F.transform(F.split(digits, ""), lambda d: F.when(d == "X", 10).otherwise(d.try_cast("int")))
    return F.aggregate(F.zip_with(values, F.array(*map(F.lit, weights)), lambda v, w: v * w), F.lit(0), lambda total, v: total + F.coalesce(v, F.lit(0)))


def isbn10(x: Column) -> Column:
    """The compact ISBN-10, null if shape or checksum is wrong."""
    return _let(_compact(x), lambda s: F.when(s.rlike(r"^[0-9]{9}[0-9X]$") & (_weighed(s, list(range(10, 0, -1))) % 11 == 0), s))


def isbn13(x: Column) -> Column:
    """The compact 13 digits, whatever they begin with; null if shape or checksum is wrong."""
    return _let(_compact(x), lambda s: F.when(s.rlike(r"^[0-9]{13}$") & (_weighed(s, [1, 3] * 6 + [1]) % 10 == 0), s))


def doi(x: Column) -> Column:
    return F.when(x.rlike(r"^(?i)10\.[0-9]{4,9}/\S+$"), F.lower(x))


def uuid(x: Column) -> Column:
    """Canonical lower case. Groups may be shorter than they should, or longer, of which the last digits count."""
    widths = F.array(*map(F.lit, (8, 4, 4, 4, 12)))
    each = F.zip_with(F.split(F.lower(x), "-"), widths, lambda g, w: F.right(F.lpad(g, 16, "0"), w))
    return F.when(x.rlike(r"^[0-9a-fA-F]{1,15}(?:-[0-9a-fA-F]{1,15}){4}$") & (F.length(x) <= 36), F.array_join(each, "-"))


def _clean_path(path: Column) -> Column:
    """A path without `.`, empty and, where something stands before them, `..` segments."""
    none = F.expr("cast(array() as array<string>)")

    def step(seen: Column, part: Column) -> Column:
        back = (part == "..") & (F.size(seen) > 0) & (F.element_at(seen, -1) != "..")
        return F.when(part.isin("", "."), seen).when(back, F.slice(seen, F.lit(1), F.size(seen) - 1)).otherwise(F.concat(seen, F.array(part)))

    kept = F.array_join(F.aggregate(F.split(path, "/"), none, step), "/")
    ends = path.rlike(r"(/|/\.|[^/.][^/]*/\.\.)$") & (kept != "")
    return F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), kept, F.when(ends, "/").otherwise(""))


#: Scheme, authority, path, and query with fragment; and what an address may hold besides letters, digits and characters beyond ASCII.
_URI = r"^([A-Za-z][A-Za-z0-9+.\-]*:)((?://[^/?#]*)?)([^?#]*)(.*)$"
_URI_CHARACTERS = r"^(?:[^\x00-\x20\x7f-\xa0\"<>\\^`{|}%]|%[0-9A-Fa-f]{2})+$"


def uri(x: Column) -> Column:
    """An absolute address with a clean path, characters beyond ASCII as escapes; null if it isn't absolute or holds what it mustn't."""

    def cleaned(part: Column) -> Column:
        hierarchical = (part[1] != "") | F.startswith(part[2], F.lit("/"))
        needs = part[2].rlike(r"//|(^|/)\.\.?(/|$)")
        return F.concat(part[0], part[1], F.when(hierarchical & needs, _clean_path(part[2])).otherwise(part[2]), part[3])

    def escaped(whole: Column) -> Column:
        return F.array_join(F.transform(F.split(whole, ""), lambda ch: F.when(ch > "\x7f", F.url_encode(ch)).otherwise(ch)), "")

    whole = _let(F.array(*[F.regexp_extract(x, _URI, k) for k in range(1, 5)]), cleaned)
    fits = x.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:[^#]") & x.rlike(_URI_CHARACTERS) & ~x.rlike("#.*#")
    return F.when(fits, _let(whole, lambda w: F.when(w.rlike(r"[^\x00-\x7f]"), escaped(w)).otherwise(w)))


def identifier_scheme(field: Column) -> Column:
    return _mapped(F.lower(F.trim(F.substring(field, len("identifier:") + 1, 1000))), SCHEMES, F.lit("OTHER"))


def fact_type(field: Column, text: Column) -> Column:
    """What a field's values are taken for, valid or not; nothing at all is text."""
    return (
        F.when(text.isNull(), "TEXT")
        .when(field == "title", "TITLE")
        .when(F.startswith(field, F.lit("contributor")), F.concat(F.lit("CONTRIBUTOR:"), contributor_role(field)))
        .when(field == "language", "BCP47")
        .when(F.startswith(field, F.lit("identifier:")), identifier_scheme(field))
        .otherwise("TEXT")
    )


def fact_value(kind: Column, text: Column, fields: list[str] | None = None) -> Column:
    """The normalised value, null if the text isn't one of its type. fields: what occurs, so no rule for others is planned."""
    checked = {"BCP47": language_tag, "ISBN_10": isbn10, "ISBN_13": isbn13, "DOI": doi, "UUID": uuid, "URI": uri}
    value = F.when(F.lit(False), text)
    occur = set(checked)
    if fields is not None:
        occur = {"BCP47" for f in fields if f == "language"} | {SCHEMES.get(f.removeprefix("identifier:").strip().lower()) for f in fields if f.startswith("identifier:")}
    for name, rule in checked.items():
        if name not in occur:
            continue
        value = value.when(kind == name, rule(text))
    return value.otherwise(text)


def with_facts(df: DataFrame, field: str = "field", observed: str = "observed", fields: list[str] | None = None) -> DataFrame:
    """df with (valid, value, type, confidence, problem) of each observed value. fields: all that occur, if known. Each step is a column of its own, so none is computed twice."""
    ready = df.withColumn("_text", collapsed(F.col(observed))).withColumn("_text", F.when(F.col("_text") != "", F.col("_text")))
    ready = ready.withColumn("type", fact_type(F.col(field), F.col("_text"))).withColumn("value", fact_value(F.col("type"), F.col("_text"), fields))
    valid = F.col("value").isNotNull()
    kind = F.col("type")
    confidence = F.when(~valid | kind.isin("TEXT", "OTHER"), "UNKNOWN").when(F.startswith(kind, F.lit("CONTRIBUTOR:")) | (kind == "SOURCE_LOCAL"), "HIGH").otherwise("EXACT")
    problem = F.when(valid, F.lit(None)).when(F.col("_text").isNull(), "empty").when(kind.isin("ISBN_10", "ISBN_13"), "checksum or shape").otherwise("malformed")
    return ready.withColumns({"valid": valid, "confidence": confidence, "problem": problem}).drop("_text")


def title_from_path(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def idempotency_key(*fields: Column) -> Column:
    """SHA-256 over the fields, a line each; null counts as empty."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256)


def memory_reservation(path: Column) -> Column:
    """MiB to reserve for a file by its name."""
    return F.when(F.lower(path).rlike(r"\.(epub|docx)$"), 128).otherwise(64)


MEDIA_TYPES = {
    "EPUB": ("application/epub+zip", "epub"),
    "FB2": ("application/x-fictionbook+xml", "fb2"),
    "MOBI": ("application/x-mobipocket-ebook", "mobi"),
    "PDF": ("application/pdf", "pdf"),
    "DOCX": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "docx"),
    "DJVU": ("image/vnd.djvu", "djvu"),
}


def media_type(fmt: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in MEDIA_TYPES.items() for x in (k, v[0])]), fmt)


def download_name(title: Column, fmt: Column) -> Column:
    """A file name without separators, quotes and control characters."""
    extension = F.element_at(F.create_map(*[F.lit(x) for k, v in MEDIA_TYPES.items() for x in (k, v[1])]), fmt)
    return F.concat(F.regexp_replace(title, r"[\x00-\x1f\x7f\"\\/:*?<>|]", "_"), F.lit("."), extension)


def image_scale(width: Column, height: Column) -> Column:
    """(width, height) scaled down to 1600 by 2400, never up."""
    s = F.least(F.lit(1.0), 1600 / F.nullif(width, F.lit(0)), 2400 / F.nullif(height, F.lit(0)))
    return F.struct(F.greatest(F.lit(1), F.floor(width * s)).cast("int").alias("width"), F.greatest(F.lit(1), F.floor(height * s)).cast("int").alias("height"))


def telemetry_code(code: Column) -> Column:
    return F.when(code.rlike(r"^[A-Z][A-Z0-9_]{0,63}$"), code).otherwise("UNKNOWN")


def legacy_identifier_scheme(value: Column) -> Column:
    """By digits only, without a checksum."""
    digits = F.regexp_replace(value, r"[^0-9Xx]", "")
    return F.when(F.length(digits) == 13, "ISBN_13").when(F.length(digits) == 10, "ISBN_10").otherwise("OTHER")
