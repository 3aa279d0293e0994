"""What the normaliser says of single values, valid ones and others."""

from tomeflow.operators import evidence

#: (field, observed, value or null, type, confidence)
NORMALISED = (
    ("title", " A\u00a0 b\n\tc ", "A b c", "TITLE", "EXACT"), ("title", " \n ", None, "TEXT", "UNKNOWN"), ("pages", " 12  a", "12 a", "TEXT", "UNKNOWN"),
    ("contributor", "Ann  Lee", "Ann Lee", "CONTRIBUTOR:AUTHOR", "HIGH"), ("contributor:editor", "E  D", "E D", "CONTRIBUTOR:EDITOR", "HIGH"), ("contributor:narrator", "N", "N", "CONTRIBUTOR:OTHER", "HIGH"), ("contributor:", "N", "N", "CONTRIBUTOR:OTHER", "HIGH"),
    ("language", "zh-hant-tw", "zh-Hant-TW", "BCP47", "EXACT"), ("language", "en_GB", None, "BCP47", "UNKNOWN"), ("language", "English", None, "BCP47", "UNKNOWN"), ("language", "und", None, "BCP47", "UNKNOWN"), ("language", "EN-us-x9", "en-US", "BCP47", "EXACT"),
    ("language", "iw-IL", "he-IL", "BCP47", "EXACT"), ("language", "art-lojban", "jbo", "BCP47", "EXACT"), ("language", "zh-cmn-hans", "cmn-Hans", "BCP47", "EXACT"), ("language", "de-1996", "de-1996", "BCP47", "EXACT"), ("language", "es-419", "es-419", "BCP47", "EXACT"),
    ("identifier:isbn", "0-306-40615-2", "0306406152", "ISBN_10", "EXACT"), ("identifier:isbn-10", "080442957x", "080442957X", "ISBN_10", "EXACT"), ("identifier:isbn", "9780306406157", None, "ISBN_10", "UNKNOWN"),
    ("identifier:isbn13", "978 0306406157", "9780306406157", "ISBN_13", "EXACT"), ("identifier:isbn13", "9780000000000", None, "ISBN_13", "UNKNOWN"), ("identifier:isbn-13", "1234567890128", "1234567890128", "ISBN_13", "EXACT"),
    ("identifier:doi", "10.1000/ABC", "10.1000/abc", "DOI", "EXACT"), ("identifier:doi", "11.1000/abc", None, "DOI", "UNKNOWN"), ("identifier:doi", "10.1000/a b", None, "DOI", "UNKNOWN"),
    ("identifier:uuid", "1-2-3-4-ABC", "00000001-0002-0003-0004-000000000abc", "UUID", "EXACT"), ("identifier:uuid", "no-uuid", None, "UUID", "UNKNOWN"),
    ("identifier:uri", "http://h/a/./b/../c", "http://h/a/c", "URI", "EXACT"), ("identifier:url", "http://h/../a//b", "http://h/../a/b", "URI", "EXACT"), ("identifier:uri", "relative/x", None, "URI", "UNKNOWN"), ("identifier:uri", "http://h/a b", None, "URI", "UNKNOWN"),
    ("identifier:uri", "http://h/%zz", None, "URI", "UNKNOWN"), ("identifier:uri", "urn:isbn:1", "urn:isbn:1", "URI", "EXACT"), ("identifier:uri", "http://h/\u00e9", "http://h/%C3%A9", "URI", "EXACT"), ("identifier:uri", "http://h/a/b/..", "http://h/a/", "URI", "EXACT"),
    ("identifier:source", "any  thing", "any thing", "SOURCE_LOCAL", "HIGH"), ("identifier:Source_Local", "x", "x", "SOURCE_LOCAL", "HIGH"), ("identifier:source:id", "x", "x", "OTHER", "UNKNOWN"), ("identifier:shelf", "x  1", "x 1", "OTHER", "UNKNOWN"),
)


def test_normalised_values(spark):
    given = spark.createDataFrame([(f, o) for f, o, *_ in NORMALISED], "field string, value string")
    found = {(r.field, r.observed): (r.value, r.type, r.confidence) for r in evidence.facts(given).collect()}
    assert found == {(f, o): tuple(rest) for f, o, *rest in NORMALISED}
