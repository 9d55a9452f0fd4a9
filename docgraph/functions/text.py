"""Column functions over text: normal forms, keys, terms, grams, titles, dates, JSON answers, tags."""

from __future__ import annotations

import contextlib
import html
import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: date mentions, never parsed.
DATE_MENTION = r"20\d{2}[.년/-]\s*\d{1,2}[.월/-]\s*\d{1,2}일?"
ANSWER = "answer string, citations array<string>, insufficient_evidence boolean"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _form(name: str):
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize(name, x))

    return run


def normalize_ws(c: Column | str, nfc: bool = True) -> Column:
    """NFC, every run of Unicode white space one space, stripped. nfc=False for text known to be NFC: no Python then."""
    c = col(c)
    # U+001C to U+001F count as white space here, which Java's class leaves out
    return F.trim(F.regexp_replace(_form("NFC")(c) if nfc else c, "(?U)[\\s\\x1c-\\x1f]+", " "))


def match_key(c: Column | str, nfkc: bool = True) -> Column:
    """NFKC, lower case, only Hangul syllables, a-z and 0-9 kept. nfkc=False as in normalize_ws."""
    c = col(c)
    # the kept runs joined, which takes a third of the time of replacing all others
    return F.array_join(F.regexp_extract_all(F.lower(_form("NFKC")(c) if nfkc else c), F.lit("[가-힣a-z0-9]+"), F.lit(0)), "")


def content_hash(c: Column | str) -> Column:
    """SHA-256 in hex of a string; other types by their JSON."""
    return F.sha2(col(c).cast("string"), 256)


def terms(c: Column | str) -> Column:
    """w: words of over one letter, then their g: 2-grams and 3-grams, word by word; duplicates stay.

    Words are runs of Hangul, ASCII letters, digits and % in lower case.
    """

    def grams(w: Column, n: int) -> Column:
        all_ = F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.concat(F.lit("g:"), F.substring(w, i, F.lit(n))))
        return F.when(F.length(w) >= n, all_).otherwise(F.array().cast("array<string>"))

    words = F.regexp_extract_all(F.lower(col(c)), F.lit("([가-힣A-Za-z0-9%]+)"), F.lit(0))
    whole = lambda w: F.when(F.length(w) > 1, F.array(F.concat(F.lit("w:"), w))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(words, lambda w: F.concat(whole(w), grams(w, 2), grams(w, 3))))


def char_grams(key: Column | str, n: int = 2) -> Column:
    """Distinct n-grams of a key; none for shorter keys. A lookahead walks the key once, however long it is."""
    return F.array_distinct(F.regexp_extract_all(col(key), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def doc_title(content: Column | str, path: Column | str) -> Column:
    """First line that begins with #, without the marks; else the name of the parent folder. A bare # gives an empty title."""
    line = F.regexp_extract(col(content), r"(?m)^(#[^\n]*)", 1)
    parts = F.split(col(path), "/")
    return F.when(line != "", F.trim(F.regexp_replace(line, r"^#+\s*", ""))).otherwise(F.get(parts, F.size(parts) - 2))


def date_mentions(c: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(col(c), F.lit(f"({DATE_MENTION})"), F.lit(0))))


#: A separator, the last one there is in what is searched.
_LAST_MARK = re.compile(r"(?s).*([\n。 ]|[.;] )")
_INK = re.compile(r"\S")


def cut_text(text: str, limit: int) -> list[str]:
    """Parts of at most limit characters, cut after the last separator of the second half where there is one."""
    out, begin, end = [], 0, len(text)
    while end - begin > limit:
        mark = _LAST_MARK.match(text, begin + limit // 2, begin + limit)
        cut = mark.start(1) + 1 if mark and mark.start(1) > begin else begin + limit
        out.append(text[begin:cut].strip())
        end = len(text.rstrip()) if begin == 0 else end
        ink = _INK.search(text, cut, end)
        begin = ink.start() if ink else end
    return [x for x in (*out, text[begin:end].strip()) if x]


def split_long(c: Column | str, limit: int = 1700) -> Column:
    """cut_text() as an array."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else cut_text(x, limit))

    return run(col(c))


def extract_json_object(c: Column | str) -> Column:
    """The text from the first { to the last }, thoughts and code fences taken off, if it parses as a JSON object; else null."""
    bare = F.regexp_replace(col(c), r"(?s)<think>.*?</think>", "")
    bare = F.trim(F.regexp_replace(bare, r"```(?:json|JSON)?", ""))
    start, back = F.instr(bare, "{"), F.instr(F.reverse(bare), "}")
    body = F.when((start > 0) & (back > 0), F.substring(bare, start, F.length(bare) - back - start + 2))
    return F.when(F.schema_of_variant(F.try_parse_json(body)).startswith("OBJECT"), body)


def json_objects(text: str) -> Iterator[tuple[dict, str]]:
    """The complete JSON objects of a text that lie in no other one, with their source, from left to right."""
    decode, end = json.JSONDecoder().raw_decode, 0
    for brace in re.finditer(r"\{", text):
        if brace.start() >= end:
            with contextlib.suppress(ValueError):
                value, end = decode(text, brace.start())
                yield value, text[brace.start() : end]


def last_answer_object(c: Column | str) -> Column:
    """The last complete JSON object with a string answer and a list of citations; else what extract_json_object finds."""
    kinds = {"answer": str, "citations": list}

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        answers = lambda x: [source for value, source in json_objects(x or "") if all(isinstance(value.get(k), t) for k, t in kinds.items())]
        return s.map(lambda x: next(reversed(answers(x)), None))

    return F.coalesce(run(col(c)), extract_json_object(c))


def strip_tags(c: Column | str, unescape: bool = True) -> Column:
    """Tags replaced by a space, then HTML entities resolved (a Python step that unescape=False leaves out)."""

    @F.pandas_udf("string")
    def resolve(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or "&" not in x else html.unescape(x))

    bare = F.regexp_replace(col(c), r"</?[A-Za-z][^>]*>", " ")
    return resolve(bare) if unescape else bare


def evidence_quote(c: Column | str) -> Column:
    """Quote text of an evidence in JSON: strings as they are, lists joined by line ends, objects by quote or text."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def quote(x: object) -> str:
            if isinstance(x, str):
                return x
            if isinstance(x, list):
                return "\n".join(map(quote, x))
            return quote(x.get("quote") or x.get("text") or "") if isinstance(x, dict) else ""

        def read(x: str | None) -> str:
            try:
                return quote(json.loads(x)) if x is not None else ""
            except ValueError:
                return x

        return s.map(read)

    return run(col(c))


def clean_citations(c: Column | str) -> Column:
    """Each citation stripped, one leading [ and one trailing ] taken off, stripped again."""
    return F.transform(col(c), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^\[|\]$", "")))


def key_contains(part: Column, whole: Column, nfkc: bool = True) -> Column:
    """Whether the key of part is in the key of whole; an empty key is in everything."""
    return F.contains(match_key(whole, nfkc), match_key(part, nfkc))


def wilson_interval(correct: Column | str, total: Column | str, z: float = 1.96) -> Column:
    """struct(low, high) of Wilson's interval; null for total 0."""
    n = col(total).cast("double")
    p = col(correct) / n
    denominator = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / denominator
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / denominator
    return F.when(n > 0, F.struct((centre - half).alias("low"), (centre + half).alias("high")))
