"""Text functions: tokens, query terms, segment ids, checksums, finding categories, lines."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The Han blocks whose runs become single characters and adjacent pairs.
HAN_BLOCKS = (
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF),
    (0x2CEB0, 0x2EBEF), (0x2EBF0, 0x2EE5F), (0x2F800, 0x2FA1F), (0x30000, 0x3134F), (0x31350, 0x323AF), (0x323B0, 0x3347F),
)
HAN = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in HAN_BLOCKS)
#: Python's line boundaries besides CR LF.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"


@F.pandas_udf(T.StringType())
def _compatible(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x).casefold(), na_action="ignore")


@F.pandas_udf(T.StringType())
def composed(s: pd.Series) -> pd.Series:
    """Canonical composition (NFC)."""
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def normalized(text: Column) -> Column:
    """Compatibility form and case folding; plain ASCII stays in the JVM."""
    return F.when(text.rlike(r"^\p{ASCII}*$"), F.lower(text)).otherwise(_compatible(F.when(~text.rlike(r"^\p{ASCII}*$"), text)))


def folded(text: Column) -> Column:
    """Drops single diacritics from Latin letters, as the search index does: é and e meet, ế keeps its two marks."""
    pairs = [(chr(c), d[0]) for c in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFD", chr(c))) == 2 and d[0].isascii() and d[0].isalpha()]
    return F.translate(text, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def tokenize(text: Column, normal: bool = False) -> Column:
    """array<string>: runs of letters and numbers; a Han run gives its characters, then all adjacent pairs.  Null gives none."""
    t = text if normal else normalized(text)
    runs = F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(rf"[{HAN}]+|[\p{{L}}\p{{N}}&&[^{HAN}]]+"), 0)

    def expand(run: Column) -> Column:
        n = F.length(run)
        singles = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(run, i, F.lit(1)))
        pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr(run, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        return F.when(run.rlike(rf"^[{HAN}]"), F.concat(singles, pairs)).otherwise(F.array(run))

    return F.flatten(F.transform(runs, expand))


def normalize_query(text: Column) -> Column:
    """A grep query in normal form, null if it holds no letter or number."""
    n = normalized(text)
    return F.when(n.rlike(r"[\p{L}\p{N}]"), n)


def segment_id(object_id: Column, section_id: Column, ordinal: Column) -> Column:
    """seg_ and the SHA-256 of the four parts joined by NUL bytes."""
    nul = F.unhex(F.lit("00"))
    parts = [F.encode(p, "utf-8") for p in (F.lit("segment-v1"), object_id, section_id, ordinal.cast("string"))]
    return F.concat(F.lit("seg_"), F.sha2(F.concat(parts[0], nul, parts[1], nul, parts[2], nul, parts[3]), 256))


def checksum(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


#: Fixed values in it: the patterns that sort codes into categories.
def finding_category(code: Column) -> Column:
    """The first rule that fits: security, relation, reference, parse, else contract."""
    return (
        F.when(code.rlike("PATH|UNSAFE"), "security")
        .when(code.rlike("^(RELATION|LITERATURE|SYNTHESIS)"), "relation")
        .when(code.rlike("^(FACT|AI_|SNIPPET_SOURCE)|MISSING"), "reference")
        .when(code.rlike("^(FRONTMATTER|FIELD|SECTION|NOTE_BLOCK)"), "parse")
        .otherwise("contract")
    )


def lines(text: Column) -> Column:
    """Lines as Python's splitlines gives them; an ending at the very end adds none."""
    cut = F.split(text, LINE_BREAK)
    last = F.element_at(cut, -1)
    return F.when(last == "", F.slice(cut, 1, F.greatest(F.size(cut) - 1, F.lit(0)))).otherwise(cut)


def object_kind(object_id: Column) -> Column:
    """source, note, snippet or ai_artifact by the id's prefix, null if the id is malformed."""
    kind = F.create_map(*(F.lit(x) for x in ("src", "source", "note", "note", "snip", "snippet", "ai", "ai_artifact")))
    return F.when(is_object_id(object_id), kind[F.regexp_extract(object_id, "^([a-z]+)_", 1)])


def is_object_id(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^(src|note|snip|ai)_[0-9A-HJKMNP-TV-Z]{26}\z"), F.lit(False))


def is_section_id(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^sec_[a-z0-9][a-z0-9_-]{2,63}\z"), F.lit(False))
