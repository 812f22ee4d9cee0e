"""Licence scans by canonical digests.

A text is brought to a canonical form: lower case, copyright lines dropped, equivalent spellings
made one, everything but letters and digits reduced to single spaces. The SHA-256 of the canonical
form of an entire text is joined to the digests of known licence texts; lines are looked up likewise
among the digests of known one-line notices. Both tables are fixed and small, so the join is a
broadcast and no row is shuffled. Only Spark expressions are used.

A text or line is only brought to canonical form if it holds a word that every known text holds, as
is asserted when the tables are built; others cannot match.

Defined results: a null text matches nothing; null and repeated ids are scanned row by row; an empty
table gives an empty result; other columns are not read. Texts are hashed whole.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import text_or_empty
from basketry.llm.licence_texts import DIGESTS, NOTICES, TEXTS

#: Every known text holds one of these, every known notice the first; fixed values.
HINTS = ("licen", "permission", "redistribution", "public domain", "warrant")
#: Spellings that count as one; fixed values.
SPELLINGS = (
    ("licence", "license"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("non commercial", "noncommercial"), ("sub license", "sublicense"),
    ("merchantibility", "merchantability"), ("copyright holder", "copyright owner"), ("https", "http"),
)
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(?:copyright\b[^\n]*?(?:\(c\)|©|[0-9]{4})|\(c\)\s*[0-9]{4}|©|all rights reserved)[^\n]*$"

#: The form of a licence at the end of its name.
FORM = r" \((.*)\)$"


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " "), r"[^\p{L}\p{N}]+", " ")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(out)


def canonical_of(text: str) -> str:
    """The same for one text on the driver, for the tables."""
    out = re.sub(r"[\W_]+", " ", re.sub(COPYRIGHT_LINE, " ", text.lower()))
    for a, b in SPELLINGS:
        out = out.replace(a, b)
    return out.strip(" ")


def digest_table(texts: dict[str, str], hints: tuple[str, ...]) -> dict[str, str]:
    """Digest to licence name."""
    for name, text in texts.items():
        if not any(h in text.lower() for h in hints):
            raise ValueError(f"{name} holds none of the words {hints}")
    return {hashlib.sha256(canonical_of(t).encode()).hexdigest(): n for n, t in texts.items()}


def _holds(text: Column, hints: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for h in hints:
        out = out | F.contains(F.lower(text), F.lit(h))
    return out


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", texts: dict[str, str] = TEXTS, notices: dict[str, str] = NOTICES, digests: dict[str, str] = DIGESTS) -> DataFrame:
    """doc_id, license_id (of an entire text, else null), license_form (the wording in which it stands, such as titled or terms; else null), notices (names of notice lines, sorted, comma-joined) and n_notice_lines.

    A name in the tables is an identifier, and in parentheses its form, if it is not the plain text.
    """
    known, lines_known = digest_table(texts, HINTS) | digests, digest_table(notices, HINTS[:1])
    whole = docs.sparkSession.createDataFrame(sorted(known.items()), "known_digest string, license_id string")
    name_of = F.create_map(*(F.lit(x) for pair in sorted(lines_known.items()) for x in pair))
    text = F.col("text")
    hinted = F.filter(F.split(text, "\n"), lambda s: F.contains(F.lower(s), F.lit(HINTS[0])))
    found = F.filter(F.transform(hinted, lambda s: F.try_element_at(name_of, F.sha2(canonical(s), 256))), lambda n: n.isNotNull())
    named = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).select(
        "doc_id",
        F.when(_holds(text, HINTS), F.sha2(canonical(text), 256)).alias("digest"),
        F.when(F.contains(F.lower(text), F.lit(HINTS[0])), found).otherwise(F.array().cast("array<string>")).alias("found"),
    )
    # The table of known digests is fixed, a few kilobytes.
    joined = named.join(F.broadcast(whole), F.col("digest") == F.col("known_digest"), "left")
    form = F.nullif(F.regexp_extract("license_id", FORM, 1), F.lit(""))
    return joined.select("doc_id", F.regexp_replace("license_id", FORM, "").alias("license_id"), form.alias("license_form"), F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices"), F.size("found").cast("long").alias("n_notice_lines"))
