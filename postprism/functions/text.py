"""Text cleaning, title rules and whole-word patterns as column expressions."""

from __future__ import annotations

import html
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters Python's str.strip() removes.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Titles that belong to the analysed roles.
ROLE_TERMS = (
    "data analyst",
    "analyst",
    "analytics",
    "business intelligence",
    "bi developer",
    "data scientist",
    "data engineer",
)

# First phrase found in a title decides its role.
TITLE_RULES = (
    ("data analyst", "Data Analyst"),
    ("business intelligence", "Business Analyst"),
    ("bi developer", "Business Analyst"),
    ("business analyst", "Business Analyst"),
    ("data scientist", "Data Scientist"),
    ("data engineer", "Data Engineer"),
    ("analy", "Data Analyst"),
)
OTHER_ROLE = "Other"


def strip_space(column: Column) -> Column:
    """Remove white space of every kind at both ends (SQL ``trim`` removes blanks only)."""
    return F.btrim(column, F.lit(WHITE_SPACE))


def clean_text(column: Column) -> Column:
    """Trimmed text, blank as NULL."""
    return F.nullif(strip_space(column), F.lit(""))


# Fixed value: what Python's html.unescape() takes for a character reference, each on its own.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@F.pandas_udf(T.ArrayType(T.StringType()))
def _decode_references(lists: pd.Series) -> pd.Series:
    return lists.map(lambda references: [html.unescape(one) for one in references], na_action="ignore")


def strip_markup(column: Column) -> Column:
    """Markup to plain text: tags become blanks, character references are decoded, ends are trimmed.

    Spark has no function for HTML character references. Only the references themselves are sent to the Arrow helper, so its
    memory does not depend on the texts' length; what lies between them stays in the JVM.
    """
    untagged = F.regexp_replace(F.coalesce(column, F.lit("")), "<[^>]+>", " ")
    references = F.regexp_extract_all(untagged, F.lit(REFERENCE), F.lit(0))
    decoded = _decode_references(F.when(F.size(references) > 0, references))
    between = F.split(untagged, REFERENCE, -1)
    whole = F.array_join(F.zip_with(between, decoded, lambda text, one: F.concat(text, F.coalesce(one, F.lit("")))), "")
    return strip_space(F.coalesce(whole, untagged))


def joined(items: Column) -> Column:
    """List as text with ``|`` between items; an empty or missing list is NULL."""
    return F.nullif(F.array_join(items, "|"), F.lit(""))


def whole_word_pattern(terms: Sequence[str]) -> str:
    """Pattern for any of the terms as whole words, case-blind, with Unicode letters as word characters."""
    words = "|".join(re.escape(term) for term in terms)
    return rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:{words})(?![\p{{L}}\p{{N}}_])"


def matches_role(title: Column, terms: Sequence[str] = ROLE_TERMS) -> Column:
    """True where a title is present and holds one of the terms as a whole word."""
    return title.isNotNull() & (title != "") & title.rlike(whole_word_pattern(terms))


def classify_title(
    title: Column, rules: Sequence[tuple[str, str]] = TITLE_RULES, other: str = OTHER_ROLE
) -> Column:
    """Role of a title by ordered rules: the first phrase it contains decides."""
    lowered = F.lower(title)
    role = None
    for phrase, name in rules:
        hit = lowered.contains(phrase)
        role = F.when(hit, F.lit(name)) if role is None else role.when(hit, F.lit(name))
    return F.lit(other) if role is None else role.otherwise(F.lit(other))
