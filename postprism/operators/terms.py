"""Which terms of a vocabulary occur in a text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postprism.operators.lookup import fits_broadcast, lookup_join
from postprism.session import materialise

# Terms that are also ordinary words.
AMBIGUOUS = (
    "r", "c", "go", "ai", "bi", "word", "flow", "sheets", "access", "express",
    "unify", "sas", "swift", "ruby", "julia", "dart", "crystal", "chef", "puppet",
)

# Signs that may not stand before and after a term.
_BEFORE, _AFTER = "[a-z0-9+#.]", "[a-z0-9+#]"

# Up to this many distinct anchors the vocabulary is sent to every executor.
BROADCAST_TERMS = 50_000


def usable_vocabulary(vocabulary: DataFrame, term: str = "skills", ambiguous: Iterable[str] = AMBIGUOUS) -> DataFrame:
    """Drop ambiguous words and terms of one or two letters."""
    too_short = (F.length(term) < 3) & F.col(term).rlike(r"^\p{L}+$")
    return vocabulary.where(~F.col(term).isin(list(ambiguous)) & ~too_short)


def _folded(text: Column) -> Column:
    """Lower case, with the letters that match i, s or k case-blind written as these."""
    return F.lower(F.translate(text, "\u0130\u0131\u017f\u212a", "iisk"))


# Texts and terms are cut into words, runs of these letters and digits, and what lies between them, which is kept exactly.
_WORD, _BETWEEN = "[a-z0-9]+", "[^a-z0-9]+"
# What a place next to a match may not be: some letter or digit, written as "a", or a sign of a name. "\0" is the text's end.
_NOT_BEFORE, _NOT_AFTER, _END = "a+#.", "a+#", "\0"
# A word that no sign of a name touches is marked, as it needs no further look. A token has the signs that touch it.
_MARK, _TOKEN = "\1", f"(?<![a-z0-9+#.])[+#.]*[a-z0-9]+[+#]?"

# Up to this many distinct strings between two words of a term, other ones are not looked at in texts; likewise words with signs and first signs.
KNOWN = 1_000


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _BETWEEN), lambda word: word != "")


def _gaps(text: Column) -> Column:
    """What lies before, between and after the words: one more than these."""
    return F.split(text, _WORD)


def _signs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _term_keys(vocabulary: DataFrame) -> DataFrame:
    """``(key, skill_id, at, keys, before, after)``: what a text must hold for a term to occur, one row per key of the term.

    A term that is one word has the marked word as its key. Of other terms, one word with signs has the word, several words every two
    neighbouring ones with what lies between them, and signs alone the sign or every two neighbouring signs. ``before`` and ``after``
    are the signs such a term has at its ends, on the rows of its first and last key.
    """
    terms = vocabulary.where(F.trim("skills").rlike(r"[^\s]")).select("skill_id", _folded(F.trim("skills")).alias("term"))
    cut = terms.select("skill_id", _words(F.col("term")).alias("words"), _gaps(F.col("term")).alias("gaps"), _signs(F.col("term")).alias("signs"))
    of_signs = F.size("words") == 0
    cut = cut.select(
        "skill_id",
        F.when(of_signs, F.col("signs")).otherwise(F.col("words")).alias("parts"),
        F.when(of_signs, F.array_repeat(F.lit(""), F.size("signs") + 1)).otherwise(F.col("gaps")).alias("gaps"),
    )
    part, gap = (lambda at: F.get("parts", at)), (lambda at: F.get("gaps", at))
    keys = F.greatest(F.size("parts") - 1, F.lit(1))
    rows = cut.withColumn("keys", keys).select("*", F.explode(F.sequence(F.lit(0), F.col("keys") - 1)).alias("at"))
    pair = F.concat(part(F.col("at")), gap(F.col("at") + 1), part(F.col("at") + 1))
    whole = (F.size("parts") == 1) & part(F.lit(0)).rlike(_WORD) & (F.concat_ws("", "gaps") == "")
    return rows.select(
        F.when(whole, F.concat(F.lit(_MARK), part(F.lit(0)))).when(F.size("parts") == 1, part(F.lit(0))).otherwise(pair).alias("key"),
        "skill_id",
        "at",
        "keys",
        F.when((F.col("at") == 0) & ~whole, gap(F.lit(0))).alias("before"),
        F.when((F.col("at") == F.col("keys") - 1) & ~whole, gap(F.size("gaps") - 1)).alias("after"),
    )


def _place_rows(folded: DataFrame, ends: int, words: list[str] | None, gaps: list[str] | None, signs: str) -> DataFrame:
    """``(_id, _text, at, key, before, after)``: the index of each text.

    Every word that no sign of a name touches, once and marked, without a place; and the places that only some terms need: ``words``
    with the signs beside them, two neighbouring words with one of ``gaps`` between them (None: any), and signs that ``signs`` matches,
    alone and with the next one. Of the signs before and after, ``ends`` and one more are kept, so a row is short whatever the
    text. Places count words, or signs of what lies between two words.
    """
    cut = folded.select(
        "_id",
        "_text",
        F.array_distinct(F.regexp_extract_all("_folded", F.lit(_TOKEN), F.lit(0))).alias("tokens"),
        _words(F.col("_folded")).alias("words"),
        _gaps(F.col("_folded")).alias("gaps"),
    )
    kind = "array<struct<at:bigint,key:string,before:string,after:string>>"
    none = F.lit(None).cast("string")
    found = F.transform(
        "tokens", lambda one: F.struct(F.lit(None).cast("long").alias("at"), F.concat(F.lit(_MARK), one).alias("key"), none.alias("before"), none.alias("after"))
    ).cast(kind)
    n = F.size("words")
    gap, word = (lambda at: F.get("gaps", at)), (lambda at: F.get("words", at))

    def before(at: Column) -> Column:
        return F.right(F.concat(F.when(at == 0, _END).otherwise("a"), gap(at)), F.lit(ends + 1))

    def after(at: Column) -> Column:
        return F.left(F.concat(gap(at + 1), F.when(at + 1 == n, _END).otherwise("a")), F.lit(ends + 1))

    def places(size: int, key: Callable[[Column], Column], known: Column | None, values: list[str] | None) -> Column:
        at = F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))
        some = at if values is None else F.filter(at, lambda i: known(i).isin(values))
        return F.transform(
            some, lambda i: F.struct(i.cast("long").alias("at"), key(i).alias("key"), before(i).alias("before"), after(i + size - 1).alias("after"))
        ).cast(kind)

    if words is None or words:
        found = F.concat(found, places(1, word, word, words))
    if gaps is None or gaps:
        found = F.concat(found, places(2, lambda at: F.concat(word(at), gap(at + 1), word(at + 1)), lambda at: gap(at + 1), gaps))
    if signs:
        found = F.concat(found, _sign_places(n, gap, signs).cast(kind))
    return cut.select("_id", "_text", F.explode(found).alias("p")).select("_id", "_text", "p.*")


def _sign_places(n: Column, gap: Callable[[Column], Column], signs: str) -> Column:
    """The places of signs between words, each alone and with the next sign."""
    some = F.filter(F.sequence(F.lit(0), n), lambda at: gap(at).rlike(signs))

    def places(at: Column) -> Column:
        own = _signs(gap(at))
        size = F.size(own)
        previous = lambda i: F.when(i > 0, F.get(own, i - 1)).when(at == 0, _END).otherwise("a")
        following = lambda i: F.when(i < size, F.get(own, i)).when(at == n, _END).otherwise("a")
        number = lambda i: F.shiftleft(at.cast("long"), 32) + i
        one = lambda i: F.struct(number(i).alias("at"), F.get(own, i).alias("key"), previous(i).alias("before"), following(i + 1).alias("after"))
        two = lambda i: F.struct(
            number(i).alias("at"), F.concat(F.get(own, i), F.get(own, i + 1)).alias("key"), previous(i).alias("before"), following(i + 2).alias("after")
        )
        return F.flatten(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.when(i < size - 1, F.array(one(i), two(i))).otherwise(F.array(one(i)))))

    return F.flatten(F.transform(some, places))


def extract_terms(
    texts: DataFrame,
    vocabulary: DataFrame,
    id_column: str,
    text_column: str = "text",
    broadcast_terms: int = BROADCAST_TERMS,
) -> DataFrame:
    """Pairs (id, skill_id) of a text and a term found in it, each pair once.

    ``vocabulary`` holds skill_id and skills (the term). Texts become an index of short rows: their distinct words, and the places of those
    neighbouring words, signs and words with signs that some term has. It meets the terms' keys by equality, so cost follows the matches, not texts x terms, and overlapping terms
    are all found. A term of more than two words occurs where all its keys lie at their distances from one place: the matches are
    counted per (text, place - distance, term). Matches are stored once, so no text is read again or shuffled, and no pattern is run per term. The keys are
    broadcast within a checked size; beyond it the index rows are shuffled by key, heavy keys apart, with the same result. Texts
    with a NULL id or text are left out; texts with one id are taken together, but a term lies within one of them.
    """
    terms = materialise(_term_keys(vocabulary), "term-keys")
    has_word, marked = F.col("key").rlike(_WORD), F.startswith("key", F.lit(_MARK))
    between = F.regexp_extract("key", _BETWEEN, 0)

    def some(values: Column) -> Column:
        return F.slice(F.collect_set(values), 1, KNOWN + 1)

    kinds = terms.agg(
        some(F.when(has_word & ~marked & (between == ""), F.col("key"))).alias("words"),
        some(F.when(has_word & ~marked & (between != ""), between)).alias("gaps"),
        some(F.when(~has_word, F.left("key", F.lit(1)))).alias("signs"),
        F.max(F.greatest(F.length("before"), F.length("after"))).alias("ends"),
        F.max("keys").alias("keys"),
    ).first()
    folded = texts.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("_id"), _folded(F.col(text_column)).alias("_folded"))
    folded = folded.withColumn("_text", F.xxhash64("_folded") if (kinds["keys"] or 0) > 1 else F.lit(0).cast("long"))
    words, gaps = (kinds[name] if len(kinds[name]) <= KNOWN else None for name in ("words", "gaps"))
    signs = "|".join(re.escape(sign) for sign in sorted(kinds["signs"])) if len(kinds["signs"]) <= KNOWN else r"[^\s]"
    rows = _place_rows(folded, kinds["ends"] or 0, words, gaps, signs)
    wanted = terms.groupBy("key").agg(F.collect_set(F.struct("skill_id", "at", "keys", "before", "after")).alias("terms"))

    def sign(text: str, at: Column) -> Column:
        return F.substring(F.col(text), at, F.lit(1))

    def fits(term: Column) -> Column:
        """Whether the place has the term's own signs and nothing of a name beside them."""
        first, last = term["before"], term["after"]
        starts = F.endswith("before", first) & ~F.contains(F.lit(_NOT_BEFORE), sign("before", F.length("before") - F.length(first)))
        ends = F.startswith("after", last) & ~F.contains(F.lit(_NOT_AFTER), sign("after", F.length(last) + 1))
        return (first.isNull() | starts) & (last.isNull() | ends)

    # Inside the array, before it is exploded: as a filter of its own it would make the stage's code too large to be compiled.
    if not fits_broadcast(wanted, broadcast_terms):
        rows = materialise(rows, "term-places")  # read several times: to find heavy keys, with them and without
    fitting = F.when(F.col("at").isNull(), F.col("terms")).otherwise(F.filter("terms", fits))
    met = lookup_join(rows, wanted, "key", broadcast_terms).select("_id", "_text", "at", F.explode(fitting).alias("term"))
    met = met.select("_id", "_text", (F.col("at") - F.col("term.at")).alias("place"), "term.*")
    if (kinds["keys"] or 0) > 1:
        met = materialise(met, "term-matches")  # read twice: terms of one key and of several
    found = met.where("keys = 1").select("_id", "skill_id")
    if (kinds["keys"] or 0) > 1:
        longer = met.where("keys > 1").groupBy("_id", "_text", "place", "skill_id").agg(F.size(F.collect_set("at")).alias("n"), F.first("keys").alias("keys"))
        found = found.unionByName(longer.where("n = keys").select("_id", "skill_id"))
    return found.distinct().select(F.col("_id").alias(id_column), "skill_id")
