"""Text functions as Column builders: suffix strategies, clitic detection and resolution, sensitivity counts.

Word characters are letters, digits and underscore of any script. Suffix functions take ``suffix``; -nya is the default.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[\p{L}\p{N}_]"
#: Leading question and function words that don't name an entity.
QUERY_STOPWORDS = ["Apa", "Siapa", "Kapan", "Mengapa", "Bagaimana", "Berapa", "Mana", "Di", "Dari", "Ke", "Yang", "Pada", "Untuk", "Dengan", "Dalam", "Adalah", "Akan", "Itu", "Ini"]
#: Fixed value: what counts as a run of capitalised words. Repetitions are possessive: nothing behind them could use what
#: they give back, and a repeated group that may give back costs a stack frame of the JVM a character.
_CAPITALISED = r"[A-Z][\p{L}\p{N}_À-ÿ]*+"
_ENTITY = rf"(?<!{WORD}){_CAPITALISED}(?:\s++{_CAPITALISED})*+"
_SENTENCE = r"[^.!?]+[.!?]?"


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(text: Column) -> Column:
    """Canonical composition. Spark has no such function; ASCII texts, which it can't change, don't leave the JVM."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _nfc(F.when(text.rlike(r"[^\x00-\x7F]"), text))).otherwise(text)


def tokens(text: Column) -> Column:
    """Lower-cased words; the default analyzer."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD}+)"), 1)


def keep(text: Column) -> Column:
    return text


def naive_strip(text: Column, suffix: str = "nya") -> Column:
    """Each word that is longer than the suffix and ends with it, in any case, loses it."""
    return F.regexp_replace(text, rf"(?iu)({WORD}+?){suffix}(?!{WORD})", "$1")


def sentinel(text: Column, suffix: str = "nya", mark: str = "<NYA>") -> Column:
    """As ``naive_strip``, with a mark in the suffix's place."""
    return F.regexp_replace(text, rf"(?iu)({WORD}+?){suffix}(?!{WORD})", f"$1 {mark}")


def suffix_remover(token: Column, suffix: str = "nya") -> Column:
    return F.when(F.lower(token).endswith(suffix) & (F.length(token) > len(suffix)), F.left(token, F.length(token) - len(suffix))).otherwise(token)


def pronoun_remover(token: Column) -> Column:
    """Drops a final -ku, -mu or -nya with the hyphens before it."""
    return F.regexp_replace(token, r"-*(ku|mu|nya)$", "")


def spaced(text: Column) -> Column:
    """Tokens between white space."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def guarded_clitic(text: Column, known: Column, remover=suffix_remover) -> Column:
    """Tokens lose their clitic where what remains is in ``known`` (array of lower-cased roots); joined by one space."""

    def one(token: Column) -> Column:
        bare = remover(token)
        return F.when(F.array_contains(known, F.lower(bare)), bare).otherwise(token)

    return F.array_join(F.transform(spaced(text), one), " ")


def clitic_candidates(text: Column, remover=suffix_remover) -> Column:
    """Lower-cased stems that ``guarded_clitic`` would look up, distinct; tokens without a clitic are left out."""
    return F.array_distinct(F.transform(F.filter(spaced(text), lambda t: remover(t) != t), lambda t: F.lower(remover(t))))


def host_candidates(text: Column, suffix: str = "nya") -> Column:
    """Lower-cased stems that the resolver would look up, distinct."""
    found = F.regexp_extract_all(text, F.lit(rf"(?i)(?<!{WORD})([A-Za-zÀ-ÿ]+){suffix}(?!{WORD})"), F.lit(1))
    return F.array_distinct(F.transform(found, F.lower))


def with_known(df: DataFrame, roots: DataFrame, candidates: Column, key: str, name: str = "known") -> DataFrame:
    """``df`` with array ``name``: those of a row's candidates that are in ``roots`` (column root). ``key`` is unique.

    Candidates, not texts, are joined to the dictionary, so its size is no matter; Spark broadcasts it if it is small.
    Its roots aren't made distinct first: behind such a step Spark doesn't divide the rows of a frequent stem.
    """
    lookups = df.select(key, F.explode(candidates).alias("_root"))
    found = lookups.join(roots.select(F.lower("root").alias("_root")), "_root", "left_semi")
    sets = found.groupBy(key).agg(F.collect_set("_root").alias(name))
    return df.join(sets, key, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def sentences(text: Column) -> Column:
    """Trimmed sentences that aren't blank."""
    pieces = F.transform(F.regexp_extract_all(text, F.lit(_SENTENCE), F.lit(0)), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    return F.filter(pieces, lambda s: s != "")


def entities(text: Column) -> Column:
    """Runs of capitalised words."""
    return F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0))


def antecedent(left: Column, suffix: str = "nya", window: int = 2) -> Column:
    """Of the last ``window`` sentences of ``left``, newest first, the first run of capitalised words that doesn't end
    with the suffix. All sentences count if ``window`` isn't positive."""
    newest = F.reverse(sentences(left))
    if window > 0:
        newest = F.slice(newest, 1, window)
    found = F.flatten(F.transform(newest, lambda s: F.filter(entities(s), lambda e: ~F.lower(e).endswith(suffix))))
    return F.get(found, 0)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _named(sentence: Column, suffix: str) -> Column:
    """What ``antecedent`` can still see of a sentence that may go on: its first run of capitalised words that doesn't end
    with the suffix; before there is one, a run at its end, which may grow. A comma stands for all the rest."""
    bare = F.rtrim(sentence, F.lit(" \t\n\x0b\f\r"))
    stop = F.regexp_extract(sentence, r"[.!?]$", 0)

    def core(runs: Column) -> Column:
        last = F.get(runs, F.size(runs) - 1)
        grows = F.coalesce(bare.endswith(last) & ~F.substring(bare, -F.length(last) - 1, F.lit(1)).rlike(WORD), F.lit(False))
        first = F.get(F.filter(F.when(grows, F.slice(runs, 1, F.size(runs) - 1)).otherwise(runs), lambda e: ~F.lower(e).endswith(suffix)), 0)
        end = F.when(grows, F.right(sentence, F.length(last) + F.length(sentence) - F.length(bare))).otherwise(F.lit(","))
        return F.coalesce(F.concat(first, F.lit(",")), end)

    return F.when(sentence.rlike(r"(?U)\S"), F.concat(_let(entities(sentence), core), stop)).otherwise(sentence)


def _cut(text: Column, word: str, suffix: str, window: int, hosts: Column | None = None, names_only: bool = False) -> Column:
    """``text`` cut before each word of class ``word`` that ends with the suffix: array of (piece, left, at). With
    ``hosts`` (lower-cased letters) only words that have one of them before the suffix count.

    left is what stands before the piece, as far back as ``window`` + 1 sentences that aren't blank (all of it if
    ``window`` isn't positive), so that a long text costs its length and not its square; at is the piece's offset. With
    ``names_only`` these sentences hold what ``antecedent`` needs, so that a long sentence costs its length too.
    """
    if hosts is None:
        pieces = F.split(text, rf"(?i)(?<!{WORD})(?={word}+{suffix}(?!{WORD}))")
    else:
        pieces = F.split(text, F.concat(F.lit(rf"(?iu)(?<!{WORD})(?=(?:"), F.array_join(hosts, "|"), F.lit(rf"){suffix}(?!{WORD}))")))
    start = F.struct(F.lit("").alias("tail"), F.lit(0).alias("at"), F.array().cast("array<struct<piece:string,left:string,at:int>>").alias("out"))

    def trimmed(chunks: Column) -> Column:
        filled = F.filter(F.sequence(F.lit(0), F.size(chunks)), lambda i: F.trim(F.coalesce(F.get(chunks, i), F.lit(""))) != "")
        last = _let(filled, lambda f: F.when(F.size(f) > window, F.slice(chunks, F.get(f, F.size(f) - window - 1) + 1, F.size(chunks))).otherwise(chunks))
        return F.array_join(F.transform(last, lambda s: _named(s, suffix)) if names_only else last, "")

    def step(state: Column, piece: Column) -> Column:
        whole = F.concat(state["tail"], piece)
        tail = _let(F.regexp_extract_all(whole, F.lit(_SENTENCE), F.lit(0)), trimmed) if window > 0 else whole
        entry = F.struct(piece.alias("piece"), state["tail"].alias("left"), state["at"].alias("at"))
        return F.struct(tail.alias("tail"), (state["at"] + F.length(piece)).alias("at"), F.array_append(state["out"], entry).alias("out"))

    return F.aggregate(pieces, start, step, lambda state: state["out"])


def _detected(text: Column, known: Column, suffix: str, window: int, tagger: Callable[[Column], Column] | None) -> Column:
    """The pieces of ``text`` in their order: array of (piece, o), where o is null or the occurrence it begins with."""
    shape = rf"(?i)^(([A-Za-zÀ-ÿ]+){suffix})(?!{WORD})"

    def one(c: Column) -> Column:
        token, host = F.regexp_extract(c["piece"], shape, 1), F.regexp_extract(c["piece"], shape, 2)

        def labelled(found: Column) -> Column:
            kind = F.when(found.isNotNull(), "anaphoric").otherwise("possessive")
            if tagger:
                kind = F.when(tagger(host) == "VERB", "nominaliser").otherwise(kind)
            return F.struct(c["at"].alias("start"), (c["at"] + F.length(token)).alias("stop"), token.alias("token"), host.alias("host"), host.alias("root"), found.alias("antecedent"), kind.alias("function"))

        return F.struct(c["piece"].alias("piece"), F.when(F.array_contains(known, F.lower(host)), _let(antecedent(c["left"], suffix, window), labelled)).alias("o"))

    return F.transform(_cut(text, "[A-Za-zÀ-ÿ]", suffix, window, known, names_only=True), one)


def occurrences(text: Column, known: Column, suffix: str = "nya", window: int = 2, tagger: Callable[[Column], Column] | None = None) -> Column:
    """Clitic occurrences whose root is known: array of (start, stop, token, host, root, antecedent, function).

    The context of an occurrence is all text to its left. function: nominaliser where ``tagger`` (from a root to its
    part of speech) says VERB, else anaphoric with an antecedent, else possessive.
    """
    return F.transform(F.filter(_detected(text, known, suffix, window, tagger), lambda d: d["o"].isNotNull()), lambda d: d["o"])


def resolved(text: Column, known: Column, suffix: str = "nya", window: int = 2, tagger: Callable[[Column], Column] | None = None) -> Column:
    """Each anaphoric occurrence gives way to its root and antecedent; a text without known roots stays as it is."""

    def written(d: Column) -> Column:
        rest = F.substring(d["piece"], F.length(d["o"]["token"]) + 1, F.length(d["piece"]))
        return F.when(d["o"]["function"] == "anaphoric", F.concat(d["o"]["root"], F.lit(" "), d["o"]["antecedent"], rest)).otherwise(d["piece"])

    whole = F.array_join(F.transform(_detected(text, known, suffix, window, tagger), written), "")
    return F.when(F.size(known) == 0, text).otherwise(whole)


def count_suffix(text: Column, suffix: str = "nya") -> Column:
    """Words that end with the suffix and are longer than it."""
    return F.size(F.regexp_extract_all(text, F.lit(rf"(?iu)(?<!{WORD}){WORD}+{suffix}(?!{WORD})"), F.lit(0)))


def _lefts(text: Column, suffix: str, window: int, names_only: bool = False) -> Column:
    clitics = F.filter(_cut(text, WORD, suffix, window, names_only=names_only), lambda c: c["piece"].rlike(rf"(?i)^{WORD}+{suffix}(?!{WORD})"))
    return F.transform(clitics, lambda c: c["left"])


def count_anaphoric(text: Column, suffix: str = "nya", window: int = 2) -> Column:
    """Suffixed words with an antecedent in their window, whatever their root."""
    return F.size(F.filter(_lefts(text, suffix, window, names_only=True), lambda left: antecedent(left, suffix, window).isNotNull()))


def entity_referenced(text: Column, entity: Column, suffix: str = "nya", window: int = 2) -> Column:
    """Whether a suffixed word has ``entity``, as a substring, in a sentence of its window; false without an entity."""
    name = F.trim(entity)
    inside = F.exists(_lefts(text, suffix, window), lambda left: F.exists(F.slice(F.reverse(sentences(left)), 1, window), lambda s: s.contains(name)))
    return F.coalesce(inside & (name != ""), F.lit(False))


def sensitivity(total: Column, anaphoric: Column, referenced: Column, weights: tuple[int, int, int] = (1, 2, 3)) -> Column:
    return weights[0] * total + weights[1] * anaphoric + weights[2] * referenced.cast("int")


def query_entity(query: Column, stopwords: list[str] | None = None) -> Column:
    """The longest run of capitalised words, first of equals, without a leading stopword; null if there is none."""
    stop = F.array(*[F.lit(w) for w in stopwords or QUERY_STOPWORDS])

    def bare(span: Column) -> Column:
        words = F.split(span, r"\s+")
        return F.when(F.array_contains(stop, words[0]), F.array_join(F.slice(words, F.lit(2), F.size(words)), " ")).otherwise(span)

    spans = F.filter(F.transform(F.regexp_extract_all(query, F.lit(_ENTITY + rf"(?!{WORD})"), F.lit(0)), bare), lambda s: s != "")
    return F.aggregate(spans, F.lit(None).cast("string"), lambda best, s: F.when(best.isNull() | (F.length(s) > F.length(best)), s).otherwise(best))


def tertile(value: Column, low: Column, high: Column) -> Column:
    return F.when(value <= low, "low").when(value >= high, "high").otherwise("mid")


def gold_text(passages: Column) -> Column:
    """Passages (title, text) as title, line end, text, with a blank line between them, in their order."""

    def one(p: Column) -> Column:
        title = F.nullif(F.coalesce(p["title"], F.lit("")), F.lit(""))
        return F.concat_ws("\n", title, F.coalesce(p["text"], F.lit("")))

    return F.array_join(F.transform(passages, one), "\n\n")


def first_filled(*columns: Column) -> Column:
    """First of ``columns`` that isn't null or empty as a string."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in columns])


def required(column: Column, message: str) -> Column:
    return F.when(column.isNotNull(), column).otherwise(F.raise_error(F.lit(message)))


def unit_vector(vector: Column) -> Column:
    """A vector over its Euclidean length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
