"""Text normalisation and tokenisation as column expressions.

Everything is JVM-side except folding accents and reading spoken numbers, which need Python. The
Arrow function receives NULL for every text the JVM rules already finish, so plain ASCII text
without number words costs no Python work, and no join or shuffle is involved.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import spoken_numbers as spoken

NORMALISER_VERSION = "v1"


def normaliser_version(spellings: Mapping[str, str] | None = None) -> str:
    """The rules and the spelling table, if there is one, by its digest: scores made under
    different versions do not belong in one table."""
    if not spellings:
        return NORMALISER_VERSION
    table = json.dumps(sorted(spellings.items()), ensure_ascii=False)
    return f"{NORMALISER_VERSION}+{hashlib.sha256(table.encode()).hexdigest()[:12]}"


# ---- fixed values: rewrites applied in this order -------------------------------------------
REWRITES = (
    (r"\bwon't\b", "will not"), (r"\bcan't\b", "can not"), (r"\blet's\b", "let us"), (r"\bain't\b", "aint"),
    (r"\by'all\b", "you all"), (r"\bwanna\b", "want to"), (r"\bgotta\b", "got to"), (r"\bgonna\b", "going to"),
    (r"\bi'ma\b", "i am going to"), (r"\bimma\b", "i am going to"), (r"\bwoulda\b", "would have"),
    (r"\bcoulda\b", "could have"), (r"\bshoulda\b", "should have"), (r"\bma'am\b", "madam"),
    (r"\bmr\b", "mister "), (r"\bmrs\b", "missus "), (r"\bst\b", "saint "), (r"\bdr\b", "doctor "),
    (r"\bprof\b", "professor "), (r"\bcapt\b", "captain "), (r"\bgov\b", "governor "), (r"\bald\b", "alderman "),
    (r"\bgen\b", "general "), (r"\bsen\b", "senator "), (r"\brep\b", "representative "), (r"\bpres\b", "president "),
    (r"\brev\b", "reverend "), (r"\bhon\b", "honorable "), (r"\basst\b", "assistant "), (r"\bassoc\b", "associate "),
    (r"\blt\b", "lieutenant "), (r"\bcol\b", "colonel "), (r"\bjr\b", "junior "), (r"\bsr\b", "senior "),
    (r"\besq\b", "esquire "),
    (r"'d been\b", " had been"), (r"'s been\b", " has been"), (r"'d gone\b", " had gone"), (r"'s gone\b", " has gone"),
    (r"'d done\b", " had done"), (r"'s got\b", " has got"),
    (r"n't\b", " not"), (r"'re\b", " are"), (r"'s\b", " is"), (r"'d\b", " would"), (r"'ll\b", " will"),
    (r"'t\b", " not"), (r"'ve\b", " have"), (r"'m\b", " am"),
)
FILLERS = ("hmm", "mm", "mhm", "mmm", "uh", "um")
# ---------------------------------------------------------------------------------------------

_NUMBERISH = r"(?U)\d|(?:^|\s)(?:" + "|".join(sorted(spoken.ROLES)) + r")(?:\s|$)"
_NON_ASCII = r"[^\x00-\x7F]"
_REWRITABLE = r"(?U)'|\b(?:" + "|".join(p.strip("\\b") for p, _ in REWRITES if "'" not in p) + r")\b"
_ASCII_SYMBOLS = r"[\p{M}\p{S}\p{P}&&[^.%$¢€£]]"
# A word of ASCII letters with at most one mark behind it loses the mark and its capitals and nothing
# else, unless it is one of these.
_SINGLE_WORD = r"^[A-Za-z]+[.,!?;:]?\z"
_NOT_PLAIN = sorted({*FILLERS, *(p.removeprefix(r"\b").removesuffix(r"\b") for p, _ in REWRITES if "'" not in p), *spoken.ROLES})


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def _words(text: Column) -> Column:
    # A split compiles its pattern for every row; a text without white space needs none.
    alone = F.when(text != "", F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.when(~text.rlike(r"(?U)\s"), alone).otherwise(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def tokenize_raw(column: Column | str) -> Column:
    """Lower-cased words as written: punctuation but the apostrophe removed, `_` a separator."""
    text = F.translate(F.lower(_col(column)), "’‘_", "'' ")
    return _words(F.regexp_replace(text, r"[\p{P}&&[^']]", ""))


def drop_asides(column: Column | str) -> Column:
    """Lower case; bracketed and parenthesised spans, fillers, and space before ' removed."""
    text = F.lower(_col(column))
    text = F.regexp_replace(text, r"[<\[][^>\]]*[>\]]", "")
    text = F.regexp_replace(text, r"\(([^)]+?)\)", "")
    starts = "".join(sorted({f[0] for f in FILLERS}))
    text = F.regexp_replace(text, rf"(?U)(?=[{starts}])(?:{'|'.join(map(_word_first, FILLERS))})\b", "")
    return F.regexp_replace(text, r"(?U)\s+'", "'")


def _word_first(word: str) -> str:
    """`word` where a word begins: letters are compared before boundaries, which are dear to find."""
    return rf"{word}(?<=\b{word})"


def _literal_first(pattern: str) -> str:
    """A rewrite's pattern with the same matches, sought by its first letter."""
    if not pattern.startswith(r"\b"):
        return pattern
    body = pattern.removeprefix(r"\b")
    word = body.removesuffix(r"\b")
    return _word_first(word) + body[len(word):]


def expand_contractions(column: Column | str) -> Column:
    text = _col(column)
    for pattern, replacement in REWRITES:
        text = F.regexp_replace(text, "(?U)" + _literal_first(pattern), replacement)
    return text


def join_digits(column: Column | str) -> Column:
    """Commas between digits removed; periods not before a digit to spaces."""
    text = F.regexp_replace(_col(column), r"(?U)(\d),(\d)", "$1$2")
    return F.regexp_replace(text, r"\.([^0-9]|$)", " $1")


def remove_symbols_and_diacritics(column: Column | str) -> Column:
    text = _col(column)
    foreign = text.rlike(_NON_ASCII)
    plain = F.regexp_replace(text, _ASCII_SYMBOLS, " ")
    return F.when(foreign, spoken.folded(F.when(foreign, text))).otherwise(plain)


def basic_normalize(column: Column | str, remove_diacritics: bool = False) -> Column:
    """The language-neutral normaliser: brackets dropped, symbols to spaces, one space between."""
    text = F.regexp_replace(F.lower(_col(column)), r"[<\[][^>\]]*[>\]]", "")
    text = F.regexp_replace(text, r"\(([^)]+?)\)", "")
    foreign = text.rlike(_NON_ASCII)
    arrow = spoken.folded_all if remove_diacritics else spoken.composed
    plain = F.regexp_replace(text, r"[\p{M}\p{S}\p{P}]", " ")
    cleaned = F.when(foreign, arrow(F.when(foreign, text))).otherwise(plain)
    return F.regexp_replace(F.lower(cleaned), r"(?U)\s+", " ")


def standardize_spellings(column: Column | str, mapping: Mapping[str, str] | None = None) -> Column:
    """Words looked up in a spelling table of the caller's; a large one goes through `respell`."""
    words = _words(_col(column))
    if not mapping:
        return F.array_join(words, " ")
    table = F.create_map(*[F.lit(x) for pair in sorted(mapping.items()) for x in pair])
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def final_symbols(column: Column | str) -> Column:
    """Currency marks not before a digit and % not after one to spaces."""
    text = F.regexp_replace(_col(column), r"[.$¢€£]([^0-9])", " $1")
    text = F.regexp_replace(text, r"([^0-9])%", "$1 ")
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalized(df: DataFrame, column: str, out: str, spellings: Mapping[str, str] | None = None) -> DataFrame:
    """`df` with `out`, the normal form of `column`.

    Each step is a column of its own: a column read more than once is computed once, and the 49
    rewrites run only on texts that hold an apostrophe or one of their words. Single plain words, which
    are most rows of a table of words, take none of the steps (NULL goes through them).
    """
    first, rewritten, plain, needs, spoken_form, quick = (f"__{out}{i}" for i in range(6))
    word = F.rtrim(F.lower(column), F.lit(".,!?;:"))
    single = F.lit(False) if spellings else F.col(column).rlike(_SINGLE_WORD) & ~word.isin(_NOT_PLAIN)
    df = df.withColumn(quick, F.when(single, word))
    df = df.withColumn(first, drop_asides(F.when(F.col(quick).isNull(), F.col(column))))
    df = df.withColumn(
        rewritten,
        join_digits(F.when(F.col(first).rlike(_REWRITABLE), expand_contractions(first)).otherwise(F.col(first))),
    )
    df = df.withColumn(plain, F.regexp_replace(rewritten, _ASCII_SYMBOLS, " "))
    df = df.withColumn(needs, F.col(rewritten).rlike(_NON_ASCII) | F.col(plain).rlike(_NUMBERISH))
    df = df.withColumn(spoken_form, spoken.folded_numbers(F.when(F.col(needs), F.col(rewritten))))
    chosen = F.when(F.col(needs), F.col(spoken_form)).otherwise(F.col(plain))
    df = df.withColumn(out, F.coalesce(quick, final_symbols(standardize_spellings(chosen, spellings))))
    return df.drop(first, rewritten, plain, needs, spoken_form, quick)


def with_norm_tokens(df: DataFrame, column: str, out: str, spellings: Mapping[str, str] | None = None) -> DataFrame:
    return normalized(df, column, out, spellings).withColumn(out, _words(F.col(out)))


def respell(df: DataFrame, column: str, table: DataFrame, row_id: list[str]) -> DataFrame:
    """`column` with every word looked up in a spelling table (word, respelled) of any size."""
    words = df.select(*row_id, F.posexplode(_words(F.col(column))).alias("__pos", "__word"))
    mapped = words.join(table.select(F.col("word").alias("__word"), F.col("respelled").alias("__to")), "__word", "left")
    piece = F.struct("__pos", F.coalesce("__to", "__word").alias("w"))
    back = mapped.groupBy(*row_id).agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["w"]), " ").alias("__new"))
    return df.join(back, row_id, "left").withColumn(column, F.coalesce("__new", F.lit(""))).drop("__new")
