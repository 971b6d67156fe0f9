"""Text in normal form where Spark has no function for it: small Arrow UDFs."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NO_LETTER = re.compile(r"[\W_]+")


#: What squashing does to the bytes of plain text: capitals become small, all but letters and digits go.
SMALL = bytes(range(256)).lower()
NO_LETTERS = bytes(k for k in range(128) if not chr(k).isalnum())


def squashed(text: str | None) -> str:
    """Letters and digits alone, compatible forms and cases made one, accents dropped."""
    if text and text.isascii():
        return text.encode().translate(SMALL, NO_LETTERS).decode()
    return NO_LETTER.sub("", unicodedata.normalize("NFKD", text or "").casefold().replace("đ", "d"))


def squash(text: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(squashed)

    return _udf(run, "string")(text)


def _udf(run, kind: str):
    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}  # real types: Spark doesn't resolve names of a closure
    return F.pandas_udf(run, kind)


AROUND = "[\\s.,;:!?\"'`“”‘’«»()\\[\\]{}<>…]+"
SURROUNDING = re.compile(f"^{AROUND}|{AROUND}$")


def answer_form(text: str | None) -> str:
    """A written answer as it is compared: compatible forms and cases made one, blanks collapsed, punctuation around it dropped."""
    return SURROUNDING.sub("", re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text or "").casefold()).strip()).strip()


def answer_forms(lists: Column) -> Column:
    """The forms of an array of arrays of written answers, null where it is null."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if rows is None else [[answer_form(x) for x in (() if row is None else row)] for row in rows] for rows in texts], dtype=object)

    return _udf(run, "array<array<string>>")(lists)


def composed(text: Column) -> Column:
    """Letters and their accents as one character each; a null text as empty."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFC", t or ""))

    return _udf(run, "string")(text)


# Words that say nothing of a question's subject.
STOPWORDS = frozenset(
    "the and for with from that this which what when where does are is was were into than then its "
    "their one option answer following about between during using used use can will not has have had "
    "how why who whom whose each any all also only most more some such according document statement "
    "describes described primary main purpose best correct true false identify select choose "
    "because therefore however instead whereas rather their there these those every other another should would could".split()
)


def content_words(text: Column, least: int) -> Column:
    """The distinct words of at least `least` characters that are no stopwords, as (word, key): in normal form, and squashed."""
    word = re.compile(rf"\w{{{least},}}")

    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [sorted({w for w in word.findall(unicodedata.normalize("NFKC", t or "").casefold()) if w not in STOPWORDS}) for t in texts]
        return pd.DataFrame({"words": rows, "keys": [[squashed(w) for w in row] for row in rows]})

    run.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    both = F.pandas_udf(run, "words array<string>, keys array<string>")(text)
    return F.arrays_zip(both["words"].alias("word"), both["keys"].alias("key"))
