"""Problem 7: one consistent form for text whose characters only look alike.

Each distinct value of an Arrow batch is handled once: stand-in letters go back to
the alphabet of their word, then compatibility normalisation in composed form, full
case folding, mapped white space and removal of default-ignorable characters.

Defined results: a null text stays null and is never affected; an empty text is its
own canonical form; texts of any length are handled whole; repeated rows of a key
count once (the row loaded last); columns besides the named ones are not carried, so
clashing names cannot arise.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.runtime import latest

# Letters of other alphabets and the Latin letter each is mistaken for.
CYRILLIC = dict(zip("асԁеһіјӏорԛѕухԝѵАВСЕНІЈКМОРЅТУХԚԜѴҮҺЬ", "acdehijlopqsyxwvABCEHIJKMOPSTYXQWVYHb"))
GREEK = dict(zip("αγεικνορτυωχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ayeikvoptuwxABEZHIKMNOPTYX"))
ARMENIAN = dict(zip("օոսհցզգՕՍ", "onuhgqqOU"))
CHEROKEE = dict(zip("ᎪᏴᏟᎬᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ", "ABCEHJKLMPRSTVWZ"))
#: Latin letters drawn like an ordinary one.
LATIN_VARIANTS = dict(zip("ɑɡıɩʟᴏᴜᴠᴡᴢ", "agiiLouvwz"))

_TO_LATIN = {**CYRILLIC, **GREEK, **ARMENIAN, **CHEROKEE}
_SCRIPT = {"LATIN": "L", "CYRILLIC": "C", "GREEK": "G", "ARMENIAN": "A", "CHEROKEE": "K"}
_BACK = {
    "C": {v: k for k, v in reversed(CYRILLIC.items())},
    "G": {v: k for k, v in reversed(GREEK.items())},
    "A": {v: k for k, v in reversed(ARMENIAN.items())},
    "K": {v: k for k, v in reversed(CHEROKEE.items())},
}
#: Letters of ordinary Russian and Greek words; a look-alike outside them betrays a word of one script as a disguise.
_ORDINARY = {chr(c) for c in range(0x410, 0x450)} | {"Ё", "ё"} | {chr(c) for c in range(0x391, 0x3CA)}

# Ranges of default-ignorable code points.
_IGNORABLE = (
    "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164"
    "\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufff8\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff"
)
_INVISIBLE = re.compile(f"[{_IGNORABLE}\x00-\x08\x0e-\x1f\x7f]")
_SPACES = re.compile("[\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\x0b\x0c\x85]")
_JOINED_EMOJI = re.compile("(?:[\U0001f1e6-\U0001faff\u2190-⯿\u3030\u303d㊗㊙©®0-9#*\u200d\ufe0f\ufe0e\u20e3\U000e0020-\U000e007f])+")
_EMOJI_BASE = re.compile("[\U0001f000-\U0001faff\u2190-⯿\u3030\u303d㊗㊙©®]|[0-9#*]\ufe0f?\u20e3")
_WORD = re.compile(r"[^\W\d_]+")
_FOREIGN = re.compile("[ıɐ-ʯᴀ-ᵿͰ-\u058fᎠ-\u13ff]")
_MARKED = re.compile("([^\\W\\d_])([\u0300-\u036f\u0483-\u0487\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20f0\ufe20-\ufe2f\u3099\u309a])")
#: What can only occur in an affected text; evaluated in the JVM before any Python.
SUSPECT = r"[^\x09\x0a\x0d\x20-\x7e]"

#: Decompositions that make a character a styled, full-width or joined form of another.
_STYLED = ("<wide>", "<narrow>", "<font>", "<circle>", "<square>", "<small>")
_LIGATURE = re.compile("[ĲĳǄ-ǌǱ-ǳſﬀ-ﬆﬓ-ﬗ]")


def _script(ch: str) -> str:
    return _SCRIPT.get(unicodedata.name(ch, "?").split(" ", 1)[0], "?")


def _styled(ch: str) -> bool:
    if _LIGATURE.match(ch):
        return True
    d = unicodedata.decomposition(ch)
    if d.startswith(_STYLED):
        return True
    return d.startswith(("<super>", "<sub>")) and ord(ch) > 0x2100 and unicodedata.category(ch)[0] == "L"


def _word_target(word: str, main: str, stands: Callable[[str], bool]) -> str | None:
    """The alphabet the word belongs to if some of its letters stand in for letters of it.

    A word wholly of ordinary letters of another script is a word of that script, unless its Latin reading stands in the text itself.
    """
    scripts = [_script(c) for c in word]
    kinds = set(scripts)
    if "?" in kinds:
        return None
    if kinds == {"L"}:
        plain = sum(c.isascii() for c in word)
        return "L" if plain and any(c in LATIN_VARIANTS for c in word) else None
    fits = [k for k in "LCGAK" if (k in kinds or k == main) and all(s == k or _swap(c, s, k) for c, s in zip(word, scripts))]
    if len(kinds) == 1:
        if main != "L" or "L" not in fits or len(word) < 2:
            return None
        odd = any(c not in _ORDINARY for c in word)
        return "L" if odd or len(word) > 2 and stands("".join(_swap(c, s, "L") for c, s in zip(word, scripts))) else None
    if not fits:
        return None
    return main if main in fits else max(fits, key=scripts.count)


def _swap(ch: str, script: str, to: str) -> str | None:
    latin = ch if script == "L" else _TO_LATIN.get(ch)
    if latin is None:
        return None
    if to == "L":
        return latin
    return _BACK[to].get(LATIN_VARIANTS.get(latin, latin))


def _stand_ins(text: str) -> tuple[str, bool]:
    """text with the stand-in letters of each word put back, and whether there were any."""
    if not _FOREIGN.search(text):
        return text, False
    latin = len(re.findall("[A-Za-zÀ-ɏ]", text))
    greek = len(re.findall("[Ͱ-Ͽ]", text))
    cyrillic = len(re.findall("[Ѐ-ԯ]", text))
    main = max((latin, "L"), (cyrillic, "C"), (greek, "G"))[1]
    hit = False
    plain: set[str] = set()

    def stands(reading: str) -> bool:
        if not plain:
            plain.update(w.lower() for w in _WORD.findall(text) if w.isascii())
            plain.add("")
        return reading.lower() in plain

    def mend(m: re.Match) -> str:
        nonlocal hit
        word = m.group()
        if word.isascii() or not _FOREIGN.search(word):
            return word
        to = _word_target(word, main, stands)
        if to is None:
            return word
        hit = True
        out = []
        for c in word:
            s = _script(c)
            out.append(LATIN_VARIANTS.get(c, c) if s == to == "L" else c if s == to else _swap(c, s, to) or c)
        return "".join(out)

    return _WORD.sub(mend, text), hit


def _folded(text: str) -> str:
    folded = unicodedata.normalize("NFKC", text.casefold())
    return _INVISIBLE.sub("", _SPACES.sub(" ", folded))


def examine(text: str | None) -> tuple[str | None, list[str]]:
    """The consistent form of one text and the kinds of disguise found in it."""
    if text is None:
        return None, []
    if text.isascii() and not _INVISIBLE.search(text):
        return text.casefold(), []
    kinds = []
    if any(_styled(c) for c in set(text) if c > "\x7f"):
        kinds.append("styled")
    if _MARKED.search(text):
        kinds.append("combining")
    if _SPACES.search(text):
        kinds.append("space")
    bare = _JOINED_EMOJI.sub(lambda m: " " if _EMOJI_BASE.search(m.group()) else m.group(), text)
    if _INVISIBLE.search(bare):
        kinds.append("invisible")
    visible = _INVISIBLE.sub("", text)
    composed = unicodedata.normalize("NFKC", visible)
    mended, hit = _stand_ins(composed)
    if hit:
        kinds.append("lookalike")
    form = _folded(mended)
    for _ in range(4):  # folding may settle a word's alphabet, so the form is taken again until it stays
        again = _folded(_stand_ins(form)[0])
        if again == form:
            break
        form = again
    return form, kinds


_RESULT = T.StructType([T.StructField("canonical", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType()))])


@F.pandas_udf(_RESULT)
def canonical_udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for values in batches:
        codes, distinct = pd.factorize(values)
        done = [examine(v) for v in distinct] + [(None, [])]
        yield pd.DataFrame({"canonical": [done[c][0] for c in codes], "kinds": [done[c][1] for c in codes]})


def text_fields(skills: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field_name, text): one row per text of the row loaded last of each key; null texts give no row."""
    rows = latest(skills, [key], *fields)
    pairs = ", ".join(f"'{f}', `{f}`" for f in fields)
    return rows.select(key, F.expr(f"stack({len(fields)}, {pairs}) AS (field_name, text)")).filter(F.col("text").isNotNull())


def affected_fields(skills: DataFrame, key: str = "skill_id", fields: tuple[str, ...] = ("description", "when_to_use", "body")) -> DataFrame:
    """(key, field_name, canonical, kinds) of the texts that hold at least one disguised character.

    Only texts with a character outside printable ASCII reach Python.
    """
    texts = text_fields(skills.select(key, "loaded_at", *fields), key, list(fields)).filter(F.col("text").rlike(SUSPECT))
    seen = texts.select(key, "field_name", canonical_udf("text").alias("r"))
    return seen.filter(F.size("r.kinds") > 0).select(key, "field_name", "r.canonical", "r.kinds")


def canonical_texts(skills: DataFrame, key: str = "skill_id", fields: tuple[str, ...] = ("description", "when_to_use", "body")) -> DataFrame:
    """(key, field_name, canonical): every text in its consistent form; ASCII texts stay in the JVM."""
    texts = text_fields(skills.select(key, "loaded_at", *fields), key, list(fields))
    plain = texts.filter(~F.col("text").rlike(SUSPECT)).select(key, "field_name", F.lower("text").alias("canonical"))
    rest = texts.filter(F.col("text").rlike(SUSPECT)).select(key, "field_name", canonical_udf("text")["canonical"].alias("canonical"))
    return plain.unionByName(rest)
