"""Text functions with Python's meaning of white space, words and null, as JVM expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Python's str.strip and str.split see it.
WHITE = r"[\s\x1c-\x1f]"
#: The same, one by one.
WHITES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def py_strip(x: Column) -> Column:
    return F.btrim(x, F.lit(WHITES))


def py_rstrip(x: Column) -> Column:
    return F.rtrim(x, F.lit(WHITES))


def py_words(x: Column) -> Column:
    """How many words str.split() gives."""
    held = py_strip(x)
    return F.when(held == "", F.lit(0)).otherwise(F.size(F.split(held, rf"(?U){WHITE}+"))).cast("int")


def has_words(x: Column, n: int) -> Column:
    """Whether str.split() gives n words at least; of few words, no more of the text is read than holds them."""
    if n > 500:
        return py_words(x) >= n
    word = WHITE.replace("[", "[^", 1)
    return F.rlike(x, F.lit(rf"(?U)^{WHITE}*+(?:{word}++{WHITE}++){{{n - 1}}}{word}")) if n > 0 else x.isNotNull()


def first(values: Column) -> Column:
    """First element of a list, or the empty text."""
    return F.coalesce(F.get(values, F.lit(0)), F.lit(""))


def year(date: Column) -> Column:
    return F.substring_index(date, "-", 1)


def said(x: Column) -> Column:
    """A scalar in an f-string: null is None."""
    return F.coalesce(x.cast("string"), F.lit("None"))


def rendered(x: Column, kind: T.DataType) -> Column:
    """A value as Python's str() writes it: a text is itself, structs and maps are dicts, arrays lists; a null stays null.

    Floating-point numbers are written as Spark casts them, which is the same from 1e-3 to 1e7.
    """
    return x if isinstance(kind, T.StringType) else _written(x, kind)


def rendered_json(x: Column) -> Column:
    """A value of any type, given as JSON text, as Python's str() writes it; a text is itself, null and what is no JSON are null."""

    def one(text: str | None) -> str | None:
        try:
            value = json.loads(text) if text is not None else None
        except ValueError:
            return None
        return None if value is None else str(value)

    def written(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    written.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(written, "string")(x)


def _written(x: Column, kind: T.DataType) -> Column:
    inner = lambda v, k: F.coalesce(_quoted(v) if isinstance(k, T.StringType) else _written(v, k), F.lit("None"))
    if isinstance(kind, T.StructType):
        made = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(_quoted(F.lit(f.name)), F.lit(": "), inner(x[f.name], f.dataType)) for f in kind.fields]), F.lit("}"))
    elif isinstance(kind, T.MapType):
        each = F.transform(F.map_entries(x), lambda e: F.concat(inner(e["key"], kind.keyType), F.lit(": "), inner(e["value"], kind.valueType)))
        made = F.concat(F.lit("{"), F.array_join(each, ", "), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        made = F.concat(F.lit("["), F.array_join(F.transform(x, lambda v: inner(v, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, T.BooleanType):
        made = F.when(x, "True").otherwise("False")
    else:
        made = x.cast("string")
    return F.when(x.isNotNull(), made)


def _quoted(x: Column) -> Column:
    """A text in quotes: single ones, or double ones where only that saves escapes; control characters escaped."""
    plain = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    shown = plain
    for c in [*range(32), 127]:
        shown = F.replace(shown, F.lit(chr(c)), F.lit({9: "\\t", 10: "\\n", 13: "\\r"}.get(c, f"\\x{c:02x}")))
    plain = F.when(x.rlike(r"[\x00-\x1f\x7f]"), shown).otherwise(plain)
    double = x.contains("'") & ~x.contains('"')
    return F.when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))


def track_line(name: Column, artist: Column, album: Column, release: Column, tags: Column) -> Column:
    """`"NAME" by ARTIST (ALBUM, YEAR) [tags: ...]`, each part but the first only where there is something in it; five tags."""
    n, a, b, y = first(name), first(artist), first(album), year(first(release))
    tail = F.array_join(F.filter(F.array(b, y), lambda v: v != ""), ", ")
    shown = F.array_join(F.slice(F.coalesce(tags, F.array().cast("array<string>")), 1, 5), ", ")
    some = lambda v, x: F.when(v != "", x)
    return F.concat_ws(" ", F.concat(F.lit('"'), n, F.lit('"')), some(a, F.concat(F.lit("by "), a)), some(tail, F.concat(F.lit("("), tail, F.lit(")"))), some(shown, F.concat(F.lit("[tags: "), shown, F.lit("]"))))


def profile_text(user_id: Column, age_group: Column, gender: Column, country: Column) -> Column:
    rows = [("user_id", user_id), ("age_group", age_group), ("gender", gender), ("country_name", country)]
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), said(v)) for k, v in rows])


def metadata_text(track_id: Column, fields: dict[str, Column]) -> Column:
    """`track_id: ID, field: value, ...`, the values in lower case."""
    return F.concat_ws(", ", F.concat(F.lit("track_id: "), track_id), *[F.concat(F.lit(f"{k}: "), F.lower(F.coalesce(F.array_join(v, ", "), F.lit("none")))) for k, v in fields.items()])


def corpus_text(fields: dict[str, Column]) -> Column:
    return F.concat(*[F.concat(F.lit(f"{k}: "), F.coalesce(F.array_join(v, ", "), F.lit("None")), F.lit("\n")) for k, v in fields.items()])


#: What stands above the candidates in a system prompt.
CANDIDATES_HEAD = "=== Candidate tracks (ranked) ===\nThese are the tracks you have selected. Recommend #1 as the primary choice. You may optionally reference #2 or #3 as alternatives.\n\n"
ABOUT_HEAD = "=== About this user ===\n"
PROFILE_HEAD, CONTEXT_HEAD, GOAL_HEAD = "User profile (demographics): ", "Additional user context: ", "Conversation goal: "


def system_prompt(persona: str, rules: str, profile: Column, context: Column, goal: Column, lines: Column) -> Column:
    """Sections joined by blank lines; null or empty bits, and the whole section about the user, are left out. lines: array of track lines."""
    bit = lambda head, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(head), x))
    bits = F.array_join(F.array_compact(F.array(bit(PROFILE_HEAD, profile), bit(CONTEXT_HEAD, context), bit(GOAL_HEAD, goal))), "\n")
    numbered = F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    return F.concat_ws("\n\n", F.lit(persona.strip()), F.lit(rules.strip()), F.when(bits != "", F.concat(F.lit(ABOUT_HEAD), bits)), F.concat(F.lit(CANDIDATES_HEAD), numbered))


def chat_turn(role: str, content: Column) -> Column:
    return F.concat(F.lit(f"<|im_start|>{role}\n"), content, F.lit("<|im_end|>\n"))
