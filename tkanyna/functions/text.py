"""Text primitives as Column expressions, with Unicode semantics: strip, words, numbering, templates, token estimates.

A null input gives null, except where a function says otherwise; an empty text stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
WORD = r"[\p{L}\p{N}_]+"
NUMBERING = r"(?U)^\d+[.):]\s*"

# The texts of prompts and of training examples.
NO_ENTRIES = "No relevant dictionary entries found."
TASK = "Перетвори ці речення на діалект."
FORM = "Поверни ТІЛЬКИ переклади, по одному на рядок, без нумерації, без оригіналу."
SYSTEM = "Ти — перекладач з діалектів та суржику на літературну українську мову."
ASK = "Перекладіть: "
ASK_PLAINLY = "Перекладіть на літературну українську: "
RULES_SUFFIXES = ("_rules_system", "_rules", "_system")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without Unicode white space and separators at either end."""
    return F.regexp_replace(_col(c), EDGES, "")


def words(c: Column | str) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(WORD), F.lit(0))


def without_numbering(c: Column | str) -> Column:
    """Without one leading number and its mark."""
    return F.regexp_replace(_col(c), NUMBERING, "")


def clean(c: Column | str) -> Column:
    """A generated text without the quotes of a JSON element, one leading number, and white space at its ends."""
    t = _col(c)
    quoted = t.startswith('"') & (t.endswith('",') | t.endswith('"'))
    bare = F.regexp_replace(F.regexp_replace(t, '^"+|"+$', ""), ",+$", "")
    return strip(without_numbering(F.when(quoted, bare).otherwise(t)))


def in_length(c: Column | str, least: int = 15, most: int = 1000) -> Column:
    """Whether a text has least to most characters, ends included; null counts as too short."""
    return F.coalesce(F.length(_col(c)).between(max(1, least), most), F.lit(False))


def not_blank(c: Column | str) -> Column:
    """Whether anything is left after stripping; null counts as blank."""
    return F.coalesce(F.length(strip(c)) > 0, F.lit(False))


def render_dictionary(entries: Column | str) -> Column:
    """Lines `- standard → dialect` of an array of structs (ukrainian, hutsul), or a fixed sentence without any."""
    e = _col(entries)
    lines = F.array_join(F.transform(e, lambda x: F.concat(F.lit("- "), x["ukrainian"], F.lit(" → "), x["hutsul"])), "\n")
    return F.when(F.coalesce(F.size(e), F.lit(0)) > 0, lines).otherwise(F.lit(NO_ENTRIES))


def system_prompt(template: str, dictionary: Column | str) -> Column:
    """The rules with the dictionary in their slot."""
    return F.replace(F.lit(template), F.lit("{dictionary}"), _col(dictionary))


def user_prompt(sentences: Column | str) -> Column:
    """The task, and the sentences of an array numbered from 1."""
    numbered = F.transform(_col(sentences), lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s))
    return F.concat(F.lit(f"{TASK}\n{FORM}\n"), F.when(F.size(_col(sentences)) > 0, F.concat(F.lit("\n"), F.array_join(numbered, "\n"))).otherwise(F.lit("")))


def token_estimate(system: Column | str, user: Column | str) -> Column:
    """A quarter of the characters of both prompts."""
    return F.floor((F.length(_col(system)) + F.length(_col(user))) / 4).cast("bigint")


def dialect_name(path: Column | str) -> Column:
    """The stem of a rules file without the first of its known suffixes, the longest tried first."""
    stem = F.regexp_replace(F.regexp_extract(_col(path), r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.regexp_replace(stem, "(?:" + "|".join(RULES_SUFFIXES) + ")$", "")


def chat_user(source: Column | str, with_system: bool = True) -> Column:
    """What the user says in a training or evaluation example."""
    return F.concat(F.lit(f"{SYSTEM}\n\n{ASK}" if with_system else ASK_PLAINLY), _col(source))


def chat_messages(source: Column | str, target: Column | str | None = None, with_system: bool = True) -> Column:
    """Array of (role, content): the user's turn, and the assistant's if there is a target."""
    turns = [F.struct(F.lit("user").alias("role"), chat_user(source, with_system).alias("content"))]
    if target is not None:
        turns.append(F.struct(F.lit("assistant").alias("role"), _col(target).alias("content")))
    return F.array(*turns)


def chat_text(messages: Column | str, opening: str = "<|{role}|>\n", closing: str = "\n") -> Column:
    """Messages as one text. opening and closing surround each turn; {role} stands for who speaks."""
    head, _, tail = opening.partition("{role}")
    return F.array_join(F.transform(_col(messages), lambda m: F.concat(F.lit(head), m["role"], F.lit(tail), m["content"], F.lit(closing))), "")


def instruct_text(system: Column | str, user: Column | str) -> Column:
    """The layout for a model without a chat template."""
    return F.concat(F.lit("<s>[INST] "), _col(system), F.lit("\n\n"), _col(user), F.lit(" [/INST]"))


def preview(c: Column | str, size: int = 80) -> Column:
    return F.substring(_col(c), 1, size)


def percent(part: Column | str, whole: Column | str) -> Column:
    """A share in percent with one decimal; 0.0 of nothing."""
    return F.format_string("%.1f", F.coalesce(F.try_divide(_col(part) * 100.0, _col(whole)), F.lit(0.0)))
