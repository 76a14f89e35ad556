"""Column functions over text: normalisation, tags, code blocks, hashes, formats."""

from __future__ import annotations

import re

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The four tags of a trajectory.
TAGS = ("think", "code", "interpreter", "answer")
#: Signals of a failed and of a good execution.
ERROR_SIGNAL = r"(?i)\b(traceback|exception|syntaxerror|nameerror|failed|error:)\b"
SUCCESS_SIGNAL = r"(?i)\b(code run successfully|executed successfully|output has been saved|the output content is|rows? returned|query executed successfully)\b"
#: Code in fences, and in tags.
FENCED = r"(?is)```(?:python|py|sql)?\s*(.*?)```"
TAGGED = r"(?is)<code>\s*(.*?)\s*</code>"
_SPACE = r"(?U)[\s\x1C-\x1F]+"


def strip(text: Column) -> Column:
    """Unicode white space off both ends; Spark's own trim takes spaces only."""
    return F.regexp_replace(text, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+\z", "")


@cache
def _folding() -> tuple[str, str, dict[str, str]]:
    """What folding case does to single characters, as two texts of the same length, and those that become several; by the rule of ``str.casefold``."""
    folded = {chr(c): chr(c).casefold() for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).casefold() != chr(c)}
    single = {a: b for a, b in folded.items() if len(b) == 1}
    return "".join(single), "".join(single.values()), {a: b for a, b in folded.items() if len(b) > 1}


def casefold(text: Column) -> Column:
    """Text without differences of case, as ``str.casefold`` gives it: unlike ``lower``, ß is ss and final sigma is sigma."""
    before, after, several = _folding()
    simple = F.translate(text, before, after)
    whole = simple
    for a, b in several.items():
        whole = F.replace(whole, F.lit(a), F.lit(b))
    return F.when(F.rlike(text, F.lit(f"[{''.join(several)}]")), whole).otherwise(simple)


def json_text(text: Column) -> Column:
    """Text as the json module writes it without escaping what is not ASCII; null as null."""
    escapes = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\f": "\\f", "\b": "\\b"}
    escapes |= {chr(c): f"\\u{c:04x}" for c in range(32) if chr(c) not in escapes}
    escaped = text
    for a, b in escapes.items():
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    safe = F.when(F.rlike(text, F.lit(r'[\x00-\x1f"\\]')), escaped).otherwise(text)
    return F.when(text.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), safe, F.lit('"')))


def json_messages(messages: Column) -> Column:
    """Messages as JSON with sorted keys, byte for byte as the json module writes it; null as an empty list."""
    one = lambda m: F.concat(F.lit('{"content": '), json_text(m["content"]), F.lit(', "role": '), json_text(m["role"]), F.lit("}"))
    return F.concat(F.lit("["), F.coalesce(F.array_join(F.transform(messages, one), ", "), F.lit("")), F.lit("]"))


def normalize_prompt(text: Column) -> Column:
    """Lower case; back-ticked code and numbers become place holders; marks become spaces; runs of white space one space."""
    out = F.regexp_replace(F.lower(text), "`[^`]+`", " CODE ")
    out = F.regexp_replace(out, r"(?U)\b\d+(?:\.\d+)?\b", " NUM ")
    out = F.regexp_replace(out, r"(?U)[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(out, _SPACE, " "))


def has_tag(text: Column, tag: str) -> Column:
    """Whether ``text`` holds an opened and closed tag, over line ends and in any case."""
    return F.rlike(text, F.lit(f"(?is)<{tag}>.*?</{tag}>"))


def code_blocks(text: Column) -> Column:
    """Fenced blocks, or if there are none those in code tags; what is left of fences goes, and so do empty blocks."""
    fenced, tagged = F.regexp_extract_all(text, F.lit(FENCED), F.lit(1)), F.regexp_extract_all(text, F.lit(TAGGED), F.lit(1))
    found = F.when(F.size(fenced) > 0, fenced).otherwise(tagged)
    bare = F.transform(found, lambda b: F.regexp_replace(strip(b), r"(?i)^```(?:python|py|sql)?\s*|```$", ""))
    return F.transform(F.filter(bare, lambda b: b != ""), strip)


def bounded_length_quality(length: Column, low: int, ideal: int, high: int) -> Column:
    """0 for nothing, rising to 1 at ``low``, 1 up to ``high``, then falling by the larger of ``high`` and ``ideal``."""
    return F.when(length <= 0, 0.0).when(length < low, length / F.lit(float(low))).when(length <= high, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - (length - high) / F.lit(float(max(high, ideal)))))


def stable_fraction(value: Column, salt: str) -> Column:
    """A number from 0 to 1 that only ``value`` and ``salt`` decide: the first 64 bits of a digest."""
    digest = F.sha2(F.concat(F.lit(f"{salt}|"), value.cast("string")).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("double") / F.lit(float(2**64))


def money(value: Column) -> Column:
    return F.concat(F.lit("£"), F.format_number(value, 0))


def percent(value: Column, digits: int) -> Column:
    return F.concat(F.format_number(value * 100, digits), F.lit("%"))


def filled(template: str, values: dict[str, Column]) -> Column:
    """``template`` with each ``{name}`` replaced by the text of that name; what looks like a name in such a text stays."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.lit(part) if k % 2 == 0 else values.get(part, F.lit("{" + part + "}")) for k, part in enumerate(parts)))


def divided(a: Column, b: Column) -> Column:
    """``a`` / ``b``, null where ``b`` is 0."""
    return a / F.when(b != 0, b)
