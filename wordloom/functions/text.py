"""Token, tag and cleaning functions: Column to Column, inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entity labels in the order in which tags are tried.
LABELS = ["CARDINAL", "DATE", "EMAIL", "EVENT", "FAC", "GPE", "LANGUAGE", "LAW", "LOC", "MONEY", "NORP", "NUMERIC", "ORDINAL", "ORG", "PERCENT", "PERSON", "PRODUCT", "QUANTITY", "TIME", "URL", "WORK_OF_ART"]
#: Labels that transcripts may carry in angle brackets by mistake.
ANGLE_LABELS = LABELS[:-1]
OPENING = [f"[{x}]" for x in LABELS]
CLOSING = [f"[/{x}]" for x in LABELS]
#: Marks that may end a token, and all ASCII punctuation in code point order.
MARKS = (".", "!", ";", ",", "?")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Characters that cleaning turns into spaces.
TO_SPACE = "\"'&’‘”“—(){}"

#: White space as Python's str.split sees it.
SPACE = r"(?U)[\s\x1c-\x1f]+"
#: Characters that are no word character, white space or ASCII punctuation, as Python's re sees them.
STRANGE = r"(?U)[^\p{L}\p{N}_\s!-/:-@\[-`{-~]+"


def _any(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)


DECOMPOSED = rf"(?s)^({_any(OPENING)})?(.*?)({_any(CLOSING)})?([.!;,?])?$"


def split_tokens(text: Column) -> Column:
    """White-space tokens, without empty ones."""
    return F.filter(F.split(text, SPACE), lambda t: t != "")


def has_token(text: Column) -> Column:
    """Whether ``split_tokens`` finds any."""
    return text.rlike(r"(?U)[^\s\x1c-\x1f]")


def decompose(token: Column) -> Column:
    """A struct (otag, mid, ctag, punct): one opening tag, then one final mark, then one closing tag before it."""
    part = lambda i: F.regexp_extract(token, DECOMPOSED, i)
    return F.struct(part(1).alias("otag"), part(2).alias("mid"), part(3).alias("ctag"), part(4).alias("punct"))


def _tagless(token: Column) -> Column:
    """The token without its final mark."""
    return F.when(F.substring(token, -1, 1).isin(*MARKS), F.substr(token, F.lit(1), F.length(token) - 1)).otherwise(token)


def bare(token: Column) -> Column:
    """The token without tags and final mark. Only tokens with a bracket can have tags, and most have none."""
    return F.when(token.contains("["), F.regexp_extract(token, DECOMPOSED, 2)).otherwise(_tagless(token))


def untagged(token: Column) -> Column:
    """The token without tags."""
    return F.when(token.contains("["), F.concat(F.regexp_extract(token, DECOMPOSED, 2), F.regexp_extract(token, DECOMPOSED, 4))).otherwise(token)


def final_mark(token: Column) -> Column:
    """The last character if it is a mark, else null. Tags are not looked behind."""
    last = F.substring(token, -1, 1)
    return F.when(last.isin(*MARKS), last)


def in_punctuation(token: Column) -> Column:
    """Whether the token is a run of the punctuation string, the empty token included."""
    return F.instr(F.lit(PUNCTUATION), token) > 0


def two_closing(token: Column) -> Column:
    return token.contains("][/")


def two_opening(token: Column) -> Column:
    return token.contains("][") & ~two_closing(token)


def single_tag(token: Column) -> Column:
    """A tag alone, or a token of which tags and one mark leave nothing."""
    tagged = token.isin(*OPENING, *CLOSING) | (F.trim(F.regexp_extract(token, DECOMPOSED, 2)) == "")
    return F.when(token.contains("["), tagged).otherwise(F.trim(_tagless(token)) == "")


def fix_double_tags(token: Column) -> Column:
    """Drop the outer tag of a token that has two on one side."""
    d = decompose(token)
    closed = F.when(two_closing(token), F.concat(d["otag"], d["mid"], d["punct"])).otherwise(token)
    e = decompose(closed)
    return F.when(two_opening(closed), F.concat(e["mid"], e["ctag"], e["punct"])).otherwise(closed)


def clean_strange(text: Column) -> Column:
    return F.regexp_replace(text, STRANGE, "")


def preclean(text: Column) -> Column:
    """Runtime cleaning: boundary markers and quotes to spaces, tags glued to their words, odd tags and lone marks dropped."""
    # The marker, and the patterns in the order in which they apply.
    out = F.replace(text, F.lit("*|"), F.lit(" "))
    out = F.translate(out, TO_SPACE, " " * len(TO_SPACE))
    out = F.regexp_replace(out, r"(?U)(\d+) %", "$1%")
    out = F.regexp_replace(out, r"(\[[A-Z_]+\]) ([A-Za-z0-9])", "$1$2")
    out = F.regexp_replace(out, r"([A-Za-z0-9]) (\[/[A-Z_]+\])", "$1$2")
    tokens = F.filter(split_tokens(clean_strange(out)), lambda t: ~single_tag(t))
    tokens = F.transform(tokens, lambda t: F.when(t.contains("]["), fix_double_tags(t)).otherwise(F.when(in_punctuation(t), "").otherwise(t)))
    return F.array_join(F.filter(tokens, lambda t: (t != "") & (~t.contains("[") | ~single_tag(t))), " ")


def clean_mark_mistakes(text: Column) -> Column:
    """Space after a closing tag's mark and between words joined by any one character or a comma."""
    # The patterns in the order in which they apply.
    out = F.regexp_replace(text, r"(?U)\].([\p{L}\p{N}_])", "]. $1")
    out = F.regexp_replace(out, r"(?U)([\p{L}\p{N}_]).([\p{L}\p{N}_])", "$1 $2")
    return F.regexp_replace(out, r"([A-Za-z]),([A-Za-z])", "$1, $2")


def correct_tags(text: Column) -> Column:
    """Angle-bracket tags to square ones, tokens joined by single spaces."""
    out = F.array_join(split_tokens(text), " ")
    names = "|".join(ANGLE_LABELS)
    return F.regexp_replace(out, f"<(/?(?:{names}))>", "[$1]")


def normalize_text(text: Column) -> Column:
    """Tokens without tags and final mark, empty ones dropped."""
    return F.array_join(F.filter(F.transform(split_tokens(text), bare), lambda t: t != ""), " ")


def normalize_entity(text: Column) -> Column:
    """An entity's tokens without tags and placeholders; marks stay."""
    return F.array_join(F.filter(F.transform(split_tokens(text), untagged), lambda t: ~t.isin("#", "*")), " ")


def lower_keeping_tags(text: Column) -> Column:
    """Lower-case words of a tagged text."""

    def lowered(token: Column) -> Column:
        d = decompose(token)
        tagged = token.startswith("[") | token.endswith("]") | token.rlike(r"(?s)\]..$")
        return F.when(tagged, F.concat(d["otag"], F.lower(d["mid"]), d["ctag"], d["punct"])).otherwise(F.lower(token))

    return F.array_join(F.transform(split_tokens(text), lowered), " ")


def boundary_segments(text: Column) -> Column:
    """The pieces between ``*|`` markers, empty ones included."""
    return F.split(text, r"\*\|", -1)


def or_else(first: Column, second: Column) -> Column:
    """second where first is null or zero: a time or index of 0 counts as missing."""
    return F.coalesce(F.nullif(first, F.lit(0)), second)
