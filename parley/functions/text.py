"""Text expressions: tokens, stop words, bigrams, feature hashing, formatting of contexts and sessions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fmt: off
STOP_WORDS = sorted(set(
    "would could should can did does do this your you with will were was to the that or on of its it is in i have has from for by be at as are and an a "
    "their them they us our we me my no not but if his her him he she such some every all any very too so how why who which where when what those these there then than".split()
))
# fmt: on


def tokens(text: Column) -> Column:
    """Lowered runs of letters and digits (Unicode); null for null."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def without_stop_words(words: Column, stop: list[str] = STOP_WORDS) -> Column:
    """The words that aren't stop words; repetitions stay."""
    return F.filter(words, lambda x: ~x.isin(stop))


def bigrams(words: Column) -> Column:
    """Neighbouring words joined by an underscore."""
    pairs = lambda: F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws("_", a, b))
    return F.when(F.size(words) >= 2, pairs()).otherwise(F.array().cast("array<string>"))


def features(text: Column, use_bigrams: bool = True, drop_stop_words: bool = True) -> Column:
    """Unigrams and bigrams of a text, the latter made after stop words are dropped."""
    words = tokens(text)
    if drop_stop_words:
        words = without_stop_words(words)
    return F.concat(words, bigrams(words)) if use_bigrams else words


def hash_blocks(token: Column, seed: int = 7, bands: int = 4) -> list[Column]:
    """MD5 of seed, block number and token, one for each four bands."""
    return [F.md5(F.concat(F.lit(f"{seed}|{b}|"), token)) for b in range(-(-max(1, bands) // 4))]


def hashed(blocks: list[Column], dim: int, bands: int = 4) -> Column:
    """Array of (pos, sign) structs, one for each band, from `hash_blocks`: seven hex digits give the place, the eighth the sign."""
    out = []
    for b in range(max(1, bands)):
        h, at = blocks[b // 4], 8 * (b % 4) + 1
        pos = (F.conv(F.substring(h, at, 7), 16, 10).cast("bigint") % dim).cast("int")
        out.append(F.struct(pos.alias("pos"), F.when(F.substring(h, at + 7, 1) >= "8", 1).otherwise(-1).alias("sign")))
    return F.array(*out)


def sanitised(session_id: Column) -> Column:
    """A session id that is safe as a file name."""
    return F.regexp_replace(session_id, r"[^A-Za-z0-9._-]", "_")


def word_count(text: Column) -> Column:
    """Number of parts between white space."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))


def long_enough(text: Column, least: int = 4) -> Column:
    """Whether a text has `least` characters besides white space at its ends."""
    return F.length(F.trim(text)) >= least


def context_lines(hits: Column, style: str = "numbered") -> Column:
    """Lines for a prompt from an array of structs (distance, id, event, text), in order.

    Styles: `numbered` `[1] (event) text`, `list` `- [event] text`, `ids` `- [event] (id=.. dist=..)`.
    A missing event is `_default`, a missing id `?`, a missing text the id.
    """
    event = lambda h: F.coalesce(h["event"], F.lit("_default"))
    ident = lambda h: F.coalesce(h["id"].cast("string"), F.lit("?"))
    body = lambda h: F.coalesce(h["text"], ident(h))
    if style == "numbered":
        line = lambda h, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] ("), event(h), F.lit(") "), body(h))
    elif style == "list":
        line = lambda h, i: F.concat(F.lit("- ["), event(h), F.lit("] "), body(h))
    else:
        line = lambda h, i: F.concat(F.lit("- ["), event(h), F.lit("] (id="), ident(h), F.lit(" dist="), h["distance"].cast("string"), F.lit(")"))
    return F.array_join(F.transform(hits, line), "\n")


def in_template(context: Column, template: str, fallback: str = "(no relevant context found)") -> Column:
    """A template with `{context}` replaced."""
    return F.replace(F.lit(template), F.lit("{context}"), F.when(F.coalesce(context, F.lit("")) == "", F.lit(fallback)).otherwise(context))
