"""Texts that were broken off by a field limit or in transfer.

Values are sorted and compared with the next, so a strict prefix of a longer copy is
known (see ``prefixes``); this is done for whole texts and for their last words, as a last
word that is only known as the beginning of others was broken off. Length limits show as
lengths at which a source ends far more texts than at neighbouring ones. What neither
tells is left to how the last line ends: lines that need no closing mark (table rows,
list items, signatures, commands, references) are complete if they end as lines of their
kind usually do in the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .prefixes import continued, length_limits

_BULLET = re.compile(r"^\s*(?:(?:[-*•–]|\d+[.)])\s+\S|[-*•–]\s*$)")
_CLOSED = re.compile(r"(?:[.!?…。！？‽][\"'”’»)\]}*_`]*|[:;]-?[)(D])$")
_REFERENCE = re.compile(r"^[\w’']+(?: [\w’']+){0,3} \S*[/\\#]\S*$|^\S*://\S+$")
_BLOCK = re.compile(r"<([A-Za-z][\w.:-]*)(?:\s[^<>]*)?(?<!/)>")
_OPEN_TAG = re.compile(r"<[/A-Za-z!?][^<>]*$")


def stem(text: str) -> str:
    """A text without blanks and damaged characters at its end."""
    return text.rstrip().rstrip("\ufffd").rstrip()


def kind_of(text: str) -> tuple[str, str]:
    """The kind of a text's end and the token that shows whether it is whole: (kind, token).

    Kinds: empty, damaged, markup, table, signature, command, reference, list, closed
    (with a closing mark) and prose (without).
    """
    bare = text.rstrip()
    if not bare:
        return "empty", ""
    if bare.endswith("\ufffd"):
        return "damaged", ""
    lines = [line.strip() for line in bare.split("\n")]
    last = lines[-1]
    if len(lines) > 1 and lines[-2] in ("$", "-", "*", "•"):  # wrapped after its mark
        last = f"{lines[-2]} {last}"
    blocks = {m[1] for line in lines if (m := _BLOCK.match(line))}
    if _OPEN_TAG.search(bare):
        return "markup", "open"
    if blocks and _BLOCK.match(lines[0]) and any(len(re.findall(rf"<{re.escape(x)}[\s>]", bare)) > bare.count(f"</{x}>") for x in blocks):
        return "markup", "open"
    if re.search(r"</[A-Za-z][^<>]*>$", bare):
        return "markup", "closed"
    if last.startswith("|"):
        return "table", "closed" if last.endswith("|") and len(last) > 1 else "open"
    if len(lines) > 1 and lines[-2] in ("--", "—", "__"):
        return "signature", last.split()[-1].casefold()
    if last.startswith("$ ") or last[0] in ">#" and last[1:2] == " " and not _CLOSED.search(bare):
        return "command", last.split()[-1].casefold()
    if _CLOSED.search(bare) or _emoji(bare[-1]):
        return "closed", ""
    if _REFERENCE.match(last):
        return "reference", last.rpartition(".")[2].casefold() if "." in last.split()[-1] else ""
    return ("list" if _ends_in_labels(lines) else "prose"), ""


def _ends_in_labels(lines: list[str]) -> bool:
    """Whether a text ends in a list whose other items mostly have no closing mark.

    Items may be wrapped. Where a blank line follows the last bullet, what comes after it
    belongs to the item only if both have at most twice the words of the longest other one;
    otherwise it is a paragraph of its own.
    """
    bullets = [i for i, line in enumerate(lines) if _BULLET.match(line)]
    items = [" ".join(lines[a:b]).split() for a, b in zip(bullets, [*bullets[1:], len(lines)], strict=False)]
    if len(items) < 2 or "" in lines[bullets[-1] :] and len(items[-1]) > 2 * max(map(len, items[:-1])):
        return False
    return 2 * sum(bool(_CLOSED.search(item[-1])) for item in items[:-1]) < len(items) - 1


def _emoji(c: str) -> bool:
    return c in "\ufe0f\u200d" or 0x1F000 <= ord(c) < 0x20000 or 0x2600 <= ord(c) < 0x27C0


TOKEN_KINDS = ("signature", "command", "reference")
#: Kinds of ends without a closing mark, which may be cut.
OPEN_KINDS = ("damaged", "prose", "markup", "table", "list", *TOKEN_KINDS)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, source, text) to what later steps need of each text; the text itself goes no further."""
    for batch in batches:
        texts = batch.column(2).to_pylist()
        kinds = [kind_of(t) for t in texts]
        stems = [stem(t) for t in texts]
        tail = [bool(s) and s[-1].isalnum() for s in stems]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([k for k, _ in kinds], pa.string()), pa.array([t for _, t in kinds], pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(tail, pa.bool_()), pa.array(stems, pa.string())],
            names=["key", "source", "kind", "token", "chars", "bytes", "inword", "stem"],
        )


def broken_words(seen: DataFrame) -> DataFrame:
    """Last words of texts without a closing mark (kind, stem) that stand nowhere but at ends of texts and begin another word of the corpus: (last).

    Words are counted in lower case; a last word that its text ends in may be broken itself, so it counts for no other.
    """
    low = F.lower("stem")
    body = seen.select(F.explode(F.regexp_extract_all(F.regexp_replace(low, r"(?U)\w+$", ""), F.lit(r"(?U)(\w+)"), F.lit(1))).alias("word")).distinct()
    last = seen.where(F.col("kind").isin(*OPEN_KINDS)).select(F.regexp_extract(low, r"(?U)(\w+)$", 1).alias("word")).where("word <> ''").distinct()
    odd = materialise(last.join(body, "word", "left_anti"), "odd")
    # a word that begins another is continued within a word
    begun = continued(body.union(odd).select(F.xxhash64("word").alias("key"), F.col("word").alias("stem"))).where("how = 1")
    return odd.join(begun.select("key").distinct(), F.xxhash64("word") == F.col("key"), "left_semi").select(F.col("word").alias("last"))


def ends(df: DataFrame) -> DataFrame:
    """Rows (key long, source string, text string) with the facts: adds kind, token, chars, bytes, inword, how, limited, usual, broken."""
    rows = df.select("key", "source", "text").where(F.col("text").isNotNull())
    seen = materialise(rows.mapInArrow(_ends, "key long, source string, kind string, token string, chars long, bytes long, inword boolean, stem string"), "ends")
    longer = continued(seen.where("kind <> 'empty'").select("key", "stem")).groupBy("key").agg(F.min("how").alias("how"))
    open_ended = seen.where(F.col("kind").isin(*OPEN_KINDS) & (F.col("kind") != "list"))
    limits = [length_limits(open_ended.select(F.col("source").alias("grp"), F.col(c).alias("length"))).select(F.col("grp").alias("source"), F.col("length").alias(c), F.lit(True).alias(f"at_{c}")) for c in ("chars", "bytes")]
    # how lines of a kind usually end: tokens of at least one in a hundred of them, thus at most 100 for each kind
    tokens = seen.where(F.col("kind").isin(*TOKEN_KINDS)).groupBy("kind", "token").agg(F.count("*").alias("n"))
    totals = F.broadcast(tokens.groupBy("kind").agg(F.sum("n").alias("of")))  # a row for each kind
    usual = tokens.join(totals, "kind").where((F.col("n") * 100 >= F.col("of")) & (F.col("token") != "")).select("kind", "token", F.lit(True).alias("usual"))
    broken = broken_words(seen).withColumn("broken", F.lit(True))
    return (
        seen.withColumn("last", F.when(F.col("kind").isin(*OPEN_KINDS), F.regexp_extract(F.lower("stem"), r"(?U)(\w+)$", 1)))
        .drop("stem")
        .join(broken, "last", "left")
        .join(longer, "key", "left")
        .join(limits[0], ["source", "chars"], "left")
        .join(limits[1], ["source", "bytes"], "left")
        .join(usual, ["kind", "token"], "left")
        .select("key", "source", "kind", "token", "chars", "bytes", "inword", F.coalesce("how", F.lit(0)).alias("how"), F.coalesce("at_chars", "at_bytes", F.lit(False)).alias("limited"), F.coalesce("usual", F.lit(False)).alias("usual"), F.coalesce("broken", F.lit(False)).alias("broken"))
    )


def routes(df: DataFrame) -> DataFrame:
    """Rows (key, source, text) that stop before their end, with what shows it: (key, source, kind, prefix, limit, mark, ending).

    prefix: another text continues this one, or its last word is known only as the
    beginning of others. limit: it has a length at which its source cuts. mark: a damaged
    character, an open tag or a table row without its border. ending: prose without a
    closing mark, or a signature, command or reference that does not end as such lines
    do. A list item counts by prefix, within a word only, or limit. Null, empty and blank
    texts are not cut, nor is a text with a closing mark, even if another text continues it.
    """
    kind = F.col("kind")
    facts = ends(df).where(kind.isin(*OPEN_KINDS))
    prefix = F.when(kind == "list", (F.col("how") == 1) | F.col("broken")).otherwise((F.col("how") > 0) | F.col("broken"))
    mark = (kind == "damaged") | (kind.isin("markup", "table") & (F.col("token") == "open"))
    ending = (kind == "prose") | (kind.isin(*TOKEN_KINDS) & ~F.col("usual"))
    cut = F.when(kind == "list", F.col("prefix") | F.col("limit")).otherwise(F.col("mark") | F.col("ending"))
    made = facts.select("key", "source", "kind", prefix.alias("prefix"), F.col("limited").alias("limit"), mark.alias("mark"), ending.alias("ending"))
    return made.where(cut)


def cut_off(df: DataFrame) -> DataFrame:
    """Rows (key, source, text) that stop before their end: (key, source), each row that is cut. The cases are those of ``routes``."""
    return routes(df).select("key", "source")


def cut_routes(cut: DataFrame) -> DataFrame:
    """How many of the rows of ``routes`` each kind of evidence shows: (kind, texts, prefix, limit, prefix_or_limit, mark, ending_only)."""
    shown = F.col("prefix") | F.col("limit")
    counts = [F.count_if(c).alias(n) for n, c in (("prefix", F.col("prefix")), ("limit", F.col("limit")), ("prefix_or_limit", shown), ("mark", F.col("mark")), ("ending_only", ~shown & ~F.col("mark")))]
    return cut.groupBy("kind").agg(F.count("*").alias("texts"), *counts)


def cut_shares(all_rows: DataFrame, cut: DataFrame) -> DataFrame:
    """How often each source truncates: (source, texts, cut, share), over all its texts that are not blank."""
    total = all_rows.where(F.length(F.trim("text")) > 0).groupBy("source").agg(F.countDistinct("key").alias("texts"))
    bad = cut.groupBy("source").agg(F.countDistinct("key").alias("cut"))
    return total.join(bad, total["source"].eqNullSafe(bad["source"]), "left").select(total["source"], "texts", F.coalesce("cut", F.lit(0).cast("long")).alias("cut")).withColumn("share", F.round(F.col("cut") / F.col("texts"), 6))
