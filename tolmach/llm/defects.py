"""Which machine drafts are no translation of their source, and why.

Responses are sorted by text over the whole collection, those of people included, and
each is compared with the next different one. A response that another of the same
request continues is a shortened version; one that is repeated or continued under
unrelated requests is said whatever is asked. Response lengths at which far more
responses end than at their neighbours are known as limits. With these facts, one pass
over the pairs applies the rules:

* empty: without letters and digits once markup and stand-ins are dropped;
* refusal: it is said to unrelated requests, or speaks about the request, instead of
  carrying the source's names;
* copy: it holds the source's letters and digits in one piece;
* truncated: it is a shortened version, or it is continued or cut at a limit and the
  source's names are incomplete; or the source's last names or numbers are missing and
  the draft stops early;
* wrong_language: by a word model and a Viterbi segmentation into languages, at
  least half of the words it knows are in a language other than the expected.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .lookalikes import SHAPES
from .prefixes import continued, length_limits
from .words import words

LANGUAGES = ("de", "en", "es", "fr", "ru")

_TAG = re.compile(r"<[^<>]*>|&(?:#\w+|\w+);")
_CUT = re.compile(r"(?:\s*(?:…|\.\.\.|\[\.\.\.\]|\[…\]|%|<[^<>]*))?\s*$")
#: What stands where no translation is.
STAND_INS = frozenset("na null none nil tbd todo undefined untranslated empty missing nan placeholder xxx".split())
#: Phrases in which a draft speaks about its task.
REFUSAL = re.compile(
    r"language model|this text|this string|(?:this|that|your) request|this translation|provide an? (?:translation|rendering)|assist (?:you|here|with)|help with (?:this|that)|more (?:details|context|information)|enough context"
    r"|sprachmodell|diesen text|diese zeichen|dieser anfrage|diese anfrage|übertragung ist mir|keine übersetzung|kontext fehlt|mehr (?:informationen|kontext|details)"
    r"|modèle (?:de langage|linguistique)|ce texte|cette chaîne|(?:cette|votre) (?:demande|requête)|une traduction|faute de contexte|plus de (?:détails|contexte)"
    r"|modelo (?:de lenguaje|lingüístico)|este texto|esta cadena|(?:esta|tu|su) (?:solicitud|petición)|una traducción|traducción solicitada|falta de contexto|más (?:detalles|contexto|información)"
    r"|языков\w+ модел|этот текст|эт\w+ строк|эт\w+ запрос|ваш запрос|пожалуйста, запрос|отказ\w+ от перевода|не хватает контекста|больше (?:деталей|контекста|информации)",
    re.IGNORECASE,
)
#: How a draft that declines or apologises may begin.
OPENING = re.compile(r"\W*(?:hmm|sorry|i'?m sorry|i’m sorry|unfortunately|apologies|as an ai|i (?:can|am|must|won)|es tut mir|leider|entschuldigung|als ki|désolé|malheureusement|en tant que|je |lo siento|lamentablemente|como |no |извините|к сожалению|прошу прощения|простите|как |мне |я )", re.IGNORECASE)


def solid(text: str) -> str:
    """Letters and digits only, in lower case."""
    return "".join(words(text))


def empty(text: str | None) -> bool:
    """No letter or digit outside markup, or a stand-in for a missing text."""
    rest = solid(_TAG.sub(" ", text or ""))
    return not rest or rest in STAND_INS


_IGNORED = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe0f\ufeff]")
_MIXED = re.compile(r"(?=\w*[A-Za-zÀ-ɏ])(?=\w*[Ͱ-ԯ])\w+")
_LATIN = str.maketrans({other: shape[0] for shape in SHAPES for other in shape[1:] if other != "."})


def _readable(text: str) -> str:
    """Without ignorable characters and full forms; words of mixed letters in Latin ones where all have one."""

    def latin(m: re.Match) -> str:
        made = m[0].translate(_LATIN)
        return made if not re.search("[Ͱ-ԯ]", made) else m[0]

    return _MIXED.sub(latin, unicodedata.normalize("NFKC", _IGNORED.sub("", text))) if not text.isascii() else text


class Judge:
    """The rules, given the word model: in how many texts of each language the common words stand, and the sums over all words."""

    def __init__(self, common: dict[str, tuple[int, ...]], totals: tuple[int, ...], english: frozenset[str], switch: float = 7.0, prior: float = 6.0):
        self.totals = np.array(totals, dtype=float) + 1
        self.unseen = 0.05 / self.totals.max()  # the same for all languages, so one with few texts or none wins no word it has not seen
        self.common, self.english, self.switch, self.prior = common, english, switch, prior

    def told(self, source: str | None, target: str) -> list[str]:
        """The words of a draft that tell its language, in order: those with letters, without uncommon ones of its source, which are names it carries over."""
        given = set(words(_TAG.sub(" ", source or "")))
        return [w for w in words(_TAG.sub(" ", target)) if (w in self.common or w not in given) and any(map(str.isalpha, w))]

    def shares(self, told: list[str], expected: int, rare: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, int]:
        """Known words by language on the best path, and their number; the path starts in the expected language unless the words outweigh that."""
        rows = [c for w in told if (c := self.common.get(w) or rare.get(w))]
        counts = np.zeros(len(LANGUAGES))
        if not rows:
            return counts, 0
        score = np.log(np.array(rows) / self.totals + self.unseen)
        best, back = score[0] - self.prior, []
        best[expected] += self.prior
        for row in score[1:]:
            stay, jump = best, best.max() - self.switch
            back.append(np.where(stay >= jump, np.arange(len(best)), best.argmax()))
            best = np.maximum(stay, jump) + row
        at = int(best.argmax())
        counts[at] += 1
        for step in reversed(back):
            at = int(step[at])
            counts[at] += 1
        return counts, len(rows)

    def names(self, source: str) -> list[str]:
        """The words of a source that a translation keeps: names and numbers."""
        return [w for w in words(_TAG.sub(" ", source)) if w not in self.english and not (len(w) < 2 and w.isalpha())]

    def defect(self, source: str | None, target: str | None, language: str | None, shortened: bool = False, unrelated: bool = False, continued: bool = False, at_limit: bool = False, rare: dict[str, tuple[int, ...]] | None = None) -> str | None:
        """The one defect of a pair, or None; the facts are those of ``neighbours``, whether the draft's length is a limit, and the counts of its words that are not common."""
        source = source or ""
        bare = solid(source)
        if empty(target):
            return "empty" if bare else None
        assert target is not None
        target = _readable(target)
        own = words(source)
        long = len(own) >= 6
        given = solid(target)
        names = self.names(source)
        there = set(words(target))
        kept = sum(n in there for n in names) / len(names) if names else 0.0
        if long and unrelated and not kept and bare not in given:
            return "refusal"
        if (not long or not names or (kept < 0.5 and names[-1] not in there)) and REFUSAL.search(target) and (OPENING.match(target) or not kept) and not REFUSAL.search(source):
            return "refusal"
        if long and bare in given:
            return "copy"
        if language in LANGUAGES and (long or bare != given):
            counts, known = self.shares(self.told(source, target), LANGUAGES.index(language), rare or {})
            if known and counts[LANGUAGES.index(language)] <= known / 2:
                return "wrong_language"
        if long and shortened and (kept < 1 or not names) and self._inside(target):
            return "truncated"
        if long and names:
            lost = [n for n in names[-2:] if n not in there]
            early = names[-1] not in there and (kept < 0.8 and (len(lost) == len(names[-2:]) or (len(names) <= 3 or kept < 0.6) and self._inside(target)) or self._cut(target, [n for n in names if n not in there]))
            if early or len(names) >= 4 and kept < 0.4 or kept < 0.8 and continued and self._inside(target):
                if not kept and not continued and re.search(r"[.!?]\s*$", target) and not _CUT.search(target)[0].strip() and OPENING.match(target):
                    return "refusal"
                return "truncated"
        elif long and (continued or at_limit) and self._inside(target):
            return "truncated"
        return None

    def _inside(self, target: str) -> bool:
        stem = target[: _CUT.search(target).start()]
        return bool(stem) and stem[-1].isalnum()

    def _cut(self, target: str, lost: list[str]) -> bool:
        """The draft ends in the beginning of a lost name, at a mark of a cut, or within brackets."""
        stem = target[: _CUT.search(target).start()]
        last = words(stem)[-1:] or [""]
        inside = max(map(stem.rfind, "([{")) > max(map(stem.rfind, ")]}"))
        return any(n.startswith(last[0]) for n in lost) or stem != target.rstrip() or inside or bool(re.search(r"[\s(\[{/,;:–-]$", stem))


def word_counts(labelled: DataFrame, least: int = 3) -> DataFrame:
    """In how many of the different labelled texts (lang, text) of each language a word stands: (w, and a column for each of ``LANGUAGES``).

    All texts are counted, and all words with letters; words seen fewer than ``least`` times in
    every language are dropped. The empty word has the numbers of texts.
    """
    texts = labelled.where(F.col("lang").isin(*LANGUAGES) & F.col("text").isNotNull()).select("lang", "text").distinct()
    each = texts.mapInArrow(_word_rows, "lang string, w string, texts long")
    counts = each.groupBy("w").agg(*[F.coalesce(F.sum(F.when(F.col("lang") == code, F.col("texts"))), F.lit(0)).alias(code) for code in LANGUAGES])
    return counts.where((F.col("w") == "") | (F.greatest(*LANGUAGES) >= least))


def word_model(labelled: DataFrame, least: int = 3, share: int = 2000) -> tuple[Judge, DataFrame]:
    """The rules with the word model of all labelled texts (lang, text), and the counts of the words that are not common.

    Common words, in one of ``share`` texts of a language, are few whatever the corpus and
    go to every task; the others stay a table. Words of English that are no names are those
    in one of 250 of its texts.
    """
    counts = materialise(word_counts(labelled, least), "words")
    totals = counts.where("w <> ''").agg(*[F.coalesce(F.sum(code), F.lit(0)) for code in LANGUAGES]).first()
    texts = counts.where("w = ''").select(*LANGUAGES).first() or [0] * len(LANGUAGES)
    common = (F.col("w") != "") & F.array_max(F.array(*[F.col(code) >= max(least, n / share) for code, n in zip(LANGUAGES, texts, strict=True)]))
    known = {r[0]: tuple(r[1:]) for r in counts.where(common).select("w", *LANGUAGES).collect()}
    at = LANGUAGES.index("en")
    english = frozenset(w for w, by in known.items() if by[at] >= max(least, texts[at] / 250))
    return Judge(known, tuple(totals), english), counts.where(~common & (F.col("w") != ""))


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from collections import Counter

    for batch in batches:
        found = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found.update([(lang, ""), *[(lang, w) for w in set(words(_TAG.sub(" ", text))) if any(map(str.isalpha, w))]])
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "w", "texts"])


def _uncommon(judge: Judge):
    """The words of drafts (id, source, target, lang) that tell their language and are not common: (id, w)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, w) for i, source, target, lang in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True) if target and lang in LANGUAGES for w in set(judge.told(source, _readable(target))) if w not in judge.common]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())], names=["id", "w"])

    return run


def _judged(judge: Judge):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rare = ({r["w"]: r["n"] for r in row or ()} for row in batch.column(8).to_pylist())
            found = [judge.defect(*row) for row in zip(*(batch.column(i).to_pylist() for i in range(1, 8)), rare, strict=True)]
            bad = [i for i, d in enumerate(found) if d]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(bad, pa.int64())), pa.array([found[i] for i in bad], pa.string())], names=["id", "defect"])

    return run


def _stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stems = [t[: _CUT.search(t).start()] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stems, pa.string())], names=["key", "stem"])


def _overlap(a: Column, b: Column) -> Column:
    """Shared words of two texts by the words of the richer one."""
    x, y = (F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))) for t in (a, b))
    return F.try_divide(F.size(F.array_intersect(x, y)), F.greatest(F.size(x), F.size(y)))


def neighbours(drafts: DataFrame, others: DataFrame | None = None, same: float = 0.9, other: float = 0.2, least_words: int = 4) -> DataFrame:
    """What other responses tell of drafts (id, source, target): (id, shortened, unrelated, continued), where one holds.

    shortened: the response is a strict prefix of one that says more, whose request has at
    least ``same`` of the words; unrelated: it is equal to, or a prefix of, one whose request has at most
    ``other`` of them, and it has ``least_words`` words at least; continued: it is the prefix of
    any other and stops within a word. Continuations are sought in ``others`` (id, source,
    target) as well. Null targets have no neighbours.
    """
    columns = ["id", "source", "target"]
    rows = drafts.select(*columns) if others is None else drafts.select(*columns).union(others.select(*columns))
    stems = rows.where(F.col("target").isNotNull() & (F.length(F.trim("target")) > 0)).select(F.col("id").alias("key"), "target").mapInArrow(_stems, "key long, stem string")
    found = materialise(continued(stems).join(drafts.select(F.col("id").alias("key")).distinct(), "key", "left_semi"), "found")
    # only the responses that continue another are looked up, each once
    named = found.select(F.explode(F.array("key", "after")).alias("id")).distinct()
    by_id = rows.join(named, "id", "left_semi").groupBy("id").agg(F.min("source").alias("source"), F.min("target").alias("target"))
    after = by_id.select(F.col("id").alias("after"), F.col("source").alias("other"), F.col("target").alias("longer"))
    joined = found.join(by_id.withColumnRenamed("id", "key"), "key").join(after, "after")
    near = _overlap(F.col("source"), F.col("other"))
    many = F.size(F.regexp_extract_all("target", F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))) >= least_words
    size = {c: F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]+", "")) for c in ("target", "longer")}
    facts = [F.max(c).alias(n) for n, c in (("shortened", (near >= same) & (size["longer"] > size["target"])), ("unrelated", many & (near <= other)), ("continued", F.col("how") == 1))]
    longer = joined.groupBy(F.col("key").alias("id")).agg(*facts)
    # equal responses: the first and the last of their requests stand for all
    said = drafts.where(many).select("id", "source", F.md5(F.lower(F.regexp_replace("target", r"[^\p{L}\p{N}]+", ""))).alias("said"))
    groups = said.groupBy("said").agg(F.min("source").alias("a"), F.max("source").alias("b")).where("a <> b").where(_overlap(F.col("a"), F.col("b")) <= other)
    repeated = said.select("id", "said").join(groups.select("said"), "said", "left_semi").select("id").distinct().withColumn("repeated", F.lit(True))
    both = longer.join(repeated, "id", "full")
    none = F.lit(False)
    return both.select("id", F.coalesce("shortened", none).alias("shortened"), (F.coalesce("unrelated", none) | F.coalesce("repeated", none)).alias("unrelated"), F.coalesce("continued", none).alias("continued"))


def draft_defects(drafts: DataFrame, labelled: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Drafts (id, source, target, lang) with a defect: (id, defect), by the rules of this module.

    ``lang`` is the expected language, one of ``LANGUAGES``; another or null leaves
    out the language rule. ``labelled`` (lang, text) trains the word model, all its texts
    counted. ``others`` (id, source, target) are responses that are not judged but may continue a draft; their ids are not those of drafts. A null
    target is empty; a null source has no copy and no truncation; rows with a null id are
    left out. Rows that occur twice are judged once; an id with several contents gets the
    alphabetically first of its defects.
    """
    rows = materialise(drafts.select(F.col("id").cast("long"), "source", "target", "lang").where(F.col("id").isNotNull()).distinct(), "drafts")
    judge, uncommon = word_model(labelled)
    rare = rows.select("id", "source", "target", "lang").mapInArrow(_uncommon(judge), "id long, w string").join(uncommon, "w")
    rare = rare.groupBy("id").agg(F.collect_list(F.struct("w", F.array(*LANGUAGES).alias("n"))).alias("rare"))
    if others is not None:
        others = others.select(F.col("id").cast("long"), "source", "target").where(F.col("id").isNotNull())
    facts = neighbours(rows, others)
    limits = length_limits(rows.select(F.lit(0).alias("grp"), F.length("target").alias("length"))).select(F.col("length").alias("limit"))
    none = F.lit(False)
    tasks = int(drafts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # rows are judged in Python: even tasks, not few
    marked = (
        rows.repartition(tasks, "id")
        .join(facts, "id", "left")
        .join(rare, "id", "left")
        .join(limits, F.length("target") == F.col("limit"), "left")
        .select("id", "source", "target", "lang", *[F.coalesce(c, none).alias(c) for c in ("shortened", "unrelated", "continued")], F.col("limit").isNotNull().alias("at_limit"), "rare")
    )
    return marked.mapInArrow(_judged(judge), "id long, defect string").groupBy("id").agg(F.min("defect").alias("defect"))
