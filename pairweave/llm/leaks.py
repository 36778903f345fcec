"""Evaluation texts leaking into training text: template windows, hash join, slot check."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairweave.llm.text import TAG_SQL, WORD, without_markup, words
from pairweave.runtime import cut
from pairweave.sources.tables import table

#: Words of the items that may be names, units or plain; they are broadcast, and more of them are refused.
LEXICON_WORDS = 5_000_000
#: Bits of the filter that documents are looked through with, at most (32 MB). Beyond some ten million windows of items
#: more documents' windows pass it; the join that follows is exact in any case.
FILTER_BITS = 1 << 28
#: Windows of a block are broadcast for the join up to so many; beyond, both sides are shuffled.
BROADCAST_WINDOWS = 200_000
#: Placeholders can't be words, since words hold letters and digits only.
NUMBER, NAME, UNIT, SLOT = "<number>", "<name>", "<unit>", "<slot>"
#: Successive words without a name or unit by which a retold item is looked for in documents.
ANCHOR = 4
#: Windows of retold items, which are wide rows, are broadcast up to so many.
BROADCAST_RETOLD = 20_000

#: Numbers with their decimals and groups of digits are one word each, units glued to them another.
_PARTS = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+")
_CASED = re.compile(_PARTS.pattern + r"|[.?!:)]")


def _lexicon_votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per word of the items: how often it occurs, begins with a capital inside a sentence, is all lower case, or
    follows a number within a sentence."""
    for batch in batches:
        rows = []
        for text in batch["text"].dropna():
            before, number = ".", False
            for token in _CASED.findall(without_markup(text)):
                if token in ".?!:)":
                    before, number = token, False
                    continue
                rows.append((token.lower(), 1, int(token[0].isupper() and len(token) > 2 and before == ""), int(token.islower()), int(number and not token[0].isdigit())))
                before, number = "", token[0].isdigit()
        yield pd.DataFrame(rows, columns=["word", "n", "capital", "lower", "after_number"])


def slot_lexicon(items: DataFrame) -> DataFrame:
    """``(word, slot)``: the names and units among the words of ``items(text)``.

    A name occurs with a capital inside a sentence and never in lower case; a unit follows a number in at least two
    places and in at least half of all its places.
    """
    votes = items.select("text").mapInPandas(_lexicon_votes, "word string, n long, capital long, lower long, after_number long")
    votes = votes.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "capital", "lower", "after_number")])
    name = (F.col("capital") > 0) & (F.col("lower") == 0)
    unit = (F.col("after_number") >= 2) & (2 * F.col("after_number") >= F.col("n"))
    return votes.select("word", F.when(name, F.lit(NAME)).when(unit, F.lit(UNIT)).alias("slot")).filter("slot is not null")


class Windows:
    """All windows of ``width`` words of a batch of texts, with the hash of each window's template."""

    def __init__(self, texts: pd.Series, width: int, slots: dict[str, str]):
        per = [words(t) if isinstance(t, str) else [] for t in texts]
        lengths = np.array([len(w) for w in per], np.int64)
        self.flat = [x for w in per for x in w]
        owner = np.repeat(np.arange(len(per)), lengths)
        begin = np.cumsum(lengths) - lengths
        codes, unique = pd.factorize(np.array(self.flat, dtype=object)) if self.flat else (np.zeros(0, np.int64), [])
        template = np.array([xxhash.xxh64_intdigest((NUMBER if w.isdigit() else slots.get(w, w)).encode()) for w in unique], np.uint64)
        n = max(0, len(self.flat) - width + 1)
        hashed = template[codes] if len(unique) else np.zeros(0, np.uint64)
        rolling = np.zeros(n, np.uint64)
        for k in range(width):
            rolling = rolling * np.uint64(0x9E3779B97F4A7C15) + hashed[k : k + n]
        whole = owner[:n] == owner[width - 1 : width - 1 + n]
        self.start = np.nonzero(whole)[0]
        self.hash = rolling[self.start].view(np.int64)
        self.owner = owner[self.start] if n else np.zeros(0, np.int64)
        self.position = self.start - begin[self.owner] if n else np.zeros(0, np.int64)
        self.width = width

    def table(self, keep: np.ndarray, ids: pd.Series) -> pd.DataFrame:
        """Rows ``(id, position, template, words)`` of the windows marked by ``keep``; the words include the slots'."""
        at = np.nonzero(keep)[0]
        text = [" ".join(self.flat[s : s + self.width]) for s in self.start[at].tolist()]
        return pd.DataFrame({"id": ids.to_numpy()[self.owner[at]], "position": self.position[at], "template": self.hash[at], "words": text})


_WINDOW = "id long, position long, template long, words string"


def _slots_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bit of a filter of ``bits`` (a power of two) that stands for each hash."""
    return (hashes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - bits.bit_length())


class HashFilter:
    """A set of hashes as one bit each: says yes to all of them, and to some others."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = _slots_of(hashes, self.bits)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def hash_filter(rows: DataFrame, column: str, *, most_bits: int = FILTER_BITS) -> HashFilter:
    """The filter of a long column: sixteen bits or more per row up to ``most_bits``, set by the tasks that hold the
    rows and gathered as words of 64."""
    bits = min(most_bits, max(1 << 10, 1 << (16 * max(1, rows.count())).bit_length()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = np.unique(_slots_of(batch[column].to_numpy(np.int64), bits))
            word = (at >> np.uint64(6)).astype(np.int64)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
            masks = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), starts) if len(word) else np.zeros(0, np.uint64)
            yield pd.DataFrame({"word": word[starts], "mask": masks.view(np.int64)})

    words = np.zeros(max(1, bits >> 6), np.uint64)
    found = rows.select(column).mapInPandas(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()  # bits / 64 rows at most
    words[found["word"].to_numpy(np.int64)] = found["mask"].to_numpy(np.int64).view(np.uint64)
    return HashFilter(words, bits)


def _vocabulary(rows: DataFrame) -> list:
    """All rows of a table of words of the items, which must be within :data:`LEXICON_WORDS`."""
    found = rows.limit(LEXICON_WORDS + 1).collect()
    if len(found) > LEXICON_WORDS:
        raise ValueError(f"the items have more than {LEXICON_WORDS} different words; look for them in parts")
    return found


def _windows(texts: DataFrame, width: int, slots: dict[str, str], wanted: HashFilter | None) -> DataFrame:
    """Windows of ``texts(id, text)``, only those whose template passes the filter if one is given."""
    spark = texts.sparkSession
    # plain values only, since what is broadcast is unpickled where this module may not be installed
    known, targets = spark.sparkContext.broadcast(slots), spark.sparkContext.broadcast(wanted and (wanted.words, wanted.bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = Windows(batch["text"], width, known.value)
            keep = np.ones(len(found.hash), bool) if targets.value is None else HashFilter(*targets.value)(found.hash)
            if keep.any():
                yield found.table(keep, batch["id"])

    return texts.select("id", "text").mapInPandas(run, _WINDOW)


def parts(text: str | None) -> list[str]:
    """Lower-case words and numbers of the text without its markup; see ``_PARTS``."""
    return _PARTS.findall(without_markup(text).lower()) if isinstance(text, str) else []


def _run_hashes(coded: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` successive codes."""
    n = max(0, len(coded) - width + 1)
    rolling = np.full(n, width, np.uint64)
    for k in range(width):
        rolling = rolling * np.uint64(0x9E3779B97F4A7C15) + coded[k : k + n]
    return (rolling ^ (rolling >> np.uint64(29))).view(np.int64)


def _codes(words_: list[str], known: dict[str, int]) -> np.ndarray:
    return np.array([known.get(w) or known.setdefault(w, xxhash.xxh64_intdigest(w.encode())) for w in words_], np.uint64)


_PATTERN = "item_id long, item_position long, anchor long, offset int, anchored boolean, item array<string>, pattern array<string>"


def _patterns(items: DataFrame, width: int, slots: dict[str, str]) -> DataFrame:
    """Every window of ``items(id, text)`` with its pattern: words, NUMBER, or SLOT where any word may stand.

    The anchor is the run of :data:`ANCHOR` words without a SLOT of least hash, or the whole pattern if there is none.
    """
    given = items.sparkSession.sparkContext.broadcast(slots)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for batch in batches:
            rows = []
            for ident, text in zip(batch["id"].tolist(), batch["text"]):
                found = parts(text)
                pattern = [NUMBER if w[0].isdigit() else SLOT if w in given.value else w for w in found]
                coded = _codes(pattern, known)
                short, whole = _run_hashes(coded, ANCHOR).tolist(), _run_hashes(coded, width).tolist()
                clean = [SLOT not in pattern[k : k + ANCHOR] for k in range(len(short))]
                for s in range(len(whole)):
                    best = min(((short[k], k - s) for k in range(s, s + width - ANCHOR + 1) if clean[k]), default=None)
                    rows.append((ident, s, *(best or (whole[s], 0)), best is not None, found[s : s + width], pattern[s : s + width]))
            yield pd.DataFrame(rows, columns=["item_id", "item_position", "anchor", "offset", "anchored", "item", "pattern"])

    return items.select("id", "text").mapInPandas(run, _PATTERN)


def _places(documents: DataFrame, width: int, slots: dict[str, str], plain: set[str], short: HashFilter, whole: HashFilter | None) -> DataFrame:
    """Where anchors stand in ``documents(id, text)``, with the words around that a window can reach.

    For anchors that are whole patterns, words of ``slots`` and words that no item uses (not in ``plain``) are slots.
    """
    given = documents.sparkSession.sparkContext.broadcast((slots, plain, (short.words, short.bits), whole and (whole.words, whole.bits)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots, plain, *filters = given.value
        short, whole = (f and HashFilter(*f) for f in filters)
        known: dict[str, int] = {}
        for batch in batches:
            rows = []
            if len(known) > 1_000_000:
                known = {}
            for ident, text in zip(batch["id"].tolist(), batch["text"]):
                found = parts(text)
                if len(found) < width:
                    continue
                typed = [NUMBER if w[0].isdigit() else w for w in found]
                hashed = _run_hashes(_codes(typed, known), ANCHOR)
                for q in np.flatnonzero(short(hashed)).tolist():
                    a = max(0, q - width + ANCHOR)
                    rows.append((ident, q, int(hashed[q]), q - a, True, found[a : q + width]))
                if whole is not None:
                    hashed = _run_hashes(_codes([w if w == NUMBER or w in plain and w not in slots else SLOT for w in typed], known), width)
                    for q in np.flatnonzero(whole(hashed)).tolist():
                        rows.append((ident, q, int(hashed[q]), 0, False, found[q : q + width]))
            yield pd.DataFrame(rows, columns=["doc_id", "at", "anchor", "lead", "anchored", "around"])

    return documents.select("id", "text").mapInPandas(run, "doc_id long, at long, anchor long, lead int, anchored boolean, around array<string>")


_FOUND = "doc_id long, item_id long, doc_position long, item_position long, same boolean"


def retold_windows(documents: DataFrame, items: DataFrame, width: int, *, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Windows of ``width`` words of items that documents tell with any other numbers, names or units.

    Names and units are those of :func:`slot_lexicon` over all items. In a document any word may stand in their place,
    known to the items or not, and in any case. Numbers stand for numbers. Equal words on one side must be equal words
    on the other. Documents are looked through once, for runs of :data:`ANCHOR` words of an item without a name or unit;
    a window without such a run needs, in place of names and units, names and units of the items or words that no item
    has. Result as of :func:`shared_windows`; positions count numbers, and units glued to them, as words.
    """
    items = items.select("id", "text")
    slots = {r["word"]: r["slot"] for r in _vocabulary(slot_lexicon(items))}
    there = cut(_patterns(items, width, slots))
    n_windows = there.count()
    if not n_windows:
        return documents.sparkSession.createDataFrame([], _FOUND)
    short, bare = hash_filter(there.filter("anchored"), "anchor", most_bits=filter_bits), there.filter("not anchored")
    whole, plain = None, set()
    if bare.take(1):
        whole = hash_filter(bare, "anchor", most_bits=filter_bits)
        used = items.select("text").mapInPandas(lambda batches: (pd.DataFrame({"w": sorted({w for t in b["text"] for w in parts(t)})}, dtype=object) for b in batches), "w string")
        plain = {r["w"] for r in _vocabulary(used.distinct())}
    here = _places(documents, width, slots, plain, short, whole)
    met = here.join(F.broadcast(there) if n_windows <= BROADCAST_RETOLD else there, ["anchor", "anchored"])
    begin = F.col("lead") - F.col("offset")
    met = met.filter((begin >= 0) & (begin + width <= F.size("around")))
    met = met.select("doc_id", "item_id", (F.col("at") - F.col("offset")).alias("doc_position"), "item_position", F.slice("around", F.greatest(begin, F.lit(0)) + 1, F.lit(width)).alias("told"), "item", "pattern")
    number = lambda w: w.rlike(r"^\p{Nd}")
    fits = F.zip_with("told", "pattern", lambda w, p: F.when(p == SLOT, ~number(w)).when(p == NUMBER, number(w)).otherwise(w == p))
    met = met.filter(F.forall(fits, lambda x: x))
    filled = F.filter(F.arrays_zip("told", "item", "pattern"), lambda z: z["pattern"].isin(SLOT, NUMBER))
    pairs = F.array_distinct(F.transform(filled, lambda z: F.struct(z["told"].alias("d"), z["item"].alias("i"))))
    met = met.withColumn("pairs", pairs)
    one_to_one = (F.size(F.array_distinct(F.col("pairs.d"))) == F.size("pairs")) & (F.size(F.array_distinct(F.col("pairs.i"))) == F.size("pairs"))
    return met.filter(one_to_one).select("doc_id", "item_id", "doc_position", "item_position", (F.col("told") == F.col("item")).alias("same"))


def shared_windows(documents: DataFrame, items: DataFrame, width: int, *, exact: bool, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Pairs of windows of ``width`` words with equal templates whose slots are consistent.

    ``documents(id, text)`` and ``items(id, text)`` have unique ids. Numbers, names and units of the words become
    typed placeholders, by one lexicon over all items; windows of both sides meet on the hash of their template. With
    ``exact`` the slots must hold the same words (so must all other words, which also rules out hash collisions).
    Otherwise slots are consistent if equal words on one side are equal words on the other, so an item told again with
    other numbers and names is found as well; see :func:`retold_windows`.

    Documents are read once, however many items there are: a filter of bounded size (:func:`hash_filter`) drops most of
    their windows where they are made, and the rest meet the items' windows in a join, which is a broadcast one only for
    a counted small number of these.

    Result: ``(doc_id, item_id, doc_position, item_position, same)``. Null, empty and short texts have no window.
    """
    if not exact:
        return retold_windows(documents, items, width, filter_bits=filter_bits)
    items = items.select("id", "text")
    slots = {r["word"]: r["slot"] for r in _vocabulary(slot_lexicon(items))}
    there = cut(_windows(items, width, slots, None).select(F.col("id").alias("item_id"), F.col("position").alias("item_position"), "template", "words"))
    here = _windows(documents, width, slots, hash_filter(there, "template", most_bits=filter_bits))
    here = here.select(F.col("id").alias("doc_id"), F.col("position").alias("doc_position"), "template", "words")
    met = here.join(F.broadcast(there) if there.count() <= BROADCAST_WINDOWS else there, ["template", "words"])
    return met.select("doc_id", "item_id", "doc_position", "item_position", F.lit(True).alias("same"))


def _texts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    return documents, table(spark, folder, "eval_items").select(F.col("item_id").alias("id"), "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with at least 13 successive words of an evaluation item."""
    return shared_windows(*_texts(spark, folder), 13, exact=True).select("doc_id", "item_id").distinct()


def p8_retold(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with at least 24 successive words of an item told with other numbers, names or units.

    Counted are positions of the document where the template agrees and the slots are consistent; ``n_same`` of them
    repeat the item's very words.
    """
    met = shared_windows(*_texts(spark, folder), 24, exact=False)
    per = met.groupBy("doc_id", "item_id", "doc_position").agg(F.max("same").alias("same"))
    return per.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_windows"), F.count_if("same").alias("n_same"))


QUERIES = {"p8_found": p8_found, "p8_retold": p8_retold}

_TOKENS = f"regexp_extract_all(lower(replace(replace(replace(replace(regexp_replace(text, '{TAG_SQL}', ' ', 'g'), '&#39;', ''''), '&amp;', '&'), '&nbsp;', ' '), '&quot;', '\"')), '[\\p{{L}}\\p{{N}}]+')"
ORACLE = {
    "p8_found": f"""
with d as (select doc_id, {_TOKENS} as w from documents where text is not null),
     i as (select item_id, {_TOKENS} as w from eval_items where text is not null),
     dw as (select distinct doc_id, list_aggregate(w[k : k + 12], 'string_agg', ' ') as win from d, unnest(range(1, greatest(len(w) - 11, 1))) as t(k) where len(w) >= 13),
     iw as (select distinct item_id, list_aggregate(w[k : k + 12], 'string_agg', ' ') as win from i, unnest(range(1, greatest(len(w) - 11, 1))) as t(k) where len(w) >= 13)
select distinct doc_id, item_id from dw join iw using (win)""",
}
