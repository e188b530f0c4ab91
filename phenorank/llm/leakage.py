"""Evaluation passages inside training text: MinHash containment search, verified by exact shingle containment.

What must be contained is a passage, a part of an item, so both sides are cut to the size of a shortest passage: items
and documents, however long, are compared through sets of one size. A passage of which at most one word in so many is
changed keeps a run of untouched words; the minima of the hashed shingles of every window that short are the same on
both sides, so a document and an item that share a passage share a minimum: none is lost. Documents are read once,
whatever the number of items; only stretches that hold enough of the items' shingles, told by a bitmap, leave that pass
and are joined with the items on the minima. Pairs are verified by the shingles they share and by aligning the words.
"""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenorank.llm.words import folded, shingles, word_hashes
from phenorank.session import written, written_counting


@dataclass(frozen=True)
class Search:
    """Words of a passage at least, one word in how many may differ, and words of a shingle."""

    passage: int = 30
    one_in: int = 10
    shingle: int = 5

    @property
    def errors(self) -> int:
        return self.passage // self.one_in

    @property
    def least_shingles(self) -> int:
        """Shingles of a shortest passage that errors can't have touched."""
        return max(1, self.passage - self.shingle + 1 - self.errors * self.shingle)

    @property
    def window(self) -> int:
        """Shingles in a row that some run between errors leaves whole."""
        return max(1, math.ceil((self.passage - self.errors) / (self.errors + 1)) - self.shingle + 1)

    @property
    def reach(self) -> int:
        return self.passage + self.errors


#: Bits of the bitmap per shingle of the items, and the most of all (32 MB): beyond, it tells apart less, never wrongly.
BITS_PER_SHINGLE, MOST_BITS, CHUNK_BITS = 32, 28, 17


def minima(codes: np.ndarray, window: int) -> np.ndarray:
    """The different minima of all runs of ``window`` codes."""
    if len(codes) < window:
        return codes[:0]
    least = codes[: len(codes) - window + 1].copy()
    for k in range(1, window):
        np.minimum(least, codes[k : len(codes) - window + 1 + k], out=least)
    return np.unique(least)


def holds(doc: np.ndarray, item: np.ndarray, chunk: np.ndarray, search: Search) -> bool:
    """Whether ``doc`` has a passage of ``item``: enough consecutive words, of which at most one in so many is changed, dropped or added."""
    blocks = difflib.SequenceMatcher(None, doc.tolist(), item.tolist(), False).get_matching_blocks()
    wrong = np.ones(len(item) + 1, np.int64)  # per word of the item; the additions before it count with it
    added = np.zeros(len(item) + 1, np.int64)
    at_doc = at_item = 0
    for d, i, n in blocks:
        gap_doc, gap_item = d - at_doc, i - at_item
        if at_item and n:
            added[i] += max(0, gap_doc - gap_item)
        wrong[i : i + n] = 0
        at_doc, at_item = d + n, i + n
    # in words as printed: one is wrong where a part of it is
    first = np.unique(chunk, return_index=True)[1]
    printed = np.maximum.reduceat(wrong[: len(item)], first), np.add.reduceat(added[: len(item)], first)
    for use_wrong, use_added in ((wrong[: len(item)], added[: len(item)]), printed):
        if len(use_wrong) < search.passage:
            continue
        balance = np.concatenate([[0], np.cumsum(1 - search.one_in * (use_wrong + use_added))])
        start = np.minimum.accumulate(balance[:-1] - search.one_in * use_added)  # what is added before the first word is outside
        ends = np.arange(search.passage, len(use_wrong) + 1)
        if (balance[ends] >= start[ends - search.passage]).any():
            return True
    return False


def contained(stretch: np.ndarray, codes: np.ndarray, item: np.ndarray, item_codes: np.ndarray, chunk: np.ndarray, search: Search) -> bool:
    """Exact shingle containment, then alignment: whether ``stretch`` of a document has a passage of ``item``; ``item_codes`` are sorted."""
    at = np.searchsorted(item_codes, codes)
    at[at == len(item_codes)] = 0
    places = np.flatnonzero(item_codes[at] == codes)
    if len(places) < search.least_shingles:
        return False
    if (np.searchsorted(places, places + search.reach) - np.arange(len(places))).max() < search.least_shingles:
        return False
    low, high = max(0, places[0] - search.reach), places[-1] + search.shingle + search.reach
    return holds(stretch[low:high], item, chunk, search)


def item_rows(ids: list, texts: list[str], search: Search) -> list[tuple]:
    """(item, words, number of each word as printed, shingles, minima); items shorter than a passage have no row."""
    rows = []
    for item, text in zip(ids, texts, strict=True):
        joined = folded(text)
        words, _, place = word_hashes([joined])
        blanks = np.cumsum(np.frombuffer(joined + b" ", np.uint8) <= 32)  # words between the same blanks are one word in print
        codes = shingles(words, search.shingle)
        if len(codes) >= search.least_shingles:
            rows.append((item, words.view(np.int64), blanks[place].astype(np.int32), codes.view(np.int64), minima(codes, search.window).view(np.int64)))
    return rows


def stretches(texts: list[bytes], likely: np.ndarray, bits: int, search: Search) -> list[tuple[int, np.ndarray]]:
    """(number of the text, words) of all stretches with enough likely shingles within the span of a shortest passage."""
    words, text_of, _ = word_hashes(texts)
    codes = shingles(words, search.shingle)
    if not len(codes):
        return []
    at = codes >> np.uint64(64 - bits)
    places = np.flatnonzero((likely[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)
    # shingles over the end of a text aren't any
    places = places[text_of[places] == text_of[places + search.shingle - 1]]
    if not len(places):
        return []
    same = np.searchsorted(places, places + search.reach)
    same = np.minimum(same, np.searchsorted(text_of[places], text_of[places], "right"))
    enough = np.flatnonzero(same - np.arange(len(places)) >= search.least_shingles)
    if not len(enough):
        return []
    keep = np.zeros(len(places) + 1, np.int32)
    np.add.at(keep, enough, 1)
    np.add.at(keep, same[enough], -1)
    places = places[np.cumsum(keep[:-1]) > 0]
    breaks = np.flatnonzero((np.diff(places) > search.reach) | (np.diff(text_of[places]) != 0)) + 1
    start, end = np.searchsorted(text_of, np.arange(len(texts)), "left"), np.searchsorted(text_of, np.arange(len(texts)), "right")
    out = []
    for run in np.split(places, breaks):
        text = int(text_of[run[0]])
        out.append((text, words[max(start[text], run[0] - search.reach) : min(end[text], run[-1] + search.shingle + search.reach)]))
    return out


_LIST = pa.list_(pa.int64())


def _lists(arrays: list[np.ndarray], kind: pa.DataType = pa.int64()) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64), kind))


def _bitmap(codes: DataFrame, bits: int) -> bytes:
    """A bit for the leading bits of every code, made in parts of fixed size; at most ``2**MOST_BITS`` bits reach the driver."""
    small = min(bits, CHUNK_BITS)
    at = codes.select(F.shiftrightunsigned("code", 64 - bits).alias("at")).distinct()
    at = at.select(F.shiftright("at", small).alias("part"), F.col("at").bitwiseAND(F.lit((1 << small) - 1)).cast("int").alias("bit"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(1 << small, np.uint8)
        flags[pdf["bit"].to_numpy()] = 1
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "bits": [np.packbits(flags, bitorder="little").tobytes()]})

    size = (1 << small) // 8
    out = bytearray(size << (bits - small))
    for row in at.groupBy("part").applyInPandas(fill, "part bigint, bits binary").toLocalIterator():
        out[row.part * size : (row.part + 1) * size] = row.bits
    return bytes(out)


def leaked(documents: DataFrame, items: DataFrame, search: Search = Search(), chunk_bytes: int = 2_000_000) -> DataFrame:
    """``(doc_id, item_id)``: documents that hold a passage of an item, whole texts against whole items.

    Letter case, accents, punctuation, line breaks, markup and odd characters don't count. Null ids and texts, blank
    texts and items shorter than a passage give no row; repeated rows give one. Stretches that are the same in many
    documents are joined and verified once. The rows don't depend on how the tables are partitioned.
    """
    spark = documents.sparkSession
    doc_type, item_type = documents.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    wanted = items.select("item_id", "text").where("item_id is not null and text is not null")

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            rows = item_rows(list(range(len(ids))), batch.column(1).to_pylist(), search)
            columns = [ids.take(pa.array([r[0] for r in rows], pa.int64())), _lists([r[1] for r in rows]), _lists([r[2] for r in rows], pa.int32()), _lists([r[3] for r in rows]), _lists([r[4] for r in rows])]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "item_words", "chunk", "codes", "minima"])

    known, _, seen = written_counting(wanted.mapInArrow(prepare, f"item_id {item_type}, item_words array<bigint>, chunk array<int>, codes array<bigint>, minima array<bigint>"), "items", codes=F.sum(F.size("codes")))
    bits = min(MOST_BITS, max(10, (seen["codes"] * BITS_PER_SHINGLE).bit_length()))
    shared = spark.sparkContext.broadcast(_bitmap(known.select(F.explode("codes").alias("code")), bits))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        likely = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            of: list[int] = []
            found: list[np.ndarray] = []
            rows: list[int] = []
            texts: list[bytes] = []
            size = 0
            for row, text in enumerate(batch.column(1)):
                rows.append(row)
                texts.append(folded(text.as_py()))
                size += len(texts[-1])
                if size >= chunk_bytes or row == batch.num_rows - 1:
                    for number, words in stretches(texts, likely, bits, search):
                        of.append(rows[number])
                        found.append(words)
                    rows, texts, size = [], [], 0
            least = [minima(shingles(words, search.shingle), search.window).view(np.int64) for words in found]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), _lists([w.view(np.int64) for w in found]), _lists(least)], ["doc_id", "words", "minima"])

    docs = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    held, _ = written(docs.mapInArrow(read, f"doc_id {doc_type}, words array<bigint>, minima array<bigint>").withColumn("stretch", F.sha2(F.to_json("words"), 256)), "stretches")
    once = held.groupBy("stretch").agg(F.first("words").alias("words"), F.first("minima").alias("minima"))
    once, _ = written(once, "stretches")
    near = once.select("stretch", F.explode("minima").alias("code")).join(known.select("item_id", F.explode("minima").alias("code")), "code").select("stretch", "item_id").distinct()
    pairs = near.join(once.select("stretch", "words"), "stretch").join(known.select("item_id", "item_words", "chunk"), "item_id").select("stretch", "item_id", "words", "item_words", "chunk")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (flat, ends), (item_flat, item_ends), (chunks, chunk_ends) = ((np.asarray(c.values), np.asarray(c.offsets)) for c in (batch.column(k) for k in (2, 3, 4)))
            flat, item_flat = flat.view(np.uint64), item_flat.view(np.uint64)
            codes = shingles(flat, search.shingle)
            sorted_codes: dict[bytes, np.ndarray] = {}  # items stand together: each is prepared once a batch
            rows = []
            for k in range(batch.num_rows):
                a, b = item_ends[k], item_ends[k + 1]
                item = item_flat[a:b]
                own = sorted_codes.get(key := item.tobytes())
                if own is None:
                    own = sorted_codes[key] = np.sort(shingles(item, search.shingle))
                low, high = ends[k], ends[k + 1]
                if contained(flat[low:high], codes[low : max(low, high - search.shingle + 1)], item, own, chunks[chunk_ends[k] : chunk_ends[k + 1]], search):
                    rows.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(rows, pa.int64())) for c in (0, 1)], ["stretch", "item_id"])

    sure = pairs.mapInArrow(verify, f"stretch string, item_id {item_type}")
    return held.select("stretch", "doc_id").join(sure, "stretch").select("doc_id", "item_id").distinct()


def found(spark: SparkSession, documents: DataFrame, items: DataFrame) -> DataFrame:
    return leaked(documents, items)


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``(item_id, n_documents)`` of the items that leaked."""
    return leaked(documents, items).groupBy("item_id").agg(F.count("*").alias("n_documents"))
