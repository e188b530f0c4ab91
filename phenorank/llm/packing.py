"""Items of varying length packed into containers of fixed capacity, the sources mixed in given proportions.

Deficit round-robin: whenever a container is opened, every source's account is credited with its share of the
capacity, and is charged for what it places. Items larger than their source's share are spread evenly over the
containers; the other room goes to the source with the largest account, and to that of its items which fits the account
best. Items over the capacity must be cut anyway, and are cut to what an account or the room still lacks. Accounts go
over from container to container, from partition to partition (what the partitions before placed too much or too little
of a source is worked out from their totals), and to the second pass, in which containers that stay badly filled are
taken apart and packed once more, together with those of other partitions.
"""

from __future__ import annotations

import base64
import math
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenorank.session import broadcast_if_small, written

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how the vocabulary's tokenizer cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CAPACITY = 2048
#: Tokens that one task packs at once.
TASK_TOKENS = 4_000_000
#: Containers filled less than this are packed once more.
WELL_FILLED = 0.97
#: An item over the capacity isn't cut into less than this, but for its rest and to fill a container.
LEAST_PIECE = 256

_encodings: dict[int, object] = {}


def with_token_counts(documents: DataFrame, column: str = "text", out: str = "n_tokens", tokenizer: str = TOKENIZER) -> DataFrame:
    """``documents`` with the number of tokens of ``column``, 0 where it is null. Whole texts, one pass, no shuffle.

    The vocabulary file is read once on the driver and broadcast, so workers need no copy of it.
    """
    base = documents.drop(out) if out in documents.columns else documents
    at = base.columns.index(column)
    with open(tokenizer, "rb") as file:
        content = file.read()
    shared = documents.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        key = hash(shared.value)
        encoding = _encodings.get(key)
        if encoding is None:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, shared.value.splitlines())}
            encoding = _encodings[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            counts = pa.array([len(encoding.encode_ordinary(text.as_py())) if text.is_valid else 0 for text in batch.column(at)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, counts], [*batch.schema.names, out])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(out, T.LongType())]))


class _Queue:
    """The items of one source: those within its share and larger ones by size, and those over the capacity, to be cut."""

    def __init__(self, items: list[tuple[int, int, int]], capacity: int, share: float):
        fit = sorted(i for i in items if i[0] <= capacity)
        at = bisect_right(fit, share * capacity, key=lambda i: i[0])
        self.small, self.large = fit[:at], fit[at:]
        self.cut = sorted((i for i in items if i[0] > capacity), reverse=True)
        self.done = 0  # tokens placed of the last of ``cut``, and pieces made of it
        self.pieces = 0
        self.left = sum(i[0] for i in items)

    def _best(self, items: list, most: float) -> int:
        return bisect_right(items, most, key=lambda i: i[0]) - 1

    def whole(self, most: float, large: bool) -> tuple | None:
        """The largest item up to ``most`` tokens: (tokens, id, piece, first token)."""
        items = self.large if large else self.small
        k = self._best(items, most)
        if k < 0:
            return None
        size, id_, piece, start = items.pop(k)
        self.left -= size
        return size, id_, piece, start

    def piece(self, most: int, least: int = LEAST_PIECE) -> tuple | None:
        """The next ``most`` tokens of an item that is to be cut."""
        if not self.cut or most < 1:
            return None
        size, id_, _, _ = self.cut[-1]
        take = min(most, size - self.done)
        if take < least and take < size - self.done:
            return None
        out = take, id_, self.pieces, self.done
        self.done, self.pieces, self.left = self.done + take, self.pieces + 1, self.left - take
        if self.done == size:
            self.cut.pop()
            self.done = self.pieces = 0
        return out


def fill(items: list[tuple], capacity: int, shares: dict[str, float], accounts: dict[str, float]) -> list[list[tuple]]:
    """Containers of (size, id, piece, first token, source) from ``items`` (size, id, piece, first token, source).

    Each is within ``capacity``; ``accounts`` is carried on.
    """
    of: dict[str, list[tuple]] = {}
    for *item, source in items:
        of.setdefault(source, []).append(tuple(item))
    queues = {s: _Queue(q, capacity, shares.get(s, 0.0)) for s, q in sorted(of.items())}
    large_left = sum(i[0] for q in queues.values() for i in q.large)
    containers = []
    while queues:
        for source, share in shares.items():
            accounts[source] = accounts.get(source, 0.0) + share * capacity
        room, inside = capacity, []

        def put(source: str, item: tuple | None) -> bool:
            nonlocal room
            if item is None:
                return False
            inside.append((*item, source))
            room -= item[0]
            accounts[source] = accounts.get(source, 0.0) - item[0]
            return True

        # large items at an even pace, each from the source that is owed most
        due = large_left / max(1, sum(q.left for q in queues.values())) * capacity
        while due > 0:
            order = sorted((s for s, q in queues.items() if q.large), key=lambda s: (-accounts.get(s, 0.0), s))
            before = room
            if not any(put(s, queues[s].whole(room, True)) for s in order):
                break
            large_left -= before - room
            due -= 1.5 * (before - room)  # another one only where half of it is still due
        while room:
            order = sorted(queues, key=lambda s: (-accounts.get(s, 0.0), s))
            owed = [s for s in order if accounts.get(s, 0.0) >= 1]
            if any(put(s, queues[s].whole(min(room, accounts[s]), False)) or put(s, queues[s].piece(int(min(room, accounts[s])))) for s in owed):
                continue
            # nothing fits what is owed: what comes next fills the room, whole items first
            if any(put(s, queues[s].whole(room, False)) for s in order) or any(put(s, queues[s].piece(room, 1)) for s in order):
                continue
            before = room
            if not any(put(s, queues[s].whole(room, True)) for s in order):
                break
            large_left -= before - room
        queues = {s: q for s, q in queues.items() if q.left}
        containers.append(inside)
    return containers


_PLACED = "level int, part bigint, window bigint, id bigint, piece bigint, source string, size bigint, token_from bigint, place bigint, filled bigint"


def _beside(rows: DataFrame, one: DataFrame) -> DataFrame:
    """``rows`` with the columns of the single row ``one``."""
    return rows.withColumn("__one", F.lit(1)).join(F.broadcast(one.withColumn("__one", F.lit(1))), "__one").drop("__one")


def _packed(items: DataFrame, shares: DataFrame, capacity: int, task_tokens: int, level: int, carried: DataFrame | None = None) -> DataFrame:
    """``items(id, piece, source, size, token_from)`` placed in containers, in partitions of about ``task_tokens``.

    ``shares(source, share)``; ``carried(source, gap)`` is what is owed before the first partition.
    """
    total = items.agg(F.coalesce(F.sum("size"), F.lit(0))).collect()[0][0]
    tasks = max(1, math.ceil(total / task_tokens))
    parted = items.withColumn("part", F.pmod(F.xxhash64("id", "piece", F.lit(level)), F.lit(tasks))).select("part", "id", "piece", "source", "size", "token_from")
    # what the partitions before owe each source: tasks x sources rows
    per = parted.groupBy("part", "source").agg(F.sum("size").alias("used"))
    whole = per.groupBy("part").agg(F.sum("used").alias("all"))
    due = _beside(whole, shares.groupBy().agg(F.collect_list(F.struct("source", "share")).alias("s"))).select("part", "all", F.inline("s"))
    gap = due.join(per, ["part", "source"], "left").select("part", "source", "share", (F.col("all") * F.col("share") - F.coalesce("used", F.lit(0))).alias("gap"))
    before = F.coalesce(F.sum("gap").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    accounts = gap.withColumn("gap", before)
    if carried is not None:
        accounts = accounts.join(carried.withColumnRenamed("gap", "__c"), "source", "left").withColumn("gap", F.col("gap") + F.coalesce("__c", F.lit(0.0)))
    opened = accounts.select(F.col("part").alias("of"), "source", "share", "gap")

    def pack(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        wanted = dict(zip(right["source"], right["share"], strict=True))
        owed = dict(zip(right["source"], right["gap"], strict=True))
        rows = list(zip(left["size"].tolist(), left["id"].tolist(), left["piece"].tolist(), left["token_from"].tolist(), left["source"].tolist(), strict=True))
        out = []
        for window, inside in enumerate(fill(rows, capacity, wanted, owed)):
            filled, place = sum(i[0] for i in inside), 0
            for size, id_, piece, start, source in inside:
                out.append((level, key[0], window, id_, piece, source, size, start, place, filled))
                place += size
        return pd.DataFrame(out, columns=[c.split(" ")[0] for c in _PLACED.split(", ")])

    return parted.groupBy("part").cogroup(opened.groupBy("of")).applyInPandas(pack, _PLACED)


def packed(documents: DataFrame, capacity: int = CAPACITY, shares: dict[str, float] | None = None, tokenizer: str = TOKENIZER, task_tokens: int = TASK_TOKENS) -> DataFrame:
    """``(doc_id, piece, container_id, token_from, n_tokens, place)``: where each document's tokens go.

    Every document with a token is placed whole, in one piece, unless it has more tokens than ``capacity``; then it is
    cut. ``token_from`` is the piece's first token in the document, ``place`` its first in the container. ``shares`` are
    the token proportions wanted per source, by default those of the documents; a source without one is owed nothing.
    Documents with null or empty text have no tokens and no row; null ids are left out; rows that repeat an id are one
    document. A null source is a source of its own, named ''.
    """
    return _containers(documents, capacity, shares, tokenizer, task_tokens)[0].select("doc_id", "piece", "container_id", "token_from", "n_tokens", "place")


def _containers(documents: DataFrame, capacity: int, shares: dict[str, float] | None, tokenizer: str, task_tokens: int) -> tuple[DataFrame, DataFrame]:
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    spark = documents.sparkSession
    counted = with_token_counts(documents.select("doc_id", "text", F.coalesce("source", F.lit("")).alias("source")).where("doc_id is not null and text is not null"), tokenizer=tokenizer)
    counted = counted.groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source")).alias("x")).select("doc_id", "x.n_tokens", "x.source").where("n_tokens > 0")
    counted, _ = written(counted, "tokens")
    if shares is None:
        per = counted.groupBy("source").agg(F.sum("n_tokens").alias("n"))
        wanted = per.select("source", F.try_divide("n", F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("share"))
    else:
        whole = sum(shares.values()) or 1
        wanted = spark.createDataFrame([(s, v / whole) for s, v in shares.items()], "source string, share double")
    wanted, _ = written(wanted, "shares")
    zero = F.lit(0).cast("bigint")
    items = counted.select(F.col("doc_id").alias("id"), zero.alias("piece"), "source", F.col("n_tokens").alias("size"), zero.alias("token_from"))
    first, _ = written(_packed(items, wanted, capacity, task_tokens, 1), "packed")
    good = F.col("filled") >= WELL_FILLED * capacity
    used = first.where(good).groupBy("source").agg(F.sum("size").alias("used"))
    all_ = used.groupBy().agg(F.sum("used").alias("all"))
    owed = _beside(wanted.join(used, "source", "left"), all_).select("source", (F.col("share") * F.coalesce("all", F.lit(0)) - F.coalesce("used", F.lit(0))).alias("gap"))
    again = _packed(first.where(~good).select("id", "piece", "source", "size", "token_from"), wanted, capacity, task_tokens, 2, owed)
    placed = first.where(good).unionByName(again)
    return placed.withColumn("container_id", F.concat_ws("-", "level", "part", "window")).withColumnsRenamed({"id": "doc_id", "size": "n_tokens"}), wanted


def filling(spark: SparkSession, documents: DataFrame, capacity: int = CAPACITY, shares: dict[str, float] | None = None) -> DataFrame:
    """One row: how full the containers are, and how far their mixtures are from the shares wanted.

    ``deviation`` is the total variation distance of a container's token shares from those wanted, ``forced`` what its
    largest item alone makes of it, since items are placed whole: an item of a third of the container, of a source with
    a share of a fifth, can't but leave a distance of two fifteenths. ``beyond`` is their difference. Medians, and the
    ninth decile of ``beyond``, over all containers; ``overall`` is the distance of all tokens together.
    """
    placed, wanted = _containers(documents, capacity, shares, TOKENIZER, TASK_TOKENS)
    placed, _ = written(placed.select("container_id", "source", "n_tokens", "filled"), "placed")
    per = placed.groupBy("container_id", "filled", "source").agg(F.sum("n_tokens").alias("used"), F.max("n_tokens").alias("most"))
    per = per.join(broadcast_if_small(wanted), "source", "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    over = lambda n: F.greatest(F.lit(0.0), F.try_divide(F.col(n), F.col("filled")) - F.col("share"))
    boxes = per.groupBy("container_id", "filled").agg(F.sum(over("used")).alias("deviation"), F.max(over("most")).alias("forced"))
    boxes = boxes.withColumn("beyond", F.col("deviation") - F.col("forced"))
    whole = per.groupBy("source", "share").agg(F.sum("used").alias("used")).withColumn("filled", F.sum("used").over(Window.partitionBy(F.lit(0))))
    overall = whole.agg(F.round(F.coalesce(F.sum(over("used")), F.lit(0.0)), 6).alias("overall"))
    middle = lambda c, q=0.5: F.round(F.percentile_approx(c, q, 10_000), 4)
    return _beside(boxes.agg(
        F.count("*").alias("containers"), F.coalesce(F.sum("filled"), F.lit(0)).alias("tokens"), middle("deviation").alias("deviation"), middle("forced").alias("forced"),
        middle("beyond").alias("beyond"), middle("beyond", 0.9).alias("beyond_90"),
    ), overall).select(
        "containers", "tokens", (F.col("containers") * capacity - F.col("tokens")).alias("room_left"), F.round(F.try_divide(F.col("tokens"), F.col("containers") * capacity), 6).alias("share_used"),
        "deviation", "forced", "beyond", "beyond_90", "overall",
    )
