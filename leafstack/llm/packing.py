"""Filling containers of fixed capacity (problem 3).

Partitions of items are packed by best-fit decreasing. Lower bounds from dual-feasible functions tell how many containers a
partition needs at least; partitions that use more give up the items of their open containers, which meet those of other
such partitions and are packed again. A new packing is kept only where it needs fewer containers.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafstack.common import maybe_broadcast, written
from leafstack.llm.splitting import split_oversized

#: Items in a partition of the first round, and partitions that meet in each later round.
PARTITION, MEET = 8_192, 4


def lower_bound(sizes: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """Containers that the items need at least: the best of several families of dual-feasible functions.

    A dual-feasible function maps sizes so that any set that fits still fits; the mapped total over the capacity is a bound.
    """
    sizes = np.asarray(sizes, dtype=np.int64)
    counts = np.ones(len(sizes), dtype=np.int64) if counts is None else np.asarray(counts, dtype=np.int64)
    sizes, at = np.unique(sizes, return_inverse=True)
    counts = np.bincount(at, weights=counts, minlength=len(sizes)).astype(np.int64)
    keep = (sizes > 0) & (counts > 0)
    sizes, counts = sizes[keep], counts[keep]
    if not len(sizes):
        return 0
    c = int(capacity)
    best = -(-int(sizes @ counts) // c)
    # Large items fill up, small ones vanish: for each limit e the sizes of [e, c - e] count as they are and larger ones as c.
    total, much = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(sizes * counts)]
    e = np.unique(np.r_[sizes[2 * sizes <= c], c + 1 - sizes[2 * sizes > c]])
    e = e[(e > 0) & (2 * e <= c)]
    if len(e):
        low, high = np.searchsorted(sizes, e), np.searchsorted(sizes, c - e, side="right")
        best = max(best, int((-(-(much[high] - much[low] + c * (total[-1] - total[high])) // c)).max()))
    for k in range(1, min(c, 32)):  # sizes round to multiples of c / k
        # scaled by k: an exact multiple of c / (k + 1) keeps its size
        whole = (k + 1) * sizes % c == 0
        mapped = np.where(whole, k * sizes, (k + 1) * sizes // c * c)
        best = max(best, -(-int(mapped @ counts) // (k * c)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item: largest first, each into the fullest container that still has room.

    Items of size 0 go to the first container.
    """
    out = np.zeros(len(sizes), dtype=np.int64)
    room: list[tuple[int, int]] = []  # (free, container) of containers with free space, ascending
    used = 0
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        if s == 0:
            used = max(used, 1)
            continue
        at = bisect_left(room, (s, -1))
        if at < len(room):
            free, box = room.pop(at)
        else:
            free, box, used = capacity, used, used + 1
        if free > s:
            insort(room, (free - s, box))
        out[i] = box
    return out


_KEEP = ["pool", "capacity", "item", "size"]


def _packed(df: pd.DataFrame, capacity: int, name: str) -> pd.DataFrame:
    """``df`` packed anew, or as before where that needs no more containers; with what is certified and what moves on."""
    sizes = df["size"].to_numpy()
    box = best_fit_decreasing(sizes, capacity)
    old = df["container"]
    if old.isna().any() or box.max() + 1 < old.nunique():
        df["container"] = [f"{name}.{b}" for b in box]
    else:
        box = pd.factorize(old)[0]
    fill, items = np.bincount(box, weights=sizes), np.bincount(box)
    gap = len(fill) > max(1, lower_bound(sizes, capacity))
    # The emptiest containers move on, of so many items that the next group is no larger than a first partition.
    order = np.argsort(fill, kind="stable")
    moves = np.zeros(len(fill), dtype=bool)
    moves[order[np.cumsum(items[order]) <= max(PARTITION // MEET, items[order[0]])]] = True
    df["open"] = (moves & (fill < capacity))[box] if gap else False
    df["certified"] = not gap
    return df


def _round(number: int):
    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("item", kind="stable").reset_index(drop=True)
        return _packed(df, int(df["capacity"].iloc[0]), f"{number}.{key[1]}")

    return run


def pack(items: DataFrame, rounds: int | None = None) -> DataFrame:
    """Containers for ``items`` (pool string, capacity int, item string unique in its pool, size int of 0..capacity).

    Returns all items with ``container`` (unique in its pool) and ``certified``: whether the partition that packed it uses
    no more containers than its lower bound. Items of one pool share containers, pools never do. The items are cut into
    partitions of about ``PARTITION`` by hash, so a pool of any size spreads over many tasks.

    Partitions with a gap exchange documents: their emptiest containers, of up to ``PARTITION / MEET`` items, meet those of
    ``MEET`` - 1 others and are packed again, and a new packing counts where it needs fewer containers. That goes on until
    no partition with a gap has anything to give or all partitions of a pool have met (or for ``rounds`` rounds). No task
    ever holds more than about ``PARTITION`` items, whatever the pool's size.
    """
    items = written(items.select(*_KEEP), "items")  # keys and sizes only; finding them may have meant splitting all texts
    counts = written(items.groupBy("pool").agg(F.count(F.lit(1)).alias("n")), "pool-sizes")
    if rounds is None:
        partitions, rounds = -(-(counts.agg(F.max("n")).first()[0] or 0) // PARTITION), 0
        while MEET**rounds < partitions:
            rounds += 1
    kind = items.schema["item"].dataType.simpleString()
    schema = f"pool string, capacity int, item {kind}, size int, bucket long, container string, open boolean, certified boolean"
    state = items.join(maybe_broadcast(counts), "pool").select(*_KEEP, F.pmod(F.xxhash64("item"), F.greatest(F.lit(1), F.ceil(F.col("n") / PARTITION))).alias("bucket"))
    state = state.select(*_KEEP, "bucket", F.lit(None).cast("string").alias("container"))
    settled = None
    for r in range(rounds + 1):
        out = written(state.groupBy("pool", "bucket").applyInPandas(_round(r), schema), f"packed-{r}")
        done = out if r == rounds else out.filter("NOT open")
        settled = done if settled is None else settled.unionByName(done)
        if r < rounds:
            state = out.filter("open").select(*_KEEP, F.floor(F.col("bucket") / MEET).alias("bucket"), "container")
            if state.isEmpty():
                break
    return settled.select(*_KEEP, "container", "certified")


def chunk_items(chunks: DataFrame, configs: DataFrame) -> DataFrame:
    """Items of rag_chunks: one per chunk, or per piece of a chunk beyond the capacity of its config.

    Chunks of one config share containers. Whole copies of a chunk count once, also where keys are null; null and empty
    texts are items of size 0; chunks without a usable config or capacity are in no pool and give no item (see
    :func:`unpackable`).
    """
    caps = configs.groupBy("config_id").agg(F.max("chunk_max_chars").alias("capacity")).filter("capacity > 0")
    rows = chunks.select("config_id", "package_id", "chunk_id", "text").distinct().join(maybe_broadcast(caps), "config_id")
    pieces = split_oversized(rows.withColumn("copy", F.xxhash64("text")), "text", "capacity", with_text=False)
    return pieces.select("config_id", "package_id", "chunk_id", F.coalesce("piece_no", F.lit(1)).alias("piece_no"), F.coalesce("piece_chars", F.lit(0)).alias("size"), "capacity", "copy")


def pack_chunks(chunks: DataFrame, configs: DataFrame, rounds: int | None = None) -> DataFrame:
    """config_id, container, package_id, chunk_id, piece_no (from 1), size, capacity, certified: the containers of all chunk texts."""
    items = chunk_items(chunks, configs)
    name = F.to_json(F.array(*(F.col(c).cast("string") for c in ("package_id", "chunk_id", "piece_no", "copy"))))
    packed = pack(items.select(F.col("config_id").alias("pool"), "capacity", name.alias("item"), "size"), rounds)
    part = F.from_json("item", "array<string>")
    return packed.select(F.col("pool").alias("config_id"), "container", part[0].cast("long").alias("package_id"), part[1].alias("chunk_id"), part[2].cast("int").alias("piece_no"), "size", "capacity", "certified")


def unpackable(chunks: DataFrame, configs: DataFrame) -> DataFrame:
    """Chunks that :func:`pack_chunks` leaves out because their config is unknown or has no capacity."""
    return chunks.join(configs.filter("chunk_max_chars > 0").select("config_id").distinct(), "config_id", "left_anti")


def packing_report(packed: DataFrame) -> DataFrame:
    """Per config: items, containers, the certified lower bound, their gap, the containers of partitions that stayed above
    their own bound, and the share of the capacity that is filled."""
    sizes = packed.groupBy("config_id", "capacity", "size").agg(F.count(F.lit(1)).alias("n"))
    boxes = packed.groupBy("config_id", "container").agg(F.min("certified").alias("certified"))
    used = boxes.groupBy("config_id").agg(F.count(F.lit(1)).alias("containers"), F.sum((~F.col("certified")).cast("long")).alias("uncertified"))

    def bound(df: pd.DataFrame) -> pd.DataFrame:  # at most capacity + 1 rows: one per size
        c, s, n = int(df["capacity"].iloc[0]), df["size"].to_numpy(), df["n"].to_numpy()
        return pd.DataFrame({"config_id": [df["config_id"].iloc[0]], "capacity": [c], "items": [int(n.sum())], "chars": [int(s @ n)], "lower_bound": [max(1, lower_bound(s, c, n))]})

    kind = "config_id string, capacity int, items long, chars long, lower_bound long"
    out = sizes.groupBy("config_id").applyInPandas(bound, kind).join(used, "config_id")
    return out.select(
        "config_id", "capacity", "items", "containers", "lower_bound", (F.col("containers") - F.col("lower_bound")).alias("gap"), "uncertified",
        (F.col("chars") / (F.col("containers") * F.col("capacity"))).alias("fill"),
    )


def packing_audit(packed: DataFrame) -> DataFrame:
    """Per config: chunks, split ones (of more than one piece), characters, containers filled beyond the capacity, and
    whether the containers are no fewer than the characters need."""
    boxes = packed.groupBy("config_id", "capacity", "container").agg(F.sum("size").alias("fill"), F.sum((F.col("piece_no") == 1).cast("long")).alias("chunks"), F.sum((F.col("piece_no") == 2).cast("long")).alias("split"))
    per = boxes.groupBy("config_id", "capacity").agg(
        F.sum("chunks").alias("chunks"), F.sum("split").alias("split_chunks"), F.sum("fill").alias("chars"), F.sum((F.col("fill") > F.col("capacity")).cast("long")).alias("overfull"), F.count(F.lit(1)).alias("n")
    )
    return per.select("config_id", "chunks", "split_chunks", "chars", "overfull", (F.col("n") * F.col("capacity") >= F.col("chars")).alias("enough"))
