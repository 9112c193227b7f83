"""Filling fixed-capacity containers with whole texts by a grouping genetic algorithm."""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.llm.common import map_texts
from quaystone.session import cut, ship_package

#: The public byte-level vocabulary; the path is a parameter everywhere.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of one call of the tokenizer; a longer text is handed over in parts that end where the pattern ends a piece.
SPAN = 100_000
_PIECE = regex.compile(PATTERN)
_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a rank file, loaded once per Python worker."""
    if path not in _encoders:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def count_tokens(text: str | None, path: str = TOKENIZER) -> int:
    """Tokens of a whole text; null and empty texts have none."""
    if not text:
        return 0
    text = text.encode("utf-8", "replace").decode("utf-8")
    if len(text) <= SPAN:
        return len(encoder(path).encode_ordinary(text))
    # A piece depends on what follows its start only, so a text may be parted at the end of any piece and counts the same.
    total, at, end = 0, 0, 0
    for piece in _PIECE.finditer(text):
        if piece.end() - at > SPAN and end > at:
            total += len(encoder(path).encode_ordinary(text[at:end]))
            at = end
        end = piece.end()
    return total + len(encoder(path).encode_ordinary(text[at:]))


class Bins:
    """A packing: item numbers by bin, and the room left in each."""

    def __init__(self, sizes: Sequence[int], capacity: int, bins: list[list[int]] | None = None):
        self.sizes, self.capacity = sizes, capacity
        self.bins = [list(b) for b in bins or []]
        self.free = [capacity - sum(sizes[i] for i in b) for b in self.bins]

    def best_fit(self, order: Iterable[int]) -> Bins:
        """Put the items, in this order, each into the fullest bin that still holds it; open a bin where none does."""
        room = sorted((f, k) for k, f in enumerate(self.free))
        for i in order:
            size = self.sizes[i]
            at = bisect.bisect_left(room, (size, -1))
            if at < len(room):
                left, k = room.pop(at)
            else:
                left, k = self.capacity, len(self.bins)
                self.bins.append([])
                self.free.append(left)
            self.bins[k].append(i)
            self.free[k] = left - size
            bisect.insort(room, (left - size, k))
        return self

    def improve(self, loose: list[int]) -> list[int]:
        """Exchange items of the bins for loose ones that fill them better: one or two for one or two; what is loose afterwards."""
        loose = sorted(loose, key=self.sizes.__getitem__)
        size = np.array([self.sizes[i] for i in loose], dtype=np.int64)
        for k, bin_ in enumerate(self.bins):
            if not self.free[k] or not loose:
                continue
            best = (0, (), ())
            for out in [(x,) for x in range(len(bin_))] + [(x, y) for x in range(len(bin_)) for y in range(x)]:
                gone = sum(self.sizes[bin_[x]] for x in out)
                most = gone + self.free[k]
                one = int(np.searchsorted(size, most, side="right")) - 1
                if one >= 0 and size[one] - gone > best[0]:
                    best = (int(size[one]) - gone, out, (one,))
                # To each loose item the largest smaller one that still fits beside it.
                other = np.minimum(np.searchsorted(size, most - size[1:], side="right") - 1, np.arange(len(size) - 1))
                sums = np.where(other >= 0, size[1:] + size[other], 0)
                if len(sums) and sums[at := int(sums.argmax())] - gone > best[0]:
                    best = (int(sums[at]) - gone, out, (at + 1, int(other[at])))
                if best[0] == self.free[k]:
                    break
            gain, out, come = best
            if gain:
                leaving, coming = [bin_[x] for x in out], [loose[j] for j in come]
                self.bins[k] = [i for x, i in enumerate(bin_) if x not in out] + coming
                self.free[k] -= gain
                loose = sorted([i for j, i in enumerate(loose) if j not in come] + leaving, key=self.sizes.__getitem__)
                size = np.array([self.sizes[i] for i in loose], dtype=np.int64)
        return loose

    def fitness(self) -> float:
        """Mean squared fill: rewards few, well-filled bins."""
        return sum((1 - f / self.capacity) ** 2 for f in self.free) / len(self.free) if self.free else 1.0


def decreasing(items: Iterable[int], sizes: Sequence[int]) -> list[int]:
    return sorted(items, key=lambda i: -sizes[i])


def crossover(mother: Bins, father: Bins, rng: np.random.Generator) -> Bins:
    """Inject whole well-filled bins of the father, drop the mother's bins that share an item, best-fit what was displaced."""
    sizes, capacity = mother.sizes, mother.capacity
    if not father.bins:
        return Bins(sizes, capacity, mother.bins)
    weight = (1 - np.array(father.free, dtype=float) / capacity) ** 8 + 1e-9
    take = max(1, int(len(father.bins) * rng.uniform(0.05, 0.25)))
    injected = [father.bins[k] for k in rng.choice(len(father.bins), size=take, replace=False, p=weight / weight.sum())]
    held = {i for b in injected for i in b}
    kept, displaced = [], []
    for b in mother.bins:
        if held.isdisjoint(b):
            kept.append(b)
        else:
            displaced += [i for i in b if i not in held]
    child = Bins(sizes, capacity, injected + kept)
    return child.best_fit(decreasing(child.improve(displaced), sizes))


def mutate(bins: Bins, rng: np.random.Generator) -> Bins:
    """Empty the worst-filled bin and a few random ones, exchange their items for better fits, best-fit the rest."""
    if len(bins.bins) < 3:
        return bins
    gone = {int(np.argmax(bins.free)), *rng.choice(len(bins.bins), size=min(len(bins.bins) - 1, 3), replace=False).tolist()}
    child = Bins(bins.sizes, bins.capacity, [b for k, b in enumerate(bins.bins) if k not in gone])
    loose = child.improve([i for k in sorted(gone) for i in bins.bins[k]])
    return child.best_fit(decreasing(loose, bins.sizes))


def least_bins(sizes: Sequence[int], capacity: int) -> int:
    """No packing has fewer: all sizes together, and the items of which no two share a bin."""
    return max(-(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes))


def evolve(sizes: Sequence[int], capacity: int, seed: int, islands: int = 2, epochs: int = 4, generations: int = 25, population: int = 6) -> tuple[Bins, int]:
    """(packing, bins of best fit decreasing): islands evolve apart, after every epoch each passes its best to the next.

    Best fit decreasing comes first; where it needs no more bins than any packing must, nothing is left to evolve. Else every
    island starts from it and from disturbed orders, and evolution ends as soon as that number is met.
    """
    rng = np.random.default_rng(seed)
    least = least_bins(sizes, capacity)
    first = Bins(sizes, capacity).best_fit(decreasing(range(len(sizes)), sizes))
    if len(first.bins) <= least:
        return first, len(first.bins)
    homes = []
    for _ in range(islands):
        people = [first]
        while len(people) < population:
            noise = rng.uniform(0.7, 1.3, len(sizes))
            people.append(Bins(sizes, capacity).best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i] * noise[i])))
        homes.append(sorted(people, key=lambda p: -p.fitness()))
    for _ in range(epochs):
        for people in homes:
            for _ in range(generations):
                a, b = sorted(rng.choice(len(people), size=2, replace=False).tolist())
                child = mutate(crossover(people[a], people[b], rng), rng)
                people.append(child)
                people.sort(key=lambda p: -p.fitness())
                people.pop()
                if len(people[0].bins) <= least:
                    return people[0], len(first.bins)
        best = [people[0] for people in homes]
        for k, people in enumerate(homes):
            people[-1] = best[k - 1]  # the neighbour's elite takes the place of the weakest
            people.sort(key=lambda p: -p.fitness())
    return min((p for people in homes for p in people), key=lambda p: (len(p.bins), -p.fitness())), len(first.bins)


def _pack_once(items: DataFrame, capacity: int, shard_items: int, evolution: dict, seed: int, tag: str) -> DataFrame:
    """Materialised items dealt into shards at random, every shard packed by one task: items with container, its fill, and the
    containers that best fit decreasing alone would need, on one row of each shard."""
    n = items.count()
    shards = max(1, -(-n // shard_items))
    # rand over a checkpointed table: the same after a lost executor, and even for equal rows.
    dealt = items.withColumn("shard", F.floor(F.rand(seed) * shards).cast("long"))
    tasks = max(1, min(shards, max(4 * items.sparkSession.sparkContext.defaultParallelism, shards // 64)))

    def packed(shard: pa.Table) -> pa.Table:
        number = shard.column("shard")[0].as_py()
        # In a fixed order, so that a task that runs again deals the same containers.
        sizes = np.array(shard.column("size").to_pylist(), dtype=np.int64)
        order = np.lexsort([np.array(shard.column("piece_no").to_pylist()), np.array(shard.column("row_key").cast("string").fill_null("").to_pylist()), sizes])
        shard, sizes = shard.take(pa.array(order)), sizes[order].tolist()
        best, plain = evolve(sizes, capacity, (seed * 1_000_003 + number) & 0x7FFFFFFF, **evolution)
        where, fill = [0] * len(sizes), [0] * len(sizes)
        for k, b in enumerate(best.bins):
            for i in b:
                where[i], fill[i] = k, capacity - best.free[k]
        columns = [pa.array([f"{tag}{number}-{k}" for k in where]), *[shard.column(c) for c in ("row_key", "piece_no", "size")], pa.array(fill, type=pa.int32()), pa.array([plain if i == 0 else 0 for i in range(len(sizes))], type=pa.int32())]
        return pa.table(columns, names=["container_id", "row_key", "piece_no", "size", "fill", "best_fit"])

    kind = items.schema["row_key"].dataType.simpleString()
    return dealt.repartition(tasks, "shard").groupBy("shard").applyInArrow(packed, f"container_id string, row_key {kind}, piece_no int, size int, fill int, best_fit int")


def token_sizes(df: DataFrame, row_key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """row_key, n_tokens: whole texts, counted in Arrow batches."""

    def count(keys: list, texts: list) -> Iterator[dict[str, list]]:
        yield {"row_key": keys, "n_tokens": [count_tokens(t, tokenizer) for t in texts]}

    return map_texts(df, row_key, text, "row_key", count, {"n_tokens": "long"})


def _packed(sizes: DataFrame, capacity: int, shard_items: int, refill_below: float, seed: int, evolution: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(full pieces, first round, second round), each with container, fill and best_fit."""
    ship_package(sizes.sparkSession)
    whole = F.ceil(F.greatest(F.col("n_tokens"), F.lit(1)) / capacity).cast("int")
    pieces = sizes.select("row_key", "n_tokens", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece_no"))
    pieces = cut(pieces.select("row_key", "piece_no", F.least(F.col("n_tokens") - F.col("piece_no") * capacity, F.lit(capacity)).cast("int").alias("size")))
    name = F.concat(F.lit("f-"), F.md5(F.concat_ws("|", F.col("row_key").cast("string"), F.monotonically_increasing_id().cast("string"))))
    full = pieces.where(F.col("size") == capacity).select(name.alias("container_id"), "row_key", "piece_no", "size", F.col("size").alias("fill"), F.lit(1).alias("best_fit"))
    first = cut(_pack_once(pieces.where(F.col("size") < capacity), capacity, shard_items, evolution, seed, "a"))
    again = first.where(F.col("fill") < refill_below * capacity).select("row_key", "piece_no", "size")
    return full, first, _pack_once(again, capacity, shard_items, evolution, seed + 1, "b")


def pack(sizes: DataFrame, capacity: int, shard_items: int = 500, refill_below: float = 0.97, seed: int = 7, **evolution: int) -> DataFrame:
    """Containers for rows (row_key, n_tokens): ``container_id``, ``row_key``, ``piece_no``, ``start_token``, ``size``.

    The rows are dealt at random into shards of about ``shard_items``, which bounds every group whatever the keys. A shard is packed
    by a grouping genetic algorithm on ``islands`` whose elites migrate between ``epochs`` (see ``evolve``): crossover injects whole
    well-filled bins, removes duplicates and best-fits the displaced rows. Containers that stay below ``refill_below`` are opened
    again and packed together across shards in a second round. Two shuffles in all.

    Defined cases: a row larger than the capacity, and no other, is cut into full containers and a rest that is packed like a row;
    rows of 0 tokens (empty or null texts) are placed like others; repeated rows are packed as often as they occur; an empty table
    gives no rows; null keys are kept.
    """
    full, first, second = _packed(sizes, capacity, shard_items, refill_below, seed, evolution)
    kept = first.where(F.col("fill") >= refill_below * capacity)
    every = full.unionByName(kept).unionByName(second)
    return every.select("container_id", "row_key", "piece_no", (F.col("piece_no").cast("long") * capacity).alias("start_token"), "size")


def fill_report(sizes: DataFrame, capacity: int, shard_items: int = 500, refill_below: float = 0.97, seed: int = 7, **evolution: int) -> DataFrame:
    """One row: rows, tokens, the least number of containers, those used and their fill, and those that best fit decreasing needs.

    ``best_fit_first`` and ``evolved_first`` compare the two over the same shards of the first round.
    """
    full, first, second = _packed(sizes, capacity, shard_items, refill_below, seed, evolution)
    second, kept = cut(second), first.where(F.col("fill") >= refill_below * capacity)
    every = full.unionByName(kept).unionByName(second)
    one = every.agg(F.countDistinct("container_id").alias("containers"), F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("placed"))
    rounds = first.agg(F.coalesce(F.sum("best_fit"), F.lit(0)).alias("best_fit_first"), F.countDistinct("container_id").alias("evolved_first"))
    fill = F.col("tokens") / (F.col("containers") * F.lit(capacity))
    return one.join(rounds).select("placed", "tokens", F.ceil(F.col("tokens") / capacity).alias("least"), "containers", F.round(fill, 4).alias("fill"), "best_fit_first", "evolved_first")
