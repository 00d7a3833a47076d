"""Problem 7: documents packed into containers of fixed capacity.

Items of one size fare alike, so the whole packing is settled on the counts of sizes, of which there are at most as
many as the capacity, however large the corpus.  Martello and Toth's reduction comes first and is repeated until it fixes
nothing more: an item that nothing fits beside is alone; a pair or triple that dominates all other sets with its largest
item stays together.  What remains is packed best-fit decreasing.  The plan says which ranks of a size go to which
containers; items are ranked within their size, salted, and look their container up.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..session import written
from .tokens import FOLDER, token_counts

#: Salts of the ranking of equal sizes.
SALTS = 64


class _Plan:
    """Counts by size that are used up, and the rules written down: (size, first rank, behind the last, first container, ranks a container, rule)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = {s: n for s, n in counts.items() if s > 0 and n > 0}
        self.order = sorted(self.left)
        self.capacity, self.boxes = capacity, 0
        self.rank: dict[int, int] = defaultdict(int)
        self.rules: list[tuple[int, int, int, int, int, str]] = []

    def put(self, size: int, n: int, box: int, each: int, rule: str) -> None:
        lo = self.rank[size]
        self.rules.append((size, lo, lo + n, box, each, rule))
        self.rank[size] += n
        self.take(size, n)

    def take(self, size: int, n: int) -> None:
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size], self.order[bisect.bisect_left(self.order, size)]

    def give(self, size: int, n: int) -> None:
        if size not in self.left:
            bisect.insort(self.order, size)
            self.left[size] = 0
        self.left[size] += n

    def least(self, n: int) -> int | None:
        """The sum of the n smallest items, None if there are fewer."""
        total = 0
        for s in self.order:
            k = min(n, self.left[s])
            total, n = total + k * s, n - k
            if not n:
                return total
        return None

    def fix(self, sizes: tuple[int, ...], rule: str) -> None:
        """Containers with one set each, as many as there are items for."""
        need = {s: sizes.count(s) for s in sizes}
        n = min(self.left[s] // k for s, k in need.items())
        for s, k in need.items():
            self.put(s, n * k, self.boxes, k, rule)
        self.boxes += n


def _dominating(plan: _Plan, big: int) -> tuple[tuple[int, ...], str] | None:
    """The set with an item of size ``big`` that dominates all others, if one is known to; ``big`` itself is already taken out."""
    room = plan.capacity - big
    at = bisect.bisect_right(plan.order, room) - 1
    if at < 0:
        return (big,), "alone"
    k, two, three = plan.order[at], plan.least(2), plan.least(3)
    if k == room or two is None or two > room:
        return (big, k), "pair"
    if three is not None and three <= room:
        return None
    # At most two others fit: the heaviest pair, and the largest second item of any pair.
    lo, hi, best, second = 0, at, 0, 0
    while lo <= hi:
        a, b = plan.order[lo], plan.order[hi]
        if a + b > room or (lo == hi and plan.left[a] < 2):
            hi -= 1
            continue
        best, second = max(best, a + b), max(second, a)
        lo += 1
    if k >= best:
        return (big, k), "pair"
    # With the largest first item and the largest second one beside it, every other set is smaller item by item.
    beside = bisect.bisect_right(plan.order, room - k) - 1
    b = plan.order[beside] if beside >= 0 else 0
    if b == k and plan.left[k] < 2:
        b = plan.order[beside - 1] if beside else 0
    return ((big, k, b), "triple") if b and second <= b else None


def reduce(plan: _Plan) -> None:
    """Fix dominating sets until none is left."""
    fixed = True
    while fixed:
        fixed = False
        for big in reversed(list(plan.order)):
            while plan.left.get(big):
                plan.take(big, 1)
                found = _dominating(plan, big)
                plan.give(big, 1)
                if not found:
                    break
                plan.fix(*found)
                fixed = True


def best_fit(plan: _Plan) -> None:
    """Each size from the largest on goes to the containers with the least room that it fits into."""
    rooms: list[int] = []  # ascending, those that some container has
    opened: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: runs of containers (first, number)

    def open_(room: int, box: int, n: int) -> None:
        if not opened[room]:
            bisect.insort(rooms, room)
        opened[room].append((box, n))

    for size in reversed(list(plan.order)):
        while left := plan.left.get(size, 0):
            at = bisect.bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                box, n = opened[room].pop()
                if not opened[room]:
                    del rooms[at]
            else:
                room, box, n = plan.capacity, plan.boxes, -(-left // (plan.capacity // size))
                plan.boxes += n
            each = room // size
            full = min(n, left // each)
            if full:
                plan.put(size, full * each, box, each, "fit")
                open_(room - each * size, box, full)
                left -= full * each
            if left and full < n:
                plan.put(size, min(left, each), box + full, each, "fit")
                open_(room - min(left, each) * size, box + full, 1)
                full += 1
            if full < n:
                open_(room, box + full, n - full)


def packing_plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, str]], int]:
    """Rules for the items of each size, and the number of containers."""
    plan = _Plan(counts, capacity)
    reduce(plan)
    best_fit(plan)
    return plan.rules, plan.boxes


def _planned(pdf: pd.DataFrame) -> pd.DataFrame:
    """The plan of one pack from its counts by size."""
    rules, boxes = packing_plan(dict(zip(pdf["_size"].tolist(), pdf["_n"].tolist())), int(pdf["capacity"].iloc[0]))
    out = pd.DataFrame(rules, columns=["_size", "_lo", "_hi", "_box", "_each", "rule"])
    return out.assign(pack=pdf["pack"].iloc[0], _boxes=boxes)[["pack", "_size", "_lo", "_hi", "_box", "_each", "rule", "_boxes"]]


def pack(sizes: DataFrame, limits: DataFrame, key: str = "doc_id", salts: int = SALTS) -> DataFrame:
    """Assign sized items to containers: (pack, container, key, piece, first_token, tokens, capacity, rule).

    ``sizes`` has (key, tokens) or (key, tokenizer, tokens), the latter matched with the pack's
    tokenizer; ``limits`` is the small table (pack, tokenizer, capacity), whose rows with a null or
    non-positive capacity are ignored.  Only an item larger than the capacity is split, into full containers and a rest.
    Items of no tokens (null counts as 0) take no room and are spread over the pack's containers.  An empty table gives no rows.
    ``rule`` says how the item got its place: alone, pair, triple (dominance), fit, or none for an item of no tokens.
    """
    packs = limits.where(F.col("capacity") > 0).select("pack", "tokenizer", F.col("capacity").cast("long").alias("capacity"))
    named = "tokenizer" in sizes.columns
    by = (F.col("tokenizer") if named else F.lit("")).alias("_by")
    items = sizes.select(F.col(key).alias("_id"), by, F.coalesce(F.col("tokens"), F.lit(0)).cast("long").alias("_size"))
    items = items.join(packs.select("pack", "capacity", by), "_by")
    items = items.select("pack", "_id", "_size", "capacity", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("_size") / F.col("capacity")) - 1, F.lit(0)))).alias("piece"))
    items = items.withColumn("_first", F.col("piece") * F.col("capacity")).withColumn("_size", F.least(F.col("_size") - F.col("_first"), F.col("capacity")))
    items = items.withColumn("_salt", F.pmod(F.xxhash64("_id", "piece"), F.lit(salts)))
    # Counts by size: at most ``capacity`` rows a pack, whatever the corpus; the plan is made of nothing else.
    salted = items.where(F.col("_size") > 0).groupBy("pack", "capacity", "_size", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    salted = written(salted, "sizes")
    by_size = salted.groupBy("pack", "capacity", "_size").agg(F.sum("_n").alias("_n"))
    plan = written(by_size.groupBy("pack").applyInPandas(_planned, "pack string, _size long, _lo long, _hi long, _box long, _each long, rule string, _boxes long"), "plan")
    # The rules that hold for the ranks of each salt, counted from the salt's first.
    earlier = W.partitionBy("pack", "_size").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    base = salted.select("pack", "_size", "_salt", "_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    mine = plan.join(base, ["pack", "_size"]).where((F.col("_lo") < F.col("_base") + F.col("_n")) & (F.col("_hi") > F.col("_base")))
    rule = F.struct((F.col("_lo") - F.col("_base")).alias("lo"), (F.col("_hi") - F.col("_base")).alias("hi"), F.col("_box").alias("box"), F.col("_each").alias("each"), "rule")
    mine = mine.groupBy("pack", "_size", "_salt").agg(F.collect_list(rule).alias("_rules"))
    # Ranked rows are already partitioned by what they are joined on.
    rank = F.row_number().over(W.partitionBy("pack", "_size", "_salt").orderBy("_id", "piece")).cast("long") - 1
    ranked = items.where(F.col("_size") > 0).withColumn("_rank", rank).join(mine, ["pack", "_size", "_salt"])
    ranked = ranked.withColumn("_rule", F.element_at(F.filter("_rules", lambda r: (r["lo"] <= F.col("_rank")) & (F.col("_rank") < r["hi"])), 1))
    box = F.col("_rule.box") + F.expr("(_rank - _rule.lo) div _rule.each")
    boxes = plan.groupBy("pack").agg(F.max("_boxes").alias("_boxes"))
    none = items.where(F.col("_size") == 0).join(boxes, "pack", "left")
    out = lambda d, at, rule: d.select("pack", at.cast("string").alias("container"), F.col("_id").alias(key), "piece", F.col("_first").alias("first_token"), F.col("_size").alias("tokens"), "capacity", rule.alias("rule"))
    return out(ranked, box, F.col("_rule.rule")).unionByName(out(none, F.pmod(F.xxhash64("_id"), F.coalesce("_boxes", F.lit(1))), F.lit("none")))


def pack_documents(documents: DataFrame, limits: DataFrame, folder: str = FOLDER, **options: int) -> DataFrame:
    """Containers of documents, sized by the tokens of their text in each pack's tokenizer; see :func:`pack`.

    Each tokenizer named in ``limits`` is run once and its counts are written down, since packing reads them several times.
    """
    parts = None
    for (name,) in limits.select("tokenizer").distinct().dropna().collect():  # a few names of a fixed table
        one = token_counts(documents, vocabulary=name, folder=folder).withColumn("tokenizer", F.lit(name))
        parts = one if parts is None else parts.unionByName(one)
    if parts is None:
        parts = documents.select("doc_id", F.lit(0).cast("long").alias("tokens"), F.lit(None).cast("string").alias("tokenizer"))
    return pack(written(parts, "token-counts"), limits, **options)


def rules(packed: DataFrame) -> DataFrame:
    """(pack, rule, items, tokens): how many items each rule of the packing has placed."""
    return packed.groupBy("pack", "rule").agg(F.count(F.lit(1)).alias("items"), F.sum("tokens").alias("tokens"))


def fill(packed: DataFrame) -> DataFrame:
    """For each pack (pack, containers, tokens, capacity, filled): how full its containers are."""
    one = packed.groupBy("pack", "container", "capacity").agg(F.sum("tokens").alias("_t"))
    return one.groupBy("pack", "capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("_t").alias("tokens"), (F.sum("_t") / (F.count(F.lit(1)) * F.first("capacity"))).alias("filled"))
