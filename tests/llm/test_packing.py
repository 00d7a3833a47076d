"""Problem 7: capacities hold, nothing is lost, little room is left."""

import math
import random
from collections import defaultdict

from strandloom.llm.packing import _Plan, fill, pack, pack_documents, packing_plan, reduce, rules

LIMITS = [("small", "t", 50), ("large", "t", 400), ("none", "t", None)]


def check(rows, packed, limits):
    for name, _, capacity in limits:
        if not capacity:
            continue
        mine = [r for r in packed if r["pack"] == name]
        room, whole = defaultdict(int), defaultdict(list)
        for r in mine:
            room[r.container] += r.tokens
            whole[r.doc_id].append((r.first_token, r.tokens))
        assert max(room.values(), default=0) <= capacity
        for doc_id, tokens in rows:
            pieces = sorted(whole.pop(doc_id))
            assert len(pieces) == max(1, math.ceil((tokens or 0) / capacity))
            assert sum(n for _, n in pieces) == (tokens or 0)
            assert [a for a, _ in pieces] == [k * capacity for k in range(len(pieces))]
        assert not whole


def test_packing_is_valid_and_full(spark):
    draw = random.Random(2)
    sizes = [(i, draw.choice([0, None, 1, 10, 25, 25, 40, 49, 50, 51, 137, 999, draw.randrange(120)])) for i in range(1500)]
    df = spark.createDataFrame([(*s, "x") for s in sizes], "doc_id long, tokens long, container string")
    limits = spark.createDataFrame(LIMITS, "pack string, tokenizer string, capacity int")
    for salts in (16, 3, 1):
        packed = pack(df, limits, salts=salts)
        check(sizes, packed.collect(), LIMITS)
        for r in fill(packed).collect():
            assert r.filled > 0.95
        placed = {(r.pack, r.rule): r["items"] for r in rules(packed).collect()}
        assert sum(n for (name, _), n in placed.items() if name == "large") == sum(max(1, math.ceil((x or 0) / 400)) for _, x in sizes)


def boxes_of(sizes, capacity):
    """The plan spelt out: the sizes in each container."""
    counts = defaultdict(int)
    for x in sizes:
        counts[x] += 1
    plan, n = packing_plan(counts, capacity)
    boxes = defaultdict(list)
    for size, lo, hi, box, each, _ in plan:
        for r in range(lo, hi):
            boxes[box + (r - lo) // each].append(size)
    ranks = defaultdict(list)
    for size, lo, hi, *_ in plan:
        ranks[size] += range(lo, hi)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in counts.items()}
    assert sorted(boxes) == list(range(n))
    return list(boxes.values())


def optimum(sizes, capacity):
    """The least number of containers, by trying."""
    best = len(sizes)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms)}.values():
            if rooms[i] >= sizes[k]:
                go(k + 1, rooms[:i] + [rooms[i] - sizes[k]] + rooms[i + 1 :])
        go(k + 1, [*rooms, capacity - sizes[k]])

    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best


def test_best_fit_reaches_the_optimum_of_exact_pairs():
    sizes = [60, 40, 70, 30, 55, 45, 100, 20, 20, 20, 20, 20]
    boxes = boxes_of(sizes, 100)
    assert len(boxes) == math.ceil(sum(sizes) / 100)
    assert sorted(x for b in boxes for x in b) == sorted(sizes)


def test_best_fit_is_valid_on_random_sizes():
    draw = random.Random(4)
    for k in range(400):
        top = 60 if k % 2 else 25
        sizes = [draw.randrange(1, top) for _ in range(draw.randrange(1, 60))]
        boxes = boxes_of(sizes, 60)
        assert sorted(x for b in boxes for x in b) == sorted(sizes)
        assert max(map(sum, boxes)) <= 60


def test_fixed_sets_never_cost_a_container():
    draw = random.Random(6)
    seen = set()
    for _ in range(1500):
        capacity = draw.choice([20, 31, 50])
        sizes = [draw.randrange(1 + capacity // draw.choice([4, 6, 12]), capacity) for _ in range(draw.randrange(1, 10))]
        counts = defaultdict(int)
        for x in sizes:
            counts[x] += 1
        plan = _Plan(counts, capacity)
        reduce(plan)
        seen |= {r[-1] for r in plan.rules}
        rest = [s for s, n in plan.left.items() for _ in range(n)]
        assert plan.boxes + optimum(rest, capacity) == optimum(sizes, capacity), (sizes, capacity, plan.rules)
    assert seen == {"alone", "pair", "triple"}


def test_equal_sizes_pair_up(spark):
    df = spark.createDataFrame([(i, 25) for i in range(1001)], "doc_id long, tokens long")
    limits = spark.createDataFrame([("p", "t", 50)], "pack string, tokenizer string, capacity int")
    assert fill(pack(df, limits)).first().containers == 501


def test_documents_and_empty_tables(spark):
    limits = spark.createDataFrame([("p", "byte_bpe_50k", 8)], "pack string, tokenizer string, capacity int")
    docs = spark.createDataFrame([(1, "one two three"), (2, None), (3, ""), (4, "word " * 40)], "doc_id long, text string")
    packed = pack_documents(docs, limits)
    assert {r.doc_id for r in packed.collect()} == {1, 2, 3, 4}
    assert pack_documents(docs.limit(0), limits).count() == 0
    assert pack_documents(docs, limits.limit(0)).count() == 0
