"""Packing of texts into containers of a fixed number of tokens.

The plan is made on the histogram of sizes, which has at most ``capacity`` entries however many texts there are.
Sizes are routed to tiers (up to the capacity, a half, a quarter, ...; the shortest tier holds everything below). From
the longest tier down, what a tier still has is packed among itself by best-fit decreasing; then the gaps of its
containers are filled from the shorter tiers, each time with the longest size that fits, before the next tier is
packed. So long texts are closed off with short ones first, and no gap waits for the rest of the corpus. Containers of
equal content are one entry of the plan with a multiplicity, so the plan stays small.
Texts are then numbered within their size, in parallel and without sorting the corpus, and looked up in the plan.
Containers are numbered tier by tier and dealt to step groups in snake order, so that each group gets its share of every tier.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.llm.tokenize import token_counts
from rankloom.session import cut

CAPACITY = 2048
#: The shortest tier holds everything below; each is half the next.
TIERS = 5
#: Containers of one step group.
GROUP = 64
#: Buckets of one size, numbered independently, so that a size that many texts share isn't sorted by one task.
BUCKETS = 64


def tiers(capacity: int = CAPACITY, n: int = TIERS) -> list[int]:
    """Upper bounds of the tiers, longest first."""
    return [max(1, capacity >> i) for i in range(n) if capacity >> i or i == 0]


def _best_fit(left: dict[int, int], own: list[int], capacity: int) -> list[list]:
    """Pack all items of the sizes ``own`` (longest first) among themselves; ``[gap, sizes, containers]`` of each kind."""
    kinds: dict[int, list[list]] = {}  # gap: [[sizes, n], ...]
    gaps: list[int] = []  # sorted keys of kinds

    def put(gap: int, items: tuple, n: int) -> None:
        if gap not in kinds:
            kinds[gap] = []
            bisect.insort(gaps, gap)
        kinds[gap].append([items, n])

    for size in own:
        while left[size]:
            i = bisect.bisect_left(gaps, size)
            if i == len(gaps):  # no gap: new containers, each with as many of this size as fit
                each = min(capacity // size, left[size])
                n = left[size] // each
                put(capacity - each * size, (size,) * each, n)
            else:
                gap = gaps[i]
                kind = kinds[gap][-1]
                each = min(gap // size, max(1, left[size] // kind[1]))  # the same number in each container of the kind, as far as the items go
                n = min(kind[1], left[size] // each)
                items = kind[0]
                kind[1] -= n
                if not kind[1]:
                    kinds[gap].pop()
                    if not kinds[gap]:
                        del kinds[gap]
                        gaps.pop(i)
                put(gap - each * size, items + (size,) * each, n)
            left[size] -= n * each
    return [[gap, items, n] for gap, ks in kinds.items() for items, n in ks]


def _fill(left: dict[int, int], shorter: list[int], kinds: list[list]) -> list[list]:
    """Fill the gaps of ``kinds``, smallest first, with the longest of the sizes ``shorter`` (rising) that fit and are left."""
    done = []
    todo = sorted(kinds, key=lambda k: (-k[0], k[1]))  # the end is taken first
    while todo:
        gap, items, n = todo.pop()
        i = bisect.bisect_right(shorter, gap) - 1
        while i >= 0 and not left[shorter[i]]:
            shorter.pop(i)
            i -= 1
        if i < 0:
            done.append([gap, items, n])
            continue
        size = shorter[i]
        each = min(gap // size, max(1, left[size] // n))
        m = min(n, left[size] // each)
        left[size] -= m * each
        if m < n:
            todo.append([gap, items, n - m])
        todo.append([gap - each * size, items + (size,) * each, m])
    return done


def plan_containers(counts: dict[int, int], capacity: int = CAPACITY, n_tiers: int = TIERS) -> list[dict]:
    """Hierarchical packing of a histogram {size: number of items}.

    Returns container kinds ``{"items": [(size, tier), ...], "fill": int, "n": int, "tier": int}``, tier by tier; ``n`` containers have
    that content, ``tier`` is that of the window they were opened for. Every item of the histogram is in exactly one of
    them. With one tier this is best-fit decreasing.
    """
    bounds = tiers(capacity, n_tiers)
    left = {s: c for s, c in counts.items() if s > 0 and c > 0}
    if left and max(left) > capacity:
        raise ValueError(f"{max(left)} is above the capacity {capacity}; split such items first")
    tier_of = {s: min(b for b in bounds if b >= s) for s in left}
    out = []
    for bound in bounds:
        own = sorted((s for s in left if tier_of[s] == bound), reverse=True)
        kinds = _fill(left, sorted(s for s in left if tier_of[s] < bound and left[s]), _best_fit(left, own, capacity))
        out += [{"items": [(s, tier_of[s]) for s in items], "fill": capacity - gap, "n": n, "tier": bound} for gap, items, n in kinds]
    return sorted(out, key=lambda k: (-k["tier"], -k["fill"], -len(k["items"]), k["items"]))


def slots_of(kinds: list[dict]) -> list[tuple]:
    """Rows (size, first_rank, end_rank, first_container, offset, tier): items of ``size`` numbered from first_rank up to
    end_rank go to consecutive containers from first_container on, at ``offset``."""
    rank: dict[int, int] = {}
    rows, container = [], 0
    for k in kinds:
        offset = 0
        for size, tier in k["items"]:
            r = rank.get(size, 0)
            rows.append((size, r, r + k["n"], container, offset, tier))
            rank[size] = r + k["n"]
            offset += size
        container += k["n"]
    return rows


_SLOTS = "s_size long, slots array<struct<first: long, container: long, offset: long, tier: long>>"


def pack_sizes(spark: SparkSession, items: DataFrame, capacity: int = CAPACITY, n_tiers: int = TIERS, group: int = GROUP) -> DataFrame:
    """Pack ``items`` (``doc_id``, ``n_tokens``).

    One row per part of an item: ``doc_id, part, start_token, part_tokens, container_id, container_offset, tier,
    step_group``. An item above the capacity is split into full containers and one rest; no other is split. Items of
    null or zero size have one row with null container. Repeated rows are items of their own. Step groups of
    ``group`` containers are dealt in snake order by tier and fill, so that their token totals and shares of the tiers are balanced.
    """
    parts = cut(
        items.select("doc_id", F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long").alias("n"))
        .select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("n") / capacity) - 1).cast("long"))).alias("part"))
        .select("doc_id", "part", (F.col("part") * capacity).alias("start_token"), F.least(F.lit(capacity), F.col("n") - F.col("part") * capacity).cast("long").alias("size"))
        .withColumn("b", F.pmod(F.xxhash64("doc_id", "part"), F.lit(BUCKETS)))
    )
    per = parts.filter("size > 0").groupBy("size", "b").agg(F.count(F.lit(1)).alias("c"))
    per_rows = per.collect()  # at most capacity x BUCKETS rows, however many texts
    counts: dict[int, int] = {}
    for r in sorted(per_rows, key=lambda r: (r["size"], r["b"])):
        counts[r["size"]] = counts.get(r["size"], 0) + r["c"]
    kinds = plan_containers(counts, capacity, n_tiers)
    total = sum(k["n"] for k in kinds)
    by_size: dict[int, list] = {}
    for size, first, _, container, offset, tier in sorted(slots_of(kinds)):
        by_size.setdefault(size, []).append((first, container, offset, tier))
    slots = spark.createDataFrame(list(by_size.items()), _SLOTS)  # a row per size, at most the capacity
    starts, seen = [], {}
    for r in sorted(per_rows, key=lambda r: (r["size"], r["b"])):
        starts.append((r["size"], r["b"], seen.get(r["size"], 0)))
        seen[r["size"]] = seen.get(r["size"], 0) + r["c"]
    offsets = spark.createDataFrame(starts, "z_size long, z_b long, base long")
    w = Window.partitionBy("size", "b").orderBy("doc_id", "part")
    numbered = (
        parts.filter("size > 0")
        .withColumn("rn", F.row_number().over(w) - 1)
        .join(F.broadcast(offsets), (F.col("size") == F.col("z_size")) & (F.col("b") == F.col("z_b")))
        .withColumn("rank", F.col("base") + F.col("rn"))
    )
    n_groups = max(1, -(-total // group))
    lane = F.col("container_id") % n_groups
    slot = F.element_at(F.filter("slots", lambda x: x["first"] <= F.col("rank")), -1)  # the last run of this size that begins at or before the item
    placed = (
        numbered.join(F.broadcast(slots), F.col("size") == F.col("s_size"))
        .select("doc_id", "part", "start_token", "size", "rank", slot.alias("s"))
        .select("doc_id", "part", "start_token", "size", "s", (F.col("s.container") + F.col("rank") - F.col("s.first")).alias("container_id"))
        .select(
            "doc_id", "part", "start_token", F.col("size").alias("part_tokens"), "container_id", F.col("s.offset").alias("container_offset"), F.col("s.tier").alias("tier"),
            F.when((F.floor(F.col("container_id") / n_groups) % 2) == 0, lane).otherwise(n_groups - 1 - lane).alias("step_group"),
        )
    )
    null = F.lit(None).cast("long")
    empty = parts.filter("size <= 0").select("doc_id", "part", "start_token", F.lit(0).cast("long").alias("part_tokens"), null.alias("container_id"), null.alias("container_offset"), null.alias("tier"), null.alias("step_group"))
    return placed.unionByName(empty)


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """``pack_sizes`` of the texts, sized in tokens of the vocabulary."""
    sizes = token_counts(df, id_col, text_col, vocabulary).select(F.col(id_col).alias("doc_id"), "n_tokens")
    return pack_sizes(df.sparkSession, sizes, capacity)
