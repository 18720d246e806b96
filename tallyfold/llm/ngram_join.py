"""Self-join of documents on the Jaccard similarity of their word shingles, exact.

Adaptive multi-match prefixes.  Let ``b = n - ceil(t n)`` for a set of ``n`` shingles and threshold
``t``: two sets that link share at least ``l`` elements among the first ``b + l`` of both, in any
common order, for every ``l``.  A longer prefix costs more postings, and leaves fewer candidates.

1. One scan hashes the shingles and groups equal sets into classes.  Each set's first ``b + l``
   elements in hash order are looked up in all the others': a set stays only if ``l`` of them occur
   in another set (``l`` grows with the set, see ``_need``).  Elements that several sets of one task
   share are settled there, so a very common element sends one row per task and not one per document.
2. The same with whole sets over what is left, which knows each element's frequency among it.
3. Elements are ordered by falling rarity; sets with a common element in their first ``b + 1`` fall
   into one candidate component.  A component is cut into blocks of bounded size.
4. Within a pair of blocks each set chooses its own ``l`` by the estimated cost of its candidates
   and verifies those that share ``l`` elements by exact counts.

No pair is written anywhere: blocks return each set's number of links and the root of its part.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import forget
from .common import STEP_BYTES, Scratch, pieces, slices, text_or_empty
from .components import Forest, components
from .words import Words, distinct_per_text, mix, utf8

#: Elements that one task settles at a time.
WINDOW = 2_000_000
#: Elements of one row of a written window.
LIST_ITEMS = 20_000
#: Bounds of a block: sets and elements.
BLOCK_SETS, BLOCK_ELEMENTS = 2048, 2_000_000
#: Sets of which the broadcast of ids is allowed; beyond it ids are joined by shuffles.
BROADCAST_ROWS = 1_000_000

_SEED = np.uint64(0x5851F42D4C957F2D)


def _base(n, num: int, den: int):
    """``n - ceil(num / den * n)``."""
    return n - (n * num + den - 1) // den


def _need(base):
    """Matches asked for in the first round: half as many as elements may differ, four at least."""
    return np.maximum(4, base // 2)


def _shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    raw, off = utf8(column)
    values, first = Words(raw, off, lower=True).shingles(k)
    return distinct_per_text(values, first)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[first[1:]] - total[first[:-1]]


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype("i4"), pa.array(values.view("i8"), pa.int64()))


class _Window:
    """Sets of one task: which of their elements are shared within it, and which are to be asked."""

    def __init__(self):
        self.uid, self.values, self.held = [], [], 0

    def add(self, uid: np.ndarray, values: np.ndarray, counts: np.ndarray) -> None:
        self.uid.append(np.repeat(uid, counts))
        self.values.append(values)
        self.held += len(values)

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(element, set or -1) rows to send, and (set, elements shared here)."""
        uid, values = np.concatenate(self.uid), np.concatenate(self.values)
        self.__init__()
        order = np.argsort(values, kind="stable")
        uid, values = uid[order], values[order]
        head = np.ones(len(values), bool)
        head[1:] = values[1:] != values[:-1]
        run = np.diff(np.append(np.flatnonzero(head), len(values)))
        shared = np.repeat(run > 1, run)
        sets, counts = np.unique(uid[shared], return_counts=True)
        return values[head], np.where(run > 1, -1, uid[head]), sets, counts


_ASKED = "element long, uid long, shared long"


def _asked_rows(values, uid, sets, counts) -> pa.RecordBatch:
    none = np.zeros(len(values), bool)
    return pa.RecordBatch.from_pydict(
        {
            "element": pa.array(np.concatenate([values.view("i8"), np.zeros(len(sets), "i8")]), mask=np.concatenate([none, ~np.zeros(len(sets), bool)])),
            "uid": pa.array(np.concatenate([uid, sets])),
            "shared": pa.array(np.concatenate([np.zeros(len(values), "i8"), counts])),
        }
    )


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (element, set or -1) in the order of elements: for each set the number of its elements
    that have another row.  A run that a batch ends in is carried to the next one."""
    rest_e, rest_u = np.empty(0, "i8"), np.empty(0, "i8")
    for batch in batches:
        e = np.concatenate([rest_e, batch.column(0).to_numpy()])
        u = np.concatenate([rest_u, batch.column(1).to_numpy()])
        if not len(e):
            continue
        cut = int(np.searchsorted(e, e[-1], "left"))
        rest_e, rest_u = e[cut:], u[cut:]
        if len(rest_e) > 100_000:  # two rows tell as much as all of them about those to come
            yield _count(rest_e, rest_u)
            rest_e, rest_u = rest_e[:2], np.full(2, -1)
        if cut:
            yield _count(e[:cut], u[:cut])
    if len(rest_e):
        yield _count(rest_e, rest_u)


def _count(e: np.ndarray, u: np.ndarray) -> pa.RecordBatch:
    same = np.zeros(len(e), bool)
    same[1:] = e[1:] == e[:-1]
    twice = same.copy()
    twice[:-1] |= same[1:]
    sets, counts = np.unique(u[twice & (u >= 0)], return_counts=True)
    return pa.RecordBatch.from_pydict({"uid": pa.array(sets, pa.int64()), "shared": pa.array(counts, pa.int64())})


def _shared_counts(asked: DataFrame) -> DataFrame:
    """Per set the number of the asked elements that another set has too."""
    elements = asked.filter("element is not null").select("element", "uid")
    matched = elements.repartition("element").sortWithinPartitions("element").mapInArrow(_matched, "uid long, shared long")
    settled = asked.filter("element is null").select("uid", "shared")
    return settled.unionByName(matched).groupBy("uid").agg(F.sum("shared").alias("shared"))


def _free(spark) -> None:
    """Lets Spark drop the shuffle files of finished steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _only(df: DataFrame, ids: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """``df`` joined to the rows of ``ids``: by broadcast up to ``BROADCAST_ROWS`` rows of two or three longs."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, key, how)


def jaccard_join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): ``doc_id``, ``n_shingles``,
    ``component_id`` (the smallest ``doc_id`` that links lead to, its own included) and ``n_links``
    (the documents that it links with).

    A-Z are lower-cased; a document's set are its distinct shingles of ``k`` words, or, with fewer
    words, its whole sequence.  Two documents link when ``den * intersection >= num * union``.  A
    null or empty text has an empty set and links with nothing: its component is its own id.
    Repeated rows count as documents of equal sets.  A null id takes part, but gives no component
    its name; where no id is known the component is null.  A pair just at the bound links, and so do equal
    texts.  All words of a text of any length count.  Other columns are ignored, and an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text"))

    # 1. Scan: sets by size and two sums, and the elements to ask about.
    def scan(batches):
        forget()
        window = _Window()
        seen: set[tuple[int, int]] = set()

        names = ["doc_id", "row", "uid", "n", "s1", "s2", "elements", "owners", "sets", "shared"]
        long, many = pa.int64(), pa.list_(pa.int64())

        def settled():
            """A window's results in rows of their own, of a bounded number of elements each."""
            e, o, s, c = window.settle()
            e = e.view("i8")
            for a in range(0, len(e), LIST_ITEMS):
                lists = [x[a : a + LIST_ITEMS].tolist() for x in (e, o, s, c)]
                one = [pa.array([v], long) for v in (None, None, -1, 0, 0, 0)]
                yield pa.RecordBatch.from_arrays([*one, *[pa.array([x], many) for x in lists]], names=names)

        for batch in batches:
            for part in slices(batch, "text", STEP_BYTES):
                values, first = _shingle_sets(part.column("text"), k)
                n = np.diff(first)
                s1, s2 = _sums(values, first), _sums(mix(values ^ _SEED), first)
                uid = part.column("uid").to_numpy()
                if len(seen) > 1_000_000:
                    seen.clear()
                new = np.zeros(len(n), bool)
                for i, key in enumerate(zip(s1.tolist(), s2.tolist(), strict=True)):
                    if n[i] and key not in seen:
                        new[i] = True
                        seen.add(key)
                base = _base(n, num, den)
                take = np.where(new, np.minimum(n, base + _need(base)), 0)
                place = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take) + np.repeat(first[:-1], take)
                window.add(uid, values[place], take)
                own = [part.column("doc_id"), part.column("row"), part.column("uid"), pa.array(n), pa.array(s1.view("i8")), pa.array(s2.view("i8"))]
                yield pa.RecordBatch.from_arrays([*own, *[pa.nulls(len(n), many)] * 4], names=names)
                if window.held >= WINDOW:
                    yield from settled()
        if window.held:
            yield from settled()

    lists = ", ".join(f"{c} array<long>" for c in ("elements", "owners", "sets", "shared"))
    scanned = scratch.save(
        rows.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(scan, f"doc_id long, row long, uid long, n long, s1 long, s2 long, {lists}"), "scan"
    )
    sets = scanned.filter("uid >= 0").select("doc_id", "row", "uid", "n", "s1", "s2")
    asked = scanned.select(F.explode(F.arrays_zip("elements", "owners")).alias("x")).select(
        F.col("x.elements").alias("element"), F.col("x.owners").alias("uid")
    )
    settled = scanned.select(F.explode(F.arrays_zip("sets", "shared")).alias("x")).select(
        F.lit(None).cast("long").alias("element"), F.col("x.sets").alias("uid"), F.col("x.shared").alias("shared")
    )
    counts = _shared_counts(asked.withColumn("shared", F.lit(0).cast("long")).unionByName(settled))
    base = F.expr(f"n - ((n * {num} + {den - 1}) div {den})")
    classes = scratch.save(
        sets.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.count("*").alias("copies"))
        .withColumn("cid", F.monotonically_increasing_id()), "classes"
    )
    enough = counts.filter("shared > 0").join(sets, "uid").filter(F.col("shared") >= F.least(F.greatest(F.lit(4), F.floor(base / 2)), F.col("n") - base))
    first_round = scratch.save(
        enough.select("n", "s1", "s2").distinct().join(classes.select("n", "s1", "s2", "row", "cid"), ["n", "s1", "s2"]).select("row", "cid"), "left-1"
    )
    _free(spark)

    # 2. Whole sets of what is left.  A row that occurs twice is read once.
    def sets_of(batches):
        for batch in batches:
            for part in slices(batch, "text", STEP_BYTES):
                values, first = _shingle_sets(part.column("text"), k)
                yield pa.RecordBatch.from_pydict({"cid": part.column("cid"), "elements": _lists(values, np.diff(first))})

    whole = _only(rows, first_round, "row").select("cid", "text").mapInArrow(sets_of, "cid long, elements array<long>")

    def ask(batches):
        window = _Window()
        seen: set[int] = set()
        for batch in batches:
            uid, lists = batch.column(0).to_numpy(), batch.column(1)
            first = lists.offsets.to_numpy()
            values = lists.values.to_numpy().view("u8")
            new = np.array([u not in seen and not seen.add(u) for u in uid.tolist()], bool)
            n = np.diff(first)
            window.add(uid[new], values[np.repeat(new, n)] if not new.all() else values[first[0] : first[-1]], n[new])
            if window.held >= WINDOW:
                yield from pieces(_asked_rows(*window.settle()))
        if window.held:
            yield from pieces(_asked_rows(*window.settle()))

    whole_saved = scratch.save(whole, "sets-1")
    counts2 = _shared_counts(whole_saved.mapInArrow(ask, _ASKED))
    second_round = scratch.save(
        counts2.join(classes.select(F.col("cid").alias("uid"), "n", "copies"), "uid").filter(F.col("shared") >= F.col("n") - base)
        .select(F.col("uid").alias("cid"), "n", "copies"), "left-2"
    )
    _free(spark)
    kept = scratch.save(_only(whole_saved, second_round, "cid").dropDuplicates(["cid"]), "sets-2")
    scratch.drop(whole_saved)

    # 3. Elements by rarity, and candidate components.
    flat = kept.select("cid", "n", F.explode("elements").alias("element"))
    often = flat.groupBy("element").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = flat.join(often, "element").groupBy("cid", "n").agg(F.array_sort(F.collect_list(F.struct("df", "element"))).alias("common"))
    # a set's elements that nobody else has come first, and match nothing
    front = ranked.select(
        "cid", F.explode(F.slice("common", 1, F.greatest(F.lit(0), base + 1 - (F.col("n") - F.size("common"))).cast("int"))).alias("x")
    ).select("cid", F.col("x.element").alias("element"))
    front = scratch.save(front, "front")
    lead = front.groupBy("element").agg(F.min("cid").alias("lead")).join(front, "element").filter("lead <> cid").select("cid", "lead").distinct()
    candidates = components(lead, scratch)
    _free(spark)

    # 4. Blocks.
    member = kept.select("cid", "n").join(candidates.withColumnRenamed("node", "cid").withColumnRenamed("label", "comp"), "cid")
    # slightly wider than the ratio of sizes that can link, so that these are in the same or the next step
    step = F.floor(F.log(F.col("n").cast("double")) / F.lit(1.0001 * math.log(den / num))).cast("int")
    size = member.groupBy("comp").agg(F.count("*").alias("m"), F.sum("n").alias("elements"))
    # Only large components, one for each BLOCK_SETS sets or BLOCK_ELEMENTS elements at most, are looked up.
    large = scratch.save(size.filter((F.col("m") > BLOCK_SETS) | (F.col("elements") > BLOCK_ELEMENTS)).select("comp", F.lit(True).alias("large")), "large")
    member = _only(member, large, "comp", "left").withColumn("step", F.when(F.col("large"), step).otherwise(0))
    cuts = scratch.save(
        member.filter("large").groupBy("comp", "step").agg(F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_ELEMENTS)).cast("int").alias("parts")), "cuts"
    )
    member = _only(member, cuts, ["comp", "step"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    member = scratch.save(member.select("cid", "comp", "step", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int").alias("part")), "members")
    whole_ones = size.join(large, "comp", "left_anti").select("comp", F.lit(0).alias("step"), F.lit(1).alias("parts"))
    parts = cuts.unionByName(whole_ones)
    one = parts.select("comp", "step", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    other = one.select("comp", F.col("step").alias("step2"), F.col("part").alias("part2"))
    near_size = (F.col("step2") == F.col("step")) & (F.col("part2") >= F.col("part")) | (F.col("step2") == F.col("step") + 1)
    pairs = scratch.save(one.join(other, "comp").filter(near_size).withColumn("pair", F.monotonically_increasing_id()), "block-pairs")
    left = pairs.select("comp", "step", "part", "pair", F.lit(0).alias("side"))
    right = pairs.filter("step <> step2 or part <> part2").select("comp", F.col("step2").alias("step"), F.col("part2").alias("part"), "pair", F.lit(1).alias("side"))
    dealt = member.join(left.unionByName(right), ["comp", "step", "part"]).select("cid", "pair", "side")
    dealt = dealt.join(second_round.select("cid", "copies"), "cid").join(kept.select("cid", "elements"), "cid")
    linked = scratch.save(
        dealt.groupBy("pair").applyInArrow(lambda t: _links(t, num, den), "cid long, root long, links long"), "links"
    )
    parts_of = components(linked.filter("cid <> root").select("cid", "root"), scratch)
    links = linked.groupBy("cid").agg(F.sum("links").alias("links"))
    named = classes.join(links, "cid", "left").join(parts_of.withColumnRenamed("node", "cid"), "cid", "left")
    named = named.withColumn("comp", F.coalesce("label", "cid"))
    smallest = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    of_class = scratch.save(
        named.join(smallest, "comp").select("n", "s1", "s2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes-named"
    )
    _free(spark)
    return sets.join(of_class, ["n", "s1", "s2"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def _links(table: pa.Table, num: int, den: int) -> pa.Table:
    """Exact links within one block, or between two: per set its links and its part's root."""
    table = table.combine_chunks().sort_by("cid")
    side = table.column("side").to_numpy()
    cid = table.column("cid").to_numpy()
    copies = table.column("copies").to_numpy()
    lists = table.column("elements").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    first = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    n = np.diff(first)
    _, ids, df = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    m = len(n)
    own = np.repeat(np.arange(m), n)
    order = np.lexsort((ids, df[ids], own))  # rarest first within each set
    ids = ids[order]
    place = np.arange(len(ids)) - first[own]
    base = _base(n, num, den)
    level = np.maximum(0, place - base[own])  # a posting counts for every l above its level
    two = bool(side.any())
    index = side[own] == 1 if two else np.ones(len(ids), bool)
    po = np.lexsort((level[index], ids[index]))
    p_set, p_level, p_id = own[index][po], level[index][po], ids[index][po]
    p_first = np.searchsorted(p_id, np.arange(len(df) + 1))
    sorted_ids = [np.sort(ids[first[i] : first[i + 1]]) for i in range(m)]
    forest = Forest(m)
    links = np.zeros(m, "i8")
    for x in np.flatnonzero(side == 0) if two else range(m):
        nx, bx = int(n[x]), int(base[x])
        mine = ids[first[x] : first[x + 1]]
        lengths = p_first[mine + 1] - p_first[mine]
        cum = np.concatenate([[0], np.cumsum(lengths)])
        most = nx - bx
        best = None
        for want in sorted({1, 2, 4, 8, 16, 32, most}):
            if want > most:
                break
            scan = int(cum[min(nx, bx + want)])
            if best is not None and scan >= best[0]:
                break
            hit = _hits(p_set, p_level, p_first, mine[: bx + want], want, m)
            ys = np.flatnonzero(hit >= want)
            ys = ys[(ys != x) if two else (ys > x)]
            ys = ys[(den * np.minimum(n[ys], nx) >= num * np.maximum(n[ys], nx))]
            cost = scan + 4 * int(n[ys].sum() + nx * len(ys))
            if best is None or cost < best[0]:
                best = (cost, ys)
            if not len(ys):
                break
        ys = best[1]
        if not len(ys):
            continue
        if 4 * int(n[ys].sum() + nx * len(ys)) > int(cum[-1]):  # counting everything is the cheapest check
            same = _hits(p_set, None, p_first, mine, 0, m)[ys]
        else:
            same = np.array([len(np.intersect1d(sorted_ids[x], sorted_ids[y], assume_unique=True)) for y in ys])
        ys = ys[den * same >= num * (nx + n[ys] - same)]
        for y in ys.tolist():
            forest.join(int(x), y)
        links[x] += copies[ys].sum()
        links[ys] += copies[x]
    root = cid[[forest.find(i) for i in range(m)]]
    return pa.table({"cid": cid, "root": root, "links": links})


def _hits(p_set, p_level, p_first, elements, want, m) -> np.ndarray:
    """How many of the elements each indexed set has (those below level ``want``, if levels are given)."""
    a, b = p_first[elements], p_first[elements + 1]
    size = b - a
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)
    sets = p_set[at] if p_level is None else p_set[at][p_level[at] < want]
    return np.bincount(sets, minlength=m)
