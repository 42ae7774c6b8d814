"""N-gram Jaccard join: the sparse product of the document by n-gram matrix with itself, in blocks.

A document is the row of its distinct word n-grams. The product is never formed
whole: its blocks are the columns of n-grams and, later, the rows of a component,
and size-derived bounds discard pairs before and while their overlaps accumulate.

1. Equal rows are one class, found by a 128-bit signature.
2. A count-min sketch gives all n-grams one order, rare ones first. Two rows
   that link share an n-gram among the first few of each (the prefix whose
   length follows from the size), so only those columns enter the product. An
   n-gram that the sketch shows in one row only has no partner and is left out;
   a row whose prefix has only such n-grams takes no further part. Columns are
   dealt once, and those that have one row after all end there; columns that the
   sketch shows far above its mean load are dealt in parts.
3. Each column links its rows to one pivot, the row whose
   n-grams are the most common - a column in parts to one of their pivots; each row multiplies only with the pivot it shares
   most columns with. This settles groups of near copies in time linear in their size.
4. Columns that still hold several components multiply across components: pairs
   that the bounds allow accumulate their overlap in full. No link between
   components is lost.
5. Links are counted where they can be, inside components: the classes of a
   component are dealt to blocks of bounded size, and each two blocks are
   multiplied, their overlaps accumulating in one matrix of counts. Only sums by
   row leave a task, so pairs are never written, however many a group has.

Four bounds are used for rows of sizes a and b and the least overlap that
reaches the threshold: the smaller size must allow it; so must the n-grams not
known to be a row's own; so must, in the first column that a pair shares, what
is left of each row from that column on, the order being the same for both; and,
before the rows of a pair are fetched, so must the sum of what each block of
columns may hold, the smaller of two counts, from counts of about three n-grams a block. A sketch past its capacity weakens bounds, never results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch as cm
from .components import connected_components
from .overlaps import overlaps
from .textgrid import WHITESPACE_FOLDED, buffers, mix, shingle_sets, slices, words
from .workspace import WAYS, durable, spread_join

HOT = 1000  # rows beyond the mean load of a sketch cell from which a column is dealt in parts
BLOCK_ROWS, BLOCK_ENTRIES = 2048, 1 << 20  # of classes of a component in a block, and of their n-grams
TILE_ROWS = 144  # of blocks that are multiplied at once

_CLASS = ["n_shingles", "a", "b"]
_ROWS = "doc_id long, n long, a long, b long, own long, common long, plain int, prefix array<long>, shared array<long>, counts array<tinyint>"
_COLUMN = "gram long, part int, rank long, doc_id long, n long, own long, at long, p_doc long, p_n long, p_own long"


def _signatures(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros((2, len(values) + 1), np.uint64)
    np.cumsum(mix(values), out=total[0, 1:])
    np.cumsum(mix(values ^ np.uint64(0xC2B2AE3D27D4EB4F)), out=total[1, 1:])
    return tuple((t[at[1:]] - t[at[:-1]]) for t in total)


def _distinct_rows(batch: pa.RecordBatch, k: int):
    """Sorted n-grams and offsets of a batch, and the texts that stand for a set: for equal sets, the one with the smallest id."""
    values, at = shingle_sets(words(*buffers(batch.column("text")), WHITESPACE_FOLDED), k)
    a, b = _signatures(values, at)
    ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
    n = np.diff(at)
    live = np.flatnonzero((n > 0) & batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False))
    order = live[np.lexsort((ids[live], b[live], a[live], n[live]))]
    keep = np.ones(len(order), bool)
    keep[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]) | (n[order][1:] != n[order][:-1])
    return values, at, ids, np.sort(order[keep])


def _entries(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the values of the rows, and for each the row's place among rows."""
    n = at[rows + 1] - at[rows]
    owner = np.repeat(np.arange(len(rows)), n)
    return np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[rows], n), owner


def _lists(values: np.ndarray, owner: np.ndarray, rows: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)), pa.array(values.view(np.int64)))


def _matrix(docs: DataFrame, k: int, num: int, den: int, entries: int) -> DataFrame:
    """Rows that may have a partner: size, signature, n-grams known to be its own, how common its n-grams are, shared n-grams of the prefix in order, how many of them are not hot, and all shared."""

    def counted(batch):
        values, at, _, rows = _distinct_rows(batch, k)
        return values[_entries(at, rows)[0]]

    sketch = cm.build(docs, counted, entries, depth=1)
    hot = cm.level(HOT + int(8 * sketch.load))
    sent = docs.sparkSession.sparkContext.broadcast(sketch)

    def index(batches):
        for batch in slices(batches):
            values, at, ids, rows = _distinct_rows(batch, k)
            sign = [x[rows].view(np.int64) for x in _signatures(values, at)]
            entry, owner = _entries(at, rows)
            value = values[entry]
            level = sent.value.levels(value)
            n = at[rows + 1] - at[rows]
            rest = -(-num * n // den) - 1
            own = np.bincount(owner[level < 2], minlength=len(rows))
            keep = own < n - rest  # else the whole prefix is its own
            live = keep[owner]
            value, level, owner = value[live], level[live], np.cumsum(keep)[owner[live]] - 1
            rows, n, rest, own, sign = rows[keep], n[keep], rest[keep], own[keep], [x[keep] for x in sign]
            common = np.bincount(owner, weights=level, minlength=len(rows)) * 1000 // n
            order = np.lexsort((value, level, owner))
            value, level, owner = value[order], level[order], owner[order]
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            shared = level >= 2
            first = shared & (nth < (n - rest)[owner])
            plain = np.bincount(owner[first & (level < hot)], minlength=len(rows)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[rows]), pa.array(n), *map(pa.array, sign), pa.array(own.astype(np.int64)), pa.array(common.astype(np.int64)), pa.array(plain), _lists(value[first], owner[first], len(rows)), _lists(value[shared], owner[shared], len(rows)), _counted(value[shared], owner[shared], n)],
                names=[x.split()[0] for x in _ROWS.split(", ")],
            )

    return docs.mapInArrow(index, _ROWS)


def _counted(value: np.ndarray, owner: np.ndarray, n: np.ndarray) -> pa.Array:
    """For each row, how many of its values each block of columns has: of a power of two of blocks, about a third of n."""
    blocks = np.int64(1) << np.maximum(np.log2(np.maximum(n, 2)).astype(np.int64) - 1, 2)
    first = np.append(0, np.cumsum(blocks))
    at = (mix(value ^ np.uint64(0x94D049BB133111EB)) & (blocks[owner] - 1).astype(np.uint64)).astype(np.int64)
    counts = np.bincount(first[owner] + at, minlength=int(first[-1]))
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(np.minimum(counts, 127).astype(np.int8)))


def _fit(pairs: DataFrame, matrix: DataFrame, num: int, den: int) -> DataFrame:
    """Of different pairs (u, v), those whose blocks of columns have enough in common. A count of 127 may stand for more, and is no bound."""
    pairs = durable(pairs)
    of = lambda c: pairs.groupBy(c).agg(F.count("*").alias("n"))
    side = lambda c: matrix.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("counts").alias(f"c_{c}"))
    met = spread_join(spread_join(pairs, side("u"), ["u"], of("u"), part=["v"]), side("v"), ["v"], of("v"), part=["u"])
    half = lambda c: (F.size(c) / 2).cast("int")
    folded = lambda c, d: F.when(F.size(c) > F.size(d), F.zip_with(F.slice(c, F.lit(1), half(c)), F.slice(c, half(c) + 1, half(c)), lambda x, y: (x.cast("int") + y).cast("int"))).otherwise(F.transform(c, lambda x: x.cast("int")))
    # sizes of a pair are alike, so one side has at most twice the blocks of the other
    most = F.aggregate(F.zip_with(folded("c_u", "c_v"), folded("c_v", "c_u"), lambda x, y: F.least(x, y)), F.lit(0), lambda t, x: t + x)
    full = F.array_contains("c_u", F.lit(127).cast("byte")) | F.array_contains("c_v", F.lit(127).cast("byte"))
    return met.where(full | (F.abs(F.log2(F.size("c_u") / F.size("c_v"))) > 1.5) | (most * (num + den) >= (F.col("n_u") + F.col("n_v")) * num)).select("u", "v")


def _columns(matrix: DataFrame) -> DataFrame:
    """Entries of prefix columns with two rows or more, each with the pivot of its column or part; one shuffle."""
    # a row's own n-grams come first in the order, so the place of a shared one is its place in the prefix after them
    flat = matrix.select("doc_id", "n", "own", "common", "plain", F.posexplode("prefix").alias("at", "gram"))
    part = F.when(F.col("at") >= F.col("plain"), F.pmod(F.xxhash64(F.lit(7), F.col("doc_id")), F.lit(WAYS)).cast("int")).otherwise(F.lit(-1))
    dealt = flat.select("gram", part.alias("part"), (-F.col("common")).alias("rank"), "doc_id", "n", "own", (F.col("own") + F.col("at")).alias("at"))

    def hang(batches):
        head, open_ = None, False  # the first row of the last group, and whether it was not given out yet
        for batch in batches:
            if not len(batch):
                continue
            rows = pa.Table.from_batches([head, batch] if head is not None else [batch])
            gram, part, rank, doc, n, own, at = (rows.column(c).to_numpy() for c in ("gram", "part", "rank", "doc_id", "n", "own", "at"))
            new = np.append(True, (gram[1:] != gram[:-1]) | (part[1:] != part[:-1]))
            pivot = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            starts = np.flatnonzero(new)
            single = np.repeat(np.diff(np.append(starts, len(new))) == 1, np.diff(np.append(starts, len(new))))
            out = ~single | (part >= 0)
            last = int(starts[-1])
            if last == len(new) - 1:
                out[last] = False  # more of its group may come
            if head is not None and not open_:
                out[0] = False
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (gram, part, rank, doc, n, own, at, doc[pivot], n[pivot], own[pivot])], names=[x.split()[0] for x in _COLUMN.split(", ")])
            open_ = last == len(new) - 1 and (last > 0 or head is None or open_)
            head = rows.slice(last, 1).combine_chunks().to_batches()[0]
        if head is not None and open_ and head.column("part")[0].as_py() >= 0:
            gram, part, rank, doc, n, own, at = (head.column(c) for c in ("gram", "part", "rank", "doc_id", "n", "own", "at"))
            yield pa.RecordBatch.from_arrays([gram, part, rank, doc, n, own, at, doc, n, own], names=[x.split()[0] for x in _COLUMN.split(", ")])

    return dealt.repartition("gram", "part").sortWithinPartitions("gram", "part", "rank", "doc_id").mapInArrow(hang, _COLUMN)


def _possible(a: str, b: str, num: int, den: int):
    """The bounds by size and by n-grams that are a row's own, for columns that begin with a and b."""
    x, y = (lambda c: F.col(f"{a}{c}")), (lambda c: F.col(f"{b}{c}"))
    return (F.least(x("n"), y("n")) * den >= F.greatest(x("n"), y("n")) * num) & (F.least(x("n") - x("own"), y("n") - y("own")) * (num + den) >= (x("n") + y("n")) * num)


def _left(a: str, b: str, num: int, den: int):
    """The bound by what is left from the first shared column on; a pair that shares an earlier one is met there."""
    x, y = (lambda c: F.col(f"{a}{c}")), (lambda c: F.col(f"{b}{c}"))
    return F.least(x("n") - x("at"), y("n") - y("at")) * (num + den) >= (x("n") + y("n")) * num


def _linked(pairs: DataFrame, matrix: DataFrame, num: int, den: int) -> DataFrame:
    """Of different pairs (u, v), those whose rows' product reaches the threshold."""
    pairs = durable(pairs)
    # v may be few rows, as pivots are
    rows = lambda c: cm.only_some(matrix.select("doc_id", "n", "shared"), "doc_id", pairs.select(c).distinct())
    x = rows("u").select(F.col("doc_id").alias("u"), F.col("n").alias("n_u"), F.col("shared").alias("s_u"))
    y = rows("v").select(F.col("doc_id").alias("v"), F.col("n").alias("n_v"), F.col("shared").alias("s_v"))
    of = lambda c: pairs.groupBy(c).agg(F.count("*").alias("n"))
    both = F.size(F.array_intersect("s_u", "s_v"))
    met = spread_join(spread_join(pairs, x, ["u"], of("u"), part=["v"]), y, ["v"], of("v"), part=["u"])
    return met.where(both * (num + den) >= (F.col("n_u") + F.col("n_v")) * num).select("u", "v")


def _signed(narrow: DataFrame, k: int) -> DataFrame:
    def sign(batches):
        for batch in slices(batches):
            values, at = shingle_sets(words(*buffers(batch.column("text")), WHITESPACE_FOLDED), k)
            a, b = _signatures(values, at)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["doc_id", *_CLASS])

    return durable(narrow.mapInArrow(sign, "doc_id long, n_shingles long, a long, b long"))


def _solved(narrow: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows with size and signature; classes with their smallest id and number of ids; the matrix; and doc_id, component_id of all ids with a set."""
    signed = _signed(narrow, k)
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").distinct()
    classes = durable(full.groupBy(*_CLASS).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    several = classes.where("copies > 1")
    copies = spread_join(full, several.select(*_CLASS, "rep"), _CLASS, several.select(*_CLASS, F.col("copies").alias("n"))).where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))

    entries = signed.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    matrix = durable(_matrix(narrow, k, num, den, entries))
    columns = durable(_columns(matrix))
    # rows of a column in parts hang on the first of the parts' pivots, which goes to each part
    dealt = columns.where("part >= 0").drop("p_doc", "p_n", "p_own")
    tops = columns.where("part >= 0 AND doc_id = p_doc").groupBy("gram").agg(F.min(F.struct("rank", "doc_id", "n", "own")).alias("p"))
    lead = tops.select("gram", F.explode(F.sequence(F.lit(0), F.lit(WAYS - 1))).alias("part"), F.col("p.doc_id").alias("p_doc"), F.col("p.n").alias("p_n"), F.col("p.own").alias("p_own"))
    hung = columns.where("part < 0").unionByName(dealt.join(lead, ["gram", "part"])).where("doc_id <> p_doc").where(_possible("", "p_", num, den))
    shares = hung.groupBy(F.col("doc_id").alias("u"), F.col("p_doc").alias("v")).agg(F.count("*").alias("c"))
    best = shares.groupBy("u").agg(F.max_by("v", F.struct("c", -F.col("v"))).alias("v"))
    first = durable(connected_components(_linked(best, matrix, num, den).unionByName(copies)))

    where = first.select("node", "component")
    entry = columns.select("gram", "doc_id", "n", "own", "at")
    placed = durable(entry.join(where.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")))
    mixed = durable(placed.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo < hi"))
    blocks = durable(spread_join(placed, mixed.select("gram"), ["gram"], mixed.select("gram", "n"), "left_semi"))
    x, y = (blocks.select("gram", *(F.col(c).alias(f"{p}{c}") for c in ("doc_id", "n", "own", "at", "component"))) for p in "xy")
    across = x.join(y, "gram").where((F.col("xcomponent") < F.col("ycomponent")) & _possible("x", "y", num, den) & _left("x", "y", num, den))
    links = _linked(_fit(across.select(F.col("xdoc_id").alias("u"), F.col("ydoc_id").alias("v")).distinct(), matrix, num, den), matrix, num, den)
    bridges = (
        links.join(where.select(F.col("node").alias("u"), F.col("component").alias("cu")), "u", "left")
        .join(where.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v", "left")
        .select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    )
    second = connected_components(bridges).select(F.col("node").alias("c1"), F.col("component").alias("c2"))
    # a document outside all first components may still be in a bridge, under its own id
    nodes = full.select("doc_id").distinct().join(where.select(F.col("node").alias("doc_id"), F.col("component").alias("c0")), "doc_id", "left").select("doc_id", F.coalesce("c0", "doc_id").alias("c1"))
    sizes = durable(nodes).groupBy("c1").agg(F.count("*").alias("n"))
    final = spread_join(nodes, second, ["c1"], sizes, "left").select("doc_id", F.coalesce("c2", "c1").alias("component_id"))
    return signed, classes, matrix, durable(final)


def _groups(batches, keys: list[str], rows: int):
    """Tables of whole groups of equal keys, from sorted batches: several small groups at once, rows at most but for one group."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        while len(table):
            new = np.zeros(len(table), bool)
            for k in keys:
                x = table.column(k).to_numpy()
                new[1:] |= x[1:] != x[:-1]
            new[0] = bool(held) and any(held[-1].column(k)[-1] != table.column(k)[0] for k in keys)
            starts = np.flatnonzero(new)
            have = sum(map(len, held))
            # the last start up to which there are no more than rows; else the first one
            within = starts[starts + have <= rows]
            cut = int(within[-1]) if len(within) and have + len(table) > rows else int(starts[0]) if len(starts) and have + len(table) > rows else None
            if cut is None or cut == 0 and not held:
                held.append(table)
                break
            if cut:
                held.append(table.slice(0, cut))
            yield pa.concat_tables(held)
            held, table = [], table.slice(cut)
    if held:
        yield pa.concat_tables(held)


def _link_counts(classes: DataFrame, matrix: DataFrame, components: DataFrame, num: int, den: int) -> DataFrame:
    """n_shingles, a, b, links: the documents of other classes that a class links with; only classes that have some."""
    many = classes.join(components.select(F.col("doc_id").alias("rep"), F.col("component_id").alias("component")), "rep")
    sizes = durable(many.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("entries")).where("n > 1"))
    parts = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("entries") / BLOCK_ENTRIES)).cast("int")
    several = spread_join(many, sizes.select("component", parts.alias("parts")), ["component"], sizes.select("component", "n"))
    wanted = several.select(F.col("rep").alias("doc_id"), F.col("n_shingles").alias("n"), "a", "b", "copies", "component", "parts", F.pmod(F.xxhash64(F.lit(5), *_CLASS), "parts").cast("int").alias("block"))
    wanted = durable(wanted)
    rows = cm.only_some(matrix.select("doc_id", "n", "a", "b", "shared"), "doc_id", wanted.select("doc_id")).join(wanted, ["doc_id", "n", "a", "b"])
    # every two blocks meet once: a row goes to as many places as its component has blocks
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = rows.select("component", "block", other.alias("other"), "n", "a", "b", "copies", "shared").withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")
    keys = ["component", "i", "j"]

    def multiply(batches):
        for table in _groups(batches, keys, TILE_ROWS):
            n, copies, block, i, j = (table.column(c).to_numpy() for c in ("n", "copies", "block", "i", "j"))
            change = np.zeros(len(table), bool)
            for k in keys:
                x = table.column(k).to_numpy()
                change[1:] |= x[1:] != x[:-1]
            group = np.cumsum(change)
            lists = table.column("shared").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            at, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy().view(np.uint64)
            at = at - at[0]
            links = np.zeros(len(table), np.int64)

            def tile(rows: np.ndarray, side: np.ndarray | None) -> None:
                """Links among rows, or of those of one side with those of the other."""
                size = (at[1:] - at[:-1])[rows]  # noqa: B023
                row = np.repeat(np.arange(len(rows)), size)
                entry = np.repeat(at[rows] - np.cumsum(size) + size, size) + np.arange(len(row))  # noqa: B023
                both = overlaps(flat[entry] + mix(group[rows].astype(np.uint64))[row], row, len(rows))  # noqa: B023
                own, of, cut = n[rows], group[rows], block[rows]  # noqa: B023
                linked = (both > 0) & (both * (num + den) >= (own[:, None] + own[None, :]) * num) & (of[:, None] == of[None, :]) & ((cut[:, None] != cut[None, :]) | (i == j)[rows][:, None])  # noqa: B023
                if side is not None:
                    linked &= side[:, None] != side[None, :]
                np.fill_diagonal(linked, False)
                links[rows] += linked @ copies[rows]  # noqa: B023

            whole = np.arange(len(table))
            # groups of few rows together, a larger one by tiles of its two blocks, or of its one with itself
            for own in [whole] if len(table) <= TILE_ROWS else np.split(whole, np.flatnonzero(change)):
                first, last = i[own[0]], j[own[0]]
                if len(own) <= TILE_ROWS:
                    tile(own, None)
                    continue
                tiles = [np.split(r, range(TILE_ROWS, len(r), TILE_ROWS)) for r in (own[block[own] == first], own[block[own] == last])]
                for x, mine in enumerate(tiles[0]):
                    if first == last:
                        tile(mine, None)
                    for theirs in tiles[0][x + 1 :] if first == last else tiles[1]:
                        tile(np.concatenate([mine, theirs]), np.arange(len(mine) + len(theirs)) < len(mine))
            some = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(n[some]), *(pa.array(table.column(c).to_numpy()[some]) for c in ("a", "b")), pa.array(links[some])], names=[*_CLASS, "links"])

    found = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(multiply, "n_shingles long, a long, b long, links long")
    return found.groupBy(*_CLASS).agg(F.sum("links").alias("links"))


def ngram_jaccard_join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for each row of docs.

    Documents link when den * |x & y| >= num * |x | y| over their sets of
    distinct k-word n-grams, A-Z lower-cased; fewer words than k are one n-gram.
    component_id is the smallest doc_id reachable by links, a document's own
    included. n_links is the number of other documents whose set links with the
    row's own. A text without words, or null, has an empty set and no links; so
    has a row with a null id, whose component is null. Rows that repeat an id are
    one document, with the links of all its texts; such a document counts for
    each of its sets among the links of others. Other columns are not read.
    """
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed, classes, matrix, components = _solved(narrow, k, num, den)
    links = durable(_link_counts(classes, matrix, components, num, den))
    # classes of one document without links have nothing to add
    known = classes.join(links, _CLASS, "left").select(*_CLASS, (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "copies").where("n_links > 0")
    with_links = spread_join(signed, known.drop("copies"), _CLASS, known.select(*_CLASS, F.col("copies").alias("n")), "left")
    named = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    out = with_links.join(components, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.when(named, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"))


def keep_one_of_each_group(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs whose id is the smallest of their component, one row of each id; rows with a null id stay.

    Of rows that repeat an id, the one with the smallest hash of its text stays,
    and of those with one text, the first by all its columns written as JSON.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed, _, _, components = _solved(narrow, k, num, den)
    gone = durable(components.where("component_id < doc_id").select("doc_id"))
    # texts are shuffled only where one of these ids may be
    touched, rest = cm.parted(docs, "doc_id", gone)
    kept = touched.join(gone, "doc_id", "left_anti").select(*docs.columns)
    kept = kept if rest is None else kept.unionByName(rest)
    repeated = durable(signed.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept
    named = kept.where("doc_id IS NOT NULL")
    once = named.join(repeated, "doc_id", "left_semi")
    columns = [c for c in docs.columns if c != "doc_id"]
    order = F.struct(F.coalesce(F.xxhash64("text"), F.lit(0)), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    one = once.groupBy("doc_id").agg(F.min_by(F.struct(*columns), order).alias("row")).select("doc_id", "row.*").select(*docs.columns)
    return kept.where("doc_id IS NULL").unionByName(named.join(repeated, "doc_id", "left_anti").select(*docs.columns)).unionByName(one)
