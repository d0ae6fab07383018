"""K-d tree partitioning: nodes are cut at weighted medians along their widest metadata dimension.

Every dimension is a whole number of 32 bits per row that follows from the text, so equal texts share all of them.  A
node's width along a dimension is its range as a share of the range of the whole table, which makes dimensions
comparable.  Medians of all dimensions are found together, by descending their bits sixteen at a time: each step sums
the bytes of at most 65,536 cells a node and dimension, and keeps the cell that holds the middle; only the node's few
numbers reach the driver.  The widest dimension is cut unless too much of the node's weight lies exactly at its
median, where metadata tells nothing apart; then the next widest is.  Among rows of the median value the checksum of
the text decides, so only equal texts (or colliding checksums) tie.  A group of equal texts at the median stays whole
if that leaves the node's halves within `tolerance` of each other, otherwise a hash of the ids, found by the same
descent, divides it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.common import cut, plain_text, salted_rank

CELL_BITS = 16
#: Share of a node's weight at the median value from which on a dimension counts as tied there.
TIED = 0.2
#: Difference of a node's halves, as a share of its weight, below which cuts count as equally even.
UNEVEN = 0.005


def text_dimensions(text: Column) -> dict[str, Column]:
    """Metadata that follows from a text alone: length on a log scale, bytes and words a character, share of marks and digits."""
    size, chars = F.octet_length(text), F.char_length(text)
    marks = chars - F.char_length(F.translate(text, ".,;:!?()\"'-0123456789", ""))

    def share(part: Column) -> Column:
        return F.when(chars == 0, F.lit(0.0)).otherwise(part / chars)
    return {
        "length": (F.log2(size + F.lit(1)) * F.lit(2**26)).cast("long"),
        "script": ((F.greatest(share(size), F.lit(1.0)) - F.lit(1.0)) * F.lit(2**30)).cast("long"),
        "words": (share(_spaces(text)) * F.lit(2**31)).cast("long"),
        "marks": (share(marks) * F.lit(2**31)).cast("long"),
    }


def _spaces(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, " \t\n\r\x0b\x0c", ""))


def _middle(rows: DataFrame, key: Column, goal: dict[int, float], bits: int = 64) -> dict[int, tuple[int, int, int, int]]:
    """For each node: the key of so many bits that holds weight goal[node].

    Returns node -> (key, weight below the key, weight at the key, rows at the key).
    """
    done = {node: (0, 0) for node in goal}  # prefix, weight below the prefix
    at: dict[int, tuple[int, int]] = {}
    for step in range(bits // CELL_BITS):
        shift = bits - CELL_BITS * (step + 1)
        cell = F.shiftrightunsigned(key, shift).bitwiseAND(F.lit(2**CELL_BITS - 1))
        prefix = F.shiftrightunsigned(key, shift + CELL_BITS) if step else F.lit(0)
        wanted = _by_node({n: p for n, (p, _) in done.items()})
        left = _by_node({n: goal[n] - below for n, (_, below) in done.items()}, "double")
        cells = (rows.filter(F.col("node").isin(*goal) & (prefix == wanted))
                 .groupBy("node", cell.alias("cell")).agg(F.sum("size").alias("weight"), F.count("*").alias("rows")))
        upto = F.sum("weight").over(Window.partitionBy("node").orderBy("cell"))
        found = (cells.withColumn("upto", upto).withColumn("left", left)
                 .filter((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("weight") < F.col("left"))).collect())
        for r in found:
            p, below = done[r.node]
            done[r.node] = ((p << CELL_BITS) | r.cell, below + r.upto - r.weight)
            at[r.node] = r.weight, r.rows
    return {n: (p, below, *at[n]) for n, (p, below) in done.items()}


def _signed(key: int) -> int:
    return key - 2**64 if key >= 2**63 else key


def _by_node(values: dict[int, float], kind: str = "long") -> Column:
    """The value of the row's node; at most one for each leaf."""
    cast = (lambda v: F.lit(_signed(v))) if kind == "long" else (lambda v: F.lit(float(v)))
    return reduce(lambda c, nv: c.when(F.col("node") == nv[0], cast(nv[1])),
                  list(values.items())[1:], F.when(F.col("node") == next(iter(values)), cast(next(iter(values.values())))))


def _widest(placed: DataFrame, bounds: list, dimensions: list[str], whole: dict[str, int]) -> dict[int, str]:
    """The dimension that each node is cut along: the widest of those that are not tied at their median, if there is one.

    Where single rows are so heavy that a cut would leave the halves more than UNEVEN apart, evener cuts come first.
    """
    n = len(dimensions)
    each = placed.select("size", F.explode(F.array(*[F.struct((F.col("node") * n + i).alias("node"), F.col(d).alias("at"))
                                                     for i, d in enumerate(dimensions)])).alias("v")).select("size", "v.node", "v.at")
    goal = {r.node * n + i: r.weight / 2 for r in bounds for i in range(n)}
    middle = _middle(each, F.col("at"), goal, 32)
    out = {}
    for r in bounds:
        rank = []
        for i, d in enumerate(dimensions):
            _, below, at, rows = middle[r.node * n + i]
            tied = at / r.weight if rows > 1 and at > TIED * r.weight else 0.0
            gap = min(abs(r.weight - 2 * below), abs(r.weight - 2 * (below + at))) / rows / r.weight  # the checksum divides ties
            rank.append((tied, max(0.0, gap - UNEVEN), -(r[f"high_{d}"] - r[f"low_{d}"]) / whole[d], i))
        out[r.node] = dimensions[min(rank)[3]]
    return out


def kd_shards(rows: DataFrame, dimensions: list[str], target_bytes: float | None = None, leaves: int | None = None,
              tolerance: float = 0.02) -> DataFrame:
    """Adds `shard` and `cuts` to rows(size, id_hash, checksum, dimensions...), a table that is cheap to read again.

    Nodes are halved until each holds at most target_bytes, or until there are `leaves` (a power of two) of them.  A
    node without a row, or with a single key that one row holds, is a leaf.  Shards are numbered along the tree; `cuts`
    names the dimensions that were cut on the way to a row's shard, from the root on.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    if leaves is None:
        leaves = 1
        while total / leaves > target_bytes:
            leaves *= 2
    placed = rows.withColumns({"node": F.lit(0), "cuts": F.lit("")})
    width, whole = 1, {}
    while width < leaves:
        bounds = placed.groupBy("node").agg(
            F.sum("size").alias("weight"),
            *[f(d).alias(f"{n}_{d}") for d in dimensions for n, f in (("low", F.min), ("high", F.max))]).collect()
        if not bounds:
            break
        whole = whole or {d: max(1, bounds[0][f"high_{d}"] - bounds[0][f"low_{d}"]) for d in dimensions}
        widest = _widest(placed, bounds, dimensions, whole)
        goal = {r.node: r.weight / 2 for r in bounds}
        along = reduce(lambda c, d: c.when(F.col("node").isin(*[n for n, x in widest.items() if x == d]), F.col(d))
                       if d in widest.values() else c, dimensions, F.when(F.lit(False), F.lit(0)))
        key = F.shiftleft(along.cast("long"), 32).bitwiseOR(F.col("checksum").cast("long"))
        keyed = placed.withColumn("_key", key)
        middle = _middle(keyed, F.col("_key"), goal)
        to_left, split = {}, {}
        for node, (k, below, at, _) in middle.items():
            gaps = [(abs(2 * (below + part) - 2 * goal[node]), part) for part in (0, at)]
            gap, part = min(gaps)
            if gap <= tolerance * 2 * goal[node]:
                to_left[node] = part > 0
            else:
                split[node] = (k, goal[node] - below)
        # flipping the sign bit makes the comparison of 64-bit keys unsigned
        sign = F.lit(-2**63)
        flipped, at_key = F.col("_key").bitwiseXOR(sign), _by_node({n: x[0] for n, x in middle.items()})
        right = F.when(flipped < at_key.bitwiseXOR(sign), 0).when(flipped > at_key.bitwiseXOR(sign), 1)
        if split:
            tied = keyed.filter(F.col("node").isin(*split) & (F.col("_key") == _by_node({n: k for n, (k, _) in split.items()})))
            inner = _middle(tied, F.col("id_hash"), {n: left for n, (_, left) in split.items()})
            cuts = {}
            for n, (k, below, at, _) in inner.items():
                upper = abs(below + at - split[n][1]) < abs(below - split[n][1])
                cuts[n] = (k, upper)
            hashed = F.col("id_hash").bitwiseXOR(sign)
            limit = _by_node({n: k for n, (k, _) in cuts.items()}).bitwiseXOR(sign)
            upper = F.col("node").isin(*[n for n, (_, u) in cuts.items() if u])
            right = right.when(F.col("node").isin(*cuts), F.when((hashed < limit) | ((hashed == limit) & upper), 0).otherwise(1))
        right = right.when(F.col("node").isin(*[n for n, left in to_left.items() if left]), 0).otherwise(1)
        named = reduce(lambda c, nd: c.when(F.col("node") == nd[0], nd[1]), widest.items(), F.when(F.lit(False), ""))
        path = F.when(F.col("cuts") == "", named).otherwise(F.concat_ws("/", "cuts", named))
        placed = cut(keyed.withColumns({"cuts": path, "node": (F.col("node") * 2 + right).cast("int")}).drop("_key"), "nodes")
        width *= 2
    return placed.withColumnRenamed("node", "shard")


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16,
                    tolerance: float = 0.02) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under the law `bytes`), cuts.

    Shards have nearly equal bytes, where a document's size is that of its text plus one (null text: 1).  Equal
    texts share a shard unless keeping the group whole would unbalance a node by more than the tolerance.  Repeated
    rows are placed each; null ids are hashed like any other; rows of equal text and id are told apart by their place.
    Texts of any length are read whole, other columns are ignored whatever their names, and an empty table gives an
    empty result.
    """
    text = plain_text(text_col)
    dims = text_dimensions(text)
    facts = cut(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.crc32(F.encode(text, "UTF-8")).alias("checksum"),
        F.xxhash64(F.col(id_col), F.monotonically_increasing_id()).alias("id_hash"),
        *[c.alias(n) for n, c in dims.items()]), "facts")
    placed = cut(kd_shards(facts, list(dims), leaves=shards, tolerance=tolerance)
                 .select("doc_id", "size", "text_crc32", "shard", "id_hash", "cuts"), "placed")
    ranked = salted_rank(placed, ["shard"], [F.col("id_hash")], ["id_hash"], "slot")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
                         F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "cuts")
