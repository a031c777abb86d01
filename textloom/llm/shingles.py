"""Similarity of texts by their sets of word shingles: candidates from buckets, exact links inside groups.

Buckets hold small sketches; a search inside a bucket gives a forest of candidates,
never all pairs. What the forests connect is a group, and in each group the whole sets
decide. Large buckets and groups are cut into parts, and pairs of parts go to tasks
by themselves, so no task holds more than two parts and none is left out. Most of a
dense group is linked to its centre by one comparison each; two texts so linked need
no comparison, only the others meet them.
"""

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import as_bytes, stored, values
from textloom.llm.simhash import components

#: Words in a shingle unless an operator says otherwise, and seed of its hash.
WORDS, SEED = 5, 42
#: Members of a bucket or group, and bytes of a group's texts, that two parts have together.
TILE, TILE_BYTES = 4096, 32 << 20
#: Copies of a group's centre that its members are dealt to.
SALTS = 64
#: Shingles hashed together.
_RUN = 1 << 9


def hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """Distinct hashes of a text's shingles in order; a text of fewer words is one shingle."""
    parts = text.lower().split()
    n = len(parts) - words + 1
    line = b" ".join(parts)
    if not parts or n < 2:
        return np.array([xxhash.xxh64_intdigest(line, SEED)] if parts else [], np.uint64)
    starts, at = [], 0
    for p in parts:
        starts.append(at)
        at += len(p) + 1
    ends = [s - 1 for s in starts[words:]] + [len(line)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, n))


def digest(own: np.ndarray) -> bytes:
    """16 bytes that stand for a set."""
    return xxhash.xxh3_128_digest(own.tobytes())


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


class MinHashes:
    """A number of hash functions over sets, and the least value of each."""

    def __init__(self, count: int, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.masks = draw.integers(0, 1 << 64, (count, 1), np.uint64)
        self.factors = draw.integers(0, 1 << 64, (count, 1), np.uint64) | np.uint64(1)

    def of(self, own: np.ndarray) -> np.ndarray:
        least = np.full(len(self.masks), ~np.uint64(0))
        for k in range(0, len(own), _RUN):
            least = np.minimum(least, ((own[k : k + _RUN] ^ self.masks) * self.factors).min(axis=1))
        return least


def with_row(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a key for each row that is the same when it is read again.

    Rows as read from Parquet are known by their file and place there, so nothing
    is copied. Other tables are written first. Not for joins or unions of files.
    """

    def place(read: DataFrame) -> DataFrame:
        row = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
        return read.withColumn(name, row)

    try:
        return place(df)
    except AnalysisException:
        return place(stored(df, "rows"))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, bounds) of complete groups, from rows sorted by their first ``keys`` columns, numbers all."""

    def names(table: pa.Table | pa.RecordBatch) -> np.ndarray:
        columns = [table.column(j) for j in range(keys)]
        return np.stack([c.to_numpy(zero_copy_only=False) if isinstance(c, pa.Array) else c.to_numpy() for c in columns], axis=1)

    def out(parts: list[pa.Table]) -> tuple[pa.Table, np.ndarray]:
        table = pa.concat_tables(parts)
        own = names(table)
        change = np.flatnonzero((own[1:] != own[:-1]).any(axis=1)) + 1
        return table, np.concatenate([[0], change, [len(own)]])

    held: list[pa.Table] = []
    last: np.ndarray | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own, table = names(batch), pa.Table.from_batches([batch])
        if held and (last != own[0]).any():
            yield out(held)
            held = []
        # The last group may go on in the next batch.
        start = int(np.argmax((own == own[-1]).all(axis=1)))
        if start:
            yield out([*held, table.slice(0, start)])
            held = [table.slice(start)]
        else:
            held.append(table)
        last = own[-1]
    if held:
        yield out(held)


def _tiles(low: Column, parts: Column) -> Column:
    """All pairs of a part with each of ``parts`` parts, as structs of the smaller and the larger."""
    others = F.sequence(F.lit(0), parts - 1)
    return F.transform(others, lambda o: F.struct(F.least(low, o).alias("low"), F.greatest(low, o).alias("high")))


def buckets(keyed: DataFrame) -> DataFrame:
    """(key, node, n) of the buckets with ``n`` > 1 nodes, from distinct ``keyed`` (node, key).

    Of buckets with the same nodes, of which near copies have very many, one is kept.
    """
    sums = keyed.groupBy("key").agg(
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"),
    )
    own = sums.filter("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n")
    return keyed.join(stored(own, "buckets"), "key")


Search = Callable[[np.ndarray], list[tuple[int, int]]]


def candidates(members: DataFrame, search: Search, tile: int = TILE) -> DataFrame:
    """Links (a, b) that ``search`` finds among the sketches of a bucket; members (key, n, node, sketch).

    ``search`` takes a matrix of bytes, a sketch in each row, and gives pairs of rows that
    connect all that similar sketches connect, fewer than there are rows.
    """
    parts = F.when(F.col("n") > tile, F.ceil(2 * F.col("n") / tile)).otherwise(1).cast("int")
    part = F.pmod(F.xxhash64("node", F.lit("part")), F.col("parts")).cast("int")
    dealt = members.withColumn("parts", parts).withColumn("t", F.explode(_tiles(part, F.col("parts"))))
    rows = dealt.select("key", "t.low", "t.high", "node", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, 3):
            nodes = table.column("node").to_pylist()
            sketches = table.column("sketch").to_pylist()
            width = len(sketches[0])
            sketches = np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, width)
            a, b = [], []
            for start, end in zip(bounds, bounds[1:]):
                for x, y in search(sketches[start:end]) if end - start > 1 else ():
                    a.append(nodes[start + x])
                    b.append(nodes[start + y])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    group = ["key", "low", "high"]
    sorted_ = rows.repartition(*group).sortWithinPartitions(*group)
    return sorted_.mapInArrow(run, "a binary, b binary").distinct()


class Sets:
    """Sets of hashes turned around: for each hash, the sets that hold it."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        _, self.which = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(self.which, kind="stable")
        self.owners = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.bounds = np.concatenate([[0], np.cumsum(np.bincount(self.which))])

    def linked(self, k: int, least: Fraction) -> np.ndarray:
        """Whether each set is similar enough to set ``k``."""
        own = self.which[self.starts[k] : self.starts[k + 1]]
        first, length = self.bounds[own], self.bounds[own + 1] - self.bounds[own]
        before = np.concatenate([[0], np.cumsum(length)])
        places = np.repeat(first - before[:-1], length) + np.arange(before[-1])
        both = np.bincount(self.owners[places], minlength=len(self.sizes))
        union = self.sizes + self.sizes[k] - both
        return least.denominator * both >= least.numerator * union


def exact_links(sets: list[np.ndarray], least: Fraction, core: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all that similar sets connect: fewer than sets.

    ``core`` marks sets that are connected already: they are not compared with each
    other, and each tree gets one link to them at most.
    """
    core = np.zeros(len(sets), bool) if core is None else core
    turned = Sets(sets)
    new = ~core
    links: list[tuple[int, int]] = []
    for root in np.flatnonzero(~core):
        if not new[root]:
            continue
        new[root] = False
        front, joined = [int(root)], not core.any()
        while front and not (joined and not new.any()):
            k = front.pop()
            near = turned.linked(k, least)
            if not joined and (near & core).any():
                links.append((k, int(np.argmax(near & core))))
                joined = True
            found = np.flatnonzero(near & new)
            new[found] = False
            links += [(k, int(j)) for j in found]
            front += found.tolist()
    return links


def _similar(a: str, b: str, words: int, least: Fraction) -> Column:
    """Whether the texts in two columns are similar enough."""

    @F.arrow_udf("boolean")
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        out, last, own = [], None, None
        for x, y in zip(values(left), values(right)):
            if y != last:
                last, own = y, hashes(y, words)
            other = hashes(x, words)
            both = len(np.intersect1d(own, other, assume_unique=True))
            out.append(least.denominator * both >= least.numerator * (len(own) + len(other) - both))
        return pa.array(out, pa.bool_())

    return run(as_bytes(a), as_bytes(b))


def _centres(members: DataFrame) -> DataFrame:
    """(group, node) of the member of each group whose sketch agrees most with the most common values."""
    width = F.octet_length("sketch")
    values_ = F.transform(
        F.sequence(F.lit(0), F.floor(width / 2).cast("int") - 1), lambda k: F.substring(F.col("sketch"), 2 * k + 1, F.lit(2))
    )
    places = members.select("group", "node", F.posexplode(values_).alias("place", "value"))
    counts = places.groupBy("group", "place", "value").agg(F.count("*").alias("n"))
    common = counts.groupBy("group", "place").agg(F.max(F.struct("n", "value")).alias("most"))
    common = common.select("group", "place", F.col("most.value").alias("value"))
    agreed = places.join(common, ["group", "place", "value"])
    agreed = agreed.groupBy("group", "node").agg(F.count("*").alias("n"))
    return agreed.groupBy("group").agg(F.max(F.struct("n", "node")).alias("most")).select("group", "most.node")


def confirmed(
    members: DataFrame,
    texts: DataFrame,
    words: int,
    least: Fraction,
    tile: int = TILE,
    tile_bytes: int = TILE_BYTES,
) -> DataFrame:
    """Links (a, b) that connect all that similar texts of a group connect.

    members (node, group, row, bytes, sketch), texts (row, text): a node's text is that of its row.
    """
    sizes = members.groupBy("group").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    parts = F.greatest(F.ceil(2 * F.col("n") / tile), F.ceil(2 * F.col("bytes") / tile_bytes)).cast("int")
    large = (F.col("n") > tile) | ((F.col("bytes") > tile_bytes) & (F.col("n") > 2))
    sizes = stored(sizes.select("group", F.when(large, parts).otherwise(1).alias("parts")), "sizes")
    read = members.join(sizes.withColumnRenamed("group", "g"), F.col("group") == F.col("g"))
    read = read.select("node", "group", "row", "bytes", "parts")
    own = stored(texts.join(read, "row").select("node", "group", "parts", "bytes", "text"), "own")
    found = []
    none = F.lit(False).alias("core")
    rows = own.filter("parts = 1").select("group", F.lit(0).alias("low"), F.lit(0).alias("high"), none, "node", "text")
    if not sizes.filter("parts > 1").isEmpty():
        many = own.filter("parts > 1")
        inside = members.join(sizes.filter("parts > 1").select("group"), "group", "left_semi")
        centre = stored(many.join(stored(_centres(inside), "centres"), ["group", "node"], "left_semi"), "centre")
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        copies = centre.select("group", salt, F.col("node").alias("centre"), F.col("text").alias("centre_text"))
        dealt = many.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(copies, ["group", "salt"])
        seen = dealt.withColumn("core", _similar("text", "centre_text", words, least)).drop("centre_text", "salt")
        seen = stored(seen, "seen")
        found.append(seen.filter("core and node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")))
        # Texts linked to the centre meet only the others, in parts after theirs.
        amount = seen.groupBy("group", "core").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
        outer, inner = (
            F.coalesce(F.max(F.when(F.col("core") == is_core, parts)), F.lit(0)) for is_core in (False, True)
        )
        amount = stored(amount.groupBy("group").agg(outer.alias("outer"), inner.alias("inner")), "amount")
        seen = seen.drop("parts").join(amount, "group")
        mine = F.when(F.col("core"), F.col("inner")).otherwise(F.col("outer"))
        part = F.pmod(F.xxhash64("node", F.lit("part")), mine).cast("int")
        part = F.when(F.col("core"), F.col("outer") + part).otherwise(part)
        meets = F.when(F.col("core"), F.col("outer")).otherwise(F.col("outer") + F.col("inner"))
        seen = seen.withColumn("part", part).withColumn("meets", meets).filter("meets > 0")
        tiles = seen.withColumn("t", F.explode(_tiles(F.col("part"), F.col("meets"))))
        rows = rows.unionByName(tiles.select("group", "t.low", "t.high", "core", "node", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, 3):
            nodes = table.column("node").to_pylist()
            core = table.column("core").to_numpy()
            a, b = [], []
            for start, end in zip(bounds.tolist(), bounds[1:].tolist()):
                if end - start < 2:
                    continue
                sets = [hashes(t, words) for chunk in table.column("text").slice(start, end - start).chunks for t in values(chunk)]
                for x, y in exact_links(sets, least, core[start:end]):
                    a.append(nodes[start + x])
                    b.append(nodes[start + y])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    # Groups of equal hash would only be compared with each other.
    rows = rows.select(F.xxhash64("group").alias("group"), "low", "high", "core", "node", as_bytes("text").alias("text"))
    key = ["group", "low", "high"]
    sorted_ = rows.repartition(*key).sortWithinPartitions(*key)
    found.append(sorted_.mapInArrow(run, "a binary, b binary"))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def near_roots(
    own: DataFrame,
    keyed: DataFrame,
    texts: DataFrame,
    search: Search,
    words: int,
    least: float,
    tile: int = TILE,
    tile_bytes: int = TILE_BYTES,
) -> DataFrame:
    """(node, root) of the nodes that similar texts connect with others.

    own (node, row, bytes, sketch) has a node for each distinct set, keyed (node, key)
    its buckets, texts (row, text) the whole texts.
    """
    met = buckets(keyed).join(own.select("node", "sketch"), "node")
    maybe = stored(candidates(met, search, tile), "maybe")
    groups = stored(components(maybe), "groups")
    # The smallest node of a group is not hung on itself.
    placed = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct()).distinct()
    members = placed.withColumnRenamed("root", "group").join(own, "node")
    links = confirmed(members, texts, words, Fraction(str(least)), tile, tile_bytes)
    return stored(components(stored(links, "near")), "roots")
