"""SimHash near copies, linked through BK-trees over shards of fingerprints.

A text's fingerprint has a bit set where over half the hashes of its word shingles have it set. Distinct
fingerprints are dealt to shards by keys made of some of their bits; a shard's BK-tree hangs each
fingerprint under its parent by their Hamming distance, and only edges whose distance can lead to a
fingerprint within the radius are followed. A shard gives a spanning forest of its links, never all
pairs; components of these are the groups of near copies.

Near copies by a similarity (``near_copies``, ``thinned``) take such groups as candidates alone: shards are
made by least hashes of shingles, the radius is wide, and all texts of a candidate group are then compared
by their sets of shingles. Only pairs that reach the similarity are links.

A shard's tree is built in the task that holds the shard and asked there; it is not broadcast, as trees of
all shards would have to be gathered on the driver and would grow with the corpus. A lost executor costs
its own shards alone: they are read anew from the written table of shards, and their trees built again.
A shard of many members is cut into parts, which meet in pairs.

Rules for odd input: a null text is the empty text; a text without words has fingerprint zero and is
linked like any other; one with fewer words than a shingle has one shingle, the whole sequence. Rows of
equal ``doc_id`` share its group. Rows whose ``doc_id`` is null get a group and pass its links on, but
never name it; a group of such rows alone has a null name. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallspark.operators.components import components
from recallspark.llm.rows import batches, texts
from recallspark.session import packed, written

SEED = 42

#: Shards of up to this many fingerprints use a tree of Python objects, larger ones arrays.
SMALL = 24

#: Members of one part of a large shard, about.
HALF = 8192

#: Names of groups without any doc_id start here.
NAMELESS = 1 << 62


def _mixed(h: np.ndarray, times: int) -> np.ndarray:
    """The hashes anew, by a bijection of 64-bit integers applied so many times."""
    for _ in range(times):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """A hash for each place of a shingle, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - shingle + 1)
    starts, stops = [0, *ends[: n - 1].tolist()], (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], dtype=np.uint64)


def majority(hashes: np.ndarray, blocks: int) -> bytes:
    """``blocks`` times 64 bits, the most significant first; the first block is that of the hashes themselves."""
    n, out = len(hashes), []
    if not n:
        return bytes(8 * blocks)
    for k in range(blocks):
        block = _mixed(hashes, k) if k else hashes
        counts = np.zeros(64, dtype=np.int64)
        for at in range(0, n, 1 << 14):
            part = block[at : at + (1 << 14)].astype(">u8")
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(np.packbits(counts * 2 > n).tobytes())
    return b"".join(out)


def fingerprint(text: str, shingle: int, blocks: int) -> bytes:
    """The fingerprint of all shingles, repeats included."""
    return majority(shingle_hashes(text, shingle), blocks)


def fingerprints(docs: DataFrame, shingle: int, blocks: int, text: str = "text") -> DataFrame:
    """``docs`` without its text and with ``fp``, in the order of rows."""
    kept = docs.drop("fp")
    names = [c for c in kept.columns if c != text]

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            made = pa.array([fingerprint(x, shingle, blocks) for x in texts(batch, text)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), made], [*names, "fp"])

    return batches(kept).mapInArrow(run, kept.drop(text).schema.add("fp", "binary"))


class BKTree:
    """Integers under their Hamming distance."""

    def __init__(self, root: int, number: int):
        self.root = (root, number, {})

    def add(self, value: int, number: int) -> None:
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            child = node[2].get(d)
            if child is None:
                node[2][d] = (value, number, {})
                return
            node = child

    def within(self, value: int, radius: int) -> list[int]:
        """Numbers of those not farther than ``radius``."""
        found, waiting = [], [self.root]
        while waiting:
            stands, number, children = waiting.pop()
            d = (stands ^ value).bit_count()
            if d <= radius:
                found.append(number)
            waiting.extend(child for edge, child in children.items() if d - radius <= edge <= d + radius)
        return found


class Heads:
    """Disjoint sets of places; the head of each is its name."""

    def __init__(self, n: int):
        self.head = list(range(n))

    def top(self, i: int) -> int:
        head = self.head
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether the two were apart."""
        a, b = self.top(i), self.top(j)
        self.head[max(a, b)] = min(a, b)
        return a != b

    def names(self) -> np.ndarray:
        head = np.array(self.head)
        while (up := head[head]).tolist() != head.tolist():
            head = up
        self.head = head.tolist()
        return head


def forest_small(values: list[int], radius: int, side: list[int]) -> list[tuple[int, int]]:
    """Spanning forest of the links between few integers, as pairs of places.

    Where there are two sides (0 and 1), those of side 0 make the tree and those of side 1 ask it.
    """
    heads, out = Heads(len(values)), []
    held, asking = [i for i, s in enumerate(side) if not s], [i for i, s in enumerate(side) if s]
    if not held:
        return out
    tree = BKTree(values[held[0]], held[0])
    for i in held[1:]:
        if not asking:
            out.extend((j, i) for j in tree.within(values[i], radius) if heads.join(i, j))
        tree.add(values[i], i)
    for i in asking:
        out.extend((j, i) for j in tree.within(values[i], radius) if heads.join(i, j))
    return out


class WideTree:
    """The same tree over many fingerprints, in arrays: children of a node stand together, by their distance.

    ``words`` are rows of unsigned 64-bit words. The tree is laid out level by level: the first of those
    that hang together is a node, the others are dealt to its edges by their distance from it.
    """

    def __init__(self, words: np.ndarray):
        self.words = words
        self.span = 64 * words.shape[1] + 1
        n = len(words)
        self.node, self.key, self.level_starts = [np.zeros(1, np.int64)], [np.full(1, -1, np.int64)], [0, 1]
        waiting, parent = np.arange(1, n), np.zeros(max(0, n - 1), np.int64)
        parent_at = np.zeros(len(waiting), np.int64)
        while len(waiting):
            d = np.bitwise_count(words[waiting] ^ words[parent]).sum(axis=1, dtype=np.int64)
            keys, first, group = np.unique(parent_at * self.span + d, return_index=True, return_inverse=True)
            start = self.level_starts[-1]
            self.node.append(waiting[first])
            self.key.append(keys)
            self.level_starts.append(start + len(keys))
            rest = np.ones(len(waiting), bool)
            rest[first] = False
            parent, parent_at, waiting = waiting[first][group][rest], start + group[rest], waiting[rest]
        self.node, self.key = np.concatenate(self.node), np.concatenate(self.key)

    def named_alike(self, names: np.ndarray) -> np.ndarray:
        """For each node the name that all of its subtree has, or -1."""
        own = names[self.node].copy()
        for start, stop in zip(self.level_starts[-2:0:-1], self.level_starts[:1:-1]):
            up = self.key[start:stop] // self.span
            own[up[own[start:stop] != own[up]]] = -1
        return own

    def ask(self, words: np.ndarray, places: np.ndarray, radius: int, heads: Heads, out: list[tuple[int, int]], block: int = 1024) -> None:
        """Adds to ``out`` a link for each pair within the radius that was not yet joined by others.

        Only edges are followed whose distance can lead into the radius, and no subtree is entered whose
        members are all in the asking one's group already.
        """
        for at in range(0, len(places), block):
            names = heads.names()
            alike = self.named_alike(names)
            query = np.arange(at, min(len(places), at + block))
            stand = np.zeros(len(query), np.int64)
            while len(query):
                fresh = alike[stand] != names[places[query]]
                query, stand = query[fresh], stand[fresh]
                d = np.bitwise_count(words[query] ^ self.words[self.node[stand]]).sum(axis=1, dtype=np.int64)
                near = d <= radius
                one, other = places[query[near]], self.node[stand[near]]
                _, first = np.unique(names[one] * len(names) + names[other], return_index=True)
                out.extend((j, i) for i, j in zip(one[first].tolist(), other[first].tolist()) if heads.join(i, j))
                low = np.searchsorted(self.key, stand * self.span + np.maximum(d - radius, 0))
                high = np.searchsorted(self.key, stand * self.span + np.minimum(d + radius, self.span - 1), side="right")
                size = high - low
                query = np.repeat(query, size)
                stand = np.repeat(low - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())


def forest(words: np.ndarray, radius: int, side: np.ndarray) -> list[tuple[int, int]]:
    """The same for many, given as rows of unsigned 64-bit words."""
    held, asking = np.flatnonzero(side == 0), np.flatnonzero(side)
    out: list[tuple[int, int]] = []
    if len(held):
        tree, heads = WideTree(words[held]), Heads(len(words))
        tree.node = held[tree.node]
        tree.words = words
        places = asking if len(asking) else held
        tree.ask(words[places], places, radius, heads, out)
    return out


def exact_keys(radius: int, blocks: int, cuts: int = 5) -> list[list[int]]:
    """Bit places of each key: all choices of ``cuts - radius`` of so many even cuts.

    Two fingerprints within the radius agree on at least that many cuts, so they share a key for certain.
    """
    parts = np.array_split(np.arange(64 * blocks), cuts)
    return [np.concatenate(chosen).tolist() for chosen in combinations(parts, cuts - radius)]


def _sharded(groups: DataFrame, keys: list[list[int]]) -> DataFrame:
    """``shard, fp, rep``: each fingerprint once a key."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            fps = batch.column("fp").to_pylist()
            if not fps:
                continue
            bits = np.unpackbits(np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), -1), axis=1)
            for table, places in enumerate(keys):
                chosen = np.packbits(bits[:, places], axis=1)
                wide = np.zeros((len(fps), 8), np.uint8)
                wide[:, 8 - chosen.shape[1] :] = chosen
                shard = (wide.view(">u8").ravel().astype(np.uint64) | (np.uint64(table) << np.uint64(56))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column("fp"), batch.column("rep")], ["shard", "fp", "rep"])

    return groups.select("fp", "rep").mapInArrow(run, "shard long, fp binary, rep long")


def _halves(shards: DataFrame) -> DataFrame:
    """``shard, side, fp, rep``: shards of more than one member; larger ones than ``HALF`` in pairs of halves.

    A large shard's members are dealt to as many parts as it needs, and each two parts meet in a task of
    their own: one is the tree, the other asks it; a part also meets itself. Members are copied once for
    each part of their own shard, and no task holds more than two parts.
    """
    sizes = shards.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
    rows = shards.join(sizes, "shard").withColumn("parts", F.ceil(F.col("n") / HALF).cast("int")).withColumn("part", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts")).cast("int"))
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    shard = F.when(F.col("parts") == 1, F.col("shard")).otherwise(F.xxhash64("shard", F.least("part", "other"), F.greatest("part", "other")))
    return met.select(shard.alias("shard"), (F.col("part") > F.col("other")).cast("int").alias("side"), "fp", "rep")


def _links(shards: DataFrame, radius: int) -> DataFrame:
    """``u, v``: spanning forests of all shards, by representatives."""

    def linked(fps: list[bytes], reps: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(fps) <= SMALL:
            pairs = forest_small([int.from_bytes(x, "big") for x in fps], radius, side.tolist())
        else:
            pairs = forest(np.frombuffer(b"".join(fps), ">u8").astype(np.uint64).reshape(len(fps), -1), radius, side)
        places = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        return reps[places[:, 0]], reps[places[:, 1]]

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_shards(found):
            shard = rows.column("shard").to_numpy()
            starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            stops = np.r_[starts[1:], len(shard)]
            full = np.flatnonzero(stops - starts > 1)
            if not len(full):
                continue
            fps, reps, side = rows.column("fp").to_pylist(), rows.column("rep").to_numpy(), rows.column("side").to_numpy()
            us, vs = zip(*(linked(fps[a:b], reps[a:b], side[a:b]) for a, b in zip(starts[full], stops[full])))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    halves = _halves(written(packed(shards), "shards"))
    return batches(halves, 16384).repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "u long, v long")


def whole_shards(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by shard, dealt anew so that none ends inside a shard."""
    held: list[pa.RecordBatch] = []
    for batch in found:
        if not batch.num_rows:
            continue
        shard = batch.column("shard").to_numpy()
        if held and held[-1].column("shard")[-1].as_py() != shard[0]:
            yield pa.concat_batches(held)
            held = []
        last = int(np.searchsorted(shard, shard[-1]))
        if last:
            yield pa.concat_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.concat_batches(held)


def _grouped(docs: DataFrame, shingle: int, blocks: int, radius: int, keys: list[list[int]], text: str) -> DataFrame:
    """``docs`` without its text and with ``fp, component``; nameless groups have numbers from ``NAMELESS`` on."""
    marked = written(fingerprints(docs, shingle, blocks, text), "fingerprints")
    spare = F.conv(F.substring(F.hex("fp"), 1, 16), 16, 10).cast("decimal(20,0)")
    groups = marked.groupBy("fp").agg(F.min("doc_id").alias("least")).select("fp", F.coalesce("least", F.floor(spare / 4).cast("long") + F.lit(NAMELESS)).alias("rep"))
    groups = written(groups, "fingerprint-groups")
    links = components(_links(_sharded(batches(groups), keys), radius))
    named = groups.join(links, groups.rep == links.id, "left").select("fp", F.coalesce("component", "rep").alias("component"))
    return marked.join(named, "fp")


def grouped(docs: DataFrame, *, shingle: int, blocks: int, radius: int, keys: list[list[int]], text: str = "text") -> DataFrame:
    """Per row of ``docs`` (``doc_id`` and a text) ``doc_id, fp, component_id``."""
    found = _grouped(docs.select("doc_id", text), shingle, blocks, radius, keys, text)
    return found.select("doc_id", "fp", F.when(F.col("component") < NAMELESS, F.col("component")).alias("component_id"))


#: Candidates for near copies: blocks of 64 bits of a fingerprint, and the radius, a cosine of 0.6.
FINE_BLOCKS = 4
FINE_RADIUS = math.floor(64 * FINE_BLOCKS * math.acos(0.6) / math.pi)

#: Texts of a candidate group are compared by pairs of blocks of so many.
BLOCK = 256

#: Stands for a null doc_id, behind all others.
LAST = (1 << 63) - 1


class LeastHashes:
    """Keys of a set of hashes: each the least hashes under ``rows`` orders.

    Sets of Jaccard similarity s share a key with probability ``1 - (1 - s ** rows) ** tables``, whatever
    their sizes: 0.99999 at 0.8 for 16 tables of 3 rows.
    """

    def __init__(self, tables: int, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.shape = tables, rows
        self.turns = rng.integers(0, 1 << 64, tables * rows, np.uint64)
        self.factors = rng.integers(0, 1 << 64, tables * rows, np.uint64) | np.uint64(1)

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        if not len(hashes):
            return np.zeros(0, np.int64)
        least = np.full(len(self.turns), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(hashes), 1 << 11):
            least = np.minimum(least, ((hashes[at : at + (1 << 11), None] ^ self.turns) * self.factors).min(axis=0))
        out = np.arange(self.shape[0], dtype=np.uint64)
        for row in least.reshape(self.shape).T:
            out = _mixed(out ^ row, 1)
        return out.view(np.int64)


def _marked(slim: DataFrame, shingle: int, tables: int, rows: int) -> DataFrame:
    """``_k, _h, sid, fp, keys`` of each row; ``sid`` stands for the set of shingles."""
    made = LeastHashes(tables, rows)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            sets = [np.unique(shingle_hashes(x, shingle)) for x in texts(batch)]
            sid = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            columns = [batch.column("_k"), batch.column("_h"), pa.array(sid), pa.array([majority(x, FINE_BLOCKS) for x in sets], pa.binary()), pa.array([made.keys(x) for x in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["_k", "_h", "sid", "fp", "keys"])

    return batches(slim.select("_k", "_h", "text")).mapInArrow(run, "_k long, _h long, sid long, fp binary, keys array<long>")


def forest_exact(values: np.ndarray, starts: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Spanning forest of the links between sets whose Jaccard similarity is at least the one given.

    The sets follow each other in ``values``, none of them empty; ``starts`` says where each begins.
    """
    distinct, codes = np.unique(values, return_inverse=True)
    sizes = np.diff(np.r_[starts, len(values)])
    label, out, mark = np.arange(len(starts)), [], np.zeros(len(distinct), np.uint8)
    for i in range(len(starts) - 1):
        if (label == label[i]).all():
            continue
        own, rest = codes[starts[i] : starts[i + 1]], starts[i + 1]
        mark[own] = 1
        common = np.add.reduceat(mark[codes[rest:]], starts[i + 1 :] - rest, dtype=np.int64)
        mark[own] = 0
        near = np.flatnonzero(common >= similarity * (sizes[i] + sizes[i + 1 :] - common) - 1e-9) + i + 1
        for other, place in zip(*np.unique(label[near], return_index=True)):
            if other != label[i]:
                out.append((i, int(near[place])))
                label[label == other] = label[i]
    return out


def _confirmed(sets: DataFrame, similarity: float) -> DataFrame:
    """``u, v``: links of ``sets`` (``sid, component, n, set``) inside their candidate groups of n texts."""
    dealt = sets.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    shards = dealt.select(F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")).alias("shard"), F.col("sid").alias("rep"), "set")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_shards(found):
            shard, reps, held = rows.column("shard").to_numpy(), rows.column("rep").to_numpy(), rows.column("set")
            values, at = held.flatten().to_numpy(), np.r_[0, np.cumsum(held.value_lengths().to_numpy())]
            starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            for a, b in zip(starts, np.r_[starts[1:], len(shard)]):
                if b - a > 1:
                    places = np.array(forest_exact(values[at[a] : at[b]], at[a:b] - at[a], similarity), dtype=np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array(reps[a:b][places[:, 0]]), pa.array(reps[a:b][places[:, 1]])], ["u", "v"])

    return batches(shards, 4096).repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "u long, v long")


def _once(rows: DataFrame) -> DataFrame:
    """One row of each ``_k, _h``: the first by all its columns."""
    others = [F.col(c) for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("_k", "_h").orderBy(*others))).where("_n = 1").drop("_n")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_k", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn("_h", F.xxhash64("text"))


def _copies(docs: DataFrame, similarity: float, shingle: int, tables: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """``_marked``'s rows, and ``sid, first, component`` of each set: ``first`` is its least ``_k, _h``."""
    slim = docs.select("_k", "_h", "text")
    marked = written(packed(_marked(slim, shingle, tables, rows)), "marks")
    nodes = written(packed(marked.groupBy("sid").agg(F.min(F.struct("_k", "_h")).alias("first"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))), "sets")
    candidates = written(packed(components(_links(nodes.select(F.explode("keys").alias("shard"), "fp", F.col("sid").alias("rep")), FINE_RADIUS))), "candidates")
    sizes = candidates.groupBy("component").agg(F.count("*").alias("n"))
    asked = candidates.join(sizes, "component").join(nodes, F.col("id") == F.col("sid")).select("first._k", "first._h", "sid", "component", "n")
    names = ["sid", "component", "n"]

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            sets = pa.array([np.unique(shingle_hashes(x, shingle)).view(np.int64) for x in texts(batch)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), sets], [*names, "set"])

    said = batches(_once(slim.join(asked, ["_k", "_h"])).select(*names, "text"))
    links = components(_confirmed(said.mapInArrow(run, "sid long, component long, n long, set array<long>"), similarity))
    found = nodes.join(links, nodes.sid == links.id, "left").select("sid", "first", F.coalesce("component", "sid").alias("component"))
    return marked, found


def near_copies(docs: DataFrame, *, similarity: float = 0.8, shingle: int = 5, tables: int = 16, rows: int = 3, text: str = "text") -> DataFrame:
    """Per row ``doc_id, fp, component_id``: groups linked by Jaccard similarities of distinct shingles."""
    marked, found = _copies(_keyed(docs.select("doc_id", F.col(text).alias("text"))), similarity, shingle, tables, rows)
    least = found.groupBy("component").agg(F.min("first._k").alias("least"))
    named = found.join(least, "component").select("sid", "least")
    name = lambda c: F.when(F.col(c) < LAST, F.col(c))
    return marked.join(named, "sid").select(name("_k").alias("doc_id"), "fp", name("least").alias("component_id"))


def thinned(docs: DataFrame, *, similarity: float = 0.8, shingle: int = 5, tables: int = 16, rows: int = 3) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of smallest ``doc_id``, null ones last.

    Rows of equal ``doc_id`` and text are one row. Every link of a group is a pair of texts whose sets of
    shingles have at least that Jaccard similarity.
    """
    inner = {"doc_id": "doc_id", "text": "text"}
    names = [inner.get(c, f"c{i}") for i, c in enumerate(docs.columns)]
    keyed = _keyed(docs.toDF(*names))
    _, found = _copies(keyed, similarity, shingle, tables, rows)
    first = found.groupBy("component").agg(F.min("first").alias("f")).select("f._k", "f._h")
    return _once(keyed.join(first, ["_k", "_h"], "left_semi")).select(*names).toDF(*docs.columns)
