"""SimHash near-dedup by anchor-point covering.

The 64 bits fall into blocks, so that two fingerprints within the threshold differ in at most `near` bits of one block.
A block's anchors are the words of a covering code: a Hamming code on its first 15 bits (every word is within one bit of a
code word) and all values of its other bits. A fingerprint goes to every anchor within the covering radius plus `near`; at
an anchor, the fingerprints that have it as their nearest are compared with all that came. Each pair within the threshold
meets: the nearest anchor of one is within radius plus `near` of the other.

Texts of a similarity of 0.8 differ in more bits than that: alike() takes fingerprints of WIDTH words and as many blocks of bits,
drawn from all of them, as it takes for two such texts to meet with a probability of MEET. Its threshold within a block is none, so
a fingerprint goes to the anchors within the covering radius, which is one a block. A block has as many bits as there are texts to
tell apart; what meets is held to a distance, and then to the similarity itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import bloom, copies
from weftline.llm.base import OWN, cut, joined, mapped, picked, sliced, trimmed
from weftline.llm.components import components, forest, labels
from weftline.llm.words import hashed, mixed, runs, sums

RADIUS, CODE = 1, 15
#: Fingerprints at one anchor from which it is dealt out as tiles, and pairs compared at once.
TILE, AT_ONCE = 8_192, 2_000_000


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """Bits set in over half the XXH64 hashes of the text's shingles. A text of fewer words is one shingle, an empty one gives 0."""
    ws = text.lower().split()
    if not ws:
        return 0
    whole = b" ".join(ws)
    hashed = xxhash.xxh64_intdigest
    if len(ws) <= words:
        h = np.array([hashed(whole, seed)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        h = np.fromiter((hashed(whole[a:b], seed) for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist())), np.uint64, len(ws) - words + 1)
    return int(majority(h))


def majority(h: np.ndarray) -> np.uint64:
    """Bits set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 8192):
        some = h[k : k + 8192]
        counts += np.unpackbits(some.astype("<u8").view(np.uint8).reshape(len(some), 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0]


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and fp, the fingerprint as a long."""

    def make(rows: dict) -> dict:
        return {"doc_id": rows["doc_id"], "fp": pa.array(np.array([fingerprint(t, words, seed) for t in rows["text"]], np.uint64).view(np.int64))}

    return mapped(picked(docs), make, "doc_id long, fp long")


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The syndrome of each 15-bit word; the flip that leads to the nearest code word; for each syndrome the flips of two bits that lead to one."""
    x = np.arange(1 << CODE)
    syndrome = np.zeros(1 << CODE, np.int64)
    for k in range(CODE):
        syndrome ^= np.where(x >> k & 1, k + 1, 0)
    one = np.array([0] + [1 << k for k in range(CODE)], np.int64)
    two = np.zeros((16, 7), np.int64)
    for s in range(1, 16):
        two[s] = [1 << (i - 1) | 1 << (j - 1) for i, j in combinations(range(1, 16), 2) if i ^ j == s]
    return syndrome, one, two


_SYNDROME, _ONE, _TWO = _tables()


def blocks(threshold: int) -> list[tuple[int, int]]:
    """Shift and size of each block: so many that one of them differs in at most one bit."""
    n = max(3, threshold // 2 + 1)
    if 64 // n < CODE + 1:
        raise ValueError("the covering code takes blocks of 16 bits or more: a threshold of at most 7")
    at = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def anchors(fps: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Rows of fps, anchors within the covering radius plus one, and whether they are the nearest ones."""
    for k, (shift, size) in enumerate(blocks(threshold)):
        v = ((fps >> np.uint64(shift)) & np.uint64((1 << size) - 1)).astype(np.int64) | k << 40
        s = _SYNDROME[v & ((1 << CODE) - 1)]
        near = v ^ _ONE[s]
        rest = [1 << (CODE + i) for i in range(size - CODE)]
        every, zero, other = np.arange(len(fps)), np.flatnonzero(s == 0), np.flatnonzero(s)
        yield every, near, True
        for flip in rest:
            yield every, near ^ flip, False
        for a, b in combinations(rest, 2):
            yield zero, near[zero] ^ (a | b), False
        for i in range(7):
            yield other, v[other] ^ _TWO[s[other], i], False


def _spread(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(every), 2000):
                fps = every[k : k + 2000]
                parts = list(anchors(fps, threshold))
                at = np.concatenate([i for i, _, _ in parts])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a for _, a, _ in parts])), pa.array(np.concatenate([np.full(len(i), h) for i, _, h in parts])), pa.array(fps[at].view(np.int64))], names=["anchor", "home", "fp"])

    return run


def _matrix(columns: list) -> np.ndarray:
    return np.stack([(x if isinstance(x, np.ndarray) else x.to_numpy(zero_copy_only=False)).view(np.uint64) for x in columns], 1)


def _compare(threshold: int, met):
    """Rows sorted by anchor (and tile), those at home first: what met makes of the rows that meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            starts = _starts(held)
            if len(starts) > 1:
                yield from met([x[: starts[-1]] for x in held], starts[:-1], threshold)
                held = [x[starts[-1] :] for x in held]
        if held is not None and len(held[0]):
            yield from met(held, _starts(held), threshold)

    return run


def _starts(rows: list[np.ndarray]) -> np.ndarray:
    anchor, tile = rows[0], rows[1]
    return np.concatenate([[0], np.flatnonzero((anchor[1:] != anchor[:-1]) | (tile[1:] != tile[:-1])) + 1]) if len(anchor) else np.zeros(0, np.int64)


def _meetings(home: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each row at home against its whole group, in parts."""
    ends = np.append(starts[1:], len(home))
    homes = np.add.reduceat(home.astype(np.int64), starts)
    owner = np.repeat(np.arange(len(starts)), homes)
    left = np.repeat(starts, homes) + np.arange(len(owner)) - np.repeat(np.cumsum(homes) - homes, homes)
    sizes = (ends - starts)[owner]
    done = 0
    before = np.concatenate([[0], np.cumsum(sizes)])
    while done < len(left):
        upto = max(done + 1, int(np.searchsorted(before, before[done] + AT_ONCE, "right")) - 1)
        n = sizes[done:upto]
        i = np.repeat(left[done:upto], n)
        yield i, np.repeat(starts[owner[done:upto]], n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        done = upto


def _met(rows: list[np.ndarray], starts: np.ndarray, threshold: int) -> Iterator[pa.RecordBatch]:
    """Links as one star for each component of an anchor."""
    fps = rows[3].view(np.uint64)
    label = np.arange(len(fps))
    for i, j in _meetings(rows[2].astype(bool), starts):
        near = (np.bitwise_count(fps[i] ^ fps[j]) <= threshold) & (label[i] != label[j])
        if near.any():
            label = labels(len(fps), i[near], j[near], label)
    some = np.flatnonzero(label != np.arange(len(fps)))
    yield pa.RecordBatch.from_arrays([pa.array(rows[3][some]), pa.array(rows[3][label[some]])], names=["a", "b"])


def _tiled(rows: DataFrame, full: int) -> DataFrame:
    """Rows (anchor, home, others) with a tile: 0, but for anchors of more than `full` rows, which become side x side tiles: a row at home takes a row of tiles, every row takes a column."""
    many = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > full)
    many = cut(many.select("anchor", F.ceil(F.col("n") / full).cast("int").alias("side")))
    others = [c for c in rows.columns if c not in ("anchor", "home")]
    if many.isEmpty():
        dealt = rows.withColumn("tile", F.lit(0))
    else:
        hot = rows.join(many, "anchor", "left")
        line, all_sides = F.pmod(F.xxhash64(others[0]), F.coalesce("side", F.lit(1))).cast("int"), F.sequence(F.lit(0), F.coalesce("side", F.lit(1)) - 1)
        as_home = hot.filter("home").withColumn("k", F.explode(all_sides)).withColumn("tile", line * 100_000 + F.col("k"))
        as_guest = hot.filter("side is not null or not home").withColumn("k", F.explode(all_sides)).withColumn("home", F.lit(False)).withColumn("tile", F.col("k") * 100_000 + line)
        dealt = as_home.unionByName(as_guest)
    return dealt.select("anchor", "tile", "home", *others).repartition("anchor", "tile").sortWithinPartitions("anchor", "tile", F.desc("home"), others[0])


def links(fps: DataFrame, threshold: int = 4) -> DataFrame:
    """Distinct fingerprints (fp) to links a, b that connect what chains of pairs within the threshold connect."""
    rows = fps.mapInArrow(trimmed(_spread(threshold)), "anchor long, home boolean, fp long")
    return _tiled(rows, TILE).mapInArrow(trimmed(_compare(threshold, _met)), "a long, b long")


def groups(docs: DataFrame, words: int = 4, seed: int = 42, threshold: int = 4) -> DataFrame:
    """doc_id, fp and component_id; see near_duplicates()."""
    rows = cut(fingerprints(docs, words, seed))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    found = components(links(distinct.select("fp"), threshold)).withColumnRenamed("node", "fp")
    ids = found.join(distinct, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    ids = found.join(ids, "root").select("fp", "component_id")
    ids = cut(distinct.join(ids, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "n"))
    return joined(rows, ids, "fp")


def near_duplicates(docs: DataFrame, words: int = 4, seed: int = 42, threshold: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id: the smallest doc_id that chains of links reach, itself included.

    Texts are compared with A-Z in lower case. Null and empty texts have fingerprint zero and link like any other. Rows that
    share a doc_id each keep their fingerprint; a null doc_id counts as none where the smallest is sought, and a component of
    such rows only has a null id. An empty table gives an empty one; other columns are ignored.
    """
    return groups(docs, words, seed, threshold).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(text: bytes, words: int) -> np.ndarray:
    """Distinct hashes of the runs of words of a text with A-Z in lower case, sorted; a text of fewer words is one run."""
    h = hashed(text.lower())
    return np.unique(runs(sums(h), min(words, len(h)))) if len(h) else np.zeros(0, np.uint64)


def similar(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    if min(len(a), len(b)) == 0:
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


#: Words of a wide fingerprint; how likely two texts meet whose similarity is just enough; how many of its 512 bits candidates differ in at most, 78 being the mean at a similarity of 0.8; how many of 128 bits a row and its leader do.
WIDTH, MEET, APART, CLOSE = 8, 0.96, 93, 20
#: Rows at one anchor from which it is dealt out as tiles, and up to which its rows are all compared at once; blocks that leaders are sought at.
WIDE_TILE, FEW, FIRST = 16_384, 64, 10
#: Texts that are held against one in a task, about; a family has the root of its rows over TRIED as parts, or of its bytes over PART_BYTES if that is more.
SPREAD, TRIED, PART_BYTES = 2000, 8, 1 << 20


def wide(text: bytes, words: int = 5) -> np.ndarray:
    """WIDTH words of bits set in over half the hashes of the text's different shingles, each word from another mix of the hash."""
    h = shingles(text, words)
    return np.array([majority(mixed(h + np.uint64(j))) for j in range(WIDTH)], np.uint64)


def drawn(texts: int, least: float) -> list[np.ndarray]:
    """The bits of each block for so many texts: CODE of the covering code and as many more as it takes that an anchor has some hundred texts; so many blocks that two texts of the similarity meet with the probability MEET."""
    rest = max(3, texts.bit_length() - CODE - 4)
    # The angle between two sets of this similarity, as a share of a half turn, is how often a bit differs.
    p = float(np.arccos(2 * least / (1 + least)) / np.pi)
    # One code word is nearest to both if no bit differs, or for one of eight words of any one or two.
    one = (1 - p) ** CODE + (CODE * p * (1 - p) ** (CODE - 1) + CODE * (CODE - 1) / 2 * p**2 * (1 - p) ** (CODE - 2)) / 8
    n = int(np.ceil(np.log(1 - MEET) / np.log(1 - one * (1 - p) ** rest)))
    rng = np.random.default_rng(15)
    return [rng.choice(64 * WIDTH, CODE + rest, replace=False) for _ in range(n)]


def _near(blocks: list[np.ndarray], names: list[str]):
    """Rows of fp0 ... and others (names, of which the first two words are among): each row at the nearest anchor of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced([whole]):
                fps = _matrix([batch.column(f"fp{j}") for j in range(WIDTH)])
                bits = np.unpackbits(np.ascontiguousarray(fps).astype("<u8").view(np.uint8).reshape(len(fps), 8 * WIDTH), axis=1, bitorder="little")
                at = []
                for k, places in enumerate(blocks):
                    v = bits[:, places].astype(np.int64) @ (1 << np.arange(len(places)))
                    at.append((v ^ _ONE[_SYNDROME[v & ((1 << CODE) - 1)]]) | k << 48)
                others = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(at)), *(pa.array(np.tile(x, len(blocks))) for x in others)], names=["anchor", *names])

    return run


def _leaders(apart: int):
    """Rows (anchor, home, node, fp0, fp1) sorted by anchor: a leader, the first that is left, takes all rows within `apart` of it, as links from these to it."""

    def met(rows: list[np.ndarray], starts: np.ndarray, _: int) -> Iterator[pa.RecordBatch]:
        node, fps = rows[3], _matrix(rows[4:6])
        a, b = [], []
        ends = np.append(starts[1:], len(node))
        small = ends - starts <= FEW
        flags = np.ones(len(node), bool)
        keep = np.repeat(small & (ends - starts > 1), ends - starts)
        if keep.any():
            at = np.flatnonzero(keep)
            some = np.flatnonzero(np.append(True, rows[0][at][1:] != rows[0][at][:-1]) | np.append(True, rows[1][at][1:] != rows[1][at][:-1]))
            for i, j in _meetings(flags[: len(at)], some):
                i, j = at[i], at[j]
                near = (j < i) & (np.bitwise_count(fps[i] ^ fps[j]).sum(1, dtype=np.int16) <= apart)
                i, j = i[near], j[near]
                # The first row within reach is each row's leader.
                first = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else i
                a.append(node[i[first]])
                b.append(node[j[first]])
        for s, e in zip(starts[~small].tolist(), ends[~small].tolist()):
            left = np.arange(s, e)
            while len(left) > 1:
                near = np.bitwise_count(fps[left] ^ fps[left[0]]).sum(1, dtype=np.int16) <= apart
                taken = left[near][1:]
                a.append(node[taken])
                b.append(np.full(len(taken), node[left[0]]))
                left = left[~near]
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return met


def _across(rows: list[np.ndarray], starts: np.ndarray, apart: int) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, tile, home, node, label, fp0, ...): each node within `apart` of one with another label, with its own label and one label for all that chains of such pairs connect here."""
    home, node, label, fps = rows[2].astype(bool), rows[3], rows[4], _matrix(rows[5:])
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def pairs(i: np.ndarray, j: np.ndarray) -> None:
        near = (label[i] != label[j]) & (np.bitwise_count(fps[i] ^ fps[j]).sum(1, dtype=np.int16) <= apart)
        if near.any():
            held.append((i[near], j[near]))
            if sum(len(x) for x, _ in held) > AT_ONCE:
                held[:] = [forest(*map(np.concatenate, zip(*held)))]

    ends = np.append(starts[1:], len(node))
    size = ends - starts
    few = np.repeat((size <= FEW) & (size > 1), size)
    if few.any():
        at = np.flatnonzero(few)
        new = np.append(True, (rows[0][at][1:] != rows[0][at][:-1]) | (rows[1][at][1:] != rows[1][at][:-1]))
        for i, j in _meetings(home[at], np.flatnonzero(new)):
            pairs(at[i], at[j])
    for s, e in zip(starts[size > FEW].tolist(), ends[size > FEW].tolist()):
        # By label: rows of one are compared with those of the others only.
        by = s + np.argsort(label[s:e], kind="stable")
        new = np.flatnonzero(np.append(True, label[by][1:] != label[by][:-1]))
        for a, b in zip(new.tolist(), np.append(new[1:], len(by)).tolist()):
            own, others = by[a:b][home[by[a:b]]], np.concatenate([by[:a], by[b:]])
            step = max(1, AT_ONCE // max(1, len(others)))
            for k in range(0, len(own) if len(others) else 0, step):
                some = own[k : k + step]
                pairs(np.repeat(some, len(others)), np.tile(others, len(some)))
    if held:
        some, root = forest(*map(np.concatenate, zip(*held)))
        some, root = np.concatenate([some, np.unique(root)]), np.concatenate([root, np.unique(root)])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[some], label[some], label[root])], names=["node", "label", "met"])


def _kin(words: int, least: float, apart: int):
    """Rows (family, tile, first, second, node, label, text, fp0, ...) sorted by family and tile: of the pairs of one of the first with one of the second that have different labels and lie within `apart`, those whose sets reach the similarity, as links; what these connect is not compared any more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for row in zip(*(x.to_pylist() for x in batch.columns)):
                if row[:2] != last:
                    out += linked(held)
                    last, held = row[:2], []
                held.append(row[2:])
            yield made(out)
        yield made(linked(held))

    def made(out: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    def linked(rows: list[tuple]) -> list[tuple[int, int]]:
        if len(rows) < 2:
            return []
        first, second = (np.flatnonzero([r[k] for r in rows]) for k in (0, 1))
        node = [r[2] for r in rows]
        label = np.unique(np.array([r[3] for r in rows], np.int64), return_inverse=True)[1]
        fps = np.array([r[5:] for r in rows], np.int64).view(np.uint64)
        sets = [shingles(r[4], words) for r in rows]
        size = np.array([len(x) for x in sets], np.int64)
        end = np.cumsum(size)
        known, run = np.unique(np.concatenate(sets), return_inverse=True)
        mine = np.zeros(len(known), bool)
        out = []
        for i in first.tolist():
            j = second[label[second] != label[i]]
            j = j[np.bitwise_count(fps[j] ^ fps[i]).sum(1, dtype=np.int16) <= apart]
            own = run[end[i] - size[i] : end[i]]
            mine[own] = True
            # So many at once that their runs of words are a bounded number.
            for part in np.split(j, np.flatnonzero(np.diff(np.cumsum(size[j]) // AT_ONCE)) + 1):
                n = size[part]
                upto = np.append(0, np.cumsum(n))
                at = np.arange(upto[-1]) + np.repeat(end[part] - n - upto[:-1], n)
                both = np.diff(np.append(0, np.cumsum(mine[run[at]]))[upto])
                every = n + size[i] - both
                for k in part[both / np.maximum(every, 1) >= np.where(every == 0, 0, least)].tolist():
                    if label[k] != label[i]:
                        out.append((node[i], node[k]))
                        label[label == label[k]] = label[i]
            mine[own] = False
        return out

    return run


def _families(met: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Nodes as _across() gives them, with nodes (node, fp0, ...) and texts: (family, tile, first, second, node, label, text, fp0, ...), where all that meet are one family.

    Large families, in rows or bytes, are dealt out by node: a tile takes two of its parts, or one twice, so a part goes to as many tiles as there are parts, of which there are about the square root of the rows.
    """
    columns = [f"fp{j}" for j in range(WIDTH)]
    met = cut(met.distinct())
    found = components(met.select(F.col("label").alias("a"), F.col("met").alias("b"))).select(F.col("node").alias("label"), F.col("root").alias("family"))
    asked = cut(met.select("node", "label").distinct())
    of = cut(asked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(found, "label"))
    kin = joined(asked, of, "label").join(_texts(asked.select("node"), rows), "node").join(nodes.select("node", *columns), "node")
    kin = cut(kin.select("family", "node", "label", "text", *columns))
    sides = kin.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    sides = cut(sides.select("family", "n", F.ceil(F.greatest(F.sqrt("n") / TRIED, F.sqrt(F.col("bytes") / PART_BYTES))).cast("int").alias("side")))
    dealt = joined(kin, sides, "family").withColumn("part", F.pmod(F.xxhash64("node"), "side").cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("side") - 1)))
    one, other = F.greatest("part", "k"), F.least("part", "k")
    dealt = dealt.select("family", (one * 100_000 + other).alias("tile"), (F.col("part") == one).alias("first"), (F.col("part") == other).alias("second"), "node", "label", "text", *columns)
    return dealt.repartition("family", "tile").sortWithinPartitions("family", "tile", "node")


def _alike(words: int, least: float):
    """Rows node, text, others (of node and text): the pairs whose shingle sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[int, np.ndarray] = {}
            keep = []
            for k, (node, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                mine = None
                for other in batch.column(2)[k]:
                    its = other["node"].as_py()
                    if its == node:
                        continue
                    if its not in known:
                        known[its] = shingles(other["text"].as_py(), words)
                    if mine is None:
                        mine = shingles(text.as_py(), words)
                    if similar(mine, known[its]) >= least:
                        keep.append((its, node))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in keep], pa.int64()), pa.array([b for _, b in keep], pa.int64())], names=["a", "b"])

    return run


def _texts(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """node and text of the nodes asked for, once each; only texts that a filter lets through move."""
    has = copies.member(rows.sparkSession, bloom.build(asked, asked.count()))
    return rows.filter(has("node")).select("node", "text").groupBy("node").agg(F.first("text").alias("text"))


def _pairs(pairs: DataFrame, rows: DataFrame, words: int, least: float) -> DataFrame:
    """Of the pairs a, b of nodes, those whose texts reach the similarity."""
    pairs = cut(pairs.select("a", "b"))
    texts = cut(_texts(cut(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()), rows))
    side = cut(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")))
    # A text of very many pairs goes to its partners; those of another one come together where it is.
    left = texts.select(F.col("node").alias("a"), F.struct("node", "text").alias("one")).join(side, "a").withColumn("salt", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / SPREAD).cast("int")))).drop("n")
    right = joined(pairs, side.withColumn("side", F.floor(F.col("n") / SPREAD).cast("int") + 1), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("side")).cast("int").alias("salt"))
    right = right.join(texts.select(F.col("node").alias("b"), "text"), "b")
    both = right.join(left, ["a", "salt"]).select(F.col("b").alias("node"), "text", F.array("one").alias("others"))
    return cut(both.mapInArrow(trimmed(_alike(words, least)), "a long, b long"))


def alike(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id and component_id, of links between texts whose sets of runs of words have a Jaccard similarity of `least`.

    At the anchors of the first blocks, a row within CLOSE goes to one leader, with which it is verified. What meets within APART
    at any anchor, and is still apart, makes families. A family's texts come together, and its pairs within APART are verified
    where they are, but for those that verified links connect: no pair is a row.
    """
    columns = [f"fp{j}" for j in range(WIDTH)]
    rows = picked(docs).withColumn("node", F.xxhash64("text"))

    def make(held: dict) -> dict:
        fps = _stacked([wide(t, words) for t in held["text"]])
        return {"doc_id": held["doc_id"], "node": held["node"]} | {c: pa.array(np.ascontiguousarray(fps[:, j]).view(np.int64)) for j, c in enumerate(columns)}

    ids = cut(mapped(rows, make, ", ".join(["doc_id long, node long", *(f"{c} long" for c in columns)])))
    distinct = cut(ids.groupBy("node", *columns).agg(F.min("doc_id").alias("least")))
    blocks = drawn(distinct.count(), least)

    def dealt(table: DataFrame, blocks: list[np.ndarray], names: list[str]) -> DataFrame:
        return table.mapInArrow(trimmed(_near(blocks, names)), ", ".join(["anchor long", *(f"{n} long" for n in names)])).withColumn("home", F.lit(True)).select("anchor", "home", *names)

    led = _salted(dealt(distinct, blocks[:FIRST], ["node", "fp0", "fp1"])).mapInArrow(trimmed(_compare(0, _leaders(CLOSE))), "a long, b long")
    links = _pairs(led.select(F.col("b").alias("a"), F.col("a").alias("b")).distinct(), rows, words, least)
    found = components(links)
    labelled = cut(distinct.join(found.withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node")))
    met = cut(_tiled(dealt(labelled, blocks, ["node", "label", *columns]), WIDE_TILE).mapInArrow(trimmed(_compare(APART, _across)), "node long, label long, met long"))
    if not met.isEmpty():
        links = links.union(cut(_families(met, distinct, rows).mapInArrow(trimmed(_kin(words, least, APART)), "a long, b long")))
        found = components(links)
    roots = found.join(distinct.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("component_id"))
    named_ids = found.join(roots, "root").select("node", "component_id")
    return ids.select("doc_id", "node").join(distinct.select("node", "least").join(named_ids, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id")), "node").select("doc_id", "component_id")


def _stacked(fps: list[np.ndarray]) -> np.ndarray:
    return np.stack(fps) if fps else np.zeros((0, WIDTH), np.uint64)


def _salted(rows: DataFrame) -> DataFrame:
    """Rows (anchor, home, node, fp0, fp1) sorted by anchor and tile. Anchors of more than WIDE_TILE rows are dealt out by node; some of their rows, one for each of eight classes of nodes, come first in every tile, so that the same leaders take most rows of all."""
    many = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > WIDE_TILE)
    many = cut(many.select("anchor", F.ceil(F.col("n") / WIDE_TILE).cast("int").alias("side")))
    if many.isEmpty():
        dealt = rows.withColumn("tile", F.lit(0))
    else:
        hot = rows.join(many, "anchor", "left")
        own = hot.withColumn("tile", F.pmod(F.xxhash64("node"), F.coalesce("side", F.lit(1))).cast("int"))
        some = hot.filter("side is not null").groupBy("anchor", "side", F.pmod("node", F.lit(8))).agg(F.min(F.struct("node", "fp0", "fp1")).alias("x"))
        some = some.select("anchor", F.lit(False).alias("home"), "x.*", F.explode(F.sequence(F.lit(0), F.col("side") - 1)).alias("tile"))
        dealt = own.select("anchor", "home", "node", "fp0", "fp1", "tile").unionByName(some)
    return dealt.select("anchor", "tile", "home", "node", "fp0", "fp1").repartition("anchor", "tile").sortWithinPartitions("anchor", "tile", "home", "node")


def one_of_each(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """The rows whose doc_id is the smallest of their group, with all their columns; so are those of groups without id.

    Groups are those of alike(): by default of links between texts whose sets of five-word runs have a Jaccard similarity of 0.8.
    Rows of one doc_id are kept if any of them would be. Texts without words are no copies of each other here: they stay.
    """
    empty = F.length(F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", "")) == 0
    found = alike(docs.filter(~empty).select("doc_id", "text"), words, least)
    gone = cut(found.groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays")).filter("not stays").select(F.col("doc_id").alias(OWN)))
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(OWN), "left_anti")
