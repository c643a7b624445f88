"""Jaccard join of n-gram sets by PartEnum signatures, and the components of its links.

Two sets are linked if ``100 * |A and B| >= percent * |A or B|``. Sizes fall into bands; linked sets
are in one band or in neighbouring ones, so each set signs for its band and the next. Within such
an instance linked sets differ in at most k elements. The domain of elements is partitioned (by
hash) into n1 parts of n2 parts each. With n1 > k // (k2 + 1) some first-level part differs in at
most k2 elements, so at most k2 of its second-level parts differ, and the sets agree on one of the
subsets of n2 - k2 of them. A signature stands for one subset; linked sets share one.

Signatures over no element would bring together unrelated sets. n1 is therefore a little larger than
needed, and sets below the largest size of their instance have room besides, since they differ from
others in fewer elements. A set with no more first-level parts that have an empty subset than it has
parts to spare keeps these to itself, and still shares a signature over elements with every set that
it is linked to.

Steps, none of which holds a group of documents in one task:

1. texts are merged if equal, partly before the shuffle, and written once with an id;
2. one pass over the texts makes signatures; one sort by signature keeps those of two texts or more;
3. each bucket of a signature has a centre, the text that shares most signatures with others. The
   members of all buckets of a centre are its group. Relatives well below the threshold share
   signatures too, so members first meet as sketches, a bit for each of some cells of the domain:
   whether the set has an odd number of elements there. Sets differ in at least as many elements as
   their sketches in bits, so a member whose sketch is too far from all others is linked to none and
   leaves the group, its text unread. Groups of over SKETCHED members meet in pairs of tiles, and
   those beyond TILES tiles stay whole. The members left are compared to the centre, and measured
   against a reference set: what most of a few members hold;
4. what a group has in common is now set aside. With D(x) the difference of x and the reference,
   x and y differ in |D(x)| + |D(y)| - 2 |D(x) and D(y)| elements. So the member nearest to the
   reference is linked to all that differ little from it, and any other linked pair has to share
   t elements of D. In any fixed order of D (here rare elements first) one of them is among the
   first |D| - t + 1 of both: a key far rarer than a signature, since copies that were changed
   independently have different changes. Sketches meet once more before that, as the links found
   so far leave most members without a partner in another component; these have no entries. Entries
   that no partner in their bucket can use go, by the sizes of D;
5. buckets with few texts outside the group's main component are compared, those to the others;
   the rest are buckets for step 3 again, with the bound on "few" doubled, so that this ends.

Comparisons are of the whole sets. Elements are 64-bit hashes. A pair of different components that
no step compares is proved not to be linked, so no link is lost.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, filtered_early

#: Texts of other components that a bucket may hold to be compared at once; doubled every round.
FAN = 8
#: Members of a group that vote on its reference, and members that are measured in one place.
VOTERS, TOGETHER = 8, 256
#: Members of a group whose sketches all meet in one place, and tiles of half as many that a larger group may be cut
#: into, to meet two by two.
SKETCHED, TILES = 1024, 8
_MASK = (1 << 64) - 1


class _Words(dict):
    """64-bit hashes of words, a bounded number of them remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_words = _Words()


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """The finaliser of splitmix64, on x moved by the seed."""
    x = x + np.uint64(seed * 0x9E3779B97F4A7C15 & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, size: int) -> np.ndarray:
    """The set of ``size``-word shingles as sorted hashes: A-Z lower-cased, cut at ASCII white space.

    Fewer words than that are one shingle; no word, none.
    """
    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    return np.unique(shingle_sequence(words, min(size, n)))


def shingle_sequence(words: list[bytes], size: int) -> np.ndarray:
    """Hashes of the ``size``-word shingles in order; there are at least so many words."""
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(words) - size + 1
    found = np.full(n, size, np.uint64)
    for k in range(size):
        found = found * np.uint64(0xD6E8FEB86659FD93) + hashes[k : n + k]
        found ^= found >> np.uint64(32)
    return _mix(found, size)


class PartEnum:
    """Signatures of sets for one threshold."""

    def __init__(self, percent: int):
        self.percent = percent
        self.lows, self._shapes = [1], {}
        while self.lows[-1] < 1 << 40:
            self.lows.append(self.lows[-1] * 100 // percent + 1)

    def differ(self, a: int, b: int) -> int:
        """The most elements in which linked sets of these sizes differ."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def shape(self, instance: int) -> tuple[int, int, int]:
        """(n1, n2, k2) of the instance for pairs whose larger set is in that band."""
        if instance not in self._shapes:
            self._shapes[instance] = self._shape(instance)
        return self._shapes[instance]

    def _shape(self, instance: int) -> tuple[int, int, int]:
        most = self.lows[instance + 1] - 1
        k = self.differ(most, most)
        if k == 0:
            return 1, 1, 0
        if k <= 4:
            return 1, k + 3, k
        n1 = k // 2 + 1
        for _ in range(4):  # the parts with an empty subset that a large set has by chance, and three deviations more
            mean = 3 * n1 * math.exp(-2 * most / (3 * n1))
            n1 = k // 2 + 1 + min(k // 2, math.ceil(mean + 3 * math.sqrt(mean) + 1))
        return n1, 3, 1

    def signatures(self, elements: np.ndarray) -> np.ndarray:
        if not len(elements):
            return np.zeros(0, np.uint64)
        size = len(elements)
        band = bisect_right(self.lows, size) - 1
        place, value = _mix(elements, 1), _mix(elements, 2)
        found = []
        for instance in (band, band + 1):
            n1, n2, k2 = self.shape(instance)
            # parts that agree with any linked set, beyond the first
            spare = n1 - 1 - self.differ(size, min(self.lows[instance + 1] - 1, size * 100 // self.percent)) // (k2 + 1)
            first = place % np.uint64(n1)
            part = (first * np.uint64(n2) + (place >> np.uint64(40)) % np.uint64(n2)).astype(np.int64)
            sums = np.zeros(n1 * n2, np.uint64)
            np.add.at(sums, part, value)
            sums, held = sums.reshape(n1, n2), np.bincount(part, minlength=n1 * n2).reshape(n1, n2)
            if k2 == 1:  # all but one part: the whole less that part
                sums, held = sums.sum(axis=1, dtype=np.uint64)[:, None] - sums, held.sum(axis=1)[:, None] - held
            else:
                subsets = [list(c) for c in combinations(range(n2), n2 - k2)]
                sums = np.stack([sums[:, c].sum(axis=1, dtype=np.uint64) for c in subsets], axis=1)
                held = np.stack([held[:, c].sum(axis=1) for c in subsets], axis=1)
            full = held > 0
            names = np.arange(sums.size, dtype=np.uint64).reshape(sums.shape) + np.uint64((instance + 1) << 40)
            signed = _mix(sums ^ _mix(names, 3), 4)
            found.append(signed[full] if int((~full).any(axis=1).sum()) <= spare else signed.reshape(-1))
        return np.concatenate(found)


@lru_cache(maxsize=4)
def part_enum(percent: int) -> PartEnum:
    return PartEnum(percent)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def sketch(elements: np.ndarray, percent: int) -> np.ndarray:
    """A bit for each of 2^j cells of the domain, at least 64 and 8 times the elements in which linked sets of this
    size differ: whether the set has an odd number of elements there. Cells of a shorter sketch are unions of these."""
    n = len(elements)
    cells = 64
    while cells < 8 * (2 * n * (100 - percent) // (100 + percent)):
        cells *= 2
    odd = np.bincount((_mix(elements, 5) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches (a row each) as they are with 64 * ``words`` cells."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def with_partner(sizes: np.ndarray, sketches: list[np.ndarray], comps: np.ndarray, percent: int) -> np.ndarray:
    """Which of some sets may, by sizes and sketches, be linked to another of them in another component."""
    kept = np.zeros(len(sizes), bool)
    words = np.array([len(s) for s in sketches])
    for w in np.unique(words):
        at = np.flatnonzero(words >= w)
        seen = np.concatenate([folded(np.stack([sketches[k] for k in at[words[at] == v]]), w) for v in np.unique(words[at])])
        at = np.concatenate([at[words[at] == v] for v in np.unique(words[at])])
        n, comp = sizes[at], comps[at]
        for k in range(int((words == w).sum())):  # those with sketches of just this length come first
            near = (comp != comp[k]) & (100 * np.minimum(n, n[k]) >= percent * np.maximum(n, n[k]))
            near[:k] = False
            near = np.flatnonzero(near)
            if not len(near):
                continue
            apart = np.bitwise_count(seen[near] ^ seen[k]).sum(axis=1, dtype=np.int64)
            near = near[apart <= (n[near] + n[k]) * (100 - percent) // (100 + percent)]
            if len(near):
                kept[at[k]] = True
                kept[at[near]] = True
    return kept


def _sketch(size: int, percent: int) -> Callable:
    """(id, t) -> (id, n, s): the size and the sketch of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = [], []
            for text in batch.column("t"):
                elements = shingles(text.as_py(), size)
                sizes.append(len(elements))
                found.append(sketch(elements, percent).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(found, pa.binary())], ["id", "n", "s"])

    return run


def _partnered(percent: int) -> Callable:
    """Rows (g, c, id, comp, n, s) in order of g -> (c, id) of rows that :func:`with_partner` finds among those of their g."""

    def of(table: pa.Table) -> Iterator[pa.RecordBatch]:
        c = table.column("g").to_numpy()
        ends = [0, *(np.flatnonzero(c[1:] != c[:-1]) + 1), len(c)]
        sizes, comps = table.column("n").to_numpy(), table.column("comp").to_numpy()
        sketches = [np.frombuffer(s, np.uint64) for s in table.column("s").to_pylist()]
        kept = [with_partner(sizes[i:j], sketches[i:j], comps[i:j], percent) for i, j in zip(ends, ends[1:], strict=False)]
        yield from table.select(["c", "id"]).filter(pa.array(np.concatenate(kept))).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the group whose end is still to come
        for batch in batches:
            if not batch.num_rows:
                continue
            c = batch.column("g").to_numpy()
            last = int(np.searchsorted(c, c[-1]))  # where the batch's last group begins
            if last or (held and held[-1].column("g")[-1].as_py() != c[0]):
                done = pa.Table.from_batches([*held, batch.slice(0, last)])
                held = [batch.slice(last)]
                if done.num_rows:
                    yield from of(done)
            else:
                held.append(batch)
        if held:
            yield from of(pa.Table.from_batches(held))

    return run


def _sign(size: int, percent: int) -> Callable:
    """(id, t) -> rows (key, id, n): signatures with n null, and one row per text with the size of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enum = part_enum(percent)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                some = batch.slice(at, 128)
                keys, ids, sizes = [], [], []
                own = some.column("id").to_numpy()
                for i, text in zip(own, some.column("t").to_pylist(), strict=True):
                    elements = shingles(text, size)
                    keys.append(enum.signatures(elements))
                    ids.append(np.full(len(keys[-1]), i, np.int64))
                    sizes.append(len(elements))
                n = sum(map(len, keys))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([*keys, _mix(own.view(np.uint64), 6)]).view(np.int64)),
                    pa.array(np.concatenate([*ids, own])),
                    pa.array(np.concatenate([np.zeros(n, np.int64), np.array(sizes, np.int64)]), mask=np.arange(n + len(own)) < n),
                ], ["key", "id", "n"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of key, those about texts, and the signatures that a neighbour has as well."""
    names = ["key", "id", "n"]
    last: tuple[int, int, bool] | None = None  # a signature whose next neighbour is still to come, and if it is shared
    for batch in batches:
        is_text = batch.column("n").is_valid().to_numpy(zero_copy_only=False)
        key, i = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "id"))
        k, j = key[~is_text], i[~is_text]
        if last is not None:
            k, j = np.append(np.int64(last[0]), k), np.append(np.int64(last[1]), j)
        same = k[1:] == k[:-1]
        keep = np.zeros(len(k), bool)
        keep[1:] |= same
        keep[:-1] |= same
        if last is not None and last[2]:
            keep[0] = True
        if len(k):
            last, k, j, keep = (int(k[-1]), int(j[-1]), bool(keep[-1])), k[:-1], j[:-1], keep[:-1]
        k, j = k[keep], j[keep]
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(j), pa.nulls(len(k), pa.int64())], names)
        yield batch.filter(pa.array(is_text)).select(names)
    if last is not None and last[2]:
        yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int64()), pa.nulls(1, pa.int64())], names)


def _vote(size: int) -> Callable:
    """The reference of a group from its voters (c, t), at most VOTERS and the centre: e, the elements of two or
    more of them, and r, how unusual a set is that differs there. Negative r: most hold the element."""

    def run(voters: pa.Table) -> pa.Table:
        found, count = np.unique(np.concatenate([shingles(t, size) for t in voters.column("t").to_pylist()]), return_counts=True)
        found, count = found[count > 1], count[count > 1]
        most = 2 * count > voters.num_rows
        rank = np.where(most, count - voters.num_rows - 1, count).astype(np.int8)
        return pa.table({"c": voters.column("c")[:1], "e": pa.array([found.tobytes()], pa.binary()), "r": pa.array([rank.tobytes()], pa.binary())})

    return run


def _measure(size: int, percent: int) -> Callable:
    """Rows in order of (c, part, id): first the centre's text t and its reference (e, r), id null, then members with theirs.

    -> (c, id, linked, d, a, p): whether the centre is linked, d = |D|, a the slack of :func:`_links`, and as many
    elements of D, in order, as any partner can ask for.
    """
    q = 100 + percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = common = seen = rank = None
        for batch in batches:
            out = {c: [] for c in ("c", "id", "linked", "d", "a", "p")}
            c, ids = batch.column("c").to_pylist(), batch.column("id").to_pylist()
            texts, e, r = (batch.column(x) for x in "ter")
            for k, i in enumerate(ids):
                own = shingles(texts[k].as_py(), size)
                if i is None:
                    centre = own
                    if e[k].is_valid:
                        seen, rank = np.frombuffer(e[k].as_py(), np.uint64), np.frombuffer(r[k].as_py(), np.int8).astype(np.int16)
                        common = seen[rank < 0]
                    else:
                        seen, rank, common = centre, np.full(len(centre), -2, np.int16), centre
                    continue
                differ = np.setxor1d(own, common, assume_unique=True)
                at = np.searchsorted(seen, differ)
                at[at == len(seen)] = 0
                known = seen[at] == differ if len(seen) else np.zeros(len(differ), bool)
                rare = np.where(known, np.abs(rank[at]), 0) if len(seen) else np.zeros(len(differ), np.int16)
                n, d = len(own), len(differ)
                slack = n * (100 - percent) - d * q
                # no partner has more slack than this, or it would be too small or too large
                most = n * (100 - percent) * (percent + 200) // percent + 1 - d * q
                first = d - max(1, -((slack + most) // (2 * q))) + 1
                order = np.lexsort((differ, rare))[: max(first, 0)]
                out["c"].append(c[k])
                out["id"].append(i)
                out["linked"].append(linked(centre, own, percent))
                out["d"].append(d)
                out["a"].append(slack)
                out["p"].append((differ[order] >> np.uint64(32)).astype(np.uint32).view(np.int32))
            types = {"c": pa.int64(), "id": pa.int64(), "linked": pa.bool_(), "d": pa.int64(), "a": pa.int64(), "p": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([pa.array(out[x], t) for x, t in types.items()], list(types))

    return run


def _compare(size: int, percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ta, tb = batch.column("ta"), batch.column("tb")
            kept = [linked(shingles(ta[k].as_py(), size), shingles(tb[k].as_py(), size), percent) for k in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return run


class _Components:
    """Labels of texts that links have joined, kept as a table; a text that is not in it is its own."""

    def __init__(self, scratch: Scratch):
        self._scratch = scratch
        self.labels = scratch.cut(scratch.spark.range(0).select("id", F.col("id").alias("label")), "labels")

    def of(self, df: DataFrame, column: str, name: str) -> DataFrame:
        labels = self.labels.select(F.col("id").alias(column), F.col("label").alias(name))
        return df.join(labels, column, "left").withColumn(name, F.coalesce(name, column))

    def add(self, links: DataFrame) -> None:
        """Merge along links by contraction: each label moves to the neighbour that is first in a
        random order of the round, until no link is left between labels."""
        fresh = links.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(self.labels, "id", "left_anti")
        labels = self.labels.unionByName(fresh.withColumn("label", F.col("id")))
        ends = self.of(self.of(links.select("a", "b"), "a", "u"), "b", "v")
        edges = self._scratch.cut(ends.where("u <> v").select("u", "v").distinct(), "edges")
        turn = 0
        while not edges.isEmpty():
            turn += 1
            rank = lambda c: F.xxhash64(F.col(c), F.lit(turn))  # noqa: E731, B023
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            best = both.groupBy("u").agg(F.min_by("v", rank("v")).alias("v"), F.min(rank("v")).alias("r"))
            steps = self._scratch.cut(best.where(F.col("r") < rank("u")).select("u", F.col("v").alias("to")), "steps")

            def move(df: DataFrame, column: str, steps=steps) -> DataFrame:
                return df.join(steps.withColumnRenamed("u", column), column, "left").withColumn(column, F.coalesce("to", column)).drop("to")

            labels = move(labels, "label")
            edges = self._scratch.cut(move(move(edges, "u"), "v").where("u <> v").distinct(), "edges")
        self.labels = self._scratch.cut(labels, "labels")


def _digest(text_col: str) -> Column:
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)


def _links(texts: DataFrame, size: int, percent: int, scratch: Scratch, fan: int) -> tuple[DataFrame, DataFrame]:
    """(about: id, n of each text), (labels: id, label of the linked ones) of ``texts`` (id, t), which are written.

    Slack is counted in units of 1 / (100 + percent): a(x) = |x| (100 - percent) - |D(x)| (100 + percent). Texts
    with a(x) + a(y) >= 0 are linked, and others need -(a(x) + a(y)) / 2 common elements of D to be.
    """
    q = 100 + percent
    schema = "key long, id long, n long"
    signed = scratch.cut(
        texts.select("id", "t").mapInArrow(_sign(size, percent), schema).repartition("key").sortWithinPartitions("key").mapInArrow(_shared, schema),
        "signed",
    )
    about = signed.where("n is not null").select("id", "n")
    buckets = signed.where("n is null").select("key", "id")
    counts = scratch.cut(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("m")), "counts")
    weights = scratch.cut(buckets.join(counts, "key").groupBy("id").agg(F.sum(F.col("m") - 1).alias("w")), "weights")
    with filtered_early(texts.sparkSession):
        texts = scratch.cut(texts.join(weights.where("w > 0").select("id"), "id", "left_semi").select("id", "t"), "held")
    active = scratch.cut(buckets.join(weights, "id").select("key", "id", "w"), "active")
    sketches = scratch.cut(texts.mapInArrow(_sketch(size, percent), "id long, n long, s binary"), "sketches")
    components = _Components(scratch)
    while not active.isEmpty():
        # of equal weights the same text everywhere, so that buckets share their centres
        order = F.struct("w", F.xxhash64("id").alias("x"))
        centres = scratch.cut(active.groupBy("key").agg(F.max_by("id", order).alias("c")), "centres")
        wide = scratch.cut(active.join(centres, "key").select("c", "id").distinct(), "groups")
        groups = _narrowed(wide, sketches, components, percent, scratch)
        with filtered_early(texts.sparkSession):
            needed = groups.select("id").union(groups.select(F.col("c").alias("id"))).distinct()
            texts, all_texts = scratch.cut(texts.join(needed, "id", "left_semi").select("id", "t"), "held"), texts
        measured = _measured(groups, texts, size, percent, scratch)
        nearest = scratch.cut(measured.groupBy("c").agg(F.max_by("id", F.struct("a", "id")).alias("near"), F.max("a").alias("top")), "nearest")
        star = measured.where("linked and id <> c").select(F.col("c").alias("a"), F.col("id").alias("b"))
        sure = measured.join(nearest, "c").where("a + top >= 0 and id <> near").select(F.col("near").alias("a"), F.col("id").alias("b"))
        components.add(scratch.cut(star.unionByName(sure).distinct(), "links"))

        main = components.of(nearest, "near", "main").select("c", "top", "main")
        members = components.of(measured.select("c", "id", "d", "a", "p").join(main, "c"), "id", "comp").withColumn("other", F.col("comp") != F.col("main"))
        members = scratch.cut(members.drop("main"), "members")  # read again, so that sums over a group combine before they are shuffled
        several = scratch.cut(members.where("other").select("c").distinct(), "several")
        apart = _narrowed(members.join(several, "c").select("c", "id"), sketches, components, percent, scratch)
        members, all_members = scratch.cut(members.join(apart, ["c", "id"]), "members"), members
        others = scratch.cut(members.where("other").groupBy("c").agg(F.max("a").alias("top_other")), "others")
        entries = scratch.cut(_entries(members.join(others, "c"), percent), "entries")
        shared = _mixed(entries, scratch)
        live = _live(shared, scratch)
        fewer = _live(live, scratch)
        many = F.col("others") > fan
        pairs = scratch.cut(_pairs(fewer.where(~many)), "pairs")
        one, two = (texts.select(F.col("id").alias(x), F.col("t").alias(f"t{x}")) for x in "ab")
        found = pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(_compare(size, percent), "a long, b long")
        components.add(scratch.cut(found, "links"))

        rest = components.of(fewer.where(many).select("key", "id", (F.col("side") != _MAIN).cast("long").alias("w")).distinct(), "id", "comp")
        mixed = scratch.cut(rest.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key"), "mixed")
        done = (active, centres, wide, groups, all_texts, measured, nearest, all_members, several, apart, members, others, entries, shared, live, fewer, pairs, mixed)
        active = scratch.cut(rest.drop("comp").join(mixed, "key", "left_semi"), "active")
        scratch.free(*done)
        fan *= 2
    return about, components.labels


def _narrowed(groups: DataFrame, sketches: DataFrame, components: _Components, percent: int, scratch: Scratch) -> DataFrame:
    """Members (c, id) of groups that may have a linked partner in their group, in another component as yet.

    Sketches of a group of over SKETCHED members meet in pairs of tiles, each member in at most TILES - 1 of them;
    groups too large for TILES tiles are returned whole."""
    sizes = scratch.cut(groups.groupBy("c").agg(F.count(F.lit(1)).alias("m")), "sizes")
    groups = groups.join(sizes, "c").withColumn("tiles", F.when(F.col("m") <= SKETCHED, 1).otherwise(F.ceil(2 * F.col("m") / SKETCHED)))
    met = components.of(groups.where(F.col("tiles") <= TILES).select("c", "id", "tiles"), "id", "comp").join(sketches, "id")
    tile = F.pmod(F.xxhash64("id", F.lit(3)), F.col("tiles"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda k: (k != tile) | (F.col("tiles") == 1))
    met = met.select("c", "id", "comp", "n", "s", tile.alias("tile"), F.explode(others).alias("with"))
    met = met.select(F.xxhash64("c", F.least("tile", "with"), F.greatest("tile", "with")).alias("g"), "c", "id", "comp", "n", "s")
    met = met.repartition("g").sortWithinPartitions("g").mapInArrow(_partnered(percent), "c long, id long").distinct()
    return scratch.cut(groups.where(F.col("tiles") > TILES).select("c", "id").unionByName(met), "narrowed")


def _measured(groups: DataFrame, texts: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """:func:`_measure` of every member of every group (c, id); groups are dealt out in parts."""
    sizes = scratch.cut(groups.groupBy("c").agg(F.count(F.lit(1)).alias("m")), "sizes")
    slot = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(VOTERS))
    voters = groups.join(sizes.where("m > 2").select("c"), "c").groupBy("c", slot.alias("slot")).agg(F.min("id").alias("id")).select("c", "id")
    voters = voters.unionByName(sizes.where("m > 2").select("c", F.col("c").alias("id"))).distinct()
    votes = voters.join(texts, "id").select("c", "t").groupBy("c").applyInArrow(_vote(size), "c long, e binary, r binary")
    votes = scratch.cut(votes, "votes")
    parts = F.ceil(F.col("m") / TOGETHER)
    centres = sizes.join(texts.withColumnRenamed("id", "c"), "c").join(votes, "c", "left")
    centres = centres.select("c", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.lit(None).cast("long").alias("id"), "t", "e", "r")
    nothing = F.lit(None).cast("binary")
    members = groups.join(sizes, "c").select("c", F.pmod(F.xxhash64("id", F.lit(2)), parts).alias("part"), "id")
    members = members.join(texts, "id").select("c", "part", "id", "t", nothing.alias("e"), nothing.alias("r"))
    dealt = centres.unionByName(members).repartition("c", "part").sortWithinPartitions("c", "part", "id")
    measured = dealt.mapInArrow(_measure(size, percent), "c long, id long, linked boolean, d long, a long, p array<int>")
    return scratch.cut(measured, "measured")


#: Where an entry stands: in the main component, outside among the first for others outside, or only for the main component.
_MAIN, _NEAR, _FAR = 0, 1, 2


def _entries(members: DataFrame, percent: int) -> DataFrame:
    """key, side, id, comp, a, need: a row per element of D that may meet a partner in another component.

    Texts outside the main component meet one another in their first elements (_NEAR), and the main
    component also in further ones (_FAR). ``need`` is the slack that a partner must have at least.
    """
    q = 100 + percent

    def first(most: Column) -> Column:
        """How many elements of D, in order, partners of at most that slack have to be met by."""
        least = F.greatest(F.lit(1).cast("long"), F.ceil(-(F.col("a") + most) / F.lit(2 * q)))
        return F.least(F.col("d") - least + 1, F.size("p").cast("long"))

    near, far = first(F.col("top_other")), first(F.col("top"))
    found = members.withColumn("near", near).withColumn("upto", F.when(F.col("other"), F.greatest(far, near)).otherwise(near)).where("upto > 0")
    found = found.select(
        "c", "id", "comp", "other", "a", "d", "near", F.posexplode(F.slice("p", F.lit(1), F.col("upto").cast("int"))).alias("k", "element")
    )
    side = F.when(~F.col("other"), _MAIN).when(F.col("k") < F.col("near"), _NEAR).otherwise(_FAR)
    need = -F.col("a") - 2 * q * (F.col("d") - F.col("k"))
    return found.select(F.xxhash64("c", "element").alias("key"), side.cast("tinyint").alias("side"), "id", "comp", "a", need.alias("need"))


def _mixed(entries: DataFrame, scratch: Scratch) -> DataFrame:
    """Entries whose bucket holds several components."""
    keys = entries.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    return scratch.cut(entries.join(scratch.cut(keys, "keys"), "key"), "mixed")


def _live(entries: DataFrame, scratch: Scratch) -> DataFrame:
    """Entries with a partner in their bucket that they may meet and that has the slack they need, as far as the
    most slack of a side tells; with the number of ``others`` in the bucket."""
    most = lambda side: F.max(F.when(F.col("side") == side, F.col("a")))
    stats = entries.groupBy("key").agg(
        most(_MAIN).alias("main"), most(_NEAR).alias("near"), most(_FAR).alias("far"), F.sum((F.col("side") != _MAIN).cast("long")).alias("others")
    )
    partner = F.when(F.col("side") == _MAIN, F.greatest("near", "far")).when(F.col("side") == _NEAR, F.greatest("main", "near")).otherwise(F.col("main"))
    found = entries.drop("others").join(scratch.cut(stats, "stats"), "key").where(F.col("need") <= partner)
    return scratch.cut(found.drop("main", "near", "far"), "live")


def _pairs(live: DataFrame) -> DataFrame:
    """(a, b): every text outside the main component with those in its buckets that it may be linked to.

    A bucket holds at most ``fan`` such texts, so a row meets at most so many others."""
    mine = live.where(F.col("side") != _MAIN)
    theirs = live.select("key", *(F.col(c).alias(f"{c}_") for c in ("id", "comp", "side", "a", "need")))
    meet = (F.col("side_") == _MAIN) | ((F.col("side") == _NEAR) & (F.col("side_") == _NEAR))
    found = mine.join(theirs, "key").where(meet).where("comp <> comp_ and need <= a_ and need_ <= a")
    return found.select(F.least("id", "id_").alias("a"), F.greatest("id", "id_").alias("b")).distinct()


def _labelled(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, fan: int, out: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows: h, i of each row), (of: h, n, root, i0 of each text), tables of ``out``: h tells texts apart, n is the size of
    a text's set, root a text of its component (null without words), i0 its smallest id."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")).distinct().select(F.monotonically_increasing_id().alias("id"), F.sha2("t", 256).alias("h"), "t")
    texts = scratch.cut(texts, "texts")
    about, labels = _links(texts, size, percent, scratch, fan)
    rows = out.cut(docs.select(_digest(text_col).alias("h"), F.col(id_col).cast("long").alias("i")), "rows")
    least = rows.groupBy("h").agg(F.min("i").alias("i0"))
    root = F.when(F.col("n") > 0, F.coalesce("label", "id"))
    of = texts.select("id", "h").join(about, "id").join(labels, "id", "left").select("h", "n", root.alias("root")).join(least, "h")
    of = out.cut(of, "of")
    scratch.clear()
    return rows, of


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, fan: int = FAN
) -> DataFrame:
    """Per row of ``docs``: ``id_col``, n_shingles, component_id.

    component_id is the smallest id that links reach, the row's own included. A text without words,
    empty or null, has no shingles and its own id; rows that repeat a text with words are linked.
    Null ids are passed over for component_id unless there is no other. Very long texts are compared
    whole. Other columns play no part, whatever their names. An empty table gives an empty one.
    Rows are told apart by nothing but their id and text.
    """
    scratch = Scratch(docs.sparkSession, "components")
    rows, of = _labelled(docs, id_col, text_col, size, percent, fan, scratch)
    least = scratch.cut(of.where("root is not null").groupBy("root").agg(F.min("i0").alias("least")), "least")
    of = scratch.cut(of.join(least, "root", "left").select("h", "n", "root", "least"), "of")
    return rows.join(of, "h").select(
        F.col("i").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("i")).otherwise(F.col("least")).alias("component_id")
    )


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, fan: int = FAN
) -> DataFrame:
    """The rows of ``docs``, one of each component of :func:`jaccard_components`: that with the smallest id.

    Null ids are largest. Of rows that repeat both id and text one stays, the first by their other
    columns written as JSON. Rows without words all stay. Columns are returned as they are, whatever
    their names; an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "near")
    rows, of = _labelled(docs, id_col, text_col, size, percent, fan, scratch)
    order = F.struct(F.col("i0").isNull(), "i0", "h")
    first = of.where("root is not null").groupBy("root").agg(F.min(order).alias("o")).select("o.h", F.col("o.i0").alias("keep"))
    times = rows.join(first, "h").where("i <=> keep").groupBy("h", "keep").agg(F.count(F.lit(1)).alias("times"))
    keep = times.unionByName(of.where("root is null").select("h", F.lit(None).cast("long").alias("keep"), F.lit(0).cast("long").alias("times")))
    keep = scratch.cut(keep, "keep")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), _digest(text_col).alias("h"), F.col(id_col).cast("long").alias("i"))
    kept = whole.join(keep.where("times < 2"), "h").where("times = 0 or i <=> keep").select("row")
    repeated = keep.where("times > 1")
    if not repeated.isEmpty():
        again = whole.join(repeated, "h").where("i <=> keep")
        kept = kept.unionByName(again.groupBy("h").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row"))
    return kept.select("row.*")
