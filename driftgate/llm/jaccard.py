"""N-gram Jaccard join by universe partitioning and the pigeonhole principle, exact for every link.

A text is the set of its distinct five-word shingles (hashed to 64 bits). Sets ``x`` and ``y`` link when
``100 |x n y| >= 75 |x u y|``, that is, when they differ in at most ``(|x| + |y|) / 7`` elements.

1. Equal sets form one class; only classes are compared.
2. Sizes fall into bands whose limits grow by 4/3, so the smaller set of a link is in the band of the larger one or the
   one below. Each band hashes the universe into segments. With at most H differences, out of H + 1 segments of the
   larger set one is equal in both. So a class *indexes* all its non-empty segments in the schemes of its own and of
   the next band, and *probes* H + 1 of them in its own: those with most elements, which are in the fewest sets.
3. Where a set has too few non-empty segments, some of a few reserved segments are probed with one-deletion
   neighbourhoods as well, which count twice (all sets index those neighbourhoods for reserved segments). The rare set
   for which that is not enough is compared with all sets of fitting size directly, in blocks.
4. Signatures travel packed, many to a row, to buckets of bounded size whose number follows the corpus. A signature
   that few classes share yields pairs; one shared by many yields a star and a chain, and its members are kept.
5. Pairs pass an exact filter (parities of hashed elements can't differ in more places than the sets do), then the
   closest pairs of each class are verified on the whole sets and joined to components. Whatever pair is left between
   two components, also inside the kept groups, is verified then. So every candidate is either verified or within one
   component: components are exact, though not all pairs of a large group are visited.

Defined cases: texts with fewer than five words are one shingle; null and wordless texts are empty and link with
nothing; rows with equal ids are texts of their own; a null id takes part, and a component of null ids only has a null
id; ``cluster`` ignores further columns, ``distinct_documents`` returns them untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from driftgate.llm.columns import aside
from driftgate.llm.components import components
from driftgate.llm.text import distinct_per_owner, lower, mix, shingles, slices, utf8, words
from driftgate.session import WorkArea

BUCKET_BYTES = 16 << 20
PAIRWISE = 16  # a signature with more classes is met by a star first
SEGMENTS = 0.32  # segments for each element of a band's largest set
RESERVED = 32  # one segment in so many is reserved
CLOSEST = 2
FILTER_BITS = 1 << 23
FIRST_GROUPS = 8
BLOCK = 2048
DIRECT_BYTES = 8 << 20
MIN_PARITY, MAX_PARITY = 64, 8192


def edges_of_bands(limit: int) -> np.ndarray:
    out = [1]
    while out[-1] <= limit:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * 4 / 3)))
    return np.array(out, np.int64)


_EDGES = edges_of_bands(1 << 40)


@cache
def scheme(band: int) -> tuple[int, int]:
    """Segments and reserved segments of a band."""
    top = int(_EDGES[band + 1]) - 1
    need = 2 * top // 7 + 1
    segments = max(math.ceil(SEGMENTS * top), need) + 2
    return segments, segments if top < 64 else segments // RESERVED + 2


def sets_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Element hashes, sorted within each text, and where each text's begin."""
    raw, offsets = utf8(column)
    value, owner = distinct_per_owner(*shingles(words(lower(raw), offsets)))
    return value, np.searchsorted(owner, np.arange(len(offsets)))


def names_of(value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set."""
    size = np.diff(first)
    owner = np.repeat(np.arange(len(size)), size)
    out = []
    for salt in (1, 2):
        total = np.zeros(len(size), np.uint64)
        np.add.at(total, owner, mix(value + np.uint64(salt * 0x1234567)))
        out.append(mix(total + size.astype(np.uint64)))
    return out[0], out[1]


def parity_of(elements: np.ndarray) -> np.ndarray:
    """Parity of the number of elements in each of a power of two of classes, packed into 64-bit words."""
    bits = min(max(MIN_PARITY, 2 << int(len(elements)).bit_length()), MAX_PARITY)
    count = np.bincount((elements >> np.uint64(7)).astype(np.int64) & (bits - 1), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def parity_gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places in which parities differ, for rows of two arrays; the longer one is folded to the shorter."""
    while a.shape[-1] > b.shape[-1]:
        half = a.shape[-1] // 2
        a = a[..., :half] ^ a[..., half:]
    while b.shape[-1] > a.shape[-1]:
        half = b.shape[-1] // 2
        b = b[..., :half] ^ b[..., half:]
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def may_link(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Could sets of these sizes link at all?"""
    return 4 * np.minimum(a, b) >= 3 * np.maximum(a, b)


def signatures(value: np.ndarray, first: np.ndarray, schemes=(0, 1)) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signature, set, probe flag of all sets, and which sets need a direct comparison."""
    size = np.diff(first)
    band = np.searchsorted(_EDGES, size, "right") - 1
    sig, own, probe, odd = [], [], [], np.zeros(len(size), bool)
    for up in schemes:  # the own band, then the next as the smaller set of a link
        for b in np.unique(band[size > 0]):
            sets = np.flatnonzero((band == b) & (size > 0))
            n = size[sets]
            segments, reserved = scheme(int(b) + up)
            at = np.repeat(first[sets] - np.cumsum(n) + n, n) + np.arange(n.sum())
            element, owner = value[at], np.repeat(np.arange(len(sets)), n)
            content = mix(element + np.uint64(99))
            segment = (mix(element + np.uint64(int(b) + up + 7)) % np.uint64(segments)).astype(np.int64)
            cell = owner * segments + segment
            order = np.argsort(cell, kind="stable")
            cell, content, element = cell[order], content[order], element[order]
            begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            total = np.add.reduceat(content, begin)
            count = np.diff(np.append(begin, len(cell)))
            seg_owner, seg = cell[begin] // segments, cell[begin] % segments
            salt = mix(seg.astype(np.uint64) * np.uint64(1_000_003) + np.uint64((int(b) + up) * 2 + 1))
            exact = mix(mix(total + count.astype(np.uint64)) ^ salt)
            chosen = np.zeros(len(begin), bool)
            twice = np.zeros(len(begin), bool)
            if not up:
                need = 2 * n // 7 + 1
                by = np.lexsort((seg, -count, seg_owner))  # most elements first
                start = np.searchsorted(seg_owner, np.arange(len(sets)))
                rank = np.empty(len(begin), np.int64)
                rank[by] = np.arange(len(begin)) - start[seg_owner[by]]
                chosen = rank < need[seg_owner]
                have = np.bincount(seg_owner, minlength=len(sets))
                lack = np.maximum(need - have, 0)
                kept = np.flatnonzero(seg < reserved)
                nth = np.arange(len(kept)) - np.searchsorted(seg_owner[kept], seg_owner[kept])
                twice[kept] = nth < lack[seg_owner[kept]]
                odd[sets] = lack > np.bincount(seg_owner[kept], minlength=len(sets))
            sig.append(exact)
            own.append(sets[seg_owner])
            probe.append(chosen)
            # one-deletion neighbourhoods of reserved segments
            inside = np.repeat(np.arange(len(begin)), count)
            inside, item = inside[seg[inside] < reserved], content[seg[inside] < reserved]
            left = total[inside] - item + (count[inside] - 1).astype(np.uint64)
            gone = count[inside] > 1  # an empty rest would match every set without elements there
            sig.append(mix(mix(left) ^ salt[inside])[gone])
            own.append(sets[seg_owner[inside]][gone])
            probe.append(twice[inside][gone])
            # a probed neighbourhood of one element may leave nothing: such a set is compared directly
            odd[sets[seg_owner[inside[~gone & twice[inside]]]]] = True
    if not sig:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool), odd
    return np.concatenate(sig), np.concatenate(own), np.concatenate(probe), odd


_ROWS = "doc_id bigint, key bigint, n_shingles bigint, h1 bigint, h2 bigint, parity binary, odd boolean"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document: size, names and parities of its set."""
    for batch in slices(batches):
        value, first = sets_of(batch.column(1))
        h1, h2 = names_of(value, first)
        odd = signatures(value, first, (0,))[3]
        parity = [parity_of(value[a:b]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(2),
                pa.array(np.diff(first)),
                pa.array(h1.view(np.int64)),
                pa.array(h2.view(np.int64)),
                pa.array(parity, pa.binary()),
                pa.array(odd),
            ],
            names=["doc_id", "key", "n_shingles", "h1", "h2", "parity", "odd"],
        )


def _pack(buckets: int):
    """Signatures of each class once a task, packed by bucket: names, sizes and counts, then the signatures."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in slices(batches):
            value, first = sets_of(batch.column(1))
            name, _ = names_of(value, first)
            if len(met) > 1_000_000:
                met.clear()
            new = np.array([not (n in met or met.add(n)) for n in name.tolist()], bool)
            sig, own, probe, _ = signatures(value, first)
            keep = new[own]
            sig, own, probe = sig[keep], own[keep], probe[keep]
            if not len(sig):
                continue
            bucket = (mix(sig) % np.uint64(buckets)).astype(np.int64)
            sig = sig >> np.uint64(1) << np.uint64(1) | probe.astype(np.uint64)
            order = np.lexsort((own, bucket))
            bucket, sig, own = bucket[order], sig[order], own[order]
            size, out, cuts = np.diff(first), [], np.flatnonzero(np.diff(bucket, prepend=-1))
            for a, b in zip(cuts, np.append(cuts[1:], len(bucket)), strict=True):
                mine, count = np.unique(own[a:b], return_counts=True)
                parts = (name[mine], size[mine].astype(np.uint32), count.astype(np.uint32), sig[a:b])
                out.append((int(bucket[a]), len(mine), b"".join(x.tobytes() for x in parts)))
            if out:
                ids, classes, packed = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(classes, pa.int64()), pa.array(packed, pa.binary())],
                    names=["bucket", "classes", "packed"],
                )

    return apply


_MET = "a bigint, b bigint, run bigint"


def _meet(table: pa.Table) -> pa.Table:
    """Pairs of classes that share a signature, and members of the signatures that many share.

    A pair has ``a, b``; a member has ``a`` and ``run``.
    """
    names, sizes, sigs, owners, at = [], [], [], [], 0
    for classes, packed in zip(table["classes"].to_pylist(), table["packed"], strict=True):
        raw = packed.as_buffer()
        names.append(np.frombuffer(raw, np.uint64, classes))
        sizes.append(np.frombuffer(raw, np.uint32, classes, 8 * classes))
        sigs.append(np.frombuffer(raw, np.uint64, offset=16 * classes))
        owners.append(np.repeat(np.arange(at, at + classes), np.frombuffer(raw, np.uint32, classes, 12 * classes)))
        at += classes
    name, size = np.concatenate(names), np.concatenate(sizes).astype(np.int64)
    sig, owner = np.concatenate(sigs), np.concatenate(owners)
    probe, sig = (sig & np.uint64(1)).astype(bool), sig >> np.uint64(1)
    # only signatures of two or more rows matter
    order = np.argsort(sig)
    sig, owner, probe = sig[order], owner[order], probe[order]
    same = sig[1:] == sig[:-1]
    shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    sig, owner, probe = sig[shared], owner[shared], probe[shared]
    who = name[owner]
    order = np.lexsort((~probe, who, sig))
    sig, owner, probe, who = sig[order], owner[order], probe[order], who[order]
    once = np.ones(len(sig), bool)
    once[1:] = (sig[1:] != sig[:-1]) | (who[1:] != who[:-1])
    sig, owner, probe, who = sig[once], owner[once], probe[once], who[once]
    begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
    length = np.diff(np.append(begin, len(sig)))
    big = size[owner]
    left, right, runs = [], [], []
    for n in range(2, PAIRWISE + 1):  # all groups of the same size at once
        start = begin[length == n]
        for i in range(n):
            for j in range(i + 1, n):
                x, y = start + i, start + j
                # the larger set probes; of equal ones either does
                ok = may_link(big[x], big[y]) & ((probe[x] & (big[x] >= big[y])) | (probe[y] & (big[y] >= big[x])))
                left.append(who[x[ok]])
                right.append(who[y[ok]])
    for s, n in zip(begin[length > PAIRWISE], length[length > PAIRWISE], strict=True):
        member = np.arange(s, s + n)
        if not probe[member].any():
            continue
        # members are in order of their names: a star around the first of each band of sizes, and a chain
        by = member[np.lexsort((who[member], big[member]))]
        group = np.searchsorted(_EDGES, big[by], "right")
        centre = by[np.searchsorted(group, group)]
        for x, y in ((by, centre), (by[1:], by[:-1]), (member[1:], member[:-1])):
            ok = may_link(big[x], big[y]) & (x != y)
            left.append(who[x[ok]])
            right.append(who[y[ok]])
        runs.append(member)
    a = np.concatenate(left) if left else np.zeros(0, np.uint64)
    b = np.concatenate(right) if right else np.zeros(0, np.uint64)
    a, b = a.view(np.int64), b.view(np.int64)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    member = np.concatenate(runs) if runs else np.zeros(0, np.int64)
    none = pa.nulls(len(pairs), pa.int64())
    return pa.table(
        {
            "a": pa.concat_arrays([pa.array(pairs[:, 0]), pa.array(who[member].view(np.int64))]),
            "b": pa.concat_arrays([pa.array(pairs[:, 1]), pa.nulls(len(member), pa.int64())]),
            "run": pa.concat_arrays([none, pa.array(sig[member].view(np.int64))]),
        }
    )


def _gap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop pairs whose sizes or parities rule a link out; ``gap`` is a lower bound of their differences."""
    for batch in batches:
        na, nb = batch["na"].to_numpy(), batch["nb"].to_numpy()
        gap = np.zeros(len(na), np.int64)
        for i, (pa_, pb) in enumerate(zip(batch["pa"], batch["pb"], strict=True)):
            x, y = np.frombuffer(pa_.as_buffer(), np.uint64), np.frombuffer(pb.as_buffer(), np.uint64)
            gap[i] = parity_gap(x, y)
        keep = may_link(na, nb) & (7 * gap <= na + nb)
        yield pa.RecordBatch.from_arrays(
            [batch["a"].filter(pa.array(keep)), batch["b"].filter(pa.array(keep)), pa.array(gap[keep])],
            names=["a", "b", "gap"],
        )


def _inside(table: pa.Table) -> pa.Table:
    """Pairs across components within one kept group that sizes and parities allow.

    Near copies share many groups; a pair is left to the first one in both its members' lists of first groups.
    """
    name, size = table["a"].to_numpy(), table["n"].to_numpy()
    root, run = table["root"].to_numpy(), table["run"][0].as_py()
    mine = table["mine"].to_numpy(zero_copy_only=False)
    firsts = np.full((len(name), FIRST_GROUPS), np.iinfo(np.int64).max)
    for i, own in enumerate(table["runs"]):
        firsts[i, : len(own)] = own.values.to_numpy()
    parity = [np.frombuffer(p.as_buffer(), np.uint64) for p in table["parity"]]
    width = np.array([len(w) for w in parity])
    stacks = {w: (np.flatnonzero(width == w), np.stack([parity[i] for i in np.flatnonzero(width == w)])) for w in set(width)}
    left, right = [], []
    for i in np.flatnonzero(mine):
        for rows, stack in stacks.values():
            ok = may_link(size[i], size[rows]) & (root[rows] != root[i])
            near = 7 * parity_gap(stack[ok], parity[i][None, :]) <= size[i] + size[rows[ok]]
            rows = rows[ok][near]
            if not len(rows):
                continue
            shared = np.isin(firsts[rows], firsts[i])
            shared &= firsts[rows] < np.iinfo(np.int64).max
            first = np.where(shared, firsts[rows], np.iinfo(np.int64).max).min(1)
            rows = rows[(first == run) | (first == np.iinfo(np.int64).max)]
            left.append(np.full(len(rows), name[i]))
            right.append(name[rows])
    a = np.concatenate(left) if left else np.zeros(0, np.int64)
    b = np.concatenate(right) if right else np.zeros(0, np.int64)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


class Join:
    """One run of the join over ``docs`` (``doc_id, text``)."""

    def __init__(self, docs: DataFrame, area: WorkArea):
        self.docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        self.area = area
        keyed = self.docs.withColumn("key", row_key())
        self.rows = area.save(keyed.mapInArrow(_describe, _ROWS), "rows")
        classes = self.rows.filter("n_shingles > 0").groupBy("h1", "h2")
        self.classes = area.save(
            classes.agg(
                F.min("doc_id").alias("least"),
                F.min("n_shingles").alias("n"),
                F.min("parity").alias("parity"),
                F.max("odd").alias("odd"),
            ),
            "classes",
        )

    def candidates(self) -> tuple[DataFrame, DataFrame]:
        """Candidate pairs of classes, and members of signatures shared by many."""
        total = self.rows.agg(F.sum("n_shingles")).first()[0] or 0
        buckets = max(16, math.ceil(total * 9 / BUCKET_BYTES))
        packed = self.docs.mapInArrow(_pack(buckets), "bucket bigint, classes bigint, packed binary")
        met = self.area.save(packed.groupBy("bucket").applyInArrow(_meet, _MET), "met")
        pairs = met.filter("run IS NULL").select("a", "b").distinct()
        for sets in self._direct():
            pairs = pairs.unionAll(sets)
        return pairs, met.filter("run IS NOT NULL").select("run", "a")

    def _direct(self) -> Iterator[DataFrame]:
        """Sets without enough segments, against all sets; usually there are none."""
        odd = self.classes.filter("odd").select(F.col("h1").alias("name"), "n")
        size = odd.agg(F.sum("n")).first()[0] or 0
        if not size:
            return
        sets = self.sets(odd.select("name"))
        blocks = math.ceil(size * 8 / DIRECT_BYTES)
        for block in range(blocks):
            own = sets.filter(F.pmod(F.xxhash64("name"), F.lit(blocks)) == block).toArrow()  # about DIRECT_BYTES
            name, sets_ = own["name"].to_pylist(), [x.values.to_numpy().view(np.uint64) for x in own["elements"]]

            def compare(batches, name=name, sets_=sets_):
                for batch in slices(batches):
                    value, first = sets_of(batch.column(1))
                    other, n = names_of(value, first)[0].view(np.int64).tolist(), np.diff(first)
                    found = [
                        (min(name[i], other[j]), max(name[i], other[j]))
                        for i, mine in enumerate(sets_)
                        for j in np.flatnonzero(may_link(n, len(mine)) & (n > 0))
                        if name[i] != other[j]
                        and 7 * len(np.intersect1d(mine, value[first[j] : first[j + 1]], assume_unique=True))
                        >= 3 * (len(mine) + n[j])
                    ]
                    a, b = zip(*found, strict=True) if found else ((), ())
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

            yield self.docs.mapInArrow(compare, "a bigint, b bigint").distinct()

    def sets(self, names: DataFrame) -> DataFrame:
        """Whole sets of some classes (``name``). A bit filter of fixed size spares most other texts the work."""
        reps = self.classes.join(names.distinct(), F.col("h1") == F.col("name"), "left_semi")
        chosen = self.area.save(reps.select("h1", "least"), f"chosen{self._next()}")
        place = F.pmod(F.xxhash64("least"), F.lit(FILTER_BITS))
        bits = (
            chosen.select((place / 64).cast("bigint").alias("word"), (place % 64).cast("int").alias("bit"))
            .groupBy("word")
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))).alias("bits"))
            .toArrow()  # at most FILTER_BITS / 64 rows
        )
        table = np.zeros(FILTER_BITS // 64, np.int64)
        table[bits["word"].to_numpy()] = bits["bits"].to_numpy()

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column(2).to_numpy()
                hit = (table[at // 64] >> (at % 64)) & 1
                for part in slices(iter([batch.filter(pa.array(hit.astype(bool)))])):
                    value, first = sets_of(part.column(1))
                    name, _ = names_of(value, first)
                    elements = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(value.view(np.int64)))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(name.view(np.int64)), elements],
                        names=["doc_id", "name", "elements"],
                    )

        located = self.docs.withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)))
        found = located.mapInArrow(apply, "doc_id bigint, name bigint, elements array<bigint>")
        same = (F.col("name") == F.col("h1")) & F.col("doc_id").eqNullSafe(F.col("least"))
        whole = found.join(chosen, same, "left_semi").select("name", "elements")
        return self.area.save(whole, f"sets{self._next()}")

    _turn = 0

    def _next(self) -> int:
        self._turn += 1
        return self._turn

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that link, tested on whole sets."""
        names = pairs.select(F.col("a").alias("name")).unionAll(pairs.select(F.col("b").alias("name")))
        sets = self.sets(names)
        left = sets.select(F.col("name").alias("a"), F.col("elements").alias("sa"))
        right = sets.select(F.col("name").alias("b"), F.col("elements").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        linked = 100 * both >= 75 * (F.size("sa") + F.size("sb") - both)
        tested = pairs.select("a", "b").join(left, "a").join(right, "b").filter(linked).select("a", "b")
        return self.area.save(tested.distinct(), name)

    def links(self) -> tuple[DataFrame, DataFrame | None]:
        """Links that span every component, and the components of their classes (None without links)."""
        pairs, members = self.candidates()
        own = self.classes.select(F.col("h1"), "n", "parity")
        a = own.select(F.col("h1").alias("a"), F.col("n").alias("na"), F.col("parity").alias("pa"))
        b = own.select(F.col("h1").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("pb"))
        near = self.area.save(pairs.join(a, "a").join(b, "b").mapInArrow(_gap, "a bigint, b bigint, gap bigint"), "near")
        # the closest pairs of each class first
        sides = near.select("a", "b", "gap", F.explode(F.array("a", "b")).alias("of"))
        rank = F.row_number().over(W.partitionBy("of").orderBy("gap", "a", "b"))
        first = sides.withColumn("rank", rank).filter(F.col("rank") <= CLOSEST).select("a", "b").distinct()
        links = self.verified(self.area.save(first, "first"), "links1")
        roots = self.area.save(components(links, self.area, "one"), "roots1")
        # what is left between components
        ra = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        rb = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        rest = near.join(ra, "a", "left").join(rb, "b", "left").select("a", "b", "ra", "rb")
        rest = rest.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
        known = self.area.load("first", first.schema)
        rest = rest.unionAll(self._within(members, roots)).distinct().join(known, ["a", "b"], "left_anti")
        rest = self.area.save(rest, "rest")
        if rest.isEmpty():
            return links, roots
        links = self.area.save(links.unionAll(self.verified(rest, "links2")), "links")
        return links, self.area.save(components(links, self.area, "two"), "roots2")

    def _within(self, members: DataFrame, roots: DataFrame) -> DataFrame:
        """Pairs across components in groups that share a signature; groups within one component need nothing."""
        ra = roots.select(F.col("node").alias("a"), "root")
        member = self.area.save(members.join(ra, "a", "left").select("run", "a", F.coalesce("root", "a").alias("root")), "members")
        mixed = (
            member.groupBy("run")
            .agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("many"))
            .filter("low <> high")
            .select("run", F.ceil(F.col("many") / BLOCK).cast("bigint").alias("blocks"))
        )
        full = member.join(self.area.save(mixed, "mixed"), "run")
        # a class is in one group at most for each of its signatures
        firsts = full.groupBy("a").agg(F.slice(F.sort_array(F.collect_set("run")), 1, FIRST_GROUPS).alias("runs"))
        own = self.classes.select(F.col("h1").alias("a"), "n", "parity")
        full = full.join(firsts.join(own, "a"), "a")
        # a group of any size in blocks: each meets the whole group
        spread = full.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        spread = spread.withColumn("mine", F.pmod(F.xxhash64("a"), F.col("blocks")) == F.col("block"))
        return spread.drop("blocks").groupBy("run", "block").applyInArrow(_inside, "a bigint, b bigint")


def row_key() -> Column:
    """Tells rows apart that share an id; equal rows share it."""
    return F.xxhash64(F.col("doc_id").cast("bigint"), "text")


def _labelled(docs: DataFrame, area: WorkArea) -> DataFrame:
    """The rows with ``component_id`` and ``keeper``, the key of the row that stands for the component."""
    join = Join(docs, area)
    _, roots = join.links()
    roots = roots.withColumnRenamed("node", "h1")
    first = join.rows.groupBy("h1", "h2").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first"))
    labelled = first.join(roots, "h1", "left").withColumn("root", F.coalesce("root", "h1"))
    least = labelled.groupBy("root").agg(F.min("first").alias("least"))
    labels = labelled.join(least, "root").select("h1", "h2", "least")
    rows = join.rows.join(labels, ["h1", "h2"], "left")
    full = F.col("n_shingles") > 0
    return rows.withColumn("component_id", F.when(full, F.col("least.doc_id")).otherwise(F.col("doc_id"))).withColumn(
        "keeper", F.when(full, F.col("least.key")).otherwise(F.col("key"))
    )


def cluster(docs: DataFrame, area: WorkArea) -> DataFrame:
    """``doc_id, n_shingles, component_id, class_id`` for every row of ``docs``."""
    labelled = _labelled(docs.select("doc_id", "text"), area)
    return labelled.select("doc_id", "n_shingles", "component_id", F.col("h1").alias("class_id"))


def distinct_documents(docs: DataFrame, area: WorkArea) -> DataFrame:
    """One document of each group stays: the one with the smallest id. Texts without words all stay.

    The documents' columns come back as they are, whatever their names.
    """
    own, restore = aside(docs, "doc_id", "text")
    labels = _labelled(docs.select("doc_id", "text"), area).select("doc_id", "key", "keeper", "n_shingles")
    rows = area.save(labels, "labels").withColumnRenamed("doc_id", "known_id")
    same = (F.col("_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("known_id"))
    gone = rows.filter("key <> keeper").select("key", "known_id").distinct()
    kept = own.withColumn("_key", row_key()).join(gone, same, "left_anti")
    # equal rows with equal ids share their key; one of them stays
    twins = rows.filter("key = keeper AND n_shingles > 0").groupBy("key", "known_id").agg(F.count("*").alias("n")).filter("n > 1")
    if twins.isEmpty():
        return restore(kept)
    once = kept.join(twins, same, "left_semi").dropDuplicates(["_key", "doc_id"])
    return restore(kept.join(twins, same, "left_anti").unionAll(once))
