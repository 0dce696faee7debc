"""Jaccard join on word n-grams by parity sketches.

A document's set holds the hashes of its distinct n-grams. Each falls into a block by its hash, and XOR-ing the hashes of
a block gives 64 parities, its sketch: a member that only one of two sets has changes one block, so they differ in at most
as many blocks as members. Sets of sizes a and b that reach the similarity J differ in at most D = (a + b)(1 - J) / (1 + J)
members. Blocks of differing contents hardly ever have equal sketches (with a sketch of one bit of 128 for each n-gram they
did, and pairs that met by chance grew with the square of the input).

Pigeonhole: in a size band whose largest set is M the sketch has D(M) + 1 + E blocks, so two linked sets
agree in at least 1 + E blocks. Few n-grams fall into a block, so a block by itself is often shared by unlinked texts; therefore
documents are joined on twos of blocks. The blocks of a band are dealt to C classes by their hashes, and of C + 1 blocks in which
two sets agree two are of one class. So each document may leave out E - C blocks, if it does so by an order common to all. The
order is: blocks of few n-grams ("light"; as long as E - C are enough for them, they are not even sent), then the blocks that most
documents send. Blocks that a single document sends are dropped before, and whoever has no C + 1 blocks then is linked with
nobody. E and C are shares of D, so a document has some multiple of D twos. It takes part in its own band and, if it
can link with a member of it, in the next one; only buckets that are in some document's own band count.

Join: equal sets become one class first, counted before they move; only the first row of each sends blocks.
Buckets of at most ``SMALL`` members give pairs of sets of able sizes. In each larger bucket
the most central member (that with most company in all of them) is compared with every other one. What is linked with it joins
its component. Let x be a member that is not, and y any other: if x and y link, they share a member of
their differences from the centre. (Otherwise they would differ in |dx| + |dy| members, where |dx| is over
(n_x + n_c) d and |dy| is at least |n_y - n_c|, so in more than (n_x + n_y) d, d = (1 - J) / (1 + J).) So the other
pairs of a star are found by their differences, and of each member only the first D + 1 in an order common to all
matter, as linked members leave at most D of them unshared. Within a task the order is by rarity and pairs are verified
on the spot: x and y differ where just one of dx and dy has a member. A star too large for one task is dealt to several,
each with the centre; where some of its members are not linked with it, the first D + 1 differences
of each (what the centre lacks first) are the keys of new buckets, which go the same way, each a star of its own. Their
members agree in one more n-gram than those of the bucket before, so this ends. Buckets whose members are all of one component or one task are left out. No link between
different texts is lost, and neither the copies in a large group nor its stragglers are paired with each other. Verification
counts shared n-grams exactly.

n-grams: lower-cased (A-Z) words between ASCII white space; a text of fewer words is one n-gram; without words
or text the set is empty and linked with nothing. A document is one row, and each row has a result. Rows
that share a doc_id, or have none, are ordered by their texts (``common.row_keys``). A component bears the doc_id of its first
row; a null doc_id sorts first. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, graph

#: Each band ends half as large again as it begins.
BAND_RATIO = 1.5
#: Buckets up to this size give pairs, larger ones stars; the pairs of a family of near copies would grow with its square.
SMALL = 2
#: Members, and n-grams of them, that one task compares with a centre; a larger star is dealt to several tasks with a copy of the centre each.
PART_ROWS, PART_GRAMS = 1000, 1 << 21

_u = np.uint64


class Rule:
    """n-gram length and similarity num / den."""

    def __init__(self, words: int, num: int, den: int):
        if not BAND_RATIO * num > den:
            raise ValueError(f"the similarity must be over {1 / BAND_RATIO:.2f}")
        self.words, self.num, self.den = words, num, den
        # Few n-grams fall into each block of a looser similarity, so there only empty blocks count as light.
        self.light = 1 if num / den >= 0.88 else 0
        self.spare = 0.3 if num / den >= 0.88 else 0.5

    def differ(self, total: int) -> int:
        """Most members in which linked sets of ``total`` members together can differ."""
        return total * (self.den - self.num) // (self.den + self.num)

    def band(self, t: int) -> tuple[int, int]:
        """Smallest and largest size in band ``t``."""
        edges = _edges()
        return edges[t], edges[t + 1] - 1

    def shape(self, t: int) -> tuple[int, int, int]:
        """(blocks, spare blocks, classes) of band ``t``; no blocks where linked sets must be equal."""
        d = self.differ(2 * self.band(t)[1])
        spare = int(np.ceil(self.spare * (d + 1)))
        return (d + 1 + spare, spare, max(1, spare // 2)) if d else (0, 0, 0)


    def classes(self, n: np.ndarray) -> np.ndarray:
        """Of sets of these sizes the number of classes in their own band, and in the next one."""
        band = _bands(n)
        known = np.array([self.shape(t)[2] for t in range(int(band.max(initial=0)) + 2)], np.int64)
        return np.stack([known[band], known[band + 1]])


def _bands(n: np.ndarray) -> np.ndarray:
    return np.maximum(np.searchsorted(_edges(), n, "right") - 1, 0)


@functools.cache
def _edges() -> list[int]:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * BAND_RATIO)))
    return out


def _hash_of(words: list[bytes]) -> int:
    """Of a text too short for an n-gram; no window has a hash like it."""
    return int(common.word_hashes([b"\x00" + b" ".join(words)])[0])


def ngrams(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of all texts, ascending within each text, and where each text's begin."""
    words, starts = common.split_words(texts, common.LOWER)
    counts, h = np.diff(starts), common.word_hashes(words)
    width = np.maximum(counts - size + 1, 0)
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(width)])
    hashes = common.window_hashes(h, size)[common.inside(starts, size)]
    for i in np.flatnonzero(width > 1):
        hashes[at[i] : at[i + 1]].sort()
    short = np.flatnonzero((counts > 0) & (counts < size))
    whole = [_hash_of(words[starts[i] : starts[i + 1]]) for i in short]
    hashes = np.insert(hashes, at[short], np.array(whole, np.uint64))
    width[short] = 1
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(width)])
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = hashes[1:] != hashes[:-1]
    fresh[at[:-1][width > 0]] = True
    return hashes[fresh], np.concatenate([np.zeros(1, np.int64), np.cumsum(fresh)])[at]


def _key(block: np.ndarray, t: np.ndarray, parities: np.ndarray, light: np.ndarray) -> np.ndarray:
    """Bit 0 tells the two bands of a text apart, bit 1 is set for light blocks."""
    whole = common.mix(common.mix(parities + block.astype(_u) * _u(0x9E3779B97F4A7C15)) ^ common.mix(t.astype(_u) << _u(40)))
    return whole & ~_u(3) | (t & 1).astype(_u) | light.astype(_u) << _u(1)


def block_keys(hashes: np.ndarray, starts: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, key, spare, own) of the sketch blocks that each text sends: whether in its own band, and how many of its blocks there it may still leave out."""
    n = np.diff(starts)
    band = _bands(n)
    docs, keys, left, home = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    shapes = {t: rule.shape(t) for t in range(int(band.max(initial=0)) + 2)}
    for step in (0, 1):
        t = band + step
        floor = np.array([_edges()[x] for x in t], np.int64)
        part = (n > 0) & (np.array([shapes[x][0] for x in t], np.int64) > 0)
        if step:
            part &= n * rule.den >= rule.num * floor
        chosen = np.flatnonzero(part)
        if not len(chosen):
            continue
        width = n[chosen]
        total = np.array([shapes[x][0] for x in t[chosen]], np.int64)
        spare = np.array([shapes[x][1] for x in t[chosen]], np.int64)
        row = np.repeat(np.arange(len(chosen)), width)
        at = np.repeat(starts[chosen] - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
        h = hashes[at]
        block = ((h >> _u(32)) * total[row].astype(_u)) >> _u(32)  # ascending with the hash
        fresh = np.ones(len(h), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (block[1:] != block[:-1])
        heads = np.flatnonzero(fresh)
        parities = np.bitwise_xor.reduceat(common.mix(h), heads)
        owner, number = row[heads], block[heads]
        heavy = np.diff(heads, append=len(h)) > rule.light
        light = total - np.bincount(owner[heavy], minlength=len(chosen))
        spare = spare - np.array([shapes[x][2] for x in t[chosen]], np.int64)
        sends_all = light > spare
        spare = np.where(sends_all, spare, spare - light)
        sent = heavy | sends_all[owner]
        docs.append(chosen[owner[sent]])
        keys.append(_key(number[sent], t[chosen][owner[sent]], parities[sent], ~heavy[sent]))
        left.append(spare[owner[sent]])
        home.append(np.full(len(docs[-1]), step == 0))
        for i in np.flatnonzero(sends_all):  # its blocks without any n-gram
            have = number[owner == i]
            bare = np.setdiff1d(np.arange(total[i]), have.astype(np.int64))
            docs.append(np.full(len(bare), chosen[i]))
            keys.append(_key(bare, np.full(len(bare), t[chosen[i]]), np.zeros(len(bare), np.uint64), np.ones(len(bare), bool)))
            left.append(np.full(len(bare), spare[i]))
            home.append(np.full(len(bare), step == 0))
    return np.concatenate(docs), np.concatenate(keys), np.concatenate(left), np.concatenate(home)


def _sums(hashes: np.ndarray, starts: np.ndarray, salt: int) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(common.mix(hashes ^ _u(salt)), dtype=np.uint64)])
    return total[starts[1:]] - total[starts[:-1]]


def _sets(docs: DataFrame, rule: Rule) -> DataFrame:
    """Of each document the size of its set and two sums over it, which equal sets share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in common.slices(batch):
                hashes, starts = ngrams(texts, rule.words)
                sums = [pa.array(_sums(hashes, starts, salt).view(np.int64)) for salt in (1, 2)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(texts)), pa.array(np.diff(starts)), *sums], ["doc_id", "n", "s", "t"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, s long, t long")


def _blocks(docs: DataFrame, rule: Rule) -> DataFrame:
    """(key, rep) of each sketch block that a document sends; the first of a band also has n (the size of its set), spare, classes and own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for start, texts in common.slices(batch):
                hashes, starts = ngrams(texts, rule.words)
                doc, keys, spare, own = block_keys(hashes, starts, rule)
                later = np.ones(len(doc), bool)
                later[np.unique(doc * 2 + own, return_index=True)[1]] = False
                n = np.diff(starts)
                classes = rule.classes(n)[np.where(own, 0, 1), doc]
                about = [pa.array(x, kind, mask=later) for x, kind in ((n[doc], pa.int32()), (spare, pa.int32()), (classes, pa.int32()), (own, pa.bool_()))]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids[start + doc]), *about], ["key", "rep", "n", "spare", "classes", "own"])

    return docs.select("doc_id", "text").mapInArrow(run, "key long, rep long, n int, spare int, classes int, own boolean")


def _band() -> Column:
    """A document's two bands differ in the last bit of their keys."""
    return F.col("key").bitwiseAND(1).alias("band")


def _twos(blocks: DataFrame) -> DataFrame:
    """(key, rep, n, own): twos of the blocks that several reps send, of one band and class, without the ``spare`` most common blocks of each rep and band.

    ``blocks`` is written already, and goes.
    """
    shared = common.cut(_met(blocks), "shared")
    bands = common.cut(blocks.where("n is not null").select("rep", _band(), "n", "spare", "classes", "own"), "bands")
    held = common.cut(blocks.select("key", "rep").join(shared.hint("merge"), "key"), "held")
    common.drop(shared, blocks)
    order = Window.partitionBy("rep", "band").orderBy(F.col("key").bitwiseAND(2).desc(), F.desc("size"), "key")
    placed = held.withColumn("band", _band()).join(bands.hint("merge"), ["rep", "band"]).withColumns({"nth": F.row_number().over(order), "all": F.count("*").over(Window.partitionBy("rep", "band"))})
    # Fewer than this are shared with anybody: not linked with anybody.
    rarest = placed.where("nth > spare and all > spare + classes").withColumn("class", F.pmod(F.xxhash64("key"), F.col("classes")))
    keys = F.array_sort(F.collect_list("key"))
    sets = rarest.groupBy("rep", "band", "class").agg(F.first("n").alias("n"), F.first("own").alias("own"), keys.alias("keys"))
    two = F.expr("flatten(transform(keys, (x, i) -> transform(slice(keys, i + 2, size(keys)), y -> xxhash64(x, y))))")
    twos = common.cut(sets.where(F.size("keys") > 1).select(F.explode(two).alias("key"), "rep", "n", "own"), "twos")
    common.drop(held, bands)
    return twos


def _pairs(small: DataFrame, rule: Rule) -> DataFrame:
    """(a, b, n) that meet in a small bucket; n: the size of b's set."""
    rows = small.select("key", F.struct("rep", "n", "own").alias("x"))
    n, m = F.col("x.n"), F.col("y.n")
    able = (F.col("x.rep") < F.col("y.rep")) & (F.col("x.own") | F.col("y.own")) & (F.lit(rule.den) * F.least(n, m) >= F.lit(rule.num) * F.greatest(n, m))
    met = rows.join(rows.select("key", F.col("x").alias("y")), "key").where(able)
    return met.groupBy(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).agg(F.max(m).alias("n"))


class _Star:
    """A centre and the members that one task compares with it."""

    def __init__(self, rule: Rule, key: tuple[int, int], a: int, split: bool, centre: np.ndarray):
        self.rule, self.key, self.a, self.split, self.centre = rule, key, a, split, centre
        self.ids: list[int] = []
        self.sizes: list[int] = []
        self.apart: list[np.ndarray] = []  # the n-grams that only the centre or only the member has

    def add(self, b: int, own: np.ndarray) -> None:
        self.ids.append(b)
        self.sizes.append(len(own))
        self.apart.append(np.setxor1d(self.centre, own, assume_unique=True))

    def _most(self) -> np.ndarray:
        """Most members in which a set can differ from one that is linked with it."""
        return np.array(self.sizes, np.int64) * (self.rule.den - self.rule.num) // self.rule.num

    def _meetings(self, loose: np.ndarray) -> np.ndarray:
        """Pairs (loose member, member) with a common one among their rarest differences."""
        m, width = len(self.ids), np.array([len(x) for x in self.apart])
        owner, grams = np.repeat(np.arange(m), width), np.concatenate(self.apart)
        _, gram, times = np.unique(grams, return_inverse=True, return_counts=True)
        order = np.lexsort((gram, times[gram], owner))
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(width) - width, width)
        # A difference that no other member has takes a place but meets nobody.
        sent = order[(nth <= self._most()[owner]) & (times[gram[order]] > 1)]
        sent = sent[np.argsort(gram[sent], kind="stable")]
        meet = np.zeros((m, m), bool)
        for who in np.split(owner[sent], np.flatnonzero(np.diff(gram[sent])) + 1):
            meet[np.ix_(who[loose[who]], who)] = True
        meet[loose[:, None] & loose[None, :] & np.tri(m, dtype=bool)] = False  # of two loose members once
        return np.argwhere(meet)

    def links(self) -> list[tuple[int, int]]:
        """Linked pairs that join what the members' links join."""
        rule, sizes = self.rule, np.array(self.sizes, np.int64)
        far = np.array([len(x) for x in self.apart], np.int64) * (rule.den + rule.num)
        loose = far > (len(self.centre) + sizes) * (rule.den - rule.num)
        self.loose = loose
        out = [(self.a, self.ids[i]) for i in np.flatnonzero(~loose)]
        if not loose.any() or len(loose) < 2:
            return out
        root = np.where(loose, np.arange(len(loose)), -1)
        for x, y in self._meetings(loose):
            if root[x] == root[y] or rule.den * min(sizes[x], sizes[y]) < rule.num * max(sizes[x], sizes[y]):
                continue
            most = rule.differ(int(sizes[x] + sizes[y]))
            dx, dy = self.apart[x], self.apart[y]
            if abs(len(dx) - len(dy)) <= most and len(np.setxor1d(dx, dy, assume_unique=True)) <= most:
                out.append((self.ids[x], self.ids[y]))
                root[root == root[x]] = root[y]
        return out

    def first_differences(self) -> Iterator[tuple[int, int, bool, np.ndarray]]:
        for b, n, loose, apart, most in zip(self.ids, self.sizes, self.loose.tolist(), self.apart, self._most().tolist(), strict=True):
            order = np.lexsort((apart, np.isin(apart, self.centre, assume_unique=True)))
            yield b, n, loose, apart[order[: most + 1]].view(np.int64)


def _compared(stars: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b); and (star, b, n, part, loose, grams) of members of stars that are dealt to several tasks.

    ``stars``: (star, a, b, n), n the size of b's set. A star's centre a is sent once to each task that compares it with some of its b.
    """

    def record(links: list[tuple[int, int]], more: list[tuple[int, int, int, int, bool, np.ndarray]]) -> pa.RecordBatch:
        none = [None] * len(links)
        offsets = np.cumsum([0, *(len(x[5]) for x in more)])
        grams = pa.ListArray.from_arrays(pa.array([*none, *offsets.tolist()], pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *(x[5] for x in more)])))
        a = pa.array([x[0] for x in links] + [None] * len(more), pa.int64())
        b = pa.array([x[1] for x in links] + [x[1] for x in more], pa.int64())
        star, *rest = (pa.array(none + [x[i] for x in more], kind) for i, kind in ((0, pa.int64()), (2, pa.int32()), (3, pa.int32()), (4, pa.bool_())))
        return pa.RecordBatch.from_arrays([a, b, star, *rest, grams], ["a", "b", "star", "n", "part", "loose", "grams"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star: _Star | None = None

        def closed() -> pa.RecordBatch:
            links = star.links() if star.ids else []
            return record(links, [(star.key[0], b, n, star.key[1], loose, grams) for b, n, loose, grams in star.first_differences()] if star.ids and star.split else [])

        for batch in batches:
            keys = list(zip(batch.column("star").to_pylist(), batch.column("part").to_pylist(), strict=True))
            ids, split = batch.column("b").to_pylist(), batch.column("split").to_pylist()
            for start, some in common.slices(batch):
                hashes, starts = ngrams(some, rule.words)
                for i in range(len(some)):
                    own = hashes[starts[i] : starts[i + 1]]
                    if star is None or keys[start + i] != star.key:  # a group's first row is its centre
                        if star is not None:
                            yield closed()
                        star = _Star(rule, keys[start + i], ids[start + i], split[start + i], own.copy())
                    else:
                        star.add(ids[start + i], own)
        if star is not None:
            yield closed()

    split = (F.col("parts") > 1).alias("split")
    loads = stars.groupBy("star", "a").agg(F.ceil(F.greatest(F.count("*") / F.lit(float(PART_ROWS)), F.sum("n") / F.lit(float(PART_GRAMS)))).cast("int").alias("parts"))
    members = stars.drop("a").join(loads, "star").select("star", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b", F.lit(1).alias("member"), split)
    centres = loads.select("star", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("b"), F.lit(0).alias("member"), split)
    rows = members.unionByName(centres).join(texts.select(F.col("doc_id").alias("b"), "text").hint("merge"), "b")
    rows = rows.repartition("star", "part").sortWithinPartitions("star", "part", "member", "b").select("star", "part", "b", "split", "text")
    return rows.mapInArrow(run, "a long, b long, star long, n int, part int, loose boolean, grams array<long>")


def _stars(held: DataFrame, star: str) -> DataFrame:
    """(star, a, b, n): in each bucket its most central member a with every other one. ``held``: (key, rep, n, size), size that of the bucket.

    A star takes in all buckets of one centre (``star``: a), or one bucket (``star``: key).
    """
    central = held.groupBy("rep").agg(F.sum("size").alias("company"))
    most = F.max_by("rep", F.struct("company", F.bitwise_not("rep")))
    centres = held.select("key", "rep").join(central, "rep").groupBy("key").agg(most.alias("a"))
    return held.join(centres, "key").where("a != rep").groupBy(F.col(star).alias("star"), "a", F.col("rep").alias("b")).agg(F.max("n").alias("n"))


def _met(rows: DataFrame, *more: Column) -> DataFrame:
    """(key, size) of the buckets that hold several reps and meet the other conditions."""
    return rows.groupBy("key").agg(F.count("*").alias("size"), *(x.alias(f"c{i}") for i, x in enumerate(more))).where(" and ".join(["size > 1", *(f"c{i}" for i in range(len(more)))])).select("key", "size")


def _buckets(rows: DataFrame, *more: Column) -> DataFrame:
    """``rows`` of such buckets, with the size. ``rows`` is written already, and goes."""
    met = common.cut(_met(rows, *more), "shared")
    held = common.cut(rows.join(met.hint("merge"), "key"), "buckets")
    common.drop(met, rows)
    return held


def _links(held: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): links that join all that the documents' links join. ``held``: buckets of twos, with ``own``."""
    small, large = held.where(F.col("size") <= SMALL), held.where(F.col("size") > SMALL)
    stars = common.cut(_pairs(small, rule).withColumn("star", F.col("a")).unionByName(_stars(large, "a")), "stars")
    links = None
    while True:
        common.drop(held)
        compared = common.cut(_compared(stars, texts, rule), "compared")
        common.drop(stars)
        own = compared.where("grams is null").select("a", "b")
        links = own if links is None else links.unionByName(own)
        dealt = compared.where("grams is not null")
        if dealt.isEmpty():
            return links
        # What is not linked with its centre meets members of other tasks where both differ from the centre alike.
        whole = graph.components(links)
        open_ = dealt.groupBy("star").agg(F.max("loose").alias("loose")).where("loose").select("star")
        rows = dealt.join(open_, "star", "left_semi").select("star", F.col("b").alias("rep"), "n", "part", "loose", F.explode("grams").alias("gram"))
        rows = rows.join(whole.select(F.col("node").alias("rep"), "component"), "rep", "left")
        rows = common.cut(rows.select(F.xxhash64("star", "gram").alias("key"), "rep", "n", "part", "loose", F.coalesce("component", "rep").alias("whole")), "differences")
        held = _buckets(rows, F.max("loose"), F.min("part") != F.max("part"), F.min("whole") != F.max("whole"))
        if held.isEmpty():
            return links
        stars = common.cut(_stars(held, "key"), "stars")


def _grouped(one: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, whole (its component) of every document. Each doc_id stands once and is not null."""
    sets = common.cut(_sets(one, rule), "sets")
    some, same = sets.where("n > 0"), ["n", "s", "t"]
    firsts = some.groupBy(*same).agg(F.min("doc_id").alias("rep"))
    classes = some.join(firsts, same).select("doc_id", "n", "rep").unionByName(sets.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("rep")))
    classes = common.cut(classes, "classes")
    common.drop(sets)
    reps = classes.where("n > 0 and doc_id = rep").select("doc_id")
    blocks = common.cut(_blocks(one.join(reps.hint("merge"), "doc_id", "left_semi"), rule), "blocks")
    parts = graph.components(_links(_buckets(_twos(blocks), F.max("own")), one, rule))
    whole = classes.join(parts, classes["rep"] == parts["node"], "left")
    return whole.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("whole"))


def clusters(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; documents link at similarity num / den."""
    common.ship(docs.sparkSession)
    rows, numbered = common.row_keys(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    final = _grouped(rows.select(F.col("_row").alias("doc_id"), "text"), Rule(words, num, den))
    if not numbered:
        back = lambda c: F.nullif(F.col(c), F.lit(common.NULL_ID))
        return final.select(back("doc_id").alias("doc_id"), "n_shingles", back("whole").alias("component_id"))
    final = common.cut(final.select(F.col("doc_id").alias("_row"), "n_shingles", "whole"), "rows")
    names = rows.select("_row", "doc_id")
    firsts = final.select("whole").distinct().join(names.select(F.col("_row").alias("whole"), F.col("doc_id").alias("component_id")), "whole")
    return final.join(names, "_row").join(firsts, "whole").select("doc_id", "n_shingles", "component_id")


def kept(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The row, all columns, of one document of each component: the first by doc_id, then by text.

    A null doc_id sorts first. Documents without words stay each.
    """
    common.ship(docs.sparkSession)
    rows, _ = common.row_keys(docs)
    lost = _grouped(rows.select(F.col("_row").alias("doc_id"), "text"), Rule(words, num, den)).where("whole != doc_id").select(F.col("doc_id").alias("_row"))
    return rows.join(lost, "_row", "left_anti").select(docs.columns)
