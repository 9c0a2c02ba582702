"""Jaccard self-join of documents' word shingles by parity sketches, and its connected components.

Every shingle's hash is XORed into one word of a sketch (and flips one bit of a finer one), so two sketches differ in at
most as many words (bits) as the sets have shingles that are not shared. A pair that links has at most
d = (1 - t) / (1 + t) * (|A| + |B|) of those. Documents are dealt into bands of set size; within a band sketches have
more than d words, so a linked pair agrees in one word at least (pigeonhole): documents are joined on (band, place of
the word, its bits). Nothing is lost: a document also visits the next band if a partner may live there, and words that
no shingle fell in, which would join strangers, are left out only by documents that have so few of them that a linked
pair must share another word.

A linked pair agrees in several words as a rule: sketches have some more words than needed, and a document's own size
bounds what may differ from any partner. If all its partners share t + 1 words with it, its t commonest keys are not
needed: of the keys that two documents share the rarest is among none's t commonest. So keys of passages that very many
documents share make no groups.

Only what components need is verified, on the shingle sets themselves after folded sketches have ruled out what they
can, and never all pairs of a group:
1. documents with equal sets are one class;
2. in each group of equal keys the members are paired with the least one; per class the pair with most keys comes first,
   the rest only if their classes are still apart;
3. groups whose members are still in different components are compared in blocks by folded sketches; pairs that these
   cannot rule out are verified, again and again until none is left between components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvaspark.llm.common import discard, stored, stored_small
from silvaspark.llm.components import components
from silvaspark.llm.native import bitmap_of, maybe_in

U = np.uint64
STEP = 1.5  # ratio of a size band's ends
MORE = 8  # one word in so many is added to a sketch, so that common keys can be left out
BLOCK = 8192  # members of a group that are compared in one go: few groups are cut, so few rows are copied
FEWEST, FASTER = 4, 16  # pairs of a class with another component in the first round, and how many times as many in each next

_rng = np.random.default_rng(20240607)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[32, 9, 10, 11, 12, 13]] = True
BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U)
BYTE[IS_BLANK] = 0
BASE = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word (run of bytes other than ASCII white space), A-Z lower-cased."""
    b = LOWER[np.frombuffer(text, np.uint8)]
    inside = ~IS_BLANK[b]
    if not inside.any():
        return np.zeros(0, U)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    lengths = np.diff(np.append(starts, len(b)))
    offset = np.arange(starts[0], len(b)) - np.repeat(starts, lengths)
    powers = np.full(int(lengths.max()), BASE)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    return mix(np.add.reduceat(BYTE[b[starts[0] :]] * powers[offset], starts - starts[0]))


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``k`` words; of all words in a row if they are fewer; empty without."""
    w = word_hashes(text)
    n = len(w)
    if n == 0:
        return w
    width = min(k, n)
    h = np.zeros(n - width + 1, U)
    for j in range(width):
        h = (h + w[j : n - width + 1 + j] + U(j + 1)) * BASE
        h ^= h >> U(29)
    return np.unique(mix(h + U(width)))


class Bands:
    """Size bands of a threshold num / den, with the number of sketch words of each."""

    def __init__(self, num: int, den: int):
        if not den <= STEP * num <= STEP * den:
            raise ValueError(f"a similarity from {1 / STEP:.2f} to 1 is needed, so that partners live in neighbouring bands")
        self.num, self.den = num, den
        self.low = [1]
        while self.low[-1] < 1 << 40:
            self.low.append(max(self.low[-1] + 1, math.floor(self.low[-1] * STEP)))

    def most(self, a: int, b: int) -> int:
        """Largest symmetric difference of linked sets of these sizes."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def most_in(self, size: int, band: int) -> int:
        """Largest symmetric difference of a set of this size and one of the band that it links with."""
        return self.most(size, min(self.low[band + 1] - 1, size * self.den // self.num))

    def of(self, size: int) -> list[int]:
        """The band of a size, and the next if the set may link with one there."""
        band = int(np.searchsorted(self.low, size, "right")) - 1
        reach = size * self.den // self.num
        return [band, band + 1] if reach >= self.low[band + 1] else [band]

    def words(self, band: int) -> int:
        """Words of the band's sketches: more than a linked pair may differ in, by what words are empty by chance and some."""
        high = self.low[band + 1] - 1
        d = self.most(high, high)
        if d == 0:
            return 0  # only equal sets link here, and these are one class
        return d + 2 + math.ceil(1.5 * (d + 2) * math.exp(-self.low[band] / (d + 2))) + d // MORE


def xor_words(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the words of a sketch that hashes fall in; each hash is XORed into the word of its range.

    Hashes are sorted, so those of a word stand in a row.
    """
    place = ((hashes >> U(32)) * U(words)) >> U(32)
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return place[starts], np.bitwise_xor.reduceat(mix(hashes + U(3)), starts)


def keys_by_band(hashes: np.ndarray, bands: Bands) -> list[tuple[int, np.ndarray]]:
    """For each band of a set its join keys, one a word of its sketch, and how many of the commonest it may leave out.

    With a partner it differs in ``most_in`` words at most, so it agrees in all others. Words in which both are empty
    are not among its keys; a set with so many of them that no other word need agree has a key for these too.
    """
    out = []
    for band in bands.of(len(hashes)):
        words, most = bands.words(band), bands.most_in(len(hashes), band)
        if words and most:
            used, values = xor_words(hashes, words)
            spare = words - 1 - most - (words - len(used))
            if spare < 0:
                every = np.zeros(words, U)
                every[used.astype(np.int64)] = values
                used, values, spare = np.arange(words).astype(U), every, 0
            out.append((spare, mix(mix(values + np.full(1, band, U) * BASE) + used)))
    return out


def keys(hashes: np.ndarray, bands: Bands) -> np.ndarray:
    """All join keys of a set."""
    return np.concatenate([np.zeros(0, U), *(k for _, k in keys_by_band(hashes, bands))])


def identity(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    a, b = mix(hashes + U(1)), mix(hashes + U(2))
    return int(np.add.reduce(a).view(np.int64)), int(np.bitwise_xor.reduce(b).view(np.int64))


def folded(hashes: np.ndarray) -> bytes:
    """A sketch of 8 to 16 bits a shingle, its size a power of two: one half onto the other gives the smaller sketch."""
    bits = max(64, 1 << math.ceil(math.log2(8 * len(hashes))))
    place = (hashes >> U(20)) & U(bits - 1)
    return np.packbits((np.bincount(place.astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def fold_to(sketch: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


class ParityJoin:
    """One self-join of ``docs (doc_id, text)``; ``num / den`` is the least similarity that links.

    With ``every_link`` all candidate pairs of classes are verified, so that ``n_links`` is the number of other texts
    that a text is similar to; that grows with the square of a group of near copies, as the links themselves do.
    """

    def __init__(self, docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, every_link: bool = False):
        self.docs, self.k, self.num, self.den, self.every_link = docs.select("doc_id", "text"), k, num, den, every_link
        self.spark = docs.sparkSession

    def run(self) -> DataFrame:
        """Per row of ``docs``: ``doc_id, n_shingles, component_id, n_links`` (verified links that join components, or all).

        Null and blank texts have no shingle and link with nothing: their component is their own doc_id. Rows with a
        null doc_id do not link others, and get the component of documents with the same set, or null. Rows that
        repeat a doc_id are one document: whatever one of them links with belongs to all. Empty tables give no rows.
        """
        found = stored(self._named(), "join-sets")
        self.named = found.drop("bands")
        linkable = self.named.where("n_shingles > 0 and doc_id is not null")
        classes = linkable.groupBy("g1", "g2").agg(F.min("doc_id").alias("c"))
        again = linkable.join(classes, ["g1", "g2"]).where("doc_id <> c").select(F.col("c").alias("a"), F.col("doc_id").alias("b")).distinct()
        # a repeated doc_id ties its classes together
        repeated = linkable.groupBy("doc_id").agg(F.min("g1").alias("lo"), F.max("g1").alias("hi")).where("lo <> hi").select("doc_id")
        ties = again.join(repeated, F.col("b") == F.col("doc_id"), "left_semi")
        self.classes = stored(classes, "join-classes")
        members = self._members(found.where("doc_id is not null"))
        links = self._links(members)
        roots = components(links.select("a", "b").unionByName(ties))
        degree = links.select("a").unionByName(links.select(F.col("b").alias("a"))).groupBy("a").agg(F.count(F.lit(1)).alias("n_links"))
        c = self.classes.join(roots, F.col("c") == F.col("node"), "left").join(degree, F.col("c") == F.col("a"), "left")
        c = stored(c.select("g1", "g2", "c", F.coalesce("root", "c").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "join-roots")
        discard(members, self.sets, self.classes)
        out = self.named.join(c, ["g1", "g2"], "left")
        own = F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("doc_id"))
        return out.select("doc_id", "n_shingles", own.alias("component_id"), F.when(F.col("n_shingles") > 0, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).alias("n_links"))

    def _named(self) -> DataFrame:
        """Of each row the set's size and name, and per band its keys with how many of the commonest it may leave out."""
        k, num, den = self.k, self.num, self.den

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bands = Bands(num, den)
            for some in (batch.slice(lo, 1024) for batch in batches for lo in range(0, batch.num_rows, 1024)):
                names, in_bands, spares, in_keys, keyed = [], [0], [], [0], [np.zeros(0, U)]
                for t in some.column(1):
                    s = shingle_set((t.as_py() or "").encode(), k)
                    names.append((len(s), *(identity(s) if len(s) else (0, 0))))
                    for spare, own in keys_by_band(s, bands) if len(s) else ():
                        spares.append(spare)
                        keyed.append(own)
                        in_keys.append(in_keys[-1] + len(own))
                    in_bands.append(len(spares))
                lists = pa.ListArray.from_arrays(pa.array(in_keys, pa.int32()), pa.array(np.concatenate(keyed).view(np.int64)))
                both = pa.StructArray.from_arrays([pa.array(spares, pa.int32()), lists], names=["spare", "keys"])
                columns = [pa.array([x[i] for x in names], pa.int64()) for i in range(3)]
                yield pa.record_batch([some.column(0), *columns, pa.ListArray.from_arrays(pa.array(in_bands, pa.int32()), both)], names=["doc_id", "n_shingles", "g1", "g2", "bands"])

        return self.docs.mapInArrow(run, "doc_id long, n_shingles long, g1 long, g2 long, bands array<struct<spare: int, keys: array<bigint>>>")

    def _members(self, found: DataFrame) -> DataFrame:
        """``key, lead, c``: classes that share a key, and the least of them; without the commonest keys of each class."""
        keyed = found.select("g1", F.posexplode("bands").alias("band", "b")).select("g1", "band", "b.spare", F.explode("b.keys").alias("key"))
        shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("g1").alias("lo"), F.max("g1").alias("hi")).where("lo <> hi").select("key", "n")
        shared = stored(shared, "join-shared")
        bits = min(27, max(20, math.ceil(math.log2(16 * max(1, shared.count())))))
        met = keyed.where(maybe_in(F.col("key"), bitmap_of(shared, "key", bits), bits)).join(shared, "key")
        per_class = met.groupBy("g1", "band", "spare").agg(F.sort_array(F.collect_set(F.struct("n", "key"))).alias("keys"))
        kept = per_class.select("g1", F.explode(F.slice("keys", F.lit(1), F.greatest(F.lit(0), F.size("keys") - F.col("spare"))).getField("key")).alias("key"))
        kept = stored(kept.join(self.classes.select("g1", "c"), "g1").select("key", "c"), "join-kept")
        discard(shared)
        leads = kept.groupBy("key").agg(F.min("c").alias("lead"), F.max("c").alias("last")).where("lead <> last").select("key", "lead")
        members = stored(kept.join(leads, "key").select("key", "lead", "c"), "join-members")
        discard(kept)
        return members

    def _links(self, members: DataFrame) -> DataFrame:
        """Verified links ``a, b`` between classes: enough of them for the components, or with ``every_link`` all."""
        self.sets = self._sets(members.select("c").distinct())
        if self.every_link:
            a, b = members.select("key", F.col("c").alias("a")), members.select("key", F.col("c").alias("b"))
            return self._verified(a.join(b, "key").where("a < b").select("a", "b").distinct()).where("linked").select("a", "b")
        pairs = members.where("lead <> c").groupBy(F.col("lead").alias("a"), F.col("c").alias("b")).agg(F.count(F.lit(1)).alias("n"))
        pairs = stored(pairs, "join-pairs")
        done = self._verified(pairs.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")))
        roots = self._roots(done)
        rest = self._apart(pairs.select("a", "b").join(done.select("a", "b"), ["a", "b"], "left_anti"), roots)
        more = self._verified(rest)
        done = done.unionByName(more)
        tries = FEWEST
        while True:
            roots = self._roots(more, roots)
            found, cut = self._candidates(members, roots, tries)
            fresh = self._apart(found.join(done.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), roots)
            more = self._verified(fresh)
            if more.isEmpty() and not cut:
                return done.where("linked").select("a", "b")
            done = done.unionByName(more)
            tries *= FASTER

    @staticmethod
    def _roots(verified: DataFrame, before: DataFrame | None = None) -> DataFrame:
        """Components of the links among ``verified`` pairs and of what ``before`` has found."""
        links = verified.where("linked").select("a", "b")
        return components(links if before is None else links.unionByName(before.select(F.col("root").alias("a"), F.col("node").alias("b"))))

    def _sets(self, needed: DataFrame) -> DataFrame:
        """``c, n, shingles, sketch`` of the classes in ``needed``, from the texts of their first documents."""
        k = self.k
        needed = stored(needed, "join-needed")
        texts = self.docs.where(maybe_in(F.col("doc_id"), bitmap_of(needed, "c"))).join(needed, F.col("doc_id") == F.col("c"), "left_semi")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    some = batch.slice(lo, 256)
                    sets = [shingle_set((t.as_py() or "").encode(), k) for t in some.column(1)]
                    kept = [i for i, s in enumerate(sets) if len(s)]
                    ids = pa.array([some.column(0)[i].as_py() for i in kept], pa.int64())
                    yield pa.record_batch([ids, pa.array([len(sets[i]) for i in kept], pa.int64()), pa.array([sets[i].tobytes() for i in kept], pa.binary()), pa.array([folded(sets[i]) for i in kept], pa.binary())], names=["c", "n", "shingles", "sketch"])

        return stored(texts.mapInArrow(run, "c long, n long, shingles binary, sketch binary"), "join-class-sets")

    def _beside(self, pairs: DataFrame, column: str) -> DataFrame:
        """Pairs beside their sets' sizes and what ``column`` holds: ``a, b, na, nb, xa, xb``."""
        for side in ("b", "a"):  # a class is one b, as a rule, and a lead of many: its row goes to the pairs last
            own = self.sets
            if column == "shingles":
                own = own.where(maybe_in(F.col("c"), bitmap_of(pairs.select(side), side)))
            pairs = pairs.join(own.select(F.col("c").alias(side), F.col("n").alias("n" + side), F.col(column).alias("x" + side)), side)
        return pairs.select("a", "b", "na", "nb", "xa", "xb")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """``a, b, linked`` of each pair. Sketches rule out what they can, so that few sets have to move."""
        num, den = self.num, self.den

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                size = batch.column(2).to_numpy() + batch.column(3).to_numpy()
                apart = np.zeros(len(size), np.int64)
                for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                    x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                    words = min(len(x), len(y))
                    apart[i] = np.bitwise_count(fold_to(x, words) ^ fold_to(y, words)).sum()
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(apart * (den + num) <= (den - num) * size)], names=["a", "b", "near"])

        def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [similar(np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U), num, den) for x, y in zip(batch.column(4), batch.column(5), strict=True)]
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.bool_())], names=["a", "b", "linked"])

        fits = f"{den} * least(na, nb) >= {num} * greatest(na, nb)"
        pairs = stored(pairs.select("a", "b"), "join-asked")
        n = pairs.count()
        if n == 0:
            return pairs.select("a", "b", F.lit(False).alias("linked"))
        close = stored(self._beside(pairs, "sketch").where(fits).mapInArrow(near, "a long, b long, near boolean").where("near").select("a", "b"), "join-near")
        sure = self._beside(close, "shingles").mapInArrow(linked, "a long, b long, linked boolean").where("linked")
        return stored_small(pairs.join(sure, ["a", "b"], "left").select("a", "b", F.col("linked").isNotNull().alias("linked")), "join-verified", n)

    @staticmethod
    def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """The pairs whose classes are in different components."""
        a, b = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        return pairs.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")

    def _candidates(self, members: DataFrame, roots: DataFrame, tries: int) -> tuple[DataFrame, bool]:
        """Pairs ``a < b`` of classes in one group but different components that their sketches do not rule out.

        Of each class and other component the ``tries`` pairs of least sketch distance; also whether any was left out.
        Groups of two need no look, their one pair is that with the least member; of groups with the same members one
        is compared. Large groups are cut into blocks: what is outside the largest component meets all, block by block.
        """
        m = members.select("key", "c").join(roots, F.col("c") == F.col("node"), "left").select("key", "c", F.coalesce("root", "c").alias("root"))
        names = [F.bit_xor(F.xxhash64("c")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "c")).alias("x2")]
        groups = m.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), *names)
        per_key = groups.groupBy("key").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("roots"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
        open_ = per_key.where("roots > 1 and n > 2").select("key", "x1", "x2", F.col("main.root").alias("main"), "n", (F.col("n") - F.col("main.n")).alias("minor"))
        open_ = stored(open_.groupBy("n", "x1", "x2", "main", "minor").agg(F.min("key").alias("key")).drop("x1", "x2"), "join-open")
        if open_.isEmpty():
            return self.spark.createDataFrame([], "a long, b long"), False
        rows = m.join(open_, "key").join(self.sets.select("c", F.col("n").alias("size"), "sketch"), "c")
        blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
        own = lambda n: F.pmod(F.hash("c"), blocks(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
        columns = ("key", "c", "root", "size", "sketch")
        all_ = rows.select(*columns, own("n").alias("i"), each("minor").alias("j"), F.lit(False).alias("minor"))
        minor = rows.where("root <> main").select(*columns, each("n").alias("i"), own("minor").alias("j"), F.lit(True).alias("minor"))
        dealt = all_.unionByName(minor).select("key", "i", "j", "minor", "c", "root", "size", "sketch").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "minor")
        num, den = self.num, self.den

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bands, held = Bands(num, den), []
            for batch in batches:
                held.append(batch)
                table = pa.Table.from_batches(held).combine_chunks()
                place = np.stack([table[k].to_numpy() for k in ("key", "i", "j")])
                cuts = np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1
                if len(cuts):  # the last group may go on in the next batch
                    yield pairs_of(table.slice(0, int(cuts[-1])), cuts[:-1], bands, tries)
                    held = table.slice(int(cuts[-1])).combine_chunks().to_batches()
            if held:
                yield pairs_of(pa.Table.from_batches(held), np.zeros(0, int), bands, tries)

        found = dealt.mapInArrow(run, "a long, b long, cut boolean")
        found = stored(found.groupBy("a", "b").agg(F.max("cut").alias("cut")), "join-found")
        return found.select("a", "b"), not found.where("cut").isEmpty()


def pairs_of(rows: pa.Table, cuts: np.ndarray, bands: Bands, tries: int) -> pa.RecordBatch:
    """Candidate pairs of the groups that lie between ``cuts``; in each, all members come first, then those that seek."""
    seeks = rows["minor"].to_numpy()
    c, root, size = (rows[k].to_numpy() for k in ("c", "root", "size"))
    sketches = [np.frombuffer(x.as_buffer(), U) for x in rows["sketch"]]
    out: list[tuple[int, int, bool]] = []
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), rows.num_rows], strict=True):
        first = lo + int(np.count_nonzero(~seeks[lo:hi]))
        by_length: dict[int, list[int]] = {}
        for k in range(lo, first):
            by_length.setdefault(len(sketches[k]), []).append(k)
        stacks = {(n, n): np.array([sketches[k] for k in ks]) for n, ks in by_length.items()}
        for x in range(first, hi):
            near: dict[int, list[tuple[int, int]]] = {}
            for n, ks in by_length.items():
                words = min(n, len(sketches[x]))
                if (n, words) not in stacks:
                    stacks[n, words] = np.array([fold_to(sketches[k], words) for k in ks])
                at = np.array(ks)
                apart = np.bitwise_count(stacks[n, words] ^ fold_to(sketches[x], words)).sum(axis=1)
                fits = (root[at] != root[x]) & (bands.den * np.minimum(size[at], size[x]) >= bands.num * np.maximum(size[at], size[x]))
                fits &= apart * (bands.den + bands.num) <= (bands.den - bands.num) * (size[at] + size[x])
                for k, d in zip(at[fits].tolist(), apart[fits].tolist(), strict=True):
                    near.setdefault(int(root[k]), []).append((d, int(c[k])))
            for found in near.values():
                found.sort()
                out += [(min(int(c[x]), y), max(int(c[x]), y), len(found) > tries) for _, y in found[:tries]]
    a, b, cut = zip(*out, strict=True) if out else ((), (), ())
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(cut, pa.bool_())], names=["a", "b", "cut"])


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, every_link: bool = False) -> DataFrame:
    """Components of documents whose sets of ``k``-word shingles have a Jaccard similarity of ``num / den`` or more."""
    return ParityJoin(docs, k, num, den, every_link).run()


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` without near-duplicates, all columns as they are: of each component the least doc_id stays.

    Rows with a null doc_id, and those without words, stay. Only rows that may have to go are moved.
    """
    found = near_duplicates(docs, k, num, den)
    name = "gone" + "_" * max(map(len, docs.columns))  # like no column of docs
    gone = stored(found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct(), "join-gone")
    suspect = F.coalesce(maybe_in(F.col("doc_id"), bitmap_of(gone, name)), F.lit(False))
    return docs.where(~suspect).unionByName(docs.where(suspect).join(gone, F.col("doc_id") == F.col(name), "left_anti"))
