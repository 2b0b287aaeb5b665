"""Jaccard self-join of word n-gram sets: a size-aware heavy-light join.

A document's set is that of its distinct shingles, each a 64-bit hash.  All
shingles stand in one global order, frequent ones last.  If two sets of n
elements overlap enough, the first n - need(n) + c elements of each share c.
So light (small) sets meet by the subsets of c = 2 elements of that prefix;
heavy (large) sets scan the inverted lists of the elements of theirs (c = 1).
The size that parts them is where the estimated cost is least.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probeline.llm.common import release, small_batches, spill
from probeline.llm.components import components
from probeline.llm.wordcore import SPACE, Words, mix, slices, window_hashes

#: Elements of one task's sets that are counted together; one that so many of these sets hold is frequent.
CHUNK, FREQUENT = 1_500_000, 2
#: Frequent elements that are broadcast, at most (12 bytes each). They only order; the result doesn't depend on them.
FREQUENT_MOST = 1 << 20
#: Heads that a list has in each round, before what is still apart is joined in pairs; rounds after the first are for lists of more than WORTH times as many sets.
HEADS, WORTH = (1, 32, 512), 4
#: Sets in lists of more sets than this have a signature of so many words of 64 parities; it parts sets of up to some 2.2 times as many elements as it has bits.
SIGNED, SIGN_WORDS = 16, 16
#: Light sets have at most so many elements, whatever the costs.
LIGHT_MOST = 256
#: Cost of meeting one entry of an inverted list, in emitted keys.
MEET_COST = 2.0
#: Frequent elements from so many sets on have their lists dealt over several tasks.
LONG_LIST, LIST_PARTS = 1 << 16, 64

_U = np.uint64


def need(n: int | np.ndarray, percent: int):
    """The least overlap that a set of n elements has with a partner."""
    return (percent * n + 99) // 100


def shingle_sets(batch: pa.RecordBatch, column: str, words_in: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle, without words none."""
    words = Words(batch.column(batch.schema.get_field_index(column)), SPACE)
    hashes = words.hashes()
    windows = window_hashes(hashes, words_in)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        out.append(np.unique(windows[a : b - words_in + 1]) if b - a >= words_in else window_hashes(hashes[a:b], b - a) if b > a else windows[:0])
    return out


def set_id(elements: np.ndarray) -> int:
    """A hash of a whole set, as a signed long."""
    if not len(elements):
        return 0
    n = np.array([len(elements)], _U)
    return int(mix(mix(elements ^ n * _U(0x9E3779B97F4A7C15)).sum(keepdims=True, dtype=_U) ^ n)[0].astype(np.int64))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == _U else x.astype(np.int64)


_MEASURE = pa.schema([("kind", pa.int8()), ("doc", pa.int64()), ("n", pa.int64()), ("sid", pa.int64())])


def _measure(words_in: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """kind 0: a document, its set's size and id; 1: the key of a frequent element of a chunk (sid) and how many sets hold it (n)."""

    def chunk(sets: list[np.ndarray]) -> pa.RecordBatch:
        every, count = np.unique(np.concatenate(sets), return_counts=True)
        often = count >= FREQUENT
        k = int(often.sum())
        keys = _signed(element_keys(every[often]))
        return pa.RecordBatch.from_arrays([pa.array([1] * k, pa.int8()), pa.nulls(k, pa.int64()), pa.array(count[often].astype(np.int64)), pa.array(keys)], schema=_MEASURE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # equal sets count once
        size = 0
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets(batch, "text", words_in)
                ids = [set_id(x) for x in sets]
                yield pa.RecordBatch.from_arrays([
                    pa.array([0] * len(sets), pa.int8()), batch.column(batch.schema.get_field_index("doc")), pa.array([len(x) for x in sets], pa.int64()), pa.array(ids, pa.int64()),
                ], schema=_MEASURE)
                for i, x in zip(ids, sets, strict=True):
                    if len(x) and i not in held:
                        held[i] = x
                        size += len(x)
                if size >= CHUNK:
                    yield chunk([*held.values()])
                    held, size = {}, 0
        if held:
            yield chunk([*held.values()])

    return run


def element_keys(elements: np.ndarray) -> np.ndarray:
    """The keys of single elements, by which heavy sets meet."""
    return mix(elements + _U(3))


@dataclass
class _Order:
    """The keys of frequent elements (sorted), the place of each after all others, and which of them have long lists."""

    frequent: np.ndarray
    place: np.ndarray
    long: np.ndarray
    percent: int
    light: int

    def prefix(self, elements: np.ndarray, length: int) -> np.ndarray:
        """The first elements of a sorted set in the global order."""
        if not len(self.frequent):
            return elements[:length]
        keys = element_keys(elements)
        at = np.minimum(np.searchsorted(self.frequent, keys), len(self.frequent) - 1)
        often = self.frequent[at] == keys
        rare = elements[~often]
        if len(rare) >= length:
            return rare[:length]
        return np.concatenate([rare, elements[often][np.argsort(self.place[at[often]], kind="stable")][: length - len(rare)]])

    def keys(self, elements: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What a set meets others by, and the overlap that a partner can have at most if a key is the first that both have.

        Light sets emit pairs of elements; heavy ones, and light ones that are
        large enough to link with heavy ones, emit elements.
        """
        n = len(elements)
        spare = n - need(n, self.percent)
        out, most = [], []
        if 1 < n <= self.light:
            first = self.prefix(elements, spare + 2)
            i, j = np.triu_indices(len(first), 1)
            pair = np.sort(np.stack([first[i], first[j]]), axis=0)
            out.append(mix(mix(pair[0]) + pair[1] * _U(0x9E3779B97F4A7C15) + _U(2)))
            most.append(n - j + 1)
        if n > self.light or 100 * n >= self.percent * (self.light + 1):
            out.append(element_keys(self.prefix(elements, spare + 1)))
            most.append(n - np.arange(len(out[-1])))
        return np.concatenate([elements[:0], *out]), np.concatenate([np.zeros(0, np.int64), *most])

    def parts(self, keys: np.ndarray, sid: int) -> np.ndarray:
        """0 for most keys; where a list is known to be long, one of LIST_PARTS parts of it."""
        if not len(self.long):
            return np.zeros(len(keys), np.int16)
        at = np.minimum(np.searchsorted(self.long, keys), len(self.long) - 1)
        return np.where(self.long[at] == keys, 1 + sid % LIST_PARTS, 0).astype(np.int16)


_KEYS = pa.schema([("key", pa.int64()), ("part", pa.int16()), ("n", pa.int32()), ("most", pa.int32()), ("sid", pa.int64())])
_KEYS_DDL = "key long, part short, n int, most int, sid long"


def _emit(order: Broadcast, words_in: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = order.value
        done: set[int] = set()  # equal sets of a task go once
        for whole in batches:
            for batch in slices(whole, "text"):
                keys, parts, most, ids, sizes = [], [], [], [], []
                for x in shingle_sets(batch, "text", words_in):
                    if len(x) and (i := set_id(x)) not in done:
                        done.add(i)
                        own, rest = known.keys(x)
                        keys.append(own)
                        most.append(rest)
                        parts.append(known.parts(own, i))
                        ids.append(i)
                        sizes.append(len(x))
                if keys:
                    times = [len(k) for k in keys]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(_signed(np.concatenate(keys))), pa.array(np.concatenate(parts)), pa.array(np.repeat(np.array(sizes, np.int32), times)),
                        pa.array(np.concatenate(most).astype(np.int32)), pa.array(np.repeat(np.array(ids, np.int64), times)),
                    ], schema=_KEYS)

    return run


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, part and set: those of keys that several sets have (parts of long lists all), each set once.

    Rows stream; a list of any length is never held.
    """
    last: tuple[np.ndarray, ...] | None = None  # the row before
    shown = False  # it is out already
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        if last is not None:  # the row before goes in front, so that every row has its neighbours but the last
            rows = [np.concatenate([x, y]) for x, y in zip(last, rows, strict=True)]
        key, part, _, _, sid = rows
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
        rows = key, part, n, most, sid = [x[new] for x in rows]
        alike = np.zeros(len(key) + 1, bool)
        alike[1:-1] = key[1:] == key[:-1]
        here = alike[:-1] | alike[1:] | (part > 0)
        if last is not None and shown:
            here[0] = False
        # the last row waits only if it stands alone so far
        shown = bool(here[-1]) or (len(key) == 1 and shown)
        last = tuple(x[-1:] for x in rows)
        if here.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[here]) for x in rows], schema=_KEYS)


#: Ids that are broadcast, at most; more are joined by a shuffle.
BROADCAST_IDS = 400_000

_SETS = pa.schema([("sid", pa.int64()), ("elements", pa.binary())])


def _sets(words_in: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = {i: x for x in shingle_sets(batch, "text", words_in) if (i := set_id(x)) not in done}
                done.update(sets)
                yield pa.RecordBatch.from_arrays([pa.array([*sets], pa.int64()), pa.array([x.tobytes() for x in sets.values()], pa.binary())], schema=_SETS)

    return run


_SIGNS_DDL = "sid long, sign array<long>"
_SIGNS = pa.schema([("sid", pa.int64()), ("sign", pa.list_(pa.int64()))])


def signature(elements: np.ndarray) -> np.ndarray:
    """Whether each class of elements occurs an odd number of times, 64 classes a word; an element that only one of two sets has changes one bit at most."""
    classes = (mix(elements + _U(5)) % _U(64 * SIGN_WORDS)).astype(np.int64)
    return np.packbits((np.bincount(classes, minlength=64 * SIGN_WORDS) & 1).astype(np.uint8)).view(np.int64)


def _signs(words_in: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = {set_id(x): x for x in shingle_sets(batch, "text", words_in)}
                yield pa.RecordBatch.from_arrays([pa.array([*sets], pa.int64()), pa.array([signature(x).tolist() for x in sets.values()], pa.list_(pa.int64()))], schema=_SIGNS)

    return run


def _linked(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(z.as_buffer(), _U) for z in (x, y))
                at = np.searchsorted(q, p)
                same = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                keep.append(100 * same >= percent * (len(p) + len(q) - same))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

    return run


def light_boundary(sizes: dict[int, int], heavier: int, meets: float, percent: int) -> int:
    """The largest size of light sets that makes the join cheapest.

    sizes: how many sets there are of each size up to LIGHT_MOST; heavier adds
    the same to every choice.  Light sets emit pairs of their prefix; sets from
    percent of the boundary on emit elements, each of which meets `meets`
    others on average.
    """

    def cost(x: int) -> float:
        total = 0.0
        for n, count in sizes.items():
            spare = n - need(n, percent)
            if n <= x:
                total += count * (spare + 2) * (spare + 1) / 2
            if n > x or 100 * n >= percent * (x + 1):
                total += count * (spare + 1) * (1 + MEET_COST * meets)
        return total + heavier

    return min(range(LIGHT_MOST + 1), key=lambda x: (cost(x), x))


@dataclass
class JaccardJoin:
    """documents: doc, n_shingles, sid; links: pairs (a, b) of different sets' ids; reps: sid and its smallest doc."""

    documents: DataFrame
    reps: DataFrame
    links: DataFrame
    light: int


def _key_of(id_col: str):
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)).cast("long"))


def jaccard_links(docs: DataFrame, words_in: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> JaccardJoin:
    """Links between different shingle sets, 100 * intersection >= percent * union, enough to give every component.

    Equal sets are one from the start.  Sets that share a key form its list.  In
    each round every list has some heads; each set is compared with as many of
    them, those that it meets most often, of lists in which it is still apart
    from them.
    Sets that are found linked are in one component from then on, and only pairs
    of different components are compared at last: so a group of near copies
    costs some times as many comparisons as it has members, not their square.
    Sets in long lists have a signature, which lets only those meet that may link
    by it; so unlike sets that share a passage cost few comparisons either.
    A pair meets only under keys at which, were they the first that both have,
    the rest of either set could still overlap enough.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(_key_of(id_col).alias("doc"), F.col(text_col).alias("text"))
    measured = spill(rows.mapInArrow(_measure(words_in), "kind byte, doc long, n long, sid long"), "shingle-sets")
    documents = measured.where("kind = 0").select("doc", "n", "sid")
    reps = spill(measured.where("kind = 0 and n > 0").groupBy("sid").agg(F.min("doc").alias("doc"), F.min("n").alias("n")), "set-reps")
    often = spill(measured.where("kind = 1").groupBy(F.col("sid").alias("key")).agg(F.sum("n").alias("n")), "frequent-elements")

    # the least count that no more than FREQUENT_MOST elements reach, by powers of 2
    room, least = FREQUENT_MOST, FREQUENT
    for size, elements in sorted(((r.size, r.elements) for r in often.groupBy(F.floor(F.log2("n")).cast("int").alias("size")).agg(F.count("*").alias("elements")).collect()), reverse=True):
        if elements > room:
            least = 2 ** (size + 1)
            break
        room -= elements
    table = often.where(F.col("n") >= least).toArrow().sort_by([("n", "descending"), ("key", "ascending")])
    frequent = table["key"].to_numpy().view(_U)
    by_hash = np.argsort(frequent)
    long = np.sort(frequent[table["n"].to_numpy() >= LONG_LIST])
    # how many others an entry of a list meets, on average over all entries that aren't frequent
    entries = reps.agg(F.sum("n")).first()[0] or 1
    meets = (often.where(F.col("n") < least).agg(F.sum(F.col("n") * (F.col("n") - 1))).first()[0] or 0) / entries
    # one row a size, LIGHT_MOST at most
    sizes = {r.n: r["count"] for r in reps.where(F.col("n") <= LIGHT_MOST).groupBy("n").count().collect()}
    light = light_boundary(sizes, 0, meets, percent)
    order = spark.sparkContext.broadcast(_Order(frequent[by_hash], (len(frequent) - np.arange(len(frequent)))[by_hash].astype(np.int32), long, percent, light))
    release(often)

    keys = rows.select("text").mapInArrow(_emit(order, words_in), _KEYS_DDL)
    sorted_keys = keys.repartition("key", "part").sortWithinPartitions("key", "part", "sid")
    lists = spill(sorted_keys.mapInArrow(_lists, _KEYS_DDL).drop("part"), "inverted-lists")
    start = lists.withColumn("root", F.col("sid"))

    def apart(p: str, q: str) -> Column:
        """Of different components, of sizes that may link, and with enough left behind the key."""
        a, b = (lambda x: F.col(f"{p}.{x}")), (lambda x: F.col(f"{q}.{x}"))
        return (
            (a("root") != b("root")) & (F.greatest(a("n"), b("n")) * percent <= F.least(a("n"), b("n")) * 100)
            & (F.least(a("most"), b("most")) * (100 + percent) >= (a("n") + b("n")) * percent)
        )

    def like(p: str, q: str) -> Column:
        """Signatures don't differ by more than the elements that one of two linked sets lacks."""
        bits = [F.bit_count(F.col(f"{p}.sign")[i].bitwiseXOR(F.col(f"{q}.sign")[i])) for i in range(SIGN_WORDS)]
        return sum(bits[1:], bits[0]) * (100 + percent) <= (F.col(f"{p}.n") + F.col(f"{q}.n")) * (100 - percent)

    links = tested = roots = None
    made: list[DataFrame] = []

    def untested(pairs: DataFrame) -> DataFrame:
        return pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")

    def compare(pairs: DataFrame) -> bool:
        """Adds the links among the pairs; whether there were any pairs."""
        nonlocal links, tested
        pairs = spill(pairs, "pairs")
        made.append(pairs)
        if pairs.isEmpty():
            return False
        found = _verify(rows, reps, pairs, words_in, percent)
        links = found if links is None else links.unionByName(found)
        tested = pairs if tested is None else tested.unionByName(pairs)
        return True

    def place(lists: DataFrame) -> DataFrame:
        return lists.drop("root").join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))

    def ends(lists: DataFrame) -> DataFrame:
        """The lists that have several roots."""
        return lists.groupBy("key").agg(F.count("*").alias("length"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")

    def regroup(lists: DataFrame) -> DataFrame:
        """What is left of the lists under the links so far."""
        nonlocal roots
        if roots is not None:
            release(roots)
        # not settled in so few turns, but what has one root is in one component
        roots = components(links, turns=1)
        placed = spill(place(lists), "placed-lists")
        left = spill(placed.join(ends(placed).select("key"), "key", "left_semi"), "open-lists")
        release(placed)
        made.append(left)
        return left

    def vote(lists: DataFrame, heads: DataFrame, picks: int, met: Column) -> DataFrame:
        """Each set with the heads that it meets most often."""
        pair = [F.least("sid", "other").alias("a"), F.greatest("sid", "other").alias("b")]
        both = lists.alias("p").join(heads.alias("q"), (F.col("p.key") == F.col("q.key")) & met)
        votes = both.groupBy(F.col("p.sid").alias("sid"), F.col("q.sid").alias("other")).agg(F.count("*").alias("votes")).select("sid", "votes", "other", *pair)
        best = F.slice(F.sort_array(F.collect_list(F.struct("votes", "a", "b")), asc=False), 1, picks)
        return untested(votes).groupBy("sid").agg(best.alias("best")).select(F.explode("best").alias("x")).select("x.a", "x.b").distinct()

    def chance(turn: int) -> Column:
        return F.pmod(F.xxhash64("sid", F.lit(turn)), F.lit(1 << 31))

    # the set with the fewest rarer elements before the key
    row = F.struct((F.col("most") - F.col("n")).alias("place"), chance(0).alias("chance"), "sid", "n", "most", "root")
    heads = start.groupBy("key").agg(F.max(row).alias("h"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key", "h.*")
    open_ = regroup(start) if compare(vote(start, heads, HEADS[0], apart("p", "q"))) else start
    placed_by = roots

    # most of the many sets of a longer list share a passage only, which their signatures show
    short, long_lists = [open_], []
    lengths = spill(ends(open_).where(F.col("length") > SIGNED).select("key", "length"), "long-keys")
    made.append(lengths)
    if not lengths.isEmpty():
        short = [open_.join(lengths, "key", "left_anti")]
        open_ = open_.join(lengths.select("key"), "key", "left_semi")
        signs = _of_sets(rows, reps, open_.select("sid").distinct(), _signs(words_in), _SIGNS_DDL).dropDuplicates(["sid"])
        open_ = spill(open_.join(signs, "sid"), "long-lists")
        made.append(open_)
        for turn, picks in enumerate(HEADS[1:], 1):
            longest = spill(ends(open_).where(F.col("length") > WORTH * picks).select("key", "length"), "long-keys")
            made.append(longest)
            if longest.isEmpty():
                break
            long_lists.append(open_.join(longest, "key", "left_anti"))
            open_ = open_.join(longest.select("key"), "key", "left_semi")
            # about `picks` sets of each list, by chance, but the same in many lists
            heads = open_.join(longest, "key").where(chance(turn) * F.col("length") < picks * (1 << 31))
            if compare(vote(open_, heads, picks, apart("p", "q") & like("p", "q"))):
                open_ = regroup(open_)
        long_lists.append(open_)

    pairs = None
    for parts, met in ((short, apart("p", "q")), (long_lists, apart("p", "q") & like("p", "q"))):
        for part in parts:
            part = part if roots is placed_by else place(part)
            both = part.alias("p").join(part.alias("q"), (F.col("p.key") == F.col("q.key")) & (F.col("p.sid") < F.col("q.sid")) & met)
            both = both.select(F.col("p.sid").alias("a"), F.col("q.sid").alias("b"))
            pairs = both if pairs is None else pairs.unionByName(both)
    compare(untested(pairs.distinct()))
    release(lists, *made, *([] if roots is None else [roots]))
    if links is None:
        links = spark.createDataFrame([], "a long, b long")
    return JaccardJoin(documents, reps, links, light)


def _of_sets(rows: DataFrame, reps: DataFrame, sids: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    """What run, which gets texts, says of the sets sids; a set may come more than once."""
    sids = spill(sids, "pair-ids")
    few = sids.count() <= BROADCAST_IDS
    wanted = reps.join(F.broadcast(sids) if few else sids, "sid").select("doc").distinct()
    texts = rows.join(F.broadcast(wanted) if few else wanted, "doc", "left_semi").select("text")
    out = spill(texts.mapInArrow(run, ddl).join(F.broadcast(sids) if few else sids, "sid", "left_semi"), "pair-sets")
    release(sids)
    return out


def _verify(rows: DataFrame, reps: DataFrame, pairs: DataFrame, words_in: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that link, by their whole sets."""
    sets = _of_sets(rows, reps, pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), _sets(words_in), "sid long, elements binary")
    both = pairs.join(sets.toDF("a", "elements_a"), "a").join(sets.toDF("b", "elements_b"), "b").select("a", "b", "elements_a", "elements_b")
    out = spill(both.mapInArrow(_linked(percent), "a long, b long").distinct(), "links")
    release(sets)
    return out


def jaccard_components(docs: DataFrame, words_in: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id column, n_shingles, component_id (the smallest id that links reach, its own included).

    Words are runs of anything but white space `[\\x20\\x09-\\x0D]`, A-Z lower-cased.
    A text of fewer words than a shingle has is one shingle; a null text, or one
    without words, has none and links with nothing.  Rows of equal sets are
    linked.  A null id is in no component_id unless all ids of the component
    are null; repeated rows stay; extra columns are ignored.
    """
    join = jaccard_links(docs, words_in, percent, id_col, text_col)
    null = F.lit(-(2**63)).cast("long")
    roots = components(join.links)
    named = join.reps.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("sid", F.coalesce("root", "sid").alias("root"), F.when(F.col("doc") != null, F.col("doc")).alias("doc"))
    # the smallest id that isn't null: of each set, then of each component
    own = join.documents.where((F.col("n") > 0) & (F.col("doc") != null)).groupBy("sid").agg(F.min("doc").alias("least"))
    named = named.drop("doc").join(own, "sid", "left")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.select("sid", "root").join(least, "root").select("sid", "component_id")
    real = F.when(F.col("doc") != null, F.col("doc"))
    full = join.documents.where("n > 0").join(labels, "sid", "left").select(real.alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    bare = join.documents.where("n = 0").select(real.alias(id_col), F.col("n").alias("n_shingles"), real.alias("component_id"))
    return full.unionByName(bare)
