"""N-gram Jaccard join: rare-first prefix filtering with length, positional and
suffix filters, joined on prefix n-grams, verified once per pair.

Follows the published prefix-filter family (AllPairs, PPJoin, PPJoin+):

* A text is the set of its distinct ``N``-word shingles (64-bit hashes). Copies
  of one word sequence form a class, so they never meet as pairs.
* Rare first: a fixed-width count sketch over all documents orders the shingles
  by frequency. The order is the same for all, so the prefix filter stays exact;
  frequent passages go to the back of it and out of the prefixes.
* A class posts its first ``n - ceil(t n) + 1`` shingles; the first
  ``n - ceil(2t/(1+t) n) + 1`` of them also stand for pairs with larger classes.
* Within one shingle's postings pairs are not enumerated. Each posting meets the
  shingle's leader only. Round one verifies each class with the leader that shares
  most of its prefix, the next rounds with its leaders in other components and
  with new leaders (of one shingle, or of equal parities, see below), and the last round compares
  each class that is still apart from a leader with the members of other components
  there that have a size near its own. No link between components is lost; pairs
  inside one are skipped, as they change no component. Texts that share most of one
  template and don't link do meet there in pairs.
* Length, positional and suffix filters come before that; the suffix filter
  compares parities by hash range, a lower bound of the symmetric difference. Each
  distinct pair that passes is verified once, on its shingle sets.

Classes and shingles are 64-bit hashes: with 3e10 texts, a few dozen pairs of
different texts may share a class hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certlens.llm import sketch, words
from certlens.llm.components import contract
from certlens.llm.components import roots as roots_of
from certlens.llm.shared import free_name, BROADCAST_ROWS, discard, keep, keep_parts, short_batches, side

N = 5
#: Similarity as a fraction: intersection * DEN >= NUM * union.
NUM, DEN = 4, 5
RANGES = 1024
#: Star contractions after round one. What they leave apart is compared once more,
#: so they don't change the result; from then on whole components count.
ROUNDS = 1
#: Rounds with new leaders before the last round.
LEADER_ROUNDS = 3
#: The postings meet in so many shares of their shingles, one after the other: the
#: shuffle files of one share are on disk at once.
SHARES = 3
#: Pairs of one class that are verified together.
GROUP = 32

_ROWS = "cls long, n long, at long, prefix array<long>, spread array<long>"


def _sets(col: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Per row: index, class hash and the sorted set of shingle hashes (as
    uint64; empty for a text without words)."""
    data, offsets = words.buffers(col)
    is_word = words.white_space_class()
    for i, j in words.chunks(offsets):
        h, first = words.scan(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], is_word)
        whole = words.grams(h, n)
        position = words.mix(np.arange(len(h), dtype=np.uint64))
        for r in range(i, j):
            s, e = int(first[r - i]), int(first[r - i + 1])
            own = h[s:e]
            if e - s >= n:
                found = np.unique(whole[s : e - n + 1])
            elif e > s:
                found = words.grams(own, e - s)
            else:
                found = own[:0]
            cls = words.mix(np.uint64([np.sum(own * (position[: e - s] | np.uint64(1))) + np.uint64(e - s)]))[0] if e > s else np.uint64(0)
            yield r, cls, found


def _signed(x) -> np.ndarray:
    return np.asarray(x, dtype=np.uint64).view(np.int64)


def _prefix_rows(order: np.ndarray, n_words: int, text_at: int):
    """Class, set size, text hash, rare-first prefix and spread of each row. A
    copy that its own task has seen before posts no prefix again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            cls, sizes, lists, flat, spread, ends = [], [], [0], [], [], [0]
            for _, c, found in _sets(batch.column(text_at), n_words):
                c = int(_signed(c).reshape(1)[0])
                size = len(found)
                cls.append(c)
                sizes.append(size)
                if size and c not in seen:
                    seen.add(c)
                    rare = np.argsort(order[sketch.slot(found)], kind="stable")
                    flat.append(found[rare[: size - (NUM * size + DEN - 1) // DEN + 1]])
                    odd = np.bincount((found >> np.uint64(54)).astype(np.int64), minlength=RANGES) & 1
                    spread.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                    lists.append(lists[-1] + len(flat[-1]))
                else:
                    lists.append(lists[-1])
                ends.append(len(spread) * (RANGES // 64))
            posts = pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array(_signed(np.concatenate(flat)) if flat else np.zeros(0, np.int64)))
            spreads = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(spread) if spread else np.zeros(0, np.int64)), mask=pa.array(np.diff(ends) == 0, pa.bool_()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cls, pa.int64()), pa.array(sizes, pa.int64()), batch.column(text_at + 1), posts, spreads],
                names=["doc_id", "cls", "n", "at", "prefix", "spread"])

    return run


def _sketch_counts(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        counts = np.zeros(sketch.SLOTS, dtype=np.uint32)
        part: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for _, _, found in _sets(batch.column(0), n_words):
                part.append(found)
                held += len(found)
                if held > 500_000:
                    sketch.count(counts, np.concatenate(part))
                    part, held = [], 0
        if part:
            sketch.count(counts, np.concatenate(part))
        return counts

    return run


def _set_rows(n_words: int):
    """Text hash and packed sorted shingle set, once for each text of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            new = []
            for r, at in enumerate(batch.column(0).to_pylist()):
                if at not in seen:
                    seen.add(at)
                    new.append(r)
            some = batch.take(pa.array(new, pa.int64()))
            grams = [found.tobytes() for _, _, found in _sets(some.column(1), n_words)]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(grams, pa.binary())], names=["at", "grams"])

    return run


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one hub and salt, the hub's own first: which other classes link with it."""
    of, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        hubs, salts, classes = (batch.column(k).to_pylist() for k in range(3))
        a, b = [], []
        for hub, salt, cls, raw in zip(hubs, salts, classes, batch.column(3)):
            grams = np.frombuffer(raw.as_buffer(), np.uint64)
            if cls == hub:
                of, own = (hub, salt), grams.copy()
                continue
            assert of == (hub, salt)
            both = len(np.intersect1d(own, grams, assume_unique=True))
            if DEN * both >= NUM * (len(own) + len(grams) - both):
                a.append(min(hub, cls))
                b.append(max(hub, cls))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _need(x_n: Column, y_n: Column) -> Column:
    """The smallest intersection of a pair that links."""
    return F.floor((F.lit(NUM) * (x_n + y_n) + F.lit(NUM + DEN - 1)) / F.lit(NUM + DEN))


def _fits(x_cls: Column, x_n: Column, x_i: Column, y_cls: Column, y_n: Column, y_i: Column) -> Column:
    """Prefix, length and positional filter of a pair at one common shingle: the
    smaller one must post it for larger ones, the sizes must be near, and what
    stands behind the shingle must be enough."""
    smaller = (x_n < y_n) | ((x_n == y_n) & (x_cls < y_cls))
    small = F.least(x_n, y_n)
    lead = F.when(smaller, x_i).otherwise(y_i) < small - F.floor((2 * NUM * small + NUM + DEN - 1) / F.lit(NUM + DEN)) + 1
    return lead & _near_sizes(x_n, y_n) & (F.lit(1) + F.least(x_n - x_i - 1, y_n - y_i - 1) >= _need(x_n, y_n))


def _met(posts: DataFrame, among: DataFrame | None = None, turn: int = 0) -> DataFrame:
    """Every posting with the leader of its shingle: the class, of those in
    ``among``, that comes first in a random order which is the same for all
    shingles of this turn, so the classes of one group mostly meet the same few
    leaders. Returns gram, cls, n, i, l_cls, l_n, l_i of all postings whose shingle
    has a leader, but the leaders' own."""
    rank = F.col("cls") if turn == 0 else F.xxhash64("cls", F.lit(turn))
    place = F.shiftleft(F.col("n").cast("long"), 32) + F.col("i")
    first = F.min("cls") if turn == 0 else F.min_by("cls", rank)
    leaders = (posts if among is None else among).groupBy("gram").agg(first.alias("l_cls"), F.min_by(place, rank).alias("l_place"))
    met = posts.join(leaders, "gram").filter("cls != l_cls")
    low = F.col("l_place").bitwiseAND(F.lit((1 << 32) - 1))
    return met.select("gram", "cls", "n", "i", "l_cls", F.shiftright("l_place", 32).cast("int").alias("l_n"), low.cast("int").alias("l_i"))


def _near_sizes(x_n: Column, y_n: Column) -> Column:
    return F.lit(DEN) * F.least(x_n, y_n) >= F.lit(NUM) * F.greatest(x_n, y_n)


def _met_fits() -> Column:
    return _fits(*(F.col(c) for c in ("l_cls", "l_n", "l_i", "cls", "n", "i")))


def _apart(x: Column, y: Column) -> Column:
    """A lower bound of the symmetric difference: the hash ranges in which one
    set has an odd number of shingles and the other an even one."""
    words = RANGES // 64
    return reduce(lambda a, b: a + b, (F.bit_count(x[k].bitwiseXOR(y[k])) for k in range(words)))


def _verified(pairs: DataFrame, spread: DataFrame, docs: DataFrame, n_words: int) -> DataFrame:
    """Distinct pairs (a, b, hub: one of both) -> those that link: the suffix filter
    first, then the shingle sets of the classes that are left, from their texts. A
    set is sent once for each pair in which it is not the hub; hubs are sent once for
    about ``GROUP`` pairs, so no hub gathers all of its pairs in one task."""
    x, y = (spread.select(F.col("cls").alias(c), *(F.col(v).alias(f"{c}_{v}") for v in ("n", "at", "spread"))) for c in "ab")
    both_n = F.col("a_n") + F.col("b_n")
    near = pairs.join(x, "a").join(y, "b").filter(_apart(F.col("a_spread"), F.col("b_spread")) <= both_n - 2 * _need(F.col("a_n"), F.col("b_n")))
    first = F.col("hub") == F.col("a")

    def other(x: str, y: str) -> Column:
        return F.when(first, F.col(y)).otherwise(F.col(x))

    near = keep(near.select("hub", other("a", "b").alias("cls"), other("b_at", "a_at").alias("hub_at"), other("a_at", "b_at").alias("at")), "jaccard-near", True)
    rows = near.count()
    if not rows:
        return near.select(F.col("hub").alias("a"), F.col("cls").alias("b"))
    hubs = near.groupBy("hub", "hub_at").agg(F.ceil(F.count("*") / F.lit(GROUP)).alias("salts"))
    salt = F.pmod(F.xxhash64("cls"), F.col("salts")).alias("salt")
    asked = near.join(hubs.drop("hub_at"), "hub").select("hub", salt, "cls", "at").union(
        hubs.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("hub").alias("cls"), F.col("hub_at").alias("at")))
    wanted = near.select(F.explode(F.array("hub_at", "at")).alias("at")).distinct()
    wanted = F.broadcast(wanted) if 2 * rows <= BROADCAST_ROWS else wanted
    texts = docs.select(F.xxhash64("text").alias("at"), "text").join(wanted, "at", "left_semi").select("at", "text")
    sets = texts.mapInArrow(_set_rows(n_words), "at long, grams binary").dropDuplicates(["at"])
    met = asked.join(sets, "at").repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("cls") != F.col("hub"))
    links = keep(met.select("hub", "salt", "cls", "grams").mapInArrow(_linked, "a long, b long"), "jaccard-links", True)
    discard(near)
    return links


def jaccard_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n_words: int = N) -> tuple[DataFrame, DataFrame]:
    """(members, roots): members has doc_id, cls, n and at (the text's hash) for
    every row of ``docs``; roots has (id, root) for every class that links to a smaller one.

    Null, empty and white-space texts have n = 0 and link with nothing. Texts of
    fewer than ``n_words`` words are one shingle. Null ids stay null, repeated
    rows share a class; extra columns are not looked at. An empty table gives
    empty results."""
    with short_batches(docs.sparkSession):
        return _classes(docs, text, doc_id, n_words)


def _classes(docs: DataFrame, text: str, doc_id: str, n_words: int) -> tuple[DataFrame, DataFrame]:
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    order = sketch.gather(sketch.tasks(slim.select("text"), _sketch_counts(n_words)))
    shared = slim.sparkSession.sparkContext.broadcast(order)
    kind = slim.schema["doc_id"].dataType.simpleString()

    def prefix_rows(batches, n_words=n_words):
        return _prefix_rows(shared.value, n_words, 1)(batches)

    rows = keep(slim.select("doc_id", "text", F.xxhash64("text").alias("at")).mapInArrow(prefix_rows, f"doc_id {kind}, {_ROWS}"), "jaccard-rows", True)
    posts = rows.filter("spread is not null").select("cls", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("i", "gram"))
    spread = keep(rows.filter("spread is not null").select("cls", "n", "at", "spread").dropDuplicates(["cls"]), "jaccard-classes", True)
    shares = (posts.filter(F.pmod(F.shiftright("gram", 40), F.lit(SHARES)) == k) for k in range(SHARES))
    met = keep_parts([_met(share) for share in shares], "jaccard-met")
    members = keep(rows.select("doc_id", "cls", "n", "at"), "jaccard-members", True)
    discard(rows)
    pair = F.least("l_cls", "cls").alias("a"), F.greatest("l_cls", "cls").alias("b"), F.col("l_cls").alias("hub")
    ranges = spread.select("cls", "spread")

    def rooted(df: DataFrame, cls: str, root: str) -> DataFrame:
        names = roots.select(F.col("id").alias(cls), F.col("root").alias(root))
        return df.join(names, cls, "left").withColumn(root, F.coalesce(root, cls))

    def apart(df: DataFrame) -> DataFrame:
        return rooted(rooted(df, "cls", "c"), "l_cls", "l_c").filter("c != l_c")

    # round one: each class with the leader that shares most with it
    by_leader = keep(met.filter(_met_fits()).groupBy("l_cls", "cls").agg(F.count("*").alias("shared")), "jaccard-leaders", True)
    done = keep(by_leader.groupBy("cls").agg(F.max_by("l_cls", "shared").alias("l_cls")).select(*pair).dropDuplicates(["a", "b"]), "jaccard-pairs", True)
    links = contract(_verified(done, spread, slim, n_words), ROUNDS)
    roots = roots_of(links)
    # round two: the other leaders, where they are in another component; then new
    # leaders for all, from those that are still apart from their first one: among
    # equal parities of 64 hash ranges, which part copies from other texts with one
    # common passage, and of shingles
    posts = met.select("gram", "cls", "n", "i")
    bits = spread.select("cls", "n", F.posexplode("spread").alias("k", "bits")).filter(F.bit_count("bits") > 1)
    alike = keep(bits.join(posts.select("cls").distinct(), "cls", "left_semi").select(F.xxhash64("k", "bits").alias("gram"), "cls", "n", F.lit(0).alias("i")), "jaccard-alike", True)
    for turn in range(1 + LEADER_ROUNDS):
        met_by_pair = by_leader
        if turn:
            by = alike if turn % 2 else posts
            meet = _met(by, by.join(apart(met).select("cls").distinct(), "cls", "left_semi"), turn)
            met_by_pair = meet.filter(_near_sizes(F.col("n"), F.col("l_n")) if turn % 2 else _met_fits()).select("l_cls", "cls").distinct()
        new = keep(apart(met_by_pair).select(*pair).dropDuplicates(["a", "b"]).join(done, ["a", "b"], "left_anti"), "jaccard-pairs", True)
        done = done.union(new)
        links = contract(links.union(_verified(new, spread, slim, n_words)))
        roots = roots_of(links)
    # last round: what is still apart from its first leader, with all other
    # components of its shingle, in bands of sizes that may link
    band = F.floor(F.log("n") / F.lit(math.log(DEN / NUM) * 1.01))
    named = keep(rooted(rooted(met, "cls", "c"), "l_cls", "l_c").withColumn("band", band), "jaccard-named", True)
    still = named.filter("c != l_c").select("gram", "cls", "n", "i", "c", "band")
    others = named.join(still.select("gram").distinct(), "gram", "left_semi").select("gram", "cls", "n", "i", "c", "band").join(ranges, "cls")
    still = still.withColumn("band", F.explode(F.array(*(F.col("band") + k for k in (-1, 0, 1)))))
    u, o = ([F.col(f"{side_}.{c}") for c in ("cls", "n", "i", "c", "spread")] for side_ in "uo")
    near = _apart(u[4], o[4]) <= u[1] + o[1] - 2 * _need(u[1], o[1])
    same = (F.col("u.gram") == F.col("o.gram")) & (F.col("u.band") == F.col("o.band"))
    rest = still.join(ranges, "cls").alias("u").join(others.alias("o"), same & (u[3] != o[3]) & _fits(*u[:3], *o[:3]) & near)
    last = rest.select(F.least(u[0], o[0]).alias("a"), F.greatest(u[0], o[0]).alias("b"), u[0].alias("hub")).dropDuplicates(["a", "b"])
    last = keep(last.join(done, ["a", "b"], "left_anti"), "jaccard-pairs", True)
    discard(met, by_leader, alike, named)
    links = contract(links.union(_verified(last, spread, slim, n_words)))
    return members, roots_of(links)


def jaccard_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n_words: int = N) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by
    links of similarity 4/5 or more) for every row of ``docs``. Rows with n = 0
    have their own doc_id; null ids count for no minimum (a component of null
    ids only has a null component_id)."""
    members, roots = jaccard_classes(docs, text, doc_id, n_words)
    least = members.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    in_class = least.join(roots, least.cls == roots.id, "left").select("cls", "least", F.coalesce("root", "cls").alias("root"))
    by_root = in_class.groupBy("root").agg(F.min("least").alias("component_id"))
    named = in_class.join(by_root, "root").select("cls", "component_id")
    joined = members.join(named, "cls", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n_words: int = N) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: one row of each component
    stays, the one with the smallest doc_id (null last), then text hash; rows
    without words all stay. All columns are kept."""
    members, roots = jaccard_classes(docs, text, doc_id, n_words)
    with_root = members.filter("n > 0").join(roots, members.cls == roots.id, "left").select("doc_id", "at", F.coalesce("root", "cls").alias("root"))
    counted = keep(with_root.groupBy("root", "doc_id", "at").agg(F.count("*").alias("times")), "jaccard-counted", True)
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("at"))
    best = counted.groupBy("root").agg(F.min(rank).alias("best"), F.sum("times").alias("all"))
    chosen = counted.join(best.filter("all > 1"), "root").withColumn("stays", rank == F.col("best"))
    gone = keep(chosen.filter(~F.col("stays")).select("doc_id", "at"), "jaccard-gone", True)
    repeated = keep(chosen.filter(F.col("stays") & (F.col("times") > 1)).select("doc_id", "at"), "jaccard-repeated", True)

    of_id, of_text = free_name(docs, "jaccard_id"), free_name(docs, "jaccard_text")

    def matches(df: DataFrame, how: str, left: DataFrame) -> DataFrame:
        keys = side(df.select(F.col("doc_id").alias(of_id), F.col("at").alias(of_text)))
        return left.join(keys, left[doc_id].eqNullSafe(F.col(of_id)) & (F.xxhash64(left[text]) == F.col(of_text)), how)

    once = matches(repeated, "left_semi", docs).dropDuplicates([doc_id, text])
    return matches(gone.union(repeated), "left_anti", docs).unionByName(once)
