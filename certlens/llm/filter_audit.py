"""How filters interact: which order of filters removes what, and what each filter
adds to the others, from decision diagrams over the documents' failure masks.

1. A document's failure mask has one bit for each filter. One pass over the texts
   gives the masks; the duplicate filter needs the smallest doc_id of each text,
   which is grouped and joined by digest (no text is shuffled).
2. Documents are counted by (part, mask) with map-side combining, so a part is at most
   ``2 ** filters`` rows from here on, however large or hot it is.
3. Each part's counts become an ordered decision diagram whose terminals are counts;
   equal subdiagrams are one node. All orders of the filters are visited by swaps of
   adjacent levels, one swap an order. In each order the all-pass path from the root
   gives the steps: at every level the failing branch is what the filter removes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certlens.llm.shared import keep

FILTERS = "ABCDE"
#: Fixed values of the five filters.
LEAST_WORDS = 50
LEAST_DISTINCT = 65
MOST_CAPITALS = 5
MARKS = "#$%&*|"
WHITE = "\t\n\x0b\x0c\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

Counts = tuple[int, ...]


class Diagram:
    """A decision diagram over failure bits with counts at its ends.

    ``order[i]`` is the filter that level i tests. A node of a level is a pair of
    nodes of the next one (pass, fail); below the last level stand count tuples. Equal
    nodes of a level are one, and every path has all levels, so a subdiagram's total
    is the sum of its branches'."""

    def __init__(self, counts: dict[int, Counts], width: int, filters: int):
        self.order = list(range(filters))
        self.zero = (0,) * width
        self.ends: list[Counts] = []
        self._end_ids: dict[Counts, int] = {}
        self.levels: list[list[tuple[int, int]]] = [[] for _ in self.order]
        row = [self._end(counts.get(m, self.zero)) for m in range(1 << filters)]
        # the mask's bit i is level i: the last level pairs masks that differ in the highest bit
        for level in reversed(range(filters)):
            half = 1 << level
            ids: dict[tuple[int, int], int] = {}
            row = [ids.setdefault((row[m], row[m | half]), len(ids)) for m in range(half)]
            self.levels[level] = list(ids)
        self.root = row[0]

    def _end(self, value: Counts) -> int:
        if value not in self._end_ids:
            self._end_ids[value] = len(self.ends)
            self.ends.append(value)
        return self._end_ids[value]

    def swap(self, level: int) -> None:
        """Let levels ``level`` and ``level + 1`` change places: only their nodes
        are made anew."""
        below = self.levels[level + 1]
        ids: dict[tuple[int, int], int] = {}
        upper = []
        for passed, failed in self.levels[level]:
            (pp, pf), (fp, ff) = below[passed], below[failed]
            upper.append((ids.setdefault((pp, fp), len(ids)), ids.setdefault((pf, ff), len(ids))))
        self.levels[level], self.levels[level + 1] = upper, list(ids)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def totals(self) -> list[list[Counts]]:
        """Counts below every node, level by level, and the ends last."""
        out = [self.ends]
        for nodes in reversed(self.levels):
            out.append([tuple(map(sum, zip(out[-1][p], out[-1][f]))) for p, f in nodes])
        return out[::-1]

    def steps(self) -> Iterator[tuple[int, Counts, Counts]]:
        """(filter, kept after it, removed by it) along the all-pass path."""
        totals, node = self.totals(), self.root
        for level, name in enumerate(self.order):
            passed, failed = self.levels[level][node]
            yield name, totals[level + 1][passed], totals[level + 1][failed]
            node = passed


def adjacent_swaps(n: int) -> Iterator[int]:
    """Places of adjacent swaps that visit every order of n things once: the last
    thing runs through the orders of the others, to and fro."""
    if n < 2:
        return
    down = True
    inner = adjacent_swaps(n - 1)
    while True:
        yield from (reversed(range(n - 1)) if down else range(n - 1))
        step = next(inner, None)
        if step is None:
            return
        # the running thing stands first after running down, and shifts the others by one
        yield step + 1 if down else step
        down = not down


def audit_counts(counts: dict[int, Counts], names: str) -> list[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley) of one part, for every order and step; the counts of a mask
    are (documents, good, toxic)."""
    n = len(names)
    diagram = Diagram(counts, 3, n)
    fails = [sum(c[0] for m, c in counts.items() if m >> i & 1) for i in range(n)]
    alone = [counts.get(1 << i, diagram.zero)[0] for i in range(n)]
    found = []
    swaps = adjacent_swaps(n)
    while True:
        order = "".join(names[i] for i in diagram.order)
        found.extend((order, step, name, kept, removed) for step, (name, kept, removed) in enumerate(diagram.steps(), 1))
        place = next(swaps, None)
        if place is None:
            break
        diagram.swap(place)
    shapley = [0] * n
    for _, _, name, _, removed in found:
        shapley[name] += removed[0]
    return [(order, step, kept[0], removed[0], fails[name] - removed[0], alone[name], removed[1], removed[2], shapley[name])
            for order, step, name, kept, removed in found]


def filter_fails(text: Column) -> dict[str, Column]:
    """The failure conditions of the filters that see one text only."""
    words = F.array_remove(F.split(F.translate(text, WHITE, " " * len(WHITE)), " "), "")
    # bound once: both counts of one list of words
    n = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    return {"counts": n, "C": 100 * (F.length(text) - F.length(F.translate(text, CAPITALS, ""))) > MOST_CAPITALS * F.length(text),
            "D": F.translate(text, MARKS, "") != text}


def failure_masks(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "source") -> DataFrame:
    """(doc_id, part, mask, good, toxic) for every row of ``docs``: bit i of the mask
    says that the document fails filter i of ``FILTERS``.

    A null text counts as empty, a null part as an empty string. A null doc_id has no
    labels and is no smaller and no larger than another, so it fails no filter E.
    Repeated rows count each; of a document's repeated labels, any 1 counts. Other
    columns of both tables are not looked at."""
    body = F.coalesce(F.col(text), F.lit(""))
    fails = filter_fails(body)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(body, 256)).alias("digest"),
                       fails["counts"].alias("n"), fails["C"].alias("c"), fails["D"].alias("d"))
    bits = (F.when(F.col("n.words") < LEAST_WORDS, 1).otherwise(0) + F.when(100 * F.col("n.distinct") < LEAST_DISTINCT * F.col("n.words"), 2).otherwise(0)
            + F.when(F.col("c"), 4).otherwise(0) + F.when(F.col("d"), 8).otherwise(0))
    slim = keep(slim.select("doc_id", "part", "digest", bits.alias("bits")), "audit-rows")
    first = slim.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")).filter("rows > 1").select("digest", "first")
    marks = labels.groupBy(F.col("doc_id").alias("labelled")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
                                                                  F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    rows = slim.join(first, "digest", "left").join(marks, F.col("doc_id") == F.col("labelled"), "left")
    copy = F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0)
    return rows.select("doc_id", "part", (F.col("bits") + copy).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


STEPS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(masks: DataFrame, names: str = FILTERS) -> DataFrame:
    """Of (part, mask, good, toxic) rows: for each part, order of the filters and
    step what is kept after it, removed by it, removed earlier though failing it
    (redundant), failing it alone (unique_fails), lost with good or toxic labels, and
    the filter's removals summed over all orders (shapley). Zeros are included; an
    empty table gives an empty result. A part is one row of at most ``2 ** filters``
    counts in one task."""
    counted = masks.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic"))
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = audit_counts({c["mask"]: (c["n"], c["good"], c["toxic"]) for c in counts}, names)
                columns = list(zip(*rows))
                kinds = [pa.string(), pa.int32(), *[pa.int64()] * 7]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *(pa.array(x, k) for x, k in zip(columns, kinds))],
                                                 names=[x.split()[0] for x in STEPS.split(", ")])

    return parts.mapInArrow(run, STEPS)
