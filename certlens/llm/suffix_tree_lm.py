"""Language-model scoring with a probabilistic suffix tree over words.

Learning (all documents that are not held out): exact counts of all tokens and of
the grams of 2, 3, ... words (each with a start mark before and an end token after
the text) that occur at least ``LEAST`` times, whatever the size of the corpus.

A context (the last words) holds the next symbols seen with it that often, with
absolute discounting; the rest of its mass goes to the distribution of its parent
(one word shorter; the root is the add-one unigram distribution over the whole
vocabulary). Divergence test: a context is retained if predicting its successors
from it instead of from its parent gains more log-likelihood on the training tokens
than half a log count for each successor. Contexts of one and two words are all
tested, longer ones where the context one word shorter is retained, and so on until
no context of a length is.

The text is read once, into pieces of about ``PIECE`` bytes: their distinct word
hashes, and the symbols as numbers of these. Each piece asks the ranges of hashes
for its words' numbers and counts in the corpus (both exact). Then every token goes
once to the range of the word before it, with the words before that one, and the
range counts, tests and scores all contexts up to some length, level by level; sums
by row go back to the piece. Only tokens behind a context that is retained at the
last level of a pass go into the next one, dealt by all words of it.

A word with more than ``MEET`` tokens is hot: what follows it is dealt by the two
last words, to as many ranges as its count asks for, so its own context is in none of
them as a whole. The grams of it and one more word are counted by gram before (each
piece sends its distinct ones), its test is summed up over those that occur ``LEAST``
times, and these go to each of its ranges with their probabilities. What follows one
pair of words meets in one task.

The ranges meet in ``SHARES`` shares, one after the other; tables and shuffle files
of a step are deleted when the next one is written. All rows that move are packed:
one for each piece and range. Nothing but the hot words is collected.

Words are 64-bit hashes; from their numbers on, contexts up to the first pass's
length and their grams are told apart exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from certlens.llm import sketch, words
from certlens.llm.shared import discard, keep, keep_parts

LEAST = 2
DISCOUNT = 0.5
LEAST_REST = 1e-12
#: Lengths of the grams that are counted by gram, behind hot words.
ORDERS = (2,)
#: Context lengths of the first pass (tested from one word on, whatever stands
#: first), and how many the others have.
FIRST, MORE = (2, 4), 4
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
#: Bytes of text in a piece (or one row, if it is longer).
PIECE = 6 << 20
#: Hashes that a range gets from the whole corpus (on average).
RANGE = 1 << 19
#: Tokens that meet in a range of contexts (on average), and the shares of the ranges.
MEET, SHARES = 1 << 18, 3
#: Bytes that a worker gets at once.
AT_ONCE = 8 << 20
#: Numbers of no word and of the start mark; words follow.
NONE, FIRST_MARK = 0, 1

U = np.uint64


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 by division by 7 (null: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


@contextmanager
def _batches(spark: SparkSession) -> Iterator[None]:
    """Inside, workers get at most ``AT_ONCE`` bytes at once (or one row), and Parquet's
    writers look at their size after each (large) row."""
    own = {"spark.sql.execution.arrow.maxBytesPerBatch": str(AT_ONCE), "parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1"}
    before = {name: spark.conf.get(name, None) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _sequences(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges with their symbols (start mark, words, end token for each row)
    and the index of each row's start mark, one more entry for the end."""
    data, offsets = words.buffers(col)
    is_word = words.white_space_class()
    for i, j in words.chunks(offsets):
        h, first = words.scan(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], is_word)
        at = first + 2 * np.arange(j - i + 1)
        seq = np.empty(len(h) + 2 * (j - i), np.uint64)
        inside = np.ones(len(seq), dtype=bool)
        inside[at[:-1]] = inside[at[1:] - 1] = False
        seq[at[:-1]], seq[at[1:] - 1] = START, END
        seq[inside] = h
        yield i, j, seq, at


def _small(x: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _sized(raw: bytes, n: int) -> np.ndarray:
    """``n`` counts that ``_small`` wrote."""
    return np.frombuffer(raw, f"u{len(raw) // n}") if n else np.zeros(0, np.uint8)


def _edges(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    new = np.ones(len(x), dtype=bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return new


def _packed(x: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Rows of an array, from cut to cut, as binary values."""
    x = np.ascontiguousarray(x)
    width = x.itemsize * (x.shape[1] if x.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * width).astype(np.int32)), pa.py_buffer(x)])


def _flat(col: pa.ChunkedArray, kind) -> np.ndarray:
    """All binary values of a column, one after the other."""
    return np.frombuffer(b"".join(col.to_pylist()), kind)


_PIECE = "held binary, at binary, vocabulary binary, times binary, symbols binary, size long, trained long"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, held_out, text) as one row for each piece: its number, the ids,
    whether held out, where each row begins; its distinct hashes with their number among
    training rows (of the start mark: the rows), the symbols as places among these;
    the tokens of all and of training rows."""
    from pyspark import TaskContext

    context = TaskContext.get()
    piece, size = (context.partitionId() if context else 0) << 33, 0
    some: list[tuple] = []

    def cut() -> pa.RecordBatch:
        ids, held, seqs, ats = zip(*some)
        held, seq = np.concatenate(held), np.concatenate(seqs)
        begins = np.cumsum([0, *map(len, seqs)])
        at = np.concatenate([*(a[:-1] + b for a, b in zip(ats, begins)), begins[-1:]])
        h, symbols = np.unique(seq, return_inverse=True)
        # the frequent ones first: small numbers take less room
        order = np.argsort(-np.bincount(symbols, minlength=len(h)), kind="stable")
        place = np.empty(len(h), np.int64)
        place[order] = np.arange(len(h))
        h, symbols = h[order], place[symbols]
        train = np.repeat(~held, np.diff(at))
        times = np.bincount(symbols[train], minlength=len(h))
        arrays = held, at.astype(np.int64), h, _small(times), symbols.astype(np.min_scalar_type(len(h)))
        ids = pa.concat_arrays(ids)
        return pa.RecordBatch.from_arrays(
            [pa.array([piece]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([x.tobytes()], pa.binary()) for x in arrays),
             pa.array([len(seq) - len(held)]), pa.array([int(train.sum() - (~held).sum())])],
            names=["piece", "doc_id", "held", "at", "vocabulary", "times", "symbols", "size", "trained"])

    for batch in batches:
        _, offsets = words.buffers(batch.column(2))
        held = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for i, j, seq, at in _sequences(batch.column(2)):
            own = int(offsets[j] - offsets[i])
            if some and size + own > PIECE:
                yield cut()
                piece, size, some = piece + 1, 0, []
            size += own
            some.append((pa.concat_arrays([batch.column(0).slice(i, j - i)]), held[i:j], seq, at))
    if some:
        yield cut()


def _by_range(ranges: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of hashes by range, the ranges met, and where each begins (and the end)."""
    of = ((h >> U(40)) % U(ranges)).astype(np.min_scalar_type(ranges))
    order = np.argsort(of, kind="stable")
    of = of[order]
    cuts = np.flatnonzero(_edges(of))
    return order, of[cuts].astype(np.int32), np.append(cuts, len(of))


def _asked(ranges: int):
    """The distinct hashes of each piece with their counts, packed by hash range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, raw, times in zip(*(c.to_pylist() for c in batch.columns)):
                h = np.frombuffer(raw, U)
                order, of, cuts = _by_range(ranges, h)
                yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(np.full(len(of), piece)), _packed(h[order], cuts), _packed(_sized(times, len(h))[order], cuts)],
                                                 names=["range", "piece", "hashes", "times"])

    return run


_ANSWER = "piece long, range int, numbers binary, times binary, known long, wide boolean, hot binary, hot_times binary"


def _numbers(ranges: int, meet: int, exact: bool):
    """The number of each hash of a range (``exact``: the hash itself) and its count in
    the corpus, in the order of each piece's hashes; in the first row also how many
    words there are, whether a number needs 64 bits, and the hot ones."""
    def run(asked: pa.Table) -> pa.Table:
        place = asked.column("range")[0].as_py()
        raw = asked.column("hashes").to_pylist()
        sizes = np.array([len(x) // 8 for x in raw])
        times = np.concatenate([_sized(x, k).astype(np.int64) for x, k in zip(asked.column("times").to_pylist(), sizes)])
        h, of = np.unique(np.frombuffer(b"".join(raw), U), return_inverse=True)
        n = np.bincount(of, times, len(h)).astype(np.int64)
        number = h.copy() if exact else np.arange(len(h), dtype=U) * U(ranges) + U(place + FIRST_MARK + 1)
        number[h == START] = FIRST_MARK
        wide, hot = bool(number.max() >> U(32)), (n > meet) & (h != END)
        first = [(int(((n > 0) & (h != START)).sum()), wide, number[hot].tobytes(), n[hot].tobytes())]
        first += [(0, wide, b"", b"")] * (len(raw) - 1)
        cuts = np.cumsum([0, *sizes])
        number = number if wide else number.astype(np.uint32)
        packed = pa.array([_small(n[of[i:j]]).tobytes() for i, j in zip(cuts[:-1], cuts[1:])], pa.binary())
        return pa.Table.from_arrays([asked.column("piece"), asked.column("range"), _packed(number[of], cuts), packed, *(pa.array(c, kind) for c, kind in zip(
            zip(*first), (pa.int64(), pa.bool_(), pa.binary(), pa.binary())))], names=["piece", "range", "numbers", "times", "known", "wide", "hot", "hot_times"])

    return run


_NUMBERED = "held binary, at binary, numbers binary, times binary, symbols binary, known binary, base binary"


def _numbered(ranges: int, all_words: int, wide: bool):
    """A piece with the numbers and counts of its words instead of their hashes; of each
    row how many tokens are known and log10 of the base."""
    def run(pieces: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("range")
        raw = {c: pieces.column(c)[0].as_py() for c in ("piece", "held", "at", "vocabulary", "symbols")}
        h, at = np.frombuffer(raw["vocabulary"], U), np.frombuffer(raw["at"], np.int64)
        symbols = np.frombuffer(raw["symbols"], np.min_scalar_type(len(h)))
        order, _, cuts = _by_range(ranges, h)
        numbers, times = np.empty(len(h), U if wide else np.uint32), np.empty(len(h), np.int64)
        for c, to in (("numbers", numbers), ("times", times)):
            to[order] = np.concatenate([_sized(x, k).astype(to.dtype) for x, k in zip(answers.column(c).to_pylist(), np.diff(cuts))])
        word = numbers != FIRST_MARK
        known, base = (times > 0) & word, np.where(word, np.log10((times + 1) / all_words), 0.0)
        arrays = raw["held"], raw["at"], numbers.tobytes(), _small(times).tobytes(), raw["symbols"], np.add.reduceat(known[symbols].astype(np.int64), at[:-1]).tobytes(), np.add.reduceat(base[symbols], at[:-1]).tobytes()
        return pa.Table.from_arrays([pieces.column("piece"), pieces.column("doc_id"), *(pa.array([x], pa.binary()) for x in arrays)],
                                    names=["piece", "doc_id", *(x.split()[0] for x in _NUMBERED.split(", "))])

    return run


_STORED = ("piece", "held", "at", "numbers", "times", "symbols")


class _Piece:
    """A numbered piece: symbols as places in its vocabulary, numbers and counts of that."""

    def __init__(self, wide: bool, piece: int, held: bytes, at: bytes, numbers: bytes, times: bytes, symbols: bytes):
        self.piece, self.held, self.at = piece, np.frombuffer(held, bool), np.frombuffer(at, np.int64)
        self.numbers = np.frombuffer(numbers, U if wide else np.uint32)
        self.times = _sized(times, len(self.numbers))
        self.symbols = np.frombuffer(symbols, np.min_scalar_type(len(self.numbers)))

    def behind(self, some: np.ndarray) -> np.ndarray:
        """Where the tokens stand that follow ``some`` symbols of the vocabulary."""
        mark = some[self.symbols]
        mark[self.at[1:] - 1] = False
        return np.flatnonzero(mark) + 1

    def dealt(self, first: int, last: int, some: np.ndarray, key: np.ndarray, value: np.ndarray, of: np.ndarray, share: int, shares: int) -> pa.RecordBatch:
        """The tokens ``some`` by their range within a share, packed."""
        order = np.argsort(of.astype(np.min_scalar_type(int(of.max(initial=0)))), kind="stable")
        some, key, value, of = some[order], key[order], value[order], of[order]
        row = np.repeat(np.arange(len(self.held), dtype=np.int32), np.diff(self.at))[some]
        before, symbols = some - self.at[row], self.numbers[self.symbols]
        more = np.empty((len(some), last - first), self.numbers.dtype)
        for k in range(first + 1, last + 1):
            more[:, k - first - 1] = np.where(before >= k, symbols[some - k], NONE)
        lead = _edges(of)
        cuts = np.append(np.flatnonzero(lead), len(of))
        step = lambda x: _small(np.where(lead, x, np.diff(x, prepend=0)))  # noqa: E731  rows and places ascend within a range
        moved = step(row)
        moved = moved.astype(np.min_scalar_type(4 * int(moved.max(initial=0)) + 3)) * 4 + 2 * (before > last).astype(np.uint8) + self.held[row]
        columns = key, symbols[some], more, value, moved, step(some)
        return pa.RecordBatch.from_arrays([pa.array(of[cuts[:-1]].astype(np.int64) * shares + share), pa.array(np.full(len(cuts) - 1, self.piece)), *(_packed(x, cuts) for x in columns)], names=_NAMES)


#: Rows and places are steps, the former with bits: held out, has more words before it.
_DEALT = "range long, piece long, key binary, word binary, more binary, value binary, row binary, place binary"
_NAMES = [x.split()[0] for x in _DEALT.split(", ")]


class _Hot:
    """The hot words: sorted numbers, counts, to how many ranges what follows goes, and
    log10 of the rest of those that are retained contexts (else NaN)."""

    def __init__(self, numbers: np.ndarray, times: np.ndarray, meet: int):
        order = np.argsort(numbers)
        self.numbers, self.times = numbers[order].astype(U), times[order]
        self.parts, self.rest = -(-self.times // meet), np.full(len(numbers), np.nan)

    def find(self, numbers: np.ndarray) -> np.ndarray:
        """Places among the hot words, -1 for others."""
        if not len(self.numbers):
            return np.full(len(numbers), -1)
        place = np.minimum(np.searchsorted(self.numbers, numbers), len(self.numbers) - 1)
        return np.where(self.numbers[place] == numbers, place, -1)


def _spot(ranges: int, number: np.ndarray, part: np.ndarray | int = 0) -> np.ndarray:
    """The range of what follows a word (in a part, for a hot one)."""
    return ((words.mix(words.mix(number.astype(U)) + np.asarray(part).astype(U)) >> U(20)) % U(ranges)).astype(np.int64)


def _all_tokens(last: int, ranges: int, share: int, shares: int, wide: bool, hot: _Hot):
    """All tokens by the word before them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in zip(*(c.to_pylist() for c in batch.columns)):
                x = _Piece(wide, *raw)
                spot, place = _spot(ranges * shares, x.numbers), hot.find(x.numbers)
                some = x.behind((spot % shares == share) | (place >= 0))
                before = x.symbols[some - 1]
                of = (spot // shares)[before]
                if (place >= 0).any():
                    at = np.flatnonzero((place >= 0)[before])
                    number = x.numbers[before[at]]
                    # by the word before that one; behind a start mark by the token itself
                    by = x.numbers[x.symbols[np.where(number == FIRST_MARK, some[at], some[at] - 2)]]
                    part = words.mix(words.mix(by.astype(U)) + number) % hot.parts[place[before[at]]].astype(U)
                    spot = _spot(ranges * shares, number, part)
                    of[at] = np.where(spot % shares == share, spot // shares, -1)
                    some, before, of = (v[of >= 0] for v in (some, before, of))
                yield x.dealt(1, last, some, x.numbers[before], x.times[x.symbols[some]].astype(np.int64), of, share, shares)

    return run


def _left_tokens(first: int, last: int, ranges: int, share: int, shares: int, wide: bool):
    """The tokens that a pass left, by the hash of the ``first`` words before them."""
    def run(pieces: pa.Table, given: pa.Table) -> pa.Table:
        out = []
        if pieces.num_rows and given.num_rows:
            x = _Piece(wide, *(pieces.column(c)[0].as_py() for c in _STORED))
            some, score = _flat(given.column("place"), np.uint32).astype(np.int64), _flat(given.column("score"), np.float64)
            order = np.argsort(some, kind="stable")
            some, score = some[order], score[order]
            key = words.grams(x.numbers[x.symbols].astype(U), first)[some - first]
            of = ((key >> U(20)) % U(ranges * shares)).astype(np.int64)
            mine = of % shares == share
            out.append(x.dealt(first, last, some[mine], key[mine], score[mine], of[mine] // shares, share, shares))
        return pa.Table.from_batches(out, pa.schema([("range", pa.int64()), ("piece", pa.int64()), *((c, pa.binary()) for c in _NAMES[2:])]))

    return run


_GRAMS = "contexts binary, words binary, word_times binary, times binary"


def _requests(orders: tuple[int, ...], ranges: int, wide: bool, hot: _Hot):
    """The distinct grams of two behind hot words of each piece with their counts in
    training rows, packed by hash range."""
    assert orders == ORDERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in zip(*(c.to_pylist() for c in batch.columns)):
                x = _Piece(wide, *raw)
                some = x.behind(hot.find(x.numbers) >= 0)
                some = some[np.repeat(~x.held, np.diff(x.at))[some]]
                grams, n = np.unique(x.symbols[some - 1].astype(U) << U(32) | x.symbols[some].astype(U), return_counts=True)
                context, word = x.numbers[grams >> U(32)], x.numbers[grams & U(0xFFFFFFFF)]
                order, of, cuts = _by_range(ranges, words.mix(words.mix(context.astype(U)) + word))
                columns = context[order], word[order], x.times[grams & U(0xFFFFFFFF)].astype(np.int64)[order], _small(n)[order]
                yield pa.RecordBatch.from_arrays([pa.array(of), *(_packed(c, cuts) for c in columns)], names=["range", "contexts", "words", "word_times", "times"])

    return run


def _frequent(wide: bool):
    """The grams of a range that occur ``LEAST`` times."""
    def run(asked: pa.Table) -> pa.Table:
        kind = U if wide else np.uint32
        context, word, word_times = (_flat(asked.column(c), t) for c, t in (("contexts", kind), ("words", kind), ("word_times", np.int64)))
        raw = asked.column("contexts").to_pylist()
        times = np.concatenate([_sized(x, len(c) // np.dtype(kind).itemsize).astype(np.int64) for x, c in zip(asked.column("times").to_pylist(), raw)])
        order = np.lexsort((word, context))
        context, word, word_times = context[order], word[order], word_times[order]
        new = np.flatnonzero(_edges(context) | _edges(word))
        n = np.add.reduceat(times[order], new)
        new, n = new[n >= LEAST], n[n >= LEAST]
        return pa.Table.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (context[new], word[new], word_times[new], n)], names=[x.split()[0] for x in _GRAMS.split(", ")])

    return run


def _of_grams(wide: bool, raw: tuple) -> tuple[np.ndarray, ...]:
    """Contexts, words, the words' counts and the grams' own, as ``_frequent`` wrote them."""
    kind = U if wide else np.uint32
    return tuple(np.frombuffer(x, t) for x, t in zip(raw, (kind, kind, np.int64, np.int64)))


_STATISTICS = "hot int, k double, seen double, gain double"


def _statistics(all_words: int, wide: bool, hot: _Hot, rest: np.ndarray | None = None):
    """What the frequent grams add up to by hot word: how many, how often; with the
    contexts' ``rest`` also what they gain over the words alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in zip(*(c.to_pylist() for c in batch.columns)):
                context, _, word_times, n = _of_grams(wide, raw)
                of = hot.find(context)
                there, place = np.unique(of, return_inverse=True)
                inside = lambda v: np.bincount(place, v, len(there))
                parent = (word_times + 1) / all_words
                gain = n * np.log(((n - DISCOUNT) / hot.times[of] + rest[of] * parent) / parent) if rest is not None else np.zeros(len(n))
                yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), *(pa.array(inside(v)) for v in (np.ones(len(n)), n, gain))], names=["hot", "k", "seen", "gain"])

    return run


def _hot_grams(all_words: int, ranges: int, share: int, shares: int, wide: bool, hot: _Hot):
    """The frequent grams behind retained hot words, with log10 of p, for each range that
    their tokens go to, as tokens of no piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in zip(*(c.to_pylist() for c in batch.columns)):
                context, word, word_times, n = _of_grams(wide, raw)
                for i, j in zip(cuts := np.flatnonzero(_edges(context)), [*cuts[1:], len(context)]):
                    at = hot.find(context[i : i + 1])[0]
                    if np.isnan(hot.rest[at]):
                        continue
                    p = np.log10((n[i:j] - DISCOUNT) / hot.times[at] + 10.0 ** hot.rest[at] * (word_times[i:j] + 1) / all_words)
                    of = np.unique(_spot(ranges * shares, np.full(hot.parts[at], context[i]), np.arange(hot.parts[at])))
                    columns = context[i:j], word[i:j], b"", p, b"", b""
                    for to in of[of % shares == share]:
                        yield pa.RecordBatch.from_arrays([pa.array([to]), pa.array([-1], pa.int64()), *(pa.array([bytes(c)], pa.binary()) for c in columns)], names=_NAMES)

    return run


def _hot_levels(all_words: int, wide: bool, hot: _Hot):
    """The retained contexts of hot words and their grams, of the tree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in zip(*(c.to_pylist() for c in batch.columns)):
                context, word, word_times, n = _of_grams(wide, raw)
                of = hot.find(context)
                good = ~np.isnan(hot.rest[of])
                context, word, word_times, n, of = (x[good] for x in (context, word, word_times, n, of))
                p = np.log10((n - DISCOUNT) / hot.times[of] + 10.0 ** hot.rest[of] * (word_times + 1) / all_words)
                own, at = np.unique(context, return_index=True)
                h, rest = np.concatenate([_gram(context, word), own.astype(U)]), np.concatenate([np.full(len(p), np.nan), hot.rest[of[at]]])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), 2, np.int32)), pa.array(h.view(np.int64)), pa.array(np.concatenate([p, np.full(len(own), np.nan)]), from_pandas=True),
                                                  pa.array(rest, from_pandas=True)], names=["order", "h", "p", "rest"])

    return run


def _passed(k: np.ndarray, total: np.ndarray, seen: np.ndarray, rest: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """The divergence test of contexts: ``k`` grams seen ``seen`` times of ``total``, and
    what these gain over the parent."""
    return (k > 0) & (gain + (total - seen) * np.log(rest) > k * 0.5 * np.log(np.maximum(total, 1.0)))


def _dense(x: np.ndarray) -> np.ndarray:
    """The place of each value among the distinct ones."""
    return np.unique(x, return_inverse=True)[1].astype(U)


def _tested(context: np.ndarray, word: np.ndarray, weight: np.ndarray, score: np.ndarray):
    """Tokens (word) behind contexts, both below 2^32, with their weight in training
    and log10 of their probability given the parent: the same given the context where it
    is retained, and whether it is; for each retained context one of its tokens and
    log10 of the rest, for each of its grams one token and log10 of p."""
    key = context << U(32) | word
    order = np.argsort(key)
    key = key[order]
    new = _edges(key)
    lead = np.flatnonzero(new)
    gram, n = np.cumsum(new) - 1, np.add.reduceat(weight[order], lead)
    new = _edges(key[lead] >> U(32))
    of, heads = np.cumsum(new) - 1, order[lead[new]]
    total = np.add.reduceat(n, np.flatnonzero(new))
    before = score[order[lead]]
    entry = np.flatnonzero(n >= LEAST)
    inside = lambda v: np.bincount(of[entry], v, len(heads))
    parent, part = 10.0 ** before[entry], (n[entry] - DISCOUNT) / total[of[entry]]
    rest = np.maximum(1.0 - inside(part), LEAST_REST)
    p = part + rest[of[entry]] * parent
    good = _passed(inside(np.ones(len(entry))), total, inside(n[entry]), rest, inside(n[entry] * np.log(p / parent)))
    now, kept, own = np.log10(rest)[of] + before, good[of], good[of[entry]]
    now[entry] = np.log10(p)
    out, retained = np.empty_like(score), np.empty(len(score), dtype=bool)
    out[order], retained[order] = np.where(kept, now, before)[gram], kept[gram]
    return out, retained, (heads[good], np.log10(rest[good]), order[lead[entry[own]]], np.log10(p[own]))


def _grow(first: int, last: int, some: np.ndarray, key: np.ndarray, word: np.ndarray, more: np.ndarray, weight: np.ndarray, score: np.ndarray, wide: bool, emit: bool):
    """Count, test and score the contexts of ``first`` (behind the tokens ``some``) to
    ``last`` words of one range: log10 of each token's probability, which tokens have a
    retained context of ``last`` words, and with ``emit`` by length the retained contexts
    with rest and grams with p."""
    levels, retained = [], np.zeros(len(key), dtype=bool)
    h, symbol = key.astype(U), _dense(word) if wide else word.astype(U)
    context = _dense(key) if key.dtype == U else h.copy()
    for length in range(first, last + 1):
        if length > first:
            column = more[:, length - first - 1]
            # contexts of one and two words are all tested
            some = np.flatnonzero((column != NONE) & retained if length > 2 else column != NONE)
            column = column[some]
            if emit:
                h[some] = words.mix(words.mix(h[some]) + column)
            of = _dense(context[some] << U(32) | (_dense(column) if wide else column))
            context[some] = of
            some = some[(np.bincount(of.astype(np.int64), weight[some]) >= LEAST)[of]] if len(some) else some
        retained[:] = False
        if len(some):
            score[some], retained[some], (heads, rest, grams, p) = _tested(context[some], symbol[some], weight[some], score[some])
            if emit:
                levels.append((length, h[some[heads]], rest, _gram(h[some[grams]], word[some[grams]]), p))
    return score, retained, levels


def _gram(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a context's hash and a word's number."""
    return words.mix(words.mix(context.astype(U) ^ END) + word)


#: Rows are steps, places are not.
_SUMS = "piece long, rows binary, sums binary, place binary, score binary"
_LEVELS = "order int, h long, p double, rest double"


def _range(first: int, last: int, all_words: int, wide: bool, hot: _Hot, emit: bool):
    """Of the tokens of a range: each piece's sums of log10 by row, and the tokens
    that need longer contexts; with ``emit`` also the retained contexts and grams."""
    kind = np.dtype(U if wide else np.uint32)

    def joined(context: np.ndarray, word: np.ndarray) -> np.ndarray:
        return _gram(context, word) if wide else context.astype(U) << U(32) | word

    def run(met: pa.Table) -> pa.Table:
        pieces = met.column("piece").to_numpy()
        met, given = met.filter(pa.array(pieces >= 0)), met.filter(pa.array(pieces < 0))
        pieces = met.column("piece").to_numpy()
        sizes = np.array([len(x) // kind.itemsize for x in met.column("word").to_pylist()], np.int64)
        cuts = np.cumsum([0, *sizes])
        word, more = _flat(met.column("word"), kind), _flat(met.column("more"), kind).reshape(-1, last - first) if last > first else np.zeros((cuts[-1], 0), kind)

        def steps(name: str) -> np.ndarray:
            return np.concatenate([np.zeros(0, np.int64), *(_sized(x, n).astype(np.int64) for x, n in zip(met.column(name).to_pylist(), sizes))])

        def summed(x: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(x)])
            return total[1:] - np.repeat(total[cuts[:-1]], sizes)

        bits, place = steps("row"), summed(steps("place"))
        row, weight, some = summed(bits >> 2), 1.0 - (bits & 1), np.arange(len(bits))
        if first > 1:
            key, score = _flat(met.column("key"), U), _flat(met.column("value"), np.float64).copy()
        else:
            key, score = _flat(met.column("key"), kind), np.log10((_flat(met.column("value"), np.int64) + 1) / all_words)
            of = hot.find(key)
            some, heavy = np.flatnonzero(of < 0), np.flatnonzero((of >= 0) & ~np.isnan(hot.rest[of]) if len(hot.rest) else of >= 0)
            if len(heavy):
                # what follows a hot word: its grams' probabilities are known, the others get its rest
                grams, which = np.unique(joined(key[heavy], word[heavy]), return_inverse=True)
                p = np.full(len(grams), np.nan)
                for context, own, known in zip(*(given.column(c).to_pylist() for c in ("key", "word", "value"))):
                    asked = joined(np.frombuffer(context, kind), np.frombuffer(own, kind))
                    at = np.minimum(np.searchsorted(grams, asked), len(grams) - 1)
                    there = grams[at] == asked
                    p[at[there]] = np.frombuffer(known, np.float64)[there]
                p = p[which]
                score[heavy] = np.where(np.isnan(p), hot.rest[of[heavy]] + score[heavy], p)
        score, left, levels = _grow(first, last, some, key, word, more, weight, score, wide, emit)
        left &= bits & 2 != 0
        packet = np.repeat(np.arange(len(sizes)), sizes)
        lead = np.flatnonzero(_edges(packet) | _edges(row))
        sums = np.add.reduceat(np.where(left, 0.0, score), lead) if len(lead) else score
        ends, stay = np.searchsorted(lead, cuts), np.searchsorted(np.flatnonzero(left), cuts)
        rows = np.where(_edges(packet[lead]), row[lead], np.diff(row[lead], prepend=0))
        columns = _packed(_small(rows), ends), _packed(sums, ends), _packed(place[left].astype(np.uint32), stay), _packed(score[left], stay)
        table = pa.Table.from_arrays([pa.array(pieces), *columns], names=["piece", "rows", "sums", "place", "score"])
        if not emit:
            return table
        parts = [(np.zeros(0, np.int32), np.zeros(0, U), np.zeros(0), np.zeros(0))]
        for length, contexts, rest, grams, p in levels:
            parts.append((np.full(len(contexts), length + 1, np.int32), contexts, np.full(len(contexts), np.nan), rest))
            parts.append((np.full(len(grams), length + 1, np.int32), grams, p, np.full(len(grams), np.nan)))
        order, h, p, rest = (np.concatenate(c) for c in zip(*parts))
        own = pa.Table.from_arrays([pa.array(order), pa.array(h.view(np.int64)), pa.array(p, from_pandas=True), pa.array(rest, from_pandas=True)], names=["order", "h", "p", "rest"])
        both = pa.concat_tables([table, own], promote_options="default")
        return both.select(["piece", "rows", "sums", "place", "score", "order", "h", "p", "rest"])

    return run


def _folded(met: pa.Table) -> pa.Table:
    """What the ranges of a share say of one piece: its rows' sums, the tokens left."""
    sums = [np.frombuffer(x, np.float64) for x in met.column("sums").to_pylist()]
    rows = [np.cumsum(_sized(x, len(s)), dtype=np.int64) for x, s in zip(met.column("rows").to_pylist(), sums)]
    sums = np.bincount(np.concatenate(rows), np.concatenate(sums)).astype(np.float64)
    columns = sums.tobytes(), b"".join(met.column("place").to_pylist()), b"".join(met.column("score").to_pylist())
    return pa.Table.from_arrays([met.column("piece").slice(0, 1), *(pa.array([x], pa.binary()) for x in columns)], names=["piece", "sums", "place", "score"])


def _finished(pieces: pa.Table, given: pa.Table) -> pa.Table:
    """Each row's result: its base and the sums of all shares and passes."""
    raw = {c: pieces.column(c)[0].as_py() for c in ("held", "at", "known", "base")}
    n_tokens = np.diff(np.frombuffer(raw["at"], np.int64)) - 1
    score = np.zeros(len(n_tokens))
    for x in given.column("sums").to_pylist():
        sums = np.frombuffer(x, np.float64)
        score[: len(sums)] += sums
    columns = np.frombuffer(raw["held"], bool), n_tokens, np.frombuffer(raw["known"], np.int64), np.frombuffer(raw["base"], np.float64), score
    return pa.Table.from_arrays([pieces.column("doc_id").combine_chunks().flatten(), *(pa.array(x) for x in columns)],
                                names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def _slots(level: DataFrame) -> np.ndarray:
    """Which sketch slots the retained contexts have: at most SLOTS rows."""
    slot = F.shiftrightunsigned("context", 64 - sketch.SLOT_BITS)
    out = np.zeros(sketch.SLOTS, dtype=bool)
    out[level.select(slot.alias("slot")).distinct().toArrow().column(0).to_numpy()] = True
    return out


def _answers(pieces: DataFrame, ranges: int, exact: bool) -> DataFrame:
    """The numbers and counts of the words of each piece; kept."""
    asked = pieces.select("piece", "vocabulary", "times").mapInArrow(_asked(ranges), "range int, piece long, hashes binary, times binary")
    return keep(asked.groupBy("range").applyInArrow(_numbers(ranges, MEET, exact), _ANSWER), "lm-answers", True)


class _Corpus:
    """A table (doc_id, held_out, text) as numbered pieces, kept, with the frequent
    grams of its hot words, kept (if any); the number of tokens, of training tokens and
    of distinct ones. ``exact``: words are numbered by their hashes."""

    def __init__(self, docs: DataFrame, exact: bool = False):
        kind = docs.schema["doc_id"].dataType.simpleString()
        pieces = keep(docs.mapInArrow(_pieces, f"piece long, doc_id array<{kind}>, {_PIECE}"), "lm-pieces", True)
        own = pieces.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long") for c in (F.col("size"), F.col("trained"), F.length("vocabulary") / 8))).first()
        self.size, self.total, hashes = own
        ranges = max(1, -(-hashes // RANGE))
        answers = _answers(pieces, ranges, exact)
        self.distinct, wide = answers.agg(F.coalesce(F.sum("known"), F.lit(0)), F.coalesce(F.max("wide"), F.lit(False))).first()
        self.wide, self.all_words = wide, self.total + self.distinct + 1
        hot = answers.filter(F.length("hot") > 0).select("hot", "hot_times").toArrow()
        self.hot = _Hot(np.concatenate([np.zeros(0, U), *(_sized(x, len(n) // 8) for x, n in zip(hot.column(0).to_pylist(), hot.column(1).to_pylist()))]), _flat(hot.column(1), np.int64), MEET)
        numbered = pieces.drop("times", "size", "trained").groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(
            _numbered(ranges, self.all_words, wide), f"piece long, doc_id array<{kind}>, {_NUMBERED}")
        self.pieces, self.grams = keep(numbered, "lm-numbered", True), None
        discard(pieces, answers)
        self.stored = self.pieces.select(*_STORED)
        if len(self.hot.numbers):
            ranges = max(1, -(-int(self.hot.times.sum()) // RANGE))
            asked = self.stored.mapInArrow(_requests(ORDERS, ranges, wide, self.hot), f"range int, {_GRAMS}")
            self.grams = keep(asked.groupBy("range").applyInArrow(_frequent(wide), _GRAMS), "lm-grams", True)
            k, seen, _ = self._summed_up()
            rest = np.maximum(1.0 - (seen - DISCOUNT * k) / self.hot.times, LEAST_REST)
            good = _passed(k, self.hot.times, seen, rest, self._summed_up(rest)[2])
            self.hot.rest = np.where(good, np.log10(rest), np.nan)

    def _summed_up(self, rest: np.ndarray | None = None) -> np.ndarray:
        """The hot words' statistics: k, seen, gain."""
        out = np.zeros((3, len(self.hot.numbers)))
        rows = self.grams.mapInArrow(_statistics(self.all_words, self.wide, self.hot, rest), _STATISTICS)
        for of, *row in rows.groupBy("hot").agg(F.sum("k"), F.sum("seen"), F.sum("gain")).collect():
            out[:, of] = row
        return out

    def done(self) -> None:
        """Delete what only the passes read."""
        if self.grams is not None:
            discard(self.grams)

    def passes(self, emit: bool = False) -> list[DataFrame]:
        """The kept results of the passes by context, one pass after the other until no
        token is left: sums by piece; with ``emit`` (by piece and range) the levels too."""
        first, last, tokens, done = 1, FIRST[1], self.size, []
        while True:
            shares = max(1, -(-SHARES * tokens // max(self.size, 1)))
            ranges = max(1, -(-tokens // (MEET * shares)))
            parts = []
            for share in range(shares):
                if done:
                    dealt = self.stored.groupBy("piece").cogroup(given.groupBy("piece")).applyInArrow(_left_tokens(first, last, ranges, share, shares, self.wide), _DEALT)
                else:
                    dealt = self.stored.mapInArrow(_all_tokens(last, ranges, share, shares, self.wide, self.hot), _DEALT)
                    if self.grams is not None:
                        dealt = dealt.union(self.grams.mapInArrow(_hot_grams(self.all_words, ranges, share, shares, self.wide, self.hot), _DEALT))
                found = dealt.groupBy("range").applyInArrow(_range(first, last, self.all_words, self.wide, self.hot, emit), _SUMS + (", " + _LEVELS if emit else ""))
                parts.append(found if emit else found.groupBy("piece").applyInArrow(_folded, "piece long, sums binary, place binary, score binary"))
            done.append(keep_parts(parts, "lm-sums"))
            given = done[-1].filter(F.length("place") > 0).select("piece", "place", "score")
            tokens = given.agg(F.sum(F.length("place") / 4)).first()[0]
            if not tokens:
                return done
            first, last, tokens = last + 1, last + MORE, int(tokens)


def learn(pieces: DataFrame) -> tuple[DataFrame, dict[int, np.ndarray], int, int]:
    """The tree of a table with a column text: h (of a token, gram or context), p
    (log10, of a token or gram), rest (log10, of a context); the sketch slots of the
    retained contexts by the length of their grams, the number of tokens, of distinct ones."""
    with _batches(pieces.sparkSession):
        corpus = _Corpus(pieces.select(F.lit(None).cast("long").alias("doc_id"), F.lit(False).alias("held_out"), "text"), exact=True)
        all_words, by_length = corpus.all_words, {}

        def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for numbers, times in zip(*(c.to_pylist() for c in batch.columns)):
                    h = np.frombuffer(numbers, U)
                    n = _sized(times, len(h)).astype(np.int64)[h != FIRST_MARK]
                    yield pa.RecordBatch.from_arrays([pa.array(h[h != FIRST_MARK].view(np.int64)), pa.array(np.log10((n + 1) / all_words))], names=["h", "p"])

        rows = corpus.pieces.select("numbers", "times").mapInArrow(tokens, "h long, p double")
        tree = rows.select("h", "p", F.lit(None).cast("double").alias("rest"))
        levels = [corpus.grams.mapInArrow(_hot_levels(all_words, corpus.wide, corpus.hot), _LEVELS)] if corpus.grams is not None else []
        for longer in [*levels, *(kept.filter("h is not null") for kept in corpus.passes(True))]:
            tree = tree.union(longer.select("h", "p", "rest"))
            for (n,) in longer.select("order").distinct().collect():
                by_length[n] = by_length.get(n, False) | _slots(longer.filter((F.col("order") == n) & F.col("rest").isNotNull()).withColumnRenamed("h", "context"))
        # a word is in many pieces, a hot word's context in many ranges
        tree = keep(tree.groupBy("h").agg(F.max("p").alias("p"), F.max("rest").alias("rest")), "lm-tree", True)
        corpus.done()
        discard(corpus.pieces)
    return tree, {n: x for n, x in by_length.items() if x.any()}, corpus.total, corpus.distinct


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", held: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score
    for every row of ``docs``; learns from the rows that are not held out.

    A null or empty text is the end token alone. A null doc_id is not held out.
    Repeated rows are counted and scored each; other columns are not looked at.
    With no training rows every token is unknown and has probability one."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), (held_out(F.col(doc_id)) if held is None else held).alias("held_out"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    with _batches(docs.sparkSession):
        corpus = _Corpus(slim)
        given = None
        for kept in corpus.passes():
            sums = kept.select("piece", "sums")
            given = sums if given is None else given.union(sums)
        corpus.done()
    scored = corpus.pieces.select("piece", "doc_id", "held", "at", "known", "base").groupBy("piece").cogroup(given.groupBy("piece")).applyInArrow(
        _finished, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(corpus.total).cast("long").alias("train_tokens"), "base_score", "score")
