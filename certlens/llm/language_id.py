"""Language identification by Bayesian evidence fusion.

The posterior of a language given a row is the product of

* the text likelihood: a multinomial model over hashed 4-byte grams of the whole
  text, letters only, tempered because neighbouring grams overlap;
* the likelihood of the declared markup language, from a grouped aggregation of
  soft counts (declared code by language) smoothed towards the code itself;
* a prior of the host, smoothed hierarchically: host towards registered domain,
  domain towards address suffix, suffix towards the corpus; country suffixes
  start from their country's languages. A row's own count is left out of its
  host's.

A further hypothesis stands for noise and languages without labels: its likelihood of
every gram lies a quarter of the way from a gram that a language has never shown to
that language's mean (averaged over the languages), and its prior is ``OTHER``. It is
part of the posterior, so where it wins no language reaches ``ACCEPT``; its share of a
row is left out of the host and code counts.

The text model is fitted on a bounded sample of labelled rows (about ``SAMPLE``
for each language, by a hash of the row); everything else covers all rows. The
soft counts come from the text alone, so the fusion needs one pass over the texts
and one small shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certlens.llm import words
from certlens.llm.shared import free_name, keep, row_key, short_batches, side

SAMPLE = 2000
BINS = 1 << 17
ALPHA = 0.05
TEMPER = 0.25
#: Pseudo-counts of each step of the host hierarchy and of a declared code.
STRENGTH = 20.0
DECLARED = 5.0
ACCEPT = 0.5
OTHER = 0.02
#: Languages of country suffixes.
COUNTRY = {"at": "de", "de": "de", "li": "de", "es": "es", "mx": "es", "ar": "es", "co": "es", "cl": "es", "pe": "es", "fr": "fr",
           "uk": "en", "us": "en", "ie": "en", "au": "en", "nz": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "jp": "ja", "cn": "zh"}

_SPACE = np.uint8(32)
_FOLD = np.full(256, _SPACE, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def code(col: Column) -> Column:
    """The primary subtag of a language tag, null if it isn't well-formed."""
    tag = F.lower(F.regexp_extract(F.coalesce(col, F.lit("")), r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1))
    return F.when(tag != "", tag)


def _bins(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins of all 4-byte grams that hold a letter and lie in one row; and the
    rows' first gram, one more entry for the end."""
    folded = _FOLD[data]
    repeat = np.zeros(len(folded), dtype=bool)
    repeat[1:] = (folded[1:] == _SPACE) & (folded[:-1] == _SPACE)
    repeat[offsets[:-1][offsets[:-1] < len(folded)]] = False
    kept = np.flatnonzero(~repeat)
    row = np.searchsorted(kept, offsets, "left")
    b = folded[kept].astype(np.uint32)
    if len(b) < 4:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    gram = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
    ok = (gram != 0x20202020)
    for k in range(1, 4):
        cut = row[1:-1] - k
        ok[cut[(cut >= 0) & (cut < len(ok))]] = False
    at = np.concatenate([[0], np.cumsum(ok)])[np.minimum(row, len(ok))]
    return ((gram[ok] * np.uint32(2654435761)) >> np.uint32(32 - 17)).astype(np.int64), at


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        tags = np.array(batch.column(0).to_pylist(), dtype=object)
        data, offsets = words.buffers(batch.column(1))
        for i, j in words.chunks(offsets):
            bins, at = _bins(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            label = np.repeat(tags[i:j], np.diff(at))
            for tag in set(tags[i:j]):
                total[tag] = total.get(tag, 0) + np.bincount(bins[label == tag], minlength=BINS)
    keys = sorted(total)
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([total[k].astype(np.int64).tobytes() for k in keys], pa.binary())], names=["lang", "counts"])


def fit_text_model(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages in code point order and log likelihoods by bin, a row for each
    language and a last one for any other; without labelled rows one language "und"
    without evidence."""
    rows = labelled.select(code(F.col(lang)).alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.pmod(F.xxhash64(F.lit(5), "text"), F.col("n")) < sample
    some = rows.join(F.broadcast(sizes), "lang").filter(share).select("lang", "text")  # at most 18,252 well-formed codes
    total: dict[str, np.ndarray] = {}
    for tag, raw in some.mapInArrow(_gram_counts, "lang string, counts binary").repartition("lang").mapInArrow(_add_counts, "lang string, counts binary").collect():
        total[tag] = total.get(tag, 0) + np.frombuffer(raw, np.int64)
    if not total:
        return ["und"], np.zeros((2, BINS), np.float32)
    tags = sorted(total)
    counts = np.stack([total[t] for t in tags]) + ALPHA
    share = counts / counts.sum(axis=1, keepdims=True)
    logs = np.log(share)
    unseen = np.log(ALPHA / counts.sum(axis=1))
    other = np.mean(unseen + ((share * logs).sum(axis=1) - unseen) / 4)
    return tags, np.vstack([logs, np.full(BINS, other)]).astype(np.float32)


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for tag, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total[tag] = total.get(tag, 0) + np.frombuffer(raw, np.int64)
    keys = sorted(total)
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([total[k].tobytes() for k in keys], pa.binary())], names=["lang", "counts"])


def _likelihoods(get, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = get()
        for batch in batches:
            data, offsets = words.buffers(batch.column(place))
            sums, grams = np.zeros((batch.num_rows, len(logs))), np.zeros(batch.num_rows, np.int64)
            for i, j in words.chunks(offsets):
                bins, at = _bins(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                grams[i:j] = np.diff(at)
                for k, row in enumerate(logs):
                    total = np.concatenate([[0.0], np.cumsum(row[bins], dtype=np.float64)])
                    sums[i:j, k] = total[at[1:]] - total[at[:-1]]
            sums *= TEMPER
            other, sums = sums[:, -1], sums[:, :-1]
            top = sums.max(axis=1, keepdims=True)
            soft = np.exp(sums - top)
            soft /= soft.mean(axis=1, keepdims=True) * len(soft[0]) * (1 + OTHER * np.exp(np.minimum(other - top[:, 0], 700.0)) / soft.mean(axis=1))[:, None]
            columns = [c for k, c in enumerate(batch.columns) if k != place]
            as_list = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * (len(logs) - 1)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(grams), pa.array(other), as_list(sums), as_list(soft)],
                                             names=[*(n for k, n in enumerate(batch.schema.names) if k != place), "grams", "log_other", "log_text", "soft"])

    return run


def _vector(make, n: int) -> Column:
    return F.array(*(make(i) for i in range(n)))


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", declared: str = "declared", host: str = "host") -> DataFrame:
    """All columns of ``rows`` but the text, plus suffix, lang, confidence,
    text_lang (from the text alone), grams and accepted.

    accepted: the text holds a letter gram and the language's posterior, against the
    others and the hypothesis of any other language, is at least ``ACCEPT``. Null and empty texts, and texts without letters, get a language
    from the other evidence but are not accepted. Null hosts and declared codes
    are no evidence of their own (they count as one unnamed host, or not at all).
    Ties go to the smaller code. Repeated rows get the same result, an empty
    table an empty one. New column names that ``rows`` has already get an
    underscore at the end."""
    tags, logs = model
    n = len(tags)
    shared = rows.sparkSession.sparkContext.broadcast(logs)
    # the address: host without port and "www.", its last label, its last two
    name = F.regexp_replace(F.lower(F.coalesce(F.col(host), F.lit(""))), r"^www\.|:[0-9]+$", "")
    labels = F.split(name, r"\.")
    rest = rows.drop(text)
    flat = rows.select(
        F.struct(*rest.columns).alias("_row"), name.alias("_host"), F.when(F.size(labels) > 1, F.element_at(labels, -1)).otherwise("").alias("_suffix"),
        F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").alias("_domain"), code(F.col(declared)).alias("_declared"), F.col(text).alias("_text"))
    place = flat.columns.index("_text")
    schema = flat.drop("_text").limit(0).withColumns({"grams": F.lit(0).cast("long"), "log_other": F.lit(0.0), "log_text": F.array(F.lit(0.0)), "soft": F.array(F.lit(0.0))}).schema

    def likelihoods(batches):
        return _likelihoods(lambda: shared.value, place)(batches)

    seen = keep(flat.mapInArrow(likelihoods, schema), "lang-rows")
    by_host = seen.groupBy("_suffix", "_domain", "_host").agg(*(F.sum(F.col("soft")[i]).alias(f"c{i}") for i in range(n)))
    by_host = keep(by_host, "lang-hosts")
    sums = [F.sum(f"c{i}") for i in range(n)]
    root_row = by_host.agg(*sums).first()
    root = np.array([x or 0.0 for x in root_row]) + 1.0
    root = root / root.sum()
    country = F.create_map(*(F.lit(x) for kv in COUNTRY.items() for x in kv))
    local = F.try_element_at(country, F.col("_suffix"))

    def towards(counts, above, total):
        return F.transform(F.arrays_zip(counts.alias("c"), above.alias("p")), lambda z: (z["c"] + STRENGTH * z["p"]) / (total + STRENGTH))

    def total(arr: Column) -> Column:
        return F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)

    counts = _vector(lambda i: F.col(f"c{i}"), n)
    start = _vector(lambda i: F.when(local == tags[i], F.lit(0.5 + 0.5 * float(root[i]))).when(local.isin(*tags), F.lit(0.5 * float(root[i]))).otherwise(F.lit(float(root[i]))), n)
    suffixes = by_host.groupBy("_suffix").agg(*(x.alias(f"c{i}") for i, x in enumerate(sums))).select("_suffix", towards(counts, start, total(counts)).alias("of_suffix"))
    domains = by_host.groupBy("_suffix", "_domain").agg(*(x.alias(f"c{i}") for i, x in enumerate(sums))).join(suffixes, "_suffix").select(
        "_domain", "_suffix", towards(counts, F.col("of_suffix"), total(counts)).alias("of_domain"))
    hosts = by_host.join(domains, ["_suffix", "_domain"]).select("_host", counts.alias("host_counts"), "of_domain")
    declared_counts = seen.filter("_declared is not null").groupBy("_declared").agg(*(F.sum(F.col("soft")[i]).alias(f"c{i}") for i in range(n)))
    # P(declared | language): soft counts, plus DECLARED for the language's own code
    by_lang = declared_counts.agg(*sums).first()
    size = [float(x or 0.0) + DECLARED + 1.0 for x in by_lang]
    codes = declared_counts.select("_declared", _vector(lambda i: F.log((F.col(f"c{i}") + F.when(F.col("_declared") == tags[i], DECLARED).otherwise(0.0) + 0.01) / size[i]), n).alias("log_declared"))
    fused = seen.join(hosts, "_host", "left").join(codes, "_declared", "left")
    own = F.transform(F.arrays_zip(F.col("host_counts").alias("c"), F.col("soft").alias("s")), lambda z: F.greatest(z["c"] - z["s"], F.lit(0.0)))
    prior = towards(own, F.col("of_domain"), total(own))
    parts = F.arrays_zip(F.col("log_text").alias("t"), F.col("prior").alias("p"), F.coalesce("log_declared", F.array(*[F.lit(0.0)] * n)).alias("d"))
    logs_col = F.transform(parts, lambda z: z["t"] + F.log(z["p"]) + z["d"])
    fused = fused.withColumn("prior", prior).withColumn("joint", logs_col).withColumn("top", F.array_max("joint"))
    best = F.element_at(F.array(*map(F.lit, tags)), F.array_position("joint", F.col("top")).cast("int"))
    # any other language: each declared code is as likely
    other = F.col("log_other") + float(np.log(OTHER)) - F.when(F.col("log_declared").isNotNull(), float(np.log(n + 1))).otherwise(0.0)
    confidence = F.lit(1.0) / F.aggregate("joint", F.exp(F.least(other - F.col("top"), F.lit(700.0))), lambda s, x: s + F.exp(x - F.col("top")))
    text_best = F.element_at(F.array(*map(F.lit, tags)), F.array_position("soft", F.array_max("soft")).cast("int"))
    out = fused.withColumn("confidence", confidence)
    real = tags != ["und"]
    accepted = (F.col("grams") > 0) & (F.col("confidence") >= ACCEPT) & F.lit(real)
    new = {"suffix": F.col("_suffix"), "lang": best, "confidence": F.col("confidence"), "text_lang": F.when(F.col("grams") > 0, text_best), "grams": F.col("grams"), "accepted": accepted}
    return out.select("_row.*", *(col.alias(free_name(rest, x)) for x, col in new.items()))


def keep_identified(docs: DataFrame, text: str = "text", declared: str = "lang", host: str = "source") -> DataFrame:
    """The rows of ``docs`` whose language is accepted, with all their columns.

    The model is fitted on the declared codes of ``docs``. Decisions go back by a
    fingerprint of text, declared code and host, on which alone they depend."""
    key = row_key(text, declared, host)
    rows = docs.select(F.col(text).alias("text"), F.col(declared).alias("declared"), F.col(host).alias("host"), key.alias("key"))
    at, gone = free_name(docs, "row_key"), free_name(docs, "refused_key")
    with short_batches(docs.sparkSession):
        model = fit_text_model(docs, text, declared)
        refused = keep(identify(rows, model).filter(~F.col("accepted")).select(F.col("key").alias(gone)).distinct(), "lang-refused")
    return docs.withColumn(at, key).join(side(refused), F.col(at) == F.col(gone), "left_anti").drop(at)
