"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's score is that of a linear model plus all pairwise interactions of its features, each the
product of two low-rank vectors. The pairs are never listed: the square of the vectors' sum less the
sum of their squares gives them in time linear in the features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairshare.llm.samples import draw_keys, known_labels, one_text_each
from fairshare.sources.tables import settle

#: Words are hashed to so many places; every statistic has PLACES of its own after them.
BUCKETS = 1 << 15
LEVELS = 41
#: A share's level is the root of the share in as many steps.
SHARE_STEPS = 20
SHARES = (
    "capitals", "digits", "stops", "exclamations", "symbols", "other_marks", "spaces", "non_ascii",
    "distinct_words", "top_word", "repeated_next", "distinct_triples", "distinct_lines", "sentence_ends",
)
SIZES = ("words", "bytes", "lines", "bytes_a_word", "longest_word", "words_a_line")
STATISTICS = SHARES + SIZES
#: Levels also count by COARSE together, in places of their own.
COARSE = 4
PLACES = LEVELS + LEVELS // COARSE + 1
#: Weight of a statistic or metadata feature, and the length of all words of a text together.
STATISTIC_X, WORDS_X = 0.5, 0.5
#: Bytes of text turned into features at once; a longer text is one piece.
AT_ONCE = 1 << 20

_SPACE, _DIGIT, _CAPITAL, _LETTER, _HIGH, _STOP, _BANG, _SYMBOL, _OTHER = range(9)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KIND[0x30:0x3A], _KIND[0x41:0x5B], _KIND[0x61:0x7B], _KIND[0x80:] = _DIGIT, _CAPITAL, _LETTER, _HIGH
_KIND[list(b".,;:?")] = _STOP
_KIND[list(b"!")] = _BANG
_KIND[list(b"#$%&*|~^=<>{}[]\\@_+")] = _SYMBOL
_IN_WORD = np.isin(_KIND, [_DIGIT, _CAPITAL, _LETTER, _HIGH])
_FOLD = np.arange(256)
_FOLD[0x41:0x5B] += 0x20
_VALUE = np.random.default_rng(12).integers(1, 1 << 63, 256, dtype=np.uint64)[_FOLD]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def _hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run of values, by their places in the run; runs do not overlap and are not empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    powers = np.full(int(sizes.max()), _STEP)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    return _mixed(np.add.reduceat(values[place + np.repeat(starts, sizes)] * powers[place], first))


def _runs(inside: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of true places, cut where the row changes."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.append(True, row[1:] != row[:-1])
    starts = inside & (new | ~np.append(False, inside[:-1]))
    ends = inside & (np.append(new[1:], True) | ~np.append(inside[1:], False))
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def _distinct(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and count of the distinct hashes of every row."""
    salted = hashes ^ _mixed(row.astype(np.uint64) + np.uint64(1))
    _, first, times = np.unique(salted, return_index=True, return_counts=True)
    return hashes[first], row[first], times


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(SHARE_STEPS * np.sqrt(part / np.maximum(whole, 1))), SHARE_STEPS).astype(np.int64)


def _size(x: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(2 * np.log2(1 + x)), LEVELS - 1).astype(np.int64)


def _piece(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word features (row, place, weight) and statistics' levels (row, statistic) of some texts in UTF-8."""
    n = len(sizes)
    row = np.repeat(np.arange(n), sizes)
    kinds = np.bincount(row * 9 + _KIND[data], minlength=9 * n).reshape(n, 9)
    per_row = lambda at: np.bincount(at, minlength=n)
    starts, ends = _runs(_IN_WORD[data], row)
    of = row[starts]
    words = _hashes(_VALUE[data], starts, ends)
    found, found_in, times = _distinct(words, of, n)
    n_words, n_found = per_row(of), per_row(found_in)
    top, longest = np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.maximum.at(top, found_in, times)
    np.maximum.at(longest, of, ends - starts)
    beside = of[1:] == of[:-1]
    again = per_row(of[1:][beside & (words[1:] == words[:-1])])
    whole = (of[2:] == of[:-2]) if len(of) > 2 else np.zeros(0, bool)
    triples = _mixed(words[2:] + _STEP * (words[1:-1] + _STEP * words[:-2]))[whole] if len(of) > 2 else words[:0]
    three_in = of[2:][whole] if len(of) > 2 else of[:0]
    n_triples = per_row(_distinct(triples, three_in, n)[1])
    line_starts, line_ends = _runs(data != 0x0A, row)
    lines = _hashes(_VALUE[data], line_starts, line_ends)
    n_lines, lines_in = per_row(row[line_starts]), row[line_starts]
    n_unlike = per_row(_distinct(lines, lines_in, n)[1])
    ended = np.zeros(len(data) + 1, bool)
    ended[:-1] = np.isin(data, list(b".!?"))
    sentences = per_row(of[ended[ends] & (np.append(row, -1)[ends] == of)])
    one = lambda *k: kinds[:, k].sum(1)
    shares = [
        (one(_CAPITAL), sizes), (one(_DIGIT), sizes), (one(_STOP), sizes), (one(_BANG), sizes), (one(_SYMBOL), sizes),
        (one(_OTHER), sizes), (one(_SPACE), sizes), (one(_HIGH), sizes), (n_found, n_words), (top, n_words), (again, n_words),
        (n_triples, per_row(three_in)), (n_unlike, n_lines), (sentences, n_words),
    ]
    counts = [n_words, sizes, n_lines, sizes / np.maximum(n_words, 1), longest, n_words / np.maximum(n_lines, 1)]
    levels = np.stack([_share(*s) for s in shares] + [_size(c) for c in counts], 1)
    order = np.argsort(found_in, kind="stable")
    at, weight = found_in[order], np.sqrt(times[order].astype(np.float64))
    length = np.sqrt(np.bincount(at, weight * weight, minlength=n))
    return at, (found[order] % np.uint64(BUCKETS)).astype(np.int64), WORDS_X * weight / length[at], levels


def _meta_level(column: pa.Array) -> np.ndarray:
    """Numbers by magnitude, other values by a hash, nulls apart; levels of one metadata column."""
    if pa.types.is_integer(column.type) or pa.types.is_floating(column.type) or pa.types.is_decimal(column.type):
        x = np.nan_to_num(np.array([np.nan if v is None else float(v) for v in column.to_pylist()], float), nan=-1.0)
        return np.where(x < 0, 0, np.minimum(1 + np.ceil(2 * np.log2(1 + np.maximum(x, 0))), LEVELS - 1)).astype(np.int64)
    texts = ["" if v is None else "=" + str(v) for v in column.to_pylist()]
    spread = [int(_hashes(_VALUE[np.frombuffer(t.encode(), np.uint8)], np.array([0]), np.array([len(t.encode())]))[0]) if t else 0 for t in texts]
    return np.array([1 + h % (LEVELS - 1) if h else 0 for h in spread], np.int64)


def places(metadata: int) -> int:
    """Number of features with so many metadata columns."""
    return BUCKETS + PLACES * (len(STATISTICS) + metadata)


def features(texts: pa.Array, metadata: list[pa.Array]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row ends, places, weights) of whole texts, some rows at a time, in order; null texts are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n, at = len(texts), 0
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    body = texts.buffers()[2]
    body = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    meta = [_meta_level(m) for m in metadata]
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + AT_ONCE, "right")) - 1)
        row, place, weight, levels = _piece(body[offsets[at] : offsets[to]], np.diff(offsets[at : to + 1]))
        levels = np.concatenate([levels, *[m[at:to, None] for m in meta]], 1)
        own = BUCKETS + PLACES * np.arange(levels.shape[1]) + levels
        own = np.concatenate([own, own + LEVELS + levels // COARSE - levels], 1)
        rows = np.concatenate([row, np.repeat(np.arange(to - at), own.shape[1])])
        order = np.argsort(rows, kind="stable")
        ends = np.cumsum(np.bincount(rows, minlength=to - at))
        yield (
            ends,
            np.concatenate([place, own.ravel()])[order].astype(np.int32),
            np.concatenate([weight, np.full(own.size, STATISTIC_X)])[order].astype(np.float32),
        )
        at = to


@dataclass(frozen=True)
class Machine:
    """Weights (places), vectors (places, rank) and bias, and the metadata columns that it reads."""

    weights: np.ndarray
    vectors: np.ndarray
    bias: float
    metadata: tuple[str, ...] = ()


def raw_scores(model: Machine, ends: np.ndarray, place: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Log-odds of rows, every one with a feature: half the vectors' squared sum less their squares gives the pairs."""
    starts = np.append(0, ends[:-1])
    own = model.vectors[place] * x[:, None]
    summed = np.add.reduceat(own, starts)
    pairs = ((summed**2).sum(1) - np.add.reduceat((own * own).sum(1), starts)) / 2
    return model.bias + np.add.reduceat(model.weights[place] * x, starts) + pairs


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(model: Machine, ends, place, x, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float]:
    """Mean weighted logistic loss, and its gradient by weights, vectors and bias."""
    rows, size, rank = np.repeat(np.arange(len(ends)), np.diff(np.append(0, ends))), *model.vectors.shape
    z = raw_scores(model, ends, place, x)
    own = model.vectors[place] * x[:, None]
    summed = np.add.reduceat(own, np.append(0, ends[:-1]))
    loss = (weight * np.where(y, np.logaddexp(0, -z), np.logaddexp(0, z))).mean()
    g = (_sigmoid(z) - y) * weight / len(y)
    by_x = g[rows] * x
    inner = (summed[rows] - own) * by_x[:, None]
    vectors = np.stack([np.bincount(place, inner[:, f], minlength=size) for f in range(rank)], 1)
    return float(loss), np.bincount(place, by_x, minlength=size), vectors, float(g.sum())


def fit(
    ends: np.ndarray, place: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray, size: int,
    rank: int = 8, passes: int = 12, batch: int = 256, rate: float = 0.02, decay: float = 1e-4, least: int = 3, seed: int = 12,
) -> Machine:
    """A machine fitted by Adam on mini-batches; features in fewer than ``least`` rows stay at zero."""
    rng = np.random.default_rng(seed)
    used = np.bincount(place, minlength=size) >= least
    vectors = rng.normal(0, 0.05, (size, rank)) * used[:, None]
    state = [np.zeros(size), vectors, np.zeros(1)]
    state[2][0] = np.log(((y * weight).sum() + 1) / (((~y) * weight).sum() + 1))
    first, second = [np.zeros_like(s) for s in state], [np.zeros_like(s) for s in state]
    starts, step = np.append(0, ends[:-1]), 0
    for _ in range(passes):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            some, step = order[at : at + batch], step + 1
            sizes = ends[some] - starts[some]
            own_ends = np.cumsum(sizes)
            at_place = np.arange(own_ends[-1]) - np.repeat(own_ends - sizes, sizes) + np.repeat(starts[some], sizes)
            _, *grads = risk(Machine(state[0], state[1], state[2][0]), own_ends, place[at_place], x[at_place], y[some], weight[some])
            grads = [(grads[0] + decay * state[0]) * used, (grads[1] + decay * state[1]) * used[:, None], np.array([grads[2]])]
            for k, g in enumerate(grads):
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                state[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Machine(state[0].astype(np.float32), state[1].astype(np.float32), float(state[2][0]))


def train(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    metadata: tuple[str, ...] = (),
    most_rows: int = 6_000,
    rank: int = 8,
    seed: int = 12,
) -> Machine:
    """Fit on the texts of at most ``most_rows`` keys with label 1 and as many with another label.

    ``labels`` holds (key, label) of the rows that may be learned from. Keys are drawn by a seeded
    hash, one row each (``samples.one_text_each``), and rows are weighted so that both classes have
    the weight that they have in ``labels``. Null keys and labels are not learned from; where one
    class is missing the score is the other's for every text, and 0.5 without any label. Whole
    texts become features on the executors and one task fits the machine on that bounded sample;
    only its weights reach the driver.
    """
    known = settle(known_labels(labels, key, label), "known")
    number = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = places(len(metadata))
    if len(number) < 2:
        bias = 0.0 if not number else 30.0 if True in number else -30.0
        return Machine(np.zeros(size, np.float32), np.zeros((size, rank), np.float32), bias, tuple(metadata))
    drawn = [draw_keys(known.where(F.col("y") == y), most_rows, seed).withColumn("y", F.lit(y)) for y in (True, False)]
    sample = one_text_each(docs, settle(drawn[0].unionByName(drawn[1]), "drawn"), key, text, list(metadata))
    columns = [F.col(f"doc.`{c}`").alias(f"_{n}") for n, c in enumerate(metadata)]
    order = F.struct(F.xxhash64("key", F.lit(seed)), F.col("key").cast("string"))
    sample = sample.select(order.alias("place"), "y", F.col("doc.text").alias("text"), *columns)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ends, place, x in features(batch.column(2), batch.columns[3:]):
                lists = [pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), v) for v in (place, x)]
                rows = batch.slice(at, len(ends))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *lists], names=["place", "y", "at", "x"])
                at += len(ends)

    kind = sample.schema["place"].dataType.simpleString()
    rows = settle(sample.mapInArrow(featured, f"place {kind}, y boolean, at array<int>, x array<float>"), "features")

    def fitted(table: pa.Table) -> pa.Table:
        # in order of the keys' hash, so that the order of arrival changes nothing
        table = table.take(pa.array(np.lexsort([np.array(c) for c in reversed(table["place"].combine_chunks().flatten())])))
        at, y = table["at"].combine_chunks(), np.array(table["y"].to_pylist(), bool)
        ends = np.cumsum(at.value_lengths().to_numpy())
        weight = np.where(y, number[True] / max(y.sum(), 1), number[False] / max((~y).sum(), 1))
        flat = [c.flatten().to_numpy() for c in (at, table["x"].combine_chunks())]
        model = fit(ends, flat[0], flat[1].astype(np.float64), y, weight / weight.mean(), size, rank, seed=seed)
        return pa.table({"weights": [model.weights.tobytes()], "vectors": [model.vectors.tobytes()], "bias": [model.bias]})

    found = rows.groupBy().applyInArrow(fitted, "weights binary, vectors binary, bias double").collect()
    if not found:
        return Machine(np.zeros(size, np.float32), np.zeros((size, rank), np.float32), 0.0, tuple(metadata))
    weights, vectors, bias = found[0]
    vectors = np.frombuffer(vectors, np.float32).reshape(size, rank)
    return Machine(np.frombuffer(weights, np.float32), vectors, bias, tuple(metadata))


def score(docs: DataFrame, model: Machine, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with ``into``: how likely the whole text has label 1, from 0 to 1. A column of that name goes.

    Null and empty texts are scored by their statistics (all zero) and metadata; repeated rows get
    equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array, *metadata: pa.Array) -> pa.Array:
        parts = [_sigmoid(raw_scores(shared.value, *piece)) for piece in features(texts, list(metadata))]
        return pa.array(np.concatenate(parts).astype(np.float64) if parts else np.zeros(0))

    return docs.withColumn(into, scored(F.col(f"`{text}`"), *[F.col(f"`{c}`") for c in model.metadata]))
