"""Document fingerprints by locally consistent parsing.

A text is parsed in levels.  On each level runs of one symbol are folded, then
deterministic coin tossing gives every symbol a label below 6 that differs from
its left neighbour's: of two neighbours the lowest bit in which they differ and
the own value of that bit make the next label, four times.  A phrase starts at each
local maximum of the labels, so it has two to about ten symbols, and where it
starts depends on a few symbols around it only.  The phrase's name,
a hash of its symbols, is a symbol of the next level.  Equal substrings thus get equal
names inside, wherever they stand.  The last level has one name, that of the text.

Fingerprint: the text's name and, for levels 4, 3 and 2 (phrases of about 33, 14 and
6 characters), the smallest hashes of the level's distinct names.  Likeness of two
fingerprints: the share of common names among the smallest of both, an
unbiased estimate of the Jaccard likeness of the name sets (exact when the lists hold
all names), on the highest level with enough names in both.

All texts of a step are parsed at once with numpy.  In the query each document also
needs the next one: rows are cut into ranges of doc_id, sorted inside a range by
its task, and the first row of each range is sent along to the range before, so the
texts are shuffled once and no task holds more than a step of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triage_spark.llm.common import in_ranges, text_col, text_steps

#: Levels of the sketch, from the top, with the number of hashes kept and the least number of names to compare by.
SKETCH = ((4, 48, 12), (3, 16, 6), (2, 16, 0))
#: Characters of text for each range of doc_id.
RANGE_CHARS = 16_000_000
STEP = 1_000_000
MOST_LEVELS = 64

U64 = np.uint64
FIRST_SYMBOL, RUN = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (splitmix64's finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Factors for the places in a phrase; phrases are far shorter.
PLACES = mix(np.arange(1, 129, dtype=U64) * FIRST_SYMBOL) | U64(1)


def _toss_table() -> np.ndarray:
    a, b = np.meshgrid(np.arange(128), np.arange(128), indexing="ij")
    d = a ^ b
    low = d & -d
    return np.where(d, 2 * np.bitwise_count(np.maximum(low, 1) - 1) + ((a & low) != 0), 0).astype(np.uint8).ravel()


TOSS = _toss_table()


def labels(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 6; neighbours in one text differ.  symbols: unsigned, neighbours differ; first: places where texts begin."""
    left = np.empty_like(symbols)
    left[1:] = symbols[:-1]
    left[first] = ~symbols[first]
    d = symbols ^ left
    low = d & (~d + d.dtype.type(1))
    lab = (np.bitwise_count(low - low.dtype.type(1)) << 1).astype(np.uint8)
    lab += (symbols & low) != 0
    for _ in range(3):
        pair = lab.astype(np.uint16) << np.uint16(7)
        pair[1:] |= lab[:-1]
        pair[first] = (lab[first].astype(np.uint16) << np.uint16(7)) | (lab[first] ^ np.uint8(1))
        lab = TOSS[pair]
    return lab


def fold_runs(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of one symbol become one symbol named by it and the run's length."""
    new = np.empty(len(symbols), bool)
    new[1:] = symbols[1:] != symbols[:-1]
    new[first] = True
    if new.all():
        return symbols, first
    at = np.flatnonzero(new)
    size = np.diff(at, append=len(symbols))
    out = symbols[at].astype(U64)
    longer = size > 1
    out[longer] = mix(out[longer] * RUN + size[longer].astype(U64))
    return out, np.searchsorted(at, first)


def next_level(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrase names, places where texts begin) of the level above."""
    symbols, first = fold_runs(symbols, first)
    lab = labels(symbols, first)
    start = np.zeros(len(symbols), bool)
    start[1:-1] = (lab[1:-1] > lab[:-2]) & (lab[1:-1] > lab[2:])
    start[first[1:] - 1] = False  # the last symbol of a text, whose right neighbour is another text's
    start[first] = True
    at = np.flatnonzero(start)
    size = np.diff(at, append=len(symbols))
    place = np.arange(len(symbols)) - np.repeat(at, size)
    # A text's first phrase may run on to the first maximum; places repeat beyond the factors.
    names = np.add.reduceat(symbols.astype(U64) * PLACES[place & 127], at)
    return mix(names + size.astype(U64) * FIRST_SYMBOL), np.searchsorted(at, first)


def smallest(names: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the k smallest distinct 32-bit hashes of its names, ascending."""
    n = len(first)
    count = np.diff(first, append=len(names))
    text = np.repeat(np.arange(n), count)
    value = (mix(names ^ RUN) >> U64(32)).astype(np.int64)
    # Only small hashes are sorted; a text in which these hold fewer than k distinct ones is sorted whole.
    limit = np.minimum((1 << 32) * (6.0 * k + 20) / np.maximum(count, 1), 1 << 32)
    low = value < limit[text]
    keys = np.unique((text[low] << 32) | value[low])
    short = (np.bincount(keys >> 32, minlength=n) < k) & (limit < 1 << 32)
    if short.any():
        again = short[text]
        keys = np.union1d(keys, (text[again] << 32) | value[again])
    text = keys >> 32
    begin = np.searchsorted(text, np.arange(n))
    kept = np.arange(len(keys)) - begin[text] < k
    return np.split((keys[kept] & 0xFFFFFFFF).astype(np.uint32), np.searchsorted(text[kept], np.arange(1, n)))


def sketches(texts: list[str]) -> list[tuple[int, list[np.ndarray]]]:
    """(name of the text, smallest hashes by level of SKETCH) for each text; the empty text has name 0 and no hashes."""
    out: list = [(0, [np.zeros(0, np.uint32)] * len(SKETCH)) for _ in texts]
    full = [i for i, t in enumerate(texts) if t]
    if not full:
        return out
    sizes = np.array([len(texts[i]) for i in full])
    symbols = np.frombuffer("".join(texts[i] for i in full).encode("utf-32-le", "surrogatepass"), "<u4")
    first = np.cumsum(sizes) - sizes
    lists: dict[int, list[np.ndarray]] = {}
    live, names = np.arange(len(full)), np.zeros(len(full), U64)
    for level in range(1, MOST_LEVELS):
        symbols, first = next_level(symbols, first)
        for at, k, _ in SKETCH:
            if at == level:
                lists[level] = smallest(symbols, first, k)
        if level >= SKETCH[0][0]:
            # A text that is down to one symbol has its name and takes part no longer.
            size = np.diff(first, append=len(symbols))
            one = size == 1
            names[live[one]] = symbols[first[one]]
            symbols, live, size = symbols[~np.repeat(one, size)], live[~one], size[~one]
            if not len(live):
                break
            first = np.cumsum(size) - size
    for j, i in enumerate(full):
        out[i] = (int(names[j]), [lists[level][j] for level, _, _ in SKETCH])
    return out


def as_text(sketch: tuple[int, list[np.ndarray]]) -> str:
    name, lists = sketch
    return "-".join([f"{name:016x}", *(x.astype(">u4").tobytes().hex() for x in lists)])


def likeness(a: tuple[int, list], b: tuple[int, list]) -> float:
    """0 to 1, 1 for equal texts; from the fingerprints alone."""
    if a[0] == b[0]:
        return 1.0
    for (_, k, least), x, y in zip(SKETCH, a[1], b[1]):
        if len(x) >= least and len(y) >= least:
            x, y = set(x.tolist()), set(y.tolist())
            both = sorted(x | y)[:k]
            return sum(v in x and v in y for v in both) / max(1, len(both))
    return 0.0


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and lcp_fingerprint (replaces a column of that name); null texts count as empty."""
    kept = docs.drop("lcp_fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_steps(batches, text, STEP):
            prints = [as_text(s) for s in sketches([t or "" for t in b.column(text).to_pylist()])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prints, pa.string())], [*b.schema.names, "lcp_fingerprint"])

    return kept.mapInArrow(run, kept.withColumn("lcp_fingerprint", F.lit("")).schema)


def edit(text: str, following: str) -> str:
    """The last half of ``text`` (rounded down) replaced by the first as many characters of ``following``, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text: str = "text", range_chars: int = RANGE_CHARS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one row for each row.

    The next document is the one before in descending doc_id; of rows with one
    id the order is by a hash of the text, rows without an id come last, the last row's next
    is the first (one row alone: itself).  Repeated rows all count.  Null texts
    are empty.  Other columns are not read.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col(text).alias("text"))
    placed, parts = in_ranges(rows, range_chars)
    # The largest row of each range, the first in descending order: one small row for each of at most MOST_RANGES.
    top = sorted(placed.groupBy("part").agg(F.max(F.struct("k", "share", "h")).alias("t")).collect(), key=lambda r: r.part)
    sends = [(r.part, r.t.k, r.t.share, r.t.h, top[(i + 1) % len(top)].part) for i, r in enumerate(top)]
    heads = spark.createDataFrame(sends, "t_part int, t_k long, t_share double, t_h long, goes int")
    at_head = (F.col("k") == F.col("t_k")) & (F.col("h") == F.col("t_h"))
    dealt = placed.join(F.broadcast(heads), F.col("part") == F.col("t_part"))
    places = F.when(at_head, F.array(F.struct("part", F.lit(False).alias("extra")), F.struct(F.col("goes").alias("part"), F.lit(True).alias("extra")))).otherwise(F.array(F.struct("part", F.lit(False).alias("extra"))))
    dealt = dealt.withColumn("to", F.explode(places)).select("to.part", "to.extra", "doc_id", "text", "k", "share", "h")
    ordered = dealt.repartitionById(parts, "part").sortWithinPartitions("part", "extra", F.desc("k"), F.desc("share"), F.desc("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in text_steps(batches, "text", STEP):
            held += zip(b.column("extra").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist())
            extra = next((i for i, r in enumerate(held) if r[0]), len(held) - 1)
            if extra > 0:
                yield _compared([r[1:] for r in held[: extra + 1]])
                held = held[extra:] if not held[extra][0] else [(True, None, "")]

    return ordered.select("extra", "doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _compared(rows: list[tuple[int | None, str]]) -> pa.RecordBatch:
    """The result for all rows but the last, which only follows."""
    texts = [t for _, t in rows]
    edited = [edit(t, n) for t, n in zip(texts, texts[1:])]
    own, other = sketches(texts), sketches(edited)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([i for i, _ in rows[:-1]], pa.int64()),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array([as_text(s) for s in own[:-1]], pa.string()),
            pa.array([as_text(s) for s in other], pa.string()),
            pa.array([likeness(a, b) for a, b in zip(own, other)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(own, own[1:])], pa.float64()),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet"))
