"""SimHash near-dedup: 64-bit fingerprints, compared exactly tile by tile.

A fingerprint has a bit for each one that is set in more than half of the hashes of a text's shingles. Distinct
fingerprints are laid in cells by the population counts of their parts (two, four or eight runs of bits): the counts of
two fingerprints differ by no more, summed over the parts, than their bits do. A cell is cut into tiles of some thousand
fingerprints; only tiles of cells whose population counts differ within the radius are paired, and a pair of tiles is
compared by numpy's exclusive-or and bit counts. Nothing is sampled or banded, so no link within the radius is lost. Of the
links in a pair of tiles only a forest is kept, which has the same components and never more edges than fingerprints.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .arrays import released
from .durable import checkpointed, small_batches, written
from .near_dedup import components

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Bytes of a text that are cut into words at once.
PIECE_BYTES = 1 << 20
#: Fingerprints in a tile at most, about, and rows of a tile that are compared at once.
TILE = 4096
STEP = 256
#: Parts by the number of distinct fingerprints. More parts make more and smaller cells: of evenly spread fingerprints, some
#: 13, 1.6 and 0.04 of 100 pairs lie in cells within the radius. The links are the same with each.
PARTS = ((200_000, 2), (20_000_000, 4))
MOST_PARTS = 8
#: The number of tiles of each cell is broadcast up to so many cells (all that four parts can make), and joined beyond.
MAX_BROADCAST_CELLS = 100_000
#: Fingerprints that stand in more rows than that, and in more than one of so many, are joined by a broadcast: they are fewer
#: than the latter number.
HOT_ROWS, HOT_SHARE = 1000, 10_000

_SPACE = re.compile(rb"[ \t-\r]")


def _shingle_hashes(data: bytes) -> Iterator[np.ndarray]:
    """XXH64 of a text's shingles, a piece of it at a time; bytes.split cuts at the six blanks, bytes.lower changes A-Z only."""
    words, at, whole = [], 0, True
    while at < len(data):
        space = _SPACE.search(data, at + PIECE_BYTES)
        end = space.start() if space else len(data)
        words = words[1 - SHINGLE :] + data[at:end].lower().split()
        at = end
        if len(words) >= SHINGLE:
            whole = False
            runs = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
            yield np.fromiter(map(xxhash.xxh64_intdigest, runs, itertools.repeat(SEED)), np.uint64, len(words) - SHINGLE + 1)
    if whole and words:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)


def _bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits, the lowest first; summed up in bytes as far as these hold it."""
    bits = np.unpackbits(np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    full = len(bits) // 255 * 255
    sums = bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return sums + bits[full:].sum(axis=0, dtype=np.uint8)


def fingerprint(data: bytes) -> int:
    """The unsigned fingerprint of a text in UTF-8; zero without words."""
    sums, n = np.zeros(64, np.int64), 0
    for hashes in _shingle_hashes(data):
        sums += _bit_sums(hashes)
        n += len(hashes)
    return int(np.packbits(2 * sums > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of each row, fp as a signed long."""

    @released
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py() or b"") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    rows = spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")))
    return rows.mapInArrow(work, "doc_id bigint, fp bigint")


def _cell(fp: Column, parts: int) -> Column:
    """Population counts of the parts as one number, seven bits for each."""
    width = 64 // parts
    counts = [F.bit_count(F.shiftrightunsigned(fp, i * width).bitwiseAND(F.lit((1 << width) - 1))) for i in range(parts)]
    return sum((c.cast("bigint") * F.lit(128**i) for i, c in enumerate(counts)), F.lit(0).cast("bigint"))


def _steps(parts: int, radius: int) -> list[int]:
    """Differences of the cells that are compared, one of each two opposite ones."""
    near = (d for d in itertools.product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, d)) <= radius)
    return sorted({sum(x * 128**i for i, x in enumerate(d)) for d in near if next((x for x in d if x), 1) > 0})


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the same components as the edges (a, b) among n nodes: each node with the least that it reaches."""
    label = np.arange(n)
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        differ = low < high
        if not differ.any():
            break
        np.minimum.at(label, high[differ], low[differ])
        while (label[label] != label).any():
            label = label[label]
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def tile_links(one: np.ndarray, two: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between two tiles of unsigned fingerprints, as places in the first and then the second."""
    a = b = np.zeros(0, np.int64)
    n = len(one) + len(two)
    for i in range(0, len(one), STEP):
        r, c = np.nonzero(np.bitwise_count(one[i : i + STEP, None] ^ two) <= radius)
        if len(r):
            a, b = forest(np.concatenate([a, r + i]), np.concatenate([b, c + len(one)]), n)
    return a, b


def tiles(fps: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """(cell, tile, fps) and (cell, tiles) of distinct fingerprints (fp)."""
    cells = fps.select("fp", _cell(F.col("fp"), parts).alias("cell"))
    sizes = checkpointed(cells.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(TILE)).cast("int").alias("tiles")))
    if sizes.count() <= MAX_BROADCAST_CELLS:
        sizes = F.broadcast(sizes)
    placed = cells.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int").alias("tile"), "fp")
    return written(placed.groupBy("cell", "tile").agg(F.collect_list("fp").alias("fps"))), sizes


def tile_pairs(laid: DataFrame, sizes: DataFrame, parts: int, radius: int = RADIUS) -> DataFrame:
    """The pairs of tiles (fps, b_fps) whose population counts differ within the radius, each once."""
    steps = F.explode(F.array(*(F.lit(s).cast("bigint") for s in _steps(parts, radius))))
    left = laid.select("cell", "tile", "fps", steps.alias("step")).select("cell", "tile", "fps", (F.col("cell") + F.col("step")).alias("b_cell"))
    left = left.join(sizes.select(F.col("cell").alias("b_cell"), "tiles"), "b_cell")
    left = left.select("cell", "tile", "fps", "b_cell", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("b_tile")).where("cell <> b_cell OR tile <= b_tile")
    right = laid.select(F.col("cell").alias("b_cell"), F.col("tile").alias("b_tile"), F.col("fps").alias("b_fps"))
    return left.join(right, ["b_cell", "b_tile"]).select("fps", "b_fps")


def links(fps: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) with the components of all pairs of the n distinct fingerprints (fp) that differ in ``radius`` bits at most."""

    @released
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two in zip(batch.column(0), batch.column(1)):
                x, y = (np.asarray(v.values).view(np.uint64) for v in (one, two))
                both = np.concatenate([x, y]).view(np.int64)
                a, b = (both[at] for at in tile_links(x, y, radius))
                other = a != b  # a tile meets itself, too
                yield pa.RecordBatch.from_arrays([pa.array(a[other]), pa.array(b[other])], ["a", "b"])

    parts = next((p for most, p in PARTS if n <= most), MOST_PARTS)
    with small_batches(fps.sparkSession):
        return checkpointed(tile_pairs(*tiles(fps, parts), parts, radius).mapInArrow(work, "a bigint, b bigint").distinct())


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hexadecimal digits) and component_id.

    Words are runs of other bytes than blanks, A-Z in lower case; a shingle is three words with one space between, and
    repeats count. A text of one or two words is one shingle; without words (null, empty, blank) the fingerprint is zero
    and is linked like any other. ``component_id`` is the least doc_id that is reached by links of at most ``radius``
    differing bits, the row's own included. Rows of one id are linked by their texts only. Rows without an id link others
    as any row does; a component without any id has a null component_id. Other columns are left out.
    """
    with small_batches(docs.sparkSession, "16m"):
        rows = written(fingerprints(docs))
    texts = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    n, n_rows = texts.agg(F.count("*"), F.sum("n")).first()
    labels = components(links(texts.select("fp"), n, radius), n)
    reached = labels.join(texts.select(F.col("fp").alias("node"), "least"), "node").groupBy("class").agg(F.min("least").alias("component"))
    linked = labels.join(reached, "class").select(F.col("node").alias("fp"), "component", F.lit(True).alias("linked"))
    known = texts.join(linked, "fp", "left").select("fp", "n", F.when(F.col("linked"), F.col("component")).otherwise(F.col("least")).alias("component_id"))
    known = written(known)
    often = F.col("n") > max(HOT_ROWS, (n_rows or 0) // HOT_SHARE)
    hot = F.broadcast(known.where(often).drop("n"))
    found = rows.join(hot, "fp").unionByName(rows.join(hot, "fp", "left_anti").join(known.where(~often).drop("n"), "fp"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
