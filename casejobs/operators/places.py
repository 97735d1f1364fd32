"""Place tags, the local stand-in for inferring a place from a text: names of a gazetteer found in the texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..session import spread

#: A gazetteer of so many names at most is sent to all tasks as a trie; a larger one meets the texts by shuffles.
MAX_BROADCAST_NAMES = 200_000


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits; texts and names are split alike."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def named_places(gazetteer: DataFrame) -> DataFrame:
    """(place, words, chars, lat, lon) of each name, by its words: of names with the same words the first counts, by name and
    point. A name without words can't be found."""
    split = gazetteer.select(F.lower("name").alias("place"), words_of(F.col("name")).alias("words"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    first = split.where(F.size("words") > 0).groupBy("words").agg(F.min(F.struct("place", "lat", "lon")).alias("x"))
    return first.select("x.place", "words", F.length(F.array_join("words", " ")).alias("chars"), "x.lat", "x.lon")


class Trie:
    """The names' words as a tree of numbered nodes: an edge is one number made of its node and word, and edges are sorted,
    so that many places of many texts go down one word at a time together."""

    def __init__(self, names: list[list[str]], chars: list[int]):
        number = {w: i for i, w in enumerate(sorted({w for words in names for w in words}))}
        self.vocabulary = pa.array(list(number), pa.string())
        self.n_words, self.chars = max(1, len(number)), np.array(chars, np.int64)
        children: dict[int, int] = {}
        ends: dict[int, int] = {}
        for i, words in enumerate(names):
            node = 0
            for w in words:
                node = children.setdefault(node * self.n_words + number[w], len(children) + 1)
            ends[node] = i
        self.edges = np.array(sorted(children), np.int64)
        self.child = np.array([children[e] for e in self.edges.tolist()], np.int64)
        self.name = np.full(len(children) + 1, -1, np.int64)
        self.name[list(ends)] = list(ends.values())

    def best(self, texts: pa.ListArray) -> np.ndarray:
        """Of each text (a list of words; null has none) the place of its longest name, of the first if several; or -1."""
        lengths = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = pc.fill_null(pc.index_in(texts.flatten(), self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        end = np.repeat(np.cumsum(lengths), lengths)
        begin = np.flatnonzero(ids >= 0)
        at, node, found = begin, np.zeros(len(begin), np.int64), []
        while len(at) and len(self.edges):
            edge = node * self.n_words + ids[at]
            place = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
            there = self.edges[place] == edge
            begin, at, node = begin[there], at[there] + 1, self.child[place[there]]
            named = self.name[node] >= 0
            found.append((begin[named], self.name[node[named]]))
            inside = at < end[begin]
            begin, at, node = begin[inside], at[inside], node[inside]
            known = ids[at] >= 0
            begin, at, node = begin[known], at[known], node[known]
        best = np.full(len(texts), -1, np.int64)
        if found:
            begin, name = (np.concatenate(x) for x in zip(*found))
            row = np.repeat(np.arange(len(texts)), lengths)[begin]
            order = np.lexsort((begin, -self.chars[name], row))
            row, name = row[order], name[order]
            first = np.append(True, row[1:] != row[:-1])[: len(row)]
            best[row[first]] = name[first]
        return best


def geotag(cases: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """case_id, place, latitude and longitude of each row of ``cases`` (case_id, text), by places named in its text.

    Only the characters that would be sent are looked at. Texts and names (name, latitude, longitude) are split into words
    alike, so that case and punctuation don't matter, and a name has any number of words. Of several names in a text the
    one with most characters counts, then the earliest. A name that the gazetteer has several times is one place: the
    least by its lower-case form and point. A text without any name, or null, has no place and the default point.
    """
    sent = spread(cases.select("case_id", F.substring("text", 1, C.ENGINE_SENT_CHARS).alias("text")))
    texts, names = sent.select("case_id", words_of(F.col("text")).alias("words")), named_places(gazetteer)
    found = _by_trie(texts, names) if gazetteer.count() <= MAX_BROADCAST_NAMES else _by_joins(texts, names)
    point = (F.when(F.col("place").isNull(), d).otherwise(F.col(c)).alias(n) for c, d, n in (("lat", C.DEFAULT_LAT, "latitude"), ("lon", C.DEFAULT_LON, "longitude")))
    return found.select("case_id", "place", *point)


def _by_trie(texts: DataFrame, names: DataFrame) -> DataFrame:
    """No row moves: each task goes down the trie with the words of its own texts."""
    table = names.toArrow()
    trie = Trie(table.column("words").to_pylist(), table.column("chars").to_pylist())
    shared = texts.sparkSession.sparkContext.broadcast((trie, table.select(["place", "lat", "lon"]).combine_chunks()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, points = shared.value
        for batch in batches:
            best = tree.best(batch.column(1))
            at = pa.array(np.maximum(best, 0), mask=best < 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(points.column(c).combine_chunks().take(at) for c in range(3))], ["case_id", "place", "lat", "lon"])

    kind = texts.schema["case_id"].dataType.simpleString()
    return texts.mapInArrow(work, f"case_id {kind}, place string, lat double, lon double")


def _by_joins(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Words meet the first words of names, and runs of as many words as such a name has meet the names."""
    row = F.struct("case_id", "words").alias("row")
    most = names.agg(F.coalesce(F.max(F.size("words")), F.lit(1))).first()[0]
    sizes = names.groupBy(F.get("words", F.lit(0)).alias("first")).agg(F.collect_set(F.size("words")).alias("sizes"))
    key = F.xxhash64(row)
    starts = texts.select(key.alias("key"), "words", F.posexplode("words").alias("at", "first"))
    starts = starts.select("key", "at", "first", F.slice("words", F.col("at") + 1, most).alias("ahead")).join(sizes, "first")
    runs = starts.select("key", "at", "ahead", F.explode("sizes").alias("size")).where(F.size("ahead") >= F.col("size"))
    hits = runs.select("key", "at", F.slice("ahead", F.lit(1), F.col("size")).alias("words")).join(names, "words")
    best = hits.groupBy("key").agg(F.min_by(F.struct("place", "lat", "lon"), F.struct(-F.col("chars"), "at")).alias("best"))
    return texts.withColumn("key", key).join(best, "key", "left").select("case_id", "best.place", "best.lat", "best.lon")
