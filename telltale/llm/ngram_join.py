"""Near-duplicate classes by exact Jaccard similarity of word shingles.

Two documents link when ``100 * intersection >= percent * union`` of their shingle sets. The join is exact:

1. One pass over the texts gives each set's size, digest, bitmap and a few min-hashes, and how frequent words are.
   Equal sets are one class from here on.
2. Classes that share a pair of min-hashes are grouped, and each is compared exactly with a few centres of its group:
   classes to which others linked, or that link to none so far. Most near copies are connected after this, so that
   later no group of copies is expanded into pairs.
3. Of each set, the shingles that must hold one of every partner's, ``n - ceil(percent * n) + 1`` of them, rare ones
   first, are laid out as rows (prefix filter). Rows of one shingle in two neighbouring bands of sizes make a tile: sets
   further apart can't link. A tile whose rows belong to one component is done with; a large one is dealt to a grid of
   block pairs. Within a tile the number of differing bits of two bitmaps bounds their overlap from above, and only pairs of
   different components that pass go on.
4. Those pairs are decided by intersecting the sorted arrays, and the links complete the components.

Rare means made of rare words: all words of all texts are counted in a fixed number of buckets, and a shingle weighs the
sum of its words' logarithms. That order only decides which rows are made, never the result. Classes are told apart by 64-bit digests, shingles in a set by 64-bit hashes.

Every row takes part by its own text: classes, candidates and texts are keyed by the digest of the set and a 64-bit hash
of the text, never by an id.

Defined cases. A null or empty text has no shingles and links with nothing; fewer words than the width are one shingle.
Rows that share an id are rows of their own; a component's id is the smallest id of its rows, NULL if none has one. A row
without words has its own id as component. Repeated rows are in one class. Texts of any length are taken whole. An empty
table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telltale.llm.common import WordHashes, bit_filter, has_bit, mixed, per_batch, raw_texts, runs_of_words, shingle_set
from telltale.llm.components import components
from telltale.session import cut
from telltale.sources.tables import table

#: Buckets that words are counted in.
BUCKETS = 1 << 18
#: Rows of a block; a tile holds two blocks at most.
BLOCK = 1_000
#: Classes of a group that are compared with its centres in one run, and how many centres there are.
GROUP = 2_000
CENTRES = 16
#: Bits of the filter that picks the texts to be compared from the scan.
FILTER_BITS = 1 << 25
_SEEDS = tuple(np.uint64(0x9E3779B97F4A7C15 * (i + 1) % 2**64) for i in range(6))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def shingler(width: int):
    """A function from the bytes of a text to its sorted distinct shingles."""
    hashes = WordHashes()
    return lambda text: shingle_set(hashes(text.lower().split()), width)  # of bytes: A-Z, six ASCII spaces


def digest(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def bitmap(shingles: np.ndarray) -> bytes:
    """Bits at the hashes modulo a power of two, 128 to 65,536: four times the set's size or more up to 2,048 bits, so
    that few differences hide behind a common bit, and the set's size or more beyond, which tells unlike sets apart."""
    n = len(shingles)
    bits = 1 << min(max(7, int(n - 1).bit_length(), min(11, int(4 * n - 1).bit_length())), 16)
    flags = np.zeros(bits, np.uint8)
    flags[(shingles & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def profiles(docs: DataFrame, width: int) -> DataFrame:
    """Keys of row and text, id, n, digest, bitmap and min-hash keys per row; a last row of each task (n = -1) has its
    counts of words."""
    def start(batches):
        hashes, counts = WordHashes(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                words = [hashes(t.lower().split()) for t in raw_texts(piece.column(3))]
                sets = [shingle_set(w, width) for w in words]
                counts += np.bincount(word_bucket(np.concatenate(words)), minlength=BUCKETS)
                keys = []
                for s in sets:
                    if not len(s):
                        keys.append([])
                        continue
                    low = np.array([mixed(s ^ seed).min() for seed in _SEEDS], np.uint64)
                    keys.append(signed(mixed(low[0::2] * np.uint64(3) + low[1::2])).tolist())
                yield pa.RecordBatch.from_pydict(
                    {
                        "row_key": piece.column(0),
                        "text_key": piece.column(1),
                        "id": piece.column(2),
                        "n": pa.array([len(s) for s in sets], pa.int64()),
                        "digest": pa.array([digest(s) for s in sets], pa.int64()),
                        "bits": pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary()),
                        "keys": pa.array(keys, pa.list_(pa.int64())),
                        "buckets": pa.array([None] * len(sets), pa.list_(pa.int32())),
                        "times": pa.array([None] * len(sets), pa.list_(pa.int64())),
                    }
                )
        met = np.flatnonzero(counts)
        if len(met):
            yield pa.RecordBatch.from_pydict(
                {
                    "row_key": pa.nulls(1, pa.int64()),
                    "text_key": pa.nulls(1, pa.int64()),
                    "id": pa.nulls(1, pa.int64()),
                    "n": pa.array([-1], pa.int64()),
                    "digest": pa.array([0], pa.int64()),
                    "bits": pa.array([None], pa.binary()),
                    "keys": pa.array([None], pa.list_(pa.int64())),
                    "buckets": pa.array([met], pa.list_(pa.int32())),
                    "times": pa.array([counts[met]], pa.list_(pa.int64())),
                }
            )

    schema = "row_key long, text_key long, id long, n long, digest long, bits binary, keys array<long>, buckets array<int>, times array<long>"
    return docs.select("row_key", "text_key", "id", "text").mapInArrow(start, schema)


def word_bucket(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(46)).astype(np.int64)


def word_weights(rows: DataFrame) -> np.ndarray:
    """For each bucket 16 times the logarithm of how often its words occur: BUCKETS small integers for any input."""
    parts = rows.where("n = -1").select(F.explode(F.arrays_zip("buckets", "times")).alias("x"))
    sums = parts.groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.times").alias("times")).toArrow()
    weights = np.zeros(BUCKETS, np.int32)
    weights[sums.column(0).to_numpy()] = np.round(16 * np.log2(sums.column(1).to_numpy() + 1.0))
    return weights


def prefix_rows(docs: DataFrame, width: int, percent: int, weights: np.ndarray) -> DataFrame:
    """shingle, digest and n: the shingles of each set of which a partner must share one."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def start():
        hashes = WordHashes()

        def step(batch: pa.RecordBatch) -> dict:
            parts, digests, sizes, lengths = [np.empty(0, np.uint64)], [], [], []
            for text in raw_texts(batch.column(0)):
                words = hashes(text.lower().split())
                s, at = np.unique(runs_of_words(words, width), return_index=True)
                n = len(s)
                if n:
                    take = n - -(-percent * n // 100) + 1
                    each = shared.value[word_bucket(words)]
                    size = min(width, len(words))
                    weight = sum(each[j + at] for j in range(size))
                    parts.append(s[np.lexsort((s, weight))[:take]])
                    digests.append(digest(s))
                    sizes.append(n)
                    lengths.append(take)
            return {
                "shingle": pa.array(signed(np.concatenate(parts))),
                "digest": pa.array(np.repeat(np.array(digests, np.int64), lengths)),
                "n": pa.array(np.repeat(np.array(sizes, np.int64), lengths)),
            }

        return step

    return per_batch(docs.select("text"), "shingle long, digest long, n long", start, most_bytes=4 << 20)


def tile_candidates(rows: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components whose bitmaps allow the overlap.

    ``rows``: shingle, node, component, n; ``bitmaps``: node, bits. Bands are as wide as the sizes of a linked pair can
    differ, so a pair lies in one band or in two neighbours; it belongs to the tile of the upper one. Bitmaps are only
    joined to rows of tiles with more than one component.
    """
    width = math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1.0
    banded = rows.withColumn("band", F.floor(F.log("n") / width).cast("int"))
    banded = banded.withColumn("tile", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    sizes = (
        banded.groupBy("shingle", "tile")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("m"))
        .where("low <> high")
        .select("shingle", "tile", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    )
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = banded.join(sizes, ["shingle", "tile"]).withColumn("block", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("tile_a", F.least("block", "other")).withColumn("tile_b", F.greatest("block", "other"))
    tile = ["shingle", "tile", "tile_a", "tile_b"]
    upper = (F.col("band") == F.col("tile")).alias("upper")
    dealt = cut(dealt.select(*tile, "n", "block", "node", "component", upper)).join(bitmaps, "node")
    dealt = dealt.select(*tile, "n", "block", "node", "component", "upper", "bits")
    dealt = dealt.repartition(*tile).sortWithinPartitions(*tile, "n", "node")

    def fold(bits: int, size: int, to: int) -> int:
        while size > to:
            size //= 2
            bits = (bits >> size) | (bits & ((1 << size) - 1))
        return bits

    def run(batches):
        now, members, first = None, [], 0
        sent: set[tuple[int, int]] = set()
        for batch in batches:
            out = []
            columns = [c.to_pylist() for c in batch.columns]
            for key, band, i, j, n, block, node, component, upper, raw in zip(*columns, strict=True):
                if (key, band, i, j) != now:
                    now, members, first = (key, band, i, j), [], 0
                bits, size = int.from_bytes(raw, "little"), 8 * len(raw)
                while first < len(members) and 100 * members[first][0] < percent * n:
                    first += 1  # too small for this and all later rows: sizes ascend
                for other in members[first:]:
                    if other[2] == component or not upper or (i != j and other[1] == block):
                        continue
                    theirs, width = other[4], other[5]
                    if width == size:
                        apart = (bits ^ theirs).bit_count()
                    else:
                        to = min(width, size)
                        apart = (fold(bits, size, to) ^ fold(theirs, width, to)).bit_count()
                    overlap = (n + other[0] - apart) // 2
                    if 100 * overlap >= percent * (n + other[0] - overlap):
                        pair = (node, other[3]) if node < other[3] else (other[3], node)
                        if pair not in sent:
                            sent.add(pair)
                            out.append(pair)
                members.append((n, block, component, node, bits, size))
            if len(sent) > 500_000:
                sent.clear()
            a, b = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.mapInArrow(run, "a long, b long").distinct()


def wanted_texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """text_key and text of the wanted keys, one row each.

    A filter of FILTER_BITS bits, whatever the input, drops nearly all other rows in the scan; the join is exact.
    """
    at = F.pmod(F.col("text_key"), F.lit(FILTER_BITS))
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(keys.select(at.alias("at")), FILTER_BITS))

    def start():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.select([0, 1]).filter(pa.array(has_bit(shared.value, batch.column(2).to_numpy())))

        return step

    rows = docs.where("text IS NOT NULL").select("text_key", "text", at.alias("at"))
    near = per_batch(rows, "text_key long, text string", start, most_rows=20_000, most_bytes=64 << 20)
    return near.join(keys, "text_key", "left_semi").groupBy("text_key").agg(F.min("text").alias("text"))


def linked(docs: DataFrame, pairs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link, by intersecting the sorted arrays of both."""
    pairs = cut(pairs)
    key = lambda side: classes.select(F.col("node").alias(side), F.col("text_key").alias(f"key_{side}"))
    keyed = cut(pairs.join(key("a"), "a").join(key("b"), "b"))
    keys = keyed.select(F.col("key_a").alias("text_key")).union(keyed.select("key_b")).distinct()
    texts = wanted_texts(docs, keys)
    text = lambda side: texts.select(F.col("text_key").alias(f"key_{side}"), F.col("text").alias(f"text_{side}"))
    both = keyed.join(text("b"), "key_b").join(text("a"), "key_a")

    def start():
        shingles_of = shingler(width)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep, last, x = [], None, None
            for a, left, right in zip(batch.column(0).to_pylist(), *map(raw_texts, (batch.column(2), batch.column(3))), strict=True):
                if a != last:
                    last, x = a, shingles_of(left)
                y = shingles_of(right)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common) and common > 0)
            return batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

        return step

    rows = both.select("a", "b", "text_a", "text_b")
    return per_batch(rows, "a long, b long", start, most_bytes=8 << 20)


def centre_links(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) of classes with centres of the groups that share a min-hash key.

    Large groups are dealt to runs of about GROUP classes, each of which begins with the group's class of the least id. Only
    true links come out; what the few centres miss is left to the tiles, which are exact.
    """
    keyed = classes.select("node", "text_key", "first_id", F.explode(F.array_distinct("keys")).alias("key"))
    # the smallest id is where copies are most likely to come from
    least = F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "node"))["node"]
    groups = keyed.groupBy("key").agg(least.alias("least"), F.count(F.lit(1)).alias("m")).where("m > 1")
    met = keyed.join(groups, "key").withColumn("runs", F.ceil(F.col("m") / GROUP).cast("int"))
    first = F.col("node") == F.col("least")
    own = F.array(F.pmod(F.xxhash64("node"), F.col("runs")).cast("int"))
    run = F.explode(F.when(first, F.sequence(F.lit(0), F.col("runs") - 1)).otherwise(own))
    met = cut(met.select("key", run.alias("run"), "node", "text_key", (~first).alias("later")))
    rows = met.join(wanted_texts(docs, met.select("text_key").distinct()), "text_key")
    rows = rows.select("key", "run", "later", F.xxhash64("node").alias("at"), "node", "text")
    rows = rows.repartition("key", "run").sortWithinPartitions("key", "run", "later", "at")

    def link(x: np.ndarray, y: np.ndarray) -> bool:
        small, large = sorted((len(x), len(y)))
        if 100 * small < percent * large:
            return False
        common = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * common >= percent * (small + large - common)

    def compare(batches):
        shingles_of, now = shingler(width), None
        centres: list[list] = []  # node, set, how many linked to it
        for batch in batches:
            out: list[tuple[int, int]] = []
            columns = [batch.column(i).to_pylist() for i in (0, 1, 4)]
            for key, part, node, text in zip(*columns, raw_texts(batch.column(5)), strict=True):
                if (key, part) != now:
                    now, centres = (key, part), []
                own, hits = shingles_of(text), []
                for centre in centres:
                    if link(own, centre[1]):
                        hits.append(centre)
                        if centre[2] > 2:
                            break
                out += [(node, c[0]) for c in hits]
                if len(hits) > 1 and all(c[2] <= 2 for c in hits):  # it stands for all of them from now on
                    centres = [[node, own, len(hits)]] + [c for c in centres if all(c is not h for h in hits)]
                elif hits:
                    hits[-1][2] += 1
                    centres.sort(key=lambda c: -c[2])
                elif len(centres) < CENTRES:
                    centres.append([node, own, 0])
            a, b = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.mapInArrow(compare, "a long, b long")


def placed_rows(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """One row per row of ``docs``: row_key, text_key, id, n, and ``home``, the least digest of the component (NULL without
    words)."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    docs = docs.select("id", "text", text_key("text").alias("text_key"), row_key("id", "text").alias("row_key"))
    rows = cut(profiles(docs, width))
    real = rows.where("n >= 0")
    classes = real.where("n > 0").groupBy(F.col("digest").alias("node"))
    classes = cut(
        classes.agg(F.min("id").alias("first_id"), F.min("text_key").alias("text_key"), F.min("n").alias("n"), F.first("bits").alias("bits"), F.first("keys").alias("keys"))
    )
    links = cut(centre_links(docs, classes, width, percent).distinct())

    first = components(links)
    nodes = classes.drop("keys").join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    nodes = cut(nodes)

    laid = cut(prefix_rows(docs, width, percent, word_weights(rows)))
    several = laid.groupBy("shingle").agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
    several = several.where("low <> high").select("shingle")
    met = laid.join(several, "shingle", "left_semi").select("shingle", F.col("digest").alias("node")).distinct()
    met = cut(met.join(nodes.select("node", "component", "n"), "node").select("shingle", "node", "component", "n"))
    more = linked(docs, tile_candidates(met, nodes.select("node", "bits"), percent), nodes, width, percent)

    last = components(links.union(more))
    homes = nodes.select(F.col("node").alias("digest"), "node").join(last, "node", "left")
    homes = homes.select("digest", F.coalesce("component", "node").alias("home"))
    real = real.select("row_key", "text_key", "id", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest"))
    return real.join(homes, "digest", "left").drop("digest")


def text_key(text: str) -> Column:
    return F.xxhash64(text)


def row_key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("")), text)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id as ``id``, ``n_shingles``, ``component_id``."""
    placed = cut(placed_rows(docs, width, percent, id_col, text_col))
    least = placed.where("home IS NOT NULL").groupBy("home").agg(F.min("id").alias("component_id"))
    out = placed.join(least, "home", "left")
    component = F.when(F.col("home").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group, that with the smallest id, ids before none, with all its columns; of rows with the same id
    and text one. Rows without words are in no group and stay."""
    placed = placed_rows(docs, width, percent, "doc_id", "text").where("home IS NOT NULL")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key", "row_key")).alias("first")
    kept = placed.groupBy("home").agg(first).select(F.col("first.row_key").alias("_row_key"))
    wordless = F.coalesce(F.length(F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))) == 0, F.lit(True))
    keyed = docs.where(~wordless).withColumn("_row_key", row_key("doc_id", "text"))
    one = keyed.join(kept, "_row_key", "left_semi").dropDuplicates(["_row_key"])
    return one.select(*[f"`{c}`" for c in docs.columns]).union(docs.where(wordless))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
