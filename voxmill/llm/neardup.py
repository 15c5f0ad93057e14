"""Op 6, near duplicates: MinHash with tensored banding, verified on the full sets.

A document's set is its distinct word shingles. Documents with the same set collapse into one representative. Each
representative has two small collections of minhash bands, A and B; a table key pairs one band of each, so m + m bands
make m * m tables. Only representatives under one key are candidates; candidates are never closed over before they are
compared. First each representative meets one leader of its keys, and confirmed links make classes; only keys that still
hold several classes go on: some more rounds of leaders, then every pair of different classes under a key of few
members. In keys of many members pairs come by a prefix of each set instead: in one order of all shingles, rare ones
first, two sets with so much in common share one of the first ones, so no link is lost and frequent shingles (a
footer that a corpus shares) pair nobody. Sets are compared two at a time, so memory doesn't follow groups.

A pair of similarity s meets in some table with probability (1 - (1 - s^r)^m)^2; with r = 5 and m = 26 a pair at 0.8 is
missed with probability 7e-5, one at one third is compared with probability 0.01.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.llm.tokens import give_up_cache, rows_of
from voxmill.operators.graph import connected_components
from voxmill.session import cut, read_table, released

#: Bands in each of the two collections, and minhashes in a band.
BANDS, ROWS = 22, 5
#: Shares of which a link has as many: 100 * intersection >= 80 * union.
PERCENT = 80
#: Rounds of leaders, and members of a key whose pairs are all compared; larger keys go by prefixes.
ROUNDS, FEW = 3, 8
#: Members of a band of A above which the band itself is one key, instead of a key with each band of B.
WIDE = 64
#: Counters of the prefixes' order; a shingle's rarity is that of all that share its counter.
COUNTERS = 1 << 16
#: Members and bytes of sets in a tile, on average, and columns of the matrices that are multiplied at once.
TILE, TILE_BYTES, COLUMNS = 1024, 8 << 20, 2048
#: Pairs of one representative that are joined in one partition before they are salted.
SALT_ROWS = 2048

_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, 2 * BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=8)
def _inverse_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.uint64(0xD1342543DE82EF95)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    ones = np.ones(n, np.uint64)
    return np.multiply.accumulate(np.concatenate([ones[:1], ones[1:] * base])), np.multiply.accumulate(np.concatenate([ones[:1], ones[1:] * inverse]))


#: Bytes of a text that are hashed at once; a cut is at white space.
_SEGMENT = 1 << 20
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


def _word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words, in order: differences of one running sum give each word's polynomial."""
    out = []
    while len(raw) > _SEGMENT:
        end = next((k for k in range(_SEGMENT, len(raw)) if raw[k] == 32 or 9 <= raw[k] <= 13), len(raw))
        out.append(_hash_words(raw[:end]))
        raw = raw[end:]
    return np.concatenate([*out, _hash_words(raw)])


def _hash_words(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers, inverses = _inverse_powers(1 << max(16, len(data).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_tables()[0][data] * powers[: len(data)], dtype=np.uint64)])
    return _scramble((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64) * _MIX)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of a whole text's distinct shingles; A-Z lower-cased, words split at blanks and U+0009-000D.

    With fewer words than a shingle has, the whole sequence is one; without words there is none.
    """
    hashes = _word_hashes((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not len(hashes):
        return hashes
    n = min(words, len(hashes))
    joined = np.full(len(hashes) - n + 1, np.uint64(len(hashes) if len(hashes) < words else words))
    for k in range(n):
        joined = joined * np.uint64(0xA0761D6478BD642F) + hashes[k : len(hashes) - n + 1 + k]
    return np.unique(_scramble(joined))


def bands(shingles: np.ndarray) -> np.ndarray:
    """2 * BANDS hashes: the bands of collection A, then those of B."""
    mults = _tables()[1][:, None]
    low = np.full(len(mults), np.iinfo(np.uint64).max, np.uint64)
    mixed = _scramble(shingles)
    part = np.empty((len(mults), 512), np.uint64)
    for at in range(0, len(mixed), 512):
        x = mixed[at : at + 512]
        np.minimum(low, np.multiply(x[None, :], mults, out=part[:, : len(x)]).min(axis=1), out=low)
    low = _scramble(low.reshape(2 * BANDS, ROWS))
    out = np.arange(2 * BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = out * np.uint64(0xA0761D6478BD642F) + low[:, k]
    return _scramble(out)


def _longs(parts: list[np.ndarray | None]) -> pa.Array:
    """Arrays of 64-bit hashes as lists of signed integers."""
    offsets = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in parts])]).astype(np.int32)
    flat = np.concatenate([x for x in parts if x is not None] or [np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array([x is None for x in parts]))


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of the two sides: products of their incidence matrices."""
    flats = [np.concatenate(x) for x in (left, right)]
    words = np.intersect1d(*[np.unique(x) for x in flats], assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)  # exact: counts are far below 2^24
    marks = []
    for sets, flat in zip((left, right), flats, strict=True):
        row, at = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.searchsorted(words, flat)
        known = at < len(words)
        known[known] = words[at[known]] == flat[known]
        order = np.argsort(at[known], kind="stable")
        marks.append((row[known][order], at[known][order]))
    for begin in range(0, len(words), COLUMNS):
        parts = []
        for sets, (row, at) in zip((left, right), marks, strict=True):
            a, b = np.searchsorted(at, (begin, begin + COLUMNS))
            part = np.zeros((len(sets), COLUMNS), np.float32)
            part[row[a:b], at[a:b] - begin] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def compare(left: list[tuple[int, int, np.ndarray]], right: list[tuple[int, int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links between rows (id, class, set) of ``left`` and of ``right`` in different classes; found links merge classes."""
    if not left or not right:
        return []
    m, n = (np.array([len(x[2]) for x in side]) for side in (left, right))
    shared = _shared([x[2] for x in left], [x[2] for x in right])
    alike = 100 * shared >= percent * (m[:, None] + n[None, :] - shared)
    ids, classes = np.array([x[0] for x in right]), np.array([x[1] for x in right])
    out, same = [], {}

    def root(c: int) -> int:
        while (up := same.get(c, c)) != c:
            c = up
        return c

    for k, (key, own, _) in enumerate(left):
        own = root(own)
        others, first = np.unique(classes[alike[k]], return_index=True)
        near = np.flatnonzero(alike[k])
        for cls, i in zip(others.tolist(), near[first].tolist(), strict=True):
            if cls != own:
                out.append((key, int(ids[i])))
                low, high = min(cls, own), max(cls, own)
                same[high] = low
                classes[classes == high] = low
                own = low
    return out


def _sketch(own: DataFrame, words: int) -> DataFrame:
    """Each row without its text, with ``n_shingles``, ``set_key`` (sixteen bytes that stand for the set) and ``bands``;
    the last two are null without shingles."""
    names = [x for x in own.columns if x != "text"]
    at, places = own.columns.index("text"), [own.columns.index(x) for x in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up_cache()
        for batch in rows_of(batches):
            counts, keys, marks = [], [], []
            for text in batch.column(at):
                shingles = shingle_set(text.as_py(), words)
                counts.append(len(shingles))
                keys.append(hashlib.md5(shingles.tobytes()).digest() if len(shingles) else None)
                marks.append(bands(shingles) if len(shingles) else None)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in places], pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), _longs(marks)], names=[*names, "n_shingles", "set_key", "bands"])

    kept = ", ".join(f"`{x}` {own.schema[x].dataType.simpleString()}" for x in names)
    return own.mapInArrow(run, f"{kept}, n_shingles long, set_key binary, bands array<long>")


def _busy(rows: DataFrame, hashes: str, to: str) -> DataFrame:
    """``(id, to)``: of the rows' bands those that another row has too; counts are pre-aggregated, so a hot band is one row per task."""
    single = rows.select("id", F.explode(hashes).alias("band"))
    busy = single.groupBy("band").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("band")
    return single.join(busy, "band", "left_semi").groupBy("id").agg(F.collect_list("band").alias(to))


def _widened(marked: DataFrame) -> DataFrame:
    """``marked`` with ``wide``, the bands of A that more than WIDE have; ``a`` keeps the others."""
    single = marked.select("id", F.explode("a").alias("band"))
    many = single.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > WIDE).select("band")
    wide = single.join(many, "band", "left_semi").groupBy("id").agg(F.collect_list("band").alias("wide"))
    rows = marked.join(wide, "id", "left").withColumn("wide", F.coalesce("wide", F.array().cast("array<long>")))
    return rows.withColumn("a", F.array_except("a", "wide"))


def _keyed(marked: DataFrame, *more: str) -> DataFrame:
    """``(key, id, ...)``: a row for each pair of a band of A and one of B, and for each wide band of A, whose rows cover
    those of all its pairs."""
    rows = marked.select("id", *more, "b", F.explode("a").alias("one")).select("id", *more, "one", F.explode("b").alias("two"))
    wide = marked.select("id", *more, F.explode("wide").alias("one"))
    return rows.select(F.xxhash64("one", "two").alias("key"), "id", *more).union(wide.select(F.xxhash64("one").alias("key"), "id", *more))


def _with_set(pairs: DataFrame, end: str, sets: DataFrame, to: str) -> DataFrame:
    """``pairs`` with the set of the representative in ``end``; where some are in very many pairs, these are salted and
    their sets repeated."""
    salts = cut(pairs.groupBy(end).agg(F.count("*").alias("n")).where(F.col("n") > SALT_ROWS).select(F.col(end).alias("hot"), F.ceil(F.col("n") / SALT_ROWS).cast("long").alias("salts")))
    held = sets.select(F.col("id").alias("own"), F.col("shingles").alias(to))
    if salts.isEmpty():
        return pairs.join(held, F.col(end) == F.col("own")).drop("own")
    salted = pairs.join(salts, F.col(end) == F.col("hot"), "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id", "other"), F.col("salts")), F.lit(0).cast("long"))).drop("hot", "salts")
    held = held.join(salts, F.col("own") == F.col("hot"), "left").select("own", to, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1).cast("long")) - 1)).alias("place"))
    return salted.join(held, (F.col(end) == F.col("own")) & (F.col("salt") == F.col("place"))).drop("own", "place", "salt")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs ``(id, other)`` those whose sets are alike enough."""
    both = _with_set(_with_set(pairs, "id", sets, "x"), "other", sets, "y")
    x, y, shared = F.size("x"), F.size("y"), F.size(F.array_intersect("x", "y"))
    alike = F.when(100 * F.least(x, y) >= percent * F.greatest(x, y), 100 * shared >= percent * (x + y - shared)).otherwise(F.lit(False))
    return both.where(alike).select("id", "other")


def _cross_pairs(rows: DataFrame, key: str, condition: Column | None = None) -> DataFrame:
    """Distinct ``(id, other)`` of different classes under one key."""
    right = rows.select(F.col(key).alias("key2"), F.col("id").alias("other"), F.col("cls").alias("cls2"), *[F.col("n").alias("n2")] * ("n" in rows.columns))
    pairs = rows.join(right, (F.col(key) == F.col("key2")) & (F.col("cls") < F.col("cls2")))
    pairs = pairs if condition is None else pairs.where(condition)
    return pairs.select(F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other")).distinct()


def _several(rows: DataFrame, key: str) -> DataFrame:
    """Keys with rows of several classes, and their numbers of rows."""
    return rows.groupBy(key).agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.count("*").alias("members")).where("lo < hi").select(key, "members")


def _by_prefix(members: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs among ``members(id, cls)`` that can be linked, as they share a shingle of their prefixes; and ``(id, grp)``,
    groups of those whose prefixes share a shingle with many.

    Any one order of all shingles serves; here those with the lowest of COUNTERS counts first. Only the counters come
    to the driver.
    """
    held = sets.join(members, "id").select("id", "cls", "shingles")
    counts = np.zeros(COUNTERS, np.int64)
    for row in held.select(F.explode("shingles").alias("s")).groupBy(F.expr(f"cast(s & {COUNTERS - 1} as int)").alias("slot")).agg(F.count("*").alias("n")).collect():
        counts[row.slot] = row.n
    known = members.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up_cache()
        counters = known.value
        for batch in rows_of(batches):
            for own, cls, shingles in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                s = np.asarray(shingles.values)
                n = len(s)
                first = s[np.lexsort((s, counters[s & (COUNTERS - 1)]))[: n - -(-percent * n // 100) + 1]]
                yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(np.full(len(first), own.as_py())), pa.array(np.full(len(first), cls.as_py())), pa.array(np.full(len(first), n, np.int64))], names=["key", "id", "cls", "n"])

    rows = cut(held.mapInArrow(run, "key long, id long, cls long, n long"))
    rows = cut(rows.join(_several(rows, "key"), "key"))
    pairs = _cross_pairs(rows.where(F.col("members") <= FEW).drop("members"), "key", 100 * F.least("n", "n2") >= percent * F.greatest("n", "n2"))
    dense = rows.where(F.col("members") > FEW)
    ties = dense.join(dense.groupBy("key").agg(F.min("id").alias("low")), "key").select("id", "low").distinct()
    groups = connected_components(ties, "id", "low").select(F.col("node").alias("id"), F.col("component").alias("grp"))
    return pairs, groups


def _tiled(groups: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(id, other)``: links that join all that is linked within the groups, beyond the classes of ``members``."""
    rows = cut(sets.join(groups.join(members, "id"), "id").select("id", "grp", "cls", "shingles", F.size("shingles").alias("n")))
    sizes = rows.groupBy("grp", "cls").agg(F.count("*").alias("n"), F.sum(F.col("n") * 8).alias("b"))
    top = sizes.groupBy("grp").agg(F.max(F.struct("n", "b", "cls")).alias("top"), F.sum("n").alias("n"), F.sum("b").alias("b"), F.count("*").alias("k")).where("k > 1")
    tiles = lambda n, b: F.greatest(F.ceil(n / TILE), F.ceil(b / TILE_BYTES)).cast("long")
    plan = top.select("grp", F.col("top.cls").alias("top"), tiles(F.col("n"), F.col("b")).alias("tiles"), tiles(F.col("n") - F.col("top.n"), F.col("b") - F.col("top.b")).alias("blocks"))
    rows = rows.join(plan, "grp")
    spread = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    right = rows.withColumn("tile", spread("tiles", 1)).withColumn("block", every("blocks"))
    left = rows.where("cls <> top").withColumn("block", spread("blocks", 2)).withColumn("tile", every("tiles"))
    key = ["grp", "tile", "block"]
    both = [x.select(*key, F.lit(side).alias("side"), "id", "cls", "shingles") for side, x in enumerate((left, right))]
    both = both[0].union(both[1]).repartition(*key).sortWithinPartitions(*key, "side", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up_cache()
        now, sides = None, ([], [])

        def links() -> pa.RecordBatch:
            found = compare(*sides, percent)
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["id", "other"])

        for batch in rows_of(batches):
            wheres = zip(*[batch.column(k).to_pylist() for k in range(6)], strict=True)
            for (*where, side, own, cls), shingles in zip(wheres, batch.column(6), strict=True):
                if where != now:
                    if now is not None:
                        yield links()
                    now, sides = where, ([], [])
                sides[side].append((own, cls, np.asarray(shingles.values)))
        if now is not None:
            yield links()

    return both.mapInArrow(run, "id long, other long")


def near_duplicates(df: DataFrame, words: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", also: Sequence[str] = ()) -> DataFrame:
    """``(doc_id, n_shingles, component_id, class_no, ...)`` of every row: component_id is the smallest doc_id reachable over links.

    Documents with the same set are linked. Without words or with a null text a document is linked with nothing, is its
    own component and has no class_no, a number that the rows of one class share. Repeated rows stay, with one class;
    rows that repeat an id with other texts are classed by their own texts; a row with a null doc_id belongs to the class
    of its text and names none, so a class of such rows alone has a null component_id. The columns of ``also`` come along;
    others are left out. An empty table gives an empty one. No bucket, partner or candidate is capped.
    """
    extra = {f"__also_{k}": x for k, x in enumerate(also)}
    own = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *[F.col(f"`{x}`").alias(k) for k, x in extra.items()])
    own = own.withColumn("text_key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    sketch = cut(_sketch(own, words))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))
    reps = sketch.where("set_key is not null").groupBy("set_key").agg(first.alias("row"), F.first("bands").alias("bands"))
    reps = cut(reps.select("set_key", "row.doc_id", "row.text_key", "bands", F.monotonically_increasing_id().alias("id")))
    classes = connected_components(_confirmed(own, reps, words, percent), "id", "other", loops=False)
    named = reps.select("set_key", "id", F.col("doc_id").alias("first_id")).join(classes, F.col("id") == F.col("node"), "left").select("set_key", "first_id", F.coalesce("component", "id").alias("class_no"))
    named = cut(named)
    least = named.groupBy("class_no").agg(F.min("first_id").alias("component_id"))
    joined = sketch.select("doc_id", "n_shingles", "set_key", *extra).join(named.join(least, "class_no").select("set_key", "class_no", "component_id"), "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), "class_no", *[F.col(k).alias(x) for k, x in extra.items()])


def _confirmed(own: DataFrame, reps: DataFrame, words: int, percent: int) -> DataFrame:
    """``(id, other)``: links that join all candidates that are linked."""
    part = lambda at: F.slice("bands", at, BANDS)
    a = cut(_busy(reps.select("id", part(1).alias("bands")), "bands", "a"))
    b = _busy(reps.join(a, "id", "left_semi").select("id", part(1 + BANDS).alias("bands")), "bands", "b")
    marked = cut(_widened(a.join(b, "id")))
    keyed = _keyed(marked)
    leaders = keyed.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("hi")).where("leader < hi").select("key", "leader")
    star = cut(keyed.join(leaders, "key").where("id <> leader").groupBy("id").agg(F.min("leader").alias("other")))
    met = star.select("id").union(leaders.select("leader")).distinct()
    sets = cut(_sets(own, reps.join(met, "id", "left_semi"), words))
    links = cut(_links(star, sets, percent))
    released(own.sparkSession)
    tried = star.select(F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other"))
    if star.isEmpty():
        return links

    def classed(rows: DataFrame) -> DataFrame:
        known = connected_components(links, "id", "other", loops=False).select(F.col("node").alias("id"), F.col("component").alias("now"))
        return rows.drop("cls").join(known, "id", "left").withColumn("cls", F.coalesce("now", "id")).drop("now")

    keyed = _keyed(cut(classed(marked)), "cls")
    rows = cut(keyed.join(_several(keyed, "key"), "key"))
    if rows.isEmpty():
        return links
    for turn in range(1, ROUNDS):
        if rows.where(F.col("members") > FEW).isEmpty():  # few members are compared directly
            break
        order = F.xxhash64("id", F.lit(turn))
        heads = rows.groupBy("key").agg(F.min(F.struct(order.alias("h"), F.col("id").alias("leader"), F.col("cls").alias("lead"))).alias("head"))
        star = rows.join(heads, "key").where("cls <> head.lead").groupBy("id").agg(F.min("head").alias("head")).select("id", F.col("head.leader").alias("other"))
        star = cut(star.join(tried, (F.least(star["id"], star["other"]) == tried["id"]) & (F.greatest(star["id"], star["other"]) == tried["other"]), "left_anti"))
        if star.isEmpty():
            break
        links = cut(links.union(_links(star, sets, percent)))
        tried = cut(tried.union(star.select(F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other"))).distinct())
        rows = classed(rows.drop("members"))
        rows = cut(rows.join(_several(rows, "key"), "key"))
        released(own.sparkSession)
    pairs = _cross_pairs(rows.where(F.col("members") <= FEW).select("key", "id", "cls"), "key")
    members = cut(rows.where(F.col("members") > FEW).select("id", "cls").distinct())
    if not members.isEmpty():
        more, groups = _by_prefix(members, sets, percent)
        released(own.sparkSession)
        pairs = pairs.union(more).distinct()
        links = links.union(_tiled(groups, members, sets, percent))
    return links.union(_links(cut(pairs.join(tried, ["id", "other"], "left_anti")), sets, percent))


def _sets(own: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``(id, shingles)`` of representatives, from the texts of the rows that they stand for."""
    find = wanted.select("id", F.col("doc_id").alias("of"), F.col("text_key").alias("text_of"))
    texts = own.select("doc_id", "text_key", "text").join(find, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("text_of")))
    texts = texts.groupBy("doc_id", "text_key").agg(F.first("id").alias("id"), F.first("text").alias("text")).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up_cache()
        for batch in rows_of(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), _longs([shingle_set(x.as_py(), words) for x in batch.column(1)])], names=["id", "shingles"])

    return texts.mapInArrow(run, "id long, shingles array<long>")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of ``documents`` by 2-word shingles; null and odd rows as in ``near_duplicates``, ``kept`` false for null ids."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"), words=2)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS xs FROM w
), n AS (SELECT doc_id, xs, len(xs)::BIGINT AS n FROM s),
x AS (SELECT doc_id, n, unnest(xs) AS x FROM n),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.x = b.x AND a.doc_id < b.doc_id
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
c(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT c.doc_id, e.b FROM c JOIN e ON c.other = e.a)
SELECT n.doc_id, n.n AS n_shingles, min(c.other) AS component_id, n.doc_id = min(c.other) AS kept
FROM n JOIN c ON n.doc_id = c.doc_id GROUP BY n.doc_id, n.n
"""
