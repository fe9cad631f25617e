"""Near duplicates: a size-aware join of word n-gram sets by Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daypanel.llm import spans
from daypanel.llm.components import components
from daypanel.llm.text import named
from daypanel.sources.tables import written

WORDS = 5
#: Similarity 80/100 in whole numbers: |A & B| * 100 >= 80 * |A | B|.
PER_CENT = 80
#: The largest size for which enumerating subsets is weighed against lists.
SMALL_LIMIT = 24
#: What a list entry costs against a subset's row: it is dealt like one, but what it brings is mostly no link and
#: goes through the joins with classes, first members and both sketches before it is told apart.
SCAN_COST = 8
#: N-grams counted as frequent; they only change in which order a set's n-grams are tried.
FREQUENT = 1 << 18
FREQUENT_SHARE = 0.001
#: Cells of the smallest and the largest sketch; in between a set has two to four for each n-gram.
SKETCHES = (256, 1 << 17)
#: Stands for a null key inside.
NO_KEY = -(1 << 63)
#: Place given to subsets, which have none in a set's order.
SUBSET = (1 << 31) - 1

#: Rows of one token in one run of texts from which on they are dealt out, and to how many places.
HOT, PLACES = 32, 4096
SIGN = np.int64(-1 << 63)

_FACTORS = spans.mix(np.arange(1, WORDS + 2, dtype=np.uint64)) | np.uint64(1)


def overlap_needed(n: int, m: int) -> int:
    """Common n-grams that link sets of n and m."""
    return -(-PER_CENT * (n + m) // (100 + PER_CENT))


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of each text, as sorted 64-bit fingerprints in a row, and the n + 1 places between texts.

    Words are runs of anything but ASCII white space after lower-casing A-Z. A
    text of fewer than `WORDS` words has its whole sequence as its only n-gram;
    one without words has none. A fingerprint sums up its words' hashes, each
    times an odd factor of its place, and mixes the sum. As a word's hash is a
    cryptographic one, two given n-grams agree with a chance of 2**-60 at most
    (factors differ by an even number, which costs some bits), whatever they say.
    """
    data, offsets = spans.buffers(texts)
    low = spans.lower(data)
    starts, ends = spans.blank_words(low, offsets)
    found, inverse = spans.distinct(low, starts, ends)
    words = spans.hashes(found)[inverse]
    first = np.searchsorted(starts, offsets)
    n = np.diff(first)
    count = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
    bounds = np.append(0, np.cumsum(count))
    out = np.empty(bounds[-1], np.uint64)
    is_short = np.zeros(len(out), bool)
    short = np.flatnonzero((n > 0) & (n < WORDS))
    is_short[bounds[short]] = True
    if len(words) >= WORDS:
        size = len(words) - WORDS + 1
        sums = np.zeros(size, np.uint64)
        for j in range(WORDS):
            sums += words[j : j + size] * _FACTORS[j]
        room = np.repeat(first[1:], n)[:size] - np.arange(size)
        out[~is_short] = spans.mix(sums[room >= WORDS])
    for d in short.tolist():
        own = words[first[d] : first[d + 1]]
        terms = np.append(own * _FACTORS[: len(own)], np.array([len(own)], np.uint64) * _FACTORS[WORDS:])
        out[bounds[d]] = spans.mix(terms.sum(dtype=np.uint64, keepdims=True))[0]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[bounds[:-1][count > 0]] = True
    return out[new], np.append(0, np.cumsum(new))[bounds]


def _identity(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set: equal for equal sets."""
    found = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.append(np.uint64(0), np.cumsum(spans.mix(tokens ^ np.uint64(salt)), dtype=np.uint64))
        found.append(sums[bounds[1:]] - sums[bounds[:-1]])
    return found[0].view(np.int64), found[1].view(np.int64)


def _sketches(tokens: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """For each set, the parity of its n-grams in each cell, of which larger sets have more.

    Two sets differ in at least as many n-grams as their sketches differ in bits.
    The n-grams of cell c lie in cell c modulo any smaller number of cells, so a
    larger sketch folds onto a smaller one by exclusive or.
    """
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        cells = min(max(1 << (2 * (b - a)).bit_length(), SKETCHES[0]), SKETCHES[1])
        found = np.bincount((tokens[a:b] & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
        out.append(np.packbits((found & 1).astype(np.uint8)).tobytes())
    return out


def _differing(one: bytes, two: bytes) -> int:
    """Bits in which two sketches differ, the larger folded onto the smaller."""
    x, y = sorted((np.frombuffer(v, np.uint64) for v in (one, two)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def describe(docs: DataFrame) -> DataFrame:
    """Of docs (key, text): rows of kind 0, (key, n, a, b, sketch) per document, and of kind 1, (a, n) per n-gram
    that is frequent in a task and in how many of its documents it stands."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "key", "n", "a", "b", "sketch"]
        seen, often, times = 0, [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for batch in batches:
            for at, part in spans.parts(batch.column(1)):
                tokens, bounds = shingles(part)
                a, b = _identity(tokens, bounds)
                k = len(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.zeros(k, np.int8)),
                        batch.column(0).slice(at, k),
                        pa.array(np.diff(bounds)),
                        pa.array(a),
                        pa.array(b),
                        pa.array(_sketches(tokens, bounds), pa.binary()),
                    ],
                    names,
                )
                values, n = np.unique(tokens, return_counts=True)
                often.append(values[n > 1])
                times.append(n[n > 1])
                seen += k
        values, inverse = np.unique(np.concatenate(often), return_inverse=True)
        n = np.bincount(inverse, np.concatenate(times), len(values)).astype(np.int64)
        some = n >= max(4, FREQUENT_SHARE * seen)
        k = int(some.sum())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.ones(k, np.int8)),
                pa.nulls(k, pa.int64()),
                pa.array(n[some]),
                pa.array(values[some].view(np.int64)),
                pa.nulls(k, pa.int64()),
                pa.nulls(k, pa.binary()),
            ],
            names,
        )

    return docs.mapInArrow(read, "kind byte, key long, n long, a long, b long, sketch binary")


def frequent(described: DataFrame, docs: int, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams in order, documents) of the most frequent n-grams, at most `most`: a table of bounded size.

    Any choice gives the same links, as it only orders the n-grams of a set.
    """
    found = described.filter("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT_SHARE / 2 * docs)
    level = F.floor(F.log2("n")).cast("int").alias("level")
    levels = {r["level"]: r["grams"] for r in found.groupBy(level).agg(F.count(F.lit(1)).alias("grams")).collect()}
    least, held = 64, 0
    while least > 0 and held + levels.get(least - 1, 0) <= most:
        least -= 1
        held += levels.get(least, 0)
    rows = found.filter(F.col("n") >= F.lit(2.0) ** least).select("a", "n").toPandas()
    tokens, n = rows["a"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(tokens)
    return tokens[order], n[order]


def prefix(n: int) -> int:
    """N-grams of a set of n of which any linked set holds one, in whatever common order."""
    return n - -(-PER_CENT * n // 100) + 1


def subset_sizes(n: int, small: int) -> list[tuple[int, int]]:
    """(partner's size, common n-grams needed) for a small set's small partners that aren't its equal."""
    least, most = -(-PER_CENT * n // 100), min(small, 100 * n // PER_CENT)
    sizes = [(m, overlap_needed(n, m)) for m in range(max(1, least), most + 1)]
    return [(m, c) for m, c in sizes if c <= min(n, m) and not (m == n == c)]


def boundary(sizes: dict[int, int]) -> int:
    """The size up to which subsets are enumerated: where their rows and the lists' scans cost least in all.

    `sizes` has how many sets there are of each size up to `SMALL_LIMIT`.
    """

    def cost(small: int) -> int:
        subsets = sum(k * sum(comb(n, c) for _, c in subset_sizes(n, small)) for n, k in sizes.items() if n <= small)
        listed = sum(k * prefix(n) for n, k in sizes.items() if 100 * n >= PER_CENT * (small + 1))
        return subsets + SCAN_COST * listed

    return min(range(SMALL_LIMIT + 1), key=cost)


def postings(docs: DataFrame, small: int, often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(token, key, held): what may bring two sets together; `held` packs the set's size and the token's place in it.

    A small set gives its subsets of each fixed size that a link with a small
    partner needs. A set that may link with a large one gives its first n-grams,
    rare ones first: any two linked sets have one of these in common. Of equal
    sets in one task only the first is listed. Rows of a token that many texts of
    one run hold have the sign of `held` set, and are dealt apart: it is known that
    they are not alone. One of them is listed without the sign too, for the rows of
    other runs to meet.
    """
    sent = docs.sparkSession.sparkContext.broadcast(often)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, times = sent.value
        rank = np.empty(len(grams), np.int64)
        rank[np.argsort(times, kind="stable")] = np.arange(1, len(grams) + 1)
        listed: set = set()
        for batch in batches:
            for at, part in spans.parts(batch.column(1)):
                keys = batch.column(0).slice(at, len(part)).to_numpy(zero_copy_only=False)
                tokens, bounds = shingles(part)
                n = np.diff(bounds)
                identity = list(zip(*(x.tolist() for x in _identity(tokens, bounds)), n.tolist(), strict=True))
                fresh = np.array([x not in listed and not listed.add(x) for x in identity], bool) & (n > 0)
                if len(listed) > 1 << 20:
                    listed.clear()
                text = np.repeat(np.arange(len(n)), n)
                order = np.zeros(len(tokens), np.int64)
                if len(grams):
                    k = np.minimum(np.searchsorted(grams, tokens), len(grams) - 1)
                    order = np.where(grams[k] == tokens, rank[k], 0)
                sequence = np.argsort(text << 32 | order, kind="stable")
                place = np.arange(len(tokens)) - bounds[text]
                length = n - -(-PER_CENT * n // 100) + 1
                length[100 * n < PER_CENT * (small + 1)] = 0
                length[~fresh] = 0
                taken = place < length[text]
                owner = text[taken]
                columns = [[tokens[sequence][taken]], [keys[owner]], [n[owner]], [place[taken]]]
                for d in np.flatnonzero(fresh & (n <= small)).tolist():
                    own = tokens[bounds[d] : bounds[d + 1]]
                    for m, c in subset_sizes(len(own), small):
                        salt = spans.mix(np.array([min(len(own), m) << 32 | max(len(own), m)], np.uint64))
                        picked = own[np.array(list(combinations(range(len(own)), c)))]
                        subset = spans.mix(spans.mix(picked).sum(axis=1, dtype=np.uint64) + salt)
                        for column, value in zip(columns, (subset, keys[d], len(own), SUBSET), strict=True):
                            column.append(np.broadcast_to(value, len(subset)))
                token, key, size, where = (np.concatenate(c) for c in columns)
                held, key = (size.astype(np.int64) << 32) | where.astype(np.int64), key.astype(np.int64)
                _, one, inverse, times = np.unique(token, return_index=True, return_inverse=True, return_counts=True)
                hot = times >= HOT
                one = one[hot]
                signed = np.where(hot[inverse], held | SIGN, held)
                columns = (token.view(np.int64), token.view(np.int64)[one]), (key, key[one]), (signed, held[one])
                yield pa.RecordBatch.from_arrays([pa.array(np.append(a, b)) for a, b in columns], ["token", "key", "held"])

    return docs.mapInArrow(read, "token long, key long, held long")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in token order, those whose token has another row or that have the sign; one row is held over."""
    last, waiting = None, None
    for batch in batches:
        token = batch.column(0).to_numpy()
        if not len(token):
            continue
        same = token[1:] == token[:-1]
        keep = np.zeros(len(token), bool)
        keep[1:] |= same
        keep[:-1] |= same
        keep |= batch.column(2).to_numpy() < 0
        if last is not None and token[0] == last:
            keep[0] = True
            if waiting is not None:
                yield waiting
        waiting = None if keep[-1] else batch.slice(len(token) - 1, 1)
        last = token[-1]
        yield batch.filter(pa.array(keep))


def tokens_of(docs: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """(key, tokens) of the documents whose key is in `keys`, and of a few more.

    A bit map of fixed size tells tasks which documents to read closer, so none
    moves whole; when many keys fill the map it passes more than it must.
    """
    bits = 1 << 23
    bit = F.pmod(F.xxhash64(key), F.lit(bits))
    words = keys.select(F.floor(bit / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toPandas()
    table = np.zeros(bits // 64, np.int64)
    table[rows["word"].to_numpy(np.int64)] = rows["bit"].to_numpy(np.int64)
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(sent.value.view(np.uint8), bitorder="little")
        for batch in batches:
            batch = batch.filter(pa.array(flags[batch.column(2).to_numpy()] == 1))
            for at, part in spans.parts(batch.column(1)):
                tokens, bounds = shingles(part)
                sets = [tokens[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.array(sets, pa.binary())], ["key", "tokens"]
                )

    return docs.withColumn("bit", bit).mapInArrow(read, "key long, tokens binary")


def _near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches leave a link possible."""
    side = lambda x: sets.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            differing = np.array([_differing(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column(3), batch.column(5), strict=True)])
            # |A ^ B| = n + m - 2 |A & B|
            most = n + m - 2 * -(-PER_CENT * (n + m) // (100 + PER_CENT))
            near = (differing <= most) & (100 * np.minimum(n, m) >= PER_CENT * np.maximum(n, m))
            yield batch.select([0, 1]).filter(pa.array(near))

    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "s_a", "n_b", "s_b")
    return joined.mapInArrow(check, "a long, b long")


def _linked(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose sets link, by comparing the whole sets."""
    ends = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    sets = written(tokens_of(docs, ends))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                one, two = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * common >= PER_CENT * (len(one) + len(two) - common) and common > 0)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    first = sets.select(F.col("key").alias("a"), F.col("tokens").alias("tokens_a"))
    second = sets.select(F.col("key").alias("b"), F.col("tokens").alias("tokens_b"))
    joined = pairs.join(first, "a").join(second, "b").select("a", "b", "tokens_a", "tokens_b")
    return joined.mapInArrow(check, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: (key, n_shingles, component_id).

    Documents link when the Jaccard similarity of their sets of five-word
    n-grams is at least 0.8; `component_id` is the smallest key reachable by
    links. The join is size-aware. Small sets meet on enumerated subsets of the
    size that a link needs; large ones by inverted lists of their rarest
    n-grams, which are scanned with one merge sort; where small ends is chosen
    by cost from the sizes of all sets (`boundary`). Equal sets are one class
    from the start. A list is first compared with its first member only; after
    these links are drawn, only members of one list in different components are
    compared with each other. So a group of n near copies costs some n
    comparisons, not all pairs, and no link that joins components is lost. All
    candidates are verified on their whole sets of 64-bit fingerprints, so that
    a pair of sets of n and m n-grams is misjudged with a chance of n m / 2**60 at
    most.

    Null or empty texts, or texts without words, have no n-grams and link with
    nothing. Rows that repeat a key link if any of their texts do, and each has
    its own n_shingles; rows of a null key link too, and a null component_id is
    theirs. An empty table gives no rows; other columns are not read.
    """
    own = docs.select(F.coalesce(named(key).cast("long"), F.lit(NO_KEY)).alias("key"), named(text).alias("text"))
    described = written(describe(own))
    sets = described.filter("kind = 0").select("key", "n", "a", "b", "sketch")
    total = sets.count()
    sizes = {r["n"]: r["k"] for r in sets.filter(F.col("n").between(1, SMALL_LIMIT)).groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}
    listed = postings(own, boundary(sizes), frequent(described, total))
    apart = F.when(F.col("held") < 0, 1 + F.pmod(F.xxhash64("key"), F.lit(PLACES))).otherwise(0)
    ordered = listed.repartition("token", apart).sortWithinPartitions("token", "key")
    shared = ordered.mapInArrow(_shared, "token long, key long, held long")
    shared = shared.withColumn("held", F.col("held").bitwiseAND(F.lit((1 << 63) - 1)))

    # Equal sets: the smallest key stands for them.
    full = sets.filter("n > 0").select("key", "n", "a", "b")
    classes = full.groupBy("n", "a", "b").agg(F.min("key").alias("class"), F.count(F.lit(1)).alias("k"))
    # Stored, so that the join deals both sides anew and can split a large class.
    classes = written(classes.filter("k > 1").drop("k"))
    members = written(full.join(classes, ["n", "a", "b"], "left").select("key", F.coalesce("class", "key").alias("class"), "n"))
    heads = sets.join(members.filter("key = class").select("key").distinct(), "key").select("key", "n", "sketch")
    sketches = written(heads.dropDuplicates(["key", "n", "sketch"]))
    of_class = members.select("key", "class").distinct()
    lists = written(shared.join(of_class, "key").select("token", F.col("class").alias("key"), "held").distinct())

    first = lists.groupBy("token").agg(F.min("key").alias("a"), F.max("key").alias("z")).filter("a < z").select("token", "a")
    pairs = lists.join(first, "token").filter("key <> a").select("a", F.col("key").alias("b")).distinct()
    tried = written(_near(pairs, sketches).distinct())
    links = written(_linked(tried, own))

    grouped = components(links)
    of_node = grouped.select(F.col("node").alias("key"), "component")
    placed = lists.select("token", "key").join(of_node, "key", "left").withColumn("component", F.coalesce("component", "key"))
    torn = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("token")
    left = lists.join(torn, "token").join(of_node, "key", "left")
    left = written(left.select("token", "key", "held", F.coalesce("component", "key").alias("component")))
    right = left.select("token", F.col("key").alias("other"), F.col("held").alias("other_held"), F.col("component").alias("other_component"))
    rest = left.join(right, "token").filter(F.col("component") < F.col("other_component")).filter(_reach("held", "other_held"))
    rest = rest.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct()
    rest = written(_near(rest.join(tried, ["a", "b"], "left_anti"), sketches).distinct())
    if not rest.isEmpty():
        links = links.unionByName(_linked(rest, own))
        grouped = components(links)

    where = members.join(grouped, members["class"] == grouped["node"], "left").select(
        F.col("key").alias("member"), F.col("n").alias("member_n"), F.coalesce("component", "class").alias("component")
    )
    lowest = where.groupBy("member").agg(F.min("component").alias("component"))
    out = sets.select("key", "n").join(lowest, sets["key"] == lowest["member"], "left")
    known = lambda c: F.when(c != NO_KEY, c)
    return out.select(
        known(F.col("key")).alias(key), F.col("n").alias("n_shingles"), known(F.coalesce("component", "key")).alias("component_id")
    )


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of `docs` per component: that of the smallest key, a null one being smaller than any other.

    Rows link by their texts alone, so rows of a null or repeated key fall
    together only where their n-grams do. Rows without n-grams all stay, and so
    do all columns, whatever their names; an empty table gives no rows.
    """
    numbered = docs.select(
        F.struct(*[named(c) for c in docs.columns]).alias("row"),
        F.coalesce(named(key).cast("long"), F.lit(NO_KEY)).alias("key"),
        F.xxhash64(named(text)).alias("print"),
        F.monotonically_increasing_id().alias("row_id"),
    )
    # Stored, so that each later reading finds the same numbers.
    numbered = written(numbered)
    found = near_duplicates(numbered.select("row_id", F.col("row")[text].alias("text")), "row_id", "text")
    placed = found.select("row_id", "component_id").join(numbered.select("row_id", "key", "print"), "row_id")
    least = placed.groupBy("component_id").agg(F.min(F.struct("key", "print", "row_id")).alias("least"))
    kept = least.select(F.col("least.row_id").alias("row_id"))
    return numbered.join(kept, "row_id", "left_semi").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def _reach(one: str, two: str) -> Column:
    """Whether two sets that share an n-gram at their places can have enough in common."""
    n, p = F.shiftright(one, 32), F.col(one).bitwiseAND(F.lit((1 << 32) - 1))
    m, q = F.shiftright(two, 32), F.col(two).bitwiseAND(F.lit((1 << 32) - 1))
    needed = F.ceil(PER_CENT * (n + m) / F.lit(100 + PER_CENT))
    return (p == SUBSET) | (q == SUBSET) | (F.least(n - p, m - q) >= needed)
